"""Operators for building large-model training corpora.

Nothing else in the library imports this subpackage. ``queries()`` and
``oracle_sql()`` list its registered queries for ``__spark_entry__``.
"""
