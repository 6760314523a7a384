"""tamarisk: a Spark-native engine for moderating and curating multilingual text.

Everything is expressed over DataFrames. Word lists, label maps and language
ranges are data handed in as tables or arguments, never code paths.
"""

from tamarisk.session import session

__all__ = ["session"]
