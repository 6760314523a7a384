"""A Merkle tree over the rows of a dataset, a subtree for each group, with a proof for each row.

Leaves are range-sorted by group and row over all partitions. Where a group's leaves start in a
partition follows from the counts of the partitions before, so every leaf knows its place in
its group's tree. A task builds all nodes whose leaves it has in full (runs of ``FANOUT`` are
aligned, so these are complete subtrees); what is left at either end of a partition, a few nodes a
level, is shuffled by its coordinate (group, level, run), and each round of that finishes one level of the
upper part. Groups that lie within a partition are finished there. The groups' roots are the
leaves of one more tree, built the same way.

For the proofs the runs that the shuffle has finished go back to the partitions below them, a few for
each level, and each task folds its leaves up to the root.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.linking import merged
from tamarisk.llm.store import Scratch

FANOUT = 3
#: Leaves a task of the tree over the groups' roots.
ROOTS_A_TASK = 100_000
OTHERS = "array<struct<level:int,parent:bigint,nodes:array<string>>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """Lower-case hexadecimal sha256 of the parts, one after another."""
    return sha256(b"".join(parts)).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    """A row's digest: sha256 over the columns, each marked with its length, so that no two rows read the same."""
    return F.sha2(F.concat(*(field(c) for c in columns.values())), 256)


def range_sorted(leaves: DataFrame, order: list[Column], partitions: int, scratch: Scratch) -> DataFrame:
    """``leaves`` (with ``grp`` and ``leaf``) in the order of grp and ``order``: with ``p``, the partition, and ``i``, the place in it."""
    keys = [F.col("grp").asc_nulls_first(), *order]
    rows = leaves.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    return scratch.put(rows.withColumn("i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).withColumn("p", F.spark_partition_id()), "sorted")


def pieces(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(p, grp, n, i, start, total) of each group's run in each partition: its rows, the place of the first, the group's rows in the partitions before and in all."""
    counts = scratch.put(rows.groupBy("p", "grp").agg(F.count("*").alias("n"), F.min("i").alias("i")), "counts")
    # a group has a row for each partition at most
    group = Window.partitionBy("grp")
    before = group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return scratch.put(counts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(group).alias("total")), "pieces")


@dataclasses.dataclass
class Piece:
    """The complete nodes of a group's leaves ``start`` to ``start + len(leaves)`` of ``total``; ``levels[k]`` begins at coordinate ``begins[k]``."""

    start: int
    total: int
    leaves: list[bytes]

    def __post_init__(self) -> None:
        self.begins, self.levels = [self.start], [self.leaves]
        whole = self.start == 0 and len(self.leaves) == self.total
        while len(self.levels[-1]) > 1 or not whole:
            begin, nodes = self.begins[-1], self.levels[-1]
            low = -(-begin // FANOUT)
            # within one partition the last run may be short; else whoever has the rest finishes it
            high = -(-len(nodes) // FANOUT) if whole else (begin + len(nodes)) // FANOUT
            if high <= low:
                break
            self.begins.append(low)
            self.levels.append([digest(*nodes[FANOUT * q - begin : FANOUT * (q + 1) - begin]) for q in range(low, high)])

    @property
    def spans(self) -> bool:
        return len(self.leaves) < self.total

    def ragged(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, coordinate, node) of all nodes whose parent is not among the own ones."""
        for k, (begin, nodes) in enumerate(zip(self.begins, self.levels, strict=True)):
            low, high = (FANOUT * self.begins[k + 1], FANOUT * (self.begins[k + 1] + len(self.levels[k + 1]))) if k + 1 < len(self.levels) else (begin, begin)
            for j, node in enumerate(nodes, begin):
                if not low <= j < high:
                    yield k, j, node

    def run(self, level: int, parent: int, others: dict[tuple[int, int], list[bytes]]) -> list[bytes]:
        """The nodes of a level below ``parent``: own ones, or those that came from the shuffle."""
        if (found := others.get((level, parent))) is not None:
            return found
        at = FANOUT * parent - self.begins[level]
        return self.levels[level][at : at + FANOUT]

    def paths(self, others: dict[tuple[int, int], list[bytes]]) -> Iterator[list[tuple[bytes, bytes]]]:
        """Of each leaf, from level to level, what stands to its left and to its right in its run. The list is reused."""
        height, n = 0, self.total
        while n > 1:
            height, n = height + 1, -(-n // FANOUT)
        last, sides = [-1] * height, [(b"", b"")] * height
        for j in range(self.start, self.start + len(self.leaves)):
            for level in range(height):
                if last[level] == j:  # all levels above are those of the leaf before
                    break
                last[level] = j
                j, place = divmod(j, FANOUT)
                run = self.run(level, j, others)
                sides[level] = b"".join(run[:place]), b"".join(run[place + 1 :])
            yield sides


def folded(node: bytes, sides: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node leads to beside these siblings."""
    for left, right in sides:
        node = digest(left, node, right)
    return node


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Table]]:
    """Each piece's own row, and its leaves, which follow it in the stream."""
    head, held = None, []
    for batch in batches:
        heads = np.flatnonzero(batch.column("is_leaf").to_numpy(zero_copy_only=False) == 0).tolist()
        for at, end in zip([0, *heads], [*heads, batch.num_rows], strict=True):
            if at in heads:
                if head is not None:
                    yield head, pa.Table.from_batches(held, batch.schema)
                head, held, at = batch.slice(at, 1).to_pylist()[0], [], at + 1
            if end > at:
                held.append(batch.slice(at, end - at))
    if head is not None:
        yield head, pa.Table.from_batches(held, batch.schema)


def _together(rows: DataFrame, heads: DataFrame, partitions: int) -> DataFrame:
    """Leaves and the rows of their pieces, which come first, dealt by partition and in order."""
    both = heads.withColumn("is_leaf", F.lit(0)).unionByName(rows.withColumn("is_leaf", F.lit(1)), allowMissingColumns=True)
    return both.repartitionById(partitions, F.col("p")).sortWithinPartitions("p", "i", "is_leaf")


def _leaves(table: pa.Table) -> list[bytes]:
    return table.column("leaf").cast(pa.large_binary()).to_pylist()


@dataclasses.dataclass
class Forest:
    """Trees of groups: sorted leaves, their pieces, with ``others`` (level, parent, nodes) that come from the shuffle, and (grp, node) of the roots."""

    rows: DataFrame
    heads: DataFrame
    roots: DataFrame
    partitions: int


def forest(leaves: DataFrame, order: list[Column], partitions: int, scratch: Scratch) -> Forest:
    """The tree of each ``grp`` over its ``leaf`` values in order; other columns stay with the leaves."""
    rows = range_sorted(leaves, order, partitions, scratch)
    heads = pieces(rows, scratch)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, table in _by_piece(batches):
            piece = Piece(head["start"], head["total"], _leaves(table))
            found = piece.ragged() if piece.spans else [(-1, 0, piece.levels[-1][0])]
            out += [(head["grp"], head["total"], k, j, node.decode()) for k, j, node in found]
            if len(out) >= 10_000:
                yield from _batch(out, "grp total level j node", (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))
                out = []
        yield from _batch(out, "grp total level j node", (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))

    climbed = scratch.put(_together(rows.select("p", "i", "leaf"), heads, partitions).mapInArrow(climb, "grp string, total long, level int, j long, node string"), "climbed")
    # the node of a group that lies in one partition is its root; the others go on by coordinate
    roots, runs, up, level = climbed.where("level = -1").select("grp", "node"), None, None, 0
    most = climbed.where("level >= 0").agg(F.max("total")).first()[0] or 0
    while FANOUT**level < most:
        here = climbed.where(F.col("level") == level).select("grp", "total", "j", "node")
        here = here if up is None else here.union(up.where(F.col("total") > FANOUT**level))
        run = here.groupBy("grp", "total", F.expr(f"j DIV {FANOUT}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("j", "node"))).alias("nodes"))
        run = scratch.put(run.select("grp", "total", F.lit(level).alias("level"), "parent", F.col("nodes.node").alias("nodes")), f"level{level}")
        runs = run if runs is None else runs.union(run)
        up = run.select("grp", "total", F.col("parent").alias("j"), F.sha2(F.array_join("nodes", ""), 256).alias("node"))
        level += 1
        roots = roots.union(up.where(F.col("total") <= FANOUT**level).select("grp", "node"))
    if runs is None:
        return Forest(rows, heads.withColumn("others", F.lit(None).cast(OTHERS)), roots, partitions)
    # the runs above a piece that are not its own are those over its first and its last leaf
    power = F.get(F.array(*(F.lit(FANOUT**k).cast("long") for k in range(level + 1))), F.col("level") + 1)
    wanted = heads.where("n < total").select("p", "grp", "start", "n", "total", F.explode(F.sequence(F.lit(0), F.lit(level - 1))).alias("level")).withColumn("power", power).where(f"total * {FANOUT} > power")
    wanted = wanted.select("p", "grp", "level", F.explode(F.array_distinct(F.array(F.expr("start DIV power"), F.expr("(start + n - 1) DIV power")))).alias("parent"))
    found = merged(wanted, runs.select("grp", "level", "parent", "nodes"), ["grp", "level", "parent"]).groupBy("p", "grp").agg(F.collect_list(F.struct("level", "parent", "nodes")).alias("others"))
    return Forest(rows, merged(heads, found, ["p", "grp"], "left"), roots, partitions)


def _batch(rows: list[tuple], names: str, types: tuple) -> Iterator[pa.RecordBatch]:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names.split())


def _others(head: dict) -> dict[tuple[int, int], list[bytes]]:
    return {(o["level"], o["parent"]): [n.encode() for n in o["nodes"]] for o in head["others"] or ()}


def siblings(trees: Forest, key: str) -> DataFrame:
    """(key, lefts, rights) of each leaf: the digests beside it from level to level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, table in _by_piece(batches):
            piece, out = Piece(head["start"], head["total"], _leaves(table)), []
            for k, sides in zip(table.column(key).to_pylist(), piece.paths(_others(head)), strict=True):
                out.append((k, [a.decode() for a, _ in sides], [b.decode() for _, b in sides]))
                if len(out) >= 1000:
                    yield from _batch(out, f"{key} lefts rights", (pa.string(), pa.list_(pa.string()), pa.list_(pa.string())))
                    out = []
            yield from _batch(out, f"{key} lefts rights", (pa.string(), pa.list_(pa.string()), pa.list_(pa.string())))

    both = _together(trees.rows.select("p", "i", "leaf", key), trees.heads.select("p", "i", "start", "total", "others"), trees.partitions)
    return both.mapInArrow(run, f"{key} string, lefts array<string>, rights array<string>")


def hashed(docs: DataFrame, tampered: Callable[[dict[str, Column]], Column] | None = None) -> DataFrame:
    """(grp, doc_id, leaf, altered): ``grp`` orders like the source, null first; ``altered`` is the digest with the text of ``tampered``, where that differs."""
    own = {c: docs[f"`{c}`"] for c in FIELDS}
    own["doc_id"] = own["doc_id"].cast("long")
    out = docs.select(F.coalesce(F.concat(F.lit(" "), own["source"].cast("string")), F.lit("")).alias("grp"), own["doc_id"].alias("doc_id"), leaf(own).alias("leaf"), (leaf(own | {"text": tampered(own)}) if tampered else F.lit(None).cast("string")).alias("altered"))
    # numbered as it is written, so that repeated rows have an order, too
    return out.withColumn("altered", F.when(F.col("altered") != F.col("leaf"), F.col("altered"))).withColumn("row", F.monotonically_increasing_id())


def without_newlines(row: dict[str, Column]) -> Column:
    """The text without line breaks in rows whose decimal doc_id has an even checksum; a null doc_id is left alone."""
    text = row["text"].cast("string")
    return F.when(F.crc32(row["doc_id"].cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def manifest(docs: DataFrame, tampered: Callable[[dict[str, Column]], Column] | None = without_newlines, with_siblings: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; with ``with_siblings`` the proof itself, too: ``lefts`` and ``rights``.

    The leaf is a digest of doc_id, source, lang, n_chars and text; other columns take no part, whatever
    their names. Nulls count as ``-`` and differ from empty texts; null sources are one group, which comes first,
    before that of the empty string. Leaves of a group are in the order of doc_id, null first, then by digest, so rows that
    share a doc_id have one order and repeated rows are leaves each. ``folded_root`` starts from the leaf of the text that
    ``tampered`` makes (None: the row as it is) and is null nowhere. Each row is hashed whole at any length.
    A table of one row has its leaf as root and an empty proof; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = scratch.put(hashed(docs, tampered), "leaves")
    trees = forest(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")], partitions, scratch)
    scratch.drop(leaves)
    roots = scratch.put(trees.roots, "roots")
    above = forest(roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("node").alias("leaf")), [F.col("key")], max(1, -(-roots.count() // ROOTS_A_TASK)), scratch)
    # one digest, the dataset's
    top = above.roots.agg(F.max("node")).first()[0]
    root = (top or "").encode()
    beside = siblings(above, "key").withColumnRenamed("key", "grp")
    group = merged(roots.select("grp", F.col("node").alias("subroot")), beside, "grp")
    heads = scratch.put(merged(trees.heads, group, "grp"), "heads")

    names = "doc_id leaf subroot root proof_sha256 folded_root verified lefts rights"
    types = (pa.int64(), *[pa.string()] * 5, pa.bool_(), *[pa.list_(pa.string())] * 2)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, table in _by_piece(batches):
            piece, out = Piece(head["start"], head["total"], _leaves(table)), []
            over = [(a.encode(), b.encode()) for a, b in zip(head["lefts"], head["rights"], strict=True)]
            for k, own, other, sides in zip(table.column("doc_id").to_pylist(), piece.leaves, table.column("altered").to_pylist(), piece.paths(_others(head)), strict=True):
                path = sides + over
                end = folded(other.encode() if other else own, path)
                proof = ([a.decode() for a, _ in path], [b.decode() for _, b in path]) if with_siblings else (None, None)
                out.append((k, own.decode(), head["subroot"], root.decode(), digest(*(x for side in path for x in side)).decode(), end.decode(), end == root, *proof))
                if len(out) >= 1000:
                    yield from _batch(out, names, types)
                    out = []
            yield from _batch(out, names, types)

    both = _together(trees.rows.select("p", "i", "doc_id", "leaf", "altered"), heads.select("p", "i", "start", "total", "others", "subroot", "lefts", "rights"), partitions)
    out = both.mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, lefts array<string>, rights array<string>")
    return out if with_siblings else out.drop("lefts", "rights")


def oracle_sql(levels: int = 14) -> str:
    """The same rows in DuckDB, level by level, for groups of 3 ** ``levels`` rows and as many groups at most."""
    sized = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: f"sha256({' || '.join(sized(c) for c in FIELDS[:-1])} || {sized(text)})"
    crc = (
        "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CAST(3988292384 AS BIGINT) * (v & 1))))"
    )
    parts = [
        f"d AS (SELECT doc_id, coalesce(' ' || source, '') AS grp, {row('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {row("replace(text, chr(10), '')")} END AS altered FROM documents)",
        "a0 AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j, leaf AS h, count(*) OVER (PARTITION BY grp) AS n, doc_id, altered FROM d)",
    ]

    def tree(x: str) -> None:
        for k in range(levels):
            parts.append(f"{x}r{k} AS (SELECT grp, j // 3 AS q, list(h ORDER BY j) AS hs, max(n) AS n FROM {x}{k} GROUP BY grp, j // 3)")
            parts.append(f"{x}{k + 1} AS (SELECT grp, q AS j, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 2) // 3 AS n FROM {x}r{k})")

    tree("a")
    parts.append(f"b0 AS (SELECT '' AS grp, grp AS of, row_number() OVER (ORDER BY grp) - 1 AS j, h, count(*) OVER () AS n FROM a{levels})")
    tree("b")
    parts.append("f0 AS (SELECT a0.doc_id, a0.grp AS agrp, a0.j AS aj, a0.h AS leaf, coalesce(a0.altered, a0.h) AS node, '' AS proof, b0.grp AS bgrp, b0.j AS bj, b0.h AS subroot FROM a0 JOIN b0 ON b0.of = a0.grp)")
    for step, (x, k) in enumerate((x, k) for x in "ab" for k in range(levels)):
        place = f"({x}j // {3**k}) % 3"
        left, right = f"array_to_string(hs[1:{place}], '')", f"array_to_string(hs[{place} + 2:], '')"
        parts.append(
            f"f{step + 1} AS (SELECT f.* REPLACE (CASE WHEN n = 1 THEN node ELSE sha256({left} || node || {right}) END AS node, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof) "
            f"FROM f{step} AS f JOIN {x}r{k} AS r ON r.grp = f.{x}grp AND r.q = f.{x}j // {3 ** (k + 1)})"
        )
    return f"WITH {', '.join(parts)} SELECT f.doc_id, f.leaf, f.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = t.h AS verified FROM f{2 * levels} AS f CROSS JOIN b{levels} AS t"
