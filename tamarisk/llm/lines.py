"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Lines of one class of lengths have ``edits + 1`` segments of one size: the first ones count
from the start, the others from the end. Of the segments of the shorter of two lines that
are within ``edits``, one, the i-th, is unchanged after exactly i - 1 edits; so it lies in
the longer line at the same place from its end of the line, but for i - 1 (or, from the end,
``edits`` + 1 - i) characters. Every line is indexed under its segments and probes with the
substrings at all these places.

A long segment names only a part of itself: what follows the first space among its first
``GAP`` characters. Probes at neighbouring places mostly find the same space and so the same
substring, which halves the rows; an unchanged segment still names the same part.

Lines that meet in a bucket are tested by :mod:`linking`, with counts of some letters and
a thresholded distance of Spark's own as necessary conditions in the join, and verified by a banded bit-parallel edit distance; linked lines form
components, of which the first line stays. A count is a ring code of eight bits, and eight of
them are one long: the join compares three longs, as a condition on each count would be a
method too large to compile. Equal lines are one item from the first
aggregation on, which the map side starts. Only lines that share a bucket are read again as
text, behind a Bloom filter of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import store
from tamarisk.llm import words as W
from tamarisk.llm.linking import components, differing, merged, sifted
from tamarisk.llm.store import Scratch

EDITS = 1
#: (code points, edits): what op4_lines and the pipeline allow, one edit for each 20 code points of the shorter line.
BY_LENGTH = ((20, 1), (40, 2), (60, 3), (80, 4))
#: So many levels of the banded distance fit into one long.
MOST_EDITS = 4
#: Lines of more code points are one class of lengths.
LONG = 2000
#: Shorter lines (code points) have no near copies; equal ones go only with ``exact``.
SHORTEST = 20
#: (size of a segment, characters at its start among which a space is looked for): what is left must tell lines apart.
GAPS = ((28, 12), (24, 8))
NO_ID = -(1 << 63)
#: (segment, shift) of every substring that a line may name; negative segments count from the end. A line
#: of ``edits`` names the first ``edits + 1`` segments of 1, -1, 2, -2, 3.
SEGMENTS = (1, -1, 2, -2, 3)
SLOTS = tuple((i, shift) for i in SEGMENTS for shift in sorted(range(1 - abs(i), abs(i)), key=abs))

#: Bits of a line's length beside its number; longer lines have the greatest such length.
LENGTH_BITS = 12
#: Letters whose counts are compared, in Latin and in Arabic script; each once, as a letter that counts twice would make one edit two.
LETTERS = "".join(dict.fromkeys("etaoinsrhlducmيمونرتهلا"))
#: Eight bits for each count modulo 16; neighbours, the last and the first as well, differ in one bit.
RING = tuple((1 << v) - 1 if v < 8 else (0xFF << (v - 8)) & 0xFF for v in range(16))
#: Longs that the ring codes of all letters take, eight a long.
COUNT_WORDS = -(-len(LETTERS) // 8)


def classes(edits: int | tuple[tuple[int, int], ...], shortest: int) -> list[tuple[int, float, int, int]]:
    """(low, high, edits, size of a segment) of the classes of lengths; ``edits`` + 1 segments fit into each line of a class."""
    steps = ((shortest, edits),) if isinstance(edits, int) else tuple((max(low, shortest), e) for low, e in edits)
    if most_edits(steps) > MOST_EDITS:
        raise ValueError(f"at most {MOST_EDITS} edits: the levels of the banded distance share one long")
    out: list[tuple[int, float, int, int]] = []
    for (low, e), above in zip(steps, [*(x for x, _ in steps[1:]), float("inf")], strict=True):
        while low < above:
            high = min(above, max(low + 8, low + low // 2)) if low < LONG else above
            out.append((low, high, e, low // (e + 1)))
            low = high
    return out


def allowed(length: Column, edits: int | tuple[tuple[int, int], ...]) -> Column:
    """The edits that two lines may be apart, by the length of the shorter one."""
    if isinstance(edits, int):
        return F.lit(edits)
    out = F.lit(edits[0][1])
    for low, e in edits[1:]:
        out = F.when(length >= low, e).otherwise(out)
    return out


def most_edits(edits: int | tuple[tuple[int, int], ...]) -> int:
    """The greatest number of edits at any length."""
    return edits if isinstance(edits, int) else max(e for _, e in edits)


def of_length(length: Column, edits: int | tuple[tuple[int, int], ...], shortest: int) -> Column:
    """array<struct<c, size, gap, edits, own>>: the class of a line of some length, and those of shorter partners."""
    every = classes(edits, shortest)
    ends = sorted({x for low, high, e, _ in every for x in (low, high, high + e)})
    out = F.expr("CAST(array() AS array<struct<c:int,size:int,gap:int,edits:int,own:boolean>>)")
    for least in ends[:-1]:
        found = []
        for c, (low, high, e, size) in enumerate(every):
            if low <= least < high + e:
                gap = next((g for at_least, g in GAPS if size >= at_least), 0)
                found.append(f"struct({c} AS c, {size} AS size, {gap} AS gap, {e} AS edits, {str(least < high).lower()} AS own)")
        out = F.when(length >= least, F.expr(f"array({', '.join(found)})")).otherwise(out)
    return out


def named(lines: DataFrame, edits: int | tuple[tuple[int, int], ...] = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """``lines`` (with line, n its length), ``own`` and ``buckets``: the substrings that a line is indexed under or probes with.

    A row of its ``own`` class, and one more for a class of shorter partners. The lowest bit of a
    bucket says that the line is indexed there; apart from it, an index entry and a probe of one
    segment are the same. What a line doesn't name is null; of one under ``shortest`` all is.
    Lines of one byte a character are cut as bytes, others character by character; the parts are the same.
    """
    names = lines.columns
    one = lines.select(*names, F.explode_outer(of_length(F.col("n"), edits, shortest)).alias("of"))
    bytewise = F.octet_length("line") == F.col("n")

    def part(text: str, start: Column, size: Column) -> Column:
        """So many characters of a column from a place on, as bytes."""
        return F.when(bytewise, F.substring(F.col(text).cast("binary"), start, size)).otherwise(F.substring(text, start, size).cast("binary"))

    start = {i: (F.lit(i - 1) if i > 0 else F.lit(i)) * F.col("of.size") + (F.lit(0) if i > 0 else F.col("n")) for i in SEGMENTS}
    radius = {i: abs(i) - 1 for i in SEGMENTS}
    # each step is a column of its own, used by several of the next; what is cut out of the line once is short from then on
    one = one.select(*names, "of", *(part("line", start[i] - radius[i] + 1, F.col("of.size") + 2 * radius[i]).cast("string").alias(f"w{i}") for i in SEGMENTS))

    def place(i: int, shift: int) -> Column:
        """From the segment's start: where the named part starts, if the segment lies ``shift`` characters on."""
        space = F.locate(" ", F.col(f"w{i}"), shift + radius[i] + 1) - (shift + radius[i])
        return F.lit(shift) + F.when(space.between(1, F.col("of.gap")), space).otherwise(0)

    one = one.select(*names, "of", *(f"w{i}" for i in SEGMENTS), *(place(i, shift).alias(f"q{i}_{shift}") for i, shift in SLOTS))
    keys = []
    for k, i in enumerate(SEGMENTS):
        before: list[str] = []
        for shift in (s for j, s in SLOTS if j == i):
            q = F.col(f"q{i}_{shift}")
            key = F.xxhash64(F.col("of.c") * 8 + k, part(f"w{i}", q + radius[i] + 1, F.col("of.size") - F.col("of.gap"))).bitwiseAND(-2)
            key = key.bitwiseOR(F.when(F.col("of.own"), 1).otherwise(0)) if shift == 0 else key
            wanted = F.col("of.edits") >= k
            for other in before:
                wanted = wanted & (q != F.col(other))
            keys.append(F.when(wanted, key))
            before.append(f"q{i}_{shift}")
    # a line of a class names its first segment at least; the higher-order function keeps this projection out of whole-stage
    # code, where it would be one method too large to compile, and does not look at the keys, which it would evaluate uncompiled
    keys = F.when(F.exists(F.array("of.c"), lambda c: c.isNotNull()), F.array(*keys))
    return one.select(*names, F.coalesce("of.own", F.lit(True)).alias("own"), keys.alias("buckets"))


def within(a: Column, b: Column, edits: int = EDITS, most: Column | None = None) -> Column:
    """Whether two arrays of characters are at most ``edits`` insertions, deletions or substitutions apart.

    Bit-parallel over the band: bit d of level e says that after some characters of ``b``,
    e edits at most lead to d - edits characters more of ``a``. All levels and diagonals
    move with a few word operations for each character of ``b``. ``most``, where given, is a
    row's own number of edits, ``edits`` at most.
    """
    if edits > MOST_EDITS:
        raise ValueError(f"at most {MOST_EDITS} edits: the levels of the banded distance share one long")
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def closed(levels: list[Column]) -> list[Column]:
        """Deletions from ``a``: up one diagonal and one level within a step."""
        out = [levels[0]]
        for level in levels[1:]:
            out.append(level.bitwiseOR(F.shiftleft(out[-1], 1).bitwiseAND(mask)))
        return out

    def packed(levels: list[Column]) -> Column:
        out = levels[0]
        for e, level in enumerate(levels[1:], 1):
            out = out.bitwiseOR(F.shiftleft(level, e * width))
        return out

    def level(state: Column, e: int) -> Column:
        return F.shiftrightunsigned(state, e * width).bitwiseAND(mask)

    def step(state: Column, j: Column) -> Column:
        c = F.get(b, j)
        same = F.lit(0).cast("long")
        for d in range(width):
            same = same + F.when(F.get(a, j + (d - edits)) == c, F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long"))
        old = [level(state, e) for e in range(edits + 1)]

        def moved(same: Column) -> Column:
            new = [old[0].bitwiseAND(same)]
            for e in range(1, edits + 1):
                new.append(old[e].bitwiseAND(same).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftrightunsigned(old[e - 1], 1)))
            return packed(closed(new))

        # a lambda variable: compared once a character, not once a level
        return F.when(state == 0, state).otherwise(F.get(F.transform(F.array(same), moved), F.lit(0)))

    start = 0
    for e in range(edits + 1):
        reach = sum(1 << (edits + k) for k in range(e + 1))
        start |= reach << (e * width)
    end = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.lit(start).cast("long"), step)
    end = F.when(F.size(b) == 0, F.lit(start).cast("long")).otherwise(end)
    diagonal = F.size(a) - F.size(b) + edits
    bit = F.least(F.greatest(diagonal, F.lit(0)), F.lit(width - 1)) + (F.lit(edits) if most is None else most) * width
    return diagonal.between(0, width - 1) & (F.getbit(end, bit) == 1)


def trimmed(x: Column, y: Column, steps: int = 6) -> Column:
    """struct(x, y) without equal beginnings and ends, which change no edit distance.

    Each step cuts the first and the last half where they are equal; every step sees the one
    before through a lambda variable, so it is computed once.
    """

    def step(s: Column) -> Column:
        n = F.floor(F.least(F.length(s.x), F.length(s.y)) / 2).cast("int")
        m = F.when(F.substring(s.x, F.lit(1), n) == F.substring(s.y, F.lit(1), n), n).otherwise(0)
        return F.struct(F.substring(s.x, m + 1, F.length(s.x)).alias("x"), F.substring(s.y, m + 1, F.length(s.y)).alias("y"))

    def back(s: Column) -> Column:
        n = F.floor(F.least(F.length(s.x), F.length(s.y)) / 2).cast("int")
        tail = lambda c: F.substring(c, F.length(c) - n + 1, n)
        m = F.when(tail(s.x) == tail(s.y), n).otherwise(0)
        return F.struct(F.substring(s.x, F.lit(1), F.length(s.x) - m).alias("x"), F.substring(s.y, F.lit(1), F.length(s.y) - m).alias("y"))

    out = F.array(F.struct(x.alias("x"), y.alias("y")))
    for _ in range(steps):
        out = F.transform(F.transform(out, step), back)
    return out


def verified(pairs: DataFrame, texts: DataFrame, edits: int | tuple[tuple[int, int], ...]) -> DataFrame:
    """Of pairs (a, b) of line ids those within the distance."""
    first = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
    second = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    both = merged(merged(pairs, first, "a"), second, "b").withColumn("most", allowed(F.least(F.length("x"), F.length("y")), edits))
    chars = lambda c: F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))
    alike = F.transform(trimmed(F.col("x"), F.col("y")), lambda s: F.struct(chars(s.x).alias("x"), chars(s.y).alias("y")))
    alike = F.exists(alike, lambda s: within(s.x, s.y, most_edits(edits), F.col("most")))
    # Spark's own distance first, as most pairs that are too far apart cost the other one more
    return both.where(close(F.col("x"), F.col("y"), edits) & alike).select("a", "b")


def counted(line: Column, n: Column) -> Column:
    """struct<n, b0, b1, ...>: the length, and how many there are of some letters as ring codes."""
    size, ring = F.octet_length(line), F.lit(list(RING))

    def code(c: str) -> Column:
        found = ((size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) / len(c.encode())).cast("int")
        return F.get(ring, found.bitwiseAND(15)).cast("long")

    words = []
    for first in range(0, len(LETTERS), 8):
        word = code(LETTERS[first])
        for i, c in enumerate(LETTERS[first + 1 : first + 8], 1):
            word = word.bitwiseOR(F.shiftleft(code(c), 8 * i))
        words.append(word)
    return F.struct(n.alias("n"), *(w.alias(f"b{i}") for i, w in enumerate(words)))


def may_be_near(x: str, y: str, edits: int | tuple[tuple[int, int], ...]) -> Column:
    """Whether the counts of two lines allow so few edits.

    Codes differ in as many bits as counts are apart around the ring, so in no more than they are
    apart. A substitution moves two counts, an insertion or deletion one and the length.
    """
    n, m = F.col(f"{x}.counts.n"), F.col(f"{y}.counts.n")
    return F.abs(n - m) + differing(f"{x}.counts", f"{y}.counts", COUNT_WORDS) <= 2 * allowed(F.least(n, m), edits)


def close(x: Column, y: Column, edits: int | tuple[tuple[int, int], ...]) -> Column:
    """Whether Spark's own edit distance, which gives up beyond a threshold, stays below the greatest one of ``edits``.

    It walks a line anew for each character, so that equal ends are cut off first.
    """
    return F.exists(trimmed(x, y, 2), lambda s: F.levenshtein(s.x, s.y, most_edits(edits)) >= 0)


def not_far(x: str, y: str, edits: int | tuple[tuple[int, int], ...]) -> Column:
    """Whether Spark's own edit distance, which gives up beyond a threshold, stays below it: keeps near misses of crowded buckets out of the join's rows."""
    return close(F.col(f"{x}.line"), F.col(f"{y}.line"), edits)


def lines_of(docs: DataFrame, shortest: int = SHORTEST, words: bool = False) -> DataFrame:
    """(d, t, pos, line, n, h1, h2) of the lines that take part; with ``words`` shorter ones with a letter or digit, too."""
    # the text's hash is taken below the explode, once a document and not once a line
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t"), F.split("text", "\n").alias("parts"))
    keyed = keyed.select("d", "t", F.posexplode("parts").alias("pos", "line")).select("*", F.length("line").alias("n"))
    # a character takes four bytes at most: of long lines none is counted
    part = (F.octet_length("line") >= 4 * shortest) | (F.col("n") >= shortest)
    if words:
        part = part | F.col("line").rlike(r"[\p{L}\p{N}]")
    return keyed.where(part).select("*", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def repeated_lines(docs: DataFrame, scratch: Scratch, edits: int | tuple[tuple[int, int], ...] = EDITS, shortest: int = SHORTEST, exact: bool = False) -> DataFrame:
    """(d, t, gone map<int, long>, n_removed, n_near) of documents with lines that go: of 64 lines each, a bit for each that does."""
    if int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 1 << (50 - 33):
        raise ValueError("a line's number, its length and a mark share one long: at most 131072 partitions")
    lines = lines_of(docs, shortest, exact)
    place = F.struct("d", "t", "pos")
    keyed = named(lines, edits, shortest).groupBy("h1", "h2", "n", "own").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("buckets").alias("buckets"))
    # numbered as they are written, so the numbers are unique and stay
    keyed = scratch.put(keyed.withColumn("id", F.monotonically_increasing_id()), "keyed", {"parquet.enable.dictionary": "false"})
    distinct, others = keyed.where("own"), keyed.where("NOT own").select("h1", "h2", "buckets")
    others = sifted(distinct.select("h1", "h2", "n", "id"), "h1", others, "inner", ("h1", "h2"))
    # length and mark stand in the id, so that one exchange of two longs serves both sides of the join; exploded after the
    # union, as the semi-join would go below a union and read its other side once for each part
    packed = F.shiftleft("id", LENGTH_BITS + 1).bitwiseOR(F.least("n", F.lit((1 << LENGTH_BITS) - 1)).cast("long") * 2)
    length = lambda c: F.shiftright(c, 1).bitwiseAND((1 << LENGTH_BITS) - 1)
    rows = distinct.select(packed.alias("id"), "buckets").union(others.select(packed.alias("id"), "buckets")).select("id", F.explode("buckets").alias("b"))
    rows = rows.where("b IS NOT NULL").select(F.col("b").bitwiseAND(-2).alias("bucket"), F.col("id").bitwiseOR(F.col("b").bitwiseAND(1)).alias("marked"))
    there = rows.select(F.col("bucket").alias("bucket_"), F.col("marked").alias("marked_"))
    another = F.shiftright("marked", LENGTH_BITS + 1) != F.shiftright("marked_", LENGTH_BITS + 1)
    fitting = F.abs(length("marked") - length("marked_")) <= most_edits(edits)
    shared = merged(rows, there, (F.col("bucket") == F.col("bucket_")) & another & fitting, "left_semi")
    members = shared.groupBy("bucket", F.shiftright("marked", LENGTH_BITS + 1).alias("id")).agg((F.max(F.col("marked").bitwiseAND(1)) == 1).alias("pivot"))
    members = scratch.put(members, "members")
    store.release(docs.sparkSession)
    met = members.select("id").distinct()
    repeated = merged(distinct.where("copies > 1"), met.withColumn("met", F.lit(True)), "id", "left")
    single = sifted(distinct.where("copies = 1"), "id", met).withColumn("met", F.lit(True))
    names = ("h1", "h2", "id", "first", "met")
    relevant = scratch.put(repeated.select(*names).union(single.select(*names)), "relevant")
    found = sifted(lines.select("d", "t", "pos", "line", "n", "h1", "h2"), "h1", relevant, "inner", ("h1", "h2"))
    text = F.when(F.col("met") & (place == F.col("first")), F.col("line"))
    found = scratch.put(found.select(place.alias("place"), "id", "first", "n", text.alias("line")), "found")
    scratch.drop(keyed)
    store.release(docs.sparkSession)
    texts = found.where("line IS NOT NULL").select("id", "line", "n").dropDuplicates(["id"])
    features = scratch.put(texts.select("id", F.struct(counted(F.col("line"), F.col("n")).alias("counts"), "line").alias("f")), "features")
    labels, links = components(members, features, lambda x, y: may_be_near(x, y, edits), lambda pairs: verified(pairs, texts, edits), scratch, lambda x, y: not_far(x, y, edits))
    scratch.drop(members, links, features)
    lost = found.select("place", "id", "first")
    if labels is None:
        lost = lost.withColumn("root", F.col("first"))
    else:
        linked = merged(relevant.select("id", "first"), labels, "id")
        roots = merged(linked, linked.groupBy("component").agg(F.min("first").alias("root")), "component").select("id", "root")
        lost = merged(lost, roots, "id", "left").withColumn("root", F.coalesce("root", "first"))
    lost = lost.where("place != root").select("place.*", (F.col("place") == F.col("first")).alias("near")).distinct()
    words = lost.groupBy("d", "t", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"), F.count("*").alias("n"), F.count_if("near").alias("near"))
    return words.groupBy("d", "t").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone"), F.sum("n").alias("n_removed"), F.sum("near").alias("n_near"))


def dedup_lines(docs: DataFrame, edits: int | tuple[tuple[int, int], ...] = EDITS, shortest: int = SHORTEST, exact: bool = False) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and ``n_lines``, ``n_removed``, ``n_near``.

    Of each component of near-equal lines the first by (doc_id, line) stays, everywhere else
    they go; lines under ``shortest`` code points stay, or with ``exact`` go where an equal one
    came before, if they hold a letter or digit. ``edits`` is a number or, by the length of
    the shorter line, rising steps (code points, edits); 4 is the most. Null text stays null, without lines.
    Rows with equal doc_id and text are one document and come out alike; rows that share only
    the doc_id are ordered by a hash of their text; a null doc_id comes before all others.
    An empty table gives an empty result. All other columns pass through.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "lines")
    own = W.table(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = repeated_lines(own, scratch, edits, shortest, exact).select(F.struct("d", "t").alias("gone_key"), "gone", "n_removed", "n_near")
    found = scratch.put(found, "gone")
    store.release(docs.sparkSession)
    keyed = docs.select(F.struct(*(docs[f"`{c}`"].alias(c) for c in names)).alias("row"), F.struct(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(docs["text"].cast("string")).alias("t")).alias("key"))
    # one strategy at every size: what is found grows with the documents and is never broadcast
    joined = keyed.join(found.hint("merge"), F.col("key") == F.col("gone_key"), "left")
    split = F.split(F.col("row.text").cast("string"), "\n")
    # the map as an array by position, so that each line's bit is read at once
    last = F.array_max(F.map_keys("gone"))
    bits = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at("gone", i.cast("int")), F.lit(0).cast("long")))

    def stays(bits: Column) -> Column:
        return F.filter(split, lambda x, i: F.getbit(F.coalesce(F.get(bits, F.floor(i / 64).cast("int")), F.lit(0).cast("long")), i % 64) == 0)

    kept = F.array_join(F.get(F.transform(F.array(bits), stays), F.lit(0)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(split))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
