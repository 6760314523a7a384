"""Every registered query of the engine with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import arabizi
from tamarisk.functions import text as T
from tamarisk.operators import evaluate as E
from tamarisk.operators import html as H
from tamarisk.operators import labels as B
from tamarisk.operators import lexicon as L
from tamarisk.operators import phrases as N
from tamarisk.operators import profile as P
from tamarisk.operators import rules as R
from tamarisk.operators import scoring as M
from tamarisk.operators import splits as S
from tamarisk.operators import suite as G
from tamarisk.operators import training as K
from tamarisk.plans import streams
from tamarisk.plans.catalog import ORACLE, QUERIES, query, table
from tamarisk.sources import files
from tamarisk.sources import settings as C
from tamarisk.streaming import moderation as O

#: A small sample lexicon and keyword table; real ones are loaded as tables.
LEXICON = [("idiot", "exact", "word"), ("moron", "exact", "word"), ("stupid", "exact", "word"), ("the", "contextual", "word"), ("thing", "pejorative", "word"), ("in the", "exact", "phrase")]
CUES = ("of", "you")
KEYWORDS = [("insult", "idiot"), ("insult", "moron"), ("insult", "stupid"), ("common", "the"), ("common", "that")]
MORPHS = [("bare", "{}"), ("plural", "{}s")]
CARRIERS = ["hello {}", "{} again", "you are {}"]

LABELLED = """labelled AS (SELECT d.doc_id, d.text, d.source, d.lang AS dialect, l.toxic AS label, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
PREDICTED = LABELLED + """, predicted AS (SELECT *, CAST(regexp_matches(text, 'idiot|moron|stupid') AS INT) AS predicted FROM labelled)"""
CELLS = "sum(CAST(label = 1 AND predicted = 1 AS BIGINT)) AS tp, sum(CAST(label = 0 AND predicted = 1 AS BIGINT)) AS fp, sum(CAST(label = 1 AND predicted = 0 AS BIGINT)) AS fn, sum(CAST(label = 0 AND predicted = 0 AS BIGINT)) AS tn"
#: Words of a text by runs of white space of ASCII, as a DuckDB list.
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "text", "source", F.col("lang").alias("dialect"), F.col("toxic").alias("label"), "quality")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).withColumn("predicted", F.col("text").rlike("idiot|moron|stupid").cast("int"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "term string, tier string, kind string")


def tokenized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("tokens"))


# --- labels, votes, lineage


@query(f"""WITH {LABELLED}, voted AS (SELECT text, CAST(avg(label) > 0.5 AS INT) AS label, string_agg(DISTINCT source, '|' ORDER BY source) AS source FROM labelled GROUP BY text)
SELECT split_part(source, '|', 1) AS source, count(*) AS n, sum(label) AS toxic, round(100.0 * sum(label) / count(*), 4) AS rate FROM voted GROUP BY 1""", longs="toxic")
def flagship_toxic_rate(spark, d):
    voted = B.vote(labelled(spark, d))
    return P.toxic_rate(voted.withColumn("source", T.first_part(F.col("source"))))


@query(f"WITH {LABELLED} SELECT text, CAST(avg(label) >= 0.5 AS INT) AS label FROM labelled GROUP BY text")
def vote_tie_toxic(spark, d):
    return B.vote(labelled(spark, d), "toxic").select("text", "label")


@query(f"WITH {LABELLED} SELECT text, CAST(avg(label) > 0.5 AS INT) AS label, string_agg(DISTINCT source, '|' ORDER BY source) AS source, string_agg(DISTINCT dialect, '|' ORDER BY dialect) AS dialect FROM labelled GROUP BY text")
def vote_tie_safe_lineage(spark, d):
    return B.vote(labelled(spark, d))


@query(f"WITH {LABELLED} SELECT text, max(label) AS label, min(source) AS source FROM labelled GROUP BY text")
def dedup_any_toxic(spark, d):
    return B.any_toxic(labelled(spark, d))


@query(f"WITH {LABELLED} SELECT text, count(*) AS n, avg(label) AS mean FROM labelled GROUP BY text HAVING avg(label) > 0 AND avg(label) < 1")
def label_conflicts(spark, d):
    return B.conflicts(labelled(spark, d))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 0 END AS mapped, CASE WHEN lang = 'en' OR source = 'src1' THEN 1 ELSE 0 END AS any_positive, lang = 'de' AS unlabeled_probe FROM documents")
def label_maps(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", B.map_label(F.upper("lang"), {"en": 1, "fr": 0}).alias("mapped"), B.any_positive([F.col("lang"), F.col("source")], {"en": 1, "src1": 1}).alias("any_positive"), (F.col("lang") == "de").alias("unlabeled_probe"))


@query(f"WITH {LABELLED} SELECT doc_id, CASE WHEN source = 'src3' AND label = 0 AND (contains(text, 'thing') OR contains(text, 'with')) THEN 1 ELSE label END AS label, source = 'src3' AND label = 0 AND (contains(text, 'thing') OR contains(text, 'with')) AS flipped FROM labelled WHERE NOT (source = 'src4' AND label = 0 AND length(text) > 300) AND source NOT IN ('src5', 'src6')")
def relabel_and_clean(spark, d):
    out = B.flip_by_keywords(B.without_sources(labelled(spark, d), ["src5", "src6"]), "src3", ["thing", "with"])
    return B.drop_long_safe(out.where("true"), "src4").select("doc_id", "label", "flipped")


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE d.text NOT IN (SELECT text FROM benchmark) AND d.doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_new_texts(spark, d):
    docs, bench, labels = (table(spark, d, t) for t in ("documents", "benchmark", "labels"))
    return B.new_texts(docs, bench).join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id").distinct()


# --- filters, normalisation


@query("""SELECT doc_id, length(regexp_replace(text, '[^a-z]', '', 'g')) * 1.0 / nullif(length(regexp_replace(text, '[^a-zA-Zà-ÿ]', '', 'g')), 0) AS ratio FROM documents
WHERE coalesce(length(regexp_replace(text, '[^a-z]', '', 'g')) * 1.0 / nullif(length(regexp_replace(text, '[^a-zA-Zà-ÿ]', '', 'g')), 0) >= 0.8, false)""")
def script_ratio_filter(spark, d):
    docs = table(spark, d, "documents").withColumn("ratio", T.script_ratio(F.col("text"), "a-z", "a-zA-Zà-ÿ"))
    return docs.where("ratio >= 0.8").select("doc_id", "ratio")


_COUNT = lambda c: f"length(regexp_replace(text, '[^{c}]', '', 'g'))"
_ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
_SCRIPTS = r"a-zA-Zа-яА-Я\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{4E00}-\x{9FFF}"
_BARE = r"trim(regexp_replace(text, 'https?://[^\x20\x09-\x0D]+|www\.[^\x20\x09-\x0D]+', '', 'g'), ' ')"


@query(
    f"""SELECT doc_id, coalesce({_COUNT(_ARABIC)} * 1.0 / nullif({_COUNT(_SCRIPTS)}, 0) >= 0.5, false) AS arabic_script, coalesce({_COUNT(_ARABIC)} * 1.0 / nullif({_COUNT(_ARABIC + "a-zA-Z")}, 0) >= 0.5, false) AS has_arabic,
  coalesce(regexp_matches(text, '[a-zA-Z]') AND NOT regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') AND length(bare) >= 3 AND (regexp_matches(bare, '[2345679]')
    OR regexp_matches(bare, '(?i)(^|[^A-Za-z0-9_])({arabizi.MARK_WORDS})([^A-Za-z0-9_]|$)')), false) AS arabizi
FROM (SELECT doc_id, text, {_BARE} AS bare FROM documents)"""
)
def script_flags(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.is_arabic_script(F.col("text")).alias("arabic_script"), T.has_arabic(F.col("text")).alias("has_arabic"), arabizi.is_arabizi(F.col("text")).alias("arabizi"))


@query(
    f"""WITH j AS (SELECT d.doc_id, d.text, d.source, l.toxic AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT count_if(text IS NOT NULL AND regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS with_text,
  count_if(text IS NOT NULL AND label IS NOT NULL AND regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS with_both,
  count_if(label IS NOT NULL) AS labelled, count_if(label IS NULL) AS unlabeled FROM j"""
)
def cleaned_rows(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("text", F.col("toxic").alias("label"))
    text, label = B.has_text(), B.has_label()
    return rows.agg(F.count_if(text).alias("with_text"), F.count_if(text & label).alias("with_both"), F.count_if(label).alias("labelled"), F.count_if(~label).alias("unlabeled"))


# The documents hold no Arabic script: their Latin letters become Arabic ones, one by one, in either engine.
_LATIN, _SCRIPT = "abcdefghijklmnopqrstuvwxyz", "ابتثةحخدذرزسشصعطظغضفقكلمنه"
assert len(_LATIN) == len(_SCRIPT)
_UNICODE_SPACES = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WHITE = rf"\x20\x09-\x0D{_UNICODE_SPACES}"


def in_arabic(text: Column) -> Column:
    return F.translate(F.lower(text), _LATIN, _SCRIPT)


def normal_sql(text: str, profile: str, source: str = "documents") -> str:
    """(doc_id, norm) of an expression over ``source`` in DuckDB, without links and placeholders, which are Latin and end as spaces anyway.

    What looks around itself in the engine goes by the list of characters here.
    """
    is_letter = lambda x: f"regexp_matches(coalesce({x}, ' '), '[ء-ي]')"
    is_white = lambda x: f"regexp_matches(coalesce({x}, 'x'), '[{_WHITE}]')"
    if profile == "corpus":
        first = f"regexp_replace(translate(regexp_replace({text}, '\\\\[ntr]|[\n\r\t]', ' ', 'g'), '{T.ZERO_WIDTH}', ''), '@[\\p{{L}}\\p{{N}}_]+', '', 'g')"
        alone = ""
    else:
        first = f"regexp_replace(translate(translate(regexp_replace({text}, '{T.INVISIBLE}', '', 'g'), '{T.CONFUSABLE_FROM}', '{T.CONFUSABLE_TO}'), '{T.ZERO_WIDTH}', ''), '@[A-Za-z0-9_]+', '', 'g')"
        alone = f" AND (i = 2 OR NOT {is_letter('c[i - 2]')})"
    keep = f"NOT ({is_white('c[i]')} AND i > 1 AND {is_letter('c[i - 1]')} AND {is_letter('c[i + 1]')} AND NOT {is_letter('c[i + 2]')}{alone})"
    listed = lambda filter_: f"array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: {filter_}), lambda i: c[i]), '')"
    plain = f"regexp_replace(translate(u, '{T.ALEF_FROM + T.SUBSTITUTION_FROM}', '{T.ALEF_TO + T.SUBSTITUTION_TO}'), '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{0640}}]', '', 'g')"
    return f"""(WITH n0 AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({first}, '[0-9٠-٩۰-۹]', ' ', 'g'), '[^{_WHITE}{T.ARABIC}]', ' ', 'g'), '') AS c FROM {source}),
n1 AS (SELECT doc_id, {listed(keep)} AS u FROM n0), n2 AS (SELECT doc_id, string_split({plain}, '') AS c FROM n1),
n3 AS (SELECT doc_id, {listed("i <= 2 OR c[i] <> c[i - 1] OR c[i] <> c[i - 2]")} AS u FROM n2)
SELECT doc_id, coalesce(trim(regexp_replace(u, '[{_WHITE}]+', ' ', 'g'), ' '), '') AS norm FROM n3)"""


_ARABIC_TEXT = f"translate(lower(text), '{_LATIN}', '{_SCRIPT}')"


@query(
    f"""WITH a AS (SELECT doc_id, {_ARABIC_TEXT} AS text, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 0 END AS label FROM documents), t AS (SELECT * FROM a WHERE text IS NOT NULL AND trim(regexp_replace(text, '[{_WHITE}]+', ' ', 'g'), ' ') <> ''),
s AS (SELECT *, length(regexp_replace(text, '[^{T.ARABIC}]', '', 'g')) * 1.0 / nullif(length(regexp_replace(text, '[^{T.RATIO_DENOMINATOR}]', '', 'g')), 0) AS ratio FROM t),
n AS {normal_sql("text", "corpus", "s")}
SELECT n.norm AS text, s.label, true AS kept FROM s JOIN n ON n.doc_id = s.doc_id WHERE s.ratio >= 0.5 AND s.label IS NOT NULL AND length(n.norm) BETWEEN 3 AND 1000 UNION ALL SELECT text, NULL, false FROM s WHERE ratio >= 0.5 AND label IS NULL"""
)
def prepared_rows(spark, d):
    """The kept rows and those of unknown labels, side by side, of whole texts in Arabic letters."""
    docs = table(spark, d, "documents").select(in_arabic(F.col("text")).alias("text"), F.col("lang").alias("label"))
    clean, unknown = B.prepare(docs, "text", "label", {"en": 1, "fr": 0}, "own")
    return clean.select("text", "label", F.lit(True).alias("kept")).union(unknown.select("text", F.lit(None).cast("int"), F.lit(False)))


FUNNEL = [("latin", "regexp_matches(text, '[a-z]')"), ("length", "length(text) BETWEEN 3 AND 1000"), ("english", "lang = 'en'")]


@query("""WITH f AS (SELECT count(*) AS a, count_if(regexp_matches(text, '[a-z]')) AS b, count_if(regexp_matches(text, '[a-z]') AND length(text) BETWEEN 3 AND 1000) AS c, count_if(regexp_matches(text, '[a-z]') AND length(text) BETWEEN 3 AND 1000 AND lang = 'en') AS e FROM documents)
SELECT 0 AS place, 'raw' AS step, a AS n, round(100.0 * a / a, 4) AS pct FROM f UNION ALL SELECT 1, 'latin', b, round(100.0 * b / a, 4) FROM f UNION ALL SELECT 2, 'length', c, round(100.0 * c / a, 4) FROM f UNION ALL SELECT 3, 'english', e, round(100.0 * e / a, 4) FROM f""", longs="n")
def funnel_counts(spark, d):
    return P.funnel(table(spark, d, "documents"), [("latin", F.col("text").rlike("[a-z]")), ("length", F.length("text").between(3, 1000)), ("english", F.col("lang") == "en")])


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\\x20\\x09-\\x0D]+|www\\.[^\\x20\\x09-\\x0D]+', '', 'g'), '@[A-Za-z0-9_]+', '', 'g'), '[0-9]', ' ', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS clean FROM documents")
def strip_mentions_digits(spark, d):
    t = T.blank_digits(T.drop_mentions(T.drop_links(F.col("text")), unicode_words=False))
    return table(spark, d, "documents").select("doc_id", T.collapse_spaces(t).alias("clean"))


@query("SELECT CASE WHEN NOT regexp_matches(text, '[a-z]') THEN 'latin' WHEN NOT length(text) BETWEEN 3 AND 1000 THEN 'length' WHEN NOT lang = 'en' THEN 'english' ELSE 'kept' END AS route, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def routed_rows(spark, d):
    """The funnel as one write: what each step drops lies beside what is kept."""
    path = streams.stateful.folder(spark, "routed")
    B.write_routed(table(spark, d, "documents"), path, [("latin", F.col("text").rlike("[a-z]")), ("length", F.length("text").between(3, 1000)), ("english", F.col("lang") == "en")])
    return spark.read.parquet(path).groupBy("route").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query()
def continued_training(spark, d):
    """A model of one half of the labelled documents goes on with the other half; the losses of either fit."""
    rows = labelled(spark, d)
    first = K.fit(rows.where("doc_id % 2 = 0"), features=1 << 12, passes=6)
    second = K.fit(rows, first, passes=6)
    told = [(name, i, *map(float, losses)) for name, m in (("first", first), ("continued", second)) for i, losses in enumerate(m.history)]
    return spark.createDataFrame(told, "fit string, pass int, train_loss double, held_loss double")


def _runs(most: int) -> str:
    keep = " OR ".join(["i <= 1"] + [f"c[i] <> c[i - {k}]" for k in range(1, most + 1)]) if most == 1 else f"i <= {most} OR " + " OR ".join(f"c[i] <> c[i - {k}]" for k in range(1, most + 1))
    return f"SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: {keep}), lambda i: c[i]), '') AS squeezed FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)"


@query(_runs(2))
def cap_repeats_2(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cap_repeats(F.col("text"), 2).alias("squeezed"))


@query(_runs(1))
def compress_repeats(spark, d):
    return table(spark, d, "documents").select("doc_id", T.compress_repeats(F.col("text")).alias("squeezed"))


@query(f"SELECT c.doc_id, c.norm AS corpus, r.norm AS runtime FROM {normal_sql(_ARABIC_TEXT, 'corpus')} AS c JOIN {normal_sql(_ARABIC_TEXT, 'runtime')} AS r ON r.doc_id = c.doc_id")
def normalized_arabic(spark, d):
    """Both normal forms of the documents in Arabic letters."""
    text = in_arabic(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.normalize(text).alias("corpus"), T.normalize(text, "runtime").alias("runtime"))


@query(f"SELECT * FROM {normal_sql(chr(39) + 'مَرحبااا @ali ' + chr(39) + ' || text', 'corpus')}")
def normalize_corpus(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.concat(F.lit("مَرحبااا @ali "), F.col("text"))).alias("norm"))


@query(f"SELECT * FROM {normal_sql(chr(39) + 'مَرحبااا ' + chr(39) + ' || text', 'runtime')}")
def normalize_runtime(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.concat(F.lit("مَرحبااا "), F.col("text")), "runtime").alias("norm"))


@query()
def transliterate(spark, d):
    return table(spark, d, "documents").select("doc_id", arabizi.transliterate(F.concat(F.lit("3ala "), F.col("text"))).alias("arabic"))


# --- splits, samples


@query("""WITH u AS (SELECT DISTINCT text, toxic AS label FROM documents JOIN labels USING (doc_id)),
r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5('42' || text), text) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM u)
SELECT label, CASE WHEN k * 1.0 / n < 0.8 THEN 'train' WHEN k * 1.0 / n < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1, 2""")
def stratified_split_counts(spark, d):
    texts = labelled(spark, d).select("text", "label").distinct()
    return S.exact_split(texts, "label", "text").groupBy("label", "split").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('7' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def seeded_sample(spark, d):
    return S.sample(table(spark, d, "documents"), "doc_id", 100, 7).select("doc_id")


@query(
    """WITH p AS (SELECT DISTINCT text, CASE WHEN h < '4' THEN 'a' WHEN h < 'a' THEN 'b' ELSE 'c' END AS split FROM (SELECT text, md5('42' || CAST(doc_id AS VARCHAR)) AS h FROM documents))
SELECT l.split AS left_split, r.split AS right_split, count(*) AS n FROM p l JOIN p r ON l.text = r.text AND l.split < r.split GROUP BY ALL"""
)
def leakage_check(spark, d):
    """A split by row, which copies of a text do leak through."""
    order = S.seeded(F.col("doc_id"))
    rows = table(spark, d, "documents").select("text", F.when(order < "4", "a").when(order < "a", "b").otherwise("c").alias("split"))
    return S.leakage(rows).select(F.col("left").alias("left_split"), F.col("right").alias("right_split"), "n")


@query(f"""WITH {LABELLED}, t AS (SELECT text, max(label) AS label FROM labelled GROUP BY text), u AS (SELECT text, CAST('0x' || substr(md5('42' || label || '|' || text), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM t),
s AS (SELECT DISTINCT text, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM u) SELECT CAST(count(*) AS INT) AS n FROM s a JOIN s b ON a.text = b.text AND a.split < b.split""")
def leakage_of_text_split(spark, d):
    """The split by text shares none."""
    texts = labelled(spark, d).groupBy("text").agg(F.max("label").alias("label"))
    return S.leakage(S.stratified(texts, "label", "text")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("n"))


@query("SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 5")
def newest_per_user(spark, d):
    return S.newest(table(spark, d, "events"), "user_id", 5, "event_id").select("event_id", "user_id", F.col("rank").cast("long").alias("rank"))


# --- profiles


@query("SELECT toxic, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM labels GROUP BY toxic")
def label_distribution(spark, d):
    return P.shares(table(spark, d, "labels"), "toxic")


@query("SELECT split_part(source, '|', 1) AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def topk_sources(spark, d):
    return P.value_counts(table(spark, d, "documents"), T.first_part(F.col("source")), 10)


@query("WITH v AS (SELECT text, string_agg(DISTINCT source, '|' ORDER BY source) AS source FROM documents GROUP BY text) SELECT part AS value, count(*) AS n FROM (SELECT unnest(string_split(source, '|')) AS part FROM v) GROUP BY 1")
def exploded_value_counts(spark, d):
    merged = table(spark, d, "documents").groupBy("text").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("source"))
    return P.exploded_counts(merged, "source")


COVER = {c: [k for x, k in KEYWORDS if x == c] for c in sorted({c for c, _ in KEYWORDS})}


@query(f"WITH {LABELLED}, t AS (SELECT text FROM labelled WHERE label = 1) " + " UNION ALL ".join(f"SELECT '{c}' AS category, CAST(sum({' + '.join(f'contains(text, {chr(39)}{k}{chr(39)})::BIGINT' for k in ks)}) AS BIGINT) AS hits, count_if({' OR '.join(f'contains(text, {chr(39)}{k}{chr(39)})' for k in ks)}) AS rows, round(100.0 * sum({' + '.join(f'contains(text, {chr(39)}{k}{chr(39)})::BIGINT' for k in ks)}) / count(*), 4) AS pct FROM t" for c, ks in COVER.items()), longs="rows")
def keyword_coverage(spark, d):
    return P.keyword_coverage(labelled(spark, d), spark.createDataFrame(KEYWORDS, "category string, keyword string"))


@query(f"WITH {LABELLED} SELECT source, count(*) AS n, sum(label) AS toxic, round(100.0 * sum(label) / count(*), 4) AS rate FROM labelled GROUP BY source", longs="toxic")
def toxic_rate_by_source(spark, d):
    return P.toxic_rate(labelled(spark, d))


@query(f"WITH {LABELLED}, top AS (SELECT split_part(source, '|', 1) AS name, count(*) AS own FROM labelled GROUP BY 1 ORDER BY own DESC, name LIMIT 25) SELECT name, count(*) AS n, sum(label) AS toxic, round(100.0 * sum(label) / count(*), 4) AS rate FROM labelled JOIN top ON contains(source, name) GROUP BY name", longs="toxic")
def toxic_rate_by_substring(spark, d):
    return P.toxic_rate_by_substring(labelled(spark, d))


@query(f"WITH {LABELLED} SELECT dialect AS value, count_if(label = 0) AS safe, count_if(label = 1) AS toxic FROM labelled GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 8", longs="safe toxic")
def crosstab_lang_toxic(spark, d):
    return P.crosstab(labelled(spark, d), "dialect")


@query(f"WITH {LABELLED} SELECT label, CAST(least(greatest(floor(length(text) / 20.0), 0), 49) AS INT) AS bin, count(*) AS n FROM labelled GROUP BY 1, 2")
def length_histogram(spark, d):
    return P.length_histogram(labelled(spark, d))


@query(f"WITH {LABELLED} SELECT label, median(length(text)) AS median_length FROM labelled GROUP BY label")
def length_median_by_class(spark, d):
    return P.length_median(labelled(spark, d))


@query("SELECT 'doc_id' AS \"column\", count_if(doc_id IS NULL) AS nulls, count(DISTINCT doc_id) AS distinct_values FROM documents UNION ALL SELECT 'text', count_if(text IS NULL), count(DISTINCT text) FROM documents UNION ALL SELECT 'lang', count_if(lang IS NULL), count(DISTINCT lang) FROM documents UNION ALL SELECT 'source', count_if(source IS NULL), count(DISTINCT source) FROM documents UNION ALL SELECT 'n_chars', count_if(n_chars IS NULL), count(DISTINCT n_chars) FROM documents", longs="nulls")
def profile_columns(spark, d):
    return P.columns(table(spark, d, "documents")).select("column", "nulls", "distinct_values")


@query("""WITH l AS (SELECT count_if(quality IS NULL) AS nq, count(DISTINCT quality) AS dq, count_if(toxic IS NULL) AS nt, count(DISTINCT toxic) AS dt, count_if(doc_id IS NULL) AS ni, count(DISTINCT doc_id) AS di FROM labels),
v AS (SELECT 'quality' AS c, quality AS k, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 2 UNION ALL SELECT 'toxic', toxic, count(*) FROM labels WHERE toxic IS NOT NULL GROUP BY 2),
m AS (SELECT c, string_agg(k || '=' || n, ',' ORDER BY k) AS values FROM v GROUP BY c)
SELECT a.column, a.nulls, a.distinct_values, CASE WHEN a.distinct_values <= 20 THEN m.values END AS values FROM (SELECT 'doc_id' AS column, ni AS nulls, di AS distinct_values FROM l UNION ALL SELECT 'quality', nq, dq FROM l UNION ALL SELECT 'toxic', nt, dt FROM l) a LEFT JOIN m ON m.c = a.column""")
def inspect_labels(spark, d):
    found = P.inspect(table(spark, d, "labels"))
    values = F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return found.select("column", "nulls", "distinct_values", values.alias("values"))


@query("SELECT lang, count(DISTINCT part) AS n_parts FROM (SELECT lang, unnest(string_split(source || '|' || lang, '|')) AS part FROM documents) GROUP BY lang")
def distinct_sources(spark, d):
    return P.distinct_parts(table(spark, d, "documents").select("lang", F.concat_ws("|", "source", "lang").alias("source")), "source", "lang")


@query("SELECT count(text) - count(DISTINCT text) AS n_duplicates FROM documents")
def duplicate_count(spark, d):
    return P.duplicates(table(spark, d, "documents"))


# --- evaluation


@query(f"WITH {PREDICTED} SELECT {CELLS} FROM predicted", longs="tp fp fn tn")
def confusion(spark, d):
    return E.confusion(predicted(spark, d))


_PR = "coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS p1, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS r1, coalesce(tn * 1.0 / nullif(tn + fn, 0), 0) AS p0, coalesce(tn * 1.0 / nullif(tn + fp, 0), 0) AS r0"
_CHAIN = f"{PREDICTED}, c AS (SELECT {CELLS} FROM predicted), m AS (SELECT *, {_PR} FROM c), f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, tp + fn AS n1, tn + fp AS n0, tp + fp + fn + tn AS n FROM m)"


@query(f"WITH {_CHAIN} SELECT round((tp + tn) * 1.0 / n, 6) AS accuracy, round(p1, 6) AS precision_toxic, round(r1, 6) AS recall_toxic, round(f1, 6) AS f1_toxic, round(f0, 6) AS f1_safe, round((p1 * n1 + p0 * n0) / n, 6) AS precision_weighted, round((r1 * n1 + r0 * n0) / n, 6) AS recall_weighted, round((f1 * n1 + f0 * n0) / n, 6) AS f1_weighted FROM f")
def prf_metrics(spark, d):
    return E.metrics(predicted(spark, d))


@query(f"WITH {_CHAIN} SELECT 'safe' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(n0 AS BIGINT) AS support FROM f UNION ALL SELECT 'toxic', round(p1, 6), round(r1, 6), round(f1, 6), CAST(n1 AS BIGINT) FROM f UNION ALL SELECT 'macro', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM f UNION ALL SELECT 'weighted', round((p1 * n1 + p0 * n0) / n, 6), round((r1 * n1 + r0 * n0) / n, 6), round((f1 * n1 + f0 * n0) / n, 6), CAST(n AS BIGINT) FROM f")
def classification_report(spark, d):
    return E.report(predicted(spark, d))


@query(f"WITH {LABELLED} SELECT 1.0::DOUBLE AS safe, round(count_if(label = 0) * 1.0 / greatest(count_if(label = 1), 1), 6) AS toxic FROM labelled")
def class_weights(spark, d):
    return E.class_weights(labelled(spark, d))


@query(f"""WITH {PREDICTED}, g AS (SELECT 'overall' AS dimension, 'all' AS value, * FROM predicted UNION ALL SELECT 'source', source, * FROM predicted UNION ALL SELECT 'dialect', dialect, * FROM predicted UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), * FROM predicted),
c AS (SELECT dimension, value, count(*) AS n, {CELLS} FROM g GROUP BY 1, 2), m AS (SELECT *, {_PR} FROM c)
SELECT dimension, value, n, tp, fp, fn, tn, round(p1, 6) AS precision, round(r1, 6) AS recall, round(coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0), 6) AS f1 FROM m""", longs="tp fp fn tn")
def grouping_sets_metrics(spark, d):
    return E.by_dimensions(predicted(spark, d), ["source", "dialect", "quality"])


@query(f"WITH {PREDICTED} SELECT source, count(*) AS n, count_if(label = predicted) AS ok, count_if(label = 0 AND predicted = 1) AS fp, count_if(label = 1 AND predicted = 0) AS fn, round(100.0 * count_if(label = predicted) / count(*), 4) AS accuracy, round((count(*) - count_if(label = 0 AND predicted = 1)) * 1.0 / count(*), 6) AS specificity, CASE WHEN round(100.0 * count_if(label = predicted) / count(*), 4) >= 80 THEN 'good' WHEN round(100.0 * count_if(label = predicted) / count(*), 4) >= 50 THEN 'fair' ELSE 'poor' END AS status FROM predicted GROUP BY source", longs="ok fp fn")
def category_report(spark, d):
    return E.by_category(predicted(spark, d), "source")


@query(f"WITH {PREDICTED}, e AS (SELECT CASE predicted WHEN 1 THEN 'fp' ELSE 'fn' END AS error, source, doc_id FROM predicted WHERE label <> predicted) SELECT error, source, place, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY error, source ORDER BY doc_id) AS place FROM e) WHERE place <= 3")
def error_slices_topn(spark, d):
    return E.error_slices(predicted(spark, d), "doc_id", "source").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {PREDICTED} SELECT source, CASE WHEN dialect = 'en' THEN 'rule_headroom' ELSE 'model_ceiling' END AS bucket, count(*) AS n FROM predicted WHERE label = 1 AND predicted = 0 GROUP BY 1, 2")
def miss_buckets(spark, d):
    rows = predicted(spark, d).withColumn("obf", F.when(F.col("dialect") == "en", "plain").otherwise("other"))
    return E.misses(rows, "source")


@query(f"WITH {PREDICTED} SELECT CASE WHEN contains(text, 'idiot') THEN 'dict' ELSE 'resolver' END AS layer, count(*) AS n, count_if(label = 1) AS correct FROM predicted WHERE predicted = 1 GROUP BY 1", longs="correct")
def layer_attribution(spark, d):
    return E.by_layer(predicted(spark, d).withColumn("layer", F.when(F.col("text").contains("idiot"), "dict").otherwise("resolver")))


@query(f"WITH {PREDICTED} SELECT dialect AS dataset, round(100 * avg(CAST(label = 0 AS DOUBLE)), 4) AS always_safe, round(100 * avg(CAST(label = predicted AS DOUBLE)), 4) AS predicted, round(round(100 * avg(CAST(label = predicted AS DOUBLE)), 4) - round(100 * avg(CAST(label = 0 AS DOUBLE)), 4), 4) AS difference FROM predicted GROUP BY 1")
def model_comparison(spark, d):
    return E.compare(predicted(spark, d).withColumn("dataset", F.col("dialect")).withColumn("always_safe", F.lit(0)), ["always_safe", "predicted"])


@query("SELECT user_id, max(value) AS score, max_by(event_type, {'a': value, 'b': event_type}) AS candidate FROM events GROUP BY user_id")
def cascade_max(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("value").alias("score"), F.col("event_type").alias("candidate"))
    return E.cascade(rows, "user_id")


@query("SELECT user_id, n, CASE WHEN n >= 1000 THEN 1000 WHEN n >= 500 THEN 500 WHEN n >= 100 THEN 100 WHEN n >= 50 THEN 50 WHEN n >= 10 THEN 10 END AS tier FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def achievement_tier(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", E.tier(F.col("n")).alias("tier"))


# --- lexicon and rules


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS tokens FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(tokens) AS token FROM t) WHERE token IN ('idiot', 'moron', 'stupid', 'the', 'thing') GROUP BY token")
def lexicon_hits(spark, d):
    positions = tokenized(spark, d).select("doc_id", F.explode("tokens").alias("token"))
    hits = L.vocabulary_hits(positions.select("token").distinct(), lexicon(spark), stemming=False)
    return positions.join(hits, "token").groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS tokens FROM documents),
r AS (SELECT doc_id, tokens, i, tokens[i] AS token, coalesce(tokens[i - 1] IN ('of', 'you') AND i > 1, false) AS aimed FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM t) WHERE tokens[i] IN ('idiot', 'moron', 'stupid', 'the', 'thing')),
f AS (SELECT doc_id, token, i, token IN ('idiot', 'moron', 'stupid') AS exact, token = 'the' AND aimed AS contextual, token = 'thing' AND (aimed OR len(tokens) = 1) AS pejorative FROM r)
SELECT doc_id, bool_or(exact) AS exact, bool_or(contextual) AS contextual, bool_or(pejorative) AS pejorative, min_by(token, i) FILTER (exact OR contextual OR pejorative) AS culprit FROM f GROUP BY doc_id HAVING bool_or(exact) OR bool_or(contextual) OR bool_or(pejorative)""")
def tiered_verdict(spark, d):
    return L.match(tokenized(spark, d), lexicon(spark), cues=CUES, stemming=False)


@query("SELECT doc_id FROM documents WHERE contains(text, 'in the') OR contains(text, 'of that')")
def phrase_hits(spark, d):
    return table(spark, d, "documents").where(L.phrase_hits(F.col("text"), ["in the", "of that"])).select("doc_id")


_WINDOWS = "SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS term FROM (SELECT string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) - 1)) AS i FROM benchmark)"


@query(f"SELECT doc_id, count(*) AS n_terms, min(term) AS least, sum(strpos(text, term) - 1) AS places FROM documents JOIN ({_WINDOWS}) ON contains(text, term) GROUP BY doc_id", longs="places")
def phrase_matches(spark, d):
    """All phrases of three words of the benchmark, anywhere in the documents, also across the borders of words."""
    words = table(spark, d, "benchmark").select(F.split("text", " ").alias("w"))
    terms = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("term")).distinct()
    found = N.matches(table(spark, d, "documents").select("doc_id", F.lit(0).alias("variant"), "text"), terms.select(F.lit(0).alias("variant"), "term", F.col("term").alias("needle")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.min("term").alias("least"), F.sum("first").alias("places"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'idi[o0]t|mor+on')")
def regex_hits(spark, d):
    tokens = F.split("text", r"[\x20\x09-\x0D]+")
    return table(spark, d, "documents").where(L.regex_hits(F.col("text"), tokens, ["idi[o0]t", "mor+on", "(broken"])).select("doc_id")


@query(
    f"""WITH w AS (SELECT DISTINCT unnest({TOKENS}) AS term FROM documents), d AS (SELECT term, CASE length(term) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'contextual' ELSE 'pejorative' END AS tier FROM w WHERE term < 'm'),
e AS (SELECT * FROM d UNION SELECT term, 'exact' FROM w WHERE term >= 'k'), o AS (SELECT * FROM e WHERE term NOT IN (SELECT term FROM w WHERE ends_with(term, 's')))
SELECT DISTINCT term, tier FROM o WHERE tier <> 'exact' OR term NOT IN (SELECT term FROM o WHERE tier <> 'exact')"""
)
def effective_lexicon(spark, d):
    """The words of the documents: one half as defaults of all tiers, a part as the user's own exact terms, some allowed."""
    words = tokenized(spark, d).select(F.explode("tokens").alias("term")).distinct()
    tier = F.expr("CASE length(term) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'contextual' ELSE 'pejorative' END")
    defaults = words.where("term < 'm'").select("term", tier.alias("tier"), F.lit("word").alias("kind"))
    custom = words.where("term >= 'k'").select("term", F.lit("exact").alias("tier"), F.lit("word").alias("kind"))
    return L.effective(defaults, custom, words.where("term LIKE '%s'")).where("kind = 'word'").select("term", "tier")


_SQUEEZED = "array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), '')"


def _shape_hits(led: bool) -> str:
    """CTEs up to h (doc_id, culprit): the first insult of each Latin text, as it is or without repeats, ``led`` also with one leading letter of several."""
    form = "left(form, 1) || ltrim(form, left(form, 1))" if led else "form"
    return f"""k AS (SELECT doc_id, text, {TOKENS} AS w FROM documents), p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM k),
v AS (SELECT token, {_SQUEEZED} AS short FROM (SELECT token, string_split(token, '') AS c FROM (SELECT DISTINCT unnest(w) AS token FROM k))),
s AS (SELECT token, shape, form FROM (SELECT token, unnest([0, 2]) AS shape, unnest([token, short]) AS form FROM v) WHERE form IN ('idiot', 'moron', 'stupid') OR {form} IN ('idiot', 'moron', 'stupid')),
h AS (SELECT doc_id, arg_min(form, shape * 1000000 + i) AS culprit FROM p JOIN s ON s.token = p.w[p.i] GROUP BY doc_id)"""


@query(
    f"""WITH {_shape_hits(True)}, e AS (SELECT doc_id, regexp_matches(text, '[{R.TOXIC_EMOJI}]') AS t, regexp_matches(text, '[{R.THREAT_EMOJI}]') AS r, regexp_matches(text, '[{R.ANIMAL_EMOJI}]') AS a, regexp_matches(text, '{R.ADDRESS}') AS y FROM documents),
x AS (SELECT e.doc_id, CASE WHEN t OR (a AND y) THEN 'emoji' WHEN h.culprit IS NOT NULL THEN 'dict' ELSE '-' END AS layer, h.culprit,
  concat_ws(',', CASE WHEN t THEN 'toxic_emoji' END, CASE WHEN r THEN 'threat_emoji' END, CASE WHEN a AND y THEN 'directed_animal_insult' WHEN a THEN 'undirected_animal' END) AS flags FROM e LEFT JOIN h ON h.doc_id = e.doc_id)
SELECT doc_id, layer <> '-' AS is_toxic, layer, CASE layer WHEN 'emoji' THEN flags WHEN 'dict' THEN culprit END AS reason FROM x"""
)
def layered_verdict(spark, d):
    docs = table(spark, d, "documents")
    return R.verdict(docs, lexicon(spark).where("tier = 'exact' AND kind = 'word'"), profile=None)


_SIGNS = ".-_*#$@!,،/\\"


def _ar(word: str) -> str:
    return word.translate(str.maketrans(_LATIN, _SCRIPT))


_HIDDEN = _ar("idiot")
_BROKEN = _HIDDEN[:2] + "ىى" + _HIDDEN[2:]
_ARABIC_WORDS = [_ar("moron"), _ar("stupid"), _ar("never").translate(L.FOLD), _HIDDEN]
_ARABIC_PHRASE = _ar("in the")
_FOLDED = lambda c: f"translate({c}, 'ةىیۃہ', 'هييهه')"
_IN_ARABIC = f"translate(translate(lower(text), '{_LATIN}', '{_SCRIPT}'), '{_SIGNS}', '{' ' * len(_SIGNS)}')"


@query(
    f"""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace({_IN_ARABIC}, '{_HIDDEN}', '{_BROKEN}') ELSE {_IN_ARABIC} END AS t FROM documents),
a AS (SELECT doc_id, coalesce(CASE doc_id % 7 WHEN 0 THEN t || ' 🖕' WHEN 1 THEN 'يا ' || t || ' 🐶' WHEN 2 THEN t || ' 🔪 🐶' ELSE t END, '') AS t FROM h),
k AS (SELECT doc_id, t, string_split(t, '') AS c, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM a),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM k),
v AS (SELECT token, {_SQUEEZED} AS short FROM (SELECT token, string_split(token, '') AS c FROM (SELECT DISTINCT unnest(w) AS token FROM k))),
s AS (SELECT token, unnest([0, 2, 4, 5]) AS shape, unnest([token, short, {_FOLDED("token")}, {_FOLDED("short")}]) AS form FROM v),
f AS (SELECT doc_id, arg_min(form, shape * 1000000 + i) AS culprit FROM p JOIN s ON s.token = p.w[p.i] WHERE form IN ({", ".join(f"'{w}'" for w in _ARABIC_WORDS)}) GROUP BY doc_id),
r AS (SELECT doc_id, min(i) AS i FROM p WHERE replace(w[i], 'ىى', '') = '{_HIDDEN}' AND contains(w[i], 'ىى') GROUP BY doc_id),
x AS (SELECT k.doc_id, t, len(w) AS n, f.culprit, r.i IS NOT NULL AS repaired, contains({_FOLDED("t")}, '{_ARABIC_PHRASE.translate(L.FOLD)}') OR contains({_FOLDED(_SQUEEZED)}, '{_ARABIC_PHRASE.translate(L.FOLD)}') AS phrase,
  CASE k.doc_id % 7 WHEN 0 THEN 'toxic_emoji' WHEN 1 THEN 'directed_animal_insult' END AS sign FROM k LEFT JOIN f ON f.doc_id = k.doc_id LEFT JOIN r ON r.doc_id = k.doc_id),
y AS (SELECT *, CASE WHEN sign IS NOT NULL AND t <> '' THEN 'emoji' WHEN culprit IS NOT NULL OR phrase THEN 'dict' WHEN repaired THEN 'resolver' WHEN length(t) >= 3 AND n >= 3 AND contains(t, '{_ar("thing")}') THEN 'model' ELSE '-' END AS layer FROM x)
SELECT doc_id, layer <> '-' AS is_toxic, layer, CASE layer WHEN 'emoji' THEN sign WHEN 'dict' THEN coalesce(culprit, 'phrase') WHEN 'resolver' THEN '{_HIDDEN}' WHEN 'model' THEN '0.9' ELSE CASE WHEN length(t) >= 3 AND n >= 3 THEN '0.1' END END AS reason FROM y"""
)
def layered_verdict_arabic(spark, d):
    """All layers over the documents in Arabic letters, some with a broken word or an emoji, with a rule behind them as the model."""
    text = F.translate(F.translate(F.lower("text"), _LATIN, _SCRIPT), _SIGNS, " " * len(_SIGNS))
    text = F.when(F.expr("doc_id % 5 = 0"), F.replace(text, F.lit(_HIDDEN), F.lit(_BROKEN))).otherwise(text)
    sign = F.expr("doc_id % 7")
    text = F.when(sign == 0, F.concat(text, F.lit(" 🖕"))).when(sign == 1, F.concat(F.lit("يا "), text, F.lit(" 🐶"))).when(sign == 2, F.concat(text, F.lit(" 🔪 🐶"))).otherwise(text)
    terms = spark.createDataFrame([(w, "exact", "word") for w in _ARABIC_WORDS] + [(_ARABIC_PHRASE, "exact", "phrase")], "term string, tier string, kind string")

    def scorer(texts):
        toxic = F.col("text").contains(_ar("thing"))
        return texts.select("text", F.when(toxic, "TOXIC").otherwise("SAFE").alias("label"), F.when(toxic, 0.9).otherwise(0.1).alias("score"))

    return R.verdict(table(spark, d, "documents").select("doc_id", text.alias("text")), terms, profile=None, scorer=scorer, stemming=False)


@query()
def hybrid_cascade(spark, d):
    """The cascade over the documents in Arabic letters, some with a broken word that only a candidate's score tells."""
    text = F.concat(in_arabic(F.col("text")), F.when(F.expr("doc_id % 4 = 0"), f" {_BROKEN}").otherwise(""))
    terms = spark.createDataFrame([(w, "exact", "word") for w in _ARABIC_WORDS if w != _HIDDEN], "term string, tier string, kind string")
    rule = lambda texts: texts.select("text", F.lit("TOXIC").alias("label"), F.when(F.col("text").contains(_HIDDEN), 0.9).otherwise(0.1).alias("score"))
    return R.hybrid(table(spark, d, "documents").select("doc_id", text.alias("text")), terms, rule, stemming=False)


@query()
def resolver_repairs(spark, d):
    # the documents hold no Arabic script: a disguised word is put before each text
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.array(F.lit("غىىىبي")), F.split("text", " ")).alias("tokens"))
    return R.resolve(docs, spark.createDataFrame([("غبي", "exact", "word")], "term string, tier string, kind string"))


EMOJI = R.TOXIC_EMOJI + R.THREAT_EMOJI + R.ANIMAL_EMOJI + "😀🌍🐢"
_GLYPH = f"substr('{EMOJI}', CAST(event_id % {len(EMOJI)} AS INTEGER) + 1, 1)"


@query(
    f"""SELECT event_id,
  CASE WHEN contains('{R.TOXIC_EMOJI}', g) THEN 0.9 WHEN contains('{R.THREAT_EMOJI}', g) THEN 0.8 WHEN contains('{R.ANIMAL_EMOJI}', g) THEN CASE WHEN event_type = 'view' THEN 0.85 ELSE 0.2 END ELSE 0.0 END AS score,
  contains('{R.TOXIC_EMOJI}', g) OR (contains('{R.ANIMAL_EMOJI}', g) AND event_type = 'view') AS is_toxic,
  CASE WHEN contains('{R.TOXIC_EMOJI}', g) THEN 'toxic_emoji' WHEN contains('{R.THREAT_EMOJI}', g) THEN 'threat_emoji' WHEN contains('{R.ANIMAL_EMOJI}', g) THEN CASE WHEN event_type = 'view' THEN 'directed_animal_insult' ELSE 'undirected_animal' END ELSE '' END AS flags,
  CASE WHEN contains('{R.TOXIC_EMOJI}', g) THEN '{R.INSULT_MARK}' WHEN contains('{R.THREAT_EMOJI}', g) THEN '{R.THREAT_MARK}' WHEN contains('{R.ANIMAL_EMOJI}', g) AND event_type = 'view' THEN '{R.AIMED_MARK}' ELSE '' END AS extracted
FROM (SELECT event_id, event_type, {_GLYPH} AS g FROM events)""",
    doubles="score",
)
def emoji_flags(spark, d):
    glyph = F.substring(F.lit(EMOJI), (F.col("event_id") % len(EMOJI) + 1).cast("int"), F.lit(1))
    sign = F.concat(F.when(F.col("event_type") == "view", "Ya ").otherwise("you "), glyph)
    return table(spark, d, "events").select("event_id", R.emoji(sign).alias("e")).select("event_id", "e.score", "e.is_toxic", F.array_join("e.flags", ",").alias("flags"), "e.extracted")


# --- pages, settings, suites, scoring, streams


@query("SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host FROM pages WHERE regexp_extract(url, '://([^/?#:]+)', 1) NOT IN (SELECT DISTINCT regexp_extract(url, '://([^/?#:]+)', 1) FROM pages WHERE page_id % 10 = 3)")
def domain_gate(spark, d):
    pages = table(spark, d, "pages").withColumn("host", T.host(F.col("url")))
    return C.open_pages(pages, pages.where("page_id % 10 = 3")).select("page_id", "host")


@query()
def block_text(spark, d):
    return H.page_blocks(table(spark, d, "pages"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'hide' ELSE 'blur' END AS mode, CASE WHEN page_id % 2 = 0 THEN 0.5 END AS threshold FROM pages", doubles="threshold")
def settings_import(spark, d):
    text = F.to_json(F.struct(F.when(F.expr("page_id % 3 = 0"), "hide").otherwise("paint").alias("mode"), F.when(F.expr("page_id % 2 = 0"), 0.5).otherwise(1.5).alias("threshold")))
    return table(spark, d, "pages").select("page_id", C.parse(text).alias("s")).select("page_id", "s.mode", "s.threshold")


@query("SELECT DISTINCT source AS word FROM documents UNION SELECT DISTINCT lang FROM documents")
def share_code_round_trip(spark, d):
    docs = table(spark, d, "documents")
    return C.from_share_code(C.share_code(docs.select(F.col("source").alias("word"))), docs.select(F.col("lang").alias("word")).distinct())


_JOINED = lambda sign: f"array_to_string(string_split(word, ''), '{sign}')"
_HEAD, _TAIL = "left(word, length(word) // 2)", "substr(word, length(word) // 2 + 1)"


@query(
    f"""SELECT word, word AS plain, {_JOINED(".")} AS dots, {_JOINED(" ")} AS spaces, {_JOINED("-")} AS dashes, {_JOINED("_")} AS underscore, repeat(left(word, 1), 4) || substr(word, 2) AS elongate,
  {_JOINED(chr(0x640))} AS tatweel, {_JOINED(chr(0x64E))} AS diacritics, {_JOINED(chr(0x200B))} AS zero_width, translate(word, 'ا', 'أ') AS alef_swap, translate(word, 'كي', 'کی') AS farsi, regexp_replace(word, 'ه$', 'ة') AS ta_marbuta,
  translate(word, 'اهaeo', 'аеаео') AS cyrillic, {_HEAD} || 'ىى' || {_TAIL} AS filler, {_HEAD} || '*' || {_TAIL} AS mask
FROM (SELECT DISTINCT source || '/' || lang AS word FROM documents)"""
)
def suite_disguises(spark, d):
    words = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("word")).distinct()
    return words.select("word", *(c.alias(n) for n, c in G.disguises(F.col("word")).items()))


@query()
def suite_adversarial(spark, d):
    """Sources as seed words, a third of them contextual."""
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    seeds = table(spark, d, "documents").select(F.col("source").alias("word"), (number % 2).alias("expected"), "lang", (number % 3 == 0).alias("contextual")).groupBy("word", "expected", "contextual").agg(F.min("lang").alias("category"))
    return G.adversarial(seeds, MORPHS, CARRIERS, ["a {} came", "my {}"], ["the {} is here", "I saw a {}", "{} is a word"])


@query()
def suite_generation(spark, d):
    """Every source and language as a seed word, each of their texts' languages a dialect."""
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    seeds = table(spark, d, "documents").select(F.concat_ws("-", "source", "lang").alias("word"), (number % 2).alias("expected"), F.col("lang").alias("dialect"), F.col("source").alias("category")).distinct()
    return G.generate(seeds, MORPHS, CARRIERS, 120)


@query()
def hard_negative_suite(spark, d):
    texts = table(spark, d, "documents").select(F.col("source").alias("category"), "text")
    return G.hard_negatives(texts, ["{}", "he said {}"])


def _toy_model():
    return lambda texts: [[("Toxic", p := min(1.0, t.lower().count("idiot") / 2)), ("Safe", 1 - p)] for t in texts]


@query("SELECT text, CASE WHEN n > 1 THEN 'TOXIC' ELSE 'SAFE' END AS label, CASE WHEN n >= 2 THEN 1.0 ELSE n / 2.0 END AS score FROM (SELECT text, (length(lower(text)) - length(replace(lower(text), 'idiot', ''))) // 5 AS n FROM (SELECT DISTINCT text FROM documents WHERE length(text) BETWEEN 3 AND 2000))")
def batch_scoring(spark, d):
    texts = table(spark, d, "documents").select("text").where(F.length("text").between(3, 2000)).distinct()
    return M.classify(texts, _toy_model).select("text", M.reduce_scores(F.col("scores")).alias("r")).select("text", "r.label", "r.score")


@query("SELECT text, CASE WHEN length(text) % 3 = 0 THEN 'TOXIC' WHEN contains(text, 'idiot') THEN 'TOXIC' ELSE 'SAFE' END AS label, CASE WHEN length(text) % 3 = 0 THEN 0.5 ELSE 0.25 END AS score FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)", doubles="score")
def known_scores(spark, d):
    """A third of the texts is in the table of scored ones; a rule stands for the model on the others."""
    texts = table(spark, d, "documents").select("text")
    known = texts.where("length(text) % 3 = 0").select("text", F.lit("TOXIC").alias("label"), F.lit(0.5).alias("score"))
    return M.score_new(texts, known, lambda df: df.select("text", F.when(F.col("text").contains("idiot"), "TOXIC").otherwise("SAFE").alias("label"), F.lit(0.25).alias("score")))


@query(streams.lockout_twin("epoch_us(ts) / 1e6", "event_type <> 'error'"))
def lockout_replay(spark, d):
    tries = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("success"))
    return O.replay(tries)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def running_counters(spark, d):
    return O.counters(table(spark, d, "events"), "event_type")


# --- more predicates, look-ups and streams


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 3 AND 1000 AND NOT contains(text, chr(65533))")
def length_window(spark, d):
    return table(spark, d, "documents").where(F.length("text").between(3, 1000) & ~T.has_mojibake(F.col("text"))).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE length(text) >= 3 AND len({TOKENS}) >= 3")
def model_gate(spark, d):
    return table(spark, d, "documents").where(R.gate(F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'thing') OR contains(text, 'ción')")
def partial_hits(spark, d):
    return table(spark, d, "documents").where(L.partial_hits(F.col("text"), ["thing", "ción", "x", "moron"], ("moron",))).select("doc_id")


@query(f"WITH {LABELLED}, c AS (SELECT source AS text FROM labelled GROUP BY source HAVING avg(label) > 0 AND avg(label) < 1 ORDER BY source LIMIT 200) SELECT doc_id, source FROM labelled WHERE source IN (SELECT text FROM c)")
def conflict_rows(spark, d):
    rows = labelled(spark, d)
    few = B.conflicts(rows.select(F.col("source").alias("text"), "label")).orderBy("text").limit(200).select(F.col("text").alias("source"))
    return rows.join(few, "source", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS shown FROM documents")
def truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 80, "…").alias("shown"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS predicted FROM embeddings")
def argmax(spark, d):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", M.softmax(logits).alias("s")).select("vec_id", "s.predicted")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return O.windowed(events, "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("SELECT conv_id, count(*) AS n_turns FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id")
def distinct_turns(spark, d):
    turns = table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"])
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


@query()
def sentence_candidates(spark, d):
    # the documents hold no Arabic script: a disguised word is put before each text
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.array(F.lit("غىىىبي")), F.split("text", " ")).alias("tokens"))
    return R.sentence_candidates(docs)


@query(f"WITH {_shape_hits(False)} SELECT doc_id, true AS exact, false AS contextual, false AS pejorative, culprit FROM h")
def match_all_forms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return L.match_forms(docs, lexicon(spark).where("tier = 'exact' AND kind = 'word'"), stemming=False)


@query("WITH o AS (SELECT source AS name, min(lang) AS dialect, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT source AS name, max(lang) AS dialect, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1) SELECT * FROM o WHERE name NOT IN (SELECT name FROM w) UNION ALL SELECT * FROM w")
def config_upsert(spark, d):
    """A table of sources by name, in which the toxic documents' rows replace those of the same name."""
    docs = table(spark, d, "documents")
    by_name = lambda df, lang: df.groupBy(F.col("source").alias("name")).agg(lang("lang").alias("dialect"), F.count("*").alias("n"))
    toxic = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return files.merge_tables(by_name(docs, F.min), by_name(toxic, F.max), "name")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
