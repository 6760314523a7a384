"""Classifier quality: confusion, precision and recall, by any dimensions, with error slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}


def cells(label: str = "label", predicted: str = "predicted") -> list[Column]:
    return [F.count_if((F.col(label) == y) & (F.col(predicted) == p)).alias(n) for n, (y, p) in CELLS.items()]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def confusion(df: DataFrame) -> DataFrame:
    return df.agg(*cells())


def metrics(df: DataFrame, digits: int = 6) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class, of the negative one, and weighted by support."""
    tp, fp, fn, tn = (F.col(c) for c in CELLS)
    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    n1, n0, n = tp + fn, tn + fp, tp + fp + fn + tn
    values = {
        "accuracy": ratio(tp + tn, n), "precision_toxic": p1, "recall_toxic": r1, "f1_toxic": f1(p1, r1), "f1_safe": f1(p0, r0),
        "precision_weighted": ratio(p1 * n1 + p0 * n0, n), "recall_weighted": ratio(r1 * n1 + r0 * n0, n), "f1_weighted": ratio(f1(p1, r1) * n1 + f1(p0, r0) * n0, n),
    }
    return confusion(df).select(*(F.round(v, digits).alias(k) for k, v in values.items()))


def report(df: DataFrame, digits: int = 6) -> DataFrame:
    """(class, precision, recall, f1, support) of each class and their macro and weighted means."""
    tp, fp, fn, tn = (F.col(c) for c in CELLS)
    one = [ratio(tp, tp + fp), ratio(tp, tp + fn), (tp + fn)]
    zero = [ratio(tn, tn + fn), ratio(tn, tn + fp), (tn + fp)]
    one.insert(2, f1(one[0], one[1]))
    zero.insert(2, f1(zero[0], zero[1]))
    total = one[3] + zero[3]
    macro = [(a + b) / 2 for a, b in zip(one[:3], zero[:3], strict=True)] + [total]
    weighted = [ratio(a * one[3] + b * zero[3], total) for a, b in zip(one[:3], zero[:3], strict=True)] + [total]
    rows = [F.struct(F.lit(n).alias("class"), *(F.round(v, digits).alias(k) for k, v in zip(("precision", "recall", "f1"), r[:3], strict=True)), r[3].cast("long").alias("support")) for n, r in (("safe", zero), ("toxic", one), ("macro", macro), ("weighted", weighted))]
    return confusion(df).select(F.inline(F.array(*rows)))


def class_weights(df: DataFrame) -> DataFrame:
    """Weight of the toxic class: safe rows by toxic rows (at least one)."""
    return df.agg(F.lit(1.0).alias("safe"), F.round(F.count_if(F.col("label") == 0) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1)), 6).alias("toxic"))


def by_dimensions(df: DataFrame, dimensions: list[str], digits: int = 6) -> DataFrame:
    """(dimension, value, n, tp, fp, fn, tn, precision, recall, f1): overall and by each dimension, in one pass of grouping sets."""
    own = df.select("label", "predicted", *dimensions)
    groups = own.groupingSets([[], *([F.col(d)] for d in dimensions)], *(F.col(d) for d in dimensions)).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), *cells())
    width = len(dimensions)
    name, value = F.lit("overall"), F.lit("all")
    for i, d in enumerate(dimensions):
        # grouping_id has a 0 at the grouped column's bit, the first column's being the highest
        alone = F.col("gid") == ((1 << width) - 1) - (1 << (width - 1 - i))
        name, value = F.when(alone, d).otherwise(name), F.when(alone, F.col(d).cast("string")).otherwise(value)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return groups.select(name.alias("dimension"), value.alias("value"), "n", *CELLS, F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f1(p, r), digits).alias("f1"))


def by_category(df: DataFrame, category: str = "category") -> DataFrame:
    """(category, n, ok, fp, fn, accuracy, specificity, status): status good from 80 %, fair from 50 %."""
    ok = F.count_if(F.col("label") == F.col("predicted"))
    out = df.groupBy(category).agg(F.count("*").alias("n"), ok.alias("ok"), F.count_if(F.expr("label = 0 AND predicted = 1")).alias("fp"), F.count_if(F.expr("label = 1 AND predicted = 0")).alias("fn"))
    accuracy = F.round(100.0 * F.col("ok") / F.col("n"), 4)
    return out.select(category, "n", "ok", "fp", "fn", accuracy.alias("accuracy"), F.round((F.col("n") - F.col("fp")) / F.col("n"), 6).alias("specificity"), F.when(accuracy >= 80, "good").when(accuracy >= 50, "fair").otherwise("poor").alias("status"))


def by_layer(df: DataFrame) -> DataFrame:
    """(layer, n, correct) among rows predicted toxic."""
    return df.where("predicted = 1").groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.expr("label = 1")).alias("correct"))


def misses(df: DataFrame, category: str = "category", obf: str = "obf") -> DataFrame:
    """Toxic rows that were missed: plain ones are headroom of the rules, disguised ones the model's ceiling."""
    bucket = F.when(F.col(obf) == "plain", "rule_headroom").otherwise("model_ceiling")
    return df.where("label = 1 AND predicted = 0").groupBy(category, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def error_slices(df: DataFrame, key: str, by: str, most: int = 3) -> DataFrame:
    """The first ``most`` errors of each kind and slice, by key."""
    errors = df.where("label != predicted").withColumn("error", F.when(F.col("predicted") == 1, "fp").otherwise("fn"))
    order = Window.partitionBy("error", by).orderBy(key)
    return errors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("error", by, "place", key)


def compare(df: DataFrame, models: list[str], dataset: str = "dataset") -> DataFrame:
    """(dataset, model accuracies in per cent, difference of the last to the first)."""
    accuracy = [F.round(100 * F.avg((F.col("label") == F.col(m)).cast("double")), 4).alias(m) for m in models]
    out = df.groupBy(dataset).agg(*accuracy)
    return out.withColumn("difference", F.round(F.col(models[-1]) - F.col(models[0]), 4))


def cascade(df: DataFrame, key: str, score: str = "score", source: str = "candidate") -> DataFrame:
    """(key, score, source): the highest score over all candidates of a text, and whose it is."""
    return df.groupBy(key).agg(F.max(score).alias(score), F.max_by(source, F.struct(score, source)).alias(source))


def tier(total: Column, thresholds: tuple[int, ...] = (10, 50, 100, 500, 1000)) -> Column:
    """The highest threshold reached, or null."""
    out = F.lit(None).cast("int")
    for t in sorted(thresholds):
        out = F.when(total >= t, t).otherwise(out)
    return out
