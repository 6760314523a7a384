"""Logistic regression over hashed words that goes on from given weights and stops early.

The weights are as many as there are features, a fixed number, and go to every task; a pass over
the rows sums their gradients in each task and then by feature. Contributions are
rounded to multiples of 2 ** -30 before they are added, so a sum is the same in any order and
partitioning, and a fit can be repeated to the bit.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.session import stored

FEATURES = 1 << 16
#: Passes without a better loss on the held-out part before the fit ends.
PATIENCE = 2
STEP = float(1 << 30)
#: Places beside the features': the bias, then what is told of a pass.
BIAS, TRAIN_LOSS, TRAIN_WEIGHT, HELD_LOSS, HELD_WEIGHT = range(5)


@dataclasses.dataclass
class Model:
    """Weights of the features, the bias, and of each pass (train loss, held-out loss) before its step; ``best`` is the pass whose weights these are."""

    weights: np.ndarray
    bias: float = 0.0
    history: list[tuple[float, float]] = dataclasses.field(default_factory=list)
    best: int = 0

    @classmethod
    def blank(cls, features: int = FEATURES) -> Model:
        return cls(np.zeros(features))


def hashed(rows: DataFrame, features: int, text: str = "text") -> DataFrame:
    """``rows`` with ``words``: the features of the lower-cased words, with repeats; none of null text."""
    words = F.coalesce(T.tokens(F.lower(text)), F.array().cast("array<string>"))
    return rows.withColumn("words", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int")))


def _margins(words: pa.Array, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(margins, scale of each row, flat features, words of each row): a row's words weigh one over the root of their number."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
    n = np.diff(ends)
    total = np.concatenate([[0.0], np.cumsum(weights[flat])])
    at = ends - ends[0]
    scale = 1.0 / np.sqrt(np.maximum(n, 1))
    return (total[at[1:]] - total[at[:-1]]) * scale + bias, scale, flat, n


def _pass(rows: DataFrame, model: Model) -> np.ndarray:
    """The sums of one pass: the five told numbers, the bias' gradient first, and then the gradient of each feature."""
    weights, bias, features = model.weights, model.bias, len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(features + 5, np.int64)
        for batch in batches:
            margin, scale, flat, n = _margins(batch.column("words"), weights, bias)
            label, weight = batch.column("label").to_numpy(), batch.column("weight").to_numpy()
            held = batch.column("held").to_numpy(zero_copy_only=False)
            loss = weight * (np.logaddexp(0.0, margin) - label * margin)
            error = np.where(held, 0.0, weight * (1.0 / (1.0 + np.exp(-np.clip(margin, -60, 60))) - label))
            whole = lambda x: int(np.rint(x * STEP).astype(np.int64).sum())
            out[:5] += [whole(error), whole(loss[~held]), whole(weight[~held]), whole(loss[held]), whole(weight[held])]
            # whole numbers below 2 ** 53, so these sums are exact
            out[5:] += np.bincount(flat, np.repeat(np.rint(error * scale * STEP), n), features).astype(np.int64)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["place", "total"])

    out = np.zeros(features + 5)
    for r in rows.select("label", "weight", "held", "words").mapInArrow(run, "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r.place] = r.total / STEP
    return out


def fit(
    train: DataFrame, start: Model | None = None, features: int = FEATURES, passes: int = 30, rate: float = 0.5, decay: float = 0.0, patience: int = PATIENCE, held_out: float = 0.1, seed: int = 42, balanced: bool = True,
) -> Model:
    """A model of rows (text, label 0 or 1), from ``start`` or from nothing; rows without a label take no part.

    A ``held_out`` share of the *texts*, by a seeded hash, only measures: the fit ends after
    ``patience`` passes without a better loss there, and the best pass' weights are returned, so going on
    never makes a given model worse on them. ``balanced`` weighs toxic rows by safe over toxic. A row may bring its
    own ``weight``. Each weight's step shrinks with the gradients that it has seen.
    """
    model = Model(start.weights.copy(), start.bias) if start is not None else Model.blank(features)
    known = train.where("label IN (0, 1)")
    own = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    ratio = 1.0
    if balanced:
        n = known.agg(F.count_if(F.expr("label = 0")).alias("safe"), F.count_if(F.expr("label = 1")).alias("toxic")).first()
        ratio = n.safe / n.toxic if n.safe and n.toxic else 1.0
    held = F.pmod(F.xxhash64(F.lit(seed), F.col("text")), F.lit(1 << 20)) < int(held_out * (1 << 20))
    rows = hashed(known, len(model.weights)).select(F.col("label").cast("double").alias("label"), (own * F.when(F.col("label") == 1, ratio).otherwise(1.0)).alias("weight"), held.alias("held"), "words")
    rows = stored(rows, "training")
    seen, history, best, stale = np.zeros(len(model.weights) + 1), [], None, 0
    for n_pass in range(passes + 1):
        told = _pass(rows, model)
        mean = lambda loss, weight: told[loss] / told[weight] if told[weight] else 0.0  # noqa: B023, E731
        history.append((mean(TRAIN_LOSS, TRAIN_WEIGHT), mean(HELD_LOSS, HELD_WEIGHT)))
        if best is None or history[-1][1] < history[best[0]][1] or not told[HELD_WEIGHT]:
            best, stale = (n_pass, model.weights.copy(), model.bias), 0
        else:
            stale += 1
        if stale >= patience or n_pass == passes or not told[TRAIN_WEIGHT]:
            break
        slope = np.concatenate([told[5:], told[:1]]) / told[TRAIN_WEIGHT]
        slope[:-1] += decay * model.weights
        seen += slope**2
        step = rate * slope / (np.sqrt(seen) + 1e-12)
        model.weights -= step[:-1]
        model.bias -= float(step[-1])
    return Model(best[1], best[2], history, best[0])


def scored(texts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``texts`` with ``score``: the probability of the label 1."""
    weights, bias = model.weights, model.bias

    @F.arrow_udf("double")
    def probability(words: pa.Array) -> pa.Array:
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(_margins(words, weights, bias)[0], -60, 60))))

    return hashed(texts, len(weights), text).withColumn("score", probability("words")).drop("words")


def save(spark: SparkSession, model: Model, path: str) -> None:
    """The weights that are not 0, and the number of features and the bias beside, as a small table."""
    at = np.flatnonzero(model.weights)
    rows = [(int(i), float(model.weights[i])) for i in at] + [(-1, model.bias), (-2, float(len(model.weights)))]
    spark.createDataFrame(rows, "place int, weight double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = {r.place: r.weight for r in spark.read.parquet(path).collect()}
    weights = np.zeros(int(rows.pop(-2)))
    bias = rows.pop(-1)
    for place, weight in rows.items():
        weights[place] = weight
    return Model(weights, bias)
