"""Batch scoring of distinct texts by a pluggable model, and a native baseline model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent import futures

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH, LONGEST = 50, 2000
# Seconds to wait before another try, by what failed, and for a call to end.
WAITS = {"busy": 20.0, "limited": 5.0, "timeout": 1.0, "other": 20.0}
TIMEOUT = 60.0
SCORED = "text string, scores array<struct<label:string,score:double>>, error string"


class ModelFailure(Exception):
    """What a model raises to say how it failed: ``busy`` (503), ``limited`` (429), ``timeout`` or ``other``."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


def patiently(model: Callable, texts: list[str], retries: int = 3, waits: dict[str, float] | None = None, timeout: float = TIMEOUT, sleep: Callable[[float], None] = time.sleep) -> tuple[list | None, str | None]:
    """(answer, None) or (None, error): a call is given ``timeout`` seconds, and after a failure ``retries`` more tries, each after the wait of its kind."""
    waits = WAITS | (waits or {})
    for left in range(retries, -1, -1):
        pool = futures.ThreadPoolExecutor(1)
        try:
            return pool.submit(model, texts).result(timeout), None
        except futures.TimeoutError:
            kind, message = "timeout", f"no answer in {timeout} s"
        except Exception as e:  # noqa: BLE001  a model may fail in any way; the error is told in its column
            kind, message = getattr(e, "kind", "other"), str(e)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        if left:
            sleep(waits.get(kind, waits["other"]))
    return None, message


def score_new(texts: DataFrame, known: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(text, label, score) of every distinct text: from the table of ``known`` ones where it has it, else by ``scorer``."""
    own = texts.select("text").where("text IS NOT NULL").distinct()
    names = ["text", "label", "score"]
    found = own.join(known.select(*names).dropDuplicates(["text"]), "text")
    return found.select(*names).union(scorer(own.join(known.select("text"), "text", "left_anti")).select(*names))


def classify(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]], batch: int = BATCH, retries: int = 3, waits: dict[str, float] | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """(text, scores, error) of rows (text): the model is loaded once a worker and called with up to ``batch`` texts.

    Blank texts and those over 2000 characters are refused with an error. A call that keeps
    failing (:func:`patiently`) gives null scores and the error, never a verdict.
    """
    if not 1 <= batch <= BATCH:
        raise ValueError(f"a request holds 1 to {BATCH} texts")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                valid = part.text.map(lambda t: isinstance(t, str) and bool(t.strip()) and len(t) <= LONGEST)
                scores, error = [None] * len(part), [None if v else "empty or too long" for v in valid]
                own = part.text[valid].tolist()
                if own:
                    made, message = patiently(model, own, retries, waits, timeout)
                    if made is None:
                        error = [x or message for x in error]
                    if made is not None:
                        it = iter(made)
                        scores = [[{"label": a, "score": float(b)} for a, b in next(it)] if v else None for v in valid]
                yield pd.DataFrame({"text": part.text.tolist(), "scores": scores, "error": error})

    return texts.select("text").mapInPandas(run, SCORED)


def reduce_scores(scores: Column, toxic: tuple[str, ...] = ("Toxic", "LABEL_1")) -> Column:
    """struct(label, score): TOXIC with the toxic score where it is above the other; SAFE and 0 without scores."""
    of = lambda own: F.coalesce(F.try_element_at(F.transform(own, lambda s: s.score), F.lit(1)), F.lit(0.0))
    bad, good = of(F.filter(scores, lambda s: s.label.isin(*toxic))), of(F.filter(scores, lambda s: ~s.label.isin(*toxic)))
    return F.struct(F.when(bad > good, "TOXIC").otherwise("SAFE").alias("label"), bad.alias("score"))


def reduced(scores: list[tuple[str, float]], toxic: tuple[str, ...] = ("Toxic", "LABEL_1")) -> tuple[str, float]:
    """:func:`reduce_scores` of one answer, where a stateful operator holds it."""
    bad = next((s for label, s in scores if label in toxic), 0.0)
    good = next((s for label, s in scores if label not in toxic), 0.0)
    return ("TOXIC" if bad > good else "SAFE"), float(bad)


def softmax(logits: Column) -> Column:
    """struct(predicted, confidence) of an array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.struct((F.array_position(logits, top) - 1).cast("int").alias("predicted"), (1.0 / total).alias("confidence"))


def baseline(train: DataFrame, features: int = 1 << 16, iterations: int = 30):
    """A hashed bag of words under logistic regression, weighted for the rarer class: a fitted ``pyspark.ml`` pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    n = train.agg(F.count_if(F.expr("label = 0")).alias("safe"), F.count_if(F.expr("label = 1")).alias("toxic")).first()
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, n.safe / max(n.toxic, 1)).otherwise(1.0)).withColumn("label", F.col("label").cast("double"))
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+")
    return Pipeline(stages=[words, HashingTF(inputCol="words", outputCol="features", numFeatures=features), LogisticRegression(weightCol="weight", maxIter=iterations)]).fit(weighted)
