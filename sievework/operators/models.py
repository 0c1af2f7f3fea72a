"""Model runners: a registry of named runners, a TF-IDF linear model and one-vs-rest isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import word_tokens

RUNNERS: dict[str, Callable] = {}


def register_runner(name: str) -> Callable:
    def wrap(f: Callable) -> Callable:
        if name in RUNNERS:
            raise ValueError(f"runner registered twice: {name}")
        RUNNERS[name] = f
        return f

    return wrap


def run(name: str, *args, **kw) -> DataFrame:
    if name not in RUNNERS:
        raise KeyError(f"no runner named {name}; known: {sorted(RUNNERS)}")
    return RUNNERS[name](*args, **kw)


@register_runner("tfidf_linear")
def tfidf_linear(train: DataFrame, test: DataFrame, family: str = "logreg", vocabulary: int = 150_000, min_df: int = 5) -> DataFrame:
    """Fits ``text, y_true`` rows, predicts ``id, text, y_true`` rows: ``id, y_true, y_pred, p_max, probs``.

    Classes are weighted by inverse frequency for the logistic model; complement naive Bayes is the other family.
    """
    counts = {r.y_true: r.n for r in train.groupBy("y_true").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, total / (len(counts) * n))))
    prep = lambda d: d.withColumn("tokens", word_tokens(F.col("text")))
    index = StringIndexer(inputCol="y_true", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")
    steps = [index, CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=vocabulary, minDF=min_df), IDF(inputCol="tf", outputCol="features")]
    if family == "logreg":
        steps.append(LogisticRegression(weightCol="weight", maxIter=50, regParam=1e-4))
    elif family == "complement_nb":
        steps.append(NaiveBayes(modelType="complement"))
    else:
        raise ValueError(f"unknown family: {family}")
    model = Pipeline(stages=steps).fit(prep(train).withColumn("weight", F.element_at(weight, F.col("y_true"))))
    labels = model.stages[0].labels
    out = model.transform(prep(test))
    probs = F.slice(vector_to_array("probability"), 1, len(labels))
    pred = F.element_at(F.array(*map(F.lit, labels)), F.array_position(probs, F.array_max(probs)).cast("int"))
    return out.select("id", "y_true", pred.alias("y_pred"), F.array_max(probs).alias("p_max"), probs.alias("probs"))


def isotonic(calibration: DataFrame, frame: DataFrame, labels: list[str]) -> DataFrame:
    """One-vs-rest isotonic calibration of ``probs``; rows are normalised, a row of zeros becomes uniform."""
    parts = []
    for i, x in enumerate(labels):
        rows = calibration.select((F.col("y_true") == x).cast("double").alias("label"), F.col("probs")[i].alias("features"))
        m = IsotonicRegression().fit(rows)
        xs, ys = list(m.boundaries), list(m.predictions)
        parts.append(_interp(F.col("probs")[i], xs, ys))
    raw = F.array(*parts)
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return frame.withColumn("probs", F.when(total > 0, F.transform(raw, lambda v: v / total)).otherwise(F.array(*[F.lit(1 / len(labels))] * len(labels))))


def _interp(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear between points, flat outside; a binary search over literal arrays."""
    at, value, last = F.lit([float(v) for v in xs]), F.lit([float(v) for v in ys]), len(xs) - 1
    place = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s.lo + s.hi + 1, 1)
        return F.when(F.get(at, mid) <= x, place(mid, s.hi)).otherwise(place(s.lo, F.greatest(mid - 1, s.lo)))

    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(len(xs))) + 1)))
    i = F.aggregate(steps, place(F.lit(0), F.lit(last)), halve, lambda s: s.lo)

    def between(i: Column) -> Column:
        a, b, p, q = F.get(at, i), F.get(at, i + 1), F.get(value, i), F.get(value, i + 1)
        return p + (x - a) * (q - p) / (b - a)

    inside = F.get(F.transform(F.array(i), between), F.lit(0))
    return F.when(x < xs[0], float(ys[0])).when(x >= xs[-1], float(ys[-1])).otherwise(inside)
