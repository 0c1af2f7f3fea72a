"""Classification and calibration metrics over a prediction frame: ``id, y_true, y_pred, probs`` (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.stats import ratio
from sievework.operators.ranking import ranked, running


def class_dim(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in labels], "label string")


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, labels: list[str]) -> DataFrame:
    """Support, true positives, recall and F1 of every declared label (0 where undefined)."""
    c = confusion(df)
    t = c.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    got = class_dim(df, labels).join(t, "label", "left").join(p, "label", "left").na.fill(0)
    return got.select("label", "support", "tp", "predicted", ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def scalars(df: DataFrame, labels: list[str]) -> DataFrame:
    """accuracy, macro F1 (all labels) and balanced accuracy (labels with support) in one row."""
    k = per_class(df, labels)
    return k.agg(
        F.coalesce(F.sum("tp") / F.sum("support"), F.lit(0.0)).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
    )


def top(probs: Column, labels: list[str]) -> Column:
    """Label of the largest probability, the first on ties."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(probs, F.array_max(probs)).cast("int"))


def scored(df: DataFrame, labels: list[str]) -> DataFrame:
    """Adds ``p_max`` and ``correct`` by the argmax of the probabilities."""
    return df.withColumn("p_max", F.array_max("probs")).withColumn("correct", (top(F.col("probs"), labels) == F.col("y_true")).cast("int"))


def reliability(df: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-width bins with count, mean confidence and accuracy; empty bins stay."""
    b = F.least(F.floor(F.col("p_max") * bins), F.lit(bins - 1))
    got = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_max").alias("confidence"), F.avg("correct").alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(got, "bin", "left").na.fill(0)


def ece(df: DataFrame, bins: int = 15) -> DataFrame:
    r = reliability(df, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, labels: list[str]) -> DataFrame:
    hot = F.array(*((F.col("y_true") == x).cast("double") for x in labels))
    row = F.aggregate(F.zip_with("probs", hot, lambda p, y: (p - y) * (p - y)), F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.avg(row).alias("brier"))


def risk_coverage(df: DataFrame, key: str) -> DataFrame:
    """Per rank (confidence descending, key ascending): cumulative errors over the whole frame."""
    rows = df.select(key, "p_max", "correct")
    return running(rows, [F.col("p_max").desc(), F.col(key).asc()], {"errors": 1 - F.col("correct")}).select(key, "rank", "errors", "correct")


def aurc(curve: DataFrame) -> DataFrame:
    return curve.agg(F.avg(F.col("errors") / F.col("rank")).alias("aurc"))


def accuracy_at_coverage(df: DataFrame, key: str, coverages: tuple[float, ...]) -> DataFrame:
    """Accuracy of the top ceil(c N) rows, at least one, at most all."""
    r = ranked(df.select(key, "p_max", "correct"), F.col("p_max").desc(), F.col(key).asc())
    n = r.agg(F.count(F.lit(1)).alias("n")).first().n
    import math

    # ceil with the slack of a float product such as 0.7 * 10
    k = {c: min(max(1, math.ceil(round(c * n, 9))), n) for c in coverages}
    got = r.agg(*(F.avg(F.when(F.col("rank") <= k[c], F.col("correct"))).alias(f"c{i}") for i, c in enumerate(coverages)))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("coverage"), F.col(f"c{i}").alias("accuracy")) for i, c in enumerate(coverages)))).alias("x")).select("x.*")
