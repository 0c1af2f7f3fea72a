"""Point metrics as a long frame, and the verification of stored predictions against what was logged about them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework import gates
from sievework.operators import metrics

COVERAGES = (0.5, 0.8, 0.9)
TOL = 1e-9


def point_metrics(df: DataFrame, labels: list[str], key: str, coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """``metric, value`` of a prediction frame ``key, y_true, y_pred, probs`` (p_max and rightness follow from probs)."""
    bad = [c for c in coverages if not 0 < c <= 1]
    if bad:
        raise ValueError(f"a coverage lies above 0 and at most at 1: {bad}")
    scored = metrics.scored(df, labels)
    one = lambda frame, *names: frame.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*")
    parts = [
        one(metrics.scalars(df, labels), "accuracy", "macro_f1", "balanced_accuracy"),
        one(metrics.ece(scored), "ece"),
        one(metrics.brier(df, labels), "brier"),
        one(metrics.aurc(metrics.risk_coverage(scored, key)), "aurc"),
        metrics.per_class(df, labels).select(F.concat(F.lit("f1::"), "label").alias("metric"), F.col("f1").cast("double").alias("value")),
        metrics.accuracy_at_coverage(scored, key, coverages).select(F.concat(F.lit("acc_at_cov::"), F.col("coverage").cast("string")).alias("metric"), F.col("accuracy").cast("double").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def prob_checks(df: DataFrame, labels: list[str], key: str) -> DataFrame:
    """``check, n_bad, first`` (the smallest offending key): what probabilities must be, and what follows from them."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    finite = F.forall("probs", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    at = F.array_position(F.array(*map(F.lit, labels)), F.col("y_pred")).cast("int")
    own = F.when(at > 0, F.try_element_at("probs", at))
    rules = {
        "one probability a label": F.size("probs") == len(labels),
        "probabilities from 0 to 1": finite,
        "probabilities sum to 1": F.abs(total - 1) <= 1e-6,
        "p_max is the largest": F.col("p_max") == F.array_max("probs"),
        "y_pred has the largest": own == F.array_max("probs"),
        "labels are declared": F.col("y_true").isin(labels) & F.col("y_pred").isin(labels),
    }
    broken = {n: ~F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    counts = df.agg(*(x for i, c in enumerate(broken.values()) for x in (F.count_if(c).alias(f"n{i}"), F.min(F.when(c, F.col(key))).alias(f"f{i}"))))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"n{i}").alias("n_bad"), F.col(f"f{i}").alias("first")) for i, n in enumerate(broken)))
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def metric_checks(found: DataFrame, logged: dict[str, float], tol: float = TOL) -> DataFrame:
    """``check, logged, recomputed, ok``: every logged metric against the recomputed one; absent ones are not ok."""
    said = found.sparkSession.createDataFrame([(k, float(v)) for k, v in sorted(logged.items())], "check string, logged double")
    both = said.join(found.select(F.col("metric").alias("check"), F.col("value").alias("recomputed")), "check", "left")
    same = (F.abs(F.col("logged") - F.col("recomputed")) <= tol) | (F.isnan("logged") & F.isnan("recomputed"))
    return both.withColumn("ok", F.coalesce(same, F.lit(False)))


def provenance(said: dict, record: dict, fields: tuple[str, ...]) -> None:
    """Each field of an artifact's provenance equals the record's; empty is no value."""
    bad = {f: (said.get(f), record.get(f)) for f in fields if not said.get(f) or said.get(f) != record.get(f)}
    if bad:
        raise gates.GateError(f"provenance differs: {bad}")


def against_split(df: DataFrame, split: DataFrame, key: str, label: str) -> DataFrame:
    """``check, n_bad, first``: ids that the split lacks, repeated ids, and truths that differ from the split's."""
    s = split.select(F.col(key).alias("_k"), F.col(label).alias("_l"))
    j = df.select(key, "y_true").join(s, F.col(key) == F.col("_k"), "left")
    lost, other = F.col("_k").isNull(), F.col("_k").isNotNull() & ~F.col("_l").eqNullSafe(F.col("y_true"))
    a = j.agg(F.count_if(lost).alias("n0"), F.min(F.when(lost, F.col(key))).alias("f0"), F.count_if(other).alias("n1"), F.min(F.when(other, F.col(key))).alias("f1"))
    r = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n2"), F.min(key).alias("f2"))
    names = ("ids are in the split", "truths are the split's", "ids are unique")
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"n{i}").alias("n_bad"), F.col(f"f{i}").alias("first")) for i, n in enumerate(names)))
    return a.crossJoin(r).select(F.explode(rows).alias("x")).select("x.*")  # one row each


def artifact(df: DataFrame, labels: list[str], key: str, split: DataFrame, label: str, logged: dict[str, float], tol: float = TOL) -> list[dict]:
    """All checks of a stored prediction frame, structure first; metrics are recomputed only where structure holds."""
    rows = [{"check": r.check, "ok": r.n_bad == 0, "n_bad": r.n_bad, "first": r.first} for r in against_split(df, split, key, label).unionByName(prob_checks(df, labels, key)).collect()]
    if all(r["ok"] for r in rows):
        coverages = tuple(float(k.split("::")[1]) for k in logged if k.startswith("acc_at_cov::")) or COVERAGES
        rows += [r.asDict() for r in metric_checks(point_metrics(df, labels, key, coverages), logged, tol).orderBy("check").collect()]
    return rows


def require(rows: list[dict]) -> None:
    bad = [r["check"] for r in rows if not r["ok"]]
    if bad:
        raise gates.GateError(f"checks that failed: {', '.join(bad)}")


def calibration_exhibit(df: DataFrame, labels: list[str], logged_ece: float, tol: float = TOL) -> list[dict]:
    """Reliability bins whose expected calibration error is the logged one."""
    bins = [r.asDict() for r in metrics.reliability(metrics.scored(df, labels)).orderBy("bin").collect()]
    n = sum(b["n"] for b in bins)
    replay = sum(b["n"] * abs(b["accuracy"] - b["confidence"]) for b in bins) / n if n else math.nan
    if not abs(replay - logged_ece) <= tol:
        raise gates.GateError(f"bins give an error of {replay}, the record says {logged_ece}")
    return bins
