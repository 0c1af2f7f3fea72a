"""Paired claims between policies, joint thresholds of a cascade, and exemplar selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.stats import ci_class
from sievework.operators.ranking import hash_rank
from sievework.operators.resampling import bands, replicate_means


def paired_claim(pairs: DataFrame, key: str, deltas: dict[str, Column], reps: int, seed: str) -> DataFrame:
    """Per metric (larger is better): band of the paired delta over shared draws, and its strict class."""
    b = bands(replicate_means(pairs, key, deltas, reps, seed), *deltas)
    return b.withColumn("verdict", ci_class(F.col("lo"), F.col("hi")))


def certified(claim: DataFrame) -> DataFrame:
    """Certified if every metric is favorable; and whether any is adverse."""
    return claim.agg(F.bool_and(F.col("verdict") == "favorable").alias("certified"), F.bool_or(F.col("verdict") == "adverse").alias("any_adverse"))


def tau_b_candidates(df: DataFrame) -> DataFrame:
    """Every distinct ``p_b`` and infinity (the second tier never answers) as ``tau_b``."""
    never = df.select(F.lit(float("inf")).alias("tau_b")).limit(1)
    return df.where("p_b is not null").select(F.col("p_b").cast("double").alias("tau_b")).distinct().unionByName(never)


def joint_grid(df: DataFrame, taus_b: tuple[float, ...] | None, prices: list[tuple[float, float]]) -> DataFrame:
    """Cost per 1,000 rows of every pair of gates at every pair of prices (c_misroute, c_human).

    A answers at ``p_max >= tau_a``, else B (paid for) at ``p_b >= tau_b``, else a human. Candidates for tau_b are
    ``taus_b``, by default every distinct ``p_b`` and infinity; for tau_a every distinct ``p_max`` and infinity (A never
    answers). Rows are counted per pair of confidences before they meet candidates and prices.
    """
    wrong = {"wrong": F.sum(1 - F.col("correct")), "wrong_b": F.sum(1 - F.col("correct_b"))}
    cells = df.groupBy("p_max", "p_b").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_b").alias("paid"), *(v.alias(k) for k, v in wrong.items()))
    taus = tau_b_candidates(df) if taus_b is None else df.sparkSession.createDataFrame([(float(x),) for x in taus_b], "tau_b double")
    sure = F.col("p_b") >= F.col("tau_b")
    sums = {"n": F.col("n"), "wrong": F.col("wrong"), "paid": F.col("paid"), "b_wrong": F.when(sure, F.col("wrong_b")).otherwise(0), "human": F.when(sure, 0).otherwise(F.col("n"))}
    # A row per candidate pair of confidences: candidates are the values of one column, not rows of the table.
    per = cells.crossJoin(taus).groupBy("tau_b", "p_max").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    down = Window.partitionBy("tau_b").orderBy(F.col("p_max").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("tau_b")
    rest = lambda c: F.sum(c).over(whole) - F.sum(c).over(down)
    g = per.select("tau_b", F.col("p_max").alias("tau_a"), F.sum("n").over(down).alias("k"), F.sum("wrong").over(down).alias("own"), rest("paid").alias("paid"), rest("b_wrong").alias("b_wrong"), rest("human").alias("human"), F.sum("n").over(whole).alias("n"))
    never = per.groupBy("tau_b").agg(*(F.sum(c).alias(c) for c in ("paid", "b_wrong", "human", "n"))).select("tau_b", F.lit(float("inf")).alias("tau_a"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("own"), "paid", "b_wrong", "human", "n")
    each = F.array(*(F.struct(F.lit(float(m)).alias("c_misroute"), F.lit(float(h)).alias("c_human")) for m, h in prices))
    priced = g.unionByName(never).withColumn("_p", F.explode(each)).select("*", "_p.*").drop("_p")
    cost = F.col("c_misroute") * (F.col("own") + F.col("b_wrong")) + F.col("paid") + F.col("c_human") * F.col("human")
    return priced.select("c_misroute", "c_human", "tau_b", "tau_a", "k", F.round(cost * 1000 / F.col("n"), 6).alias("cost_per_1k"))


def joint_thresholds(df: DataFrame, taus_b: tuple[float, ...] | None, c_misroute: float, c_human: float) -> DataFrame:
    """The cheapest pair of gates; ties go to the larger coverage of A, then of B (the smaller tau_b)."""
    return joint_grid(df, taus_b, [(c_misroute, c_human)]).orderBy("cost_per_1k", F.col("k").desc(), "tau_b").limit(1)


def joint_sensitivity(df: DataFrame, misroute: tuple[float, ...], human: tuple[float, ...], taus_b: tuple[float, ...] | None = None) -> DataFrame:
    """The cheapest pair of gates at each pair of prices."""
    g = joint_grid(df, taus_b, [(m, h) for m in misroute for h in human])
    best = F.min(F.struct("cost_per_1k", (-F.col("k")).alias("minus_k"), "tau_b", "tau_a")).alias("m")
    return g.groupBy("c_misroute", "c_human").agg(best).select("c_misroute", "c_human", "m.tau_b", "m.tau_a", (-F.col("m.minus_k")).alias("k"), "m.cost_per_1k")


def exemplars(df: DataFrame, key: str, cls: str, text: str, low: int, high: int, seed: str) -> DataFrame:
    """One row per class, drawn by hash among texts whose white-space-normalised length lies within bounds."""
    n = F.length(F.trim(F.regexp_replace(text, r"\s+", " ")))
    r = F.row_number().over(Window.partitionBy(cls).orderBy(hash_rank(seed, key), key))
    return df.where(n.between(low, high)).withColumn("_r", r).where("_r = 1").drop("_r")


def cascade_paths(df: DataFrame, tau: float) -> DataFrame:
    """The route of each row as an array of steps."""
    return df.withColumn("path", F.when(F.col("p_max") >= tau, F.array(F.lit("A"), F.lit("answered"))).otherwise(F.array(F.lit("A"), F.lit("escalated"), F.lit("B"), F.lit("answered"))))
