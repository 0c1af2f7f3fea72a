"""Costs, thresholds and routing policies: a prediction frame with ``p_max``, ``correct`` and an escalation arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.ranking import prefix_sums


def components(correct: Column, api: Column, to_human: Column, c_misroute: float, c_human: float) -> dict[str, Column]:
    """A row sent to a human pays for that and for API calls already made, but is never misrouted."""
    return {
        "misroute": F.when(~to_human & (correct == 0), c_misroute).otherwise(0.0),
        "api": api.cast("double"),
        "human": F.when(to_human, c_human).otherwise(0.0),
    }


def threshold_table(df: DataFrame) -> DataFrame:
    """Per distinct confidence: what a threshold there covers and how right it is."""
    n = df.agg(F.count(F.lit(1))).scalar()
    p = prefix_sums(df, "p_max", {"n_covered": F.lit(1), "right": F.col("correct")})
    acc = F.col("right") / F.col("n_covered")
    return p.select(F.col("p_max").alias("tau"), "n_covered", (F.col("n_covered") / n).alias("coverage"), acc.alias("accuracy"), (1 - acc).alias("risk"))


def grid(df: DataFrame, arm: dict[str, Column]) -> DataFrame:
    """A row per threshold (rows with p_max >= tau are answered, the rest take the arm), and one above all (tau infinite).

    ``arm``: ``correct`` (0/1), ``api`` (cost) and ``to_human`` (0/1) of the escalation of each row.
    """
    sums = {"k": F.lit(1), "right": F.col("correct"), "arm_right": arm["correct"] * (1 - arm["to_human"]), "arm_human": arm["to_human"], "arm_api": arm["api"]}
    total = df.agg(*(F.sum(c).alias(f"t_{k}") for k, c in sums.items()))
    pre = prefix_sums(df, "p_max", sums).withColumnRenamed("p_max", "tau")
    zero = total.select(F.lit(float("inf")).alias("tau"), F.lit(0).alias("k"), F.lit(0).alias("right"), F.lit(0).alias("arm_right"), F.lit(0).alias("arm_human"), F.lit(0.0).alias("arm_api"))
    t = {k: total.select(f"t_{k}").scalar() for k in sums}
    rows = pre.unionByName(zero)
    return rows.select("tau", "k", (F.col("k") - F.col("right")).alias("wrong"), (t["k"] - F.col("k")).alias("escalated"), (t["arm_human"] - F.col("arm_human")).alias("to_human"), (t["arm_api"] - F.col("arm_api")).alias("api"), (t["arm_right"] - F.col("arm_right")).alias("arm_right"), t["k"].alias("n"))


def sweep(g: DataFrame, c_misroute: Column | float, c_human: Column | float) -> DataFrame:
    """Cost per 1,000 rows at every threshold."""
    arm_wrong = F.col("escalated") - F.col("to_human") - F.col("arm_right")
    cost = (c_misroute * (F.col("wrong") + arm_wrong) + F.col("api") + c_human * F.col("to_human")) * 1000 / F.col("n")
    return g.withColumn("coverage", F.col("k") / F.col("n")).withColumn("cost_per_1k", cost)


def cheapest(swept: DataFrame, *by: str) -> DataFrame:
    """The cheapest threshold; ties go to the larger coverage."""
    order = [F.col("cost_per_1k").asc(), F.col("k").desc()]
    if by:
        return swept.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
    return swept.orderBy(*order).limit(1)


def sensitivity(g: DataFrame, misroute: tuple[float, ...], human: tuple[float, ...]) -> DataFrame:
    """The cheapest threshold at each pair of prices; the grid has a row per distinct confidence, prices are a literal."""
    prices = F.array(*(F.struct(F.lit(float(m)).alias("c_misroute"), F.lit(float(h)).alias("c_human")) for m in misroute for h in human))
    every = g.withColumn("_p", F.explode(prices)).select("*", "_p.*").drop("_p")
    return cheapest(sweep(every, F.col("c_misroute"), F.col("c_human")), "c_misroute", "c_human")


def evaluate(policies: DataFrame, c_misroute: float, c_human: float) -> DataFrame:
    """Per policy: cost per 1,000 rows by component, share of humans, accuracy of answered rows and of the system."""
    c = components(F.col("correct"), F.col("api"), F.col("to_human"), c_misroute, c_human)
    rows = policies.select("policy", "correct", "to_human", *(v.alias(f"c_{k}") for k, v in c.items()))
    return rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(f"c_{k}").alias(k) for k in c),
        F.avg(F.col("to_human").cast("int")).alias("human_share"),
        F.avg(F.when(~F.col("to_human"), F.col("correct"))).alias("answered_accuracy"),
        F.avg(F.when(F.col("to_human"), 1).otherwise(F.col("correct"))).alias("system_accuracy"),
    )
