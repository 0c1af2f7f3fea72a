"""Selection, global ranks and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.session import stored


def hash_rank(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def quotas(counts: DataFrame, stratum: str, n: str, target: int) -> DataFrame:
    """Largest-remainder quotas in exact integers, one row per stratum (strata are few, so one task orders them)."""
    everything = Window.partitionBy()
    c = counts.select(stratum, F.col(n).alias("n"), F.sum(n).over(everything).alias("total"))
    c = c.withColumn("base", (F.col("n") * target).cast("long") - (F.col("n") * target) % F.col("total"))
    c = c.withColumn("base", F.expr("base div total")).withColumn("rest", (F.col("n") * target) % F.col("total"))
    left = F.lit(target) - F.sum("base").over(everything)
    place = F.row_number().over(Window.orderBy(F.col("rest").desc(), stratum))
    extra = F.when(place <= left, 1).otherwise(0)
    return c.select(stratum, "n", F.when(F.col("total") <= target, F.col("n")).otherwise(F.col("base") + extra).cast("long").alias("quota"))


def stratified_sample(df: DataFrame, key: str, stratum: str, target: int, seed: str) -> DataFrame:
    """The first rows of each stratum by (hash of seed and key, key), as many as its quota: nested for growing targets."""
    q = quotas(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), stratum, "n", target).select(stratum, "quota")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_rank(seed, key), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= target).join(q, stratum).where(F.col("_rank") <= F.col("quota")).drop("_rank", "quota")


def latest(df: DataFrame, group: str, order: str, tie: str) -> DataFrame:
    """The newest row of each group, with the count of rows that share its place."""
    return df.groupBy(group).agg(F.max(F.struct(order, tie)).alias("m")).select(group, f"m.{order}", f"m.{tie}")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds ``rank`` (from 1) and running sums over the whole frame without a one-task window.

    Rows are dealt by ranges of the order; each range numbers and sums its own rows, and the ranges' totals (one row
    per partition) give the offsets. The ranges are written first, so their numbers hold when tasks are lost. Ties
    that the order doesn't break are split between ranges as Spark deals them, so the order should end in a key.
    """
    dealt = stored(df.withColumns(sums).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(k).alias(f"_t_{k}") for k in sums))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    offsets = totals.select("_part", before("_n").alias("_n"), *(before(f"_t_{k}").alias(f"_t_{k}") for k in sums))
    own = Window.partitionBy("_part").orderBy(*order)
    here = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({"_own": F.row_number().over(own)} | {k: F.sum(k).over(here) for k in sums})
    whole = {"rank": F.col("_own") + F.col("_n")} | {k: F.col(k) + F.col(f"_t_{k}") for k in sums}
    return rows.join(F.broadcast(offsets), "_part").withColumns(whole).drop("_part", "_own", "_n", *(f"_t_{k}" for k in sums))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank`` (from 1) over the whole frame."""
    return running(df, list(order), {})


def prefix_sums(df: DataFrame, value: str, sums: dict[str, Column]) -> DataFrame:
    """Per distinct value, descending: each sum over all rows at or above it (ties together)."""
    per = df.groupBy(value).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    return running(per, [F.col(value).desc()], {k: F.col(k) for k in sums}).select(value, *sums)


def evenly_spaced(n: int, most: int) -> list[int]:
    """At most ``most`` of the places 0..n-1, evenly spaced, ends included (half to even, as numpy rounds)."""
    if n <= most:
        return list(range(n))
    return sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})
