"""Event windows, batch or streaming, and a streaming receipts gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def hourly(events: DataFrame) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    g = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def hourly_stream(spark: SparkSession, folder: str, late: str = "2 hours") -> DataFrame:
    """The same windows over files as they arrive; state older than the watermark is dropped."""
    e = spark.readStream.schema(EVENT).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, strict: bool = False) -> DataFrame:
    """Each left row with the last right ``value`` at or before it (``strict``: before it): a union and one window."""
    from pyspark.sql.window import Window

    own = left.select("*", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    other = right.select(by, at, F.col(value).alias("_v"), F.lit(1 if strict else 0).alias("_side"))
    both = own.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_v", ignorenulls=True).over(w)
    return both.withColumn(value, found).where(F.col("_side") == (0 if strict else 1)).drop("_side", "_v")
