"""Taxonomy mapping, date-range splits and their checks."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapped(df: DataFrame, col: str, taxonomy: dict[str, str], name: str) -> DataFrame:
    """Adds the class of ``col``, null where the taxonomy has none (a literal map: no join)."""
    m = F.create_map(*map(F.lit, chain.from_iterable(sorted(taxonomy.items()))))
    return df.withColumn(name, F.try_element_at(m, F.col(col)))


def uncovered(df: DataFrame, col: str, taxonomy: dict[str, str], dropped: tuple[str, ...] = ()) -> DataFrame:
    """Observed values that are neither mapped nor dropped."""
    return df.select(col).distinct().where(~F.col(col).isin(*taxonomy, *dropped))


def class_year(df: DataFrame, cls: str, date: str) -> DataFrame:
    """Counts of every class in every observed year, zeros included."""
    got = df.groupBy(F.col(cls).alias("class"), F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    years = sorted(r.year for r in got.select("year").distinct().collect())  # years of the data: a few dozen
    every = got.select("class").distinct().withColumn("year", F.explode(F.array(*map(F.lit, years))))
    return every.join(got, ["class", "year"], "left").na.fill(0, ["n"])


def assigned(df: DataFrame, date: str, ranges) -> DataFrame:
    """A row per split that a date falls in: inclusive bounds, open end allowed."""
    day = F.to_date(date)
    hits = [F.when((day >= F.lit(lo).cast("date")) & (F.lit(True) if hi is None else day <= F.lit(hi).cast("date")), F.lit(name)) for name, lo, hi in ranges]
    return df.withColumn("split", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def overlaps(df: DataFrame, key: str) -> DataFrame:
    """Rows shared by each pair of splits: a key's splits are gathered (at most one each), pairs come from there."""
    per = df.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("n"))
