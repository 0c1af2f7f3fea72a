"""Gates: checks that raise with a sample of offenders instead of letting a join lose or double rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import stored


class GateError(ValueError):
    """A check on data failed; the message names some offenders."""


def offenders(df: DataFrame, key: str, k: int = 5) -> tuple[int, list]:
    """Count and the smallest ``k`` keys: one aggregation and one top-k, never the whole set."""
    n = df.count()
    return n, [r[0] for r in df.select(key).orderBy(key).limit(k).collect()] if n else []


def _fail(what: str, df: DataFrame, key: str) -> None:
    n, sample = offenders(df, key)
    if n:
        raise GateError(f"{n} {what}: {', '.join(map(str, sample))}{', ...' if n > len(sample) else ''}")


def unique_key(df: DataFrame, key: str) -> None:
    _fail(f"repeated {key}", df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), key)


def no_nulls(df: DataFrame, *cols: str) -> None:
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols)).first()
    bad = {c: counts[c] for c in cols if counts[c]}
    if bad:
        raise GateError(f"nulls: {bad}")


def covers(wanted: DataFrame, held: DataFrame, key: str) -> None:
    """Every key of ``wanted`` is in ``held``."""
    _fail(f"missing {key}", wanted.select(key).distinct().join(held.select(key), key, "left_anti"), key)


def same_ids(a: DataFrame, b: DataFrame, key: str) -> None:
    covers(a, b, key)
    covers(b, a, key)


def equal_values(a: DataFrame, b: DataFrame, key: str, col: str) -> None:
    """Rows of the same key agree in ``col`` (nulls are equal)."""
    both = a.select(key, F.col(col).alias("_a")).join(b.select(key, F.col(col).alias("_b")), key)
    _fail(f"{key} with different {col}", both.where(~F.col("_a").eqNullSafe(F.col("_b"))), key)


def in_domain(df: DataFrame, key: str, col: str, labels: list[str]) -> None:
    _fail(f"unknown {col}", df.where(~F.coalesce(F.col(col).isin(labels), F.lit(False))), key)


def holds(df: DataFrame, key: str, condition: Column, what: str) -> None:
    _fail(what, df.where(~F.coalesce(condition, F.lit(False))), key)


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``ids``, exactly one each: repeated or missing keys raise."""
    unique_key(df, key)
    unique_key(ids, key)
    covers(ids, df, key)
    return df.join(ids.select(key), key, "left_semi")


def aligned(a: DataFrame, b: DataFrame, key: str, truth: str) -> DataFrame:
    """A 1:1 join of two prediction frames whose truths agree; columns of ``b`` other than those get ``_b``.

    Ids and truths are checked in the pass of the join, which is stored; only where it finds something are they looked
    for again, to be named.
    """
    for x in (a, b):
        unique_key(x, key)
    rest = [F.col(c).alias(f"{c}_b") for c in b.columns if c not in (key, truth)]
    right = b.select(F.col(key).alias("_key"), F.col(truth).alias("_truth"), F.lit(True).alias("_there"), *rest)
    both = stored(a.withColumn("_here", F.lit(True)).join(right, F.col(key) == F.col("_key"), "full_outer"), "aligned")
    if not both.where(F.col("_here").isNull() | F.col("_there").isNull() | ~F.col(truth).eqNullSafe(F.col("_truth"))).isEmpty():
        same_ids(a, b, key)
        equal_values(a, b, key, truth)
    return both.drop("_key", "_truth", "_here", "_there")


def content_hash(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free 64-bit hash of the rows: equal whatever the partitioning."""
    row = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in sorted(df.columns)))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x")).first()
    return r.n, r.x or 0
