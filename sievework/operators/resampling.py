"""Bootstrap by hash-Poisson weights: every row draws its own weight for each replicate, so replicates are one pass.

A weight hangs on (seed, replicate, key) alone. One pass over the rows keeps sums of each replicate (as many numbers as
replicates times values, whatever the rows), partitions are added up, and nothing is exploded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Constants of the draws, modulo 2^64; 32 bits of a draw are compared with the Poisson(1) distribution.
MIX, STEP = 0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15
LIMITS = tuple(math.ceil(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(9))
_EDGES = np.array([min(x, 2**32 - 1) for x in LIMITS], np.uint64)
_CELLS = 1 << 16  # draws at a time, so that they stay in the cache
_U = np.uint64


def seed_number(seed: str) -> int:
    return int.from_bytes(hashlib.md5(seed.encode()).digest()[:8], "big")


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """Mixes ``x`` in place."""
    x ^= np.right_shift(x, _U(32), out=spare)
    x *= _U(MIX)
    x ^= np.right_shift(x, _U(29), out=spare)


#: Weights by a draw's upper 16 bits; ``_SPLIT`` where a limit lies between draws of the same upper bits.
_TOPS, _SPLIT = np.arange(1 << 16, dtype=np.int64) << 16, 255
_LEAST, _MOST = (np.searchsorted(_EDGES.astype(np.int64), _TOPS + more, "right") for more in (0, (1 << 16) - 1))
_BY_TOP = np.where(_LEAST == _MOST, _LEAST, _SPLIT).astype(np.uint8)


def weights(keys: np.ndarray, reps: int, seed: str) -> np.ndarray:
    """Poisson(1) weights, a row per key and a column per replicate."""
    own = keys.view(np.uint64) + _U(seed_number(seed))
    _mix(own, np.empty_like(own))
    draws = own[:, None] + np.arange(reps, dtype=np.uint64) * _U(STEP)
    spare = np.empty_like(draws)
    _mix(draws, spare)
    draws ^= np.right_shift(draws, _U(32), out=spare)
    draws *= _U(MIX)
    # The last step of the mixing leaves the upper bits as they are; few draws need it.
    out = _BY_TOP.take(np.right_shift(draws, _U(48), out=spare).view(np.int64), mode="wrap")
    split = np.flatnonzero(out.ravel() == _SPLIT)
    late = draws.ravel()[split]
    out.ravel()[split] = np.searchsorted(_EDGES, (late ^ (late >> _U(29))) >> _U(32), "right")
    return out.astype(np.float64)


def _summer(reps: int, seed: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), reps))
        size = max(1, _CELLS // reps)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            for k in range(0, len(keys), size):
                total += values[k : k + size].T @ weights(keys[k : k + size], reps, seed)
        yield pa.record_batch([pa.array(np.arange(reps, dtype=np.int32)), *(pa.array(total[i]) for i in range(len(names)))], names=["rep", *names])

    return run


def replicate_sums(df: DataFrame, key: str, values: dict[str, Column], reps: int, seed: str) -> DataFrame:
    """``rep, w`` and the weighted sum of each value (null: 0) in every replicate, all from the same draws.

    ``w`` is the sum of weights. Keys that aren't integers are hashed first; a null key draws as 0.
    """
    whole = F.col(key).cast("long") if isinstance(df.schema[key].dataType, IntegralType) else F.xxhash64(key)
    names = ["w", *values]
    rows = df.select(F.coalesce(whole, F.lit(0)).alias("k"), F.lit(1.0).alias("w"), *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()))
    kinds = ", ".join(f"`{n}` double" for n in names)
    parts = rows.mapInArrow(_summer(reps, seed, names), f"rep int, {kinds}")
    return parts.groupBy("rep").agg(*(F.sum(n).alias(n) for n in names))


def replicate_means(df: DataFrame, key: str, values: dict[str, Column], reps: int, seed: str) -> DataFrame:
    """Weighted mean of each value in every replicate (null where a replicate drew no row)."""
    return replicate_sums(df, key, values, reps, seed).select("rep", *(F.try_divide(F.col(k), F.col("w")).alias(k) for k in values))


def bands(replicates: DataFrame, *cols: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of each column over the replicates."""
    a = (1 - level) / 2
    got = replicates.agg(*(F.percentile(c, F.array(F.lit(a), F.lit(1 - a))).alias(c) for c in cols))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c)[0].alias("lo"), F.col(c)[1].alias("hi")) for c in cols))).alias("x")).select("x.*")


def replicate_f1(df: DataFrame, key: str, labels: list[str], reps: int, seed: str, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """``rep, accuracy, macro_f1`` from each replicate's weighted counts per class."""
    t, p = F.col(true), F.col(pred)
    values = {}
    for i, x in enumerate(labels):
        values |= {f"s{i}": (t == x).cast("int"), f"p{i}": (p == x).cast("int"), f"h{i}": ((t == x) & (p == x)).cast("int")}
    sums = replicate_sums(df, key, values, reps, seed)
    f1 = [F.coalesce(F.try_divide(2 * F.col(f"h{i}"), F.col(f"s{i}") + F.col(f"p{i}")), F.lit(0.0)) for i in range(len(labels))]
    hits, macro = sum((F.col(f"h{i}") for i in range(len(labels))), F.lit(0.0)), sum(f1, F.lit(0.0)) / len(labels)
    return sums.select("rep", F.try_divide(hits, F.col("w")).alias("accuracy"), macro.alias("macro_f1"))
