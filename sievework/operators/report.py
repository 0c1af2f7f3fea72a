"""Rows of reports: arms over time, seeds, perturbation grids, and the run of a configuration."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import gates
from sievework.functions.stats import mcnemar_p
from sievework.operators import models, resampling, routing, verify
from sievework.sources import frames, ingest


def arm_stats(policies: DataFrame, labels: list[str]) -> DataFrame:
    """Eight numbers of each policy: who answers, how right the answers and the system are, and what goes wrong."""
    human = F.col("to_human")
    rates = policies.groupBy("policy").agg(
        F.avg((~human).cast("int")).alias("machine_share"), F.avg(human.cast("int")).alias("human_share"), F.avg((~human & (F.col("correct") == 0)).cast("int")).alias("misroute_rate"),
        F.avg((F.col("api") > 0).cast("int")).alias("paid_share"), F.avg(F.when(~human, F.col("correct"))).alias("answered_accuracy"), F.avg(F.when(human, 1).otherwise(F.col("correct"))).alias("system_accuracy"),
    )
    return rates.join(routing.macro_f1(policies, labels, False), "policy", "left").join(routing.macro_f1(policies, labels, True), "policy")


def arm_replicates(policies: DataFrame, name: str, reps: int, seed: str) -> DataFrame:
    """Replicates of a policy's human share, misroute rate, and accuracies of answered rows and of the system."""
    rows, human = policies.where(F.col("policy") == name), F.col("to_human")
    r = resampling.replicate_sums(rows, "id", {"h": human.cast("int"), "ok": F.when(human, 0).otherwise(F.col("correct")), "bad": (~human & (F.col("correct") == 0)).cast("int")}, reps, seed)
    return r.select("rep", F.try_divide("h", "w").alias("human_share"), F.try_divide("bad", "w").alias("misroute_rate"), F.try_divide("ok", F.col("w") - F.col("h")).alias("answered_accuracy"), F.try_divide(F.col("ok") + F.col("h"), F.col("w")).alias("system_accuracy"))


def series(slices: dict[str, DataFrame], labels: list[str]) -> DataFrame:
    """Arm numbers of the same policies over several slices: a row per slice and policy."""
    out = None
    for name, policies in slices.items():
        rows = arm_stats(policies, labels).withColumn("slice", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def support_kind(n: int, n_split: int) -> str:
    return "full_slice" if n == n_split else "uniform_random_subsample_n"


def seed_spread(rows: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean, sample deviation and range of each metric over seeds."""
    v = F.col(value)
    return rows.groupBy(metric).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"))


def arms_compared(a: DataFrame, b: DataFrame, key: str) -> dict:
    """Two systems on the same rows: accuracies, agreement and McNemar's test."""
    j = gates.aligned(a.select(key, "y_true", "y_pred"), b.select(key, "y_true", "y_pred"), key, "y_true")
    x, y = F.col("y_pred") == F.col("y_true"), F.col("y_pred_b") == F.col("y_true")
    r = j.agg(F.count(F.lit(1)).alias("n"), F.avg(x.cast("int")).alias("accuracy_a"), F.avg(y.cast("int")).alias("accuracy_b"), F.avg((F.col("y_pred") == F.col("y_pred_b")).cast("int")).alias("agreement"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c")).first()
    return {**r.asDict(), "p": mcnemar_p(r.b, r.c)}


def id_hash(df: DataFrame, key: str) -> tuple[int, int]:
    """Count and order-free hash of a frame's ids: two frames hold the same ids where these are the same."""
    return gates.content_hash(df.select(key))


# ---- perturbation grid ----------------------------------------------------------------------------------------------

def pair_row(clean: DataFrame, changed: DataFrame, key: str, labels: list[str], expected: int | None = None, subset: bool = False) -> DataFrame:
    """``metric, clean, perturbed, delta`` over the pairs of rows; ids must be the same, or ``changed`` a subset."""
    if subset:
        clean = gates.restrict(clean, changed, key)
    gates.same_ids(clean, changed, key)
    gates.equal_values(clean, changed, key, "y_true")
    n = changed.count()
    if expected is not None and n != expected:
        raise gates.GateError(f"{n} pairs, expected {expected}")
    x, y = (verify.point_metrics(d, labels, key).withColumnRenamed("value", c) for d, c in ((clean, "clean"), (changed, "perturbed")))
    return x.join(y, "metric").withColumn("delta", F.col("perturbed") - F.col("clean"))


def grid(arms: dict[str, bool], families: dict[str, tuple[float, ...]], found: set[tuple[str, str, float]]) -> list[dict]:
    """Every arm x family x rate with its state: done, missing, or skipped (an optional arm's absent run)."""
    rows = [{"arm": a, "family": f, "rate": r, "state": "done" if (a, f, r) in found else "skipped" if optional else "missing"} for a, optional in arms.items() for f, rates in families.items() for r in rates]
    if extra := sorted(found - {(r["arm"], r["family"], r["rate"]) for r in rows}):
        raise gates.GateError(f"runs outside the grid: {extra}")
    return rows


# ---- runs -----------------------------------------------------------------------------------------------------------

def run(spark: SparkSession, config_path: str | Path, splits: Callable[[str], tuple[DataFrame, DataFrame, dict]], results: str | Path | None = None, preds: str | Path | None = None) -> dict:
    """Configuration, runner, metrics, record: appends the record and writes predictions where paths are given.

    ``splits(name)`` gives (training rows, rows to score, statistics) of a split; the runner must return a row for each
    row to score, with known labels.
    """
    config = frames.load_config(config_path)
    train, test, stats = splits(config["data"]["split"])
    began = time.time()
    options = {k: v for k, v in config["model"].items() if k != "runner"}
    got = models.run(config["model"]["runner"], train, test, **options)
    gates.unique_key(got, "id")
    gates.same_ids(test, got, "id")
    labels = sorted(r[0] for r in train.select("y_true").distinct().collect())
    gates.in_domain(got, "id", "y_true", labels)
    found = {r.metric: r.value for r in verify.point_metrics(got, labels, "id").collect()}
    stamp = datetime.now(timezone.utc).isoformat(timespec="microseconds")
    name = Path(config_path).stem
    record = {"run_id": f"{name}-{stamp}", "config_path": str(config_path), "timestamp_utc": stamp, "dataset": {"split": stats["split"], "rows_hash": stats["rows_hash"], "n": stats["n"]}, "labels": labels, "metrics": found, "seconds": round(time.time() - began, 3)}
    if preds is not None:
        path = str(Path(preds) / record["run_id"])
        ingest.write_predictions(got.withColumnRenamed("id", "complaint_id"), path, labels, {"run_id": record["run_id"], "split": stats["split"]})
        record["predictions"] = path
    if results is not None:
        ingest.append_record(results, record)
    return record


def latest(records: list[dict], config_path: str) -> tuple[dict, list[dict]]:
    """The newest record of a configuration, and those that it supersedes; none raises."""
    mine = sorted((r for r in records if r["config_path"] == config_path), key=lambda r: r["timestamp_utc"])
    if not mine:
        raise KeyError(f"no run of {config_path}")
    return mine[-1], mine[:-1]


def by_config(records: list[dict]) -> dict[str, dict]:
    """Records by configuration; two of one raise."""
    names = [r["config_path"] for r in records]
    if again := sorted({n for n in names if names.count(n) > 1}):
        raise gates.GateError(f"several records of {again}")
    return dict(zip(names, records, strict=True))


def compared_state(before: dict[str, str], after: dict[str, str]) -> list[dict]:
    """Paths of two snapshots (path to hash) and what became of each: same, changed, deleted or new."""
    state = lambda p: "new" if p not in before else "deleted" if p not in after else "same" if before[p] == after[p] else "changed"
    return [{"path": p, "state": state(p)} for p in sorted(set(before) | set(after))]
