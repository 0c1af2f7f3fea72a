"""Split frames: writing, loading, subsampling, curated draws, exports, and the tables of a datasheet."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework import gates
from sievework.operators.ranking import hash_rank
from sievework.session import written


def load_config(path: str | Path) -> dict:
    """A run's configuration; ``model.runner`` and ``data.split`` must be there."""
    doc = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    for part, name in (("model", "runner"), ("data", "split")):
        if not isinstance(doc, dict) or not isinstance(doc.get(part), dict) or not doc[part].get(name):
            raise ValueError(f"the configuration lacks {part}.{name}")
    return doc


def write_split(df: DataFrame, path: str, name: str, key: str, label: str) -> dict:
    """Writes a split and returns its statistics: rows, key range, rows a class, and an order-free hash of its rows."""
    gates.unique_key(df, key)
    gates.no_nulls(df, key, label)
    got = written(df, path)
    n, digest = gates.content_hash(got)
    low, high = got.agg(F.min(key), F.max(key)).first()
    classes = {r[0]: r.n for r in got.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"split": name, "n": n, "rows_hash": digest, "low": low, "high": high, "classes": dict(sorted(classes.items()))}


def verify_split(spark: SparkSession, path: str, stats: dict) -> DataFrame:
    """The split at ``path``, if it still is what its statistics say."""
    df = spark.read.parquet(path)
    n, digest = gates.content_hash(df)
    if (n, digest) != (stats["n"], stats["rows_hash"]):
        raise gates.GateError(f"split {stats['split']} has changed: {n} rows, hash {digest}, stated {stats['n']} and {stats['rows_hash']}")
    return df


def dataset_info(stats: list[dict], split: str) -> dict:
    found = [s for s in stats if s["split"] == split]
    if len(found) != 1:
        raise KeyError(f"{len(found)} statistics of split {split!r}")
    return found[0]


def load_split(spark: SparkSession, path: str, key: str, text: str, label: str) -> DataFrame:
    """``id, text, y_true``: only these columns are read; a null text is empty."""
    return spark.read.parquet(path).select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).alias("y_true"))


def load_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col(key).alias("id"))


def subsample(df: DataFrame, key: str, cap: int | None, seed: str) -> DataFrame:
    """The first ``cap`` rows by (hash of seed and key, key): a smaller cap's rows are among a larger one's."""
    if cap is None:
        return df
    if cap < 1:
        raise ValueError(f"a cap is at least 1: {cap}")
    return df.withColumn("_h", hash_rank(seed, key)).orderBy("_h", key).limit(cap).drop("_h")


def lookup(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of wanted keys; one that is missing raises."""
    return gates.restrict(df, wanted, key)


def shared(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Both frames on their common keys, and how many rows each loses; nothing in common raises."""
    x, y = a.join(b.select(key), key, "left_semi"), b.join(a.select(key), key, "left_semi")
    if x.isEmpty():
        raise gates.GateError(f"no {key} in common")
    return x, y, a.join(b.select(key), key, "left_anti").count(), b.join(a.select(key), key, "left_anti").count()


def allocation(counts: dict[str, int], n: int) -> dict[str, int]:
    """Shares of ``n`` over classes: largest remainders, at least one a class, at most what it has."""
    if any(c < 1 for c in counts.values()) or not len(counts) <= n <= sum(counts.values()):
        raise ValueError(f"{n} rows can't be drawn from {counts} with one a class")
    total = sum(counts.values())
    out = {k: min(c, max(1, n * c // total)) for k, c in counts.items()}
    # What is still due goes to the class that is furthest below its exact share; what is too much comes from the one furthest above.
    gap = lambda k: n * counts[k] - out[k] * total
    while (left := n - sum(out.values())) != 0:
        if left > 0:
            k = min((k for k in out if out[k] < counts[k]), key=lambda k: (-gap(k), k))
            out[k] += 1
        else:
            k = min((k for k in out if out[k] > 1), key=lambda k: (gap(k), k))
            out[k] -= 1
    return out


def curated(df: DataFrame, key: str, label: str, n: int, seed: str) -> DataFrame:
    """``n`` rows with every class among them, drawn by hash within each class."""
    counts = {r[0]: r.n for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = F.create_map(*(F.lit(x) for k, v in sorted(allocation(counts, n).items()) for x in (k, v)))
    r = F.row_number().over(Window.partitionBy(label).orderBy(hash_rank(seed, key), key))
    most = max(allocation(counts, n).values())
    return df.withColumn("_r", r).where((F.col("_r") <= most) & (F.col("_r") <= F.element_at(quota, F.col(label)))).drop("_r")


def dedup_map(clusters: DataFrame, key: str) -> DataFrame:
    """Removed rows and the row that stands for each: ``removed_id, kept_id``."""
    return clusters.where("not kept").select(F.col(key).alias("removed_id"), F.col("cluster_id").alias("kept_id"))


def export(df: DataFrame, path: str, key: str, text: str, label: str) -> dict:
    """JSON lines of id, text and label for a trainer, with row counts a class."""
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).alias("label"))
    rows.write.json(path)
    classes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"n": sum(classes.values()), "classes": dict(sorted(classes.items()))}


def truncation_rate(df: DataFrame, n_tokens: str, most: int) -> DataFrame:
    """``n, rate``: the share of rows of more than ``most`` tokens."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.col(n_tokens) > most).cast("int")), F.lit(0.0)).alias("rate"))


# ---- datasheet -----------------------------------------------------------------------------------------------------

def markdown(head: list[str], rows: list[list]) -> str:
    """A table; numbers get thousands separators and stand right."""
    cell = lambda x: f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else "" if x is None else str(x)
    right = [all(isinstance(r[i], int) for r in rows) and bool(rows) for i in range(len(head))]
    lines = [head, ["--:" if r else "---" for r in right], *([cell(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def class_year_table(counts: DataFrame) -> str:
    """``class, year, n`` (a few rows) as a table with a column a year and totals."""
    rows = [r.asDict() for r in counts.collect()]
    years, classes = sorted({r["year"] for r in rows}), sorted({r["class"] for r in rows})
    n = {(r["class"], r["year"]): r["n"] for r in rows}
    body = [[c, *(n.get((c, y), 0) for y in years), sum(n.get((c, y), 0) for y in years)] for c in classes]
    total = ["all", *(sum(n.get((c, y), 0) for c in classes) for y in years), sum(n.values())]
    return markdown(["class", *map(str, years), "all"], [*body, total])


def split_table(stats: list[dict]) -> str:
    return markdown(["split", "rows", "first", "last", "hash"], [[s["split"], s["n"], str(s["low"]), str(s["high"]), f"{s['rows_hash'] & 0xFFFFFFFFFFFFFFFF:016x}"] for s in stats])


def datasheet(title: str, counts: DataFrame, stats: list[dict], dedup: dict[str, int]) -> str:
    """A short datasheet: what was read, what duplicates cost, how classes and splits lie."""
    if dedup["kept"] + dedup["removed"] != dedup["read"]:
        raise gates.GateError(f"rows don't add up: {dedup}")
    share = 100 * dedup["removed"] / dedup["read"] if dedup["read"] else 0.0
    return f"# {title}\n\n{dedup['read']:,} rows, {dedup['removed']:,} near-copies removed ({share:.2f} %), {dedup['kept']:,} kept.\n\n## Classes by year\n\n{class_year_table(counts)}\n## Splits\n\n{split_table(stats)}"
