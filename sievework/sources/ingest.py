"""Sources and sinks: frozen snapshots, CSV with counted rejects, receipts, prediction artifacts and run records."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.gates import GateError, unique_key

# The CSV's columns in order, and the names and types of those that are kept.
RAW = ("Date received", "Product", "Sub-product", "Issue", "Sub-issue", "Consumer complaint narrative", "Company public response", "Company", "State", "ZIP code", "Tags", "Submitted via", "Date sent to company", "Company response to consumer", "Timely response?", "Complaint ID")
KEPT = {"complaint_id": ("Complaint ID", "bigint"), "date_received": ("Date received", "date"), "product": ("Product", "string"), "sub_product": ("Sub-product", "string"), "issue": ("Issue", "string"), "company": ("Company", "string"), "state": ("State", "string"), "narrative": ("Consumer complaint narrative", "string")}
RECEIPT = "complaint_id long, slug string, provider string, prompt_tokens long, completion_tokens long, total_tokens long, computed_cost_usd double, openrouter_cost_usd double, latency_ms double, finish_reason string, content string, retries long, parse_failed boolean"


def sha256_file(path: str | Path, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def freeze(path: str | Path, manifest: str | Path, url: str, day: str) -> dict:
    """Writes a manifest once; an existing one is never replaced."""
    p = Path(path)
    out = {"url": url, "filename": p.name, "download_date": day, "sha256": sha256_file(p), "size_bytes": p.stat().st_size}
    with open(manifest, "x", encoding="utf-8") as f:
        yaml.safe_dump(out, f, sort_keys=False)
    return out


def verify(path: str | Path, manifest: str | Path) -> dict:
    m = yaml.safe_load(Path(manifest).read_text(encoding="utf-8"))
    p = Path(path)
    if not p.exists():
        raise GateError(f"snapshot is missing: {p}")
    if p.stat().st_size != m["size_bytes"]:
        raise GateError(f"size is {p.stat().st_size}, the manifest says {m['size_bytes']}")
    if (got := sha256_file(p)) != m["sha256"]:
        raise GateError(f"sha256 is {got}, the manifest says {m['sha256']}")
    return m


def extracted(archive: str | Path, csv: str | Path) -> Path:
    """The one CSV member of a zip, unpacked unless it is there."""
    out = Path(csv)
    if out.exists():
        return out
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".csv")]
        if len(names) != 1:
            raise GateError(f"{len(names)} CSV members in {archive}")
        part = out.with_suffix(".part")
        with z.open(names[0]) as src, open(part, "wb") as dst:
            while block := src.read(1 << 20):
                dst.write(block)
        part.rename(out)
    return out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; rows that don't parse stay, in ``_corrupt``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*RAW, "_corrupt")])
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", nullValue="", emptyValue="").csv(path)


def narratives(raw: DataFrame) -> DataFrame:
    """Typed rows with an id, a date and a text; what doesn't cast is null."""
    good = raw.where(F.col("_corrupt").isNull()) if "_corrupt" in raw.columns else raw
    typed = good.select(*(F.col(f"`{c}`").try_cast(t).alias(k) for k, (c, t) in KEPT.items()))
    return typed.where(F.col("complaint_id").isNotNull() & F.col("date_received").isNotNull() & (F.length(F.trim("narrative")) > 0))


def ingest_counts(raw: DataFrame) -> dict:
    """Parsed, corrupt, uncast and kept rows in one pass."""
    cast = [F.col(f"`{KEPT[k][0]}`").try_cast(KEPT[k][1]) for k in ("complaint_id", "date_received")]
    ok = F.col("_corrupt").isNull()
    r = raw.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("corrupt"),
        F.count_if(ok & (cast[0].isNull() | cast[1].isNull())).alias("bad_key"),
        F.count_if(ok & cast[0].isNotNull() & cast[1].isNotNull() & (F.length(F.trim(F.col(f"`{KEPT['narrative'][0]}`"))) > 0)).alias("kept"),
    ).first()
    return r.asDict()


def load_taxonomy(path: str | Path) -> tuple[dict[str, str], list[str]]:
    """(product to class, dropped products) of a YAML file; repeated, empty or contradictory entries raise."""
    doc = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    out: dict[str, str] = {}
    for cls, products in doc["classes"].items():
        if not products:
            raise GateError(f"class without products: {cls}")
        for p in products:
            if p in out:
                raise GateError(f"product in two classes: {p}")
            out[p] = cls
    dropped = [x["product"] for x in doc.get("dropped_products") or []]
    if both := sorted(set(dropped) & set(out)):
        raise GateError(f"mapped and dropped: {both}")
    return out, dropped


def read_receipts(spark: SparkSession, path: str, slug: str, prompt_rate: float, completion_rate: float, tol: float = 1e-12) -> DataFrame:
    """Receipts by id; rows that break a rule raise with their ids, by reason."""
    r = spark.read.schema(RECEIPT).json(path)
    cost = F.col("prompt_tokens") * prompt_rate + F.col("completion_tokens") * completion_rate
    bad = (
        F.when(F.col("complaint_id").isNull(), "no id")
        .when(~F.coalesce((F.col("prompt_tokens") > 0) & (F.col("completion_tokens") > 0), F.lit(False)), "token counts")
        .when(~F.col("total_tokens").eqNullSafe(F.col("prompt_tokens") + F.col("completion_tokens")), "token total")
        .when(~F.col("slug").eqNullSafe(slug), "model")
        .when(~F.coalesce(F.abs(F.col("computed_cost_usd") - cost) <= tol, F.lit(False)), "cost")
    )
    found = r.withColumn("reason", bad).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("complaint_id").alias("first")).orderBy("reason").collect()
    if found:
        raise GateError("; ".join(f"{x.reason}: {x.n} rows, first {x.first}" for x in found))
    unique_key(r, "complaint_id")
    return r


def write_predictions(df: DataFrame, path: str, labels: list[str], provenance: dict) -> None:
    """``complaint_id, y_true, y_pred, p_max`` and a column per label; provenance goes into the schema's metadata."""
    cols = [F.col("complaint_id"), F.col("y_true"), F.col("y_pred"), F.array_max("probs").alias("p_max", metadata={"provenance": json.dumps(provenance, sort_keys=True), "labels": labels})]
    df.select(*cols, *(F.col("probs")[i].alias(f"prob::{x}") for i, x in enumerate(labels))).write.parquet(path)


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], dict]:
    df = spark.read.parquet(path)
    meta = df.schema["p_max"].metadata
    labels = list(meta["labels"])
    probs = F.array(*(F.col(f"`prob::{x}`") for x in labels)).alias("probs")
    return df.select("complaint_id", "y_true", "y_pred", "p_max", probs), labels, json.loads(meta["provenance"])


def append_record(path: str | Path, record: dict) -> None:
    """One compact line with sorted keys; earlier lines are never rewritten."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True, separators=(",", ":")) + "\n")


def load_records(path: str | Path) -> list[dict]:
    return [json.loads(x) for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()]


def resolve_records(records: list[dict]) -> dict[tuple[str, str], dict]:
    """The newest record of each (config, split) after dropping superseded ones; an unresolved tie raises."""
    gone: set[str] = set()
    for r in records:
        s = r.get("supersedes") or (r.get("extra") or {}).get("supersedes") or []
        gone |= {s} if isinstance(s, str) else set(s)
    out: dict[tuple[str, str], dict] = {}
    for r in sorted((r for r in records if r["run_id"] not in gone), key=lambda r: r["timestamp_utc"]):
        k = (r["config_path"], r["dataset"]["split"])
        if k in out and out[k]["timestamp_utc"] == r["timestamp_utc"]:
            raise GateError(f"two newest records of {k}")
        out[k] = r
    return out


def write_json(obj: dict, path: str | Path) -> Path:
    p = Path(path)
    p.write_text(json.dumps(obj, sort_keys=True, indent=2) + "\n", encoding="utf-8")
    return p
