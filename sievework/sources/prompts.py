"""The data side of a language-model runner: schema, prompt bundle, completions and receipts. Calls are not made here."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import gates
from sievework.functions.text import parse_label

#: Files of a prompt bundle.
BUNDLE = ("system.txt", "user.txt", "exemplars.jsonl")
COMPLETION = """id string, model string, provider string,
choices array<struct<finish_reason: string, message: struct<content: string>>>,
usage struct<prompt_tokens: long, completion_tokens: long, total_tokens: long, cost: double>"""


def response_schema(labels: list[str]) -> dict:
    """A strict JSON schema: an object with one label of the list and nothing else."""
    if not labels or len(set(labels)) < len(labels):
        raise ValueError("labels are distinct and at least one")
    label = {"type": "string", "enum": list(labels)}
    return {"type": "object", "properties": {"label": label}, "required": ["label"], "additionalProperties": False}


@dataclass(frozen=True)
class Bundle:
    system: str
    user: str
    exemplars: tuple[tuple[str, str], ...]  # (text, label)
    files: dict[str, str]  # name to sha256

    @property
    def sha256(self) -> str:
        lines = "".join(f"{n}:{h}\n" for n, h in sorted(self.files.items()))
        return hashlib.sha256(lines.encode()).hexdigest()


def load_bundle(folder: str | Path, labels: list[str], frozen: str | None = None) -> Bundle:
    """Reads and hashes a prompt bundle; unknown labels, and a hash other than the frozen one, raise."""
    raw = {n: (Path(folder) / n).read_bytes() for n in BUNDLE}
    shots = tuple((x["text"], x["label"]) for x in map(json.loads, raw["exemplars.jsonl"].decode("utf-8").splitlines()) if x)
    if bad := sorted({label for _, label in shots} - set(labels)):
        raise gates.GateError(f"exemplars with unknown labels: {bad}")
    out = Bundle(raw["system.txt"].decode("utf-8"), raw["user.txt"].decode("utf-8"), shots, {n: hashlib.sha256(b).hexdigest() for n, b in raw.items()})
    if frozen is not None and out.sha256 != frozen:
        raise gates.GateError(f"the bundle's hash is {out.sha256}, frozen as {frozen}")
    return out


def bundle_hash(files: DataFrame) -> DataFrame:
    """``sha256`` of the sorted lines "name:sha256" of ``name, sha256`` rows (a few files)."""
    lines = F.array_sort(F.collect_list(F.concat("name", F.lit(":"), "sha256", F.lit("\n"))))
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("sha256"))


def completion_fields(completion: Column) -> Column:
    """A provider's JSON response as one flat struct; what is absent is null."""
    c = F.from_json(completion, COMPLETION)
    first = F.get(c.choices, F.lit(0))
    return F.struct(
        c.model.alias("model"), c.provider.alias("provider"), first.finish_reason.alias("finish_reason"), first.message.content.alias("content"),
        c.usage.prompt_tokens.alias("prompt_tokens"), c.usage.completion_tokens.alias("completion_tokens"), c.usage.total_tokens.alias("total_tokens"), c.usage.cost.alias("provider_cost_usd"),
    )


def receipts(df: DataFrame, key: str, completion: str, slug: str, prompt_price: float, completion_price: float, labels: list[str]) -> DataFrame:
    """A receipt per response: token counts, cost by the price list, and whether its answer could be read."""
    rows = df.select(F.col(key).alias("complaint_id"), completion_fields(F.col(completion)).alias("c"), *(x for x in ("latency_ms", "retries") if x in df.columns))
    cost = F.col("c.prompt_tokens") * prompt_price + F.col("c.completion_tokens") * completion_price
    failed = parse_label(F.col("c.content"), labels).isNull()
    return rows.select("complaint_id", F.lit(slug).alias("slug"), "c.*", cost.alias("computed_cost_usd"), failed.alias("parse_failed"), *rows.columns[2:])


def rollup(receipts_: DataFrame) -> DataFrame:
    """Totals of a run: calls, tokens, cost, latency percentiles, retries and answers that could not be read."""
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95)))
    return receipts_.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("computed_cost_usd"), F.lit(0.0)).alias("cost_usd"), F.get(p, F.lit(0)).alias("p50_ms"), F.get(p, F.lit(1)).alias("p95_ms"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.count_if("parse_failed").alias("parse_failed"),
    )


def labels_of(ids: DataFrame, receipts_: DataFrame, key: str, labels: list[str], fallback: str) -> DataFrame:
    """``key, label`` of each id from its receipt's content; unreadable answers get the fallback, absent receipts raise."""
    if fallback not in labels:
        raise ValueError(f"the fallback {fallback!r} is no label")
    gates.unique_key(receipts_, key)
    gates.covers(ids, receipts_, key)
    got = receipts_.select(key, F.coalesce(parse_label(F.col("content"), labels), F.lit(fallback)).alias("label"))
    return ids.select(key).join(got, key)


def read_receipt_labels(spark: SparkSession, path: str, key: str, labels: list[str], fallback: str) -> DataFrame:
    r = spark.read.schema(f"{key} long, content string").json(path)
    return labels_of(r.select(key).distinct(), r, key, labels, fallback)
