"""Cost configurations: what tiers, mistakes and people cost. Nothing has a default, so nothing is free by omission."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import gates
from sievework.session import stored

#: How a tier's calls are priced: a fixed price an example, or each call by its receipt.
MODES = ("amortized", "receipts")


def _price(value: object, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
        raise ValueError(f"{what} must be a number of dollars, not {value!r}")
    return float(value)


@dataclass(frozen=True)
class CostConfig:
    version: str
    c_misroute: float
    c_human: float
    tiers: dict[str, dict]
    evidence: str
    sha256: str

    def per_example(self, tier: str) -> float:
        """The declared price of an example of a tier; a tier without one has none."""
        block = self.tiers.get(tier)
        if block is None:
            raise KeyError(f"tier {tier!r} has no price; priced: {sorted(self.tiers)}")
        if block["mode"] != "amortized":
            raise ValueError(f"tier {tier!r} is priced by its receipts")
        return block["price"]

    def prices(self, *tiers: str) -> bool:
        return all(t in self.tiers for t in tiers)

    def tier_of(self, config_name: str) -> str:
        """The priced tier that a configuration's name begins with (the longest such)."""
        found = max((t for t in self.tiers if config_name.startswith(t)), key=len, default=None)
        if found is None:
            raise KeyError(f"no priced tier begins {config_name!r}; priced: {sorted(self.tiers)}")
        return found

    def identity(self) -> dict:
        return {"version": self.version, "sha256": self.sha256, "c_misroute_usd": self.c_misroute, "c_human_usd": self.c_human, "evidence_class": self.evidence}


def load(path: str | Path) -> CostConfig:
    """Reads and checks a cost file; its hash goes with every result that it priced."""
    raw = Path(path).read_bytes()
    top = yaml.safe_load(raw)
    if not isinstance(top, dict) or not {"version", "params", "api_cost"} <= set(top):
        raise ValueError("a cost file has version, params and api_cost")
    params, tiers = top["params"], {}
    for name in ("c_misroute_usd", "c_human_usd"):
        if name not in params:
            raise ValueError(f"params lack {name}")
    for tier, block in top["api_cost"].items():
        if not isinstance(block, dict) or block.get("mode") not in MODES:
            raise ValueError(f"tier {tier!r} needs a mode of {MODES}")
        if block["mode"] == "amortized":
            if "per_example_usd" not in block:
                raise ValueError(f"tier {tier!r} declares no per_example_usd")
            tiers[tier] = {"mode": "amortized", "price": _price(block["per_example_usd"], f"the price of {tier}")}
        else:
            tiers[tier] = {"mode": "receipts", "price": None}
    return CostConfig(str(top["version"]), _price(params["c_misroute_usd"], "c_misroute_usd"), _price(params["c_human_usd"], "c_human_usd"), tiers, str(top.get("evidence_class", "")), hashlib.sha256(raw).hexdigest())


def call_cost(prompt_tokens: Column, completion_tokens: Column, prompt_price: float, completion_price: float) -> Column:
    return prompt_tokens * prompt_price + completion_tokens * completion_price


def with_receipts(df: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """``df`` with ``api`` (the receipt's cost) and ``parse_failed`` of each row, joined by key.

    Repeated or missing receipts, costs that are null, negative or not finite and flags that are null raise.
    """
    gates.unique_key(receipts, key)
    r = receipts.select(F.col(key).alias("_key"), F.col("computed_cost_usd").cast("double").alias("api"), "parse_failed")
    both = stored(df.join(r, F.col(key) == F.col("_key"), "left"), "receipts")
    fair = F.col("_key").isNotNull() & F.col("parse_failed").isNotNull() & (F.col("api") >= 0) & (F.col("api") < float("inf"))
    if not both.where(~F.coalesce(fair, F.lit(False))).isEmpty():  # looked for again, to be named
        gates.covers(df, receipts, key)
        gates.holds(both, key, F.col("parse_failed").isNotNull(), f"{key} without a parse_failed flag")
        gates.holds(both, key, (F.col("api") >= 0) & (F.col("api") < float("inf")), f"{key} with an impossible cost")
    return both.drop("_key")


def check_cost_sum(priced: DataFrame, logged: float, tol: float = 1e-6) -> dict:
    """The sum of joined costs against the logged one."""
    total = priced.agg(F.coalesce(F.sum("api"), F.lit(0.0))).first()[0]
    if not abs(total - logged) <= tol:
        raise gates.GateError(f"receipts sum to {total}, the record says {logged}")
    return {"joined": total, "logged": logged, "difference": total - logged}
