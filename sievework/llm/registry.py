"""Queries and SQL of this package, gathered from its modules."""

from __future__ import annotations

import importlib

MODULES = ("chat", "warc", "quality_rules", "licenses", "byte_bpe", "near_dup", "wavelet", "pairwise_quality", "line_chunks", "decontaminate")


def _all(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), attr)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
