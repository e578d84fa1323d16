"""Queries of this package with their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "sharding", "hash_search", "mixing", "hmm", "toxicity", "licenses", "near_dedup", "decontaminate", "token_store", "token_counts", "chat", "merkle", "whitening",
)


def _collect(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"tremorlake.llm.{name}"), attr))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
