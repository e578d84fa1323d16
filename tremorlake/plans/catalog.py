"""All registered queries with their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "quality",
    "align",
    "fit",
    "diagnose",
    "sites",
    "sweep",
    "uncertainty",
    "waveform",
)


def _collect(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"tremorlake.plans.{name}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"duplicate query names: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
