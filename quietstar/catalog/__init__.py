"""Registered queries and the DuckDB SQL that checks them, one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("ingest", "killers", "text", "aspects", "trend", "market", "search", "models", "streams")


def _merge(name: str) -> dict:
    out: dict = {}
    for area in AREAS:
        part = getattr(import_module(f"{__name__}.{area}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merge("QUERIES")


def oracles() -> dict:
    return _merge("ORACLES")
