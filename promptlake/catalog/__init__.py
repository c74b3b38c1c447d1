"""Every operator as a query over the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("scalars", "adapters", "caching", "metrics", "experiments", "streams")


def all_queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(import_module(f"promptlake.catalog.{m}").QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(import_module(f"promptlake.catalog.{m}").ORACLES)
    return out
