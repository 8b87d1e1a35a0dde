"""Every query of the core library by name, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


for _name in ("urls", "records", "profiles", "verification", "vocabularies", "sync", "web", "histories", "returns", "shapes", "stores", "audits"):
    import_module(f"gleanery.plans.{_name}")
