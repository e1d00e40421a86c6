"""Queries of the analytics engine and the SQL they are compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import cache

#: modules of brindle.plans; each has QUERIES: name -> (function of (spark, sf_dir), SQL or None)
MODULES: tuple[str, ...] = ("flagship", "semantic", "profiling", "validation", "suites", "product", "workload", "statistics", "causal", "series", "logs", "streams", "sinks")


@cache
def entries() -> dict[str, tuple[Callable, str | None]]:
    out: dict[str, tuple[Callable, str | None]] = {}
    for name in MODULES:
        found = importlib.import_module(f"brindle.plans.{name}").QUERIES
        assert not (both := out.keys() & found.keys()), both
        out |= found
    return out


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in entries().items() if sql is not None}
