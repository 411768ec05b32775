"""Registered queries on the driver tables, each with an independent SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["mart_checks", "cleaning_checks", "client_checks", "bounds_checks", "quote_checks", "model_checks", "stream_checks"]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def _fixed_digits(sql: str) -> str:
    """Rewrite every ``round(x, n)`` to ``floor(x * 10^n + 0.5) / 10^n``, see ``mart.fixed``."""
    out, at = "", 0
    for start in iter(lambda: sql.find("round(", at), -1):
        depth, end, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        inner, digits = sql[start + 6:comma], sql[comma + 1:end - 1].strip()
        out += sql[at:start]
        if comma > 0 and digits.isdigit():
            inner = _fixed_digits(inner)
            out += f"(floor(({inner}) * 1e{digits} + 0.5) / 1e{digits})"
            at = end
        else:
            out, at = out + "round(", start + 6
    return out + sql[at:]


def register(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator name; ``check`` is SQL over the same tables."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = _fixed_digits(check.strip())
        return fn

    return wrap


def load_all() -> None:
    for module in MODULES:
        import_module(f"priceloom.catalog.{module}")
