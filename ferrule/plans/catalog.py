"""All registered queries: name -> (spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_MODULES = [
    "ferrule.plans.rules_q",
    "ferrule.plans.prep_q",
    "ferrule.plans.scoring_q",
    "ferrule.plans.eval_q",
    "ferrule.plans.monitor_q",
    "ferrule.plans.options_q",
    "ferrule.plans.ml_q",
    "ferrule.plans.stream_q",
]


def registry() -> dict[str, tuple[QueryFn, str | None]]:
    out: dict[str, tuple[QueryFn, str | None]] = {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        for key, val in mod.QUERIES.items():
            if key in out:
                raise ValueError(f"duplicate query name {key}")
            out[key] = val
    return out


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in registry().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in registry().items() if v[1] is not None}
