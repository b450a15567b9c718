"""Registered queries: a Spark callable and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.functions.special import Engine
from airgrid.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: how the other engine folds and names values in the text of ``functions.special``
DUCK = Engine(
    lambda first, last, by, start, state, item, step: (
        f"list_reduce(CAST(range({first}, {last} + ({by}), {by}) AS DOUBLE[]), lambda {state}, {item}: {step}, {start})"
    ),
    lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]",
)


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column, with negative zero folded into zero, for value comparison."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in floats})


def r(*columns: str, places: int = 6) -> str:
    """SQL text that rounds columns the way ``rounded`` does; ``name=expr`` renames."""
    out = []
    for c in columns:
        name, _, expr = c.partition("=")
        out.append(f"round({expr or name}, {places}) + 0.0 AS {name.strip()}")
    return ", ".join(out)
