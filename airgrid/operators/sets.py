"""Set operations over datasets and time indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.core import all_of
from airgrid.sources.tables import union_daily


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return union_daily(dfs)


def intersect_times(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Times (per key) that occur in both."""
    return a.select(*keys, time).intersect(b.select(*keys, time))


def missing_days(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time") -> DataFrame:
    """Calendar days between a series' first and last day without a row."""
    observed = series.select(*keys, F.to_date(time).alias("day")).distinct()
    span = observed.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    calendar = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    same = all_of([calendar[k].eqNullSafe(observed[k]) for k in [*keys, "day"]])
    return calendar.join(observed, same, "left_anti")
