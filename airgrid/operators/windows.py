"""Operators over ordered series: lags, rolling statistics, gaps, decomposition, splits.

A series has one row per key and time.  All windows run over bounded blocks of a series (see
``core.halo_blocks``), never over a whole key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.core import (
    BLOCK,
    attach,
    exact_quantiles,
    nearest_valid,
    own_rows,
    ratio,
    row_position,
    value_position,
    windowed,
)
from airgrid.core import block_window, halo_blocks
from airgrid.functions.calendar import seconds, temporal_columns
from airgrid.functions.special import normal_ppf
from airgrid.operators.aggregates import merge_on

# fixed values: feature lags and windows
TARGET_LAGS = (1, 3, 7, 14)
OTHER_LAGS = (1, 3, 7)
ROLLING = (7, 14, 30)
DIFFS = (1, 7)


def lag_columns(w: Window, column: str, lags: Sequence[int]) -> dict[str, Column]:
    return {f"{column}_lag_{k}": F.lag(column, k).over(w) for k in lags}


def rolling_columns(w: Window, column: str, sizes: Sequence[int]) -> dict[str, Column]:
    """Trailing mean, sample std, min and max; null until the window is full and free of nulls."""
    out = {}
    for k in sizes:
        span = w.rowsBetween(-(k - 1), 0)
        full = F.count(column).over(span) == k
        for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"{column}_rolling_{name}_{k}"] = F.when(full, fn(column).over(span))
    return out


def diff_columns(w: Window, column: str, steps: Sequence[int]) -> dict[str, Column]:
    return {f"{column}_diff_{k}": F.col(column) - F.lag(column, k).over(w) for k in steps}


def _each(fn, columns: Sequence[str], sizes: Sequence[int]):
    return lambda w: {n: c for col in columns for n, c in fn(w, col, sizes).items()}


def add_lags(
    df: DataFrame, target: str, others: Sequence[str] = (), lags: Sequence[int] = TARGET_LAGS,
    other_lags: Sequence[int] = OTHER_LAGS, keys: Sequence[str] = ("dataset_id",), time: str = "time", block: int = BLOCK,
) -> DataFrame:
    """Row lags of the target, then of the other columns and of the target's own lags."""
    own = [f"{target}_lag_{k}" for k in lags]
    layers = [_each(lag_columns, [target], lags), _each(lag_columns, [*others, *own], other_lags)]
    return windowed(df, keys, max(lags) + max(other_lags, default=0), 0, layers, time, block)


def add_rolling(
    df: DataFrame, columns: Sequence[str], sizes: Sequence[int] = ROLLING, keys: Sequence[str] = ("dataset_id",),
    time: str = "time", block: int = BLOCK,
) -> DataFrame:
    return windowed(df, keys, max(sizes) - 1, 0, _each(rolling_columns, columns, sizes), time, block)


def add_diffs(
    df: DataFrame, columns: Sequence[str], steps: Sequence[int] = DIFFS, keys: Sequence[str] = ("dataset_id",),
    time: str = "time", block: int = BLOCK,
) -> DataFrame:
    return windowed(df, keys, max(steps), 0, _each(diff_columns, columns, steps), time, block)


def engineer_features(
    df: DataFrame, target: str, variables: Sequence[str], keys: Sequence[str] = ("dataset_id",), time: str = "time",
    lags: Sequence[int] = TARGET_LAGS, other_lags: Sequence[int] = OTHER_LAGS, sizes: Sequence[int] = ROLLING,
    steps: Sequence[int] = DIFFS, drop_nulls: bool = True, block: int = BLOCK,
) -> DataFrame:
    """Calendar columns, lags, rolling statistics, differences and products, in that order.

    Every layer sees the numeric columns of the layers before it; all windows share one sort.
    Calendar indexes get lags but no rolling statistics of their own.
    """
    calendar = temporal_columns(F.col(time))
    whole = [c for c in calendar if not c.endswith(("_sin", "_cos"))]
    waves = [c for c in calendar if c.endswith(("_sin", "_cos"))]
    others = [v for v in variables if v != target]
    own = [f"{target}_lag_{k}" for k in lags]
    lagged = [*others, *[c for c in [*whole, *waves] if c not in ("month", "season")], *own]
    lag_names = [*own, *[f"{c}_lag_{k}" for c in lagged for k in other_lags]]
    numeric = [*variables, *waves, "is_weekend", *lag_names]
    stats = [f"{c}_rolling_{s}_{k}" for c in numeric for k in sizes for s in ("mean", "std", "min", "max")]
    layers = [
        _each(lag_columns, [target], lags),
        _each(lag_columns, lagged, other_lags),
        _each(rolling_columns, numeric, sizes),
        _each(diff_columns, [*numeric, *stats], steps),
    ]
    before = max(lags) + max(other_lags) + max(sizes) - 1 + max(steps)
    base = df.select(*keys, time, *variables).withColumns(calendar)
    out = windowed(base, keys, before, 0, layers, time, block)
    pairs = list(zip(numeric, numeric[1:], strict=False))[:3]
    out = out.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})
    return out.na.drop("any") if drop_nulls else out


@dataclass(frozen=True)
class FeaturePlan:
    """Which features ``engineer_features`` makes of which columns, layer by layer."""

    target: str
    variables: tuple[str, ...]
    lags: tuple[int, ...] = TARGET_LAGS
    other_lags: tuple[int, ...] = OTHER_LAGS
    sizes: tuple[int, ...] = ROLLING
    steps: tuple[int, ...] = DIFFS

    @property
    def calendar(self) -> list[str]:
        """The names of ``temporal_columns``."""
        return [
            "day_of_year", "month", "day_of_week", "quarter", "season",
            "day_of_year_sin", "day_of_year_cos", "month_sin", "month_cos", "is_weekend",
        ]

    @property
    def own_lags(self) -> list[tuple[str, str, int]]:
        return [(f"{self.target}_lag_{k}", self.target, k) for k in self.lags]

    @property
    def further_lags(self) -> list[tuple[str, str, int]]:
        calendar = [c for c in self.calendar if c not in ("month", "season", "is_weekend")]
        order = [c for c in [*calendar, "is_weekend"] if not c.endswith(("_sin", "_cos"))] + [c for c in calendar if c.endswith(("_sin", "_cos"))]
        lagged = [*[v for v in self.variables if v != self.target], *order, *[n for n, *_ in self.own_lags]]
        return [(f"{c}_lag_{k}", c, k) for c in lagged for k in self.other_lags]

    @property
    def numeric(self) -> list[str]:
        waves = [c for c in self.calendar if c.endswith(("_sin", "_cos"))]
        return [*self.variables, *waves, "is_weekend", *[n for n, *_ in self.own_lags], *[n for n, *_ in self.further_lags]]

    @property
    def rolling(self) -> list[tuple[str, str, str, int]]:
        return [(f"{c}_rolling_{f}_{k}", c, f, k) for c in self.numeric for k in self.sizes for f in ("mean", "std", "min", "max")]

    @property
    def diffs(self) -> list[tuple[str, str, int]]:
        return [(f"{c}_diff_{k}", c, k) for c in [*self.numeric, *[n for n, *_ in self.rolling]] for k in self.steps]

    @property
    def products(self) -> list[tuple[str, str, str]]:
        return [(f"{a}_x_{b}", a, b) for a, b in list(zip(self.numeric, self.numeric[1:], strict=False))[:3]]

    @property
    def names(self) -> list[str]:
        """All features in the order of the matrix."""
        layers = [self.own_lags, self.further_lags, self.rolling, self.diffs, self.products]
        return [*self.calendar, *self.variables, *[f[0] for layer in layers for f in layer]]

    @property
    def reach(self) -> int:
        """Rows before a row that its features look at."""
        return max(self.lags) + max(self.other_lags) + max(self.sizes) - 1 + max(self.steps)

    @cached_property
    def looks_back(self) -> dict[str, list[int]]:
        """How many rows back the features look at each base column."""
        seen = {c: {c: {0}} for c in [*self.calendar, *self.variables]}

        def made(name: str, c: str, steps: Sequence[int]) -> None:
            seen[name] = {b: {o + k for o in found for k in steps} for b, found in seen[c].items()}

        for name, c, k in [*self.own_lags, *self.further_lags]:
            made(name, c, [k])
        for name, c, _, k in self.rolling:
            made(name, c, range(k))
        for name, c, k in self.diffs:
            made(name, c, [0, k])
        out: dict[str, set[int]] = {}  # products look where their factors do
        for found in seen.values():
            for b, offsets in found.items():
                out.setdefault(b, set()).update(offsets)
        return {b: sorted(offsets) for b, offsets in out.items()}

    def known(self, base: Mapping[str, np.ndarray]) -> np.ndarray:
        """The rows of ``rows(base)`` without NaN, mostly without working them out."""
        if min(self.sizes, default=2) < 2 or any(np.abs(v[~np.isnan(v)]).max(initial=0) > 1e100 for v in base.values()):
            return ~np.isnan(self.rows(base)).any(axis=1)  # the arithmetic itself may give NaN
        out = np.ones(len(next(iter(base.values()))), bool)
        for c, offsets in self.looks_back.items():
            there = ~np.isnan(base[c])
            for o in offsets:
                out[:o] = False
                out[o:] &= there[: max(len(there) - o, 0)]
        return out

    def sources(self, names: Sequence[str]) -> set[str]:
        """``names`` and all columns that they are made of."""
        found = set(names)
        for name, a, b in self.products:
            found |= {a, b} if name in found else set()
        for layer in (self.diffs, self.rolling, self.further_lags, self.own_lags):
            found |= {f[1] for f in layer if f[0] in found}
        return found

    def rows(self, base: Mapping[str, np.ndarray], names: Sequence[str] | None = None) -> np.ndarray:
        """The matrix (or the named columns of it) of a stretch of consecutive rows from its base columns; what is not known is NaN."""
        held, names = dict(base), self.names if names is None else names
        needed = self.sources(names)

        def behind(c: str, k: int) -> np.ndarray:
            out = np.full(len(held[c]), np.nan)
            out[k:] = held[c][:-k] if k else held[c]
            return out

        for name, c, k in [*self.own_lags, *self.further_lags]:
            if name in needed:
                held[name] = behind(c, k)
        fns = {"mean": np.mean, "std": lambda v, axis: np.std(v, axis=axis, ddof=1), "min": np.min, "max": np.max}
        for name, c, f, k in self.rolling:
            if name not in needed:
                continue
            out = np.full(len(held[c]), np.nan)
            if len(out) >= k:
                out[k - 1 :] = fns[f](np.lib.stride_tricks.sliding_window_view(held[c], k), axis=1)
            held[name] = out
        for name, c, k in self.diffs:
            if name in needed:
                held[name] = held[c] - behind(c, k)
        for name, x, y in self.products:
            if name in needed:
                held[name] = held[x] * held[y]
        return np.stack([held[n] for n in names], axis=1)


@dataclass(frozen=True)
class FeatureBlocks:
    """Blocks of consecutive rows, with the rows that they reach back to, of which a task can work out a feature matrix."""

    rows: DataFrame
    plan: FeaturePlan
    keys: tuple[str, ...]
    time: str
    block: int
    drop_nulls: bool

    def apply(self, work, schema) -> DataFrame:
        return self.rows.groupBy(*self.keys, "_block").applyInArrow(work, schema)


def base_columns(plan: FeaturePlan, table: pa.Table) -> dict[str, np.ndarray]:
    """The columns that a block's features are made of; infinite values are as unknown as nulls."""
    names = [*plan.calendar, *plan.variables]
    return {c: np.nan_to_num(table[c].to_numpy(zero_copy_only=False).astype(float), nan=np.nan, posinf=np.nan, neginf=np.nan) for c in names}


def own_places(table: pa.Table, block: int) -> np.ndarray:
    return np.asarray(table["_pos"]) // block == np.asarray(table["_block"])


def wide_arrays(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def feature_blocks(
    df: DataFrame, plan: FeaturePlan, keys: Sequence[str] = ("dataset_id",), time: str = "time", drop_nulls: bool = True, block: int = BLOCK // 8
) -> FeatureBlocks:
    """The rows of ``feature_matrix`` before their features are worked out."""
    calendar = {n: c.cast("double") for n, c in temporal_columns(F.col(time)).items()}
    rows = df.select(*keys, time, *[F.col(v).cast("double").alias(v) for v in plan.variables]).withColumns(calendar)
    return FeatureBlocks(halo_blocks(rows, list(keys), plan.reach, 0, time, block), plan, tuple(keys), time, block, drop_nulls)


def feature_matrix(
    df: DataFrame, plan: FeaturePlan, keys: Sequence[str] = ("dataset_id",), time: str = "time", drop_nulls: bool = True, block: int = BLOCK // 8
) -> DataFrame:
    """``keys, time, features``: the features of ``engineer_features`` as one array per row, in the order of ``plan.names``.

    With the default lags there are over two thousand features, too many for columns of a plan; a block
    of consecutive rows, with the rows that it reaches back to, is worked out in arrays instead.
    Features that are not known, or would look at an infinite value, are NaN; ``drop_nulls`` leaves out rows that have one.
    """
    blocks = feature_blocks(df, plan, keys, time, drop_nulls, block)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        matrix, keep = plan.rows(base_columns(plan, table)), own_places(table, block)
        if drop_nulls:
            keep &= ~np.isnan(matrix).any(axis=1)
        return table.select([*keys, time]).filter(pa.array(keep)).append_column("features", wide_arrays(matrix[keep]))

    return blocks.apply(work, blocks.rows.select(*keys, time, F.lit(None).cast("array<double>").alias("features")).schema)


def smooth_centered(
    series: DataFrame, size: int = 7, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Centred moving mean; null at both ends and where the window holds a null."""
    half = size // 2

    def columns(w):
        span = w.rowsBetween(-half, size - 1 - half)
        return {"smoothed": F.when(F.count(value).over(span) == size, F.avg(value).over(span))}

    return windowed(series, keys, half, size - 1 - half, columns, time, block)


def temporal_smooth3(
    cube: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Per-cell mean over the slice before, the slice itself and the slice after, nulls skipped.

    Slices are numbered per key, so that a cell missing from the slice before does not reach further
    back.  A cell's history is cut into blocks of slices that borrow one slice on each side.  Keys
    with fewer than 3 slices stay as they are.
    """
    times = cube.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_cells"))
    numbered = row_position(times.drop("_cells"), keys, time, "_slot", "_slots")
    rows = attach(cube, numbered, [*keys, time])
    b, off = F.floor(F.col("_slot") / block), F.col("_slot") % block
    owners = F.array_compact(F.array(b, F.when(off == block - 1, b + 1), F.when((off == 0) & (b > 0), b - 1)))
    w = Window.partitionBy(*keys, "y", "x", "_block").orderBy("_slot").rangeBetween(-1, 1)
    smooth = F.when(F.col("_slots") >= 3, F.avg(value).over(w)).otherwise(F.col(value))
    out = rows.withColumn("_block", F.explode(owners)).withColumn("_mean", smooth)
    own = out.where(F.col("_block") == F.floor(F.col("_slot") / block))
    return own.withColumn(value, F.col("_mean")).select(*cube.columns)


def to_calendar(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Daily calendar between a series' first and last day, null on days without a row.

    Several rows of one day count as one, with the mean of their values.
    """
    day = series.select(*keys, F.date_trunc("day", F.col(time)).cast("timestamp_ntz").alias(time), value)
    day = day.groupBy(*keys, time).agg(F.avg(value).alias(value))
    span = day.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    calendar = span.select(
        *keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 DAY"))).alias(time)
    )
    return merge_on(calendar, day, [*keys, time])


def fill_gaps(
    series: DataFrame, max_gap_days: int = 3, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Linear interpolation over the daily calendar; gaps longer than ``max_gap_days`` stay null.

    Leading gaps stay null, trailing ones repeat the last value within the same limit.
    """
    rows = nearest_valid(to_calendar(series, keys, time, value), keys, value, time, block)
    pos, a, b = F.col("_pos"), F.col("_prev"), F.col("_next")
    run = F.coalesce(b["pos"], F.col("_n")) - F.coalesce(a["pos"], F.lit(-1)) - 1
    line = a["v"] + (b["v"] - a["v"]) * ratio(pos - a["pos"], b["pos"] - a["pos"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(
        (run <= max_gap_days) & a.isNotNull(), F.when(b.isNull(), a["v"]).otherwise(line)
    )
    return rows.withColumns({"filled": filled, "was_missing": F.col(value).isNull()}).drop("_prev", "_next", "_pos", "_n")


def gap_runs(
    series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Start and length of every run of consecutive nulls; a run is named by the valid row before it."""
    rows = nearest_valid(series, keys, value, time, block).where(F.col(value).isNull())
    runs = rows.groupBy(*keys, F.coalesce(F.col("_prev")["pos"], F.lit(-1)).alias("_run"))
    return runs.agg(F.min(time).alias("start"), F.count(F.lit(1)).alias("length")).drop("_run")


def decompose(
    series: DataFrame, period: int = 12, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Additive classical decomposition of series with at least two periods.

    trend: centred moving mean of one period (half weights at both ends for an even period);
    seasonal: mean detrended value per position in the period, recentred to sum to zero.
    """
    half = period // 2

    def columns(w):
        if period % 2:
            inner, ends = w.rowsBetween(-half, half), F.lit(0.0)
            need = period
        else:
            inner = w.rowsBetween(-(half - 1), half - 1)
            ends = 0.5 * (F.lag(value, half).over(w) + F.lead(value, half).over(w))
            need = period - 1
        total = F.when(F.count(value).over(inner) == need, F.sum(value).over(inner))
        return {"trend": (total + ends) / period}

    rows = halo_blocks(series, keys, half, half, time, block, total="_n").where(F.col("_n") >= 2 * period)
    rows = own_rows(rows.withColumns(columns(block_window(keys))), block).withColumn("_phase", F.col("_pos") % period)
    phases = rows.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_mean"))
    centre = phases.groupBy(*keys).agg(F.avg("_mean").alias("_centre"))
    seasonal = merge_on(phases, centre, keys).select(*keys, "_phase", (F.col("_mean") - F.col("_centre")).alias("seasonal"))
    out = attach(rows, seasonal, [*keys, "_phase"])
    return out.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_phase", "_pos", "_n")


def recent_trend(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Mean of the last 7 values against the first 7 of the last 14, for series of at least 7."""
    rows = row_position(series.where(F.col(value).isNotNull()), keys, time, "_pos", "_n")
    start = F.greatest(F.col("_n") - 14, F.lit(0))
    tail = rows.where((F.col("_n") >= 7) & (F.col("_pos") >= start))
    recent = F.avg(F.when(F.col("_pos") >= F.col("_n") - 7, F.col(value)))
    previous = F.avg(F.when(F.col("_pos") < start + 7, F.col(value)))
    out = tail.groupBy(*keys).agg(recent.alias("recent_mean"), previous.alias("previous_mean"))
    change = ratio(F.col("recent_mean") - F.col("previous_mean"), F.col("previous_mean")) * 100
    return out.withColumn("trend_pct", change).withColumn(
        "direction", F.when(F.col("trend_pct") > 0, "increasing").otherwise("decreasing")
    )


def current_value(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Last valid value."""
    return series.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max_by(value, time).alias("current_value"), F.max(time).alias("current_time")
    )


def ffill_bfill_mean(
    series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Forward fill, then backward fill, then the mean of the filled column."""
    rows = nearest_valid(series, keys, value, time, block)
    filled = F.coalesce(F.col(value), F.col("_prev")["v"], F.col("_next")["v"])
    return rows.withColumn("filled", filled).drop("_prev", "_next", "_pos", "_n")


def chrono_split(
    df: DataFrame, keys: Sequence[str] = ("dataset_id",), time: str = "time", test: float = 0.15, val: float = 0.15
) -> DataFrame:
    """Adds ``split``: the last part of each key's rows is test, the part before it val, the rest train."""
    rows = row_position(df, keys, time, "_pos", "_n")
    n_test, n_val = F.floor(F.col("_n") * test), F.floor(F.col("_n") * val)
    split = (
        F.when(F.col("_pos") >= F.col("_n") - n_test, "test")
        .when(F.col("_pos") >= F.col("_n") - n_test - n_val, "val")
        .otherwise("train")
    )
    return rows.withColumn("split", split).drop("_pos", "_n")


def random_split(
    df: DataFrame, identity: Sequence[str], seed: int = 42, test: float = 0.15, val: float = 0.15
) -> DataFrame:
    """Adds ``split`` by a hash of the row's identity, so that recomputed tasks agree on it."""
    u = F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def temporal_gaps(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", factor: float = 2.0, block: int = BLOCK) -> DataFrame:
    """Number of steps between successive times that exceed ``factor`` times the median step."""
    times = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_m"))
    steps = windowed(
        times, keys, 1, 0, lambda w: {"step": seconds(F.col(time)) - seconds(F.lag(time).over(w))}, time, block
    ).where(F.col("step").isNotNull())
    rows = attach(steps, exact_quantiles(steps, keys, "step", {"median_step": 0.5}), keys)
    large = F.col("step") > factor * F.col("median_step")
    return rows.groupBy(*keys).agg(
        F.max("median_step").alias("median_step"), F.count_if(large).alias("large_gaps"), F.max("step").alias("largest_step")
    )


def qq_points(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Ordered values against normal quantiles at the medians of the order statistics."""
    rows = value_position(df.select(*keys, value, *tiebreak), keys, value, tiebreak)
    n, i = F.col("_n"), F.col("_pos") + 1
    edge = F.pow(F.lit(0.5), 1.0 / n)
    p = F.when(i == 1, 1 - edge).when(i == n, edge).otherwise((i - 0.3175) / (n + 0.365))
    rows = rows.withColumn("_p", p)
    return rows.select(*keys, i.alias("order"), F.expr(normal_ppf("_p")).alias("theoretical"), F.col(value).alias("ordered"))
