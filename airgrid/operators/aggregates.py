"""Descriptive, temporal and spatial aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.core import attach, exact_quantiles, ratio, running, same_keys
from airgrid.functions.calendar import month_end, season_label, season_number, seconds, week_end
from airgrid.operators.slicing import first_slice

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def cv(value: str = "value", std=F.stddev_pop) -> Column:
    """Coefficient of variation, 0 for a zero mean."""
    return F.when(F.avg(value) == 0, 0.0).otherwise(ratio(std(value), F.avg(value)))


def merge_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join two result tables that both have one row per key."""
    if not keys:
        return left.withColumn("_1", F.lit(1)).join(right.withColumn("_1", F.lit(1)), "_1", how).drop("_1")
    return same_keys(left, right, keys, how)


def describe(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Full descriptive statistics, population forms."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.var_pop(value).alias("var"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("range"),
        F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"),
        cv(value).alias("cv"),
        (F.count_if(F.col(value).isNull()) * 100.0 / F.count(F.lit(1))).alias("missing_pct"),
    )
    spread = exact_quantiles(df, keys, value, QUARTILES).withColumn("iqr", F.col("q3") - F.col("q1"))
    return merge_on(moments, spread, keys)


def iqr_fences(df: DataFrame, keys: Sequence[str], value: str, multiplier: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    reach = multiplier * (F.col("q3") - F.col("q1"))
    return q.select(*keys, (F.col("q1") - reach).alias("_low"), (F.col("q3") + reach).alias("_high"))


def outlier_percentage(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Share of valid values outside the Tukey fences."""
    v = F.col(value)
    rows = attach(df.where(v.isNotNull()), iqr_fences(df, keys, value), keys)
    out = (v < F.col("_low")) | (v > F.col("_high"))
    return rows.groupBy(*keys).agg(
        F.count_if(out).alias("outliers"), (F.count_if(out) * 100.0 / F.count(F.lit(1))).alias("outlier_pct")
    )


def spatial_mean(
    cube: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Mean over all cells per time: the reduction from cube to series."""
    return cube.groupBy(*keys, time).agg(F.avg(value).alias(value))


def time_mean(cube: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Mean over time per cell."""
    extra = {c: F.max(c).alias(c) for c in ("lat", "lon") if c in cube.columns}
    return cube.groupBy(*keys, "y", "x").agg(F.avg(value).alias(value), *extra.values())


def region_reduce(
    cube: DataFrame, reducer: str = "mean", keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """mean / median / min / max over the region per image date; dates without valid cells have no row."""
    group = [*keys, time]
    if reducer == "median":
        out = exact_quantiles(cube, group, value, {value: 0.5})
    else:
        fn = {"mean": F.avg, "min": F.min, "max": F.max}[reducer]
        out = cube.groupBy(*group).agg(fn(value).alias(value))
    return out.where(F.col(value).isNotNull())


def region_statistics(
    cube: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Mean, min and max over cells of the time-mean image, with slice count and first time."""
    image = time_mean(cube, keys, value).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("cells")
    )
    slices = (
        cube.groupBy(*keys, time)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("scenes"), F.min(time).alias("first_time"))
    )
    return merge_on(image, slices, keys)


PERIODS = {
    "daily": lambda t: F.date_trunc("day", t).cast("date"),
    "weekly": week_end,
    "monthly": month_end,
}


def aggregate_time(
    series: DataFrame, freq: str, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Period statistics labelled by day, by the closing Sunday or by the last day of the month.

    A series has one row per key and time, so a period holds a bounded number of values (44,640 for a
    month of minutes) and its exact median fits the one aggregation that makes the other statistics.
    """
    dated = series.withColumn("period", PERIODS[freq](F.col(time)))
    return dated.groupBy(*keys, "period").agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *([F.count(value).alias("count")] if freq == "daily" else []),
    )


def aggregate_season(
    series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    dated = series.withColumn("season", season_label(F.col(time)))
    group = [*keys, "season"]
    stats = dated.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return merge_on(stats, exact_quantiles(dated, group, value, {"median": 0.5}), group)


def temporal_stats(
    series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Span and sample statistics of the valid values of a series."""
    valid = series.where(F.col(value).isNotNull())
    stats = valid.groupBy(*keys).agg(
        F.min(time).alias("start"),
        F.max(time).alias("end"),
        F.date_diff(F.max(time), F.min(time)).alias("duration_days"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("range"),
        cv(value, F.stddev_samp).alias("cv"),
    )
    return merge_on(stats, exact_quantiles(valid, keys, value, {"median": 0.5}), keys)


def _profile(series: DataFrame, part: Column, name: str, least: int, keys, value: str) -> DataFrame:
    valid = series.where(F.col(value).isNotNull()).withColumn(name, part)
    groups = valid.groupBy(*keys, name).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    )
    totals = groups.groupBy(*keys).agg(F.sum("count").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return merge_on(groups, totals, keys, "left_semi")


def season_profile(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", least: int = 12) -> DataFrame:
    """Mean, sample std and count per season of series with at least ``least`` values."""
    return _profile(series, season_label(F.col(time)), "season", least, keys, value)


def month_profile(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", least: int = 24) -> DataFrame:
    return _profile(series, F.month(time), "month", least, keys, value)


def grid_stats(cube: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    stats = cube.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("count_valid"),
        F.count(F.lit(1)).alias("count_total"),
        (F.count(value) / F.count(F.lit(1))).alias("coverage"),
    )
    probs = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    return merge_on(stats, exact_quantiles(cube, keys, value, probs), keys, "inner")


def slice_stats(cube: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Spatial statistics of each key's first slice."""
    return first_slice(cube, keys, time).groupBy(*keys).agg(
        F.avg(value).alias("spatial_mean"),
        F.stddev_pop(value).alias("spatial_std"),
        (F.max(value) - F.min(value)).alias("spatial_range"),
        cv(value).alias("spatial_cv"),
    )


def hotspots(cells: DataFrame, percentile: float = 90, keys: Sequence[str] = (*KEYS, "time"), value: str = "value") -> DataFrame:
    """Cells strictly above the percentile of their slice: threshold, number, share, mean and maximum.

    Both sides are compared to 12 decimals: a cell that is the percentile is not above it.
    """
    cut = exact_quantiles(cells, keys, value, {"threshold": percentile / 100.0})
    rows = attach(cells.where(F.col(value).isNotNull()), cut, keys)
    hot = F.when(F.round(value, 12) > F.round("threshold", 12), F.col(value))
    return rows.groupBy(*keys).agg(
        F.max("threshold").alias("threshold"),
        F.count(hot).alias("num_hotspots"),
        (F.count(hot) * 100.0 / F.count(F.lit(1))).alias("hotspot_pct"),
        F.coalesce(F.avg(hot), F.lit(0.0)).alias("hotspot_mean"),
        F.coalesce(F.max(hot), F.lit(0.0)).alias("hotspot_max"),
    )


def bin_index(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin, the last one closed; a constant column falls into the middle bin."""
    scaled = F.least(F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1))
    return F.when(hi > lo, scaled).when(v.isNotNull(), F.lit(bins // 2)).cast("int")


def with_bins(df: DataFrame, bins: int, keys: Sequence[str], value: str = "value", join: Callable = attach) -> DataFrame:
    """Adds ``bin``, ``_lo`` (left end of the first bin) and ``_w`` (bin width) to the valid rows.

    ``join`` brings the range to the rows; ``core.same_keys`` is the one for many small groups.
    """
    valid = df.where(F.col(value).isNotNull())
    span = valid.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = join(valid, span, keys)
    rows = rows.withColumn("bin", bin_index(F.col(value), F.col("_lo"), F.col("_hi"), bins))
    flat = F.col("_hi") == F.col("_lo")
    return rows.withColumns(
        {
            "_w": F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")) / bins,
            "_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        }
    ).drop("_hi")


def histogram(df: DataFrame, bins: int = 50, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Counts and left edges of the occupied equal-width bins."""
    rows = with_bins(df, bins, keys, value)
    counted = rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.max("_lo").alias("_lo"), F.max("_w").alias("width")
    )
    return counted.withColumn("left_edge", F.col("_lo") + F.col("bin") * F.col("width")).drop("_lo")


def cdf(hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Running count of a histogram, normalised to 0 at the first and 1 at the last bin.

    A histogram has a fixed number of bins per key, so one window per key is bounded.
    """
    out = hist.withColumn("cum", F.sum("count").over(running(keys, "bin")))
    ends = out.groupBy(*keys).agg(F.min("cum").alias("_a"), F.max("cum").alias("_b"))
    joined = merge_on(out, ends, keys)
    return joined.withColumn("cdf", ratio(F.col("cum") - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def entropy(df: DataFrame, bins: int = 256, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """-sum h log2 h over the bin densities h."""
    hist = histogram(df, bins, keys, value)
    total = hist.groupBy(*keys).agg(F.sum("count").alias("_n"))
    h = F.col("count") / (F.col("_n") * F.col("width"))
    return merge_on(hist, total, keys).groupBy(*keys).agg((-F.sum(h * F.log2(h))).alias("entropy"))


def coverage(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("valid"),
        F.count(F.lit(1)).alias("total"),
        (F.count(value) / F.count(F.lit(1))).alias("coverage"),
    )


def dataset_score(df: DataFrame, dataset: str = "dataset_id", variable: str = "variable", value: str = "value") -> DataFrame:
    """Mean coverage of a dataset's variables."""
    return coverage(df, [dataset, variable], value).groupBy(dataset).agg(F.avg("coverage").alias("score"))


def table_score(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Valid share of all numeric cells of a point table."""
    valid = sum((F.count(c) for c in columns), F.lit(0))
    return df.groupBy(*keys).agg((valid / (F.count(F.lit(1)) * len(columns))).alias("score"))


def snr_column(mean: Column, std: Column) -> Column:
    return F.when(std > 0, ratio(mean, std)).otherwise(F.lit(float("inf")))


def snr(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(
        snr_column(F.avg(value), F.stddev_pop(value)).alias("snr"), F.var_pop(value).alias("noise_variance")
    )


def _moments(df: DataFrame, keys: Sequence[str], value: str, tag: str, *more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"{tag}_mean"), F.stddev_pop(value).alias(f"{tag}_std"), F.min(value).alias(f"{tag}_min"),
        F.max(value).alias(f"{tag}_max"), *more,
    )


def _both(orig: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return merge_on(_moments(orig, keys, value, "original"), _moments(new, keys, value, "new"), keys, "inner")


def compare_before_after(orig: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Means, deviations, their changes, and the change of signal-to-noise ratio and contrast."""
    m, s, m2, s2 = (F.col(c) for c in ("original_mean", "original_std", "new_mean", "new_std"))
    return _both(orig, new, keys, value).select(
        *keys,
        "original_mean",
        "new_mean",
        "original_std",
        "new_std",
        (m2 - m).alias("mean_change"),
        (s2 - s).alias("std_change"),
        F.when(s > 0, ratio(F.abs(m2), s2) - ratio(F.abs(m), s)).alias("snr_improvement"),
        F.when(m > 0, ratio(s2, m2) - ratio(s, m)).alias("contrast_improvement"),
    )


def correction_checks(orig: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    m, s, m2, s2 = (F.col(c) for c in ("original_mean", "original_std", "new_mean", "new_std"))
    return _both(orig, new, keys, value).select(
        *keys,
        (F.col("new_min") >= 0).alias("no_negative_values"),
        (F.abs(m2 - m) < s).alias("reasonable_mean_change"),
        (s2 > 0.1 * s).alias("preserved_data_structure"),
        (s2 >= s).alias("improved_contrast"),
    )


def variable_importance(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.var_pop(value).alias("variance"), (F.max(value) - F.min(value)).alias("range"), cv(value).alias("cv")
    )


def completeness(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Observations per day of the spanned days, in percent; null for a one-day span."""
    days = F.floor((seconds(F.max(time)) - seconds(F.min(time))) / 86400)
    return series.groupBy(*keys).agg(
        ratio(F.count(F.lit(1)) * 100.0, days).alias("completeness"),
        F.count(F.lit(1)).alias("data_points"),
        F.min(time).alias("start"),
        F.max(time).alias("end"),
    )


def season_summary(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Overall mean and sample std, the four seasonal means, and their extremes."""
    dated = series.withColumn("_season", season_number(F.col(time)))
    named = {1: "winter", 2: "spring", 3: "summer", 4: "fall"}
    out = dated.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        *[F.avg(F.when(F.col("_season") == i, F.col(value))).alias(n) for i, n in named.items()],
    )
    means = [F.col(n) for n in named.values()]
    return out.withColumns({"season_max": F.greatest(*means), "season_min": F.least(*means)})


def metric_columns(actual: str, predicted: str) -> list[Column]:
    """mse, rmse, mae, r2 and mape (infinite where an actual value is zero) as aggregates."""
    y, p = F.col(actual), F.col(predicted)
    mse = F.avg((y - p) * (y - p))
    relative = F.avg(F.abs(ratio(y - p, y))) * 100
    return [
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - ratio(mse, F.var_pop(y))).alias("r2"),
        F.when(F.count_if(y == 0) > 0, F.lit(float("inf"))).otherwise(relative).alias("mape"),
    ]


def residual_columns(actual: str, predicted: str) -> list[Column]:
    res = F.col(actual) - F.col(predicted)
    return [
        F.avg(res).alias("residual_mean"),
        F.stddev_pop(res).alias("residual_std"),
        F.skewness(res).alias("residual_skewness"),
        F.kurtosis(res).alias("residual_kurtosis"),
    ]


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*metric_columns(actual, predicted))


def residual_stats(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*residual_columns(actual, predicted))


def prediction_band(df: DataFrame, actual: str, predicted: str, keys: Sequence[str]) -> DataFrame:
    """Adds ``lower`` and ``upper``: the prediction with 1.96 residual deviations on each side."""
    spread = residual_stats(df, actual, predicted, keys).select(*keys, (1.96 * F.col("residual_std")).alias("_half"))
    out = attach(df, spread, keys)
    p, half = F.col(predicted), F.col("_half")
    return out.withColumns({"lower": p - half, "upper": p + half}).drop("_half")


def pivot_wide(series: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("dataset_id",), time: str = "time", value: str = "value") -> DataFrame:
    """One column per variable; listing the variables keeps the pivot a single aggregation."""
    return series.groupBy(*keys, time).pivot("variable", list(variables)).agg(F.max(value))


def metric_rows(df: DataFrame, metrics: Mapping[str, str] | Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Wide metric columns to tidy (metric, value) rows."""
    return df.unpivot(list(keys), list(metrics), "metric", "value")
