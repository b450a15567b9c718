"""Report-ready tables: the data behind charts, maps and dashboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.core import attach, exact_quantiles
from airgrid.functions.calendar import season_number
from airgrid.functions.levels import ALERT_THRESHOLDS, QUALITY_BANDS, alert_level, quality_band, tripped_threshold
from airgrid.operators.aggregates import QUARTILES, cdf, completeness, histogram, merge_on, pivot_wide
from airgrid.operators.slicing import latest_slice
from airgrid.operators.windows import current_value, recent_trend


def dashboard_summary(
    series: DataFrame, bands: Mapping = QUALITY_BANDS, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Current value, recent trend, statistics, completeness and quality band per pollutant."""
    valid = series.where(F.col(value).isNotNull())
    stats = valid.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    out = merge_on(stats, exact_quantiles(valid, keys, value, {"median": 0.5}), keys)
    out = merge_on(out, current_value(valid, keys, time, value), keys)
    out = merge_on(out, recent_trend(valid, keys, time, value).select(*keys, "trend_pct", "direction"), keys)
    out = merge_on(out, completeness(valid, keys, time, value), keys)
    return out.withColumn("current_level", quality_band(F.col("variable"), F.col("current_value"), bands))


def alert_table(series: DataFrame, thresholds: Mapping = ALERT_THRESHOLDS, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Current value, alert level and the threshold it tripped; pollutants without thresholds drop out."""
    now = current_value(series, keys, time, value)
    out = now.withColumn("level", alert_level(F.col("variable"), F.col("current_value"), thresholds))
    out = out.where(F.col("level").isNotNull())
    return out.withColumn("threshold", tripped_threshold(F.col("variable"), F.col("level"), thresholds))


def chart_series(series: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Series with its mean and one sample deviation on each side as reference lines."""
    stats = series.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    out = attach(series, stats, keys)
    return out.withColumns({"upper": F.col("mean") + F.col("_sd"), "lower": F.col("mean") - F.col("_sd")}).drop("_sd")


def stacked_series(series: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("dataset_id",), time: str = "time") -> DataFrame:
    return pivot_wide(series, variables, keys, time)


def distribution_table(df: DataFrame, bins: int = 50, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Histogram bins with the summary statistics of their variable."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"),
    )
    stats = merge_on(stats, exact_quantiles(df, keys, value, QUARTILES), keys)
    return merge_on(histogram(df, bins, keys, value), stats, keys)


def seasonal_table(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Rows ``kind, period, mean, n`` for months, seasons (1 = winter) and days of the year."""
    parts = []
    for kind, period in (("month", F.month(time)), ("season", season_number(F.col(time))), ("day_of_year", F.dayofyear(time))):
        part = series.groupBy(*keys, period.alias("period")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
        parts.append(part.withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def animation_frames(cube: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Every valid cell with its frame number, the latest slice being frame 0."""
    from airgrid.core import row_position

    times = cube.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_m")).drop("_m")
    frames = row_position(times, keys, time, "_pos", "_n").select(*keys, time, (F.col("_n") - 1 - F.col("_pos")).alias("frame"))
    valid = cube.where(F.col(value).isNotNull())
    return attach(valid, frames, [*keys, time]).select(*keys, "frame", time, "lat", "lon", value)


def compare_slices(cube: DataFrame, variables: Sequence[str], dataset: str = "dataset_id", value: str = "value") -> DataFrame:
    """Latest slice of several pollutants side by side."""
    cells = latest_slice(cube.where(F.col("variable").isin(*variables)), KEYS)
    return cells.groupBy(dataset, "y", "x").pivot("variable", list(variables)).agg(F.max(value))


def before_after_diff(orig: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Cell-wise original, new and difference."""
    cell = [*keys, time, "y", "x"]
    a, b = orig.select(*cell, F.col(value).alias("original")), new.select(*cell, F.col(value).alias("changed"))
    return a.join(b, cell).withColumn("difference", F.col("changed") - F.col("original"))


def middle_row_profile(diff: DataFrame, rows: int) -> DataFrame:
    """The middle grid row of a before/after table."""
    return diff.where(F.col("y") == rows // 2)


def before_after_histograms(orig: DataFrame, new: DataFrame, bins: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both histograms with their cumulative form, tagged ``original`` / ``changed``."""
    a = cdf(histogram(orig, bins, keys), keys).withColumn("version", F.lit("original"))
    return a.unionByName(cdf(histogram(new, bins, keys), keys).withColumn("version", F.lit("changed")))


__all__ = [n for n in dir() if not n.startswith("_")]
