"""Filters, masks and slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid import KEYS
from airgrid.core import all_of, attach
from airgrid.functions.calendar import seconds
from airgrid.functions.geo import KM_PER_DEGREE, haversine_km, in_bbox

# fixed values: first day of data per sensor
SENSOR_START = {"sentinel5p": "2017-10-13", "modis": "2000-01-01"}
# fixed values: QA bits for dilated cloud, cloud and shadow
CLOUD_BITS = 0b101010
OPTICAL_BANDS = tuple(f"sr_b{i}" for i in range(1, 8))


def clip_bbox(df: DataFrame, bbox: Mapping[str, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cells inside the box, all four edges included; a plain range filter that reaches the scan."""
    return df.where(in_bbox(F.col(lat), F.col(lon), dict(bbox)))


def filter_dates(df: DataFrame, start: str, end: str, closed: bool = False, time: str = "time") -> DataFrame:
    """``[start, end)``, or whole days ``start .. end`` when ``closed``."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz")
    upper = F.col(time) < (hi + F.expr("INTERVAL 1 DAY") if closed else hi)
    return df.where((F.col(time) >= lo) & upper)


def check_date_range(
    requests: DataFrame, sensor: str, now: Column | None = None, start: str = "start", end: str = "end"
) -> DataFrame:
    """Adds ``status``: why a requested range is unusable, or ``ok``."""
    lo, hi = F.col(start).try_cast("date"), F.col(end).try_cast("date")
    today = (now if now is not None else F.current_timestamp()).cast("date")
    status = (
        F.when(lo.isNull() | hi.isNull(), "invalid")
        .when(lo < F.lit(SENSOR_START[sensor]).cast("date"), "before_sensor_start")
        .when(lo > hi, "start_after_end")
        .when(hi > F.date_add(today, 1), "in_future")
        .otherwise("ok")
    )
    return requests.withColumns({"status": status, "valid": status == "ok"})


def mask_quality(df: DataFrame, limit: int = 3, qa: str = "qa", value: str = "value") -> DataFrame:
    """Keep the cell, null its value unless ``qa < limit``; a missing qa masks too."""
    return df.withColumn(value, F.when(F.col(qa) < limit, F.col(value)))


def mask_qc(df: DataFrame, value: str = "value") -> DataFrame:
    """Aerosol QA below 3 where present, else QC below 2, else unchanged."""
    if "aerosol_qa" in df.columns:
        return mask_quality(df, 3, "aerosol_qa", value)
    if "qc" in df.columns:
        return mask_quality(df, 2, "qc", value)
    return df


def mask_cloud_bits(df: DataFrame, qa: str = "qa_pixel", bands: Sequence[str] | None = None) -> DataFrame:
    """Null the optical bands of pixels whose cloud bits are set; other bands are dropped."""
    bands = list(bands or [b for b in OPTICAL_BANDS if b in df.columns])
    clear = F.col(qa).bitwiseAND(F.lit(CLOUD_BITS)) == 0
    other = [c for c in df.columns if c not in bands and not c.startswith(("sr_b", "st_b"))]
    return df.select(*other, *[F.when(clear, F.col(b)).alias(b) for b in bands])


def filter_cloud_cover(scenes: DataFrame, limit: float = 20.0) -> DataFrame:
    return scenes.where(F.col("cloud_cover") < limit)


def points_in_region(
    points: DataFrame, bbox: Mapping[str, float], lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    return clip_bbox(points, bbox, lat, lon)


def points_in_regions(
    points: DataFrame,
    regions: Mapping[str, Mapping[str, float]],
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """One row per point and region that holds it; the region list is part of the expression."""
    hits = F.array_compact(
        F.array(*[F.when(in_bbox(F.col(lat), F.col(lon), dict(b)), F.lit(name)) for name, b in regions.items()])
    )
    return points.withColumn("region_id", F.explode(hits))


def points_within_radius(
    points: DataFrame, centre: tuple[float, float], km: float, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Points within ``km`` of the centre; a latitude band goes to the scan before the exact test."""
    band = 1.001 * km / KM_PER_DEGREE
    distance = haversine_km(F.lit(centre[0]), F.lit(centre[1]), F.col(lat), F.col(lon))
    near = points.where(F.col(lat).between(centre[0] - band, centre[0] + band))
    return near.withColumn("distance_km", distance).where(F.col("distance_km") <= km)


def _at_time(df: DataFrame, keys: Sequence[str], pick: Column, time: str) -> DataFrame:
    chosen = df.groupBy(*keys).agg(pick.alias("_at"))
    return attach(df, chosen, keys).where(F.col(time) == F.col("_at")).drop("_at")


def latest_slice(cube: DataFrame, keys: Sequence[str] = KEYS, time: str = "time") -> DataFrame:
    return _at_time(cube, keys, F.max(time), time)


def first_slice(cube: DataFrame, keys: Sequence[str] = KEYS, time: str = "time") -> DataFrame:
    return _at_time(cube, keys, F.min(time), time)


def nearest_slice(cube: DataFrame, at: str, keys: Sequence[str] = KEYS, time: str = "time") -> DataFrame:
    """Slice whose time is closest to ``at``, the earlier one on ties."""
    away = F.abs(seconds(F.col(time)) - seconds(F.lit(at).cast("timestamp_ntz")))
    return _at_time(cube, keys, F.min_by(time, F.struct(away, F.col(time))), time)


def stride_sample(
    cube: DataFrame, n: int = 20, positive: bool = False, keys: Sequence[str] = KEYS, rows: int | None = None
) -> DataFrame:
    """Every k-th index on both axes, k = max(1, rows // n), of valid (or positive) cells.

    ``rows`` is the grid height; where it is not given it is taken from the cells of each key.
    """
    if rows is None:
        sized = attach(cube, cube.groupBy(*keys).agg((F.max("y") + 1).alias("_ny")), keys)
    else:
        sized = cube.withColumn("_ny", F.lit(rows))
    step = F.greatest(F.floor(F.col("_ny") / n), F.lit(1))
    usable = F.col("value") > 0 if positive else F.col("value").isNotNull()
    return sized.where((F.col("y") % step == 0) & (F.col("x") % step == 0) & usable).drop("_ny")


def find_variable(df: DataFrame, name: str, dataset: str = "dataset_id") -> DataFrame:
    """Per dataset the first variable (by name) that contains ``name``, ignoring case."""
    hits = df.where(F.lower("variable").contains(name.lower()))
    return hits.groupBy(dataset).agg(F.min("variable").alias("variable"))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def replace_infinite(df: DataFrame, *columns: str) -> DataFrame:
    """Infinite values become null in the given (default: all) floating columns."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    inf = float("inf")
    return df.withColumns(
        {c: F.when(~F.col(c).isin(inf, -inf), F.col(c)) for c in (columns or floats) if c in floats}
    )


def availability(
    scenes: DataFrame, start: str, end: str, time: str = "time_start", keys: Sequence[str] = ()
) -> DataFrame:
    """Number of scenes in ``[start, end)`` per key and whether there is any."""
    inside = (F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz"))
    return scenes.groupBy(*keys).agg(
        F.count_if(inside).alias("scenes"), (F.count_if(inside) > 0).alias("available")
    )


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("all_of",)]
