"""Alignment of series, fusion and resampling of grids."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.core import attach, same_keys
from airgrid.functions.geo import KM_PER_DEGREE, from_utm, to_utm, wind_direction, wind_speed
from airgrid.operators.aggregates import merge_on, pivot_wide
from airgrid.operators.slicing import latest_slice
from airgrid.sources.tables import grid_coordinate, union_daily

METRES_PER_DEGREE = 111_000.0


def align_inner(series: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("dataset_id",), time: str = "time", value: str = "value") -> DataFrame:
    """Times at which every variable has a value, one column per variable."""
    return pivot_wide(series, variables, keys, time, value).na.drop("any", subset=list(variables))


def align_outer(series: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("dataset_id",), time: str = "time", value: str = "value") -> DataFrame:
    return pivot_wide(series, variables, keys, time, value)


def common_variables(cubes: Sequence[DataFrame], dataset: str = "dataset_id") -> DataFrame:
    """(dataset, variable) pairs that occur in all cubes."""
    tagged = union_daily([c.select(dataset, "variable").withColumn("_src", F.lit(i)) for i, c in enumerate(cubes)])
    per_source = tagged.groupBy(dataset, "variable", "_src").agg(F.count(F.lit(1)).alias("_n"))
    sources = per_source.groupBy(dataset, "variable").agg(F.count(F.lit(1)).alias("_sources"))
    return sources.where(F.col("_sources") == len(cubes)).drop("_sources")


def fuse_weighted(
    cubes: Sequence[DataFrame], weights: Sequence[float] | None = None, keys: Sequence[str] = KEYS,
    time: str = "time", value: str = "value", fill: float | None = 0.0,
) -> DataFrame:
    """Per-cell weighted mean of cubes on one grid, nulls ignored, over the variables all cubes have.

    The first cube is the reference: only its cells appear.  Cells without any valid value get
    ``fill``.  Fewer than two cubes come back unchanged.
    """
    if len(cubes) < 2:
        return cubes[0]
    weights = list(weights or [1.0] * len(cubes))
    cell = [*keys, time, "y", "x"]
    parts = [
        c.select(*cell, value, F.lit(float(w)).alias("_w"), F.lit(i == 0).alias("_reference"))
        for i, (c, w) in enumerate(zip(cubes, weights, strict=True))
    ]
    w = F.when(F.col(value).isNotNull(), F.col("_w"))
    fused = union_daily(parts).groupBy(*cell).agg(
        (F.sum(F.col(value) * F.col("_w")) / F.nullif(F.sum(w), F.lit(0.0))).alias(value),
        F.max("_reference").alias("_reference"),
    )
    fused = fused.where("_reference").drop("_reference")
    shared = common_variables(cubes, keys[0])
    out = attach(fused, shared.withColumn("_shared", F.lit(True)), [keys[0], "variable"]).drop("_shared")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(fill))) if fill is not None else out


def mosaic(cube: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Latest valid value per cell."""
    return cube.where(F.col(value).isNotNull()).groupBy(*keys, "y", "x").agg(
        F.max_by(value, time).alias(value), F.max(time).alias(time)
    )


def scene_join(cube: DataFrame, scenes: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Cells whose scene passes the catalogue's filters; ``on`` maps cube columns to scene columns.

    The catalogue is reduced to its distinct join values first and joined without copies; adaptive execution splits
    the tasks of a scene with very many cells.
    """
    right = scenes.select(*[F.col(s).alias(c) for c, s in on.items()]).distinct()
    return same_keys(cube, right, list(on))


def variable_pairs(df: DataFrame, dataset: str = "dataset_id", ordered: bool = True) -> DataFrame:
    """Pairs of a dataset's distinct variables; the variables of a dataset are a short list."""
    names = df.groupBy(dataset).agg(F.array_sort(F.collect_set("variable")).alias("_v"))
    left = names.select(dataset, "_v", F.explode("_v").alias("variable_a"))
    pairs = left.select(dataset, "variable_a", F.explode("_v").alias("variable_b"))
    keep = F.col("variable_a") != F.col("variable_b") if ordered else F.col("variable_a") < F.col("variable_b")
    return pairs.where(keep)


# ------------------------------------------------------------------ grids


def linspace_axis(spark: SparkSession, name: str, coord: str, low: float, high: float, n: int) -> DataFrame:
    return spark.range(n).select(
        F.col("id").cast("int").alias(name), grid_coordinate(F.col("id"), low, high, n).alias(coord)
    )


def grid_points(spark: SparkSession, bbox: Mapping[str, float], km: float) -> DataFrame:
    """Regular points from the south-west corner in steps of ``km``, both ends included."""
    dlat = km / KM_PER_DEGREE
    dlon = km / (KM_PER_DEGREE * math.cos(math.radians((bbox["north"] + bbox["south"]) / 2)))
    ny = int(math.floor((bbox["north"] - bbox["south"]) / dlat + 1e-9)) + 1
    nx = int(math.floor((bbox["east"] - bbox["west"]) / dlon + 1e-9)) + 1
    return _mesh(spark, ny, nx).select(
        "y", "x", (bbox["south"] + F.col("y") * dlat).alias("lat"), (bbox["west"] + F.col("x") * dlon).alias("lon")
    )


def _mesh(spark: SparkSession, ny: int, nx: int) -> DataFrame:
    """All (y, x) of a grid, generated in parallel from one range."""
    return spark.range(ny * nx).select(
        F.expr(f"id div {nx}").cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x")
    )


def mesh(spark: SparkSession, bbox: Mapping[str, float], ny: int, nx: int) -> DataFrame:
    return _mesh(spark, ny, nx).withColumns(
        {
            "lat": grid_coordinate(F.col("y"), bbox["south"], bbox["north"], ny),
            "lon": grid_coordinate(F.col("x"), bbox["west"], bbox["east"], nx),
        }
    )


def analysis_grid(spark: SparkSession, bbox: Mapping[str, float], metres: float = 1000) -> DataFrame:
    """Grid of ``int(range * 111 km / resolution)`` points on both axes."""
    ny = int((bbox["north"] - bbox["south"]) * METRES_PER_DEGREE / metres)
    nx = int((bbox["east"] - bbox["west"]) * METRES_PER_DEGREE / metres)
    return mesh(spark, bbox, ny, nx)


def target_shape(bbox: Mapping[str, float], metres: float) -> tuple[int, int]:
    """Grid size of a resampling to ``metres``."""
    mid = math.radians((bbox["south"] + bbox["north"]) / 2)
    ny = int((bbox["north"] - bbox["south"]) * METRES_PER_DEGREE / metres)
    nx = int((bbox["east"] - bbox["west"]) * METRES_PER_DEGREE * math.cos(mid) / metres)
    return ny, nx


def corner_weights(source_y, source_x, ny: int, nx: int):
    """The four source cells around a fractional source index and their bilinear weights."""
    y0 = F.least(F.floor(source_y), F.lit(ny - 2)).cast("int")
    x0 = F.least(F.floor(source_x), F.lit(nx - 2)).cast("int")
    fy, fx = source_y - y0, source_x - x0

    def corner(dy, dx):
        wy, wx = (fy if dy else 1 - fy), (fx if dx else 1 - fx)
        return F.struct((y0 + dy).alias("sy"), (x0 + dx).alias("sx"), (wy * wx).alias("w"))

    return F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)])


def interpolate(
    cube: DataFrame, targets: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Bilinear values at target cells ``(y, x, ..., sy, sx, w)``, null where a corner is missing.

    Each source cell meets the targets it contributes to through an equi join on its grid index and
    one aggregation sums the weighted corners.  The target table depends on the grid alone, not on
    the number of slices.  A corner of weight zero is not needed, hence its absence does no harm.
    """
    needed = targets.where(F.col("w") > 0)
    corners = needed.groupBy("y", "x").agg(F.count(F.lit(1)).alias("_need"))
    wanted = needed.join(corners, ["y", "x"]).withColumnsRenamed({"y": "_ty", "x": "_tx"})
    source = cube.select(*keys, time, F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("_v"))
    hit = attach(source, wanted.groupBy("sy", "sx").agg(
        F.collect_list(F.struct("_ty", "_tx", "lat", "lon", "w", "_need")).alias("_targets")
    ), ["sy", "sx"])
    parts = hit.select(*keys, time, "_v", F.explode("_targets").alias("_t")).select(*keys, time, "_v", "_t.*")
    return (
        parts.groupBy(*keys, time, F.col("_ty").alias("y"), F.col("_tx").alias("x"))
        .agg(
            F.max("lat").alias("lat"),
            F.max("lon").alias("lon"),
            F.when(F.count("_v") == F.max("_need"), F.sum(F.col("_v") * F.col("w"))).alias(value),
        )
    )


def resample_to(
    cube: DataFrame, bbox: Mapping[str, float], shape: tuple[int, int], target_shape_: tuple[int, int], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Linear interpolation in both axes onto ``linspace`` axes over the same box."""
    (ny, nx), (my, mx) = shape, target_shape_
    sy = F.col("y") * ((ny - 1) / (my - 1)) if my > 1 else F.lit(0.0)
    sx = F.col("x") * ((nx - 1) / (mx - 1)) if mx > 1 else F.lit(0.0)
    targets = mesh(cube.sparkSession, bbox, my, mx)
    targets = targets.withColumn("_c", F.explode(corner_weights(sy, sx, ny, nx))).select("y", "x", "lat", "lon", "_c.*")
    return interpolate(cube, targets, keys)


def resample_bilinear(
    cube: DataFrame, bbox: Mapping[str, float], shape: tuple[int, int], metres: float, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Resample a cube of known grid to a resolution in metres."""
    return resample_to(cube, bbox, shape, target_shape(bbox, metres), keys)


def align_to_reference(
    cube: DataFrame, bbox: Mapping[str, float], shape: tuple[int, int], reference: Mapping[str, object], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Onto the reference grid ``{"bbox": ..., "shape": (ny, nx)}``; target cells outside the source are null-free only inside it."""
    box, (my, mx) = dict(reference["bbox"]), reference["shape"]
    (ny, nx) = shape
    targets = mesh(cube.sparkSession, box, my, mx)
    sy = (F.col("lat") - bbox["south"]) / (bbox["north"] - bbox["south"]) * (ny - 1)
    sx = (F.col("lon") - bbox["west"]) / (bbox["east"] - bbox["west"]) * (nx - 1)
    inside = sy.between(0, ny - 1) & sx.between(0, nx - 1)
    targets = targets.where(inside).withColumn("_c", F.explode(corner_weights(sy, sx, ny, nx)))
    return interpolate(cube, targets.select("y", "x", "lat", "lon", "_c.*"), keys)


def reproject(
    cube: DataFrame, bbox: Mapping[str, float], shape: tuple[int, int], zone: int, metres: float, keys: Sequence[str] = KEYS
) -> DataFrame:
    """WGS84 grid to a UTM grid that covers it: each UTM cell is projected back and interpolated.

    Adds ``easting`` and ``northing``; ``lat``/``lon`` are those of the UTM cell.
    """
    spark, (ny, nx) = cube.sparkSession, shape
    z = F.lit(zone)
    # the outline of the box bounds the projected grid; it has a fixed number of points
    steps = [i / 32 for i in range(33)]
    ring = [
        (bbox["south"] + a * (bbox["north"] - bbox["south"]), bbox["west"] + b * (bbox["east"] - bbox["west"]))
        for a in steps for b in steps if a in (0.0, 1.0) or b in (0.0, 1.0)
    ]
    outline = spark.createDataFrame(ring, "lat double, lon double")
    e, n = to_utm(F.col("lat"), F.col("lon"), z)
    row = outline.select(e.alias("e"), n.alias("n")).agg(F.min("e"), F.max("e"), F.min("n"), F.max("n")).first()
    west, east, south, north = row
    mx, my = int((east - west) / metres) + 1, int((north - south) / metres) + 1
    targets = _mesh(spark, my, mx).withColumns(
        {"easting": west + F.col("x") * metres, "northing": south + F.col("y") * metres}
    )
    lat, lon = from_utm(F.col("easting"), F.col("northing"), z)
    sy = (F.col("lat") - bbox["south"]) / (bbox["north"] - bbox["south"]) * (ny - 1)
    sx = (F.col("lon") - bbox["west"]) / (bbox["east"] - bbox["west"]) * (nx - 1)
    targets = targets.withColumns({"lat": lat, "lon": lon}).where(sy.between(0, ny - 1) & sx.between(0, nx - 1))
    targets = targets.withColumn("_c", F.explode(corner_weights(sy, sx, ny, nx))).select("y", "x", "lat", "lon", "_c.*")
    out = interpolate(cube, targets, keys)
    return out.withColumns({"easting": west + F.col("x") * metres, "northing": south + F.col("y") * metres})


def wind_overlay(
    cube: DataFrame, wind: DataFrame, bbox: Mapping[str, float], shape: tuple[int, int], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Latest slice with the mean wind of the points nearest to each cell.

    ``wind`` has ``lat, lon, u, v``; a point belongs to the cell whose centre it is closest to.
    """
    (ny, nx) = shape
    sy = F.round((F.col("lat") - bbox["south"]) / (bbox["north"] - bbox["south"]) * (ny - 1)).cast("int")
    sx = F.round((F.col("lon") - bbox["west"]) / (bbox["east"] - bbox["west"]) * (nx - 1)).cast("int")
    cells = wind.groupBy(sy.alias("y"), sx.alias("x")).agg(
        F.avg("u").alias("u"), F.avg("v").alias("v"), F.count(F.lit(1)).alias("wind_points")
    )
    cells = cells.withColumns({"speed": wind_speed(F.col("u"), F.col("v")), "direction": wind_direction(F.col("u"), F.col("v"))})
    return attach(latest_slice(cube, keys), cells, ["y", "x"], "left")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("merge_on",)]
