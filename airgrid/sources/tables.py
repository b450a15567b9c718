"""Reading, normalising and writing of tables, cubes and point records."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid import KEYS
from airgrid.core import attach, by, same_keys
from airgrid.functions.geo import in_bbox
from airgrid.operators.slicing import latest_slice

#: side of a stored tile, in cells
TILE = 256

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json"}

CUBE_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("qa", T.IntegerType()),
    ]
)


def format_of(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/*"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file format: {ext or path}")
    return FORMATS[ext]


def read_table(
    spark: SparkSession, path: str | Sequence[str], fmt: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """Load parquet, csv or json; the format follows the extension unless given.

    Text formats want an explicit ``schema``: without one every csv column is read as text, so that
    no extra inference pass over the data takes place.
    """
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or format_of(paths[0])
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(paths)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    compression: str = "gzip",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    writer = df.write.mode(mode).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    fmt = fmt or format_of(path)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_partitioned(
    df: DataFrame, base: str, product: str = "variable", time: str = "time", rows_per_file: int = 2_000_000, **options
) -> None:
    """product / year / month directories, so that later date and product filters prune partitions.

    A directory's rows are counted first and spread over as many tasks as they fill files of
    ``rows_per_file``, by their content, so that a hot product or month is the work of many tasks.
    """
    out = df.withColumns({"product": F.col(product), "year": F.year(time), "month": F.month(time)})
    folder = ["product", "year", "month"]
    files = out.groupBy(*folder).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    spread = F.pmod(F.xxhash64(*df.columns), F.col("_files"))
    dealt = same_keys(out, files, folder).withColumn("_file", spread).repartition(*folder, "_file").drop("_files", "_file")
    write_table(dealt, base, "parquet", partition_by=folder, **options)


def normalise_points(
    df: DataFrame, bbox: Mapping[str, float], product: str, region: str, sort: bool = True
) -> DataFrame:
    """Point records with a timestamp, numeric coordinates inside ``bbox`` and literal tags."""
    stamp = F.try_to_timestamp(F.concat_ws(" ", "acq_date", "acq_time"), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = df.withColumns(
        {
            "time": stamp.cast("timestamp_ntz"),
            "latitude": F.col("latitude").try_cast("double"),
            "longitude": F.col("longitude").try_cast("double"),
            "product": F.lit(product),
            "region": F.lit(region),
        }
    ).where(in_bbox(F.col("latitude"), F.col("longitude"), dict(bbox)))
    return out.orderBy("time") if sort else out


def union_daily(dfs: Sequence[DataFrame]) -> DataFrame:
    """One collection out of per-day (or per-source) datasets; columns missing somewhere become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def missing_dates(df: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """Calendar days of [start, end] without a row."""
    calendar = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    seen = df.select(F.to_date(time).alias("day")).distinct()
    return calendar.join(seen, "day", "left_anti")


def grid_coordinate(index: Column, low: float, high: float, n: int) -> Column:
    """``linspace(low, high, n)[index]``."""
    return F.lit(float(low)) if n == 1 else low + index * (high - low) / (n - 1)


def assign_grid_coords(df: DataFrame, bbox: Mapping[str, float], ny: int, nx: int) -> DataFrame:
    return df.withColumns(
        {
            "lat": grid_coordinate(F.col("y"), bbox["south"], bbox["north"], ny),
            "lon": grid_coordinate(F.col("x"), bbox["west"], bbox["east"], nx),
        }
    )


def raster_to_long(df: DataFrame, raster: str = "raster") -> DataFrame:
    """``array<array<double>>`` slices to one row per cell."""
    keep = [c for c in df.columns if c != raster]
    rows = df.select(*keep, F.posexplode(raster).alias("y", "_row"))
    return rows.select(*keep, "y", F.posexplode("_row").alias("x", "value"))


def _dense(df: DataFrame, group: Sequence[str], axis: str, n: int, item: str, out: str) -> DataFrame:
    """Array of length ``n`` of the items of each group, nulls where an index is absent."""
    w = by(group, axis)
    none = F.lit(None).cast(df.schema[item].dataType)
    lead = F.when(F.lag(axis).over(w).isNull(), F.array_repeat(none, F.col(axis))).otherwise(F.array_repeat(none, 0))
    gap = F.coalesce(F.lead(axis).over(w), F.lit(n)) - F.col(axis) - 1
    piece = F.concat(lead, F.array(F.col(item)), F.array_repeat(none, gap))
    return (
        df.withColumn("_piece", piece)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct(axis, "_piece"))).alias("_parts"))
        .select(*group, F.flatten(F.transform("_parts", lambda p: p["_piece"])).alias(out))
    )


def long_to_raster(df: DataFrame, ny: int, nx: int, keys: Sequence[str] = (*KEYS, "time")) -> DataFrame:
    """One row per slice holding its cells as rows of columns; a slice is bounded by the grid size."""
    cells = df.select(*keys, "y", "x", "value")
    rows = _dense(cells, [*keys, "y"], "x", nx, "value", "_row")
    slices = _dense(rows, list(keys), "y", ny, "_row", "raster")
    blank = F.array_repeat(F.lit(None).cast("double"), nx)
    return slices.withColumn("raster", F.transform("raster", lambda row: F.coalesce(row, blank)))


def _tile_shape(ny: int, nx: int, tile: int) -> tuple[int, int]:
    return min(tile, ny), min(tile, nx)


def tile_pyramid(
    cube: DataFrame, ny: int, nx: int, levels: int = 1, tile: int = TILE, keys: Sequence[str] = (*KEYS, "time"), value: str = "value"
) -> DataFrame:
    """``keys, level, ty, tx, values``: slices as tiles of at most ``tile`` x ``tile`` cells, at ``levels`` levels of detail.

    Level 0 holds the cells themselves, each further level the means over 2 x 2 times as many of them (of those that
    have a value).  ``values`` lists a tile's cells row by row, null where there is none.  No row and no group is
    larger than a tile, however large the slices are; a tile without a cell is left out.  Expects one row per cell.
    """
    keys = list(keys)
    h, w = _tile_shape(ny, nx, tile)
    held = cube.select(*keys, "y", "x", F.col(value).cast("double").alias("_sum"), F.col(value).isNotNull().cast("long").alias("_n"))
    parts = [held]
    for _ in range(1, levels):
        coarse = [F.shiftright(F.col(c).cast("int"), 1).alias(c) for c in ("y", "x")]
        parts.append(parts[-1].groupBy(*keys, *coarse).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")))
    cells = reduce(DataFrame.unionByName, [p.withColumn("level", F.lit(i)) for i, p in enumerate(parts)])
    place = {"ty": F.floor(F.col("y") / h).cast("int"), "tx": F.floor(F.col("x") / w).cast("int")}
    at = (F.pmod("y", F.lit(h)) * w + F.pmod("x", F.lit(w))).cast("int")
    mean = F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))
    cells = cells.withColumns({**place, "_at": at, "_mean": mean})
    return _dense(cells.select(*keys, "level", "ty", "tx", "_at", "_mean"), [*keys, "level", "ty", "tx"], "_at", h * w, "_mean", "values")


def tiles_to_long(tiles: DataFrame, ny: int, nx: int, tile: int = TILE) -> DataFrame:
    """The cells of tiles that have a value: the columns of ``tiles`` with ``y, x, value`` (in cells of the level) for ``ty, tx, values``."""
    h, w = _tile_shape(ny, nx, tile)
    keep = [c for c in tiles.columns if c not in ("ty", "tx", "values")]
    rows = tiles.select(*keep, "ty", "tx", F.posexplode("values").alias("_at", "value")).where(F.col("value").isNotNull())
    y, x = F.col("ty") * h + F.floor(F.col("_at") / w), F.col("tx") * w + F.col("_at") % w
    return rows.select(*keep, y.cast("int").alias("y"), x.cast("int").alias("x"), "value")


def write_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with a folder per level, in the order of places, so that readers of a window skip what lies outside."""
    tiles.sortWithinPartitions("level", "ty", "tx").write.mode(mode).partitionBy("level").parquet(path)


def read_window(
    spark: SparkSession, path: str, level: int, ys: tuple[int, int], xs: tuple[int, int], ny: int, nx: int, tile: int = TILE
) -> DataFrame:
    """The cells of one level from ``ys`` and ``xs`` (first and last, in cells of the level); reads no other level or tile."""
    h, w = _tile_shape(ny, nx, tile)
    tiles = spark.read.parquet(path).where(F.col("level") == level)
    tiles = tiles.where(F.col("ty").between(ys[0] // h, ys[1] // h) & F.col("tx").between(xs[0] // w, xs[1] // w))
    return tiles_to_long(tiles, ny, nx, tile).where(F.col("y").between(*ys) & F.col("x").between(*xs))


def select_variable(cube: DataFrame, priority: Sequence[str], dataset: str = "dataset_id") -> DataFrame:
    """Per dataset keep the first variable of ``priority`` that is present, else its first by name."""
    rank = F.lit(999)
    for i, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col("variable") == name, F.lit(i)).otherwise(rank)
    present = cube.groupBy(dataset, "variable").agg(F.count(F.lit(1)).alias("_n"))
    chosen = present.groupBy(dataset).agg(F.min_by("variable", F.struct(rank, "variable")).alias("_chosen"))
    return attach(cube, chosen, [dataset]).where(F.col("variable") == F.col("_chosen")).drop("_chosen")


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Result table as JSON lines."""
    df.write.mode(mode).json(path)


def export_cells(cube: DataFrame, fmt: str = "csv", keys: Sequence[str] = KEYS) -> DataFrame:
    """Valid cells of the latest slice, as columns or as one GeoJSON feature per row."""
    cells = latest_slice(cube, keys).where(F.col("value").isNotNull())
    rows = cells.select(*[k for k in keys if k != "variable"], "lon", "lat", "value", F.col("variable").alias("pollutant"))
    if fmt == "csv":
        return rows
    if fmt != "geojson":
        raise ValueError(f"unsupported export format: {fmt}")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("value", "pollutant").alias("properties"),
    )
    return rows.select(*[k for k in keys if k != "variable"], "pollutant", F.to_json(feature).alias("feature"))


def dataset_metadata(features: DataFrame, target: str, time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: samples, features, feature names and time range of an ML-ready table."""
    names = [c for c in features.columns if c not in (target, time, *keys)]
    return features.groupBy(*keys).agg(
        F.lit(target).alias("target"),
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(len(names)).alias("n_features"),
        F.lit(",".join(names)).alias("feature_names"),
        F.min(time).alias("start"),
        F.max(time).alias("end"),
    )


def export_dataset_csv(features: DataFrame, target: str, path: str, time: str = "time") -> None:
    """ML-ready table and its metadata row below ``path``."""
    write_table(features, f"{path}/data", "csv")
    write_report(dataset_metadata(features, target, time), f"{path}/metadata")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Window",)]
