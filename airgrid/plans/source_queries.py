"""Queries for sources, sinks and normalisation."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.plans import views as V
from airgrid.plans.registry import query, r, rounded
from airgrid.plans.scratch import scratch_path
from airgrid.sources import files, tables

GRID = "dataset_id, variable, time, y, x"


@query(
    "A1_read_table",
    "",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n,
        {r('qty=sum(l_quantity)', 'price=CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100')}
        FROM lineitem GROUP BY 1, 2""",
)
def _(spark, sf):
    df = tables.read_table(spark, f"{sf}/lineitem.parquet")
    return rounded(
        df.groupBy("l_returnflag", "l_linestatus").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").alias("qty"),
            (V._cents("l_extendedprice") / 100).alias("price"),
        )
    )


def _round_trip(spark, df, fmt):
    path = scratch_path(spark, f"table.{fmt}") + f".{fmt}"
    tables.write_table(df, path, fmt)
    return tables.read_table(spark, path, fmt, df.schema)


@query(
    "A2_write_table",
    "event_series",
    "SELECT f.fmt, e.dataset_id, e.variable, e.time, e.n FROM event_series e, (VALUES ('parquet'), ('csv'), ('json')) f(fmt)",
)
def _(spark, sf):
    df = V.event_series(spark, sf).select("dataset_id", "variable", "time", "n")
    parts = [_round_trip(spark, df, f).withColumn("fmt", F.lit(f)) for f in ("parquet", "csv", "json")]
    return tables.union_daily(parts)


@query(
    "A3_write_partitioned",
    "event_series",
    """SELECT variable AS product, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month,
       count(*) AS days FROM event_series GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    path = scratch_path(spark, "cube")
    tables.write_partitioned(V.event_series(spark, sf), path)
    return spark.read.parquet(path).groupBy("product", "year", "month").agg(F.count(F.lit(1)).alias("days"))


@query(
    "A4_normalise_points",
    "points",
    """SELECT point_id, source, acq_date, acq_time, value, 'aod' AS product, 'north' AS region,
       CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude,
       CAST(acq_date || ' ' || acq_time AS TIMESTAMP) AS time
       FROM points WHERE TRY_CAST(latitude AS DOUBLE) BETWEEN 32.5 AND 34.0
         AND TRY_CAST(longitude AS DOUBLE) BETWEEN 71.5 AND 73.5""",
)
def _(spark, sf):
    bbox = {"south": 32.5, "north": 34.0, "west": 71.5, "east": 73.5}
    return tables.normalise_points(V.points(spark, sf), bbox, "aod", "north")


@query(
    "A5_union_daily",
    "series event_series",
    """SELECT dataset_id, variable, count(*) AS days, min(time) AS first_day, max(time) AS last_day, count(n) AS counted
       FROM (SELECT dataset_id, variable, time, NULL AS n FROM series
             UNION ALL SELECT dataset_id, variable, time, n FROM event_series) GROUP BY 1, 2""",
)
def _(spark, sf):
    both = tables.union_daily([V.series(spark, sf), V.event_series(spark, sf)])
    return both.groupBy("dataset_id", "variable").agg(
        F.count(F.lit(1)).alias("days"),
        F.min("time").alias("first_day"),
        F.max("time").alias("last_day"),
        F.count("n").alias("counted"),
    )


@query(
    "A5_missing_dates",
    "daily",
    """SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY) g(d)
       WHERE CAST(d AS DATE) NOT IN (SELECT CAST(time AS DATE) FROM daily)""",
)
def _(spark, sf):
    return tables.missing_dates(V.daily(spark, sf), "1994-12-01", "2001-12-31")


@query(
    "A6_assign_grid_coords",
    "grid",
    f"SELECT {GRID}, {r('lat', 'lon')} FROM grid",
)
def _(spark, sf):
    bare = V.grid(spark, sf).select("dataset_id", "variable", "time", "y", "x")
    return rounded(tables.assign_grid_coords(bare, V.BBOX, V.NY, V.NX))


@query(
    "A7_raster_round_trip",
    "grid",
    f"""WITH slices AS (SELECT DISTINCT dataset_id, variable, time FROM grid)
        SELECT s.dataset_id, s.variable, s.time, CAST(gy.y AS INTEGER) AS y, CAST(gx.x AS INTEGER) AS x, {r('value')}
        FROM slices s, range({V.NY}) gy(y), range({V.NX}) gx(x)
        LEFT JOIN grid g ON g.dataset_id = s.dataset_id AND g.variable = s.variable AND g.time = s.time
          AND g.y = gy.y AND g.x = gx.x""",
)
def _(spark, sf):
    rasters = tables.long_to_raster(V.grid(spark, sf), V.NY, V.NX)
    return rounded(tables.raster_to_long(rasters))


#: first and last row and column that the tile query reads at each level
WINDOW = ((1, 4), (2, 8))


@query(
    "A7_tile_pyramid",
    "grid",
    f"""WITH levels AS (SELECT dataset_id, variable, time, l.level, CAST(g.y AS INTEGER) >> l.level AS y, CAST(g.x AS INTEGER) >> l.level AS x, value FROM grid g, (VALUES (0), (1), (2)) l(level) WHERE value IS NOT NULL)
        SELECT dataset_id, variable, time, level, y, x, {r('value=avg(value)')} FROM levels
        WHERE y BETWEEN {WINDOW[0][0]} AND {WINDOW[0][1]} AND x BETWEEN {WINDOW[1][0]} AND {WINDOW[1][1]} GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "tiles")
    tables.write_tiles(tables.tile_pyramid(V.grid(spark, sf), V.NY, V.NX, levels=3, tile=4), path)
    parts = [tables.read_window(spark, path, level, *WINDOW, V.NY, V.NX, tile=4) for level in range(3)]
    return rounded(reduce(DataFrame.unionByName, parts))


@query(
    "A8_select_variable",
    "series event_series",
    """WITH everything AS (SELECT dataset_id, variable, time FROM series UNION ALL
                           SELECT dataset_id, variable, time FROM event_series),
       best AS (SELECT dataset_id, arg_min(variable, printf('%03d', CASE variable WHEN 'aod' THEN 0 WHEN 'so2' THEN 1
                  WHEN 'no2' THEN 2 ELSE 999 END) || variable) AS chosen FROM everything GROUP BY 1)
       SELECT e.* FROM everything e JOIN best b ON e.dataset_id = b.dataset_id AND e.variable = b.chosen""",
)
def _(spark, sf):
    both = tables.union_daily([V.series(spark, sf), V.event_series(spark, sf)])
    return tables.select_variable(both.select("dataset_id", "variable", "time"), ["aod", "so2", "no2"])


@query("A9_lake_manifest")
def _(spark, sf):
    m = files.lake_manifest(spark, sf, "*.parquet", checksum="md5")
    return m.select("name", "size", "file_type", "checksum")


@query("A10_verify_integrity")
def _(spark, sf):
    m = files.lake_manifest(spark, sf, "*.parquet", checksum="sha256")
    expected = m.select("path", F.when(F.col("name") == "orders.parquet", "0").otherwise(F.col("checksum")).alias("checksum"))
    return files.verify_integrity(m, expected)


@query("A11_storage_usage")
def _(spark, sf):
    return files.storage_usage(files.lake_manifest(spark, sf, "*.parquet"))


@query("A12_stale_files")
def _(spark, sf):
    return files.stale_files(files.lake_manifest(spark, sf, "*.parquet"), 0).select("name", "size")


@query(
    "A13_write_report",
    "series",
    f"SELECT dataset_id, variable, count(*) AS n, {r('mean=avg(value)')} FROM series GROUP BY 1, 2",
)
def _(spark, sf):
    stats = V.series(spark, sf).groupBy("dataset_id", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")
    )
    path = scratch_path(spark, "report")
    tables.write_report(rounded(stats), path)
    return spark.read.schema("dataset_id string, variable string, n bigint, mean double").json(path)


_LATEST = "FROM grid g WHERE time = (SELECT max(time) FROM grid h WHERE h.dataset_id = g.dataset_id AND h.variable = g.variable)"


@query("A14_export_cells", "grid", f"SELECT dataset_id, variable AS pollutant, {r('lon', 'lat', 'value')} {_LATEST}")
def _(spark, sf):
    return rounded(tables.export_cells(V.grid(spark, sf)))


@query(
    "A14_export_geojson",
    "grid",
    f"""SELECT dataset_id, variable AS pollutant, 'Feature' AS kind, 'Point' AS shape, variable AS name,
        {r('lon', 'lat', 'value')} {_LATEST}""",
)
def _(spark, sf):
    out = tables.export_cells(V.grid(spark, sf), "geojson")
    field = lambda path: F.get_json_object("feature", path)
    return rounded(
        out.select(
            "dataset_id",
            "pollutant",
            field("$.type").alias("kind"),
            field("$.geometry.type").alias("shape"),
            field("$.properties.pollutant").alias("name"),
            field("$.geometry.coordinates[0]").cast("double").alias("lon"),
            field("$.geometry.coordinates[1]").cast("double").alias("lat"),
            field("$.properties.value").cast("double").alias("value"),
        )
    )


@query(
    "A15_export_dataset_csv",
    "daily",
    """SELECT 'no2' AS target, count(*) AS n_samples, 4 AS n_features, 'so2,co,o3,n' AS feature_names,
       min(time) AS "start", max(time) AS "end", (SELECT count(*) FROM daily) AS csv_rows FROM daily""",
)
def _(spark, sf):
    wide = V.daily(spark, sf).select("time", "no2", "so2", "co", "o3", "n")
    path = scratch_path(spark, "ml")
    tables.export_dataset_csv(wide, "no2", path)
    rows = tables.read_table(spark, f"{path}/data", "csv").agg(F.count(F.lit(1)).alias("csv_rows"))
    meta = spark.read.schema(
        "target string, n_samples bigint, n_features int, feature_names string, start timestamp_ntz, end timestamp_ntz"
    ).json(f"{path}/metadata")
    return meta.join(rows.withColumn("target", F.lit("no2")), "target")
