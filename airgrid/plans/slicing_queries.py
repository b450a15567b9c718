"""Queries for filters, masks and slices."""

from pyspark.sql import functions as F

from airgrid.operators import slicing as S
from airgrid.plans import views as V
from airgrid.plans.registry import query, r, rounded

CELL = "dataset_id, variable, time, y, x"
INNER = {"south": 33.1844, "north": 34.1844, "west": 72.1479, "east": 73.9479}
NUMERIC_POINTS = "np AS (SELECT point_id, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon FROM points)"


def _cell(df, *more):
    return rounded(df.select("dataset_id", "variable", "time", "y", "x", "value", *more))


def _numeric_points(spark, sf):
    p = V.points(spark, sf)
    return p.select(
        "point_id",
        F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lon"),
    )


@query(
    "B1_clip_bbox",
    "grid",
    f"SELECT {CELL}, {r('value')} FROM grid WHERE lat BETWEEN 33.1844 AND 34.1844 AND lon BETWEEN 72.1479 AND 73.9479",
)
def _(spark, sf):
    return _cell(S.clip_bbox(V.grid(spark, sf), INNER))


@query(
    "B2_filter_dates",
    "grid",
    f"SELECT {CELL}, {r('value')} FROM grid WHERE time >= TIMESTAMP '1996-03-01' AND time < TIMESTAMP '1997-03-01'",
)
def _(spark, sf):
    return _cell(S.filter_dates(V.grid(spark, sf), "1996-03-01", "1997-03-01"))


@query(
    "B2_filter_dates_closed",
    "series",
    f"""SELECT dataset_id, variable, time, {r('value')} FROM series
        WHERE time >= TIMESTAMP '1996-03-01' AND time < TIMESTAMP '1996-07-01'""",
)
def _(spark, sf):
    return rounded(S.filter_dates(V.series(spark, sf), "1996-03-01", "1996-06-30", closed=True))


@query(
    "B3_check_date_range",
    "",
    """WITH req AS (SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN 'soon'
                    ELSE strftime(o_orderdate + INTERVAL 6000 DAY, '%Y-%m-%d') END AS "start",
                    strftime(o_orderdate + to_days(CAST(6000 + o_custkey % 9 - 2 AS INTEGER)), '%Y-%m-%d') AS "end" FROM orders),
       s AS (SELECT *, CASE WHEN TRY_CAST("start" AS DATE) IS NULL OR TRY_CAST("end" AS DATE) IS NULL THEN 'invalid'
                WHEN TRY_CAST("start" AS DATE) < DATE '2017-10-13' THEN 'before_sensor_start'
                WHEN TRY_CAST("start" AS DATE) > TRY_CAST("end" AS DATE) THEN 'start_after_end'
                WHEN TRY_CAST("end" AS DATE) > DATE '2018-01-02' THEN 'in_future' ELSE 'ok' END AS status FROM req)
       SELECT *, status = 'ok' AS valid FROM s""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    day = lambda shift: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), shift), "yyyy-MM-dd")
    req = o.select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 50 == 0, "soon").otherwise(day(6000)).alias("start"),
        day((6000 + F.col("o_custkey") % 9 - 2).cast("int")).alias("end"),
    )
    return S.check_date_range(req, "sentinel5p", now=F.lit("2018-01-01").cast("timestamp"))


@query(
    "B4_mask_quality",
    "grid",
    f"SELECT {CELL}, qa, {r('value=CASE WHEN qa < 3 THEN value END')} FROM grid",
)
def _(spark, sf):
    return _cell(S.mask_quality(V.grid(spark, sf)), "qa")


@query(
    "B5_mask_qc",
    "grid",
    f"""SELECT {CELL}, 'aerosol_qa' AS rule, {r('value=CASE WHEN qa < 3 THEN value END')} FROM grid UNION ALL
        SELECT {CELL}, 'qc', {r('value=CASE WHEN qa < 2 THEN value END')} FROM grid UNION ALL
        SELECT {CELL}, 'none', {r('value')} FROM grid""",
)
def _(spark, sf):
    g = V.grid(spark, sf).select("dataset_id", "variable", "time", "y", "x", "value", "qa")
    parts = [
        _cell(S.mask_qc(g.withColumnRenamed("qa", c)), F.lit(c).alias("rule")) for c in ("aerosol_qa", "qc")
    ]
    return parts[0].union(parts[1]).union(_cell(S.mask_qc(g.drop("qa")), F.lit("none").alias("rule")))


@query(
    "B6_mask_cloud_bits",
    "scenes",
    """SELECT scene_id, time_start, cloud_cover, qa_pixel, region,
       CASE WHEN (qa_pixel & 42) = 0 THEN sr_b1 END AS sr_b1 FROM scenes""",
)
def _(spark, sf):
    return S.mask_cloud_bits(V.scenes(spark, sf).withColumn("st_b10", F.lit(1.0)))


@query("B7_filter_cloud_cover", "scenes", "SELECT scene_id, cloud_cover FROM scenes WHERE cloud_cover < 20")
def _(spark, sf):
    return S.filter_cloud_cover(V.scenes(spark, sf)).select("scene_id", "cloud_cover")


@query(
    "B8_valid_coords",
    "points",
    f"""WITH {NUMERIC_POINTS} SELECT point_id,
        (lat*2.6 BETWEEN -90 AND 90) AND (lon*2.45 BETWEEN -180 AND 180) AS valid FROM np""",
)
def _(spark, sf):
    from airgrid.functions.geo import valid_coords

    p = _numeric_points(spark, sf)
    return p.select("point_id", valid_coords(F.col("lat") * 2.6, F.col("lon") * 2.45).alias("valid"))


_REGIONS = {
    "north": {"south": 34.0, "north": 36.0, "west": 71.5, "east": 75.0},
    "centre": {"south": 33.0, "north": 34.0, "west": 72.0, "east": 74.0},
    "south": {"south": 32.0, "north": 33.0, "west": 71.0, "east": 75.0},
}


@query(
    "B9_points_in_region",
    "points",
    f"""WITH {NUMERIC_POINTS} SELECT point_id, g.region_id FROM np, (VALUES ('north', 34.0, 36.0, 71.5, 75.0),
        ('centre', 33.0, 34.0, 72.0, 74.0), ('south', 32.0, 33.0, 71.0, 75.0)) g(region_id, s, n, w, e)
        WHERE lat BETWEEN s AND n AND lon BETWEEN w AND e""",
)
def _(spark, sf):
    hit = S.points_in_regions(_numeric_points(spark, sf), _REGIONS, "lat", "lon")
    return hit.select("point_id", "region_id")


@query(
    "B10_points_within_radius",
    "points",
    f"""WITH {NUMERIC_POINTS}, d AS (SELECT point_id, 2*6371.0*asin(sqrt(pow(sin(radians(lat-33.6844)/2), 2)
          + cos(radians(33.6844))*cos(radians(lat))*pow(sin(radians(lon-73.0479)/2), 2))) AS d FROM np)
        SELECT point_id, {r('distance_km=d')} FROM d WHERE d <= 50""",
)
def _(spark, sf):
    near = S.points_within_radius(_numeric_points(spark, sf), (33.6844, 73.0479), 50.0, "lat", "lon")
    return rounded(near.select("point_id", "distance_km"))


_EDGE = "WHERE time = (SELECT {0}(time) FROM grid h WHERE h.dataset_id = g.dataset_id AND h.variable = g.variable)"


@query("B11_latest_slice", "grid", f"SELECT {CELL}, {r('value')} FROM grid g {_EDGE.format('max')}")
def _(spark, sf):
    return _cell(S.latest_slice(V.grid(spark, sf)))


@query("B11_first_slice", "grid", f"SELECT {CELL}, {r('value')} FROM grid g {_EDGE.format('min')}")
def _(spark, sf):
    return _cell(S.first_slice(V.grid(spark, sf)))


@query(
    "B12_nearest_slice",
    "grid",
    f"""WITH best AS (SELECT dataset_id, variable, arg_min(time, abs(epoch(time) - epoch(TIMESTAMP '1998-05-17')) * 1e9
                      + epoch(time) / 1e3) AS t FROM grid GROUP BY 1, 2)
        SELECT g.dataset_id, g.variable, g.time, y, x, {r('value')} FROM grid g
        JOIN best b ON g.dataset_id = b.dataset_id AND g.variable = b.variable AND g.time = b.t""",
)
def _(spark, sf):
    return _cell(S.nearest_slice(V.grid(spark, sf), "1998-05-17"))


@query(
    "B13_stride_sample",
    "grid",
    f"""WITH h AS (SELECT dataset_id, variable, greatest(1, (max(y)+1)//4) AS step FROM grid GROUP BY 1, 2)
        SELECT g.dataset_id, g.variable, g.time, y, x, {r('value')} FROM grid g
        JOIN h ON g.dataset_id = h.dataset_id AND g.variable = h.variable
        WHERE y % step = 0 AND x % step = 0 AND value > 0""",
)
def _(spark, sf):
    return _cell(S.stride_sample(V.grid(spark, sf), 4, positive=True))


@query(
    "B14_find_variable",
    "series event_series",
    """SELECT dataset_id, min(variable) AS variable FROM (SELECT dataset_id, variable FROM series UNION ALL
       SELECT dataset_id, variable FROM event_series) WHERE lower(variable) LIKE '%o%' GROUP BY 1""",
)
def _(spark, sf):
    cols = ["dataset_id", "variable"]
    return S.find_variable(V.series(spark, sf).select(*cols).union(V.event_series(spark, sf).select(*cols)), "O")


@query(
    "B15_drop_missing_target",
    "gappy",
    f"SELECT dataset_id, variable, time, {r('value')} FROM gappy WHERE value IS NOT NULL",
)
def _(spark, sf):
    return rounded(S.drop_missing_target(V.gappy(spark, sf), "value"))


@query(
    "B15_drop_any_null",
    "gappy",
    f"""SELECT dataset_id, time, {r("no2=max(CASE WHEN variable='no2' THEN value END)",
        "so2=max(CASE WHEN variable='so2' THEN value END)")} FROM gappy GROUP BY 1, 2
        HAVING count(CASE WHEN variable='no2' THEN value END) = 1 AND count(CASE WHEN variable='so2' THEN value END) = 1""",
)
def _(spark, sf):
    wide = V.gappy(spark, sf).groupBy("dataset_id", "time").pivot("variable", ["no2", "so2"]).agg(F.max("value"))
    return rounded(S.drop_any_null(wide))


@query(
    "B16_replace_infinite",
    "daily",
    f"""SELECT dataset_id, time, {r('co_share=CASE WHEN co > 0 THEN o3/co END')} FROM daily""",
)
def _(spark, sf):
    d = V.daily(spark, sf)
    share = F.when(F.col("co") > 0, F.col("o3") / F.nullif("co", F.lit(0.0))).otherwise(float("inf"))
    return rounded(S.replace_infinite(d.select("dataset_id", "time", share.alias("co_share"))))


@query(
    "B17_availability",
    "scenes",
    """SELECT region, count(*) FILTER (WHERE time_start >= TIMESTAMP '1996-01-01' AND time_start < TIMESTAMP '1996-02-01')
       AS scenes, count(*) FILTER (WHERE time_start >= TIMESTAMP '1996-01-01' AND time_start < TIMESTAMP '1996-02-01') > 0
       AS available FROM scenes GROUP BY 1""",
)
def _(spark, sf):
    return S.availability(V.scenes(spark, sf), "1996-01-01", "1996-02-01", keys=["region"])
