"""Queries for ranking, set, validation, report, learning and streaming operators."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.core import materialize
from airgrid.functions.levels import ALERT_THRESHOLDS
from airgrid.operators import learning as ML
from airgrid.operators import ranking as R
from airgrid.operators import reports as P
from airgrid.operators import sets as J
from airgrid.operators import validation as Q
from airgrid.operators import windows as W
from airgrid.plans import views as V
from airgrid.plans.aggregate_queries import K, LOWERED, MASKED, hist_sql, lowered, masked
from airgrid.plans.grid_queries import SHAPE, gradient_sql
from airgrid.plans.registry import query, r, rounded
from airgrid.plans.scratch import scratch_path
from airgrid.plans.window_queries import PLAN, SPLIT_SQL, TREND_SQL, matrix_layers, matrix_sql, matrix_stats
from airgrid.streaming import monitoring

OVER2 = "OVER (PARTITION BY dataset_id, variable ORDER BY time)"

# ------------------------------------------------------------------ sort, limit, top-k


@query("I1_sort_time", "series", f"SELECT {K}, time, {r('value')} FROM series ORDER BY time")
def _(spark, sf):
    return rounded(R.sort_time(V.series(spark, sf)))


@query(
    "I2_optimal_dates",
    "scenes",
    "SELECT CAST(time_start AS DATE) AS date, cloud_cover, scene_id FROM scenes ORDER BY cloud_cover, time_start, scene_id LIMIT 10",
)
def _(spark, sf):
    return R.optimal_dates(V.scenes(spark, sf))


_F_SCORES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, regr_r2(no2, {c})*(count(*)-2)/(1-regr_r2(no2, {c})) AS score FROM daily" for c in ("so2", "co", "o3")
)


@query("I3_top_features", "daily", f"WITH f AS ({_F_SCORES}) SELECT feature, {r('score')} FROM f ORDER BY f.score DESC LIMIT 2")
def _(spark, sf):
    return rounded(R.top_features(V.daily(spark, sf), "no2", ["so2", "co", "o3"], 2))


@query(
    "I4_tail_n",
    "series",
    f"SELECT {K}, time, {r('value')} FROM series QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY time DESC) <= 14",
)
def _(spark, sf):
    return rounded(R.tail_n(V.series(spark, sf), 14))


_MODELS = """m AS (SELECT dataset_id, 'a' AS model, 1 - avg(pow(no2-so2*1.5, 2))/var_pop(no2) AS r2, sqrt(avg(pow(no2-so2*1.5, 2))) AS rmse FROM daily GROUP BY 1
    UNION ALL SELECT dataset_id, 'b', 1 - avg(pow(no2-so2*1.4, 2))/var_pop(no2), sqrt(avg(pow(no2-so2*1.4, 2))) FROM daily GROUP BY 1)"""


@query(
    "I5_best_model",
    "daily",
    f"""WITH {_MODELS} SELECT dataset_id, 'r2' AS metric, arg_max(model, r2) AS model, {r('score=max(r2)')} FROM m GROUP BY 1
        UNION ALL SELECT dataset_id, 'rmse', arg_min(model, rmse), {r('score=min(rmse)')} FROM m GROUP BY 1""",
)
def _(spark, sf):
    from airgrid.operators.aggregates import regression_metrics

    d = V.daily(spark, sf)
    parts = [
        regression_metrics(d.withColumn("p", F.col("so2") * f), "no2", "p", ["dataset_id"]).withColumn("model", F.lit(m))
        for m, f in (("a", 1.5), ("b", 1.4))
    ]
    metrics = parts[0].unionByName(parts[1])
    best = [
        R.best_model(metrics, m, ["dataset_id"]).select("dataset_id", F.lit(m).alias("metric"), "model", F.col(m).alias("score"))
        for m in ("r2", "rmse")
    ]
    return rounded(best[0].unionByName(best[1]))


# ------------------------------------------------------------------ set operations


@query(
    "J1_union_all",
    "series event_series",
    f"""SELECT {K}, count(*) AS n, {r('total=sum(value)')} FROM (SELECT {K}, value FROM series UNION ALL SELECT {K}, value FROM event_series) GROUP BY 1, 2""",
)
def _(spark, sf):
    both = J.union_all([V.series(spark, sf), V.event_series(spark, sf)])
    return rounded(both.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query(
    "J2_intersect_times",
    "gappy",
    """SELECT variable, time FROM gappy WHERE value IS NOT NULL INTERSECT
       SELECT CASE o_orderstatus WHEN 'O' THEN 'no2' WHEN 'F' THEN 'so2' ELSE 'co' END, CAST(o_orderdate AS TIMESTAMP) FROM orders""",
)
def _(spark, sf):
    status = F.col("o_orderstatus")
    variable = F.when(status == "O", "no2").when(status == "F", "so2").otherwise("co")
    times = V.table(spark, sf, "orders").select(variable.alias("variable"), F.col("o_orderdate").alias("time"))
    return J.intersect_times(V.gappy(spark, sf).where("value IS NOT NULL"), times, ["variable"])


@query(
    "J3_missing_days",
    "gappy",
    f"""WITH v AS (SELECT * FROM gappy WHERE value IS NOT NULL), s AS (SELECT {K}, min(time) AS a, max(time) AS b FROM v GROUP BY 1, 2)
        SELECT {K}, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s EXCEPT SELECT {K}, CAST(time AS DATE) FROM v""",
)
def _(spark, sf):
    return J.missing_days(V.gappy(spark, sf).where(F.col("value").isNotNull()))


# ------------------------------------------------------------------ validation

CHECK_COLUMNS = ["dataset_id", "test_name", "status", "level"]


def check_sql(source: str, name: str, bad: str, status: str, level: str) -> str:
    return f"""SELECT dataset_id, {name} AS test_name, CASE WHEN {bad} THEN '{status}' ELSE 'passed' END AS status,
               CASE WHEN {bad} THEN '{level}' ELSE 'info' END AS level FROM {source}"""


COVER = f"cover AS (SELECT {K}, count(value) AS valid, count(*) AS total FROM masked GROUP BY 1, 2)"
POINTS = """pts AS (SELECT source AS dataset_id, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon, latitude, longitude,
    CASE WHEN point_id % 3 = 0 THEN NULL ELSE value END AS value, CASE WHEN point_id % 20 < 3 THEN value*50 ELSE value/1000 END AS spiky FROM points)"""


def point_table(spark, sf):
    k = F.col("point_id")
    return V.points(spark, sf).select(
        F.col("source").alias("dataset_id"),
        F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lon"),
        "latitude",
        "longitude",
        F.when(k % 3 != 0, F.col("value")).alias("value"),
        F.when(k % 20 < 3, F.col("value") * 50).otherwise(F.col("value") / 1000).alias("spiky"),
    )


def datasets(spark, sf):
    """The datasets one expects: those of the cube and of the events."""
    both = V.grid(spark, sf).select("dataset_id").union(V.event_series(spark, sf).select("dataset_id"))
    return both.distinct()


DATASETS = "expected AS (SELECT DISTINCT dataset_id FROM grid UNION SELECT DISTINCT dataset_id FROM event_series)"


@query(
    "M1_check_empty",
    "grid event_series",
    f"WITH {DATASETS}, n AS (SELECT e.dataset_id, count(g.dataset_id) AS n FROM expected e LEFT JOIN grid g ON e.dataset_id = g.dataset_id GROUP BY 1) "
    + check_sql("n", "'dataset_empty'", "n = 0", "failed", "critical"),
)
def _(spark, sf):
    return Q.check_empty(V.grid(spark, sf), datasets(spark, sf)).select(*CHECK_COLUMNS)


@query(
    "M2_check_required",
    "grid event_series",
    f"""WITH {DATASETS}, req AS (SELECT dataset_id, v.variable FROM expected, (VALUES ('no2'), ('aod')) v(variable)),
        m AS (SELECT dataset_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.dataset_id = q.dataset_id AND g.variable = q.variable)) AS n
          FROM req q GROUP BY 1) """
    + check_sql("m", "'required_columns'", "n > 0", "failed", "error"),
)
def _(spark, sf):
    required = datasets(spark, sf).withColumn("variable", F.explode(F.array(F.lit("no2"), F.lit("aod"))))
    return Q.check_required(V.grid(spark, sf), required).select(*CHECK_COLUMNS)


@query(
    "M3_check_coordinates",
    "points",
    f"""WITH {POINTS}, s AS (SELECT dataset_id, min(lat*2.6) AS a, max(lat*2.6) AS b, min(lon*2.45) AS c, max(lon*2.45) AS d,
          count(*) FILTER (WHERE latitude IS NOT NULL AND lat IS NULL) AS bad_lat, count(*) FILTER (WHERE longitude IS NOT NULL AND lon IS NULL) AS bad_lon
          FROM pts GROUP BY 1) """
    + " UNION ALL ".join(
        [
            check_sql("s", "'latitude_coordinates'", "a < -90 OR b > 90", "failed", "warning"),
            check_sql("s", "'longitude_coordinates'", "c < -180 OR d > 180", "failed", "warning"),
            check_sql("s", "'latitude_type'", "bad_lat > 0", "failed", "warning"),
            check_sql("s", "'longitude_type'", "bad_lon > 0", "failed", "warning"),
        ]
    ),
)
def _(spark, sf):
    p = point_table(spark, sf)
    moved = p.withColumns({"lat": F.col("lat") * 2.6, "lon": F.col("lon") * 2.45})
    return J.union_all([Q.check_coordinates(moved), Q.check_numeric(p)]).select(*CHECK_COLUMNS)


def gapped_cube(spark, sf):
    """The masked cube in which one dataset-variable pair has lost all values."""
    gone = (F.col("variable") == "so2") & (F.col("dataset_id") == "d0")
    return masked(spark, sf).withColumn("value", F.when(~gone, F.col("value")))


GAPPED = f"""gone AS (SELECT dataset_id, variable, time, CASE WHEN variable = 'so2' AND dataset_id = 'd0' THEN NULL ELSE value END AS value FROM masked),
    cov AS (SELECT {K}, count(value) AS valid, count(*) AS total FROM gone GROUP BY 1, 2)"""


@query("M4_check_all_null", "grid", f"WITH {MASKED}, {GAPPED} " + check_sql("cov", "'all_nan_' || variable", "valid = 0", "failed", "critical"))
def _(spark, sf):
    return Q.check_all_null(gapped_cube(spark, sf)).select(*CHECK_COLUMNS)


@query(
    "M5_check_coverage",
    "grid",
    f"WITH {MASKED}, {GAPPED} " + check_sql("cov", "'data_coverage_' || variable", "valid > 0 AND valid/total < 0.6", "partial", "warning"),
)
def _(spark, sf):
    return Q.check_coverage(gapped_cube(spark, sf), 0.6).select(*CHECK_COLUMNS)


@query(
    "M6_check_range",
    "series",
    f"""WITH ruled AS (SELECT {K}, count(*) FILTER (WHERE value < lo OR value > hi) AS n, min(value) AS a, max(value) AS b FROM series
          JOIN (VALUES ('no2', 0.0, 90.0), ('co', 0.0, 0.1)) q(v, lo, hi) ON variable = v GROUP BY 1, 2)
        SELECT dataset_id, 'range_validation_' || variable AS test_name, CASE WHEN n > 0 THEN 'warning' ELSE 'passed' END AS status,
        CASE WHEN n > 0 THEN 'warning' ELSE 'info' END AS level, CAST(n AS VARCHAR) AS out_of_range, {r('actual_min=a', 'actual_max=b')} FROM ruled""",
)
def _(spark, sf):
    rules = {"no2": {"low": 0.0, "high": 90.0}, "co": {"low": 0.0, "high": 0.1}}
    out = Q.check_range(V.series(spark, sf), rules)
    d = F.col("details")
    return out.select(
        *CHECK_COLUMNS, d["out_of_range_count"].alias("out_of_range"), d["actual_min"].cast("double").alias("actual_min"), d["actual_max"].cast("double").alias("actual_max")
    )


@query(
    "M7_check_missing_columns",
    "points",
    f"""WITH {POINTS}, s AS (SELECT dataset_id, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN lat IS NULL THEN 1.0 ELSE 0 END) AS b
          FROM pts GROUP BY 1) """
    + check_sql("s", "'missing_values'", "a > 0.3 OR b > 0.3", "warning", "warning"),
)
def _(spark, sf):
    return Q.check_missing_columns(point_table(spark, sf), ["value", "lat"]).select(*CHECK_COLUMNS)


@query(
    "M8_check_outlier_columns",
    "points",
    f"""WITH {POINTS}, tall AS (SELECT dataset_id, 'value' AS variable, value AS v FROM pts UNION ALL SELECT dataset_id, 'spiky', spiky FROM pts),
        q AS (SELECT {K}, quantile_cont(v, .25) AS a, quantile_cont(v, .75) AS b FROM tall WHERE v IS NOT NULL GROUP BY 1, 2),
        o AS (SELECT t.dataset_id, t.variable, count(*) FILTER (WHERE v < a-1.5*(b-a) OR v > b+1.5*(b-a)) AS n, count(*) AS m FROM tall t
          JOIN q ON t.dataset_id = q.dataset_id AND t.variable = q.variable GROUP BY 1, 2) """
    + check_sql("o", "'outliers_' || variable", "n/m > 0.1", "warning", "warning"),
)
def _(spark, sf):
    return Q.check_outlier_columns(point_table(spark, sf), ["value", "spiky", "lat"]).select(*CHECK_COLUMNS)


@query(
    "M9_check_product",
    "series event_series",
    f"""WITH s AS (SELECT DISTINCT {K} FROM series UNION SELECT DISTINCT {K} FROM event_series),
        u AS (SELECT *, CASE dataset_id WHEN 'd0' THEN 'mol m-2' ELSE 'ug m-3' END AS units FROM s WHERE variable IN ('no2', 'so2', 'co', 'o3')) """
    + check_sql("s", "'product_validation_' || variable", "variable NOT IN ('no2', 'so2', 'co', 'o3', 'aod')", "partial", "warning")
    + " UNION ALL "
    + check_sql("u", "'units_validation_' || variable", "units <> 'mol m-2'", "warning", "warning"),
)
def _(spark, sf):
    both = J.union_all([V.series(spark, sf).select(*KEYS), V.event_series(spark, sf).select(*KEYS)])
    attributes = both.distinct().withColumn("units", F.when(F.col("dataset_id") == "d0", "mol m-2").otherwise("ug m-3"))
    return J.union_all([Q.check_product(both), Q.check_units(attributes)]).select(*CHECK_COLUMNS)


@query(
    "M10_check_source",
    "grid",
    f"""WITH {MASKED}, {COVER}, d AS (SELECT DISTINCT dataset_id FROM masked) """
    + " UNION ALL ".join(
        [
            check_sql("d", "'sentinel5p_resolution'", "abs(3.0/9 - 0.0625) > 0.02", "warning", "warning"),
            check_sql("d", "'modis_quality_flags'", "false", "warning", "warning"),
            check_sql("cover", "'gee_coverage_' || variable", "valid/total < 0.7", "warning", "warning"),
        ]
    ),
)
def _(spark, sf):
    cube = masked(spark, sf)
    return J.union_all([Q.check_source(cube, s) for s in ("sentinel5p", "modis", "gee")]).select(*CHECK_COLUMNS)


@query(
    "M11_check_region_and_gaps",
    "grid gappy",
    f"""WITH s AS (SELECT dataset_id, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM grid GROUP BY 1),
        st AS (SELECT dataset_id, epoch(time) - epoch(lag(time) OVER (PARTITION BY dataset_id ORDER BY time)) AS step
          FROM (SELECT DISTINCT dataset_id, time FROM gappy WHERE value IS NOT NULL)),
        md AS (SELECT dataset_id, quantile_cont(step, .5) AS med FROM st WHERE step IS NOT NULL GROUP BY 1),
        g AS (SELECT st.dataset_id, count(*) FILTER (WHERE step > 2*med) AS n FROM st JOIN md ON st.dataset_id = md.dataset_id GROUP BY 1) """
    + check_sql("s", "'spatial_coverage'", "a > 33.2353 OR b < 34.1335 OR c > 72.508 OR d < 75.0", "warning", "warning")
    + " UNION ALL "
    + check_sql("g", "'temporal_gaps'", "n > 0", "warning", "warning"),
)
def _(spark, sf):
    bbox = {"south": 33.2353, "north": 34.1335, "west": 72.508, "east": 75.0}
    gaps = Q.check_time_gaps(V.gappy(spark, sf).where(F.col("value").isNotNull()))
    return J.union_all([Q.check_region(V.grid(spark, sf), bbox), gaps]).select(*CHECK_COLUMNS)


@query(
    "M12_check_quality_score",
    "grid",
    f"""WITH {MASKED}, {COVER}, s AS (SELECT dataset_id, avg(valid/total) AS score FROM cover GROUP BY 1)
        SELECT dataset_id, 'overall_quality' AS test_name, CASE WHEN score < 0.7 THEN 'failed' ELSE 'passed' END AS status,
        CASE WHEN score < 0.7 THEN 'error' ELSE 'info' END AS level, {r('score')} FROM s""",
)
def _(spark, sf):
    out = Q.check_quality_score(masked(spark, sf))
    return out.select(*CHECK_COLUMNS, F.col("details")["quality_score"].cast("double").alias("score"))


@query(
    "M13_report",
    "grid",
    f"""WITH {MASKED}, {GAPPED}, sc AS (SELECT dataset_id, avg(valid/total) AS score FROM cov GROUP BY 1),
        res AS ({check_sql('cov', "'a'", 'valid = 0', 'failed', 'critical')} UNION ALL
          {check_sql('cov', "'b'", 'valid > 0 AND valid/total < 0.6', 'partial', 'warning')} UNION ALL
          {check_sql('sc', "'c'", 'score < 0.1', 'failed', 'error')})
        SELECT dataset_id, count(*) AS total_checks, count(*) FILTER (WHERE status = 'passed') AS passed_checks,
        count(*) FILTER (WHERE status = 'failed') AS failed_checks, count(*) FILTER (WHERE status = 'partial') AS partial_checks,
        count(*) FILTER (WHERE level = 'warning') AS warnings, count(*) FILTER (WHERE level = 'error') AS errors,
        count(*) FILTER (WHERE level = 'critical') AS critical,
        CASE WHEN count(*) FILTER (WHERE level IN ('critical', 'error')) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'partial'
          ELSE 'passed' END AS overall_status FROM res GROUP BY 1""",
)
def _(spark, sf):
    cube = gapped_cube(spark, sf)
    checks = J.union_all([Q.check_all_null(cube), Q.check_coverage(cube, 0.6), Q.check_quality_score(cube, 0.1)])
    return Q.report(checks).drop("results")


_CUBE_CHECKS = [
    check_sql("f", "'latitude_coordinates'", "lat_a < -90 OR lat_b > 90", "failed", "warning"),
    check_sql("f", "'longitude_coordinates'", "lon_a < -180 OR lon_b > 180", "failed", "warning"),
    check_sql("cover", "'all_nan_' || variable", "valid = 0", "failed", "critical"),
    check_sql("cover", "'data_coverage_' || variable", "valid > 0 AND valid/total < 0.5", "partial", "warning"),
    check_sql("ranged", "'range_validation_' || variable", "beyond > 0", "warning", "warning"),
    check_sql("cover", "'product_validation_' || variable", "variable NOT IN ('no2', 'so2', 'co', 'o3', 'aod')", "partial", "warning"),
    check_sql("f", "'spatial_coverage'", " OR ".join(
        [f"lat_a > {V.BBOX['south']!r}", f"lat_b < {V.BBOX['north']!r}", f"lon_a > {V.BBOX['west']!r}", f"lon_b < {V.BBOX['east']!r}"]
    ), "warning", "warning"),
    check_sql("steep", "'spatial_consistency_' || variable", "g > 10*sd", "warning", "warning"),
    check_sql("gaps", "'temporal_gaps'", "large > 0", "warning", "warning"),
    check_sql("sc", "'overall_quality'", "score < 0.7", "failed", "error"),
    check_sql("cover", "'gee_coverage_' || variable", "valid/total < 0.7", "warning", "warning"),
]


@query(
    "M13_validate_cube",
    "grid",
    f"""WITH {MASKED}, {COVER}, sc AS (SELECT dataset_id, avg(valid/total) AS score FROM cover GROUP BY 1),
        f AS (SELECT dataset_id, min(lat) AS lat_a, max(lat) AS lat_b, min(lon) AS lon_a, max(lon) AS lon_b FROM masked GROUP BY 1),
        ranged AS (SELECT {K}, count(*) FILTER (WHERE value < lo OR value > hi) AS beyond FROM masked
          JOIN (VALUES ('no2', 0.0, 100.0), ('so2', 0.0, 50.0), ('co', 0.0, 0.1), ('o3', 0.0, 0.5), ('aod', 0.0, 5.0)) q(v, lo, hi) ON variable = v GROUP BY 1, 2),
        image AS MATERIALIZED (SELECT {K}, TIMESTAMP '2000-01-01' AS time, y, x, avg(value) AS value FROM masked GROUP BY {K}, y, x),
        {gradient_sql('image')},
        top AS (SELECT {K}, max(greatest(abs(grad_y), abs(grad_x))) AS g FROM grad GROUP BY 1, 2),
        sd AS (SELECT {K}, stddev_pop(value) AS sd FROM masked GROUP BY 1, 2),
        steep AS (SELECT top.dataset_id, top.variable, g, sd FROM top JOIN sd ON top.dataset_id = sd.dataset_id AND top.variable = sd.variable),
        st AS (SELECT dataset_id, epoch(time) - epoch(lag(time) OVER (PARTITION BY dataset_id ORDER BY time)) AS step
          FROM (SELECT DISTINCT dataset_id, time FROM masked)),
        md AS (SELECT dataset_id, quantile_cont(step, .5) AS med FROM st WHERE step IS NOT NULL GROUP BY 1),
        gaps AS (SELECT st.dataset_id, count(*) FILTER (WHERE step > 2*med) AS large FROM st JOIN md ON st.dataset_id = md.dataset_id GROUP BY 1),
        res AS ({' UNION ALL '.join(_CUBE_CHECKS)})
        SELECT dataset_id, count(*) AS total_checks, count(*) FILTER (WHERE status = 'passed') AS passed_checks,
        count(*) FILTER (WHERE status = 'failed') AS failed_checks, count(*) FILTER (WHERE status = 'partial') AS partial_checks,
        count(*) FILTER (WHERE level = 'warning') AS warnings, count(*) FILTER (WHERE level = 'error') AS errors,
        count(*) FILTER (WHERE level = 'critical') AS critical,
        CASE WHEN count(*) FILTER (WHERE level IN ('critical', 'error')) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'partial'
          ELSE 'passed' END AS overall_status FROM res GROUP BY 1""",
)
def _(spark, sf):
    cube = masked(spark, sf)
    return Q.report(Q.validate_cube(cube, V.BBOX, SHAPE, source="gee")).drop("results")


@query(
    "M14_grid_consistency",
    "grid",
    """WITH s AS (SELECT dataset_id, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM grid GROUP BY 1)
       SELECT dataset_id, true AS lat_increasing, true AS lon_increasing, a >= -90 AND b <= 90 AS lat_valid, c >= -180 AND d <= 180 AS lon_valid,
       a <= 34.1335 AND b >= 33.2353 AND c <= 73.5877 AND d >= 72.508 AS overlaps_region FROM s""",
)
def _(spark, sf):
    return Q.grid_consistency(V.grid(spark, sf), {"south": 33.2353, "north": 34.1335, "west": 72.508, "east": 73.5877})


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query("M15_validate_files")
def _(spark, sf):
    from airgrid.sources.files import lake_manifest

    manifest = lake_manifest(spark, sf, "*.parquet").select("path", "name")
    rows = [spark.read.parquet(f"{sf}/{n}.parquet").select(F.col("_metadata.file_path").alias("path")) for n in TABLES]
    return Q.validate_files(J.union_all(rows), manifest).drop("results")


@query(
    "M16_check_attributes",
    "grid event_series",
    f"WITH {DATASETS} " + check_sql("expected", "'metadata'", "dataset_id NOT IN (SELECT dataset_id FROM grid)", "warning", "warning"),
)
def _(spark, sf):
    attributes = V.grid(spark, sf).select("dataset_id", F.lit("units").alias("name")).distinct()
    return Q.check_attributes(datasets(spark, sf), attributes).select(*CHECK_COLUMNS)


# ------------------------------------------------------------------ report tables

BAND = """CASE variable WHEN 'no2' THEN CASE WHEN {0} < 20 THEN 'good' WHEN {0} < 40 THEN 'moderate' ELSE 'poor' END
    WHEN 'so2' THEN CASE WHEN {0} < 10 THEN 'good' WHEN {0} < 20 THEN 'moderate' ELSE 'poor' END
    WHEN 'co' THEN CASE WHEN {0} < 0.05 THEN 'good' WHEN {0} < 0.1 THEN 'moderate' ELSE 'poor' END ELSE 'good' END"""


@query(
    "N1_dashboard_summary",
    "series",
    f"""WITH {TREND_SQL}, s AS (SELECT {K}, avg(value) AS mean, quantile_cont(value, .5) AS median, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi,
          arg_max(value, time) AS cur, max(time) AS b, min(time) AS a, count(*) AS n FROM series GROUP BY 1, 2)
        SELECT s.dataset_id, s.variable, {r('mean', 'median', 'std', 'min=lo', 'max=hi', 'current_value=cur', 'trend_pct=(recent_mean-previous_mean)/previous_mean*100',
          "completeness=n*100.0/date_diff('day', a, b)")}, n AS data_points, a AS "start", b AS "end", b AS current_time,
        CASE WHEN recent_mean > previous_mean THEN 'increasing' ELSE 'decreasing' END AS direction, {BAND.format('cur').replace('CASE variable', 'CASE s.variable')} AS current_level
        FROM s JOIN recent q ON s.dataset_id = q.dataset_id AND s.variable = q.variable""",
)
def _(spark, sf):
    return rounded(P.dashboard_summary(V.series(spark, sf)))


ALERT = """CASE variable WHEN 'no2' THEN CASE WHEN {0} >= 60 THEN 'critical' WHEN {0} >= 40 THEN 'warning' WHEN {0} >= 20 THEN 'moderate' ELSE 'good' END
    WHEN 'so2' THEN CASE WHEN {0} >= 30 THEN 'critical' WHEN {0} >= 20 THEN 'warning' WHEN {0} >= 10 THEN 'moderate' ELSE 'good' END END"""
TRIPPED = """CASE variable || level WHEN 'no2critical' THEN 60.0 WHEN 'no2warning' THEN 40.0 WHEN 'no2moderate' THEN 20.0
    WHEN 'so2critical' THEN 30.0 WHEN 'so2warning' THEN 20.0 WHEN 'so2moderate' THEN 10.0 END"""


@query(
    "N2_alert_table",
    "series",
    f"""WITH c AS (SELECT {K}, arg_max(value, time) AS v, max(time) AS current_time FROM series WHERE variable IN ('no2', 'so2') GROUP BY 1, 2),
        l AS (SELECT *, {ALERT.format('v')} AS level FROM c)
        SELECT {K}, {r('current_value=v')}, current_time, level, CAST({TRIPPED} AS DOUBLE) AS threshold FROM l""",
)
def _(spark, sf):
    return rounded(P.alert_table(V.series(spark, sf), ALERT_THRESHOLDS))


@query(
    "N3_chart_series",
    "series",
    f"""SELECT {K}, time, {r('value', 'mean=avg(value) OVER w', 'upper=avg(value) OVER w + stddev_samp(value) OVER w', 'lower=avg(value) OVER w - stddev_samp(value) OVER w')}
        FROM series WINDOW w AS (PARTITION BY {K})""",
)
def _(spark, sf):
    return rounded(P.chart_series(V.series(spark, sf)))


@query(
    "N4_distribution_table",
    "grid",
    f"""WITH {hist_sql('grid', 50)}, s AS (SELECT {K}, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx,
          avg(pow(value-mu, 3))/pow(stddev_pop(value), 3) AS sk, kurtosis_pop(value) AS ku, quantile_cont(value, .25) AS q1, quantile_cont(value, .5) AS q2,
          quantile_cont(value, .75) AS q3 FROM (SELECT *, avg(value) OVER (PARTITION BY {K}) AS mu FROM grid) GROUP BY 1, 2)
        SELECT h.dataset_id, h.variable, bin, count, n, {r('width', 'left_edge=lo+bin*width', 'mean', 'std', 'min=mn', 'max=mx', 'skewness=sk', 'kurtosis=ku', 'q1', 'median=q2', 'q3')}
        FROM hist h JOIN s ON h.dataset_id = s.dataset_id AND h.variable = s.variable""",
)
def _(spark, sf):
    return rounded(P.distribution_table(V.grid(spark, sf)))


@query(
    "N5_seasonal_table",
    "series",
    " UNION ALL ".join(
        f"SELECT {K}, '{k}' AS kind, CAST({e} AS INTEGER) AS period, {r('mean=avg(value)')}, count(value) AS n FROM series GROUP BY 1, 2, 3, 4"
        for k, e in (("month", "month(time)"), ("season", "(month(time) % 12) // 3 + 1"), ("day_of_year", "dayofyear(time)"))
    ),
)
def _(spark, sf):
    return rounded(P.seasonal_table(V.series(spark, sf)))


@query(
    "N6_animation_frames",
    "grid",
    f"""WITH {MASKED}, t AS (SELECT {K}, time, row_number() OVER (PARTITION BY {K} ORDER BY time DESC) - 1 AS frame FROM (SELECT DISTINCT {K}, time FROM masked))
        SELECT m.dataset_id, m.variable, frame, m.time, {r('lat', 'lon', 'value')} FROM masked m JOIN t ON m.dataset_id = t.dataset_id AND m.variable = t.variable
        AND m.time = t.time WHERE value IS NOT NULL""",
)
def _(spark, sf):
    return rounded(P.animation_frames(masked(spark, sf)))


@query(
    "N7_compare_slices",
    "grid",
    f"""WITH l AS (SELECT * FROM grid g WHERE time = (SELECT max(time) FROM grid h WHERE h.dataset_id = g.dataset_id AND h.variable = g.variable))
        SELECT dataset_id, y, x, {r("no2=max(CASE WHEN variable = 'no2' THEN value END)", "so2=max(CASE WHEN variable = 'so2' THEN value END)")} FROM l GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(P.compare_slices(V.grid(spark, sf), ["no2", "so2"]))


@query(
    "N8_before_after_diff",
    "grid",
    f"""WITH {LOWERED} SELECT g.dataset_id, g.variable, g.time, g.y, g.x, {r('original=g.value', 'changed=l.value', 'difference=l.value-g.value')} FROM grid g
        JOIN lowered l USING (dataset_id, variable, time, y, x)""",
)
def _(spark, sf):
    return rounded(P.before_after_diff(V.grid(spark, sf), lowered(spark, sf)))


@query(
    "N8_middle_row_profile",
    "grid",
    f"""WITH {LOWERED} SELECT g.dataset_id, g.variable, g.time, g.y, g.x, {r('original=g.value', 'changed=l.value', 'difference=l.value-g.value')} FROM grid g
        JOIN lowered l USING (dataset_id, variable, time, y, x) WHERE g.y = {V.NY // 2}""",
)
def _(spark, sf):
    return rounded(P.middle_row_profile(P.before_after_diff(V.grid(spark, sf), lowered(spark, sf)), V.NY))


@query(
    "N8_before_after_histograms",
    "grid",
    f"""WITH {LOWERED}, two AS (SELECT dataset_id, variable, 'original' AS version, value FROM grid UNION ALL SELECT dataset_id, variable, 'changed', value FROM lowered),
        {hist_sql('two', 50, 'dataset_id, variable, version')}, c AS (SELECT *, CAST(sum(count) OVER (PARTITION BY {K}, version ORDER BY bin) AS BIGINT) AS cum FROM hist)
        SELECT {K}, version, bin, count, cum, {r('width', 'left_edge=lo+bin*width', 'cdf=(cum-min(cum) OVER w)/(max(cum) OVER w-min(cum) OVER w)')} FROM c
        WINDOW w AS (PARTITION BY dataset_id, variable, version)""",
)
def _(spark, sf):
    return rounded(P.before_after_histograms(V.grid(spark, sf), lowered(spark, sf)))


# ------------------------------------------------------------------ learning


FAMILIES = ("linear", "ridge", "lasso", "random_forest", "gradient_boosting")
_RUNS: dict[tuple[str, str], ML.TrainingRun] = {}

#: spatial means as one column per variable, rows without a target left out
PREPARED = "prepared AS (SELECT dataset_id, time, " + ", ".join(f"max(m) FILTER (WHERE variable = '{v}') AS {v}" for v in PLAN.variables) + (
    " FROM (SELECT dataset_id, variable, time, avg(value) AS m FROM grid GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING max(m) FILTER (WHERE variable = 'no2') IS NOT NULL), "
)


@query("L2_prepare", "grid", matrix_sql("prepared", PREPARED, whole_rows=False))
def _(spark, sf):
    return matrix_stats(ML.prepare_matrix(V.grid(spark, sf), PLAN, drop_nulls=False))


def _scale_sql(method: str) -> str:
    cols = ("no2", "so2", "co")
    stat = {
        "standard": "avg({0}) FILTER (WHERE split = 'train') AS {0}_c, stddev_pop({0}) FILTER (WHERE split = 'train') AS {0}_w",
        "minmax": "min({0}) FILTER (WHERE split = 'train') AS {0}_c, max({0}) FILTER (WHERE split = 'train') - min({0}) FILTER (WHERE split = 'train') AS {0}_w",
        "robust": "quantile_cont({0}, .5) FILTER (WHERE split = 'train') AS {0}_c, quantile_cont({0}, .75) FILTER (WHERE split = 'train') - quantile_cont({0}, .25) FILTER (WHERE split = 'train') AS {0}_w",
    }[method]
    stats = ", ".join(stat.format(c) for c in cols)
    return f"""WITH {SPLIT_SQL}, st AS (SELECT dataset_id, {stats} FROM splits GROUP BY 1)
      SELECT s.dataset_id, time, split, {r(*[f'{c}=({c}-{c}_c)/{c}_w' for c in cols])} FROM splits s JOIN st ON s.dataset_id = st.dataset_id"""


def _register_scale(method: str):
    @query(f"L3_scale_{method}", "daily", _scale_sql(method))
    def _(spark, sf):
        rows = W.chrono_split(V.daily(spark, sf).select("dataset_id", "time", "no2", "so2", "co"))
        return rounded(ML.scale(rows, ["no2", "so2", "co"], method, ["dataset_id"]))


for _m in ("standard", "minmax", "robust"):
    _register_scale(_m)


def whole_matrix(spark, sf) -> ML.MatrixTable:
    """All features at their default settings, split in time."""
    return ML.block_table(W.feature_blocks(V.daily(spark, sf), PLAN))


def training(spark, sf) -> ML.TrainingRun:
    """All five families on the 20 best of all features, trained once per session and input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS.clear()
        _RUNS[key] = ML.run_matrix_training(whole_matrix(spark, sf), "no2", FAMILIES)
    return _RUNS[key]


def _univariate_sql() -> str:
    names = [n for n in PLAN.names if n != "no2"]
    scores = ", ".join(f"regr_r2(no2, {n}) AS {n}" for n in names)
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""WITH {matrix_layers()}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY time) - 1 AS _i,
        count(*) OVER (PARTITION BY dataset_id) AS _n FROM rows_),
      scored AS (SELECT {scores} FROM o WHERE _i < _n - floor(_n * 0.15) - floor(_n * 0.15)),
      tall AS (UNPIVOT scored ON COLUMNS(*) INTO NAME feature VALUE r2)
      SELECT feature, round(r2, 6) + 0.0 AS r2 FROM tall ORDER BY round(tall.r2, 9) DESC, list_position([{listed}], feature) LIMIT 20"""


@query("L4_select_features_univariate", "daily", _univariate_sql())
def _(spark, sf):
    table = whole_matrix(spark, sf)
    return rounded(table.train_scores().orderBy(F.round("r2", 9).desc(), "place").limit(20).select("feature", "r2"))


@query("L4_select_features_rfe")
def _(spark, sf):
    table = whole_matrix(spark, sf)
    chosen = ML.rfe_matrix(table, 10)
    rows = materialize(table.columns(chosen, ["split"], "no2").where(F.col("split") == "train"))
    return rounded(R.feature_scores(rows, "no2", chosen))


@query("L5_train_and_evaluate")
def _(spark, sf):
    return rounded(training(spark, sf).metrics)


def _test_rows(run):
    return run.rows.where(F.col("split") == "test")


@query("L6_evaluate_test")
def _(spark, sf):
    run = training(spark, sf)
    parts = [ML.evaluate(t, _test_rows(run), "no2", ["dataset_id"]) for t in run.trained.values()]
    return rounded(reduce(DataFrame.unionByName, parts))


@query("L7_predict")
def _(spark, sf):
    run, keys = training(spark, sf), ["dataset_id"]
    parts = [
        ML.predict_with_band(t, _test_rows(run), "no2", [*keys, "time"], keys).withColumn("model", F.lit(name)) for name, t in run.trained.items()
    ]
    return rounded(reduce(DataFrame.unionByName, parts))


@query("L8_save_models")
def _(spark, sf):
    run, base = training(spark, sf), scratch_path(spark, "models")
    ML.save_models(run.trained, run.metrics, "no2", base)
    return rounded(spark.read.parquet(f"{base}/no2_importance"))


@query("L8_reload_and_score")
def _(spark, sf):
    """Every family saved, loaded again and applied to the rows of the test split, as a batch and as a stream."""
    run, keys = training(spark, sf), ["dataset_id", "time"]
    base = scratch_path(spark, "scorers")
    matrix = run.table.part("test").select(*keys, "features")
    matrix.write.parquet(f"{base}/matrix")
    stored = spark.read.parquet(f"{base}/matrix")

    def compared(name: str) -> DataFrame:
        run.scorers[name].save(spark, f"{base}/{name}")
        again = ML.Scorer.load(spark, f"{base}/{name}")
        live = spark.readStream.schema(stored.schema).parquet(f"{base}/matrix")
        monitoring.run_available_batches(live, lambda batch: again.score(batch, keys), f"{base}/{name}-stream", f"{base}/{name}-checkpoint")
        before = ML.predict(run.trained[name], _test_rows(run), "no2", keys).withColumnRenamed("prediction", "trained")
        after = again.score(stored, keys).withColumnRenamed("prediction", "reloaded")
        streamed = spark.read.parquet(f"{base}/{name}-stream").drop("epoch").withColumnRenamed("prediction", "streamed")
        same = (F.abs(F.col("trained") - F.col("reloaded")) < 1e-9) & (F.col("reloaded") == F.col("streamed"))
        joined = before.join(after, keys).join(streamed, keys)
        return joined.select(F.lit(name).alias("model"), *keys, "trained", "reloaded", "streamed", same.alias("same"))

    return rounded(reduce(DataFrame.unionByName, ML.at_once(spark, compared, run.scorers)))


@query("L9_run_training")
def _(spark, sf):
    run = training(spark, sf)
    return rounded(run.predictions.withColumn("model", F.lit(run.best)))


# ------------------------------------------------------------------ streaming


def _stream(spark, sf, name):
    schema = V.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(
    "K1_stream_daily",
    "",
    f"""SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, {r('mean=avg(value)', 'std=stddev_pop(value)', 'min=min(value)', 'max=max(value)')},
        count(value) AS count FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    out, ckpt = scratch_path(spark, "daily"), scratch_path(spark, "daily-ckpt")
    daily = monitoring.stream_daily(_stream(spark, sf, "events"))
    monitoring.run_available_update(daily, out, ckpt)
    return rounded(monitoring.latest_groups(spark, out, ["event_type", "day"]))


@query(
    "K2_stream_alerts",
    "",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'no2' WHEN 'error' THEN 'so2' ELSE event_type END AS variable, value FROM events),
       l AS (SELECT *, """
    + ALERT.format("value")
    + f""" AS level FROM e WHERE variable IN ('no2', 'so2'))
       SELECT event_id, variable, value, level, CAST({TRIPPED} AS DOUBLE) AS threshold FROM l""",
)
def _(spark, sf):
    out, ckpt = scratch_path(spark, "alerts"), scratch_path(spark, "alerts-ckpt")
    kind = F.col("event_type")
    records = _stream(spark, sf, "events").select(
        "event_id", F.when(kind == "click", "no2").when(kind == "error", "so2").otherwise(kind).alias("variable"), "value"
    )
    monitoring.run_available(monitoring.stream_alerts(records), out, ckpt)
    return spark.read.parquet(out)
