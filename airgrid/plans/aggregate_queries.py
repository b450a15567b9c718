"""Queries for aggregates."""

from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.operators import aggregates as A
from airgrid.plans import views as V
from airgrid.plans.registry import query, r, rounded

SLICE = [*KEYS, "time"]
K = "dataset_id, variable"
FENCES = """q AS (SELECT dataset_id, variable, quantile_cont(value, .25) AS q1, quantile_cont(value, .75) AS q3
      FROM {0} WHERE value IS NOT NULL GROUP BY 1, 2),
    fences AS (SELECT dataset_id, variable, q1 - {1}*(q3-q1) AS lo, q3 + {1}*(q3-q1) AS hi FROM q)"""


def masked(spark, sf):
    """The cube after the quality mask: cells stay, some values become null."""
    from airgrid.operators.slicing import mask_quality

    return mask_quality(V.grid(spark, sf), 2)


MASKED = "masked AS (SELECT dataset_id, variable, time, y, x, lat, lon, CASE WHEN qa < 2 THEN value END AS value FROM grid)"

DESCRIBE = """SELECT dataset_id, variable, count(value) AS count, round(avg(value), 6) AS mean,
   round(quantile_cont(value, .5), 6) AS median, round(stddev_pop(value), 6) AS std, round(var_pop(value), 5) AS var,
   round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range,
   round(quantile_cont(value, .25), 6) AS q1, round(quantile_cont(value, .75), 6) AS q3,
   round(quantile_cont(value, .75) - quantile_cont(value, .25), 6) AS iqr,
   round(avg(pow(value - mu, 3)) / pow(stddev_pop(value), 3), 6) + 0.0 AS skewness,
   round(kurtosis_pop(value), 6) + 0.0 AS kurtosis, round(stddev_pop(value) / avg(value), 6) AS cv,
   round(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS missing_pct
   FROM (SELECT *, avg(value) OVER (PARTITION BY dataset_id, variable) AS mu FROM {0}) GROUP BY 1, 2"""


@query("D1_describe", "grid", f"WITH {MASKED} {DESCRIBE.format('masked')}")
def _(spark, sf):
    d = A.describe(masked(spark, sf))
    return rounded(d.withColumn("var", F.round("var", 5)))


@query(
    "D4_outlier_percentage",
    "grid",
    f"""WITH {MASKED}, {FENCES.format('masked', 1.5)}
        SELECT m.dataset_id, m.variable, count(*) FILTER (WHERE value < lo OR value > hi) AS outliers,
        {r('outlier_pct=count(*) FILTER (WHERE value < lo OR value > hi)*100.0/count(*)')}
        FROM masked m JOIN fences f ON m.dataset_id = f.dataset_id AND m.variable = f.variable
        WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(A.outlier_percentage(masked(spark, sf)))


@query(
    "D5_spatial_mean",
    "grid",
    f"WITH {MASKED} SELECT {K}, time, {r('value=avg(value)')} FROM masked GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return rounded(A.spatial_mean(masked(spark, sf)))


@query(
    "D6_time_mean",
    "grid",
    f"WITH {MASKED} SELECT {K}, y, x, {r('value=avg(value)', 'lat=max(lat)', 'lon=max(lon)')} FROM masked GROUP BY 1, 2, 3, 4",
)
def _(spark, sf):
    return rounded(A.time_mean(masked(spark, sf)))


@query(
    "D7_region_reduce",
    "grid",
    f"""WITH {MASKED}, box AS (SELECT * FROM masked WHERE lat BETWEEN 33.1844 AND 34.1844 AND lon BETWEEN 72.1479 AND 73.9479)
        SELECT {K}, time, f.reducer, round(CASE f.reducer WHEN 'mean' THEN avg(value) WHEN 'median' THEN quantile_cont(value, .5)
          WHEN 'min' THEN min(value) ELSE max(value) END, 6) + 0.0 AS value
        FROM box, (VALUES ('mean'), ('median'), ('min'), ('max')) f(reducer) GROUP BY 1, 2, 3, 4 HAVING count(value) > 0""",
)
def _(spark, sf):
    from airgrid.operators.slicing import clip_bbox
    from airgrid.plans.slicing_queries import INNER

    box = clip_bbox(masked(spark, sf), INNER)
    out = None
    for name in ("mean", "median", "min", "max"):
        part = A.region_reduce(box, name).withColumn("reducer", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query(
    "D8_region_statistics",
    "grid",
    f"""WITH {MASKED}, image AS (SELECT dataset_id, variable, y, x, avg(value) AS v FROM masked GROUP BY 1, 2, 3, 4),
        s AS (SELECT dataset_id, variable, count(DISTINCT time) AS scenes, min(time) AS first_time FROM masked GROUP BY 1, 2)
        SELECT i.dataset_id, i.variable, {r('mean=avg(v)', 'min=min(v)', 'max=max(v)')}, count(v) AS cells,
        max(s.scenes) AS scenes, max(s.first_time) AS first_time
        FROM image i JOIN s ON i.dataset_id = s.dataset_id AND i.variable = s.variable GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(A.region_statistics(masked(spark, sf)))


_PERIOD = {
    "daily": ("CAST(date_trunc('day', time) AS DATE)", "event_series", ", count(value) AS count"),
    "weekly": ("CAST(date_trunc('week', time) AS DATE) + 6", "series", ""),
    "monthly": ("last_day(time)", "gappy", ""),
}


def _register_period(freq):
    period, view, extra = _PERIOD[freq]
    sql = f"""SELECT {K}, CAST({period} AS DATE) AS period, {r('mean=avg(value)', 'std=stddev_pop(value)', 'min=min(value)',
              'max=max(value)', 'median=quantile_cont(value, .5)')}{extra} FROM {view} GROUP BY 1, 2, 3"""

    @query(f"D9_aggregate_{freq}", view, sql)
    def _(spark, sf):
        return rounded(A.aggregate_time(getattr(V, view)(spark, sf), freq))


for _freq in _PERIOD:
    _register_period(_freq)

LABEL = "['DJF','MAM','JJA','SON'][(month(time) % 12) // 3 + 1]"


@query(
    "D10_aggregate_season",
    "series",
    f"""SELECT {K}, {LABEL} AS season, {r('mean=avg(value)', 'std=stddev_pop(value)', 'median=quantile_cont(value, .5)')}
        FROM series GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(A.aggregate_season(V.series(spark, sf)))


@query(
    "D11_temporal_stats",
    "gappy",
    f"""SELECT {K}, min(time) AS "start", max(time) AS "end",
        CAST(date_diff('day', CAST(min(time) AS DATE), CAST(max(time) AS DATE)) AS INTEGER) AS duration_days, count(*) AS n,
        {r('mean=avg(value)', 'median=quantile_cont(value, .5)', 'std=stddev_samp(value)', 'min=min(value)', 'max=max(value)',
           'range=max(value)-min(value)', 'cv=stddev_samp(value)/avg(value)')}
        FROM gappy WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(A.temporal_stats(V.gappy(spark, sf)))


@query(
    "D12_season_profile",
    "gappy",
    f"""SELECT {K}, {LABEL} AS season, {r('mean=avg(value)', 'std=stddev_samp(value)')}, count(*) AS count
        FROM gappy WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(A.season_profile(V.gappy(spark, sf)))


@query(
    "D12_month_profile",
    "event_series",
    f"""WITH n AS (SELECT {K}, count(value) AS total FROM event_series GROUP BY 1, 2)
        SELECT e.dataset_id, e.variable, CAST(month(time) AS INTEGER) AS month, {r('mean=avg(value)', 'std=stddev_samp(value)')},
        count(*) AS count FROM event_series e JOIN n ON e.dataset_id = n.dataset_id AND e.variable = n.variable
        WHERE value IS NOT NULL AND total >= 24 GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(A.month_profile(V.event_series(spark, sf)))


@query(
    "D13_grid_stats",
    "grid",
    f"""WITH {MASKED} SELECT {K}, {r('mean=avg(value)', 'std=stddev_pop(value)', 'min=min(value)', 'max=max(value)',
        'median=quantile_cont(value,.5)', 'p25=quantile_cont(value,.25)', 'p75=quantile_cont(value,.75)',
        'p90=quantile_cont(value,.9)', 'p95=quantile_cont(value,.95)', 'coverage=count(value)/count(*)')},
        count(value) AS count_valid, count(*) AS count_total FROM masked GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(A.grid_stats(masked(spark, sf)))


_FIRST = "first_slice AS (SELECT * FROM grid g WHERE time = (SELECT min(time) FROM grid h WHERE h.dataset_id = g.dataset_id AND h.variable = g.variable))"


@query(
    "D14_slice_stats",
    "grid",
    f"""WITH {_FIRST} SELECT {K}, {r('spatial_mean=avg(value)', 'spatial_std=stddev_pop(value)',
        'spatial_range=max(value)-min(value)', 'spatial_cv=stddev_pop(value)/avg(value)')} FROM first_slice GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(A.slice_stats(V.grid(spark, sf)))


@query(
    "D15_hotspots",
    "grid",
    f"""WITH t AS (SELECT {K}, time, quantile_cont(value, .9) AS threshold FROM grid GROUP BY 1, 2, 3)
        SELECT g.dataset_id, g.variable, g.time, {r('threshold=max(threshold)',
          'hotspot_pct=count(*) FILTER (WHERE round(value, 12) > round(threshold, 12))*100.0/count(*)',
          'hotspot_mean=coalesce(avg(value) FILTER (WHERE round(value, 12) > round(threshold, 12)), 0)',
          'hotspot_max=coalesce(max(value) FILTER (WHERE round(value, 12) > round(threshold, 12)), 0)')},
        count(*) FILTER (WHERE round(value, 12) > round(threshold, 12)) AS num_hotspots
        FROM grid g JOIN t ON g.dataset_id = t.dataset_id AND g.variable = t.variable AND g.time = t.time GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(A.hotspots(V.grid(spark, sf)))


def hist_sql(view: str, bins: int, keys: str = K) -> str:
    on = " AND ".join(f"g.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    g = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""span AS (SELECT {keys}, min(value) AS lo, max(value) AS hi FROM {view} WHERE value IS NOT NULL GROUP BY ALL),
      hist AS (SELECT {g}, CAST(CASE WHEN hi > lo THEN least(floor((value-lo)/(hi-lo)*{bins}), {bins - 1}) ELSE {bins // 2} END AS INTEGER) AS bin,
        count(*) AS count, max(CASE WHEN hi > lo THEN hi-lo ELSE 1 END)/{bins} AS width,
        max(CASE WHEN hi > lo THEN lo ELSE lo-.5 END) AS lo
        FROM {view} g JOIN span s ON {on} WHERE value IS NOT NULL GROUP BY ALL)"""


@query(
    "D16_histogram",
    "grid",
    f"WITH {hist_sql('grid', 50)} SELECT {K}, bin, count, {r('width', 'left_edge=lo+bin*width')} FROM hist",
)
def _(spark, sf):
    return rounded(A.histogram(V.grid(spark, sf), 50))


@query(
    "D17_entropy",
    "grid",
    f"""WITH {hist_sql('grid', 256)}, d AS (SELECT *, count/(sum(count) OVER (PARTITION BY dataset_id, variable)*width) AS h FROM hist)
        SELECT {K}, {r('entropy=-sum(h*log2(h))')} FROM d GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(A.entropy(V.grid(spark, sf)))


@query(
    "D18_coverage",
    "grid",
    f"""WITH {MASKED}, c AS (SELECT {K}, count(value) AS valid, count(*) AS total, count(value)/count(*) AS coverage FROM masked GROUP BY 1, 2)
        SELECT {K}, valid, total, {r('coverage', 'score=avg(coverage) OVER (PARTITION BY dataset_id)')} FROM c""",
)
def _(spark, sf):
    m = masked(spark, sf)
    return rounded(A.merge_on(A.coverage(m), A.dataset_score(m), ["dataset_id"]))


@query(
    "D18_table_score",
    "points",
    f"""SELECT source, {r('score=(count(TRY_CAST(latitude AS DOUBLE)) + count(TRY_CAST(longitude AS DOUBLE)) + count(value))/(count(*)*3.0)')}
        FROM points GROUP BY 1""",
)
def _(spark, sf):
    p = V.points(spark, sf).withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")})
    return rounded(A.table_score(p, ["latitude", "longitude", "value"], ["source"]))


@query(
    "D19_snr",
    "series",
    f"SELECT {K}, {r('snr=avg(value)/stddev_pop(value)', 'noise_variance=var_pop(value)')} FROM series GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(A.snr(V.series(spark, sf)))


def lowered(spark, sf):
    """A corrected version of the cube: a tenth off, never below twenty."""
    v = F.col("value")
    return V.grid(spark, sf).withColumn("value", F.when(v.isNotNull(), F.greatest(v * 0.9, F.lit(20.0))))


LOWERED = "lowered AS (SELECT dataset_id, variable, time, y, x, greatest(value*0.9, 20) AS value FROM grid)"
BOTH = f"""{LOWERED}, a AS (SELECT {K}, avg(value) AS m, stddev_pop(value) AS s FROM grid GROUP BY 1, 2),
    b AS (SELECT {K}, avg(value) AS m2, stddev_pop(value) AS s2, min(value) AS lo2 FROM lowered GROUP BY 1, 2),
    ab AS (SELECT a.*, m2, s2, lo2 FROM a JOIN b ON a.dataset_id = b.dataset_id AND a.variable = b.variable)"""


@query(
    "D20_compare_before_after",
    "grid",
    f"""WITH {BOTH} SELECT {K}, {r('original_mean=m', 'new_mean=m2', 'original_std=s', 'new_std=s2', 'mean_change=m2-m',
        'std_change=s2-s', 'snr_improvement=abs(m2)/s2-abs(m)/s', 'contrast_improvement=s2/m2-s/m')} FROM ab""",
)
def _(spark, sf):
    return rounded(A.compare_before_after(V.grid(spark, sf), lowered(spark, sf)))


@query(
    "D23_correction_checks",
    "grid",
    f"""WITH {BOTH} SELECT {K}, lo2 >= 0 AS no_negative_values, abs(m2-m) < s AS reasonable_mean_change,
        s2 > 0.1*s AS preserved_data_structure, s2 >= s AS improved_contrast FROM ab""",
)
def _(spark, sf):
    return A.correction_checks(V.grid(spark, sf), lowered(spark, sf))


@query(
    "D24_variable_importance",
    "series",
    f"SELECT {K}, {r('variance=var_pop(value)', 'range=max(value)-min(value)', 'cv=stddev_pop(value)/avg(value)')} FROM series GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(A.variable_importance(V.series(spark, sf)))


@query(
    "D25_completeness",
    "series",
    f"""SELECT {K}, {r("completeness=count(*)*100.0/date_diff('day', min(time), max(time))")}, count(*) AS data_points,
        min(time) AS "start", max(time) AS "end" FROM series GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(A.completeness(V.series(spark, sf)))


SEASONAL = ", ".join(
    f"avg(CASE WHEN (month(time) % 12) // 3 = {i} THEN value END) AS {n}"
    for i, n in enumerate(("winter", "spring", "summer", "fall"))
)


@query(
    "D26_season_summary",
    "series",
    f"""WITH s AS (SELECT {K}, avg(value) AS mean, stddev_samp(value) AS std, {SEASONAL} FROM series GROUP BY 1, 2)
        SELECT {K}, {r('mean', 'std', 'winter', 'spring', 'summer', 'fall', 'season_max=greatest(winter, spring, summer, fall)',
        'season_min=least(winter, spring, summer, fall)')} FROM s""",
)
def _(spark, sf):
    return rounded(A.season_summary(V.series(spark, sf)))


def predicted(spark, sf):
    """Daily no2 with a plain prediction from so2."""
    return V.daily(spark, sf).select(
        "dataset_id", "time", F.col("no2").alias("actual"), (F.col("so2") * 1.5).alias("predicted")
    )


PREDICTED = "pred AS (SELECT dataset_id, time, no2 AS actual, so2*1.5 AS predicted, no2 - so2*1.5 AS res FROM daily)"


@query(
    "D27_regression_metrics",
    "daily",
    f"""WITH {PREDICTED} SELECT dataset_id, {r('mse=avg(res*res)', 'rmse=sqrt(avg(res*res))', 'mae=avg(abs(res))',
        'r2=1-avg(res*res)/var_pop(actual)', 'mape=avg(abs(res/actual))*100')} FROM pred GROUP BY 1""",
)
def _(spark, sf):
    return rounded(A.regression_metrics(predicted(spark, sf), "actual", "predicted", ["dataset_id"]))


@query(
    "D28_residual_stats",
    "daily",
    f"""WITH {PREDICTED}, c AS (SELECT *, avg(res) OVER (PARTITION BY dataset_id) AS mu FROM pred)
        SELECT dataset_id, {r('residual_mean=avg(res)', 'residual_std=stddev_pop(res)',
        'residual_skewness=avg(pow(res-mu,3))/pow(stddev_pop(res),3)', 'residual_kurtosis=kurtosis_pop(res)')} FROM c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(A.residual_stats(predicted(spark, sf), "actual", "predicted", ["dataset_id"]))


@query(
    "D28_prediction_band",
    "daily",
    f"""WITH {PREDICTED} SELECT dataset_id, time, {r('actual', 'predicted',
        'lower=predicted-1.96*stddev_pop(res) OVER (PARTITION BY dataset_id)',
        'upper=predicted+1.96*stddev_pop(res) OVER (PARTITION BY dataset_id)')} FROM pred""",
)
def _(spark, sf):
    return rounded(A.prediction_band(predicted(spark, sf), "actual", "predicted", ["dataset_id"]))
