"""Queries for operators over ordered series."""

from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.core import average_rank
from airgrid.functions import special
from airgrid.operators import aggregates as A
from airgrid.operators import windows as W
from airgrid.plans import views as V
from airgrid.plans.aggregate_queries import K, MASKED, hist_sql, masked
from airgrid.plans.function_queries import TEMPORAL_SQL
from airgrid.plans.registry import query, r, rounded

OVER = "OVER (PARTITION BY dataset_id ORDER BY time)"
OVER2 = "OVER (PARTITION BY dataset_id, variable ORDER BY time)"
CALENDAR = """span AS (SELECT dataset_id, variable, min(time) AS a, max(time) AS b FROM {0} GROUP BY 1, 2),
    days AS (SELECT dataset_id, variable, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS time FROM span),
    cal AS (SELECT d.dataset_id, d.variable, d.time, value, row_number() OVER w AS i, count(*) OVER
      (PARTITION BY d.dataset_id, d.variable) AS n FROM days d LEFT JOIN {0} g ON d.dataset_id = g.dataset_id
      AND d.variable = g.variable AND d.time = g.time WINDOW w AS (PARTITION BY d.dataset_id, d.variable ORDER BY d.time)),
    near AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi,
      first_value(value IGNORE NULLS) OVER q AS nv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ni FROM cal
      WINDOW p AS (PARTITION BY dataset_id, variable ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             q AS (PARTITION BY dataset_id, variable ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _lag_names():
    return [f"no2_lag_{k}" for k in W.TARGET_LAGS]


_LAG1 = ", ".join(f"lag(no2, {k}) {OVER} AS no2_lag_{k}" for k in W.TARGET_LAGS)
_LAG2 = [f"{c}_lag_{k}=lag({c}, {k}) {OVER}" for c in ["so2", *_lag_names()] for k in W.OTHER_LAGS]


@query(
    "E1_add_lags",
    "daily",
    f"WITH l AS (SELECT dataset_id, time, no2, so2, {_LAG1} FROM daily) SELECT dataset_id, time, {r('no2', 'so2', *_lag_names(), *_LAG2)} FROM l",
)
def _(spark, sf):
    return rounded(W.add_lags(V.daily(spark, sf).select("dataset_id", "time", "no2", "so2"), "no2", ["so2"]))


def rolling_sql(c: str, k: int, over: str = "PARTITION BY dataset_id ORDER BY time") -> dict[str, str]:
    w = f"OVER ({over} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    fns = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return {f"{c}_rolling_{n}_{k}": f"CASE WHEN count({c}) {w} = {k} THEN {f}({c}) {w} END" for n, f in fns.items()}


_ROLL = {n: e for c in ("no2", "co") for k in W.ROLLING for n, e in rolling_sql(c, k).items()}


@query(
    "E2_add_rolling",
    "daily",
    f"SELECT dataset_id, time, {r(*[f'{n}={e}' for n, e in _ROLL.items()])} FROM daily",
)
def _(spark, sf):
    d = V.daily(spark, sf).select("dataset_id", "time", "no2", "co")
    return rounded(W.add_rolling(d, ["no2", "co"]).drop("no2", "co"))


@query(
    "E3_add_diffs",
    "daily",
    f"""SELECT dataset_id, time, {r(*[f'{c}_diff_{k}={c} - lag({c}, {k}) {OVER}' for c in ('no2', 'so2') for k in W.DIFFS])} FROM daily""",
)
def _(spark, sf):
    d = V.daily(spark, sf).select("dataset_id", "time", "no2", "so2")
    return rounded(W.add_diffs(d, ["no2", "so2"]).drop("no2", "so2"))


@query(
    "E4_smooth_centered",
    "gappy",
    f"""SELECT {K}, time, {r('value', '''smoothed=CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END''')} FROM gappy
        WINDOW w AS (PARTITION BY dataset_id, variable ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def _(spark, sf):
    return rounded(W.smooth_centered(V.gappy(spark, sf)))


@query(
    "E5_temporal_smooth3",
    "grid",
    f"""WITH {MASKED}, slots AS (SELECT {K}, time, row_number() {OVER2} AS slot FROM (SELECT DISTINCT {K}, time FROM masked)),
        m AS (SELECT m.*, slot FROM masked m JOIN slots s ON m.dataset_id = s.dataset_id AND m.variable = s.variable AND m.time = s.time)
        SELECT {K}, time, y, x, {r('''value=avg(value) OVER (PARTITION BY dataset_id, variable, y, x ORDER BY slot
          RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)''')} FROM m""",
)
def _(spark, sf):
    out = W.temporal_smooth3(masked(spark, sf))
    return rounded(out.select(*KEYS, "time", "y", "x", "value"))


@query(
    "E6_fill_gaps",
    "gappy",
    f"""WITH {CALENDAR.format('gappy')} SELECT {K}, time, value IS NULL AS was_missing, {r('value', '''filled=CASE WHEN value IS NOT NULL
        THEN value WHEN pi IS NOT NULL AND coalesce(ni, n+1) - pi - 1 <= 3 THEN
        CASE WHEN ni IS NULL THEN pv ELSE pv + (nv-pv)*(i-pi)/(ni-pi) END END''')} FROM near""",
)
def _(spark, sf):
    return rounded(W.fill_gaps(V.gappy(spark, sf)))


@query(
    "E7_gap_runs",
    "gappy",
    f"""WITH o AS (SELECT {K}, time, value, row_number() {OVER2} AS i FROM gappy),
        g AS (SELECT {K}, time, i - row_number() {OVER2} AS island FROM o WHERE value IS NULL)
        SELECT {K}, min(time) AS "start", count(*) AS length FROM g GROUP BY {K}, island""",
)
def _(spark, sf):
    return W.gap_runs(V.gappy(spark, sf))


@query(
    "E8_decompose",
    "grid",
    f"""WITH s AS (SELECT {K}, time, avg(value) AS value FROM grid GROUP BY 1, 2, 3),
        o AS (SELECT *, row_number() {OVER2} - 1 AS i, count(*) OVER (PARTITION BY {K}) AS n FROM s),
        t AS (SELECT *, i % 12 AS phase, CASE WHEN count(value) OVER w = 11 THEN (sum(value) OVER w + .5*(lag(value, 6) {OVER2}
          + lead(value, 6) {OVER2}))/12 END AS trend FROM o WINDOW w AS (PARTITION BY {K} ORDER BY time ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
        p AS (SELECT {K}, phase, avg(value - trend) AS m FROM t GROUP BY 1, 2, 3),
        q AS (SELECT {K}, phase, m - avg(m) OVER (PARTITION BY {K}) AS seasonal FROM p)
        SELECT t.dataset_id, t.variable, time, {r('value', 'trend', 'seasonal', 'resid=value-trend-seasonal')}
        FROM t JOIN q ON t.dataset_id = q.dataset_id AND t.variable = q.variable AND t.phase = q.phase WHERE n >= 24""",
)
def _(spark, sf):
    return rounded(W.decompose(A.spatial_mean(V.grid(spark, sf))))


TREND_SQL = f"""o AS (SELECT *, row_number() {OVER2} - 1 AS i, count(*) OVER (PARTITION BY {K}) AS n FROM series),
    tail AS (SELECT *, greatest(n-14, 0) AS s FROM o WHERE n >= 7 AND i >= greatest(n-14, 0)),
    recent AS (SELECT {K}, avg(value) FILTER (WHERE i >= n-7) AS recent_mean, avg(value) FILTER (WHERE i < s+7) AS previous_mean
      FROM tail GROUP BY 1, 2)"""


@query(
    "E9_recent_trend",
    "series",
    f"""WITH {TREND_SQL} SELECT {K}, {r('recent_mean', 'previous_mean', 'trend_pct=(recent_mean-previous_mean)/previous_mean*100')},
        CASE WHEN recent_mean > previous_mean THEN 'increasing' ELSE 'decreasing' END AS direction FROM recent""",
)
def _(spark, sf):
    return rounded(W.recent_trend(V.series(spark, sf)))


@query(
    "E10_current_value",
    "gappy",
    f"SELECT {K}, {r('current_value=arg_max(value, time)')}, max(time) AS current_time FROM gappy WHERE value IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(W.current_value(V.gappy(spark, sf)))


@query(
    "E11_ffill_bfill",
    "gappy",
    f"""SELECT {K}, time, {r('value', 'filled=coalesce(last_value(value IGNORE NULLS) OVER p, first_value(value IGNORE NULLS) OVER q)')} FROM gappy
        WINDOW p AS (PARTITION BY {K} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               q AS (PARTITION BY {K} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def _(spark, sf):
    return rounded(W.ffill_bfill_mean(V.gappy(spark, sf)))


SPLIT_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY time) - 1 AS i,
      count(*) OVER (PARTITION BY dataset_id) AS m FROM daily),
    splits AS (SELECT *, CASE WHEN i >= m - floor(m*.15) THEN 'test' WHEN i >= m - 2*floor(m*.15) THEN 'val' ELSE 'train' END AS split FROM o)"""


@query("E12_chrono_split", "daily", f"WITH {SPLIT_SQL} SELECT dataset_id, time, split FROM splits")
def _(spark, sf):
    return W.chrono_split(V.daily(spark, sf).select("dataset_id", "time"))


@query("E13_random_split")
def _(spark, sf):
    d = V.daily(spark, sf).select("dataset_id", "time")
    return W.random_split(d, ["dataset_id", "time"]).groupBy("dataset_id", "split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "E14_temporal_gaps",
    "gappy",
    f"""WITH s AS (SELECT {K}, epoch(time) - epoch(lag(time) {OVER2}) AS step FROM gappy WHERE value IS NOT NULL),
        m AS (SELECT {K}, quantile_cont(step, .5) AS med FROM s WHERE step IS NOT NULL GROUP BY 1, 2)
        SELECT s.dataset_id, s.variable, max(med) AS median_step, count(*) FILTER (WHERE step > 2*med) AS large_gaps, max(step) AS largest_step
        FROM s JOIN m ON s.dataset_id = m.dataset_id AND s.variable = m.variable WHERE step IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    return W.temporal_gaps(V.gappy(spark, sf).where(F.col("value").isNotNull()))


@query(
    "E15_rank_average",
    "series",
    f"""WITH v AS (SELECT {K}, time, round(value, 2) AS value FROM series)
        SELECT {K}, time, rank() OVER (PARTITION BY {K} ORDER BY value)
        + (count(*) OVER (PARTITION BY {K}, value) - 1)/2.0 AS rank FROM v""",
)
def _(spark, sf):
    s = V.series(spark, sf).withColumn("value", F.round("value", 2))
    return average_rank(s, KEYS, "value", "rank").select(*KEYS, "time", "rank")


@query(
    "E16_cdf",
    "grid",
    f"""WITH {hist_sql('grid', 256)}, c AS (SELECT {K}, bin, count, CAST(sum(count) OVER (PARTITION BY {K} ORDER BY bin) AS BIGINT) AS cum FROM hist)
        SELECT {K}, bin, count, cum, {r('cdf=(cum - min(cum) OVER (PARTITION BY dataset_id, variable))/(max(cum) OVER (PARTITION BY dataset_id, variable) - min(cum) OVER (PARTITION BY dataset_id, variable))')}
        FROM c""",
)
def _(spark, sf):
    hist = A.histogram(V.grid(spark, sf), 256).drop("width", "left_edge")
    return rounded(A.cdf(hist))


@query(
    "E17_qq_points",
    "series",
    f"""WITH o AS (SELECT {K}, value, count(*) OVER (PARTITION BY {K}) AS n, row_number() OVER (PARTITION BY {K} ORDER BY value, time) AS i
          FROM series WHERE value IS NOT NULL),
        p AS (SELECT *, CASE WHEN i = 1 THEN 1 - pow(0.5, 1e0/n) WHEN i = n THEN pow(0.5, 1e0/n) ELSE (i - 0.3175)/(n + 0.365) END AS p FROM o)
        SELECT {K}, i AS "order", {r('theoretical=' + special.normal_ppf('p'), 'ordered=value')} FROM p""",
)
def _(spark, sf):
    return rounded(W.qq_points(V.series(spark, sf), tiebreak=["time"]))


_FEATURES = ["no2", "so2"]
_L_LAGS, _L_OTHER, _L_SIZES, _L_DIFFS = (1, 7), (1,), (7,), (1,)


def _feature_sql():
    cal = {n: e for n, e in TEMPORAL_SQL.items()}
    waves = {
        "day_of_year_sin": "sin(2*pi()*dayofyear(time)/365)", "day_of_year_cos": "cos(2*pi()*dayofyear(time)/365)",
        "month_sin": "sin(2*pi()*month(time)/12)", "month_cos": "cos(2*pi()*month(time)/12)",
    }
    cal.update(waves)
    base = ", ".join(f"{e} AS {n}" for n, e in cal.items())
    own = [f"no2_lag_{k}" for k in _L_LAGS]
    lagged = ["so2", *[c for c in cal if c not in ("month", "season")], *own]
    l1 = ", ".join(f"lag(no2, {k}) {OVER} AS no2_lag_{k}" for k in _L_LAGS)
    l2 = ", ".join(f"lag({c}, {k}) {OVER} AS {c}_lag_{k}" for c in lagged for k in _L_OTHER)
    numeric = [*_FEATURES, *waves, "is_weekend", *own, *[f"{c}_lag_{k}" for c in lagged for k in _L_OTHER]]
    roll = {n: e for c in numeric for k in _L_SIZES for n, e in rolling_sql(c, k).items()}
    l3 = ", ".join(f"{e} AS {n}" for n, e in roll.items())
    diffed = [*numeric, *roll]
    l4 = ", ".join(f"{c} - lag({c}, {k}) {OVER} AS {c}_diff_{k}" for c in diffed for k in _L_DIFFS)
    cross = [(a, b) for a, b in list(zip(numeric, numeric[1:]))[:3]]
    l5 = ", ".join(f"{a}*{b} AS {a}_x_{b}" for a, b in cross)
    names = [*cal, *_FEATURES, *numeric[2:], *roll, *[f"{c}_diff_{k}" for c in diffed for k in _L_DIFFS], *[f"{a}_x_{b}" for a, b in cross]]
    names = list(dict.fromkeys(names))
    show = [n for n in names if n not in cal or n in waves]
    whole = [n for n in names if n in cal and n not in waves]
    lag_ints = [f"{c}_lag_1" for c in whole if c not in ("month", "season")]
    exact = {*whole, *lag_ints}
    exact |= {n for n in names for c in [*lag_ints, "is_weekend"] if n in (f"{c}_rolling_min_7", f"{c}_rolling_max_7", f"{c}_diff_1",
              f"{c}_rolling_min_7_diff_1", f"{c}_rolling_max_7_diff_1")}
    shown = ", ".join(n if n in exact else f"round({n}, 6) + 0.0 AS {n}" for n in names)
    keep = " AND ".join(f"{n} IS NOT NULL" for n in names)
    assert show
    return f"""WITH b AS (SELECT dataset_id, time, no2, so2, {base} FROM daily),
      l1 AS (SELECT *, {l1} FROM b), l2 AS (SELECT *, {l2} FROM l1), l3 AS (SELECT *, {l3} FROM l2),
      l4 AS (SELECT *, {l4} FROM l3), l5 AS (SELECT *, {l5} FROM l4)
      SELECT dataset_id, time, {shown} FROM l5 WHERE {keep}"""


@query("L1_engineer_features", "daily", _feature_sql())
def _(spark, sf):
    out = W.engineer_features(
        V.daily(spark, sf), "no2", _FEATURES, lags=_L_LAGS, other_lags=_L_OTHER, sizes=_L_SIZES, steps=_L_DIFFS
    )
    return rounded(out)


PLAN = W.FeaturePlan("no2", ("no2", "so2", "co", "o3"))


def matrix_layers(source: str = "daily", whole_rows: bool = True) -> str:
    """CTEs of all features at their default settings, up to ``rows_``: all rows, or those that have all of them."""
    cal = dict(TEMPORAL_SQL) | {
        "day_of_year_sin": "sin(2*pi()*dayofyear(time)/365)", "day_of_year_cos": "cos(2*pi()*dayofyear(time)/365)",
        "month_sin": "sin(2*pi()*month(time)/12)", "month_cos": "cos(2*pi()*month(time)/12)",
    }
    base = ", ".join(f"CAST({cal[n]} AS DOUBLE) AS {n}" for n in PLAN.calendar)
    variables = ", ".join(f"CAST({v} AS DOUBLE) AS {v}" for v in PLAN.variables)
    lag = lambda name, c, k: f"lag({c}, {k}) {OVER} AS {name}"
    roll = {n: e for c in PLAN.numeric for k in PLAN.sizes for n, e in rolling_sql(c, k).items()}
    layers = [
        [lag(*f) for f in PLAN.own_lags],
        [lag(*f) for f in PLAN.further_lags],
        [f"{e} AS {n}" for n, e in roll.items()],
        [f"{c} - lag({c}, {k}) {OVER} AS {n}" for n, c, k in PLAN.diffs],
        [f"{a} * {b} AS {n}" for n, a, b in PLAN.products],
    ]
    ctes = ", ".join(f"l{i + 1} AS (SELECT *, {', '.join(layer)} FROM l{i})" for i, layer in enumerate(layers))
    keep = " AND ".join(f"{n} IS NOT NULL" for n in PLAN.names) if whole_rows else "TRUE"
    return f"""l0 AS (SELECT dataset_id, time, {variables}, {base} FROM {source}), {ctes},
      rows_ AS (SELECT dataset_id, time, {", ".join(PLAN.names)} FROM l5 WHERE {keep})"""


#: one row per feature, so that a result of two thousand columns can be compared
MATRIX_STATS = "SELECT feature, count(*) AS n, " + ", ".join(
    f"round({f}(v), 6) + 0.0 AS {n}" for n, f in (("mean", "avg"), ("low", "min"), ("high", "max"))
)


def matrix_sql(source: str = "daily", before: str = "", whole_rows: bool = True) -> str:
    return f"""WITH {before}{matrix_layers(source, whole_rows)},
      tall AS (UNPIVOT (SELECT * EXCLUDE (dataset_id, time) FROM rows_) ON COLUMNS(*) INTO NAME feature VALUE v)
      {MATRIX_STATS} FROM tall GROUP BY 1"""


def matrix_stats(matrix):
    """The same of a matrix in Spark."""
    names = F.array(*[F.lit(n) for n in PLAN.names])
    tall = matrix.select(F.posexplode("features").alias("pos", "v")).where(~F.isnan("v"))
    found = tall.groupBy("pos").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    return rounded(found.select(names[F.col("pos")].alias("feature"), "n", "mean", "low", "high"))


@query("L1_feature_matrix", "daily", matrix_sql())
def _(spark, sf):
    return matrix_stats(W.feature_matrix(V.daily(spark, sf), PLAN))
