"""Queries for alignment, correlation, trend and anomaly operators."""

import math

from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.functions import geo, special
from airgrid.operators import aggregates as A
from airgrid.operators import align as L
from airgrid.operators import statistics as S
from airgrid.operators.isolation import anomalies_isolation
from airgrid.operators.ordering import concordance
from airgrid.operators.slicing import filter_cloud_cover, filter_dates
from airgrid.plans import views as V
from airgrid.plans.aggregate_queries import FENCES, K, LOWERED, MASKED, lowered, masked
from airgrid.plans.registry import DUCK, query, r, rounded

VARS = ["no2", "so2", "co", "o3"]
THREE = ["no2", "so2", "co"]


def wide(spark, sf):
    return L.align_inner(V.series(spark, sf), VARS)


# ------------------------------------------------------------------ alignment

_PIVOT = ", ".join(f"max(CASE WHEN variable = '{v}' THEN value END) AS {v}" for v in ("no2", "so2"))


@query(
    "F1_align_inner",
    "gappy",
    f"""WITH p AS (SELECT dataset_id, time, {_PIVOT} FROM gappy GROUP BY 1, 2)
        SELECT dataset_id, time, {r('no2', 'so2')} FROM p WHERE no2 IS NOT NULL AND so2 IS NOT NULL""",
)
def _(spark, sf):
    return rounded(L.align_inner(V.gappy(spark, sf), ["no2", "so2"]))


@query("F2_align_outer", "gappy", f"WITH p AS (SELECT dataset_id, time, {_PIVOT} FROM gappy GROUP BY 1, 2) SELECT dataset_id, time, {r('no2', 'so2')} FROM p")
def _(spark, sf):
    return rounded(L.align_outer(V.gappy(spark, sf), ["no2", "so2"]))


@query(
    "F3_fuse_weighted",
    "grid",
    f"""WITH {MASKED}, {LOWERED}, three AS (SELECT dataset_id, variable, time, y, x, value, 0 AS src FROM masked
          UNION ALL SELECT dataset_id, variable, time, y, x, value, 1 FROM lowered WHERE variable = 'no2' AND y < 7)
        SELECT {K}, time, y, x, {r('value=coalesce(avg(value), 0)')} FROM three WHERE variable = 'no2'
        GROUP BY 1, 2, 3, 4, 5 HAVING min(src) = 0""",
)
def _(spark, sf):
    second = lowered(spark, sf).where((F.col("variable") == "no2") & (F.col("y") < 7))
    return rounded(L.fuse_weighted([masked(spark, sf), second]))


@query(
    "F4_mosaic",
    "grid",
    f"""WITH {MASKED} SELECT {K}, y, x, {r('value=arg_max(value, time)')}, max(time) AS time FROM masked
        WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return rounded(L.mosaic(masked(spark, sf)))


@query(
    "F5_scene_join",
    "scenes",
    """SELECT l_orderkey AS scene_id, l_linenumber, l_quantity AS value FROM lineitem WHERE l_orderkey IN
       (SELECT scene_id FROM scenes WHERE cloud_cover < 20 AND time_start >= TIMESTAMP '1996-01-01' AND time_start < TIMESTAMP '1998-01-01')""",
)
def _(spark, sf):
    cells = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scene_id"), "l_linenumber", F.col("l_quantity").alias("value")
    )
    catalogue = filter_dates(filter_cloud_cover(V.scenes(spark, sf)), "1996-01-01", "1998-01-01", time="time_start")
    return L.scene_join(cells, catalogue, {"scene_id": "scene_id"})


PAIRS = """s AS (SELECT dataset_id, variable, time, round(value, 1) AS value FROM series WHERE variable IN ('no2', 'so2')),
    w AS (SELECT dataset_id, time, max(CASE WHEN variable = 'no2' THEN value END) AS a, max(CASE WHEN variable = 'so2' THEN value END) AS b
          FROM s GROUP BY 1, 2)"""


@query(
    "F7_pair_concordance",
    "series",
    f"""WITH {PAIRS} SELECT p.dataset_id, max(m) AS n, CAST(sum(sign(q.a - p.a)*sign(q.b - p.b)) AS BIGINT) AS s
        FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS m FROM w) p
        JOIN w q ON p.dataset_id = q.dataset_id AND p.time < q.time GROUP BY 1""",
)
def _(spark, sf):
    s = V.series(spark, sf).withColumn("value", F.round("value", 1))
    w = L.align_inner(s, ["no2", "so2"])
    return concordance(w, ["dataset_id"], "no2", "so2")


@query(
    "F8_variable_pairs",
    "series event_series",
    """WITH v AS (SELECT DISTINCT dataset_id, variable FROM series UNION SELECT DISTINCT dataset_id, variable FROM event_series)
       SELECT a.dataset_id, a.variable AS variable_a, b.variable AS variable_b FROM v a JOIN v b
       ON a.dataset_id = b.dataset_id AND a.variable <> b.variable""",
)
def _(spark, sf):
    cols = ["dataset_id", "variable"]
    return L.variable_pairs(V.series(spark, sf).select(*cols).union(V.event_series(spark, sf).select(*cols)))


def bilinear_sql(my: int, mx: int, sy: str, sx: str, lat: str, lon: str, where: str = "true") -> str:
    """Four-corner interpolation of ``masked`` at the targets (y, x)."""
    ny, nx = V.NY, V.NX
    return f"""t0 AS (SELECT CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x FROM range({my}) a(y), range({mx}) b(x)),
      t1 AS (SELECT y, x, {lat} AS lat, {lon} AS lon FROM t0),
      t2 AS (SELECT *, {sy} AS sy, {sx} AS sx FROM t1),
      t3 AS (SELECT *, least(CAST(floor(sy) AS INTEGER), {ny - 2}) AS y0, least(CAST(floor(sx) AS INTEGER), {nx - 2}) AS x0 FROM t2 WHERE {where}),
      corners AS (SELECT t3.y, t3.x, t3.lat, t3.lon, y0 + d.dy AS cy, x0 + e.dx AS cx,
        (CASE d.dy WHEN 1 THEN sy - y0 ELSE 1 - (sy - y0) END)*(CASE e.dx WHEN 1 THEN sx - x0 ELSE 1 - (sx - x0) END) AS w
        FROM t3, (VALUES (0), (1)) d(dy), (VALUES (0), (1)) e(dx)),
      need AS (SELECT *, count(*) OVER (PARTITION BY y, x) AS need FROM corners WHERE w > 0),
      got AS (SELECT m.dataset_id, m.variable, m.time, n.y, n.x, max(n.lat) AS lat, max(n.lon) AS lon,
        CASE WHEN count(m.value) = max(need) THEN sum(m.value*w) END AS value
        FROM masked m JOIN need n ON m.y = n.cy AND m.x = n.cx GROUP BY 1, 2, 3, 4, 5)
      SELECT dataset_id, variable, time, y, x, {r('lat', 'lon', 'value')} FROM got"""


_METRES = 25_000.0
_SHAPE = L.target_shape(V.BBOX, _METRES)


@query(
    "F9_resample_bilinear",
    "grid",
    f"WITH {MASKED}, "
    + bilinear_sql(
        *_SHAPE,
        f"y*CAST({(V.NY - 1) / (_SHAPE[0] - 1)!r} AS DOUBLE)",
        f"x*CAST({(V.NX - 1) / (_SHAPE[1] - 1)!r} AS DOUBLE)",
        f"32.5 + y*3.0/{_SHAPE[0] - 1}",
        f"71.5 + x*3.0/{_SHAPE[1] - 1}",
    ),
)
def _(spark, sf):
    return rounded(L.resample_bilinear(masked(spark, sf), V.BBOX, (V.NY, V.NX), _METRES))


_REF = {"bbox": {"south": 33.05, "north": 36.05, "west": 72.05, "east": 75.05}, "shape": (7, 8)}


@query(
    "F12_align_to_reference",
    "grid",
    f"WITH {MASKED}, "
    + bilinear_sql(
        7, 8, "(lat - 32.5)/CAST(3.0 AS DOUBLE)*9", "(lon - 71.5)/CAST(3.0 AS DOUBLE)*19",
        "CAST(33.05 AS DOUBLE) + y*CAST(3.0 AS DOUBLE)/6", "CAST(72.05 AS DOUBLE) + x*CAST(3.0 AS DOUBLE)/7",
        "sy BETWEEN 0 AND 9 AND sx BETWEEN 0 AND 19",
    ),
)
def _(spark, sf):
    return rounded(L.align_to_reference(masked(spark, sf), V.BBOX, (V.NY, V.NX), _REF))


_ZONE, _CELL_METRES = 43, 40_000.0


def _utm_frame() -> tuple[float, float, int, int]:
    """West and south end and the size of the UTM grid around the box, from points along its outline."""
    k, e = geo.UTM_SCALE * geo._RECTIFYING, 2 * math.sqrt(geo._N) / (1 + geo._N)
    steps, easts, norths = [i / 32 for i in range(33)], [], []
    for a in steps:
        for b in steps if a in (0.0, 1.0) else (0.0, 1.0):
            lat, lon = V.BBOX["south"] + a * (V.BBOX["north"] - V.BBOX["south"]), V.BBOX["west"] + b * (V.BBOX["east"] - V.BBOX["west"])
            s, dl = math.sin(math.radians(lat)), math.radians(lon - (_ZONE * 6 - 183))
            t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
            xi, eta = math.atan2(t, math.cos(dl)), math.atanh(math.sin(dl) / math.sqrt(1 + t * t))
            terms = list(enumerate(geo._ALPHA, start=1))
            easts.append(geo.FALSE_EASTING + k * (eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in terms)))
            norths.append(k * (xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in terms)))
    size = lambda v: int((max(v) - min(v)) / _CELL_METRES) + 1
    return min(easts), min(norths), size(norths), size(easts)


def _reproject_sql() -> str:
    west, south, my, mx = _utm_frame()
    k = geo.UTM_SCALE * geo._RECTIFYING
    xi, eta = f"(({south!r} + y*{_CELL_METRES!r})/{k!r})", f"(({west!r} + x*{_CELL_METRES!r} - 500000e0)/{k!r})"
    xp = f"({xi}" + "".join(f" - ({b!r})*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, b in enumerate(geo._BETA, start=1)) + ")"
    ep = f"({eta}" + "".join(f" - ({b!r})*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, b in enumerate(geo._BETA, start=1)) + ")"
    chi = f"asin(sin({xp})/cosh({ep}))"
    lat = f"degrees({chi}" + "".join(f" + ({d!r})*sin({2 * j}*{chi})" for j, d in enumerate(geo._DELTA, start=1)) + ")"
    lon = f"({_ZONE * 6 - 183} + degrees(atan2(sinh({ep}), cos({xp}))))"
    box = V.BBOX
    sy = f"(lat - {box['south']!r})/CAST({box['north'] - box['south']!r} AS DOUBLE)*{V.NY - 1}"
    sx = f"(lon - {box['west']!r})/CAST({box['east'] - box['west']!r} AS DOUBLE)*{V.NX - 1}"
    inner = bilinear_sql(my, mx, sy, sx, lat, lon, f"sy BETWEEN 0 AND {V.NY - 1} AND sx BETWEEN 0 AND {V.NX - 1}")
    return f"""WITH {MASKED}, placed AS (WITH {inner}) SELECT *,
        {r(f'easting=CAST({west!r} + x*{_CELL_METRES!r} AS DOUBLE)', f'northing=CAST({south!r} + y*{_CELL_METRES!r} AS DOUBLE)')} FROM placed"""


@query("F10_reproject", "grid", _reproject_sql())
def _(spark, sf):
    return rounded(L.reproject(masked(spark, sf), V.BBOX, (V.NY, V.NX), _ZONE, _CELL_METRES))


@query(
    "F11_grid_points",
    "points",
    """WITH np AS (SELECT TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon FROM points),
       c AS (SELECT CAST(round((lat-32.5)/(25/111.32)) AS INTEGER) AS y,
                    CAST(round((lon-71.5)/(25/(111.32*cos(radians(34.0))))) AS INTEGER) AS x, count(*) AS n FROM np
             WHERE lat IS NOT NULL GROUP BY 1, 2)
       SELECT CAST(gy.y AS INTEGER) AS y, CAST(gx.x AS INTEGER) AS x, round(32.5 + gy.y*(25/111.32), 6) AS lat,
              round(71.5 + gx.x*(25/(111.32*cos(radians(34.0)))), 6) AS lon, coalesce(n, 0) AS n
       FROM range(CAST(floor(3.0/(25/111.32)) AS BIGINT) + 1) gy(y), range(CAST(floor(3.0/(25/(111.32*cos(radians(34.0))))) AS BIGINT) + 1) gx(x)
       LEFT JOIN c ON c.y = gy.y AND c.x = gx.x""",
)
def _(spark, sf):
    import math

    dlat, dlon = 25 / 111.32, 25 / (111.32 * math.cos(math.radians(34.0)))
    p = V.points(spark, sf).withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")})
    near = p.where(F.col("latitude").isNotNull()).groupBy(
        F.round((F.col("latitude") - 32.5) / dlat).cast("int").alias("y"),
        F.round((F.col("longitude") - 71.5) / dlon).cast("int").alias("x"),
    ).agg(F.count(F.lit(1)).alias("n"))
    mesh = L.grid_points(spark, V.BBOX, 25.0)
    return rounded(A.merge_on(mesh, near, ["y", "x"]).withColumn("n", F.coalesce("n", F.lit(0))))


@query(
    "F13_wind_overlay",
    "grid points",
    f"""WITH np AS (SELECT point_id, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon,
           (point_id % 21) - 10.0 AS u, (point_id % 13) - 6.0 AS v FROM points),
        c AS (SELECT CAST(round((lat-32.5)/3.0*9) AS INTEGER) AS y, CAST(round((lon-71.5)/3.0*19) AS INTEGER) AS x,
           avg(u) AS u, avg(v) AS v, count(*) AS wind_points FROM np WHERE lat IS NOT NULL GROUP BY 1, 2)
        SELECT g.dataset_id, g.variable, g.time, g.y, g.x, wind_points, {r('value', 'u', 'v', 'speed=sqrt(u*u+v*v)',
          '''direction=CASE WHEN u = 0 AND v = 0 THEN 0 WHEN atan2(u, v) < 0 THEN degrees(atan2(u, v)) + 360 ELSE degrees(atan2(u, v)) END''')}
        FROM grid g LEFT JOIN c ON g.y = c.y AND g.x = c.x
        WHERE time = (SELECT max(time) FROM grid h WHERE h.dataset_id = g.dataset_id AND h.variable = g.variable)""",
)
def _(spark, sf):
    k = F.col("point_id")
    wind = V.points(spark, sf).select(
        F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lon"),
        (k % 21 - 10.0).alias("u"),
        (k % 13 - 6.0).alias("v"),
    )
    out = L.wind_overlay(V.grid(spark, sf), wind.where(F.col("lat").isNotNull()), V.BBOX, (V.NY, V.NX))
    return rounded(out.drop("lat", "lon", "qa"))


# ------------------------------------------------------------------ statistics


@query(
    "D2_mean_ci",
    "series",
    f"""WITH s AS (SELECT {K}, count(value) AS n, avg(value) AS mean, stddev_samp(value)/sqrt(count(value)) AS sem FROM series GROUP BY 1, 2),
        d AS (SELECT *, CAST(n - 1 AS DOUBLE) AS dof FROM s WHERE n >= 30),
        h AS (SELECT *, sem*{special.t_quantile((1 + 0.95) / 2, 'dof', DUCK)} AS half FROM d)
        SELECT {K}, n, {r('mean', 'sem', 'ci_low=mean-half', 'ci_high=mean+half')} FROM h""",
)
def _(spark, sf):
    return rounded(S.mean_ci(V.series(spark, sf)))


_CRITICAL = ", ".join(
    f"round({v!r}/(1 + 4e0/n - 25e0/n/n), 3) + 0.0 AS critical_{k}" for k, v in S.ANDERSON_CRITICAL.items()
)


@query(
    "D3_anderson_darling",
    "series",
    f"""WITH p AS (SELECT {K}, count(*) OVER k AS n, row_number() OVER (k ORDER BY value, time) AS i,
          (value - avg(value) OVER k)/stddev_samp(value) OVER k AS z FROM series WHERE value IS NOT NULL WINDOW k AS (PARTITION BY {K})),
        a AS (SELECT {K}, max(n) AS n, -max(n) - sum((2*i - 1)*{special.log_normal_cdf('z')}
          + (2*(n - i) + 1)*{special.log_normal_cdf('(-z)')})/max(n) AS statistic FROM p GROUP BY 1, 2)
        SELECT {K}, n, {r('statistic')}, {_CRITICAL} FROM a""",
)
def _(spark, sf):
    return rounded(S.anderson_darling(V.series(spark, sf), tiebreak=["time"]))


def _pair_list(variables):
    return [(a, b) for i, a in enumerate(variables) for b in variables[i + 1 :]]


def _pair_sql(source: str, template: str, variables=VARS) -> str:
    return " UNION ALL ".join(
        f"SELECT dataset_id, '{a}' AS variable_a, '{b}' AS variable_b, {template.format(a=a, b=b)} FROM {source} GROUP BY 1"
        for a, b in _pair_list(variables)
    )


def _full_sql(half: str) -> str:
    same = " UNION ALL ".join(f"SELECT dataset_id, '{v}', '{v}', 1.0, count(*) FROM daily GROUP BY 1" for v in VARS)
    return f"""h AS ({half}) SELECT dataset_id, variable_a, variable_b, round(r, 6) + 0.0 AS r, n FROM (SELECT * FROM h UNION ALL
      SELECT dataset_id, variable_b, variable_a, r, n FROM h UNION ALL {same})"""


@query("H1_correlation_pearson", "daily", "WITH " + _full_sql(_pair_sql("daily", "corr({a}, {b}) AS r, count(*) AS n")))
def _(spark, sf):
    return rounded(S.correlation(wide(spark, sf), VARS))


_RANKS = ", ".join(
    f"rank() OVER (PARTITION BY dataset_id ORDER BY {v}) + (count(*) OVER (PARTITION BY dataset_id, {v}) - 1)/2.0 AS {v}" for v in VARS
)


@query(
    "H1_correlation_spearman",
    "daily",
    f"WITH ranked AS (SELECT dataset_id, {_RANKS} FROM daily), " + _full_sql(_pair_sql("ranked", "corr({a}, {b}) AS r, count(*) AS n")),
)
def _(spark, sf):
    return rounded(S.correlation(wide(spark, sf), VARS, "spearman"))


@query(
    "H1_correlation_kendall",
    "series",
    f"""WITH {PAIRS}, c AS (SELECT p.dataset_id, max(m) AS n, sum(sign(q.a - p.a)*sign(q.b - p.b)) AS s,
          count(*) FILTER (WHERE q.a = p.a) AS ta, count(*) FILTER (WHERE q.b = p.b) AS tb, count(*) AS total
          FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS m FROM w) p JOIN w q ON p.dataset_id = q.dataset_id AND p.time < q.time GROUP BY 1)
        SELECT dataset_id, 'no2' AS variable_a, 'so2' AS variable_b, {r('r=s/sqrt(CAST(total-ta AS DOUBLE)*(total-tb))')}, n FROM c""",
)
def _(spark, sf):
    s = V.series(spark, sf).withColumn("value", F.round("value", 1))
    return rounded(S.correlation_pairs(L.align_inner(s, ["no2", "so2"]), ["no2", "so2"], "kendall"))


_PEARSON = _full_sql(_pair_sql("daily", "corr({a}, {b}) AS r, count(*) AS n")).replace("round(r, 6) + 0.0 AS r", "r")


@query(
    "H2_correlation_significance",
    "daily",
    f"""WITH m AS (WITH {_PEARSON}),
        t AS (SELECT *, CAST(n - 2 AS DOUBLE) AS dof, CASE WHEN abs(r) >= 1 THEN CAST('inf' AS DOUBLE) ELSE r*sqrt((n - 2)/(1 - r*r)) END AS t FROM m),
        p AS (SELECT *, {special.t_pvalue('t', 'dof', DUCK)} AS p_value FROM t)
        SELECT dataset_id, variable_a, variable_b, n, {r('r', 't', 'p_value')}, p_value < 0.05 AS significant FROM p""",
)
def _(spark, sf):
    return rounded(S.correlation_significance(wide(spark, sf), VARS))


_MK = f"""s AS (SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY time) AS i, value FROM event_series),
    m AS (SELECT p.dataset_id, p.variable, CAST(sum(sign(q.value - p.value)) AS BIGINT) AS s FROM s p JOIN s q
      ON p.dataset_id = q.dataset_id AND p.variable = q.variable AND p.i < q.i GROUP BY 1, 2),
    n AS (SELECT {K}, count(*) AS n FROM s GROUP BY 1, 2),
    z AS (SELECT m.*, n, n*(n-1.0)*(2*n+5)/18 AS var_s FROM m JOIN n ON m.dataset_id = n.dataset_id AND m.variable = n.variable),
    y AS (SELECT *, CASE WHEN s > 0 THEN (s-1)/sqrt(var_s) WHEN s < 0 THEN (s+1)/sqrt(var_s) ELSE 0 END AS z FROM z)"""


def _mk_sql(view):
    return f"""WITH {_MK.replace('event_series', view)} SELECT {K}, n, s, {r('var_s', 'z', 'p_value=' + special.normal_pvalue('z'))},
        CASE WHEN z > 1.96 THEN 'increasing' WHEN z < -1.96 THEN 'decreasing' ELSE 'no trend' END AS trend FROM y"""


@query("H3_mann_kendall", "series", _mk_sql("series"))
def _(spark, sf):
    return rounded(S.mann_kendall(V.series(spark, sf)))


@query("H3_mann_kendall_events", "event_series", _mk_sql("event_series"))
def _(spark, sf):
    return rounded(S.mann_kendall(V.event_series(spark, sf)))


_POS = f"o AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY time) - 1 AS i FROM gappy WHERE value IS NOT NULL)"
_REGR = f"""{_POS}, f AS (SELECT {K}, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept, regr_r2(value, i) AS r2,
    count(*) AS n FROM o GROUP BY 1, 2 HAVING count(*) >= 10)"""


@query(
    "H4_linear_trend",
    "gappy",
    f"""WITH {_REGR}, t AS (SELECT *, CAST(n - 2 AS DOUBLE) AS dof,
          CASE WHEN r2 < 1 THEN sqrt(r2*(n - 2)/(1 - r2)) ELSE CAST('inf' AS DOUBLE) END AS t FROM f)
        SELECT {K}, n, round(slope, 9) + 0.0 AS slope, {r('intercept', 'r2', 'p_value=' + special.t_pvalue('t', 'dof', DUCK))},
        CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM t""",
)
def _(spark, sf):
    t = S.linear_trend(V.gappy(spark, sf))
    return rounded(t.drop("slope")).join(t.select(*KEYS, (F.round("slope", 9) + 0.0).alias("slope")), list(KEYS))


@query(
    "H4_trend_line",
    "gappy",
    f"""WITH {_REGR} SELECT o.dataset_id, o.variable, time, {r('value', 'trend_line=intercept+slope*i', 'detrended=value-intercept-slope*i')}
        FROM o JOIN f ON o.dataset_id = f.dataset_id AND o.variable = f.variable""",
)
def _(spark, sf):
    return rounded(S.trend_line(V.gappy(spark, sf)))


@query(
    "H5_partial_correlation",
    "daily",
    f"""WITH c AS (SELECT dataset_id, count(*) AS n, corr(no2, so2) AS ab, corr(no2, co) AS ac, corr(so2, co) AS bc FROM daily GROUP BY 1)
        SELECT dataset_id, n, 'no2' AS variable_a, 'so2' AS variable_b, {r('partial_r=(ab-ac*bc)/sqrt((1-ac*ac)*(1-bc*bc))')} FROM c UNION ALL
        SELECT dataset_id, n, 'no2', 'co', {r('partial_r=(ac-ab*bc)/sqrt((1-ab*ab)*(1-bc*bc))')} FROM c UNION ALL
        SELECT dataset_id, n, 'so2', 'co', {r('partial_r=(bc-ab*ac)/sqrt((1-ab*ab)*(1-ac*ac))')} FROM c""",
)
def _(spark, sf):
    return rounded(S.partial_correlation(wide(spark, sf), THREE))


_SIMPLE = " UNION ALL ".join(
    f"""SELECT dataset_id, '{x}' AS predictor, '{y}' AS target, regr_slope({y}, {x}) AS coefficient, regr_intercept({y}, {x}) AS intercept,
        regr_r2({y}, {x}) AS r2, count(*) AS n, var_pop({y})*(1-regr_r2({y}, {x})) AS mse, var_pop({x}) AS vx FROM daily GROUP BY 1"""
    for x in THREE
    for y in THREE
    if x != y
)


@query(
    "H6_simple_regressions",
    "daily",
    f"""WITH f AS ({_SIMPLE}), e AS (SELECT *, sqrt(mse/((n-2)*vx)) AS std_error, CAST(n - 2 AS DOUBLE) AS dof FROM f WHERE n >= 10),
        t AS (SELECT *, coefficient/std_error AS t FROM e)
        SELECT dataset_id, predictor, target, n, {r('coefficient', 'intercept', 'r2', 'mse', 'rmse=sqrt(mse)', 'std_error',
        'p_value=' + special.t_pvalue('t', 'dof', DUCK))} FROM t""",
)
def _(spark, sf):
    return rounded(S.simple_regressions(wide(spark, sf), THREE))


@query("H7_multiple_regression")
def _(spark, sf):
    return rounded(S.multiple_regression(wide(spark, sf), VARS))


@query(
    "H8_anomalies_zscore",
    "gappy",
    f"""WITH z AS (SELECT {K}, time, value, abs(value - avg(value) OVER w)/stddev_pop(value) OVER w AS zscore FROM gappy
          WINDOW w AS (PARTITION BY {K}))
        SELECT {K}, time, {r('value', 'zscore')}, coalesce(zscore > 3, false) AS is_anomaly FROM z""",
)
def _(spark, sf):
    return rounded(S.anomalies_zscore(V.gappy(spark, sf)))


@query(
    "H9_anomalies_iqr",
    "gappy",
    f"""WITH {FENCES.format('gappy', 1.5)} SELECT g.dataset_id, g.variable, count(*) FILTER (WHERE value < lo OR value > hi) AS anomalies,
        {r('anomaly_pct=count(*) FILTER (WHERE value < lo OR value > hi)*100.0/count(*)')}
        FROM gappy g JOIN fences f ON g.dataset_id = f.dataset_id AND g.variable = f.variable GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(S.anomaly_summary(S.anomalies_iqr(V.gappy(spark, sf))))


@query("H10_anomalies_isolation")
def _(spark, sf):
    return rounded(S.anomaly_summary(anomalies_isolation(V.series(spark, sf))))


@query(
    "H11_remove_outliers_zscore",
    "grid",
    f"""WITH z AS (SELECT {K}, time, y, x, value, abs(value - avg(value) OVER w)/stddev_pop(value) OVER w AS z FROM grid
          WINDOW w AS (PARTITION BY {K}))
        SELECT {K}, time, y, x, {r('value=CASE WHEN z > 2 THEN NULL ELSE value END')} FROM z""",
)
def _(spark, sf):
    return rounded(S.remove_outliers(V.grid(spark, sf), "zscore", 2.0).select(*KEYS, "time", "y", "x", "value"))


@query(
    "H11_remove_outliers_iqr",
    "grid",
    f"""WITH {FENCES.format('grid', 0.5)} SELECT g.dataset_id, g.variable, time, y, x,
        {r('value=CASE WHEN value < lo OR value > hi THEN NULL ELSE value END')}
        FROM grid g JOIN fences f ON g.dataset_id = f.dataset_id AND g.variable = f.variable""",
)
def _(spark, sf):
    return rounded(S.remove_outliers(V.grid(spark, sf), "iqr", 0.5).select(*KEYS, "time", "y", "x", "value"))


@query("H12_pca")
def _(spark, sf):
    return rounded(S.pca(wide(spark, sf), VARS).drop("loadings"))


def _distances_sql(points: str, out: str) -> str:
    apart = " + ".join(f"(a.{v} - b.{v}) * (a.{v} - b.{v})" for v in THREE)
    return f"""{out} AS (SELECT a.dataset_id, avg(sqrt({apart})) AS d FROM {points} a JOIN {points} b
        ON a.dataset_id = b.dataset_id AND a.time < b.time GROUP BY 1)"""


def _uniform_sql(i: int, v: str) -> str:
    drawn = f"md5('{42 + i}|' || dataset_id || '|' || CAST(time AS VARCHAR))"
    return f"lo + CAST(('0x' || substring({drawn}, 1, 7)) AS BIGINT) / 268435456.0::DOUBLE * (hi - lo) AS {v}"


@query(
    "H13_hopkins",
    "daily",
    f"""WITH spans AS (SELECT dataset_id, count(*) AS n, least({", ".join(f"min({v})" for v in THREE)}) AS lo,
          greatest({", ".join(f"max({v})" for v in THREE)}) AS hi FROM daily GROUP BY 1),
        drawn AS (SELECT dataset_id, time, {", ".join(_uniform_sql(i, v) for i, v in enumerate(THREE))} FROM daily JOIN spans USING (dataset_id)),
        {_distances_sql("daily", "own")}, {_distances_sql("drawn", "other")},
        h AS (SELECT s.dataset_id, n, own.d AS mean_distance, CASE WHEN n >= 10 THEN other.d / nullif(own.d + other.d, 0) END AS h
          FROM spans s LEFT JOIN own USING (dataset_id) LEFT JOIN other USING (dataset_id))
        SELECT dataset_id, n, round(mean_distance, 6) + 0.0 AS mean_distance, round(h, 6) + 0.0 AS hopkins,
          CASE WHEN h IS NULL THEN 'insufficient_data' WHEN h > 0.75 THEN 'high' WHEN h > 0.5 THEN 'moderate' ELSE 'low' END AS tendency
        FROM h""",
)
def _(spark, sf):
    return rounded(S.hopkins(wide(spark, sf), THREE))


@query(
    "H14_scatter_corr",
    "daily",
    "WITH h AS (" + _pair_sql("daily", "corr({a}, {b}) AS r, count(*) AS n") + ") SELECT dataset_id, variable_b AS variable_a, variable_a AS variable_b, round(r, 6) + 0.0 AS r, n FROM h",
)
def _(spark, sf):
    return rounded(S.scatter_corr(wide(spark, sf), VARS))
