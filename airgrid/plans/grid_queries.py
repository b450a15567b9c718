"""Queries for grid neighbourhood operators."""


from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.operators import neighbourhood as N
from airgrid.plans import views as V
from airgrid.plans.aggregate_queries import K
from airgrid.plans.registry import query, r, rounded

SHAPE = (V.NY, V.NX)
CELL = "dataset_id, variable, time, y, x"


def _cells(df, *more, places=6):
    return rounded(df.select(*KEYS, "time", "y", "x", "value", *more), places)


def yearly(spark, sf):
    """Mean image per year: every cell is present."""
    return V.grid(spark, sf).groupBy(*KEYS, F.date_trunc("year", "time").cast("timestamp_ntz").alias("time"), "y", "x").agg(
        (F.round(F.avg("value"), 9) / 1.0003).alias("value")
    )


YEARLY = f"""yearly AS MATERIALIZED (SELECT {K}, CAST(date_trunc('year', time) AS TIMESTAMP) AS time, y, x, round(avg(value), 9)/CAST(1.0003 AS DOUBLE) AS value
    FROM grid GROUP BY 1, 2, 3, 4, 5)"""


def _axis(p: str, n: int, border: str | None) -> str:
    if border is None:
        return p
    lo, hi = (f"-1-({p})", f"{2 * n - 1}-({p})") if border == "symmetric" else (f"-({p})", f"{2 * n - 2}-({p})")
    return f"CASE WHEN {p} < 0 THEN {lo} WHEN {p} >= {n} THEN {hi} ELSE {p} END"


def window_sql(view: str, radius: int, border: str | None, name: str = "win", value: str = "value", only: str = "true") -> str:
    """Each existing cell with every cell of its window (null where missing)."""
    return f"""{name} AS (SELECT g.dataset_id, g.variable, g.time, g.y, g.x, g.{value} AS value, a.d AS dy, b.d AS dx, s.{value} AS v
      FROM {view} g CROSS JOIN range({-radius}, {radius + 1}) a(d) CROSS JOIN range({-radius}, {radius + 1}) b(d)
      LEFT JOIN {view} s ON s.dataset_id = g.dataset_id AND s.variable = g.variable AND s.time = g.time
        AND s.y = {_axis('(g.y + a.d)', V.NY, border)} AND s.x = {_axis('(g.x + b.d)', V.NX, border)} WHERE {only})"""


def kernel_sql(kernel) -> str:
    rad = len(kernel) // 2
    cases = " ".join(f"WHEN {(i + 0) * len(kernel) + j} THEN {w!r}" for i, row in enumerate(kernel) for j, w in enumerate(row))
    return f"(CASE (dy + {rad})*{len(kernel)} + dx + {rad} {cases} END)"


G3 = N.outer(N.gaussian_taps(0.5, 2), N.gaussian_taps(0.5, 2))
B5 = N.outer(N.BINOMIAL5, N.BINOMIAL5)


@query(
    "F6_neighbour_join",
    "grid",
    f"""SELECT g.dataset_id, g.variable, g.time, g.y, g.x, CAST(a.d AS INTEGER) AS dy, CAST(b.d AS INTEGER) AS dx, {r('value=g.value', 'neighbour=s.value')}
        FROM grid g, range(-1, 2) a(d), range(-1, 2) b(d), grid s WHERE (a.d <> 0 OR b.d <> 0) AND s.dataset_id = g.dataset_id
        AND s.variable = g.variable AND s.time = g.time AND s.y = g.y + a.d AND s.x = g.x + b.d""",
)
def _(spark, sf):
    return rounded(N.neighbour_join(V.grid(spark, sf), N.RING))


@query(
    "G1_dos_correct",
    "grid",
    f"""WITH d AS (SELECT {K}, time, quantile_cont(value, .01) AS dark FROM grid GROUP BY 1, 2, 3)
        SELECT g.dataset_id, g.variable, g.time, y, x, {r('value=greatest(value-dark, 0)')}
        FROM grid g JOIN d ON g.dataset_id = d.dataset_id AND g.variable = d.variable AND g.time = d.time""",
)
def _(spark, sf):
    return _cells(N.dos_correct(V.grid(spark, sf)))


def haze_sql(view: str) -> str:
    """CTE ``clear``: the blur as two sums over mirrored weights, first along y, then along x, over existing cells."""

    def weights(axis: str, n: int) -> str:
        turn = 2 * (n - 1)
        at = f"((({axis} + d) % {turn}) + {turn}) % {turn}"
        return f"""w{axis} AS (SELECT {axis}, src, sum(k) AS w FROM (SELECT {axis}, k, least({at}, {turn} - {at}) AS src
          FROM range({n}) t({axis}), taps) GROUP BY 1, 2)"""

    return f"""taps AS (SELECT d, exp(-0.5*pow(d/CAST({N.SIGMA51!r} AS DOUBLE), 2)) AS k FROM range(-25, 26) t(d)),
      {weights('y', V.NY)}, {weights('x', V.NX)},
      tall AS (SELECT {K}, time, wy.y, x, sum(w*value) AS total, sum(CASE WHEN value IS NOT NULL THEN w END) AS weight
        FROM {view} v JOIN wy ON v.y = wy.src GROUP BY ALL),
      blurred AS (SELECT {K}, time, y, wx.x, sum(w*total)/sum(w*weight) AS back FROM tall JOIN wx ON tall.x = wx.src GROUP BY ALL),
      clear AS (SELECT v.dataset_id, v.variable, v.time, v.y, v.x, CASE WHEN value IS NOT NULL THEN greatest(value - 0.5*back, 0) END AS value
        FROM {view} v JOIN blurred b ON v.dataset_id = b.dataset_id AND v.variable = b.variable AND v.time = b.time AND v.y = b.y AND v.x = b.x)"""


@query("G2_haze_remove", "grid", f"WITH {haze_sql('grid')} SELECT {CELL}, {r('value')} FROM clear")
def _(spark, sf):
    return _cells(N.haze_remove(V.grid(spark, sf), SHAPE))


@query(
    "G3_combined_correct",
    "grid",
    f"""WITH d AS (SELECT {K}, time, quantile_cont(value, .01) AS dark FROM grid GROUP BY 1, 2, 3),
        dark AS MATERIALIZED (SELECT g.dataset_id, g.variable, g.time, y, x, greatest(value-dark, 0) AS value
          FROM grid g JOIN d ON g.dataset_id = d.dataset_id AND g.variable = d.variable AND g.time = d.time), {haze_sql('dark')}
        SELECT {CELL}, {r('value')} FROM clear""",
)
def _(spark, sf):
    return _cells(N.combined_correct(V.grid(spark, sf), SHAPE))


@query(
    "G4_gaussian",
    "grid",
    f"""WITH {window_sql('grid', 2, 'symmetric')} SELECT {CELL}, {r(f'value=sum({kernel_sql(G3)}*v)/sum(CASE WHEN v IS NOT NULL THEN {kernel_sql(G3)} END)')}
        FROM win GROUP BY {CELL}""",
)
def _(spark, sf):
    return _cells(N.gaussian(V.grid(spark, sf), SHAPE, nulls="skip"))


@query(
    "G4_gaussian_dense",
    "grid",
    f"""WITH {YEARLY}, {window_sql('yearly', 2, 'symmetric')} SELECT {CELL}, {r(f'value=CASE WHEN count(v) = 25 THEN sum({kernel_sql(G3)}*v) END')}
        FROM win GROUP BY {CELL}""",
)
def _(spark, sf):
    return _cells(N.gaussian(yearly(spark, sf), SHAPE))


@query(
    "G5_median3",
    "grid",
    f"""WITH {window_sql('grid', 1, 'symmetric')} SELECT {CELL}, {r('value=CASE WHEN count(v) = 9 THEN quantile_cont(v, .5) END')}
        FROM win GROUP BY {CELL}""",
)
def _(spark, sf):
    return _cells(N.median3(V.grid(spark, sf), SHAPE))


_BILATERAL = f"""span AS (SELECT {K}, min(value) AS lo, max(value) AS hi FROM yearly GROUP BY 1, 2),
    q AS (SELECT y.*, lo, hi, floor((value-lo)/(hi-lo)*255) AS v8 FROM yearly y JOIN span s ON y.dataset_id = s.dataset_id AND y.variable = s.variable)"""


@query(
    "G6_bilateral",
    "grid",
    f"""WITH {YEARLY}, {_BILATERAL}, {window_sql('q', 4, 'mirror', value='v8', only='a.d*a.d + b.d*b.d <= 16')},
        k AS (SELECT *, exp(-0.5*(dy*dy+dx*dx)/5625.0)*exp(-0.5*pow(v-value, 2)/5625.0) AS w FROM win),
        b AS (SELECT {CELL}, round_even(sum(w*v)/sum(w), 0) AS out8 FROM k GROUP BY {CELL})
        SELECT b.dataset_id, b.variable, b.time, b.y, b.x, {r('value=out8/255*(hi-lo)+lo')} FROM b
        JOIN span s ON b.dataset_id = s.dataset_id AND b.variable = s.variable""",
)
def _(spark, sf):
    return _cells(N.bilateral(yearly(spark, sf), SHAPE))


@query("G6_bilateral_monthly")
def _(spark, sf):
    return _cells(N.bilateral(V.grid(spark, sf), SHAPE))


@query(
    "G7_unsharp",
    "grid",
    f"""WITH {YEARLY}, {window_sql('yearly', 2, 'mirror')} SELECT {CELL}, {r(f'value=1.5*value-0.5*CASE WHEN count(v) = 25 THEN sum({kernel_sql(B5)}*v) END')}
        FROM win GROUP BY {CELL}, value""",
)
def _(spark, sf):
    return _cells(N.unsharp(yearly(spark, sf), SHAPE))


def _stack_sql() -> str:
    parts = ["g0 AS MATERIALIZED (SELECT dataset_id, variable, time, y, x, value FROM yearly)"]
    for i in range(3):
        parts.append(window_sql(f"g{i}", 2, "mirror", f"w{i}"))
        parts.append(f"g{i + 1} AS MATERIALIZED (SELECT {CELL}, CASE WHEN count(v) = 25 THEN sum({kernel_sql(B5)}*v) END AS value FROM w{i} GROUP BY {CELL})")
    return ", ".join(parts)


@query(
    "G8_multiscale",
    "grid",
    f"""WITH {YEARLY}, {_stack_sql()} SELECT a.dataset_id, a.variable, a.time, a.y, a.x,
        {r('value=d.value + (a.value-b.value) + (b.value-c.value)*(1+0.2*(1.0/3)) + (c.value-d.value)*(1+0.2*(2.0/3))')}
        FROM g0 a JOIN g1 b USING (dataset_id, variable, time, y, x) JOIN g2 c USING (dataset_id, variable, time, y, x)
        JOIN g3 d USING (dataset_id, variable, time, y, x)""",
)
def _(spark, sf):
    return _cells(N.multiscale(yearly(spark, sf), SHAPE))


def gradient_sql(view: str) -> str:
    def at(dy, dx):
        return f"max(CASE WHEN dy = {dy} AND dx = {dx} THEN v END)"

    return f"""{window_sql(view, 1, None)}, n AS (SELECT {CELL}, max(value) AS v, {at(-1, 0)} AS up, {at(1, 0)} AS dn, {at(0, -1)} AS lf, {at(0, 1)} AS rt
        FROM win GROUP BY {CELL}),
      grad AS (SELECT {CELL}, v AS value, CASE WHEN y = 0 THEN dn-v WHEN y = {V.NY - 1} THEN v-up ELSE (dn-up)/2 END AS grad_y,
        CASE WHEN x = 0 THEN rt-v WHEN x = {V.NX - 1} THEN v-lf ELSE (rt-lf)/2 END AS grad_x FROM n)"""


@query(
    "G9_gradient",
    "grid",
    f"WITH {gradient_sql('grid')} SELECT {CELL}, {r('value', 'grad_y', 'grad_x', 'gradient=sqrt(grad_y*grad_y+grad_x*grad_x)')} FROM grad",
)
def _(spark, sf):
    return _cells(N.gradient(V.grid(spark, sf), SHAPE), "grad_y", "grad_x", "gradient")


@query(
    "G9_gradient_stats",
    "grid",
    f"""WITH {gradient_sql('grid')}, m AS (SELECT *, sqrt(grad_y*grad_y+grad_x*grad_x) AS g FROM grad)
        SELECT {K}, time, {r('mean_gradient=avg(g)', 'max_gradient=max(g)', 'gradient_variability=stddev_pop(g)')} FROM m GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(N.gradient_stats(V.grid(spark, sf), SHAPE))


def sobel_sql(view: str, suffix: str = "") -> str:
    h, v = kernel_sql(N.SOBEL_H), kernel_sql(N.SOBEL_V)
    return f"""{window_sql(view, 1, 'symmetric', f'win{suffix}')}, sobel{suffix} AS (SELECT {CELL}, CASE WHEN count(v) = 9 THEN sum({h}*v) END AS h,
      CASE WHEN count(v) = 9 THEN sum({v}*v) END AS w FROM win{suffix} GROUP BY {CELL})"""


@query(
    "G9_sobel",
    "grid",
    f"WITH {YEARLY}, {sobel_sql('yearly')} SELECT {CELL}, {r('sobel_h=h', 'sobel_v=w', 'edge=sqrt(h*h+w*w)')} FROM sobel",
)
def _(spark, sf):
    out = N.sobel(yearly(spark, sf), SHAPE)
    return rounded(out.select(*KEYS, "time", "y", "x", "sobel_h", "sobel_v", "edge"))


@query(
    "G10_local_variance",
    "grid",
    f"""WITH {window_sql('grid', 1, None)}, l AS (SELECT {CELL}, max(value) AS value, CASE WHEN count(v) = 9 THEN var_pop(v) END AS lv FROM win GROUP BY {CELL})
        SELECT {K}, time, {r('local_variance_mean=avg(lv)', 'local_variance_std=stddev_pop(lv)', 'data_variance=var_pop(value)')} FROM l GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(N.texture_stats(V.grid(spark, sf), SHAPE))


@query(
    "G11_morans_i",
    "grid",
    f"""WITH {window_sql('grid', 1, None, only='(a.d <> 0 OR b.d <> 0)')},
        c AS (SELECT {CELL}, max(value) AS value, avg(v) AS lag, CASE WHEN y BETWEEN 1 AND {V.NY - 2} AND x BETWEEN 1 AND {V.NX - 2} THEN count(v) ELSE 0 END AS w
          FROM win GROUP BY {CELL}),
        m AS (SELECT *, avg(value) OVER (PARTITION BY {K}, time) AS mu, count(*) OVER (PARTITION BY {K}, time) AS n FROM c)
        SELECT {K}, time, max(n) AS n, {r('morans_i=CASE WHEN max(n) < 10 THEN 0 ELSE sum(w*(value-mu)*(coalesce(lag,0)-mu))/sum(w*(value-mu)*(value-mu)) END')}
        FROM m GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(N.morans_i(V.grid(spark, sf), SHAPE))


@query(
    "G12_hist_equalize",
    "grid",
    f"""WITH span AS (SELECT {K}, time, min(value) AS lo, (max(value)-min(value))/256 AS w, max(value) AS hi FROM grid GROUP BY 1, 2, 3),
        b AS (SELECT g.dataset_id, g.variable, g.time, y, x, value, lo, w, least(CAST(floor((value-lo)/(hi-lo)*256) AS INTEGER), 255) AS bin
          FROM grid g JOIN span s ON g.dataset_id = s.dataset_id AND g.variable = s.variable AND g.time = s.time),
        f AS (SELECT s.dataset_id, s.variable, s.time, k.bin, sum(count(b.bin)) OVER (PARTITION BY s.dataset_id, s.variable, s.time ORDER BY k.bin) AS cum
          FROM span s CROSS JOIN range(256) k(bin) LEFT JOIN b ON b.dataset_id = s.dataset_id AND b.variable = s.variable AND b.time = s.time AND b.bin = k.bin
          GROUP BY 1, 2, 3, 4),
        c AS (SELECT *, (cum - min(cum) OVER p)/(max(cum) OVER p - min(cum) OVER p) AS c FROM f WINDOW p AS (PARTITION BY {K}, time)),
        e AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY {K}, time ORDER BY bin), c) AS nxt FROM c)
        SELECT b.dataset_id, b.variable, b.time, y, x, {r('value=c + (nxt-c)*(value-(lo+b.bin*w))/w')} FROM b JOIN e
        ON b.dataset_id = e.dataset_id AND b.variable = e.variable AND b.time = e.time AND b.bin = e.bin""",
)
def _(spark, sf):
    return _cells(N.hist_equalize(V.grid(spark, sf)))


@query(
    "G13_contrast_stretch",
    "grid",
    f"""WITH p AS (SELECT {K}, time, quantile_cont(value, .02) AS a, quantile_cont(value, .98) AS b FROM grid GROUP BY 1, 2, 3)
        SELECT g.dataset_id, g.variable, g.time, y, x, {r('value=CASE WHEN b > a THEN least(greatest((value-a)/(b-a), 0), 1) ELSE value END')}
        FROM grid g JOIN p ON g.dataset_id = p.dataset_id AND g.variable = p.variable AND g.time = p.time""",
)
def _(spark, sf):
    return _cells(N.contrast_stretch(V.grid(spark, sf)))


@query("G14_clahe")
def _(spark, sf):
    return _cells(N.clahe(V.grid(spark, sf), SHAPE))


@query("G14_adaptive_equalize")
def _(spark, sf):
    return _cells(N.adaptive_equalize(V.grid(spark, sf), SHAPE))


_IMAGE = f"image AS MATERIALIZED (SELECT {K}, TIMESTAMP '2000-01-01' AS time, y, x, avg(value) AS value FROM grid GROUP BY {K}, y, x)"


@query(
    "G15_spatial_consistency",
    "grid",
    f"""WITH {_IMAGE}, {gradient_sql('image')}, t AS (SELECT {K}, max(greatest(abs(grad_y), abs(grad_x))) AS g FROM grad GROUP BY 1, 2),
        s AS (SELECT {K}, stddev_pop(value) AS sd FROM grid GROUP BY 1, 2)
        SELECT t.dataset_id, t.variable, {r('max_gradient=g', 'std=sd')}, g > 10*sd AS inconsistent
        FROM t JOIN s ON t.dataset_id = s.dataset_id AND t.variable = s.variable""",
)
def _(spark, sf):
    return rounded(N.spatial_consistency(V.grid(spark, sf), SHAPE))


@query("G16_pca_denoise")
def _(spark, sf):
    return _cells(N.pca_denoise(V.grid(spark, sf)), places=5)


@query(
    "G17_heat_points",
    "grid",
    f"SELECT {K}, y, x, {r('lat', 'lon', 'intensity=value')} FROM grid g WHERE value > 0 AND time = (SELECT max(time) FROM grid h WHERE h.dataset_id = g.dataset_id AND h.variable = g.variable)",
)
def _(spark, sf):
    from airgrid.operators.slicing import latest_slice

    return rounded(N.heat_points(latest_slice(V.grid(spark, sf)), rows=V.NY))


@query(
    "G17_markers",
    "grid",
    f"""SELECT {K}, y, x, {r('lat', 'lon', 'value=value/100')}, CASE WHEN value/100 < .2 THEN 'green' WHEN value/100 < .4 THEN 'yellow' WHEN value/100 < .6
        THEN 'orange' WHEN value/100 < .8 THEN 'red' ELSE 'darkred' END AS colour FROM grid g
        WHERE y % 2 = 0 AND x % 2 = 0 AND time = (SELECT max(time) FROM grid h WHERE h.dataset_id = g.dataset_id AND h.variable = g.variable)""",
)
def _(spark, sf):
    from airgrid.operators.slicing import latest_slice

    cells = latest_slice(V.grid(spark, sf)).withColumn("value", F.col("value") / 100)
    return rounded(N.markers(cells, rows=2 * V.NX // 2))


def _edge(view: str, tag: str) -> str:
    return f"{sobel_sql(view, tag)}, edge{tag} AS (SELECT {K}, avg(sqrt(h*h+w*w)) AS e FROM sobel{tag} GROUP BY 1, 2)"


def smoothed(spark, sf):
    v = F.col("value")
    return yearly(spark, sf).withColumn("value", F.greatest(v * 0.9, F.lit(22.0)))


SMOOTHED = "smoothed AS MATERIALIZED (SELECT dataset_id, variable, time, y, x, greatest(value*0.9, 22) AS value FROM yearly)"


@query(
    "D21_noise_metrics",
    "grid",
    f"""WITH {YEARLY}, {SMOOTHED}, {sobel_sql('yearly', 'a')}, {sobel_sql('smoothed', 'b')},
        p AS (SELECT a.dataset_id, a.variable, corr(a.h+a.w, b.h+b.w) AS e FROM sobela a JOIN sobelb b USING (dataset_id, variable, time, y, x) GROUP BY 1, 2),
        m AS (SELECT {K}, avg(value) AS m, stddev_pop(value) AS s, var_pop(value) AS v FROM yearly GROUP BY 1, 2),
        n AS (SELECT {K}, avg(value) AS m, stddev_pop(value) AS s, var_pop(value) AS v FROM smoothed GROUP BY 1, 2)
        SELECT m.dataset_id, m.variable, {r('snr_original=m.m/m.s', 'snr_reduced=n.m/n.s', 'snr_improvement=n.m/n.s-m.m/m.s', 'noise_variance_original=m.v',
          'noise_variance_reduced=n.v', 'noise_reduction_ratio=n.v/m.v', 'edge_preservation=e')}
        FROM m JOIN n USING (dataset_id, variable) JOIN p USING (dataset_id, variable)""",
)
def _(spark, sf):
    return rounded(N.noise_metrics(yearly(spark, sf), smoothed(spark, sf), SHAPE))


def _entropy(view: str, tag: str) -> str:
    return f"""span{tag} AS (SELECT {K}, min(value) AS lo, max(value) AS hi, count(*) AS n, stddev_pop(value) AS s FROM {view} GROUP BY 1, 2),
      bin{tag} AS (SELECT g.dataset_id, g.variable, least(floor((value-lo)/(hi-lo)*256), 255) AS bin, count(*)/(max(n)*max(hi-lo)/256) AS h FROM {view} g
        JOIN span{tag} s ON g.dataset_id = s.dataset_id AND g.variable = s.variable GROUP BY 1, 2, 3),
      ent{tag} AS (SELECT {K}, -sum(h*log2(h)) AS ent FROM bin{tag} GROUP BY 1, 2)"""


def _contrast_select() -> str:
    pairs = {"contrast": "s", "dynamic_range": "hi-{0}.lo", "entropy": "ent", "edge_content": "e"}
    tables = {"contrast": "span", "dynamic_range": "span", "entropy": "ent", "edge_content": "edge"}
    out = []
    for name, col in pairs.items():
        a, b = (f"{tables[name]}{t}.{col.format(tables[name] + t)}" for t in "ab")
        out += [f"{name}_original={a}", f"{name}_enhanced={b}", f"{name}_improvement=({b})-({a})"]
    return r(*out)


@query(
    "D22_contrast_metrics",
    "grid",
    f"""WITH {YEARLY}, {SMOOTHED}, {_edge('yearly', 'a')}, {_edge('smoothed', 'b')}, {_entropy('yearly', 'a')}, {_entropy('smoothed', 'b')}
        SELECT dataset_id, variable, {_contrast_select()} FROM spana JOIN spanb USING (dataset_id, variable) JOIN enta USING (dataset_id, variable)
        JOIN entb USING (dataset_id, variable) JOIN edgea USING (dataset_id, variable) JOIN edgeb USING (dataset_id, variable)""",
)
def _(spark, sf):
    return rounded(N.contrast_metrics(yearly(spark, sf), smoothed(spark, sf), SHAPE))



