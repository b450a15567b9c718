"""Queries for column functions and variable-wide transforms."""

import math

from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.functions import calendar, geo, levels, scaling
from airgrid.plans import views as V
from airgrid.plans.registry import query, r, rounded
from airgrid.plans.slicing_queries import CELL, NUMERIC_POINTS, _cell, _numeric_points

RANGE = """span AS (SELECT dataset_id, variable, min(value) AS lo, max(value) AS hi FROM grid GROUP BY 1, 2),
    ranged AS (SELECT g.*, lo, hi FROM grid g JOIN span s ON g.dataset_id = s.dataset_id AND g.variable = s.variable)"""


@query(
    "C1_haversine_km",
    "points",
    f"""WITH {NUMERIC_POINTS} SELECT point_id, {r('''km=2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(lat-33.6844)/2), 2)
        + cos(radians(33.6844))*cos(radians(lat))*pow(sin(radians(lon-73.0479)/2), 2))))''')} FROM np""",
)
def _(spark, sf):
    p = _numeric_points(spark, sf)
    km = geo.haversine_km(F.lit(33.6844), F.lit(73.0479), F.col("lat"), F.col("lon"))
    return rounded(p.select("point_id", km.alias("km")))


@query(
    "C2_bbox_around",
    "points",
    f"""WITH {NUMERIC_POINTS} SELECT point_id, {r('south=lat-25/111.32', 'north=lat+25/111.32',
        'west=lon-25/(111.32*cos(radians(lat)))', 'east=lon+25/(111.32*cos(radians(lat)))')} FROM np""",
)
def _(spark, sf):
    p = _numeric_points(spark, sf).withColumn("b", geo.bbox_around(F.col("lat"), F.col("lon"), 25.0))
    return rounded(p.select("point_id", "b.*"))


_UV = "uv AS (SELECT point_id, (point_id % 21) - 10.0 AS u, (point_id % 13) - 6.0 AS v FROM points)"


def _wind(spark, sf):
    k = F.col("point_id")
    return V.points(spark, sf).select("point_id", (k % 21 - 10.0).alias("u"), (k % 13 - 6.0).alias("v"))


@query(
    "C3_wind_vector",
    "points",
    f"""WITH {_UV} SELECT point_id, {r('speed=sqrt(u*u+v*v)', '''direction=CASE WHEN u=0 AND v=0 THEN 0
        WHEN atan2(u,v) < 0 THEN degrees(atan2(u,v))+360 ELSE degrees(atan2(u,v)) END''')} FROM uv""",
)
def _(spark, sf):
    u, v = F.col("u"), F.col("v")
    return rounded(
        _wind(spark, sf).select(
            "point_id", geo.wind_speed(u, v).alias("speed"), geo.wind_direction(u, v).alias("direction")
        )
    )


@query(
    "C4_normalize_lon",
    "points",
    """WITH l AS (SELECT point_id, CAST((point_id % 25) * 60 - 720 AS DOUBLE) AS raw FROM points)
       SELECT point_id, CASE WHEN abs(raw) <= 180 THEN raw
         WHEN raw > 180 THEN raw - 360 * ceil((raw - 180) / 360) ELSE raw + 360 * ceil((-180 - raw) / 360) END AS lon FROM l""",
)
def _(spark, sf):
    raw = ((F.col("point_id") % 25) * 60 - 720).cast("double")
    return V.points(spark, sf).select("point_id", geo.normalize_lon(raw).alias("lon"))


@query(
    "C5_utm_zone",
    "points",
    f"""WITH {NUMERIC_POINTS}, z AS (SELECT point_id, lat, CAST(trunc((lon+180)/6) AS INTEGER)+1 AS zone FROM np)
        SELECT point_id, zone, CASE WHEN point_id % 2 = 0 THEN 32600+zone ELSE 32700+zone END AS epsg FROM z""",
)
def _(spark, sf):
    z = _numeric_points(spark, sf).withColumn("zone", geo.utm_zone(F.col("lon")))
    return z.select("point_id", "zone", geo.utm_epsg(F.col("zone"), F.col("point_id") % 2 == 0).alias("epsg"))


def utm_sql(source: str, keep: str) -> str:
    """CTE ``utm`` with easting and northing of ``source(lat, lon, zone)``, step by step."""
    e = 2 * math.sqrt(geo._N) / (1 + geo._N)
    k = geo.UTM_SCALE * geo._RECTIFYING
    east = " + ".join(f"{a!r}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(geo._ALPHA, start=1))
    north = " + ".join(f"{a!r}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(geo._ALPHA, start=1))
    return f"""u0 AS (SELECT *, sin(radians(lat)) AS s, radians(lon - (zone*6 - 183)) AS dl FROM {source}),
        u1 AS (SELECT *, sinh(atanh(s) - {e!r}*atanh({e!r}*s)) AS t FROM u0),
        u2 AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1 + t*t)) AS eta FROM u1),
        utm AS (SELECT {keep}, 500000e0 + {k!r}*(eta + {east}) AS easting, CASE WHEN lat < 0 THEN 1e7 ELSE 0 END + {k!r}*(xi + {north}) AS northing FROM u2)"""


@query(
    "C6_to_utm",
    "points",
    f"""WITH {NUMERIC_POINTS}, z AS (SELECT *, CAST(trunc((lon+180)/6) AS INTEGER)+1 AS zone FROM np), {utm_sql('z', 'point_id')}
        SELECT point_id, {r('easting', 'northing', places=3)} FROM utm""",
)
def _(spark, sf):
    p = _numeric_points(spark, sf)
    e, n = geo.to_utm(F.col("lat"), F.col("lon"), geo.utm_zone(F.col("lon")))
    return rounded(p.select("point_id", e.alias("easting"), n.alias("northing")), 3)


@query(
    "C7_bbox_area",
    "points",
    f"""WITH {NUMERIC_POINTS} SELECT point_id, {r('''area_km2=6371.0*6371.0*radians(2*25/(111.32*cos(radians(lat))))
        *(sin(radians(lat+25/111.32))-sin(radians(lat-25/111.32)))''')} FROM np""",
)
def _(spark, sf):
    p = _numeric_points(spark, sf).withColumn("b", geo.bbox_around(F.col("lat"), F.col("lon"), 25.0))
    area = geo.bbox_area_km2(F.col("b.south"), F.col("b.north"), F.col("b.west"), F.col("b.east"))
    return rounded(p.select("point_id", area.alias("area_km2")))


TEMPORAL_SQL = {
    "day_of_year": "CAST(dayofyear(time) AS INTEGER)",
    "month": "CAST(month(time) AS INTEGER)",
    "day_of_week": "CAST(isodow(time) - 1 AS INTEGER)",
    "quarter": "CAST(quarter(time) AS INTEGER)",
    "season": "CAST((month(time) % 12) // 3 AS INTEGER)",
    "day_of_year_sin": "round(sin(2*pi()*dayofyear(time)/365), 6) + 0.0",
    "day_of_year_cos": "round(cos(2*pi()*dayofyear(time)/365), 6) + 0.0",
    "month_sin": "round(sin(2*pi()*month(time)/12), 6) + 0.0",
    "month_cos": "round(cos(2*pi()*month(time)/12), 6) + 0.0",
    "is_weekend": "CAST(isodow(time) >= 6 AS INTEGER)",
}


@query(
    "C8_temporal_features",
    "daily",
    "SELECT dataset_id, time, " + ", ".join(f"{e} AS {n}" for n, e in TEMPORAL_SQL.items()) + " FROM daily",
)
def _(spark, sf):
    d = V.daily(spark, sf).select("dataset_id", "time")
    return rounded(d.withColumns(calendar.temporal_columns(F.col("time"))))


@query(
    "C9_season",
    "daily",
    """SELECT dataset_id, time, ['DJF','MAM','JJA','SON'][(month(time) % 12) // 3 + 1] AS label,
       CAST((month(time) % 12) // 3 + 1 AS INTEGER) AS number FROM daily""",
)
def _(spark, sf):
    t = F.col("time")
    return V.daily(spark, sf).select(
        "dataset_id", "time", calendar.season_label(t).alias("label"), calendar.season_number(t).alias("number")
    )


@query(
    "C10_gamma_correct",
    "grid",
    f"""WITH {RANGE} SELECT {CELL}, {r('value=CASE WHEN hi > lo THEN pow((value-lo)/(hi-lo), 1/1.2)*(hi-lo)+lo ELSE value END')}
        FROM ranged""",
)
def _(spark, sf):
    return _cell(scaling.gamma_correct(V.grid(spark, sf)))


@query(
    "C11_value_bucket",
    "grid",
    f"""WITH {RANGE}, s AS (SELECT {CELL}, (value-lo)/(hi-lo) AS v FROM ranged)
        SELECT {CELL}, CASE WHEN v < .2 THEN 'green' WHEN v < .4 THEN 'yellow' WHEN v < .6 THEN 'orange'
        WHEN v < .8 THEN 'red' ELSE 'darkred' END AS colour FROM s""",
)
def _(spark, sf):
    g = scaling.with_range(V.grid(spark, sf))
    v = (F.col("value") - F.col("_min")) / (F.col("_max") - F.col("_min"))
    return g.select("dataset_id", "variable", "time", "y", "x", levels.value_bucket(v).alias("colour"))


@query(
    "C12_normalise_8bit",
    "grid",
    f"""WITH {RANGE}, s AS (SELECT *, CAST(floor((value-lo)/(hi-lo)*255) AS INTEGER) AS value_8bit FROM ranged)
        SELECT {CELL}, value_8bit, {r('scaled_back=value_8bit/255.0*(hi-lo)+lo')} FROM s""",
)
def _(spark, sf):
    g = scaling.normalise_8bit(V.grid(spark, sf))
    return rounded(g.select("dataset_id", "variable", "time", "y", "x", "value_8bit", "scaled_back"))


@query(
    "C13_log1p_if_skewed",
    "daily",
    f"""WITH s AS (SELECT dataset_id, time, no2, so2*so2*so2 AS cubed, so2, pow(o3*20, 6) + 1 AS spiky,
                 CASE WHEN year(time) < 1999 THEN 'train' WHEN year(time) < 2000 THEN 'val' ELSE 'test' END AS split FROM daily),
        t AS (SELECT dataset_id, skewness(no2) > 1 AND min(no2) > 0 AS a, skewness(cubed) > 1 AND min(cubed) > 0 AS b,
              skewness(spiky) > 1 AND min(spiky) > 0 AS c FROM s WHERE split = 'train' GROUP BY 1)
        SELECT s.dataset_id, time, split, {r('no2=CASE WHEN a THEN ln(1+no2) ELSE no2 END',
          'cubed=CASE WHEN b THEN ln(1+cubed) ELSE cubed END', 'spiky=CASE WHEN c THEN ln(1+spiky) ELSE spiky END')}
        FROM s LEFT JOIN t ON s.dataset_id = t.dataset_id""",
)
def _(spark, sf):
    y = F.year("time")
    d = V.daily(spark, sf).select(
        "dataset_id",
        "time",
        "no2",
        (F.col("so2") * F.col("so2") * F.col("so2")).alias("cubed"),
        (F.pow(F.col("o3") * 20, 6) + 1).alias("spiky"),
        F.when(y < 1999, "train").when(y < 2000, "val").otherwise("test").alias("split"),
    )
    return rounded(scaling.log1p_if_skewed(d, ["no2", "cubed", "spiky"], ["dataset_id"]))


@query(
    "C14_cross_features",
    "daily",
    f"SELECT dataset_id, time, {r('no2_x_so2=no2*so2', 'so2_x_co=so2*co', 'co_x_o3=co*o3')} FROM daily",
)
def _(spark, sf):
    d = scaling.cross_features(V.daily(spark, sf), ["no2", "so2", "co", "o3"])
    return rounded(d.select("dataset_id", "time", "no2_x_so2", "so2_x_co", "co_x_o3"))


@query(
    "C15_alert_level",
    "series",
    """SELECT dataset_id, variable, time, CASE variable
         WHEN 'no2' THEN CASE WHEN value >= 60 THEN 'critical' WHEN value >= 40 THEN 'warning' WHEN value >= 20 THEN 'moderate' ELSE 'good' END
         ELSE CASE WHEN value >= 30 THEN 'critical' WHEN value >= 20 THEN 'warning' WHEN value >= 10 THEN 'moderate' ELSE 'good' END
       END AS level FROM series WHERE variable IN ('no2', 'so2')""",
)
def _(spark, sf):
    s = V.series(spark, sf)
    out = s.select(*KEYS, "time", levels.alert_level(F.col("variable"), F.col("value")).alias("level"))
    return out.where(F.col("level").isNotNull())


@query(
    "C16_quality_band",
    "series",
    """SELECT dataset_id, variable, time, CASE variable
         WHEN 'no2' THEN CASE WHEN value < 20 THEN 'good' WHEN value < 40 THEN 'moderate' ELSE 'poor' END
         WHEN 'so2' THEN CASE WHEN value < 10 THEN 'good' WHEN value < 20 THEN 'moderate' ELSE 'poor' END
         WHEN 'co' THEN CASE WHEN value < 0.05 THEN 'good' WHEN value < 0.1 THEN 'moderate' ELSE 'poor' END
         ELSE 'good' END AS band FROM series""",
)
def _(spark, sf):
    s = V.series(spark, sf)
    return s.select(*KEYS, "time", levels.quality_band(F.col("variable"), F.col("value")).alias("band"))


@query(
    "C17_product_resolution",
    "",
    """WITH p AS (SELECT p_partkey, ['MOD04_L2','MYD04_3K','MOD08_D3','MOD13Q1','VNP46A1'][p_size % 5 + 1] AS product,
                  ['no2','SO2','aod','ndvi'][p_size % 4 + 1] AS gas FROM part)
       SELECT p_partkey, CASE WHEN product LIKE 'MOD04%' OR product LIKE 'MYD04%' THEN '10km' WHEN product LIKE 'MOD08%'
         THEN '1degree' WHEN product LIKE 'MOD13%' THEN '250m' ELSE 'unknown' END AS resolution,
         CASE lower(gas) WHEN 'aod' THEN 'dimensionless' WHEN 'ndvi' THEN 'unknown' ELSE 'mol m-2' END AS units FROM p""",
)
def _(spark, sf):
    def pick(names, n):
        return F.get(F.array(*[F.lit(x) for x in names]), F.col("p_size") % n)

    product = pick(["MOD04_L2", "MYD04_3K", "MOD08_D3", "MOD13Q1", "VNP46A1"], 5)
    return V.table(spark, sf, "part").select(
        "p_partkey",
        levels.product_resolution(product).alias("resolution"),
        levels.product_units(pick(["no2", "SO2", "aod", "ndvi"], 4)).alias("units"),
    )


@query(
    "C18_assess_range",
    "series",
    """WITH s AS (SELECT dataset_id, variable, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM series GROUP BY 1, 2)
       SELECT dataset_id, variable, CASE WHEN (variable = 'no2' AND lo >= 0 AND hi <= 100) OR (variable = 'so2' AND lo >= 0
         AND hi <= 50) OR (variable = 'co' AND lo >= 0 AND hi <= 0.1) THEN 'reasonable' WHEN lo = hi THEN 'constant'
         WHEN hi - lo > 10*m THEN 'wide_range' ELSE 'unknown' END AS assessment FROM s""",
)
def _(spark, sf):
    s = V.series(spark, sf).groupBy(*KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m"))
    return s.select(*KEYS, levels.assess_range(F.col("variable"), F.col("lo"), F.col("hi"), F.col("m")).alias("assessment"))
