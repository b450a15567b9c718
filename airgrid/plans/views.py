"""Fixture views: the driver tables seen as cubes, series, scenes and points.

Each view is defined once for Spark and once as SQL for the comparison.  All of them grow with their
source table: the number of datasets grows with the suppliers (or users), rows with the facts.
Prices are summed as whole cents, so that both engines start from identical doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NY, NX = 10, 20
SOUTH, NORTH, WEST, EAST = 32.5, 35.5, 71.5, 74.5
# unit divisors; deliberately not round, so that no value lies on a rounding tie
PRICE_UNIT, QTY_UNIT, CENT_UNIT = 99991.0, 1.0007, 100.07
BBOX = {"south": SOUTH, "north": NORTH, "west": WEST, "east": EAST}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dataset(key: str, size: int, letter: str):
    return F.concat(F.lit(letter), F.expr(f"{key} div {size}").cast("string"))


def _unpivot(df: DataFrame, ids: list[str], variables: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in variables])
    return df.select(*ids, F.explode(rows).alias("_row")).select(*ids, "_row.*")


def _cents(column: str):
    return F.sum(F.round(F.col(column) * 100).cast("long")).cast("double")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly cube of two variables with a quality column and missing cells."""
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            _dataset("l_suppkey", 50, "d").alias("dataset_id"),
            F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"),
            (F.col("l_suppkey") % NY).cast("int").alias("y"),
            (F.col("l_partkey") % NX).cast("int").alias("x"),
        )
        .agg(
            (_cents("l_extendedprice") / F.count(F.lit(1)) / PRICE_UNIT).alias("no2"),
            (F.sum("l_quantity") / F.count(F.lit(1)) / QTY_UNIT).alias("so2"),
            (F.min("l_linenumber") - 1).cast("int").alias("qa"),
        )
        .withColumn("lat", SOUTH + F.col("y") * (NORTH - SOUTH) / (NY - 1))
        .withColumn("lon", WEST + F.col("x") * (EAST - WEST) / (NX - 1))
    )
    return _unpivot(cells, ["dataset_id", "time", "y", "x", "lat", "lon", "qa"], ["no2", "so2"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide daily series: one column per variable."""
    n = F.count(F.lit(1))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            _dataset("l_suppkey", 50, "d").alias("dataset_id"),
            F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("time"),
        )
        .agg(
            (_cents("l_extendedprice") / n / PRICE_UNIT).alias("no2"),
            (F.sum("l_quantity") / n / QTY_UNIT).alias("so2"),
            (_cents("l_discount") / n / CENT_UNIT).alias("co"),
            (_cents("l_tax") / n / CENT_UNIT).alias("o3"),
            n.alias("n"),
        )
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily series."""
    return _unpivot(
        daily(spark, sf_dir).drop("n"), ["dataset_id", "time"], ["no2", "so2", "co", "o3"]
    )


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily series in which thinly observed days carry no value."""
    wide = daily(spark, sf_dir)
    rich = F.col("n") >= 5
    wide = wide.select(
        "dataset_id", "time", F.when(rich, F.col("no2")).alias("no2"), F.when(rich, F.col("so2")).alias("so2")
    )
    return _unpivot(wide, ["dataset_id", "time"], ["no2", "so2"])


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean and count per event type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            _dataset("user_id", 100, "u").alias("dataset_id"),
            F.col("event_type").alias("variable"),
            F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"),
        )
        .agg(
            (_cents("value") / F.count("value") / CENT_UNIT).alias("value"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scene_id"),
        F.col("o_orderdate").alias("time_start"),
        (F.col("o_custkey") % 100).cast("double").alias("cloud_cover"),
        (F.col("o_orderkey") % 64).cast("int").alias("qa_pixel"),
        _dataset("o_custkey", 5000, "r").alias("region"),
        (F.round(F.col("o_totalprice") * 100).cast("long") / PRICE_UNIT).alias("sr_b1"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point records as they arrive: coordinates and dates are text, some of them broken."""
    k = F.col("c_custkey")
    lat = F.format_number(32.5 + (k % 300) / 100.0, 2)
    return table(spark, sf_dir, "customer").select(
        k.alias("point_id"),
        F.when(k % 97 == 0, F.lit("n/a")).otherwise(lat).alias("latitude"),
        F.format_number(71.5 + (k % 310) / 100.0, 2).alias("longitude"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (k % 365).cast("int")), "yyyy-MM-dd").alias(
            "acq_date"
        ),
        F.concat(
            F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00")
        ).alias("acq_time"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source"),
        F.col("c_acctbal").alias("value"),
    )


# ------------------------------------------------------------------ the same views as SQL

_CENTS = "CAST(sum(CAST(round({0}*100) AS BIGINT)) AS DOUBLE)"
_PRICE = _CENTS.format("l_extendedprice") + f"/count(*)/CAST({PRICE_UNIT} AS DOUBLE)"

SQL_VIEWS = {
    "grid": f"""cells AS (
      SELECT 'd' || CAST(l_suppkey // 50 AS VARCHAR) AS dataset_id, date_trunc('month', l_shipdate) AS time,
             CAST(l_suppkey % {NY} AS INTEGER) AS y, CAST(l_partkey % {NX} AS INTEGER) AS x,
             {_PRICE} AS no2, sum(l_quantity)/count(*)/CAST({QTY_UNIT} AS DOUBLE) AS so2, CAST(min(l_linenumber) - 1 AS INTEGER) AS qa
      FROM lineitem GROUP BY 1, 2, 3, 4),
    grid AS MATERIALIZED (
      SELECT dataset_id, v.variable, CAST(time AS TIMESTAMP) AS time, y, x,
             {SOUTH} + y * CAST({NORTH - SOUTH} AS DOUBLE) / {NY - 1} AS lat,
             {WEST} + x * CAST({EAST - WEST} AS DOUBLE) / {NX - 1} AS lon, qa,
             CASE v.variable WHEN 'no2' THEN no2 ELSE so2 END AS value
      FROM cells, (VALUES ('no2'), ('so2')) v(variable))""",
    "daily": f"""daily AS MATERIALIZED (
      SELECT 'd' || CAST(l_suppkey // 50 AS VARCHAR) AS dataset_id,
             CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS time,
             {_PRICE} AS no2, sum(l_quantity)/count(*)/CAST({QTY_UNIT} AS DOUBLE) AS so2,
             {_CENTS.format('l_discount')}/count(*)/CAST({CENT_UNIT} AS DOUBLE) AS co, {_CENTS.format('l_tax')}/count(*)/CAST({CENT_UNIT} AS DOUBLE) AS o3,
             count(*) AS n
      FROM lineitem GROUP BY 1, 2)""",
    "series": """series AS MATERIALIZED (
      SELECT dataset_id, v.variable, time,
             CASE v.variable WHEN 'no2' THEN no2 WHEN 'so2' THEN so2 WHEN 'co' THEN co ELSE o3 END AS value
      FROM daily, (VALUES ('no2'), ('so2'), ('co'), ('o3')) v(variable))""",
    "gappy": """gappy AS MATERIALIZED (
      SELECT dataset_id, v.variable, time,
             CASE WHEN n >= 5 THEN CASE v.variable WHEN 'no2' THEN no2 ELSE so2 END END AS value
      FROM daily, (VALUES ('no2'), ('so2')) v(variable))""",
    "event_series": f"""event_series AS MATERIALIZED (
      SELECT 'u' || CAST(user_id // 100 AS VARCHAR) AS dataset_id, event_type AS variable,
             CAST(date_trunc('day', ts) AS TIMESTAMP) AS time,
             {_CENTS.format('value')}/count(value)/CAST({CENT_UNIT} AS DOUBLE) AS value, count(*) AS n
      FROM events GROUP BY 1, 2, 3)""",
    "scenes": f"""scenes AS MATERIALIZED (
      SELECT o_orderkey AS scene_id, o_orderdate AS time_start, CAST(o_custkey % 100 AS DOUBLE) AS cloud_cover,
             CAST(o_orderkey % 64 AS INTEGER) AS qa_pixel, 'r' || CAST(o_custkey // 5000 AS VARCHAR) AS region,
             CAST(round(o_totalprice*100) AS BIGINT)/CAST({PRICE_UNIT} AS DOUBLE) AS sr_b1 FROM orders)""",
    "points": """points AS MATERIALIZED (
      SELECT c_custkey AS point_id,
             CASE WHEN c_custkey % 97 = 0 THEN 'n/a' ELSE printf('%.2f', 32.5 + (c_custkey % 300)/100.0) END AS latitude,
             printf('%.2f', 71.5 + (c_custkey % 310)/100.0) AS longitude,
             strftime(DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') AS acq_date,
             printf('%02d:%02d:00', c_custkey % 24, c_custkey % 60) AS acq_time,
             'n' || CAST(c_nationkey AS VARCHAR) AS source, c_acctbal AS value FROM customer)""",
}
_NEEDS = {"series": ["daily"], "gappy": ["daily"]}


def with_views(views: str, body: str) -> str:
    """Prefix ``body`` with the CTEs of the named views; ``body`` may start with ``WITH``."""
    names: list[str] = []
    for v in views.split():
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    head = ", ".join(SQL_VIEWS[n] for n in names)
    body = body.strip()
    if not names:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
