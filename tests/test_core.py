"""Building blocks against pandas, with settings small enough to force every branch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airgrid import core
from airgrid.operators.ordering import concordance, digit_balance


@pytest.fixture(scope="module")
def hot(spark):
    """Key ``a`` holds two thirds of the rows and one value a third of each key."""
    rng = np.random.default_rng(0)
    n = 4000
    pdf = pd.DataFrame(
        {
            "k": rng.choice(list("aab"), n),
            "v": np.where(rng.random(n) < 0.33, 0.0, np.round(rng.normal(size=n), 2)),
            "u": np.where(rng.random(n) < 0.35, 1.0, np.round(rng.normal(size=n), 1)),
            "time": pd.date_range("2020-01-01", periods=n, freq="h"),
        }
    )
    df = spark.createDataFrame(pdf).repartition(8).cache()
    return pdf, df


@pytest.mark.parametrize("bucket", [1, 8_192])
def test_exact_quantiles(hot, bucket):
    pdf, df = hot
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p98": 0.98, "p100": 1.0}
    got = core.exact_quantiles(df, ["k"], "v", probs, bucket).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k").v.quantile(list(probs.values())).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


def test_exact_quantiles_ignores_nulls_and_drops_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0), ("b", None)], "k string, v double")
    got = core.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()
    assert [tuple(r) for r in got] == [("a", 1.5)]


@pytest.mark.parametrize("bucket", [20, 8_192])
def test_average_rank(hot, bucket):
    pdf, df = hot
    got = core.average_rank(df, ["k"], "v", "r", bucket=bucket).toPandas()
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got.r, got.groupby("k").v.rank())


@pytest.mark.parametrize("bucket", [20, 8_192])
def test_value_position(hot, bucket):
    pdf, df = hot
    got = core.value_position(df, ["k"], "v", ["time"], bucket=bucket).toPandas()
    assert len(got) == len(pdf)
    for _, g in got.groupby("k"):
        g = g.sort_values("_pos")
        assert list(g._pos) == list(range(len(g)))
        assert g.v.is_monotonic_increasing
        assert (g._n == len(g)).all()


@pytest.mark.parametrize("bucket", [20, 8_192])
def test_concordance(hot, bucket):
    pdf, df = hot
    got = concordance(df, ["k"], "u", "v", bucket=bucket).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        a, b = g.u.to_numpy(), g.v.to_numpy()
        want = int((np.sign(a[:, None] - a) * np.sign(b[:, None] - b)).sum() // 2)
        assert got.loc[k, "s"] == want
        assert got.loc[k, "n"] == len(g)


@pytest.mark.parametrize(("n", "levels"), [(1, 1), (2, 1), (40, 2), (40, 4), (1_500, 3)])
def test_digits_count_every_pair_once(spark, n, levels):
    rng = np.random.default_rng(n)
    x, y = (pd.Series(rng.integers(0, max(2, n // 2), n)).rank(method="min").astype(int) - 1 for _ in "xy")
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y}))
    want = int((np.sign(x.to_numpy()[:, None] - x.to_numpy()) * np.sign(y.to_numpy()[:, None] - y.to_numpy())).sum() // 2)
    assert digit_balance(df, ["k"], "x", "y", levels).first().s == want


EXTREME = [0.0, -0.0, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 3e-7, 3.0000001e-7]


def test_order_of_extreme_values(spark):
    rng = np.random.default_rng(1)
    values = [*EXTREME, *(1.0 + rng.integers(0, 40, 200) * 2.0**-52), *np.ldexp(rng.normal(size=200), rng.integers(-1000, 1000, 200))]
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double").repartition(5)
    ordered = np.sort(values)
    probs = {f"p{i}": i / (len(values) - 1) for i in range(0, len(values), 7)}
    got = core.exact_quantiles(df, ["k"], "v", probs, bucket=3).first()
    for i in range(0, len(values), 7):
        assert got[f"p{i}"] == pytest.approx(ordered[i], rel=1e-9, abs=1e-320)
    rows = core.average_rank(df, ["k"], "v", "r", bucket=3).toPandas()
    np.testing.assert_allclose(rows.r, rows.v.rank())


def test_nan_is_the_greatest_value(spark):
    df = spark.createDataFrame([(1, v) for v in (2.0, float("nan"), 1.0, float("nan"), 5.0)], "k int, v double")
    got = {(str(r.v), r.r) for r in core.average_rank(df, ["k"], "v", "r").collect()}
    assert got == {("1.0", 1.0), ("2.0", 2.0), ("5.0", 3.0), ("nan", 4.5)}


@pytest.mark.parametrize("n", [2_000, 32_000])
def test_buckets_stay_small_as_a_key_grows(spark, n):
    """One hot key, crowded around one point and with a third of its rows equal."""
    x = F.when(F.col("id") % 3 == 0, 7.0).otherwise(7.0 + F.pow(F.rand(5), 9) * 1e-3)
    df = spark.range(n).select(F.lit(1).alias("k"), x.alias("v"), "id").cache()
    tree = core.value_tree(df, ["k"], "v", bucket=256)
    sizes = tree.rows.groupBy("k", *tree.path).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("v").alias("values"))
    assert sizes.where("values > 1").agg(F.max("rows")).first()[0] <= 256
    ordered = np.sort(df.toPandas().v.to_numpy())
    got = core.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.999}, bucket=16).first()
    np.testing.assert_allclose([got.a, got.b, got.c], np.quantile(ordered, [0.25, 0.5, 0.999]), rtol=1e-15)
    df.unpersist()


def test_lookup_measures_before_it_broadcasts(spark, monkeypatch):
    rows = spark.range(1_000).select((F.col("id") % 50).alias("k"), "id")
    table = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(core.lookup(rows, table, ["k"]))
    monkeypatch.setattr(core, "BROADCAST_ROWS", 49)
    far = core.lookup(rows, table, ["k"])
    assert "strategy=broadcast" not in plan(far) and far.where("d = 2 * k").count() == 1_000


def test_row_position(hot):
    pdf, df = hot
    got = core.row_position(df, ["k"], "time", total="n").toPandas().sort_values("time")
    assert (got._pos == got.groupby("k").cumcount()).all()
    assert (got.n == got.groupby("k").v.transform("size")).all()


@pytest.mark.parametrize("block", [16, 8192])
def test_windows_over_blocks(hot, block):
    pdf, df = hot
    got = core.windowed(
        df, ["k"], 5, 2, lambda w: {"lag": F.lag("v", 5).over(w), "lead": F.lead("v", 2).over(w)}, block=block
    ).toPandas().sort_values("time")
    g = got.groupby("k").v
    pd.testing.assert_series_equal(got["lag"], g.shift(5), check_names=False)
    pd.testing.assert_series_equal(got["lead"], g.shift(-2), check_names=False)
    assert len(got) == len(pdf)


@pytest.mark.parametrize("block", [16, 8192])
def test_nearest_valid(hot, block):
    pdf, df = hot
    holes = df.withColumn("v", F.when(F.col("v") > 0.8, F.col("v")))
    got = core.nearest_valid(holes, ["k"], "v", block=block).select("k", "time", "v", "_prev.v", "_next.v")
    got = got.toDF("k", "time", "v", "prev", "next").toPandas().sort_values("time")
    g = got.groupby("k").v
    pd.testing.assert_series_equal(got["prev"], g.ffill(), check_names=False)
    pd.testing.assert_series_equal(got["next"], g.bfill(), check_names=False)


def test_attach_matches_null_keys_and_keeps_all_rows(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, i int")
    stats = spark.createDataFrame([("a", 10), (None, 20)], "k string, s int")
    assert sorted(core.attach(rows, stats, ["k"]).select("i", "s").collect()) == [(1, 10), (2, 20)]
    left = core.attach(rows, stats, ["k"], "left").select("i", "s").collect()
    assert {tuple(r) for r in left} == {(1, 10), (2, 20), (3, None)}


def test_attach_spreads_a_hot_key(spark):
    """With broadcasting off, no task may hold most of a key that makes up all rows."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        rows = spark.range(20_000).select(F.lit("hot").alias("k"), "id")
        stats = rows.groupBy("k").agg(F.max("id").alias("m"))
        sizes = core.attach(rows, stats, ["k"]).groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert sizes.sum() == 20_000
        assert sizes.max() < 0.4 * sizes.sum()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_attach_spreads_exact_copies(spark):
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 16_000, 1, 16).select(F.lit("hot").alias("k"), F.lit(0.0).alias("v"))
        stats = rows.groupBy("k").agg(F.max("v").alias("m"))
        sizes = core.attach(rows, stats, ["k"]).groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert sizes.sum() == 16_000
        assert sizes.max() < 0.4 * sizes.sum()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_row_position_keeps_null_keys_and_times(spark):
    rows = [(None, "2020-01-01"), (None, "2020-02-01"), ("a", None), ("a", "2020-01-05")]
    df = spark.createDataFrame(rows, "k string, time string").withColumn("time", F.col("time").cast("timestamp_ntz"))
    got = {(r.k, r._pos, r.n) for r in core.row_position(df, ["k"], total="n").collect()}
    assert got == {(None, 0, 2), (None, 1, 2), ("a", 0, 2), ("a", 1, 2)}


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, i int")
    assert [r.v for r in core.nan_to_null(df).orderBy("i").collect()] == [None, 2.0]


def test_salt_depends_on_content_only(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    a = df.withColumn("s", core.salt(df, 8)).orderBy("id").collect()
    b = df.repartition(7).withColumn("s", core.salt(df, 8)).orderBy("id").collect()
    assert a == b


def test_short_keys_are_counted_by_one_task(spark):
    """Every row used to be sent to the tables of all pairs of digits, at any length of its key."""
    from airgrid.operators.ordering import balance

    rng = np.random.default_rng(12)
    for n, values in ((0, 1), (1, 1), (2, 2), (60, 3), (257, 40), (300, 10**6)):
        x, y = rng.integers(0, values, n).astype(float), rng.integers(0, values, n) - values / 2
        want = sum(np.sign(x[i] - x[:i]) @ np.sign(y[i] - y[:i]) for i in range(n))
        assert balance(x, y) == want
    assert balance(np.array([1.0, 2.0, 3.0]), np.array([np.nan, 1.0, np.nan])) == 0  # NaN is greatest and ties with itself
    rows = [(k, float(rng.integers(0, 9)), float(rng.integers(0, 9))) for k, n in (("a", 70), (None, 20), ("c", 1)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("d", 1.0, None)], "k string, u double, v double")
    one, other, mixed = ({tuple(r) for r in concordance(df, ["k"], "u", "v", whole=w).collect()} for w in (100, 0, 30))
    assert one == other == mixed and {r[:2] for r in one} == {("a", 70), (None, 20), ("c", 1)}
    assert concordance(df, ["k"], "u", "v").columns == ["k", "n", "s"]
    short = concordance(df, ["k"], "u", "v")._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow" in short and "explode" not in short
