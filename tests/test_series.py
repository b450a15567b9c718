"""Series operators on small hand-made frames, against pandas and numpy."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airgrid.functions import special
from airgrid.operators import aggregates as A
from airgrid.operators import statistics as S
from airgrid.operators import windows as W
from airgrid.operators.isolation import anomalies_isolation, count_below, fit_isolation, forest_steps, tree_samples


def series_of(spark, values, start="2023-01-01", key="no2", days=None):
    first = dt.datetime.fromisoformat(start)
    days = days or range(len(values))
    rows = [("d", key, first + dt.timedelta(days=int(d)), None if v is None else float(v)) for d, v in zip(days, values, strict=True)]
    return spark.createDataFrame(rows, "dataset_id string, variable string, time timestamp_ntz, value double")


def test_fill_gaps_rules(spark):
    # leading null, a short gap, a long gap, a calendar hole, a short trailing gap
    values = [None, 1.0, None, 3.0, None, None, None, None, 8.0, 11.0, None]
    days = [0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12]
    out = W.fill_gaps(series_of(spark, values, days=days)).orderBy("time").collect()
    assert [r.filled for r in out] == [None, 1.0, 2.0, 3.0, None, None, None, None, 8.0, 9.0, 10.0, 11.0, 11.0]


@pytest.mark.parametrize("block", [4, 8192])
def test_gap_runs_cross_blocks(spark, block):
    values = [1.0, None, None, None, None, None, 2.0, None, 3.0, None]
    out = W.gap_runs(series_of(spark, values), block=block).orderBy("start").collect()
    assert [(r.start.day, r.length) for r in out] == [(2, 5), (8, 1), (10, 1)]


def test_rolling_needs_full_windows(spark):
    df = series_of(spark, [1, 2, None, 4, 5, 6]).withColumnRenamed("value", "v")
    out = W.add_rolling(df, ["v"], (3,), keys=["dataset_id"]).orderBy("time").collect()
    assert [r.v_rolling_mean_3 for r in out] == [None, None, None, None, None, 5.0]
    assert out[-1].v_rolling_std_3 == pytest.approx(1.0)


@pytest.mark.parametrize("block", [16, 8192])
def test_features_equal_pandas(spark, block):
    rng = np.random.default_rng(3)
    n = 80
    pdf = pd.DataFrame({"time": pd.date_range("2021-01-01", periods=n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    df = spark.createDataFrame(pdf).withColumn("dataset_id", F.lit("d")).withColumn("time", F.col("time").cast("timestamp_ntz"))
    got = W.engineer_features(df, "a", ["a", "b"], lags=(1, 3), other_lags=(1,), sizes=(4,), steps=(1,), drop_nulls=False, block=block)
    got = got.toPandas().sort_values("time").reset_index(drop=True)
    assert len(got) == n
    a_lag = pdf.a.shift(3)
    for name, want in {
        "a_lag_3": a_lag,
        "a_lag_3_lag_1": a_lag.shift(1),
        "b_lag_1": pdf.b.shift(1),
        "a_lag_3_rolling_std_4": a_lag.rolling(4).std(),
        "a_rolling_max_4_diff_1": pdf.a.rolling(4).max().diff(1),
        "a_x_b": pdf.a * pdf.b,
    }.items():
        np.testing.assert_allclose(got[name].astype(float), want, err_msg=name, atol=1e-10)


def test_decomposition_adds_up(spark):
    rng = np.random.default_rng(1)
    x = np.arange(60)
    df = series_of(spark, 5 + 0.1 * x + np.sin(2 * np.pi * x / 12) + rng.normal(0, 0.1, 60))
    out = W.decompose(df, block=16).orderBy("time").toPandas()
    core = out.dropna()
    assert len(out) == 60 and len(core) == 48
    np.testing.assert_allclose(core.trend + core.seasonal + core.resid, core.value)
    assert abs(out.seasonal[:12].sum()) < 1e-9


def test_decomposition_needs_two_periods(spark):
    assert W.decompose(series_of(spark, range(23))).count() == 0


def test_recent_trend_with_overlapping_windows(spark):
    out = W.recent_trend(series_of(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9])).first()
    assert (out.recent_mean, out.previous_mean, out.direction) == (6.0, 4.0, "increasing")
    assert W.recent_trend(series_of(spark, range(6))).count() == 0


def test_split_sizes(spark):
    out = W.chrono_split(series_of(spark, range(101))).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"train": 71, "val": 15, "test": 15}


def test_temporal_smooth_uses_slices_not_rows(spark):
    days = [0, 1, 2, 3]
    rows = [("d", "v", dt.datetime(2023, 1, 1 + d), 0, 0, float(10**d)) for d in days]
    rows += [("d", "v", dt.datetime(2023, 1, 1), 0, 1, 1.0), ("d", "v", dt.datetime(2023, 1, 3), 0, 1, 5.0)]
    cube = spark.createDataFrame(rows, "dataset_id string, variable string, time timestamp_ntz, y int, x int, value double")
    for block in (2, 8192):
        out = W.temporal_smooth3(cube, block=block).orderBy("x", "time").collect()
        assert [r.value for r in out] == pytest.approx([5.5, 37.0, 370.0, 550.0, 1.0, 5.0])


def test_describe_constant_and_null(spark):
    out = A.describe(series_of(spark, [2, 2, None, 2])).first()
    assert (out["count"], out.std, out.cv, out.iqr, out.missing_pct) == (3, 0.0, 0.0, 0.0, 25.0)


def test_snr_of_constant_is_infinite(spark):
    assert A.snr(series_of(spark, [3, 3])).first().snr == float("inf")


def test_mape_is_infinite_for_zero_actual(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0)], "y double, p double")
    out = A.regression_metrics(df, "y", "p").first()
    assert out.mape == float("inf") and out.mse == 0.5


def test_histogram_of_constant_uses_middle_bin(spark):
    out = A.histogram(series_of(spark, [4, 4, 4]), 10).collect()
    assert [(r.bin, r["count"]) for r in out] == [(5, 3)]


def evaluated(spark, rows, schema, text):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(F.expr(text)).collect()]


def test_normal_distribution(spark):
    z = [*np.linspace(-37, 8, 181), 0.0, 0.6628, -0.6629, 1e-9]
    rows = [(float(v),) for v in z]
    assert evaluated(spark, rows, "z double", special.normal_cdf("z")) == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], rel=1e-11, abs=1e-305)
    assert evaluated(spark, rows, "z double", special.normal_pvalue("z")) == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in z], rel=1e-11, abs=1e-305)
    logs = evaluated(spark, [*rows, (-1e4,), (None,)], "z double", special.log_normal_cdf("z"))
    assert logs[: len(z)] == pytest.approx([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in z], rel=1e-10, abs=1e-15)
    assert logs[-2] == pytest.approx(-0.5e8 - math.log(1e4 * math.sqrt(2 * math.pi)), rel=1e-12) and logs[-1] is None
    p = [1e-300, 1e-12, 0.01, 0.0749, 0.075, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-12]
    got = evaluated(spark, [(v,) for v in [*p, 0.0, 1.0]], "p double", special.normal_ppf("p"))
    assert got[: len(p)] == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-13, abs=1e-15) and got[-2:] == [None, None]


def t_tail(t, df, steps=200_000):
    """P(|T| >= t) by the midpoint rule over the angle whose tangent is t / sqrt(df)."""
    edge = math.atan(abs(t) / math.sqrt(df))
    weight = lambda a, b: float(np.sum(np.cos(a + (b - a) * (np.arange(steps) + 0.5) / steps) ** (df - 1)) * (b - a) / steps)
    rest, body = weight(edge, math.pi / 2), weight(0.0, edge)
    return rest / (rest + body)


def test_t_distribution(spark):
    cases = [(t, d) for t in (0.0, 0.3, -1.2, 1.7, 2.5, 9.0) for d in (1.0, 2.0, 7.5, 30.0, 1_000.0, 1_001.0, 5_000.0)]
    got = evaluated(spark, cases, "t double, d double", special.t_pvalue("t", "d"))
    assert got == pytest.approx([t_tail(t, d) for t, d in cases], rel=1e-6, abs=1e-12)
    # closed forms at one and two degrees of freedom
    ends = evaluated(spark, [(3.0, 1.0), (3.0, 2.0)], "t double, d double", special.t_pvalue("t", "d"))
    assert ends == pytest.approx([1 - 2 * math.atan(3.0) / math.pi, 1 - 3 / math.sqrt(11)], rel=1e-12)
    far = evaluated(spark, [(math.inf, 5.0), (2.0, 0.0), (None, 3.0)], "t double, d double", special.t_pvalue("t", "d"))
    assert far == [0.0, None, None]


def test_t_quantile(spark):
    rows = [(d,) for d in (1.0, 2.0, 10.0, 1e6)]
    got = evaluated(spark, rows, "d double", special.t_quantile(0.975, "d"))
    assert got == pytest.approx([math.tan(math.pi * 0.475), 4.302652729749464, 2.2281388519862744, 1.9599663569], rel=1e-9)


def test_anderson_darling_separates_normal_from_exponential(spark):
    rng = np.random.default_rng(2)
    normal = S.anderson_darling(series_of(spark, rng.normal(size=300)), tiebreak=["time"]).first()
    skewed = S.anderson_darling(series_of(spark, rng.exponential(size=300)), tiebreak=["time"]).first()
    assert normal.statistic < normal.critical_1 < skewed.statistic
    z = np.sort((lambda v: (v - v.mean()) / v.std(ddof=1))(np.random.default_rng(2).normal(size=300)))
    i = np.arange(1, 301)
    cdf = np.array([NormalDist().cdf(v) for v in z])
    want = -300 - np.mean((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1])))
    assert normal.statistic == pytest.approx(want, rel=1e-9)


def wide_frame(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(size=n), "c": rng.normal(size=n) - a, "time": pd.date_range("2020-01-01", periods=n)})
    df = spark.createDataFrame(pdf).withColumn("dataset_id", F.lit("d")).withColumn("time", F.col("time").cast("timestamp_ntz"))
    return pdf, df


def test_correlations_equal_pandas(spark):
    pdf, df = wide_frame(spark)
    for method in ("pearson", "spearman"):
        got = S.correlation(df, ["a", "b", "c"], method).toPandas().pivot(index="variable_a", columns="variable_b", values="r")
        np.testing.assert_allclose(got, pdf[["a", "b", "c"]].corr() if method == "pearson" else pdf[["a", "b", "c"]].rank().corr(), atol=1e-12)


def test_partial_correlation_equals_residual_correlation(spark):
    pdf, df = wide_frame(spark)
    got = {(r.variable_a, r.variable_b): r.partial_r for r in S.partial_correlation(df, ["a", "b", "c"]).collect()}
    x = np.c_[np.ones(len(pdf)), pdf.c]
    res = [pdf[v] - x @ np.linalg.lstsq(x, pdf[v], rcond=None)[0] for v in "ab"]
    assert got["a", "b"] == pytest.approx(np.corrcoef(*res)[0, 1])


def test_multiple_regression_equals_least_squares(spark):
    pdf, df = wide_frame(spark, 63)
    got = {r.target: r for r in S.multiple_regression(df, ["a", "b", "c"]).collect()}
    x, y = np.c_[np.ones(63), pdf[["a", "c"]]], pdf.b.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert got["b"].intercept == pytest.approx(beta[0]) and got["b"].coefficients == pytest.approx(list(beta[1:]))
    held = []
    for part in np.array_split(np.arange(63), 5):
        rest = np.setdiff1d(np.arange(63), part)
        fit = np.linalg.lstsq(x[rest], y[rest], rcond=None)[0]
        res = y[part] - x[part] @ fit
        held.append(1 - (res**2).sum() / ((y[part] - y[part].mean()) ** 2).sum())
    assert got["b"].cv_r2_mean == pytest.approx(np.mean(held)) and got["b"].cv_r2_std == pytest.approx(np.std(held))


def test_pca_ratios(spark):
    pdf, df = wide_frame(spark)
    got = S.pca(df, ["a", "b", "c"]).orderBy("component").toPandas()
    values = np.sort(np.linalg.eigvalsh(pdf[["a", "b", "c"]].corr()))[::-1]
    np.testing.assert_allclose(got.explained_ratio, values / values.sum(), atol=1e-12)
    assert got.cumulative_ratio.iloc[-1] == pytest.approx(1.0)


def test_pair_distance_is_exact_over_chunks(spark):
    pdf, df = wide_frame(spark, 50)
    got = S.mean_pair_distance(df, ["a", "b"], ["dataset_id"], ["time"], chunk=7).first().mean_distance
    p = pdf[["a", "b"]].to_numpy()
    d = np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    assert got == pytest.approx(d[np.triu_indices(50, 1)].mean())


def test_hopkins_labels(spark):
    _, df = wide_frame(spark, 50)
    assert S.hopkins(df, ["a", "b"]).first().tendency in ("low", "moderate", "high")
    assert S.hopkins(df.limit(5), ["a", "b"]).first().tendency == "insufficient_data"


def test_isolation_flags_the_far_values(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(0, 1, 190), rng.normal(0, 1, 10) + 50])
    out = anomalies_isolation(series_of(spark, values), contamination=0.05).toPandas()
    assert out.is_anomaly.sum() <= 10
    assert (out[out.is_anomaly].value > 40).sum() >= 8


@pytest.mark.parametrize("n", [100, 3_000])
def test_isolation_model_ignores_order_and_partitions(spark, n):
    values = np.random.default_rng(n).normal(size=n).round(3)
    rows = series_of(spark, values)
    models = [fit_isolation(df).orderBy("chunk").collect() for df in (rows, rows.orderBy("value").repartition(5))]
    assert models[0] == models[1]
    sampled = tree_samples(rows, ["dataset_id", "variable"], "value", 100, 42).collect()
    assert len(sampled) == 100 and {len(r["_values"]) for r in sampled} == {min(n, 256)}


def test_isolation_scores_in_parts_as_the_model_says(spark, monkeypatch):
    """Parts of a key score their rows by the forest's steps; no step function travels to the rows."""
    from airgrid.operators import isolation

    monkeypatch.setattr(isolation, "PART", 100, raising=True)
    rows = series_of(spark, [None, *np.random.default_rng(5).normal(size=900).round(2)])
    model = fit_isolation(rows).orderBy("chunk").collect()
    edges, scores = (np.concatenate([m[c] for m in model]) for c in ("edges", "scores"))
    out = anomalies_isolation(rows)
    got = out.toPandas().dropna(subset="value")
    np.testing.assert_allclose(got.score, scores[np.searchsorted(edges, got.value, "left")])
    assert len(got) == 900 and out.where("value IS NULL AND score IS NULL AND NOT is_anomaly").count() == 1
    assert not out.where("value IS NOT NULL AND score IS NULL").count()


@pytest.mark.parametrize("n", [1, 300, 2_500])
def test_isolation_draws_short_keys_in_their_task(spark, monkeypatch, n):
    """Every row of a short series used to be shuffled once for each of a hundred trees."""
    from airgrid.operators import isolation

    values = np.random.default_rng(n).normal(size=n).round(2)
    rows = series_of(spark, [None, *values]).unionByName(series_of(spark, [None], key="so2"))
    rows = rows.unionByName(rows.where("value > 1.5"))  # copies
    hashed = rows.select("value", F.xxhash64(*rows.columns).alias("h")).where("value IS NOT NULL").toPandas()
    want = {r["_tree"]: sorted(r["_values"]) for r in tree_samples(rows, ["dataset_id", "variable"], "value", 100, 42).collect()}
    got = isolation.key_samples(hashed.h.to_numpy(), hashed.value.to_numpy(), 100, 42)
    assert [g.tolist() for g in got] == [want[t] for t in sorted(want)]
    out = anomalies_isolation(rows)
    assert "explode" not in out._jdf.queryExecution().analyzed().toString() and "CoGroup" not in out._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(isolation, "PART", n)  # one key longer than a part, one shorter
    assert sorted(map(repr, out.collect())) == sorted(map(repr, anomalies_isolation(rows).collect()))
    assert out.count() == rows.count()


def test_forest_steps_are_a_step_function():
    rng = np.random.default_rng(1)
    cuts, scores = forest_steps([np.sort(rng.normal(size=250)) for _ in range(20)], 7)
    assert len(scores) == len(cuts) + 1 and (np.diff(cuts) > 0).all()
    assert ((scores > 0) & (scores <= 1)).all()


@pytest.mark.parametrize("size", [1, 2, 7, 8, 200])
def test_count_below(spark, size):
    edges = [float(i) for i in range(size)]
    df = spark.createDataFrame([(float(v) / 2,) for v in range(-2, 2 * size + 3)], "v double")
    out = df.select("v", count_below(F.array(*[F.lit(e) for e in edges]), F.col("v"), size).alias("n")).collect()
    assert all(r.n == sum(e < r.v for e in edges) for r in out)


def test_mann_kendall_monotone(spark):
    out = S.mann_kendall(series_of(spark, range(30))).first()
    assert (out.s, out.trend) == (435, "increasing") and out.p_value < 1e-6
    flat = S.mann_kendall(series_of(spark, [1] * 20)).first()
    assert (flat.s, flat.z, flat.trend) == (0, 0.0, "no trend")


def test_t_distribution_keeps_its_digits(spark):
    rows = [(t, df) for df in (5.0, 1e4, 1e10, 1e13, 1e15) for t in (0.0, 1.7)]
    got = dict(zip(rows, evaluated(spark, rows, "t double, d double", special.t_pvalue("t", "d")), strict=True))
    for (t, df), p in got.items():
        if t == 0.0:
            assert p == pytest.approx(1.0)
        elif df >= 1e10:  # the normal distribution
            assert p == pytest.approx(math.erfc(1.7 / math.sqrt(2)), rel=1e-9)


def test_days_with_several_rows(spark):
    from airgrid.operators.sets import missing_days
    from airgrid.operators.windows import fill_gaps

    at = [dt.datetime(2023, 1, 1, 1), dt.datetime(2023, 1, 1, 13), dt.datetime(2023, 1, 3)]
    df = spark.createDataFrame([("d", "v", t, float(i)) for i, t in enumerate(at)], "dataset_id string, variable string, time timestamp_ntz, value double")
    assert [r.day.day for r in missing_days(df).collect()] == [2]
    filled = fill_gaps(df).orderBy("time").collect()
    assert [(r.time.day, r.filled, r.was_missing) for r in filled] == [(1, 0.5, False), (2, 1.25, True), (3, 2.0, False)]


def test_pair_distance_makes_no_object_for_each_row(spark, monkeypatch):
    """Chunks reach the distance sums as Arrow arrays; null coordinates leave their chunk pairs out, as before."""
    from pyspark.sql import functions as functions

    kinds = []
    monkeypatch.setattr(functions, "pandas_udf", lambda *a, **k: kinds.append(a) or pytest.fail("rows as pandas objects"))
    pdf, df = wide_frame(spark, 30)
    one = S.mean_pair_distance(df, ["a", "b"], ["dataset_id"], ["time"], chunk=1000).first()
    p = pdf[["a", "b"]].to_numpy()
    d = np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    assert one.n == 30 and one.mean_distance == pytest.approx(d[np.triu_indices(30, 1)].mean()) and not kinds
