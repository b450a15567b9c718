"""Sources, validation, streaming, learning and invariants."""

import datetime as dt
import hashlib
import math
import threading

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airgrid.functions import calendar, geo, levels, scaling
from airgrid.operators import learning as ML
from airgrid.operators import slicing as B
from airgrid.operators import validation as Q
from airgrid.operators import windows as W
from airgrid.sources import files, tables
from airgrid.streaming import monitoring

CUBE = "dataset_id string, variable string, time timestamp_ntz, y int, x int, lat double, lon double, value double"
T0 = dt.datetime(2023, 1, 1)


def test_read_table_rejects_unknown_formats(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "/tmp/nothing.xlsx")


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "k string, i int, v double")
    for fmt in ("parquet", "csv", "json"):
        path = str(tmp_path / f"t.{fmt}")
        tables.write_table(df, path)
        assert sorted(tables.read_table(spark, path, schema=df.schema).collect()) == sorted(df.collect())


def test_partitioned_layout_prunes(spark, tmp_path):
    rows = [("d", v, dt.datetime(2023, m, 1), 0, 0, 0.0, 0.0, 1.0) for v in ("no2", "so2") for m in (1, 2)]
    tables.write_partitioned(spark.createDataFrame(rows, CUBE), str(tmp_path / "cube"))
    out = spark.read.parquet(str(tmp_path / "cube")).where("product = 'no2' and year = 2023 and month = 2")
    assert out.count() == 1
    assert "PartitionFilters: [isnotnull(product" in out._jdf.queryExecution().toString()


def test_checksums_of_files_larger_than_a_row(spark, tmp_path):
    """The content of a file used to be one value of a row, which ends at 2 GB."""
    large = tmp_path / "a b%20c#d"
    large.mkdir()
    (large / "long, é.csv").write_bytes(b"x" * 11)
    with open(large / "big.nc", "wb") as f:
        f.truncate((1 << 31) + 7)  # takes no room on disk
        f.write(b"start")
    want = {}
    for name in ("long, é.csv", "big.nc"):
        with open(large / name, "rb") as f:
            want[name] = hashlib.file_digest(f, "sha1").hexdigest()
    m = files.lake_manifest(spark, str(tmp_path), checksum="sha1")
    assert {r.name: r.checksum for r in m.collect()} == want
    assert m.columns == [*files.lake_manifest(spark, str(tmp_path)).columns, "checksum"]
    out = files.verify_integrity(m, m.select("path", "checksum")).collect()
    assert len(out) == 2 and all(r.intact for r in out)


def test_manifest_and_integrity(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.nc").write_bytes(b"12")
    (tmp_path / "sub" / "empty.nc").write_bytes(b"")
    m = files.lake_manifest(spark, str(tmp_path), checksum="md5").cache()
    assert {(r.name, r.file_type, r.size) for r in m.collect()} == {("a.csv", "csv", 4), ("b.nc", "netcdf", 2)}
    path = m.where("name = 'a.csv'").first().path
    other = path.replace("a.csv", "sub/b.nc")
    good = hashlib.md5(b"x\n1\n").hexdigest()
    rows = [(path, good), (other, "0" * 32), (other.replace("b.nc", "empty.nc"), None), ("file:/gone", None)]
    want = spark.createDataFrame(rows, "path string, checksum string")
    out = {r.path.rsplit("/", 1)[-1]: (r.exists, r.not_empty, r.intact) for r in files.verify_integrity(m, want).collect()}
    assert out["a.csv"] == (True, True, True) and out["b.nc"] == (True, True, False)
    assert not out["gone"][2] and not out["empty.nc"][2]
    usage = files.storage_usage(m).first()
    assert (usage.total_bytes, usage.file_count, usage.directory_count) == (6, 2, 2)


def test_tiles_of_a_large_slice_round_trip(spark, tmp_path):
    """Holes, nulls, a null key and sides that aren't multiples of a tile's; no row is longer than a tile."""
    ny, nx, tile = 37, 21, 8
    cells = {
        (d, y, x): None if (y + x) % 11 == 0 else y * 100.0 + x
        for d in ("a", None) for y in range(ny) for x in range(nx) if (y * x) % 7 != 3 and not (y < 8 and x < 8)
    }
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "d string, y int, x int, value double")
    tiles = tables.tile_pyramid(df, ny, nx, levels=3, tile=tile, keys=["d"])
    path = str(tmp_path / "tiles")
    tables.write_tiles(tiles, path)
    stored = spark.read.parquet(path)
    assert {len(r["values"]) for r in stored.collect()} == {tile * tile}
    assert stored.where("level = 0 and ty = 0 and tx = 0").count() == 0
    back = tables.tiles_to_long(stored, ny, nx, tile).collect()
    want = {}
    for (d, y, x), v in cells.items():
        for level in range(3):
            if v is not None:
                want.setdefault((d, level, y >> level, x >> level), []).append(v)
    got = {(r.d, r.level, r.y, r.x): r.value for r in back}
    assert len(got) == len(back) and got.keys() == want.keys()
    assert all(v == pytest.approx(sum(want[k]) / len(want[k])) for k, v in got.items())

    window = tables.read_window(spark, path, 1, (3, 9), (8, 10), ny, nx, tile)
    assert {(r.d, r.y, r.x) for r in window.collect()} == {(d, y, x) for d, n, y, x in want if n == 1 and 3 <= y <= 9 and 8 <= x <= 10}
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(ty,1)" in plan and "PartitionFilters: [isnotnull(level" in plan
    assert tables.tile_pyramid(df.limit(0), ny, nx, levels=2, tile=tile, keys=["d"]).count() == 0


def test_raster_round_trip_with_holes(spark):
    df = spark.createDataFrame([("d", "v", T0, 0, 2, 1.0), ("d", "v", T0, 3, 0, 2.0)], "dataset_id string, variable string, time timestamp_ntz, y int, x int, value double")
    raster = tables.long_to_raster(df, 4, 3)
    assert raster.first().raster == [[None, None, 1.0], [None] * 3, [None] * 3, [2.0, None, None]]
    back = tables.raster_to_long(raster).where("value is not null").select("y", "x", "value").collect()
    assert sorted(tuple(r) for r in back) == [(0, 2, 1.0), (3, 0, 2.0)]


def test_quality_mask_nulls_missing_flags(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 3), (3.0, None)], "value double, qa int")
    assert [r.value for r in B.mask_quality(df).collect()] == [1.0, None, None]


def test_nearest_slice_takes_the_earlier_on_ties(spark):
    rows = [("d", "v", T0 + dt.timedelta(days=d), 0, 0, 0.0, 0.0, float(d)) for d in (0, 2)]
    out = B.nearest_slice(spark.createDataFrame(rows, CUBE), "2023-01-02").collect()
    assert [r.value for r in out] == [0.0]


def test_clip_reaches_the_scan(spark, tmp_path):
    rows = [("d", "v", T0, 0, 0, 33.0, 73.0, 1.0)]
    spark.createDataFrame(rows, CUBE).write.parquet(str(tmp_path / "c"))
    df = B.clip_bbox(spark.read.parquet(str(tmp_path / "c")), {"south": 32, "north": 34, "west": 72, "east": 74}).select("value")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lat), IsNotNull(lon), GreaterThanOrEqual(lat,32.0)" in plan
    assert "ReadSchema: struct<lat:double,lon:double,value:double>" in plan


def test_report_folding(spark):
    rows = [("a", "passed", "info"), ("b", "failed", "warning"), ("c", "failed", "critical"), ("d", "failed", "error"), ("e", "warning", "warning")]
    df = spark.createDataFrame(rows, "dataset_id string, status string, level string")
    df = df.withColumns({"test_name": F.lit("t"), "message": F.lit("m")})
    out = {r.dataset_id: r.overall_status for r in Q.report(df).collect()}
    assert out == {"a": "passed", "b": "partial", "c": "failed", "d": "failed", "e": "passed"}


def test_checks_fire_and_pass(spark):
    rows = [("d", "no2", T0 + dt.timedelta(days=t), y, x, 33.0 + y, 72.0 + x, 200.0 if (t, y, x) == (0, 0, 0) else 1.0) for t in (0, 1, 2, 9) for y in range(3) for x in range(3)]
    cube = spark.createDataFrame(rows, CUBE)
    box = {"south": 33.5, "north": 34.5, "west": 72.5, "east": 73.5}
    out = {r.test_name: r.status for r in Q.validate_cube(cube, box, (3, 3), source="modis").collect()}
    assert out["range_validation_no2"] == "warning" and out["temporal_gaps"] == "warning" and out["modis_quality_flags"] == "warning"
    assert out["spatial_coverage"] == "passed" and out["overall_quality"] == "passed" and out["all_nan_no2"] == "passed"


def check_rows(df):
    return sorted((r.dataset_id, r.test_name, r.status, r.level, r.message, sorted((r.details or {}).items())) for r in df.collect())


def test_one_aggregation_serves_all_checks(spark):
    box = {"south": 33.5, "north": 34.5, "west": 72.5, "east": 73.5}
    rows = [
        (d, v, None if t == 5 else T0 + dt.timedelta(days=t), y, x, 33.0 + y, 72.0 + x, None if v == "gone" or (t + y) % 3 == 0 else 50.0 * t)
        for d in ("a", "b") for v in ("no2", "gone", "odd_qa") for t in (0, 1, 2, 5) for y in range(3) for x in range(3)
    ]
    cube = spark.createDataFrame(rows, CUBE)
    datasets = spark.createDataFrame([("a",), ("empty",)], "dataset_id string")
    required = spark.createDataFrame([("a", "no2"), ("a", "aod"), ("c", "co")], "dataset_id string, variable string")
    for source in ("sentinel5p", "modis", "gee"):
        alone = [
            Q.check_coordinates(cube), Q.check_all_null(cube), Q.check_coverage(cube), Q.check_range(cube), Q.check_product(cube),
            Q.check_region(cube, box), Q.check_gradients(cube, (3, 3)), Q.check_time_gaps(cube), Q.check_quality_score(cube),
            Q.check_empty(cube, datasets), Q.check_required(cube, required), Q.check_source(cube, source),
        ]
        together = Q.validate_cube(cube, box, (3, 3), datasets, required, source)
        assert check_rows(together) == sorted(row for df in alone for row in check_rows(df))
    assert check_rows(Q.validate_cube(cube.limit(0), box, (3, 3))) == []


def test_checks_ask_for_one_table_per_grain(spark):
    cube = spark.createDataFrame([("d", "no2", T0, 0, 0, 33.0, 72.0, 1.0)], CUBE)
    tables = Q.gathered_facts(cube, [Q.coverage_check(), Q.coordinates_check(), Q.time_gaps_check()])
    assert set(tables) == {("dataset_id", "variable"), ("dataset_id",), ("dataset_id", "time")}
    # one check alone is gathered at its own grain
    assert Q.gathered_facts(cube, [Q.coordinates_check()])[("dataset_id",)].columns[0] == "dataset_id"


def test_grid_consistency_sees_falling_axes(spark):
    rows = [("up", "v", T0, y, 0, 33.0 + y, 72.0, 1.0) for y in range(3)] + [("down", "v", T0, y, 0, 35.0 - y, 72.0, 1.0) for y in range(3)]
    out = Q.grid_consistency(spark.createDataFrame(rows, CUBE), {"south": 30, "north": 31, "west": 70, "east": 80}).collect()
    assert {r.dataset_id: (r.lat_increasing, r.overlaps_region) for r in out} == {"up": (True, False), "down": (False, False)}


def test_file_validation_reports_unreadable_files(spark):
    manifest = spark.createDataFrame([("f1",), ("f2",)], "path string")
    rows = spark.createDataFrame([("f1",)], "path string")
    assert {r.dataset_id: r.overall_status for r in Q.validate_files(rows, manifest).collect()} == {"f1": "passed", "f2": "failed"}


def test_stream_append_drops_late_records(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "event_type string, ts timestamp_ntz, value double"

    def batch(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        monitoring.run_available(monitoring.stream_daily(stream, "1 day"), out, ckpt)

    batch(("a", T0, 1.0), ("a", T0 + dt.timedelta(hours=3), 3.0))
    batch(("a", T0 + dt.timedelta(days=5), 9.0))
    batch(("a", T0, 100.0), ("a", T0 + dt.timedelta(days=9), 1.0))
    got = {r.day: (r.mean, r["count"]) for r in spark.read.parquet(out).collect()}
    assert got[dt.date(2023, 1, 1)] == (2.0, 2)
    assert dt.date(2023, 1, 10) not in got


def test_update_mode_goes_on_from_its_checkpoint(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "event_type string, ts timestamp_ntz, value double"

    def batch(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)  # a new query each time
        monitoring.run_available_update(monitoring.stream_daily(stream, "2 days"), out, ckpt)
        return {(r.event_type, r.day.day): (r.mean, r["count"]) for r in monitoring.latest_groups(spark, out, ["event_type", "day"]).collect()}

    assert batch(("a", T0, 1.0), ("b", T0, 5.0)) == {("a", 1): (1.0, 1), ("b", 1): (5.0, 1)}
    assert batch(("a", T0 + dt.timedelta(hours=3), 3.0)) == {("a", 1): (2.0, 2), ("b", 1): (5.0, 1)}
    batch(("a", T0 + dt.timedelta(days=9), 7.0))
    assert batch(("a", T0, 100.0))[("a", 1)] == (2.0, 2)  # later than the watermark


def test_alert_levels(spark):
    df = spark.createDataFrame([("no2", 60.0), ("no2", 45.0), ("no2", 20.0), ("no2", 1.0), ("aod", 99.0), ("x", 1.0), ("no2", None)], "variable string, value double")
    out = [r[0] for r in df.select(levels.alert_level(F.col("variable"), F.col("value"))).collect()]
    assert out == ["critical", "warning", "moderate", "good", "warning", None, None]


def frame(spark, n=120):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = x @ [3.0, -2.0, 0.0] + 5 + rng.normal(0, 0.1, n)
    rows = [("d", T0 + dt.timedelta(days=i), *map(float, x[i]), float(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "dataset_id string, time timestamp_ntz, a double, b double, c double, y double")


def test_ridge_equals_the_closed_form(spark):
    x, y, df = frame(spark)
    model = ML.train(df.withColumn("split", F.lit("train")), ["a", "b", "c"], "y", ("ridge",))["ridge"].model
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(model.coefficients.toArray(), want, atol=1e-5)


def test_training_run_from_table_to_predictions(spark, tmp_path):
    _, _, df = frame(spark)
    run = ML.run_training(df, "y", ["a", "b", "c"], ("linear", "ridge", "random_forest"), k=2, save_to=str(tmp_path / "m"))
    assert run.columns == ["a", "b"] and run.best in ("linear", "ridge")
    metrics = {(r.model, r.split): r.r2 for r in run.metrics.collect()}
    assert metrics["linear", "test"] > 0.99 and metrics["random_forest", "train"] > 0.9
    out = run.predictions.collect()
    assert len(out) == 18 and all(r.lower < r.prediction < r.upper for r in out)
    assert spark.read.parquet(str(tmp_path / "m" / "y_metrics")).count() == 9


def test_boosting_and_aliases(spark):
    _, _, df = frame(spark, 60)
    out = ML.train(df.withColumn("split", F.lit("train")), ["a", "b"], "y", ("xgboost",))
    assert out["gradient_boosting"].importance["a"] > 0.3  # named after the model that ran


def test_rfe_drops_the_idle_feature(spark):
    _, _, df = frame(spark)
    assert ML.select_features(df, ["a", "b", "c"], "y", "rfe", 2) == ["a", "b"]


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_scaling_leaves_cyclic_columns(spark, method):
    _, _, df = frame(spark)
    rows = df.withColumns({"split": F.when(F.dayofyear("time") < 80, "train").otherwise("test"), "month_sin": F.lit(0.3)})
    out = ML.scale(rows, ["a", "month_sin"], method).toPandas()
    train = out[out.split == "train"].a
    assert (out.month_sin == 0.3).all()
    if method == "standard":
        assert abs(train.mean()) < 1e-9 and train.std(ddof=0) == pytest.approx(1)
    elif method == "minmax":
        assert (train.min(), train.max()) == (0.0, pytest.approx(1.0))
    else:
        assert abs(train.median()) < 1e-9


QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(st.lists(st.floats(-2000, 2000), min_size=1, max_size=20))
def test_normalised_longitude_is_in_range(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "lon double")
    for r in df.select("lon", geo.normalize_lon(F.col("lon")).alias("n")).collect():
        assert -180 <= r.n <= 180
        assert math.isclose(math.cos(math.radians(r.n)), math.cos(math.radians(r.lon)), abs_tol=1e-9)


@QUICK
@given(st.lists(st.floats(0.1, 100), min_size=2, max_size=20))
def test_gamma_keeps_the_range(spark, values):
    df = spark.createDataFrame([("d", "v", v) for v in values], "dataset_id string, variable string, value double")
    out = [r.value for r in scaling.gamma_correct(df).collect()]
    assert min(out) == pytest.approx(min(values)) and max(out) == pytest.approx(max(values))


@QUICK
@given(st.lists(st.tuples(st.floats(30, 36), st.floats(70, 76)), min_size=1, max_size=20))
def test_clip_is_idempotent(spark, cells):
    df = spark.createDataFrame(cells, "lat double, lon double")
    box = {"south": 32.0, "north": 34.0, "west": 72.0, "east": 74.0}
    once = B.clip_bbox(df, box)
    assert sorted(once.collect()) == sorted(B.clip_bbox(once, box).collect())


def test_calendar_labels(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 12, 31),), (dt.datetime(2024, 2, 29),)], "t timestamp_ntz")
    out = df.select(calendar.season_label(F.col("t")), calendar.week_end(F.col("t")), calendar.month_end(F.col("t"))).collect()
    assert tuple(out[0]) == ("DJF", dt.date(2023, 12, 31), dt.date(2023, 12, 31))
    assert tuple(out[1]) == ("DJF", dt.date(2024, 3, 3), dt.date(2024, 2, 29))


# ---------------------------------------------------------------- training on feature matrices


PLAN = W.FeaturePlan("y", ("y", "a"), lags=(1, 2), other_lags=(1,), sizes=(3,), steps=(1,))


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(3)
    n = 240
    a = rng.normal(size=n)
    y = 5 + 2 * a + 0.1 * rng.normal(size=n) + np.sin(np.arange(n) / 9)
    pdf = pd.DataFrame({"dataset_id": np.repeat(["p", "q"], n // 2), "time": np.tile(pd.date_range("2021-01-01", periods=n // 2), 2), "y": y, "a": a})
    return ML.matrix_table(W.feature_matrix(spark.createDataFrame(pdf), PLAN), PLAN)


def as_numpy(rows):
    got = rows.toPandas()
    return np.stack(got.features.to_numpy()), got.label.to_numpy(), got


def test_matrix_split_is_the_chronological_one(matrix):
    _, _, got = as_numpy(matrix.rows)
    assert "y" not in matrix.names and len(matrix.names) == len(got.features[0]) == len(PLAN.names) - 1
    for _, g in got.sort_values("time").groupby("dataset_id"):
        n, part = len(g), int(len(g) * 0.15)
        assert list(g.split) == ["train"] * (n - 2 * part) + ["val"] * part + ["test"] * part


def test_matrix_scores_are_the_f_scores_of_each_column(matrix):
    train = matrix.rows.where("split = 'train'")
    x, y, _ = as_numpy(train)
    got = ML.matrix_scores(train, matrix.names).orderBy("place").toPandas()
    assert list(got.feature) == list(matrix.names)
    for i in range(x.shape[1]):
        r2 = 0.0 if np.ptp(x[:, i]) < 1e-9 else np.corrcoef(x[:, i], y)[0, 1] ** 2
        assert got.r2[i] == pytest.approx(r2, abs=1e-9)
        assert got.score[i] == pytest.approx(r2 * (len(y) - 2) / (1 - r2), rel=1e-6, abs=1e-6)
    chosen = ML.select_from_matrix(matrix, 4)
    assert set(chosen) == set(got.sort_values("r2", ascending=False).feature[:4]) and "a" in chosen
    assert ML.matrix_scores(train.limit(0), matrix.names).count() == 0


def test_matrix_training_equals_closed_forms(matrix):
    run = ML.run_matrix_training(matrix, "y", ("linear", "ridge"), k=5)
    x, y, frame = as_numpy(matrix.rows)
    place = [matrix.names.index(c) for c in run.columns]
    train = (frame.split == "train").to_numpy()
    x = x[:, place]
    waves = np.array([ML.is_cyclic(c) for c in run.columns])
    for i in np.flatnonzero(~waves):
        if (x[train, i] > 0).all() and pd.Series(x[train, i]).skew() > 1:
            x[:, i] = np.log1p(x[:, i])
    centre, width = np.where(waves, 0, x[train].mean(0)), np.where(waves, 1, x[train].std(0))
    z = (x - centre) / width
    for name, penalty in (("linear", 0.0), ("ridge", 1.0)):
        mean = z[train].mean(0)
        w = np.linalg.solve((z[train] - mean).T @ (z[train] - mean) + penalty * np.eye(5), (z[train] - mean).T @ (y[train] - y[train].mean()))
        fitted = (z - mean) @ w + y[train].mean()
        got = run.metrics.where(f"model = '{name}'").toPandas().set_index("split")
        for split in ("train", "val", "test"):
            rows = (frame.split == split).to_numpy()
            assert got.loc[split, "rmse"] == pytest.approx(np.sqrt(np.mean((y[rows] - fitted[rows]) ** 2)), rel=1e-4)


def test_a_matrix_worked_out_from_blocks_is_the_stored_one(spark):
    """The whole matrix used to be stored, two thousand numbers a row; now only the blocks' narrow rows are."""
    rng = np.random.default_rng(4)
    n = 90
    pdf = pd.DataFrame({"dataset_id": np.repeat(["p", "q", None], n // 3), "time": np.tile(pd.date_range("2021-01-01", periods=n // 3), 3), "y": rng.normal(size=n), "a": rng.normal(size=n)})
    pdf.loc[[11, 50], "a"] = [np.nan, np.inf]
    df = spark.createDataFrame(pdf)
    stored = ML.matrix_table(W.feature_matrix(df, PLAN, block=8), PLAN)
    table = ML.block_table(W.feature_blocks(df, PLAN, block=8))
    assert table.names == stored.names and not [t for _, t in table.blocks.rows.dtypes if t.startswith("array")]
    listed = lambda rows: sorted((str(r) for r in rows.collect()))
    assert listed(table.rows) == listed(stored.rows) and stored.rows.count() > 40
    for split in ("train", "val", "test"):
        assert listed(table.part(split)) == listed(stored.part(split))
    some = [table.names[i] for i in (20, 3, 11)]
    assert listed(table.columns(some, ["time", "split"], "y")) == listed(stored.columns(some, ["time", "split"], "y"))
    got, want = (t.train_scores().orderBy("place").toPandas() for t in (table, stored))
    assert list(got.feature) == list(want.feature)
    np.testing.assert_allclose(got[["score", "r2"]], want[["score", "r2"]], rtol=1e-6, atol=1e-9)
    empty = ML.block_table(W.feature_blocks(df.limit(0), PLAN))
    assert empty.train_scores().count() == 0 and empty.rows.count() == 0


@pytest.mark.parametrize("value", [np.nan, 1e200, -1e308, 0.0])
def test_known_rows_are_those_without_an_unknown_feature(value):
    for plan in (PLAN, W.FeaturePlan("y", ("y", "a"), lags=(2, 5), other_lags=(4,), sizes=(1, 2), steps=(9,)), W.FeaturePlan("y", ("y", "a"))):
        base = {c: np.random.default_rng(1).random(200) for c in [*plan.calendar, "y", "a"]}
        base["a"][[20, 140]], base["month"][190] = value, np.nan
        with np.errstate(all="ignore"):
            matrix = plan.rows(base)
            np.testing.assert_array_equal(plan.known(base), ~np.isnan(matrix).any(axis=1))
            some = plan.names[5::7]
            np.testing.assert_array_equal(plan.rows(base, some), matrix[:, [plan.names.index(c) for c in some]])


def test_models_are_fitted_at_the_same_time(spark, monkeypatch):
    """A fit of many small jobs used to keep the next one waiting; here each fit waits until all have begun."""
    _, _, df = frame(spark, 60)
    begun, estimator = threading.Barrier(3, timeout=60), ML._estimator

    def waiting(*args):
        begun.wait()
        return estimator(*args)

    monkeypatch.setattr(ML, "_estimator", waiting)
    out = ML.train(df.withColumn("split", F.lit("train")), ["a", "b"], "y", ("linear", "ridge", "lasso"))
    assert list(out) == ["linear", "ridge", "lasso"]
    with pytest.raises(ZeroDivisionError):
        ML.at_once(spark, lambda name: 1 // len(name), ["a", ""])


def test_scorers_give_the_same_after_reload_as_a_batch_and_as_a_stream(spark, matrix, tmp_path):
    run = ML.run_matrix_training(matrix, "y", ("linear", "random_forest", "gradient_boosting"), k=3)
    keys = ["dataset_id", "time"]
    matrix.rows.select(*keys, "features").write.parquet(str(tmp_path / "matrix"))
    stored = spark.read.parquet(str(tmp_path / "matrix"))
    for name, scorer in run.scorers.items():
        base = str(tmp_path / name)
        scorer.save(spark, base)
        again = ML.Scorer.load(spark, base)
        assert (again.names, again.columns, again.scaler) == (scorer.names, scorer.columns, scorer.scaler)
        want = {tuple(r) for r in ML.predict(run.trained[name], run.rows, "y", keys).drop("actual").collect()}
        batch = {tuple(r) for r in again.score(stored, keys).collect()}
        live = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "matrix"))
        monitoring.run_available(again.score(live, keys), f"{base}-out", f"{base}-ckpt")
        assert {tuple(r) for r in spark.read.parquet(f"{base}-out").collect()} == batch
        near = sorted(want), sorted(batch)
        assert len(want) == len(batch) and all(u[:2] == v[:2] and u[2] == pytest.approx(v[2], abs=1e-9) for u, v in zip(*near, strict=True))


def test_a_forest_finds_the_known_best_split(spark):
    rows = [(float(i), float(i % 7), 10.0 if i < 60 else 30.0) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, y double").withColumn("split", F.lit("train"))
    forest = ML.train(df, ["a", "b"], "y", ("random_forest",), depth=3)["random_forest"]
    assert forest.importance["a"] > 0.95
    got = ML.predict(forest, spark.createDataFrame([(30.0, 1.0, 0.0), (90.0, 1.0, 0.0)], "a double, b double, y double"), "y", ["a"]).collect()
    assert [r.prediction for r in sorted(got)] == pytest.approx([10.0, 30.0], abs=0.5)


def forest_rows(spark, x, y):
    from pyspark.ml.linalg import Vectors

    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y, strict=True)], ["features", "label"])


def forest_output(model, df):
    return np.array([r.prediction for r in model.transform(df).select("features", "prediction").collect()])


def test_unlimited_trees_are_not_grown_by_a_job_for_each_level(spark):
    """Nodes down to two rows used to be split by sums of all tasks, level by level; parts are now grown whole."""
    from airgrid.operators.forest import RandomForest

    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 4)).round(2)
    y = x[:, 0] * 3 + x[:, 1] * x[:, 2] + rng.normal(size=900)
    df, tracker = forest_rows(spark, x, y).persist(), spark.sparkContext.statusTracker()
    df.count()
    spark.sparkContext.setJobGroup("forest", "forest")
    whole = RandomForest(8, 30).fit(df)
    jobs = len(tracker.getJobIdsForGroup("forest"))
    spark.sparkContext.setJobGroup("", "")
    split = RandomForest(8, 30, part_rows=60).fit(df)
    assert jobs < 16 and split.parts.where("part >= 0").count() > 8 * 9
    one, other = forest_output(whole, df), forest_output(split, df)
    np.testing.assert_allclose(one, other, atol=1e-9)  # the same trees, however they are cut
    np.testing.assert_allclose(whole.featureImportances.toArray(), split.featureImportances.toArray(), atol=1e-9)
    assert 1 - ((one - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
    df.unpersist()


def test_a_grown_tree_has_the_best_cut_in_every_node():
    from airgrid.operators.forest import LEAF, grow, walk

    rng = np.random.default_rng(8)
    bins, y, w = rng.integers(0, 32, (300, 3)).astype(np.uint8), rng.normal(size=300).round(2), rng.integers(1, 4, 300)

    def naive(rows, depth):
        def squares(r):
            return float((w[r] * (y[r] - np.average(y[r], weights=w[r])) ** 2).sum())

        cuts = [(i, c) for i in range(3) for c in range(31) if 0 < (bins[rows, i] <= c).sum() < len(rows)]
        if depth == 0 or np.ptp(y[rows]) == 0 or not cuts:
            return {int(r): np.average(y[rows], weights=w[rows]) for r in rows}
        left = {k: bins[rows, k[0]] <= k[1] for k in cuts}
        i = min(cuts, key=lambda k: round(squares(rows[left[k]]) + squares(rows[~left[k]]), 9))
        return naive(rows[left[i]], depth - 1) | naive(rows[~left[i]], depth - 1)

    for depth in (0, 1, 4):
        feature, cut, value, _ = grow(bins, y, w, depth)
        want = naive(np.arange(300), depth)
        np.testing.assert_allclose(value[walk(feature, cut, bins)], [want[i] for i in range(300)], atol=1e-9)
    feature, cut, value, _ = grow(bins, y, w, 30)
    exact = value[walk(feature, cut, bins)]
    assert {len(np.unique(y[exact == v])) for v in np.unique(exact)} == {1} and (feature == LEAF).sum() > 100


def test_trees_see_rows_a_poisson_number_of_times():
    from airgrid.operators.forest import draws

    ids = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 20_000)
    for copies in (1, 3, 500):
        found = [draws(ids, np.full(20_000, copies), tree, 42, 100) for tree in (0, 1)]
        assert found[0].mean() == pytest.approx(copies, rel=0.05) and found[0].var() == pytest.approx(copies, rel=0.1)
        assert abs(np.corrcoef(found)[0, 1]) < 0.05
    assert (draws(ids, np.full(20_000, 2), 0, 42, 1) == 2).all()


def test_forests_of_odd_rows(spark):
    from airgrid.operators.forest import RandomForest

    same = forest_rows(spark, np.ones((50, 2)), np.arange(50) % 2)
    flat = RandomForest(5, 30, part_rows=1).fit(same)
    assert np.ptp(forest_output(flat, same)) == 0 and set(flat.featureImportances.toArray()) == {0.0}
    steady = forest_rows(spark, np.arange(40.0).reshape(20, 2), np.full(20, 7.5))
    assert forest_output(RandomForest(5, 30, part_rows=4).fit(steady), steady) == pytest.approx(7.5, abs=1e-12)
    with pytest.raises(ValueError, match="training rows"):
        RandomForest(5, 30).fit(steady.limit(0))
    with pytest.raises(Exception, match="finite"):
        RandomForest(5, 30).fit(steady.withColumn("label", F.lit(float("nan"))))


def test_a_tree_that_loses_features_is_the_one_grown_without_them():
    from airgrid.operators.forest import ShrinkingTree, grow

    rng = np.random.default_rng(9)
    bins, y, w = rng.integers(0, 32, (200, 9)).astype(np.uint8), rng.normal(size=200), rng.poisson(1, 200)
    tree, left = ShrinkingTree(bins, y, w, 30), list(range(9))
    for lost in ([4], [0], [8, 2], [1]):
        tree.drop(lost)
        left = [f for f in left if f not in lost]
        anew = ShrinkingTree(bins[:, left], y, w, 30).gains
        assert tree.gains[left].tolist() == anew.tolist() and not tree.gains[lost].any()
        np.testing.assert_allclose(anew, grow(bins[w > 0][:, left], y[w > 0], w[w > 0], 30)[3], rtol=1e-9)


def test_elimination_starts_from_all_features(spark, matrix, monkeypatch):
    """The query used to start from the twelve features with the best F scores."""
    from airgrid.operators import forest

    seen, grown = [], ML.eliminate
    monkeypatch.setattr(ML, "eliminate", lambda rows, *rest: seen.append(len(rows.first().x)) or grown(rows, *rest))
    got = ML.rfe_matrix(matrix, 3, trees=4)
    assert seen == [len(matrix.names)] and len(got) == 3 and set(got) < set(matrix.names)
    assert got == ML.rfe_matrix(matrix, 3, trees=4)
    monkeypatch.setattr(forest, "HELD_BYTES", 0)  # a forest for each step
    assert len(ML.rfe_matrix(matrix, len(matrix.names) - 2, trees=2)) == len(matrix.names) - 2


def test_rows_go_to_the_parts_of_a_large_forest(spark, monkeypatch, tmp_path):
    """The nodes of all trees used to be collected and broadcast at any size."""
    from airgrid.operators import forest

    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 3)).round(1)
    y = x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=700)
    df = forest_rows(spark, np.concatenate([x, x[:40]]), np.concatenate([y, y[:40]])).withColumn("place", F.monotonically_increasing_id()).persist()
    df.count()
    model = forest.RandomForest(6, 30, part_rows=80).fit(df)
    want = {r.place: r.prediction for r in model.transform(df).collect()}
    model.write().overwrite().save(str(tmp_path / "forest"))
    monkeypatch.setattr(forest, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)
    monkeypatch.setattr(forest, "MEET_ROWS", 50)
    again = forest.ForestModel.load(str(tmp_path / "forest"))
    got = again.transform(df)
    assert got.columns == [*df.columns, "prediction"]
    assert {r.place: r.prediction for r in got.collect()} == want and len(want) == 740
    assert "nodes" not in vars(again)
    assert again.transform(df.limit(0)).count() == 0
    df.unpersist()


def test_large_forests_score_streams_batch_by_batch(spark, matrix, tmp_path, monkeypatch):
    from airgrid.operators import forest

    monkeypatch.setattr(forest, "BROADCAST_BYTES", 0)
    run = ML.run_matrix_training(matrix, "y", ("random_forest",), k=3)
    keys, scorer = ["dataset_id", "time"], run.scorers["random_forest"]
    matrix.rows.select(*keys, "features").write.parquet(str(tmp_path / "matrix"))
    stored = spark.read.parquet(str(tmp_path / "matrix"))
    live = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "matrix"))
    with pytest.raises(ValueError, match="batch by batch"):
        scorer.score(live, keys)
    monitoring.run_available_batches(live, lambda batch: scorer.score(batch, keys), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in scorer.score(stored, keys).collect()} and got.count()


def test_infinite_inputs_become_unknown_features(spark):
    rows = [("p", f"2021-01-{d:02d}", float("inf") if d == 9 else float(d)) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "dataset_id string, day string, y double").select("dataset_id", F.to_timestamp("day").alias("time"), "y")
    plan = W.FeaturePlan("y", ("y",), lags=(1,), other_lags=(1,), sizes=(2,), steps=(1,))
    got = W.feature_matrix(df, plan).toPandas()
    assert np.isfinite(np.stack(got.features.to_numpy())).all() and np.abs(np.stack(got.features.to_numpy())).max() < 400
    assert pd.Timestamp("2021-01-09") not in set(got.time) and pd.Timestamp("2021-01-20") in set(got.time)


def test_scene_join_copies_no_scenes(spark):
    """The catalogue used to be copied once per shuffle partition, a table that the driver could broadcast."""
    from airgrid.operators.align import scene_join

    cells = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (None, 4.0)], "scene_id long, value double")
    scenes = spark.createDataFrame([(1,), (1,), (None,), (3,)], "id long")
    out = scene_join(cells, scenes, {"scene_id": "id"})
    assert sorted(r.value for r in out.collect()) == [1.0, 2.0, 4.0] and out.columns == cells.columns
    assert "explode" not in out._jdf.queryExecution().analyzed().toString()
