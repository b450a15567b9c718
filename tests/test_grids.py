"""Grid operators against plain numpy on small dense or holed grids."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.operators import align as L
from airgrid.operators import neighbourhood as N

NY, NX = 9, 12
SHAPE = (NY, NX)


def cube_of(spark, slices):
    rows = [
        ("d", "no2", dt.datetime(2023, 1, 1) + dt.timedelta(days=t), y, x, 33 + y / 8, 72 + x / 11, None if np.isnan(v) else float(v))
        for t, a in enumerate(slices)
        for (y, x), v in np.ndenumerate(a)
    ]
    return spark.createDataFrame(
        rows, "dataset_id string, variable string, time timestamp_ntz, y int, x int, lat double, lon double, value double"
    )


def grids_of(df, n=1, column="value"):
    pdf = df.toPandas()
    out = np.full((n, NY, NX), np.nan)
    day = (pd.to_datetime(pdf.time) - pd.Timestamp("2023-01-01")).dt.days
    out[day, pdf.y, pdf.x] = pdf[column].astype(float)
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(4).uniform(1, 9, (2, NY, NX))


@pytest.fixture(scope="module")
def cube(spark, image):
    return cube_of(spark, image).cache()


def blur(a, taps, mode):
    r = len(taps) // 2
    p = np.pad(a, r, mode=mode)
    rows = sum(t * p[i : i + a.shape[0], :] for i, t in enumerate(taps))
    return sum(t * rows[:, i : i + a.shape[1]] for i, t in enumerate(taps))


def test_gaussian(cube, image):
    taps = N.gaussian_taps(0.5, 2)
    got = grids_of(N.gaussian(cube, SHAPE), 2)
    np.testing.assert_allclose(got, [blur(a, taps, "symmetric") for a in image])


def test_unsharp_and_multiscale(cube, image):
    b = N.BINOMIAL5
    np.testing.assert_allclose(grids_of(N.unsharp(cube, SHAPE), 2), [1.5 * a - 0.5 * blur(a, b, "reflect") for a in image])
    levels = [image]
    for _ in range(3):
        levels.append(np.array([blur(a, b, "reflect") for a in levels[-1]]))
    want = levels[3] + sum((levels[i] - levels[i + 1]) * (1 + 0.2 * i / 3) for i in range(3))
    np.testing.assert_allclose(grids_of(N.multiscale(cube, SHAPE), 2), want)


def test_median(cube, image):
    p = np.pad(image[0], 1, mode="symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).reshape(NY, NX, 9)
    np.testing.assert_allclose(grids_of(N.median3(cube, SHAPE), 2)[0], np.median(windows, axis=-1))


def test_nulls_propagate_or_are_skipped(spark):
    a = np.ones((NY, NX))
    a[4, 4] = np.nan
    holed = cube_of(spark, [a])
    strict = grids_of(N.gaussian(holed, SHAPE))[0]
    assert np.isnan(strict[2:7, 2:7]).all() and np.isnan(strict).sum() == 25
    np.testing.assert_allclose(grids_of(N.gaussian(holed, SHAPE, nulls="skip"))[0], 1.0)


@pytest.mark.parametrize("tile", [4, 64])
def test_tiles_do_not_show(cube, image, tile):
    taps = N.gaussian_taps(2.0, 3)
    got = grids_of(N.tile_map(cube, N.blur_tile(taps), 3, SHAPE, "mirror", tile), 2)
    np.testing.assert_allclose(got, [blur(a, taps, "reflect") for a in image])


def test_haze_with_a_window_larger_than_the_grid(cube, image):
    background = [blur(a, N.gaussian_taps(N.SIGMA51, 25), "reflect") for a in image]
    got = grids_of(N.haze_remove(cube, SHAPE), 2)
    np.testing.assert_allclose(got, np.maximum(image - 0.5 * np.array(background), 0))


def test_bilateral(cube, image):
    lo, hi = image.min(), image.max()
    a = np.floor((image[1] - lo) / (hi - lo) * 255)
    p, out = np.pad(a, 4, mode="reflect"), np.zeros((NY, NX))
    for y in range(NY):
        for x in range(NX):
            total = weight = 0.0
            for dy in range(-4, 5):
                for dx in range(-4, 5):
                    if dy * dy + dx * dx <= 16:
                        v = p[y + 4 + dy, x + 4 + dx]
                        w = math.exp(-(dy * dy + dx * dx) / (2 * 75**2)) * math.exp(-((v - a[y, x]) ** 2) / (2 * 75**2))
                        total, weight = total + w * v, weight + w
            out[y, x] = round(total / weight)
    np.testing.assert_allclose(grids_of(N.bilateral(cube, SHAPE), 2)[1], out / 255 * (hi - lo) + lo)


def test_gradient_and_sobel(cube, image):
    out = N.gradient(cube, SHAPE)
    gy, gx = np.gradient(image[0])
    np.testing.assert_allclose(grids_of(out, 2, "grad_y")[0], gy)
    np.testing.assert_allclose(grids_of(out, 2, "gradient")[0], np.hypot(gy, gx))
    p = np.pad(image[0], 1, mode="symmetric")
    h = sum(N.SOBEL_H[i][j] * p[i : i + NY, j : j + NX] for i in range(3) for j in range(3))
    np.testing.assert_allclose(grids_of(N.sobel(cube, SHAPE), 2, "sobel_h")[0], h, atol=1e-12)


def test_local_variance_has_no_value_at_the_border(cube, image):
    got = grids_of(N.local_variance(cube, SHAPE), 2, "local_variance")[0]
    want = np.lib.stride_tricks.sliding_window_view(image[0], (3, 3)).reshape(NY - 2, NX - 2, 9).var(axis=-1)
    np.testing.assert_allclose(got[1:-1, 1:-1], want)
    assert np.isnan(got[0]).all() and np.isnan(got[:, -1]).all()


def test_morans_i(spark):
    y, x = np.mgrid[0:NY, 0:NX]
    smooth = N.morans_i(cube_of(spark, [y + x]), SHAPE).first().morans_i
    board = N.morans_i(cube_of(spark, [(y + x) % 2.0]), SHAPE).first().morans_i
    assert smooth > 0.9 and abs(board) < 0.2
    assert N.morans_i(cube_of(spark, [np.ones((NY, NX))]), SHAPE).first().morans_i == 0.0


def test_dos_and_stretch_ranges(cube):
    assert grids_of(N.dos_correct(cube), 2).min() == 0
    s = grids_of(N.contrast_stretch(cube), 2)
    assert s.min() == 0 and s.max() == 1


def test_hist_equalize(cube, image):
    got = grids_of(N.hist_equalize(cube), 2)[0]
    hist, edges = np.histogram(image[0], bins=256)
    cdf = hist.cumsum()
    want = np.interp(image[0], edges[:-1], (cdf - cdf.min()) / (cdf.max() - cdf.min()))
    np.testing.assert_allclose(got, want, atol=1e-9)


def clahe_numpy(v8, clip_limit, tiles):
    ny, nx = v8.shape
    th, tw = -(-ny // tiles), -(-nx // tiles)
    p = np.pad(v8, ((0, th * tiles - ny), (0, tw * tiles - nx)), mode="reflect")
    area = th * tw
    clip = max(int(clip_limit * area / 256), 1)
    luts = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(hist - clip, 0).sum())
            hist = np.minimum(hist, clip) + excess // 256
            left = excess % 256
            if left:
                step, at = max(256 // left, 1), 0
                while at < 256 and left > 0:
                    hist[at] += 1
                    at, left = at + step, left - 1
            luts[i, j] = np.rint(np.cumsum(hist) * 255.0 / area)
    out = np.zeros((ny, nx))
    for y in range(ny):
        for x in range(nx):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y1, x1 = math.floor(fy), math.floor(fx)
            a, b = fy - y1, fx - x1
            t = lambda i, j: luts[min(max(i, 0), tiles - 1), min(max(j, 0), tiles - 1), v8[y, x]]  # noqa: B023, E731
            top = t(y1, x1) * (1 - b) + t(y1, x1 + 1) * b
            low = t(y1 + 1, x1) * (1 - b) + t(y1 + 1, x1 + 1) * b
            out[y, x] = np.rint(top * (1 - a) + low * a)
    return out


@pytest.mark.parametrize("tiles", [2, 4])
def test_clahe(cube, image, tiles):
    lo, hi = image.min(), image.max()
    v8 = np.floor((image[0] - lo) / (hi - lo) * 255).astype(int)
    got = grids_of(N.clahe(cube, SHAPE, 40.0, tiles), 2)[0]
    np.testing.assert_allclose(got, clahe_numpy(v8, 40.0, tiles) / 255 * (hi - lo) + lo)


def test_adaptive_equalization_stays_in_unit_range(cube):
    out = grids_of(N.adaptive_equalize(cube, SHAPE), 2)
    assert out.min() >= 0 and out.max() <= 1


@pytest.mark.parametrize("k", [1, 2, 10])
def test_pca_denoise(spark, k):
    a = np.random.default_rng(8).normal(size=(5, NY, NX))
    a[2, 3, 3] = np.nan
    got = grids_of(N.pca_denoise(cube_of(spark, a), k), 5)
    flat = a.reshape(5, -1)
    mean = np.nanmean(flat, axis=0)
    x = np.where(np.isnan(flat), mean, flat) - mean
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    want = (u[:, :k] * s[:k]) @ vt[:k] + mean
    want[np.isnan(flat)] = np.nan
    np.testing.assert_allclose(got.reshape(5, -1), want, atol=1e-9)


def test_fusing_identical_cubes_changes_nothing(cube, image):
    np.testing.assert_allclose(grids_of(L.fuse_weighted([cube, cube]), 2), image)


def test_resampling_to_the_same_grid_changes_nothing(cube, image):
    box = {"south": 33.0, "north": 34.0, "west": 72.0, "east": 73.0}
    np.testing.assert_allclose(grids_of(L.resample_to(cube, box, SHAPE, SHAPE), 2), image)


def test_reprojection_of_a_plane_stays_a_plane(spark):
    y, x = np.mgrid[0:NY, 0:NX]
    plane = cube_of(spark, [2 * y + 3.0 * x])
    box = {"south": 33.0, "north": 34.0, "west": 72.0, "east": 73.0}
    out = L.reproject(plane, box, SHAPE, 43, 10_000.0).toPandas().dropna()
    want = 2 * (out.lat - 33) * (NY - 1) + 3 * (out.lon - 72) * (NX - 1)
    assert len(out) > 50
    np.testing.assert_allclose(out.value, want, atol=1e-6)


def test_utm_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(33.6844, 73.0479), (-12.5, 71.2), (0.0, 75.0)], "lat double, lon double")
    zone = geo.utm_zone(F.col("lon"))
    e, n = geo.to_utm(F.col("lat"), F.col("lon"), zone)
    rows = df.withColumns({"zone": zone, "e": e, "n": n})
    lat, lon = geo.from_utm(F.col("e"), F.col("n"), F.col("zone"))
    lat_s, lon_s = geo.from_utm(F.col("e"), F.col("n"), F.col("zone"), northern=False)
    back = rows.withColumns({"lat2": F.when(F.col("lat") < 0, lat_s).otherwise(lat), "lon2": F.when(F.col("lat") < 0, lon_s).otherwise(lon)}).toPandas()
    np.testing.assert_allclose(back.lat2, back.lat, atol=1e-9)
    np.testing.assert_allclose(back.lon2, back.lon, atol=1e-9)
    on_meridian = back.iloc[2]
    assert on_meridian.e == pytest.approx(500000.0) and on_meridian.n == pytest.approx(0.0, abs=1e-6)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_chains_of_windows_need_one_exchange(cube):
    for df in (N.gaussian(cube, SHAPE), N.median3(cube, SHAPE), N.unsharp(cube, SHAPE), N.multiscale(cube, SHAPE)):
        assert exchanges(df) == 1


@pytest.mark.parametrize("nulls", ["propagate", "skip"])
def test_multiscale_equals_its_chain_of_blurs(spark, nulls, monkeypatch):
    """Tiles of 8 and few dense cells at once, so that halos, borders and batches meet; some cells absent or null."""
    rng, shape = np.random.default_rng(7), (21, 19)
    rows = [
        (d, "v", dt.datetime(2020, 1, t), y, x, None if rng.random() < 0.02 else float(rng.normal()))
        for d in ("a", None) for t in (1, 2) for y in range(21) for x in range(19) if rng.random() > 0.02
    ]
    small = spark.createDataFrame(rows, "dataset_id string, variable string, time timestamp_ntz, y int, x int, value double")
    monkeypatch.setattr(N, "TILE", 8)
    monkeypatch.setattr(N, "STACK", 1_000)
    kernel, want = N.outer(N.BINOMIAL5, N.BINOMIAL5), small.withColumn("_g0", F.col("value"))
    for i in (1, 2, 3):
        want = N.convolve(want, kernel, shape, "mirror", nulls, value=f"_g{i - 1}", out=f"_g{i}")
    g = [F.col(f"_g{i}") for i in range(4)]
    want = want.withColumn("want", g[3] + (g[0] - g[1]) + (g[1] - g[2]) * (1 + 0.2 / 3) + (g[2] - g[3]) * (1 + 0.4 / 3))
    place = ["dataset_id", "time", "y", "x"]
    key = lambda r: tuple(str(r[c]) for c in place)
    expected = {key(r): r.want for r in want.collect()}
    got = {key(r): r.value for r in N.multiscale(small, shape, nulls=nulls).collect()}
    assert len(got) == len(rows) and got.keys() == expected.keys()
    assert all((got[k] is None) == (expected[k] is None) for k in got)
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got if got[k] is not None)
    assert any(v is not None for v in got.values())


def analysed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_tables_of_slices_are_not_copied(cube):
    """Only the range of a whole variable is copied over salts, never a table with a row per slice, bin or level."""
    for out, copied in ((N.hist_equalize(cube), 0), (N.clahe(cube, SHAPE), 1), (N.adaptive_equalize(cube, SHAPE), 0)):
        plan = analysed(out)
        assert plan.count("Generate explode(_ty") == 0 and plan.count("posexplode") == 0
        copies = [line for line in plan.splitlines() if "Generate explode(sequence(0, " in line]
        # clahe reads its ranged rows twice: for the histograms and for the cells
        assert len(copies) == 2 * copied


def test_hist_equalize_keeps_null_and_constant_slices(spark):
    cube = cube_of(spark, [np.full((NY, NX), 3.0), np.where(np.eye(NY, NX) > 0, np.nan, np.arange(NY * NX).reshape(NY, NX))])
    got = grids_of(N.hist_equalize(cube), 2)
    assert np.isnan(np.diagonal(got[1])).all() and np.isfinite(got[1]).sum() == NY * NX - NY
    assert not np.isfinite(got[0]).any() or (got[0] >= 0).all()


def test_clahe_with_gaps_and_odd_tiles(spark, image):
    holes = image.copy()
    holes[0, :4, :5] = np.nan  # whole tiles without a valid cell
    cube = cube_of(spark, holes)
    got = grids_of(N.adaptive_equalize(cube, SHAPE), 2)
    assert np.isnan(got[0, :4, :5]).all() and np.isfinite(got).sum() == 2 * NY * NX - 20
    nulls = cube.withColumn("dataset_id", F.lit(None).cast("string"))
    assert sorted(r.value for r in N.clahe(nulls.where("value IS NOT NULL"), SHAPE).collect()) == sorted(holes[np.isfinite(holes)].tolist())


@pytest.mark.parametrize(("border", "pad"), [("symmetric", "symmetric"), ("mirror", "reflect"), (None, "constant")])
@pytest.mark.parametrize(("halo", "tile"), [(1, 64), (3, 4), (11, 5)])
def test_stencils_send_a_cell_once_to_a_tile(cube, image, border, pad, halo, tile):
    def fn(dense, present):
        windows = np.lib.stride_tricks.sliding_window_view(dense, (2 * halo + 1, 2 * halo + 1), axis=(1, 2))
        return {"value": np.nansum(windows * np.arange(1, 2 * halo + 2), axis=(-2, -1))}

    out = N.stencils(cube, fn, ["value"], halo, SHAPE, border, tile)
    with_edge = np.pad(image[1], halo, mode=pad)
    want = (np.lib.stride_tricks.sliding_window_view(with_edge, (2 * halo + 1,) * 2) * np.arange(1, 2 * halo + 2)).sum((-2, -1))
    np.testing.assert_allclose(grids_of(out, 2)[1], want)
    # repeated cells of a border used to be rows of their own
    assert "_py" not in analysed(out)


def test_tables_with_many_rows_are_joined_without_copies(spark, monkeypatch):
    from airgrid import core

    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "k string, v int")
    table = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "k string, w int")
    monkeypatch.setattr(core, "BROADCAST_ROWS", 2)
    for how, n in (("inner", 3), ("left", 4)):
        out = core.lookup(rows, table, ["k"], how)
        assert "explode" not in analysed(out)
        assert sorted((r.v, r.w or 0) for r in out.collect()) == [(1, 10), (2, 20), (3, 30), (4, 0)][:n]


def test_pca_sums_one_matrix_a_tile(spark, monkeypatch):
    # cells spread over all tasks made a slices-by-slices matrix each; rows whose place is null or repeats stay
    a = np.random.default_rng(9).normal(size=(6, NY, NX))
    made = []
    monkeypatch.setattr("airgrid.core.materialize", lambda df: made.append(df) or df)
    df = cube_of(spark, a).repartition(40)
    got = grids_of(N.pca_denoise(df, 6), 6)
    np.testing.assert_allclose(got, a, atol=1e-9)
    assert [m.count() for m in made if "_g" in m.columns] == [6]
    monkeypatch.undo()
    odd = df.limit(1).withColumn("y", F.lit(None).cast("int"))
    twice = df.where("y = 0 and x = 0 and day(time) = 1")
    out = N.pca_denoise(df.unionByName(odd).unionByName(twice), 2)
    assert out.where("y is null").collect()[0].value is None and out.where("y = 0 and x = 0 and day(time) = 1").count() == 4


def test_neighbours_meet_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 4)
    a = np.random.default_rng(10).uniform(1, 9, (2, NY, NX))
    a[0, 4, 4] = np.nan
    df = cube_of(spark, a).where("not (y = 5 and x = 3)")
    df = df.unionByName(df.where("y = 3 and x = 7")).unionByName(df.limit(3).withColumn("variable", F.lit(None).cast("string")))
    got = N.neighbour_join(df, N.RING)
    near = df.select("dataset_id", "variable", "time", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("value").alias("neighbour"))
    want = df.join(near, ["dataset_id", "variable", "time"]).withColumns({"dy": F.col("ny") - F.col("y"), "dx": F.col("nx") - F.col("x")})
    want = want.where("abs(dy) <= 1 and abs(dx) <= 1 and (dy <> 0 or dx <> 0)").select(*got.columns)
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(got) == rows(want)
    # the cells travel once to a tile, not eight times
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
