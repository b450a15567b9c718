"""Grid neighbourhood operators, per slice (keys + time).

Two mechanisms serve them all:

* ``stencils`` hands bounded tiles with a halo to a vectorised function, one exchange for any chain of windows
  (kernels, medians, bilateral weights, the 51 x 51 blur);
* ``spread`` sends every cell to the cells whose 3 x 3 window contains it and lets an aggregation combine
  the contributions, for neighbour statistics that are aggregates anyway.  Cells are first brought together by
  tile, so that the partial aggregation folds nearly all contributions before the second shuffle.

The grid size is part of the operator's arguments, never derived from the observed cells.  Border
rules are index arithmetic: ``symmetric`` repeats the edge cell, ``mirror`` does not, ``None`` leaves
the outside empty.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid import KEYS
from airgrid.core import attach, by, exact_quantiles, ratio, running, same_keys
from airgrid.functions.levels import value_bucket
from airgrid.functions.scaling import from_8bit, to_8bit, with_range
from airgrid.operators.aggregates import merge_on, time_mean, with_bins
from airgrid.operators.isolation import count_below
from airgrid.operators.slicing import stride_sample

TILE = 64
#: side of a tile whose cells' whole histories one task holds
HISTORY_TILE = 32
#: dense cells that a task works on at once
STACK = 1 << 20
Shape = tuple[int, int]

# fixed values: 5-tap Gaussian of the image library's size rule, and its sigma for 51 taps
BINOMIAL5 = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
SIGMA51 = 0.3 * ((51 - 1) * 0.5 - 1) + 0.8
SOBEL_H = ((0.25, 0.5, 0.25), (0.0, 0.0, 0.0), (-0.25, -0.5, -0.25))
SOBEL_V = tuple(zip(*SOBEL_H, strict=True))


def gaussian_taps(sigma: float, radius: int) -> list[float]:
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def outer(a: Sequence[float], b: Sequence[float]) -> list[list[float]]:
    return [[p * q for q in b] for p in a]


def _positions(s: Column, n: int, reach: int, border: str | None) -> Column:
    """All padded positions in [-reach, n + reach) that show source index ``s``."""
    if border is None or n == 1:
        spots = [s]
    else:
        period, flip = (2 * n, -1 - s) if border == "symmetric" else (2 * (n - 1), -s)
        turns = range(-(reach // period) - 1, reach // period + 2)
        spots = [base + k * period for k in turns for base in (s, flip)]
    return F.filter(F.array_distinct(F.array(*spots)), lambda p: (p >= -reach) & (p < n + reach))


def _tiles_at(halo: int, tile: int, last: int) -> Callable[[Column], Column]:
    """The tiles whose halo holds a padded position."""

    def tiles(p: Column) -> Column:
        lo, hi = F.greatest(F.floor((p - halo) / tile), F.lit(0)), F.least(F.floor((p + halo) / tile), F.lit(last))
        return F.sequence(lo.cast("int"), hi.cast("int"))

    return tiles


def by_tile(cube: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Co-locate the cells of a tile; a tile is bounded, so no slice or key fills one task."""
    return cube.repartition(*keys, time, F.floor(F.col("y") / TILE), F.floor(F.col("x") / TILE))


def spread(
    cube: DataFrame, radius: int, shape: Shape, border: str | None = "symmetric", keys: Sequence[str] = KEYS, time: str = "time",
) -> DataFrame:
    """One row per cell and window that holds it: the window's ``y, x``, the offset ``dy, dx``, the cell's columns."""
    out = by_tile(cube, keys, time)
    for axis, n in (("y", shape[0]), ("x", shape[1])):
        out = out.withColumn("_p", F.explode(_positions(F.col(axis), n, radius, border)))
        lo, hi = F.greatest(F.col("_p") - radius, F.lit(0)), F.least(F.col("_p") + radius, F.lit(n - 1))
        out = out.withColumn(axis, F.explode(F.sequence(lo, hi)))
        out = out.withColumn(f"d{axis}", F.col("_p") - F.col(axis)).drop("_p")
    return out


def centre(column: str) -> Column:
    """The window's own cell among the spread rows."""
    return F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col(column)))


def gather(
    cube: DataFrame, radius: int, shape: Shape, border: str | None, results: Mapping[str, Column], keys: Sequence[str] = KEYS,
    time: str = "time", value: str = "value",
) -> DataFrame:
    """Aggregate each window; only windows around an existing cell remain, with that cell's columns."""
    rest = [c for c in cube.columns if c not in (*keys, time, "y", "x")]
    rows = spread(cube, radius, shape, border, keys, time)
    own = F.max((F.col("dy") == 0) & (F.col("dx") == 0))
    named = [c.alias(f"_r_{n}") for n, c in results.items()]
    out = rows.groupBy(*keys, time, "y", "x").agg(*[centre(c).alias(c) for c in rest], own.alias("_own"), *named)
    out = out.where("_own").drop("_own")
    return out.withColumns({n: F.col(f"_r_{n}") for n in results}).drop(*[f"_r_{n}" for n in results])


def weighted(kernel: Sequence[Sequence[float]], value: str = "value") -> Column:
    """Kernel sum over a window with all its cells, for ``gather``."""
    size = len(kernel)
    r = size // 2
    flat = F.array(*[F.lit(float(w)) for row in kernel for w in row])
    w = F.get(flat, (F.col("dy") + r) * size + F.col("dx") + r)
    return F.when(F.count(value) == size * size, F.sum(w * F.col(value)))


def whole_tiles(
    rows: DataFrame, worked: Callable[[pa.Table, np.ndarray], Iterable[pa.Table]], step: int, kinds: T.StructType,
    keys: Sequence[str], time: str,
) -> DataFrame:
    """What ``worked`` makes of the rows of ``step`` tiles (``keys, time, _ty, _tx``) and their tiles' numbers.

    A task sorts its rows by tile and streams through them.
    """
    # two hashes name a tile; they take note of nulls, which hashes skip
    named = [*keys, time, "_ty", "_tx", *[F.col(k).isNull() for k in (*keys, time)]]
    rows = rows.withColumns({"_g": F.xxhash64(*named), "_h": F.hash(*named)})
    rows = rows.repartition(*keys, time, "_ty", "_tx").sortWithinPartitions("_g", "_h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            held = [t for t in (rest, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
            if not held or not (table := pa.concat_tables(held)).num_rows:
                continue
            g, k = table["_g"].to_numpy(), table["_h"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
            # the last tile may go on in the next batch
            ends = np.r_[starts[1:], len(g)] if batch is None else starts[1:]
            rest = table.slice(ends[-1] if len(ends) else 0)
            for i in range(0, len(ends), step):
                begin, end = starts[i], ends[min(i + step, len(ends)) - 1]
                number = np.searchsorted(starts[i : i + step], np.arange(begin, end), "right") - 1
                for made in worked(table.slice(begin, end - begin), number):
                    yield from made.to_batches()

    return rows.mapInArrow(run, kinds)


def stencils(
    cube: DataFrame, fn: Callable[[np.ndarray, np.ndarray], Mapping[str, np.ndarray]], outputs: Sequence[str], halo: int, shape: Shape,
    border: str | None = "mirror", tile: int = TILE, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value",
) -> DataFrame:
    """Columns worked out from the tile around each cell, with one exchange for all of them.

    ``fn`` receives a stack of dense tiles with their halo (NaN where there is no value) and one that says
    where there is a cell; it returns stacks of the tiles alone, one per name in ``outputs``.  A cell is sent to
    the tiles whose halo holds it, so a chain of windows needs the sum of their radii as its halo.
    Tiles have a fixed size, whatever the slice; a task sorts its cells by tile and streams through them, so that
    it holds a batch of rows and at most ``STACK`` dense cells, or one tile.  NaN becomes null.
    """
    rows = cube.withColumn("_v", F.col(value).cast("double"))
    for axis, n in (("y", shape[0]), ("x", shape[1])):
        served = F.transform(_positions(F.col(axis), n, halo, border), _tiles_at(halo, tile, (n - 1) // tile))
        rows = rows.withColumn(f"_t{axis}", F.explode(F.array_distinct(F.flatten(served))))
    columns = [c for c in cube.columns if c not in outputs]
    h, w = min(tile, shape[0]), min(tile, shape[1])
    height, width = h + 2 * halo, w + 2 * halo

    def sources(t: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tile the first grid index it needs, and where after that each of its positions takes its value from;
        positions that show nothing take it from the place after the last."""
        p = t[:, None] * tile - halo + np.arange(length)
        if border is None or n == 1:
            shown, at = (p >= 0) & (p < n), p
        else:
            period = 2 * n if border == "symmetric" else 2 * (n - 1)
            shown, at = p < n + halo, p % period
            at = np.where(at < n, at, (period - 1 if border == "symmetric" else period) - at)
        first = np.where(shown, at, n).min(axis=1)
        at = at - first[:, None]
        return first, np.where(shown, at, np.where(shown, at, 0).max() + 1)

    def worked(table: pa.Table, number: np.ndarray) -> pa.Table:
        y, x, ty, tx, v = (table[c].to_numpy() for c in ("y", "x", "_ty", "_tx", "_v"))
        head = np.flatnonzero(np.diff(number, prepend=-1))
        (top, rows), (left, cols) = sources(ty[head], shape[0], height), sources(tx[head], shape[1], width)
        cells = np.full((len(head), rows.max() + 2, cols.max() + 2), np.nan)
        there = np.zeros(cells.shape, bool)
        at, to = y - top[number], x - left[number]
        reach = (at >= 0) & (at < cells.shape[1]) & (to >= 0) & (to < cells.shape[2])
        place = (number[reach], at[reach], to[reach])
        cells[place], there[place] = v[reach], True
        # border rules repeat cells here, not on their way
        spread_out = (np.arange(len(head))[:, None, None], rows[:, :, None], cols[:, None, :])
        found = fn(cells[spread_out], there[spread_out])
        own = (y // tile == ty) & (x // tile == tx)
        core = table.filter(pa.array(own)).select(columns)
        place = (number[own], (y - ty * tile)[own], (x - tx * tile)[own])
        for name in outputs:
            core = core.append_column(name, pa.array(found[name][place], pa.float64()))
        return core

    kinds = T.StructType([cube.schema[c] for c in columns] + [T.StructField(n, T.DoubleType()) for n in outputs])
    result = whole_tiles(rows, lambda table, number: [worked(table, number)], max(1, STACK // (height * width)), kinds, keys, time)
    order = [*cube.columns, *[n for n in outputs if n not in cube.columns]]
    return result.withColumns({n: F.nanvl(F.col(n), F.lit(None)) for n in outputs}).select(*order)


def correlated(dense: np.ndarray, kernel: Sequence[Sequence[float]], nulls: str) -> np.ndarray:
    """Kernel sums over the windows inside the tiles of ``dense``; ``propagate`` needs every cell, ``skip`` renormalises over the valid ones."""
    size = len(kernel)
    h, w = dense.shape[1] - size + 1, dense.shape[2] - size + 1
    valid = ~np.isnan(dense)
    held = dense if nulls == "propagate" else np.where(valid, dense, 0.0)
    total, weight = np.zeros((len(dense), h, w)), np.zeros((len(dense), h, w))
    for i, row in enumerate(kernel):
        for j, k in enumerate(row):
            total += k * held[:, i : i + h, j : j + w]
            if nulls != "propagate":
                weight += k * valid[:, i : i + h, j : j + w]
    if nulls == "propagate":
        return total
    return np.where(weight != 0, total / np.where(weight != 0, weight, 1.0), np.nan)


def convolve(
    cube: DataFrame, kernel: Sequence[Sequence[float]], shape: Shape, border: str = "symmetric", nulls: str = "propagate",
    keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", out: str | None = None,
) -> DataFrame:
    name = out or value
    fn = lambda dense, present: {name: correlated(dense, kernel, nulls)}
    return stencils(cube, fn, [name], len(kernel) // 2, shape, border, TILE, keys, time, value)


def neighbour_join(
    cube: DataFrame, offsets: Sequence[tuple[int, int]], keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Every cell with each of its existing neighbours.

    A cell is sent once to each tile whose halo holds it, and meets its neighbours there by their places; rows
    that repeat a cell all meet.  A null key, time or place has no neighbours.
    """
    columns = [*keys, time, "y", "x", value]
    halo = max((abs(d) for o in offsets for d in o), default=0)
    rows = cube.select(*columns).dropna(subset=[*keys, time, "y", "x"])
    for axis in ("y", "x"):
        first, last = (F.floor((F.col(axis) + d) / TILE) for d in (-halo, halo))
        rows = rows.withColumn(f"_t{axis}", F.explode(F.sequence(first, last)))
    width = TILE + 2 * halo

    def worked(table: pa.Table, number: np.ndarray) -> Iterable[pa.Table]:
        y, x, ty, tx = (table[c].to_numpy().astype(np.int64) for c in ("y", "x", "_ty", "_tx"))
        place = (number * width + y - ty * TILE + halo) * width + x - tx * TILE + halo
        order = np.argsort(place, kind="stable")
        own = np.flatnonzero((y // TILE == ty) & (x // TILE == tx))
        base, values = table.select(columns), table[value].combine_chunks()
        for dy, dx in offsets:
            target = place[own] + dy * width + dx
            low, high = (np.searchsorted(place, target, side, sorter=order) for side in ("left", "right"))
            met = high - low
            at = np.repeat(low - np.cumsum(met) + met, met) + np.arange(met.sum())
            out = base.take(pa.array(np.repeat(own, met)))
            for name, d in (("dy", dy), ("dx", dx)):
                out = out.append_column(name, pa.array(np.full(len(at), d, dtype=np.int32)))
            yield out.append_column("neighbour", values.take(pa.array(order[at])))

    kinds = [rows.schema[c] for c in columns] + [T.StructField(n, T.IntegerType()) for n in ("dy", "dx")]
    kinds = T.StructType([*kinds, T.StructField("neighbour", rows.schema[value].dataType)])
    return whole_tiles(rows, worked, max(1, STACK // width**2), kinds, keys, time)


RING = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


# ------------------------------------------------------------------ corrections and filters


def dos_correct(cube: DataFrame, percentile: float = 1.0, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Subtract the dark-object percentile of each slice and clamp at zero."""
    dark = exact_quantiles(cube, [*keys, time], value, {"_dark": percentile / 100.0})
    rows, v = same_keys(cube, dark, [*keys, time], "left"), F.col(value)
    return rows.withColumn(value, F.when(v.isNotNull(), F.greatest(v - F.col("_dark"), F.lit(0.0)))).drop("_dark")


def gaussian(
    cube: DataFrame, shape: Shape, kernel_size: int = 3, nulls: str = "propagate", keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    size = kernel_size if kernel_size % 2 else kernel_size + 1
    sigma = size / 6.0
    taps = gaussian_taps(sigma, int(4.0 * sigma + 0.5))
    return convolve(cube, outer(taps, taps), shape, "symmetric", nulls, keys, time, value)


def median3(
    cube: DataFrame, shape: Shape, nulls: str = "propagate", keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """3 x 3 median; ``propagate`` needs all nine cells."""

    def fn(dense: np.ndarray, present: np.ndarray) -> dict[str, np.ndarray]:
        h, w = dense.shape[1] - 2, dense.shape[2] - 2
        stack = np.sort(np.stack([dense[:, i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)  # NaN last
        n = 9 - np.isnan(stack).sum(axis=0)
        low, high = (np.take_along_axis(stack, k[None], axis=0)[0] for k in (np.maximum(n - 1, 0) // 2, n // 2 % 9))
        return {value: np.where(n == 9, stack[4], np.nan) if nulls == "propagate" else (low + high) / 2}

    return stencils(cube, fn, [value], 1, shape, "symmetric", TILE, keys, time, value)


def tile_map(
    cube: DataFrame, fn: Callable[[np.ndarray], np.ndarray], halo: int, shape: Shape, border: str | None = "mirror", tile: int = TILE,
    keys: Sequence[str] = KEYS, time: str = "time", value: str = "value",
) -> DataFrame:
    """Replace ``value`` by ``fn`` of the dense tile around it (see ``stencils``)."""
    return stencils(cube, lambda dense, present: {value: np.stack([fn(t) for t in dense])}, [value], halo, shape, border, tile, keys, time, value)


def blur_tile(taps: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    """Separable blur of a tile with halo; windows with a missing cell use the cells they have."""
    k = np.asarray(taps)

    def along(a: np.ndarray) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(a, len(k), axis=0)
        return np.tensordot(windows, k, axes=([-1], [0]))

    def fn(dense: np.ndarray) -> np.ndarray:
        valid = ~np.isnan(dense)
        total = along(along(np.where(valid, dense, 0.0)).T).T
        weight = along(along(valid.astype(float)).T).T
        return np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), np.nan)

    return fn


def haze_background(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """51 x 51 Gaussian of each slice."""
    return tile_map(cube, blur_tile(gaussian_taps(SIGMA51, 25)), 25, shape, "mirror", 128, keys, time, value)


def haze_remove(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Half of the blurred background off, clamped at zero."""
    copy = cube.withColumn("_raw", F.col(value))
    out, v = haze_background(copy, shape, keys, time, value), F.col("_raw")
    return out.withColumn(value, F.when(v.isNotNull(), F.greatest(v - 0.5 * F.col(value), F.lit(0.0)))).drop("_raw")


def combined_correct(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    return haze_remove(dos_correct(cube, keys=keys, time=time, value=value), shape, keys, time, value)


def bilateral_tile(d: int, sigma_color: float, sigma_space: float, quantize: bool) -> Callable[[np.ndarray], np.ndarray]:
    r = d // 2

    def fn(dense: np.ndarray) -> np.ndarray:
        h, w = dense.shape[0] - 2 * r, dense.shape[1] - 2 * r
        mid = dense[r : r + h, r : r + w]
        total, weight = np.zeros((h, w)), np.zeros((h, w))
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                if dy * dy + dx * dx > r * r:
                    continue
                other = dense[r + dy : r + dy + h, r + dx : r + dx + w]
                k = math.exp(-0.5 * (dy * dy + dx * dx) / sigma_space**2) * np.exp(-0.5 * ((other - mid) / sigma_color) ** 2)
                ok = ~np.isnan(k)
                total += np.where(ok, k * other, 0.0)
                weight += np.where(ok, k, 0.0)
        out = np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), np.nan)
        return np.rint(out) if quantize else out

    return fn


def bilateral(
    cube: DataFrame, shape: Shape, d: int = 9, sigma_color: float = 75.0, sigma_space: float = 75.0, quantize: bool = True,
    keys: Sequence[str] = KEYS, time: str = "time", value: str = "value",
) -> DataFrame:
    """Edge-preserving filter on values scaled to 0..255 by the whole variable's range, scaled back after.

    ``quantize`` keeps the 256 integer levels of an 8-bit image on input and output.  A constant
    variable and null cells stay as they are.
    """
    lo, hi, v = F.col("_min"), F.col("_max"), F.col(value)
    scaled = to_8bit(v, lo, hi).cast("double") if quantize else F.when(hi > lo, (v - lo) / (hi - lo) * 255)
    rows = with_range(cube, keys, value).withColumn("_raw", v).withColumn(value, scaled)
    out = tile_map(rows, bilateral_tile(d, sigma_color, sigma_space, quantize), d // 2, shape, "mirror", TILE, keys, time, value)
    back = F.when(hi > lo, from_8bit(v, lo, hi)).otherwise(F.col("_raw"))
    return out.withColumn(value, F.when(F.col("_raw").isNotNull(), back)).drop("_raw", "_min", "_max")


def unsharp(cube: DataFrame, shape: Shape, nulls: str = "propagate", keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    out = convolve(cube, outer(BINOMIAL5, BINOMIAL5), shape, "mirror", nulls, keys, time, value, out="_blur")
    return out.withColumn(value, 1.5 * F.col(value) - 0.5 * F.col("_blur")).drop("_blur")


def multiscale(
    cube: DataFrame, shape: Shape, levels: int = 4, nulls: str = "propagate", keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Stack of repeated blurs; each difference of neighbouring levels is amplified a little more."""
    kernel, reach = outer(BINOMIAL5, BINOMIAL5), 2 * (levels - 1)

    def fn(dense: np.ndarray, present: np.ndarray) -> dict[str, np.ndarray]:
        stack = [dense]
        for i in range(1, levels):
            blurred = correlated(stack[-1], kernel, nulls)
            # as a blur of a blur, each level has values only where the grid has cells
            stack.append(np.where(present[:, 2 * i : present.shape[1] - 2 * i, 2 * i : present.shape[2] - 2 * i], blurred, np.nan))
        inner = [g[:, m : g.shape[1] - m, m : g.shape[2] - m] for g, m in ((g, reach - 2 * i) for i, g in enumerate(stack))]
        total = inner[-1]
        for i in range(levels - 1):
            total = total + (inner[i] - inner[i + 1]) * (1.0 + 0.2 * (i / (levels - 1)))
        return {value: total}

    return stencils(cube, fn, [value], reach, shape, "mirror", TILE, keys, time, value)


# ------------------------------------------------------------------ gradients and texture


def _at(dy: int, dx: int, value: str) -> Column:
    return F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col(value)))


def gradient(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Adds ``grad_y``, ``grad_x`` and ``gradient``: central differences, one-sided at the edges."""
    sides = {"_up": (-1, 0), "_down": (1, 0), "_left": (0, -1), "_right": (0, 1)}
    out = gather(cube, 1, shape, None, {n: _at(*o, value) for n, o in sides.items()}, keys, time, value)

    def slope(axis: str, n: int, before: str, after: str) -> Column:
        v, a, b = F.col(value), F.col(before), F.col(after)
        return F.when(F.col(axis) == 0, b - v).when(F.col(axis) == n - 1, v - a).otherwise((b - a) / 2)

    out = out.withColumns({"grad_y": slope("y", shape[0], "_up", "_down"), "grad_x": slope("x", shape[1], "_left", "_right")})
    inside = F.when(F.col(value).isNotNull(), F.sqrt(F.col("grad_y") ** 2 + F.col("grad_x") ** 2))
    return out.withColumn("gradient", inside).drop(*sides)


def gradient_stats(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Mean, maximum and population deviation of the gradient magnitude per slice, over cells that have one."""
    return gradient(cube, shape, keys, time, value).groupBy(*keys, time).agg(
        F.avg("gradient").alias("mean_gradient"),
        F.max("gradient").alias("max_gradient"),
        F.stddev_pop("gradient").alias("gradient_variability"),
    )


def sobel(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Adds ``sobel_h``, ``sobel_v`` and ``edge``."""
    kernels = {"sobel_h": weighted(SOBEL_H, value), "sobel_v": weighted(SOBEL_V, value)}
    out = gather(cube, 1, shape, "symmetric", kernels, keys, time, value)
    return out.withColumn("edge", F.sqrt(F.col("sobel_h") ** 2 + F.col("sobel_v") ** 2))


def edge_content(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Mean Sobel magnitude per variable."""
    return sobel(cube, shape, keys, time, value).groupBy(*keys).agg(F.avg("edge").alias("edge_content"))


def edge_preservation(
    orig: DataFrame, new: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Correlation of the summed Sobel responses before and after; 0 where it is undefined.

    Both versions travel through one pass as two columns of the same cells.
    """
    cell = [*keys, time, "y", "x"]
    both = orig.select(*cell, F.col(value).alias("_a")).join(new.select(*cell, F.col(value).alias("_b")), cell)
    sums = {f"_e{c}": weighted(SOBEL_H, c) + weighted(SOBEL_V, c) for c in ("_a", "_b")}
    out = gather(both, 1, shape, "symmetric", sums, keys, time, "_a").where(F.col("_e_a").isNotNull() & F.col("_e_b").isNotNull())
    defined = (F.stddev_pop("_e_a") > 0) & (F.stddev_pop("_e_b") > 0)
    return out.groupBy(*keys).agg(F.when(defined, F.corr("_e_a", "_e_b")).otherwise(0.0).alias("edge_preservation"))


def local_variance(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """Adds ``local_variance``: 3 x 3 population variance, null unless all nine cells are valid."""
    full = F.when(F.count(value) == 9, F.var_pop(value))
    return gather(cube, 1, shape, None, {"local_variance": full}, keys, time, value)


def texture_stats(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    return local_variance(cube, shape, keys, time, value).groupBy(*keys, time).agg(
        F.avg("local_variance").alias("local_variance_mean"),
        F.stddev_pop("local_variance").alias("local_variance_std"),
        F.var_pop(value).alias("data_variance"),
    )


def morans_i(
    cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", least: int = 10
) -> DataFrame:
    """Simplified Moran's I per slice.

    The lag of an interior cell is the mean of its valid neighbours and its weight their number; the
    mean runs over all valid cells.  0 for slices of fewer than ``least`` cells or without variation.
    """
    ring = F.when((F.col("dy") != 0) | (F.col("dx") != 0), F.col(value))
    cells = gather(cube, 1, shape, None, {"_lag": F.avg(ring), "_w": F.count(ring)}, keys, time, value)
    valid = cells.where(F.col(value).isNotNull())
    inner = F.col("y").between(1, shape[0] - 2) & F.col("x").between(1, shape[1] - 2) & (F.col("_w") > 0)
    w = F.when(inner, F.col("_w")).otherwise(0)
    # centred sums expand into moments, so that the mean needs no second pass over the windows
    v, lag = F.col(value), F.coalesce(F.col("_lag"), F.lit(0.0))
    slices = [*keys, time]
    mean = cube.groupBy(*slices).agg(F.avg(value).alias("_mu"), F.count(value).alias("n"))
    rows = same_keys(valid, mean, slices)
    mu = F.col("_mu")
    out = rows.groupBy(*slices).agg(
        F.sum(w * (v - mu) * (lag - mu)).alias("_num"), F.sum(w * (v - mu) * (v - mu)).alias("_den"), F.max("n").alias("n")
    )
    value_of = F.when((F.col("n") < least) | (F.col("_den") == 0), 0.0).otherwise(ratio(F.col("_num"), F.col("_den")))
    return out.select(*slices, "n", value_of.alias("morans_i"))


def spatial_consistency(
    cube: DataFrame, shape: Shape, factor: float = 10.0, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value",
    spread: DataFrame | None = None,
) -> DataFrame:
    """Largest gradient of the time-mean image against ``factor`` standard deviations of the data.

    ``spread`` gives the deviations (``keys, std``) where the caller has them.
    """
    image = time_mean(cube, keys, value).withColumn("_image", F.lit(1))
    steep = F.greatest(F.abs("grad_y"), F.abs("grad_x"))
    top = gradient(image, shape, keys, "_image", value).groupBy(*keys).agg(F.max(steep).alias("max_gradient"))
    if spread is None:
        spread = cube.groupBy(*keys).agg(F.stddev_pop(value).alias("std"))
    out = merge_on(top, spread, keys)
    return out.withColumn("inconsistent", F.coalesce(F.col("max_gradient") > factor * F.col("std"), F.lit(False)))


# ------------------------------------------------------------------ contrast


def hist_equalize(
    cube: DataFrame, bins: int = 256, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Per slice: values through the normalised cumulative histogram, linear between left bin edges.

    Slices have about as many occupied bins as cells, so their tables are joined without copies.
    """
    group = [*keys, time]
    rows = with_bins(cube, bins, group, value, same_keys)
    table = rows.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("_m"))
    # a slice has at most ``bins`` rows here
    w = by(group, "bin")
    nxt = F.when(F.lead("bin").over(w) == F.col("bin") + 1, F.lead("_m").over(w)).otherwise(0)
    table = table.withColumns({"_cum": F.sum("_m").over(running(group, "bin")), "_next": nxt})
    ends = table.groupBy(*group).agg(F.min("_cum").alias("_a"), F.max("_cum").alias("_b"))
    levels = merge_on(table, ends, group).select(
        *group, "bin",
        ratio(F.col("_cum") - F.col("_a"), F.col("_b") - F.col("_a")).alias("_level"),
        F.when(F.col("bin") < bins - 1, ratio(F.col("_next"), F.col("_b") - F.col("_a"))).otherwise(0.0).alias("_rise"),
    )
    out = same_keys(rows, levels, [*group, "bin"])
    part = (F.col(value) - (F.col("_lo") + F.col("bin") * F.col("_w"))) / F.col("_w")
    out = out.withColumn(value, F.col("_level") + F.col("_rise") * part).select(*cube.columns)
    return out.unionByName(cube.where(F.col(value).isNull()))


def contrast_stretch(
    cube: DataFrame, low: float = 2.0, high: float = 98.0, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Per slice clip((v - p_low) / (p_high - p_low), 0, 1); unchanged where both percentiles are equal."""
    cut = exact_quantiles(cube, [*keys, time], value, {"_a": low / 100.0, "_b": high / 100.0})
    rows, v = same_keys(cube, cut, [*keys, time], "left"), F.col(value)
    scaled = (v - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))
    clipped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
    return rows.withColumn(value, F.when(v.isNotNull() & (F.col("_b") > F.col("_a")), clipped).otherwise(v)).drop("_a", "_b")


def _level(hist: Column, v8: Column, clip: int, area: int) -> Column:
    """Entry ``v8`` of a tile's table: its clipped and redistributed cumulative histogram, scaled to 0..255.

    ``hist`` has the occupied levels in order (``bins``), the running sums of their clipped counts (``sums``)
    and what was cut off (``excess``), which is dealt out over all 256 levels, the rest of it in equal steps.
    """
    below = F.coalesce(F.get(hist["sums"], count_below(hist["bins"], v8 + 1, 256) - 1), F.lit(0))
    each, rest = F.floor(hist["excess"] / 256), hist["excess"] % 256
    step = F.floor(F.lit(256) / F.greatest(rest, F.lit(1)))
    total = below + (v8 + 1) * each + F.least(rest, F.floor(v8 / step) + 1)
    return F.rint(F.greatest(F.least(total * F.lit(255.0 / area), F.lit(255.0)), F.lit(0.0)))


def clahe(
    cube: DataFrame, shape: Shape, clip_limit: float = 2.0, tiles: int = 8, keys: Sequence[str] = KEYS, time: str = "time",
    value: str = "value", unit_range: bool = False,
) -> DataFrame:
    """Contrast limited adaptive equalisation on 8-bit levels.

    Levels come from the whole variable's range and are scaled back to it; with ``unit_range`` they
    come from the slice, ``clip_limit`` is a share of the tile and the result lies in 0..1.  Tile
    histograms are aggregated and sent to the up to nine fields between four tile centres that they
    serve; each cell is sent once, to its field, and blends the entries it needs of the four tables.
    """
    group = [*keys, time]
    ny, nx = shape
    th, tw = -(-ny // tiles), -(-nx // tiles)
    area = th * tw
    clip = max(int(clip_limit * area / (1 if unit_range else 256)), 1)
    ranged = with_range(cube, group, value, same_keys) if unit_range else with_range(cube, keys, value)
    rows = ranged.withColumn("_v8", to_8bit(F.col(value), F.col("_min"), F.col("_max")))
    padded = rows.where(F.col("_v8").isNotNull()).select(*group, "y", "x", "_v8")
    for axis, n, size in (("y", ny, th), ("x", nx, tw)):
        mirrored = 2 * (n - 1) - F.col(axis)
        spots = F.array_compact(F.array(F.col(axis), F.when((mirrored >= n) & (mirrored < size * tiles), mirrored)))
        padded = padded.withColumn(axis, F.explode(spots))
    tile_y, tile_x = F.floor(F.col("y") / th).cast("int"), F.floor(F.col("x") / tw).cast("int")
    tile = [*group, "_ty", "_tx"]
    counted = padded.groupBy(*group, tile_y.alias("_ty"), tile_x.alias("_tx"), "_v8").agg(F.count(F.lit(1)).alias("_m"))
    # a tile has at most 256 rows here
    summed = counted.withColumn("_sum", F.sum(F.least("_m", F.lit(clip))).over(running(tile, "_v8")))
    listed = F.array_sort(F.collect_list(F.struct("_v8", "_sum")))
    hists = summed.groupBy(*tile).agg(listed.alias("_l"), F.sum(F.greatest(F.col("_m") - clip, F.lit(0))).alias("_excess"))
    hists = hists.select(*tile, F.struct(F.col("_l._v8").alias("bins"), F.col("_l._sum").alias("sums"), F.col("_excess").alias("excess")).alias("_hist"))

    # field i lies between the centres of the tiles i and i + 1; beyond the outer centres both are the outer tile
    def serves(axis: str) -> Column:
        t = F.col(axis)
        spots = [(t, 0), (t - 1, 1), *((F.when(t == edge, t - 1 + side), side) for edge, side in ((0, 0), (tiles - 1, 1)))]
        return F.filter(F.array(*[F.struct(at.alias("at"), F.lit(side).alias("side")) for at, side in spots]), lambda s: s["at"].isNotNull())

    fields = hists.withColumn("_a", F.explode(serves("_ty"))).withColumn("_b", F.explode(serves("_tx")))
    corner = {f"_c{i}{j}": F.max(F.when((F.col("_a.side") == i) & (F.col("_b.side") == j), F.col("_hist"))) for i in (0, 1) for j in (0, 1)}
    fields = fields.groupBy(*group, F.col("_a.at").alias("_fy"), F.col("_b.at").alias("_fx")).agg(*[c.alias(n) for n, c in corner.items()])

    for axis, size, name in (("y", th, "_fy"), ("x", tw, "_fx")):
        rows = rows.withColumn(name, F.floor(F.col(axis) / size - 0.5).cast("int"))
    placed = rows.join(fields, [*group, "_fy", "_fx"], "left")
    share_y, share_x = F.col("y") / th - 0.5 - F.col("_fy"), F.col("x") / tw - 0.5 - F.col("_fx")
    # a tile without any valid cell has no table; the remaining tiles share its weight
    total, weight = F.lit(0.0), F.lit(0.0)
    for name in corner:
        w = (share_y if name[2] == "1" else 1 - share_y) * (share_x if name[3] == "1" else 1 - share_x)
        held = F.col(name).isNotNull()
        total = total + F.when(held, w * _level(F.col(name), F.col("_v8"), clip, area)).otherwise(0.0)
        weight = weight + F.when(held, w).otherwise(0.0)
    new = F.when(F.col("_v8").isNotNull(), F.rint(ratio(total, weight)))
    out = placed.withColumn("_new", new)
    scaled = F.col("_new") / 255.0 if unit_range else from_8bit(F.col("_new"), F.col("_min"), F.col("_max"))
    return out.withColumn(value, F.when(F.col("_new").isNotNull(), scaled).otherwise(F.col(value))).select(*cube.columns)


def adaptive_equalize(cube: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    return clahe(cube, shape, 0.03, 8, keys, time, value, unit_range=True)


ENHANCEMENTS = ("clahe", "histogram_equalization", "adaptive_equalization", "contrast_stretching", "gamma_correction", "gamma", "unsharp_masking", "multiscale_enhancement")


def enhance_contrast(cube: DataFrame, method: str, shape: Shape, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dispatch by method name."""
    from airgrid.functions.scaling import gamma_correct

    if method == "clahe":
        return clahe(cube, shape, keys=keys)
    if method == "histogram_equalization":
        return hist_equalize(cube, keys=keys)
    if method == "adaptive_equalization":
        return adaptive_equalize(cube, shape, keys)
    if method == "contrast_stretching":
        return contrast_stretch(cube, keys=keys)
    if method in ("gamma", "gamma_correction"):
        return gamma_correct(cube, keys=keys)
    if method == "unsharp_masking":
        return unsharp(cube, shape, keys=keys)
    if method == "multiscale_enhancement":
        return multiscale(cube, shape, keys=keys)
    raise ValueError(f"unknown enhancement: {method}")


# ------------------------------------------------------------------ decomposition over time


def _histories(table: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tile's rows as one centred vector over the slices per cell, gaps at zero: the vectors, the cells' means,
    and of each row its cell, its slice and whether it has a value."""
    cell = table.select(["y", "x"]).to_pandas().groupby(["y", "x"], dropna=False, sort=False).ngroup().to_numpy()
    slot, valid = table["_slot"].to_numpy().astype(int), table[value].is_valid().to_numpy()
    v = table[value].cast(pa.float64()).to_numpy()[valid]
    n = cell.max() + 1
    mean = np.bincount(cell[valid], v, n) / np.maximum(np.bincount(cell[valid], minlength=n), 1)
    vectors = np.zeros((n, int(table["_slots"][0].as_py())))
    vectors[cell[valid], slot[valid]] = v - mean[cell[valid]]
    return vectors, mean, cell, slot, valid


def pca_denoise(
    cube: DataFrame, components: int = 10, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value"
) -> DataFrame:
    """Keep the leading time components of each variable.

    A cell's history is one vector over the slices of its key, centred by the cell's mean, gaps at the
    mean.  The slices-by-slices Gram matrix is summed per tile of cells and then per key; its leading
    eigenvectors, sent once to each tile, project every cell.  Only that matrix, of slice count squared, is
    ever decomposed.  A row whose key or place is null gets null.
    """
    from airgrid.core import materialize, row_position

    keys, kept = list(keys), [c for c in cube.columns if c != value]
    slots = row_position(cube.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_m")).drop("_m"), keys, time, "_slot", "_slots")
    tile = [F.floor(F.col(axis) / HISTORY_TILE).alias(f"_t{axis}") for axis in ("y", "x")]
    rows = same_keys(cube, slots, [*keys, time]).select("*", *tile)
    group = [*keys, "_ty", "_tx"]
    kinds = {f.name: f for f in rows.schema}

    def gram(table: pa.Table) -> pa.Table:
        vectors = _histories(table, value)[0]
        g, n = vectors.T @ vectors, vectors.shape[1]
        # one row per row of the upper triangle
        upper = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *range(n, 0, -1)], dtype=np.int32)), pa.array(g[np.triu_indices(n)]))
        head = table.select(group).take(pa.array(np.zeros(n, dtype=np.int64)))
        return head.append_column("_row", pa.array(np.arange(n))).append_column("_g", upper)

    places = [kinds[c] for c in group]
    partial_kind = T.StructType([*places, T.StructField("_row", T.LongType()), T.StructField("_g", T.ArrayType(T.DoubleType()))])
    valued = rows.where(F.col(value).isNotNull()).select(*group, "y", "x", "_slot", "_slots", value)
    partial = materialize(valued.groupBy(*group).applyInArrow(gram, partial_kind))
    # add the partial rows element by element; a row of the matrix is as long as the series of slices
    flat = partial.select(*keys, "_row", F.posexplode("_g").alias("_col", "_x"))
    summed = flat.groupBy(*keys, "_row", "_col").agg(F.sum("_x").alias("_x"))

    def basis(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_row"].max()) + 1
        g = np.zeros((n, n))
        row, col = pdf["_row"].to_numpy(int), (pdf["_row"] + pdf["_col"]).to_numpy(int)
        g[row, col] = g[col, row] = pdf["_x"].to_numpy()
        _, vec = np.linalg.eigh(g)
        lead = vec[:, ::-1][:, : min(components, n)]
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "_basis": [lead.T.ravel().tolist()]})

    types = ", ".join(f"`{k}` {cube.schema[k].dataType.simpleString()}" for k in keys)
    bases = summed.groupBy(*keys).applyInPandas(basis, f"{types}, _basis array<double>")
    there = same_keys(partial.where("_row = 0").select(*group), bases, keys).withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(group)})

    def project(table: pa.Table, bases: pa.Table) -> pa.Table:
        vectors, mean, cell, slot, valid = _histories(table, value)
        known = np.logical_and.reduce([table[c].is_valid().to_numpy() for c in (*keys, "y", "x")])
        new, times = np.full(len(cell), np.nan), np.ones(len(cell), dtype=int)
        if bases.num_rows:
            lead = np.asarray(bases["_basis"][0].values).reshape(-1, vectors.shape[1])
            new = ((vectors @ lead.T) @ lead + mean[:, None])[cell, slot]
            held = np.zeros(vectors.shape, dtype=int)
            np.add.at(held, (cell[valid], slot[valid]), 1)
            # rows that repeat a cell of a slice meet each other, as in a join
            times = np.where(known, np.maximum(held[cell, slot], 1), 1)
        out = table.append_column("_new", pa.array(new, mask=~(valid & known)))
        return out.select([*kept, "_new"]).take(pa.array(np.repeat(np.arange(len(cell)), times)))

    kind = T.StructType([*[cube.schema[c] for c in kept], T.StructField("_new", T.DoubleType())])
    out = rows.groupBy(*group).cogroup(there.groupBy(*[f"_g{i}" for i in range(len(group))])).applyInArrow(project, kind)
    return out.withColumnRenamed("_new", value).select(*cube.columns)


# ------------------------------------------------------------------ map layers


def heat_points(cells: DataFrame, keys: Sequence[str] = KEYS, rows: int | None = None) -> DataFrame:
    """Every k-th positive cell as lat, lon, intensity."""
    return stride_sample(cells, 20, True, keys, rows).select(*keys, "y", "x", "lat", "lon", F.col("value").alias("intensity"))


def markers(cells: DataFrame, keys: Sequence[str] = KEYS, rows: int | None = None) -> DataFrame:
    """Every k-th valid cell with its colour bucket."""
    sampled = stride_sample(cells, 10, False, keys, rows)
    return sampled.select(*keys, "y", "x", "lat", "lon", "value", value_bucket(F.col("value")).alias("colour"))


# ------------------------------------------------------------------ before / after metrics


def noise_metrics(orig: DataFrame, new: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Signal-to-noise ratios, noise variances, their change, and edge preservation."""
    from airgrid.operators.aggregates import snr

    a = snr(orig, keys, value).withColumnsRenamed({"snr": "snr_original", "noise_variance": "noise_variance_original"})
    b = snr(new, keys, value).withColumnsRenamed({"snr": "snr_reduced", "noise_variance": "noise_variance_reduced"})
    out = merge_on(merge_on(a, b, keys, "inner"), edge_preservation(orig, new, shape, keys, value=value), keys)
    v = F.col("noise_variance_original")
    return out.withColumns(
        {
            "snr_improvement": F.col("snr_reduced") - F.col("snr_original"),
            "noise_reduction_ratio": F.when(v > 0, ratio(F.col("noise_variance_reduced"), v)).otherwise(1.0),
        }
    )


def contrast_metrics(orig: DataFrame, new: DataFrame, shape: Shape, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Deviation, range, entropy and edge content before and after, with their changes."""
    from airgrid.operators.aggregates import entropy

    def side(df: DataFrame, tag: str) -> DataFrame:
        base = df.groupBy(*keys).agg(
            F.stddev_pop(value).alias(f"contrast_{tag}"), (F.max(value) - F.min(value)).alias(f"dynamic_range_{tag}")
        )
        base = merge_on(base, entropy(df, keys=keys, value=value).withColumnRenamed("entropy", f"entropy_{tag}"), keys)
        edges = edge_content(df, shape, keys, value=value).withColumnRenamed("edge_content", f"edge_content_{tag}")
        return merge_on(base, edges, keys)

    out = merge_on(side(orig, "original"), side(new, "enhanced"), keys, "inner")
    names = ("contrast", "dynamic_range", "entropy", "edge_content")
    return out.withColumns({f"{n}_improvement": F.col(f"{n}_enhanced") - F.col(f"{n}_original") for n in names})


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Window", "Iterable")]
