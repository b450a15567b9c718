"""Regression forests whose trees grow to the end: large nodes split by sums over all tasks, small ones grown whole.

Features are seen as at most 32 bins and each tree sees every row a Poisson(1) number of times, as in MLlib.  MLlib
gathers the sums of all features and bins for every node down to two rows, from every partition; here only nodes of
more than ``PART_ROWS`` rows are split that way.  What is left is dealt out by tree and node, and a task grows such a
part in memory.  No task sees a whole tree's rows unless they fit one part.
"""

from __future__ import annotations

import json
import math
import multiprocessing
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.core import materialize, same_keys

BINS = 32
#: rows whose values give the bounds of the bins (MLlib's number); every row is used for growing
BOUND_ROWS = 10_000
#: a node with more different rows than this is split by all tasks together
PART_ROWS = 1 << 16
LEAF = 65535
#: a gain below this share of a node's squares is rounding
LEAST_GAIN = 1e-12
#: nodes whose sums one job gathers
NODES = 2048
#: bytes of a forest's nodes that go over the driver to every task; rows go to the parts of a larger one
BROADCAST_BYTES = 1 << 26
#: different rows, in places below 2**16, that reach the parts of a large forest as one block
BLOCK_ROWS = 1 << 14
#: different rows that meet one part of a large forest at once, on average
MEET_ROWS = 1 << 19
PARTS = "tree int, part int, feature binary, cut binary, value binary, importance array<double>"
BLOCKS = "tree int, part int, id binary, bins binary, label binary, weight binary"
SUMS = "tree int, node int, sums binary"
#: bytes of binned features that the task of an elimination holds
HELD_BYTES = 1 << 27
#: binned values that a node looks at in one go
LOOK = 1 << 21
DEALT = "tree int, part int, slice int, block int, place binary, bins binary"
FOUND = "block int, tree int, place binary, value binary"
CUTS = "tree int, node int, feature int, cut int, gain double, mean double, left long, right long"


def bin_bounds(values: np.ndarray, copies: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins - 1`` bounds halfway between neighbouring values, with about equal numbers of rows between them."""
    found, place = np.unique(values, return_inverse=True)
    cut = np.arange(len(found) - 1)
    if len(cut) >= bins:
        below = np.cumsum(np.bincount(place, copies))[:-1]
        cut = np.unique([np.abs(below - copies.sum() * k / bins).argmin() for k in range(1, bins)])
    return found[cut] + (found[cut + 1] - found[cut]) / 2


def binned(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, x[:, i], "left") for i, b in enumerate(bounds)], 1).astype(np.uint8)


def _uniform(ids: np.ndarray, stream: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = ids.view(np.uint64) + np.uint64((stream + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def draws(ids: np.ndarray, copies: np.ndarray, tree: int, seed: int, trees: int) -> np.ndarray:
    """How often a tree sees each row: one Poisson number for all copies of a row, drawn from the row's hash.

    A single tree sees every row as it is.
    """
    if trees == 1:
        return copies.astype(np.int64)
    u, out = _uniform(ids, 2 * (seed * 100_003 + tree)), np.zeros(len(ids), np.int64)
    few = copies <= 64
    if few.any():
        mean = copies[few].astype(float)
        chance = np.exp(-mean)
        total, drawn = chance.copy(), np.zeros(len(mean), np.int64)
        for k in range(1, 200):
            more = u[few] >= total
            if not more.any():
                break
            drawn += more
            chance = chance * mean / k
            total += chance
        out[few] = drawn
    if not few.all():
        mean, v = copies[~few].astype(float), _uniform(ids[~few], 2 * (seed * 100_003 + tree) + 1)
        normal = np.sqrt(-2 * np.log1p(-u[~few])) * np.cos(2 * np.pi * v)
        out[~few] = np.maximum(np.rint(mean + np.sqrt(mean) * normal), 0)
    return out


def children(feature: np.ndarray) -> np.ndarray:
    """Left child of each node; nodes are listed level by level, so that siblings are neighbours."""
    return 2 * np.cumsum(feature != LEAF) - 1


def walk(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    left, at, live = children(feature), np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(live := live[feature[at[live]] != LEAF]):
        here = at[live]
        at[live] = left[here] + (bins[live, feature[here]] > cut[here])
    return at


def best_cut(w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best gain and bin of each node for one feature, from weights and weighted deviations by node and bin."""
    left, moved = np.cumsum(w, 1)[:, :-1], np.cumsum(t, 1)[:, :-1]
    total = w.sum(1)[:, None]
    both = left * (total - left)
    gain = np.where(both > 0, moved * moved * total / np.where(both > 0, both, 1), -1.0)
    at = gain.argmax(1)
    return gain[np.arange(len(w)), at], at


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree level by level: feature and cut of each node, value of each leaf, summed gains by feature."""
    count, w = bins.shape[1], w.astype(float)
    node, nodes = np.zeros(len(y), np.int64), 1
    features, cuts, values, importance = [], [], [], np.zeros(count)
    while nodes:
        weight = np.bincount(node, w, nodes)
        mean = np.bincount(node, w * y, nodes) / weight
        first = np.empty(nodes)
        first[node[::-1]] = y[::-1]
        mixed = np.bincount(node, y != first[node], nodes) > 0
        mean = np.where(mixed, mean, first)
        feature, cut = np.full(nodes, LEAF, np.uint16), np.zeros(nodes, np.uint8)
        if depth > 0 and mixed.any():
            keep = mixed[node]
            bins, y, w, node = bins[keep], y[keep], w[keep], node[keep]
            place = np.cumsum(mixed) - 1
            some, local = int(mixed.sum()), place[node]
            away = y - mean[node]
            t = w * away
            best, which, at = np.full(some, 0.0), np.full(some, LEAF, np.uint16), np.zeros(some, np.uint8)
            for i in range(count):
                key = local * BINS + bins[:, i]
                gain, here = best_cut(np.bincount(key, w, some * BINS).reshape(some, BINS), np.bincount(key, t, some * BINS).reshape(some, BINS))
                better = gain > best
                best[better], which[better], at[better] = gain[better], i, here[better]
            which[best <= LEAST_GAIN * np.bincount(local, t * away, some)] = LEAF
            np.add.at(importance, which[which != LEAF], best[which != LEAF])
            feature[mixed], cut[mixed] = which, at
        features.append(feature)
        cuts.append(cut)
        values.append(mean)
        keep = feature[node] != LEAF
        bins, y, w, node = bins[keep], y[keep], w[keep], node[keep]
        right = bins[np.arange(len(node)), feature[node]] > cut[node]
        node = 2 * (np.cumsum(feature != LEAF) - 1)[node] + right
        nodes, depth = 2 * int((feature != LEAF).sum()), depth - 1
    feature = np.concatenate(features)
    return feature, np.concatenate(cuts), np.concatenate(values), importance


def packed(tree: int, part: int, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, importance: np.ndarray) -> tuple:
    """A tree or part of one as a row of ``PARTS``: cuts of the inner nodes and values of the leaves only."""
    inner = feature != LEAF
    return tree, part, feature.astype(np.uint16).tobytes(), cut[inner].astype(np.uint8).tobytes(), value[~inner].tobytes(), importance.tolist()


def unpacked(feature: bytes, cut: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = np.frombuffer(feature, np.uint16)
    c, v = np.zeros(len(f), np.uint8), np.zeros(len(f))
    c[f != LEAF] = np.frombuffer(cut, np.uint8)
    v[f == LEAF] = np.frombuffer(value)
    return f, c, v


class Top:
    """The first levels of one tree, split by all tasks together; a leaf without a value is a part still to grow."""

    def __init__(self, rows: int, count: int) -> None:
        self.feature, self.cut, self.rows, self.level = [LEAF], [0], [rows], [0]
        self.value, self.importance = [np.nan], np.zeros(count)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.uint16), np.array(self.cut, np.uint8), np.array(self.value), np.array(self.level)

    def large(self, most: int) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f == LEAF and self.rows[i] > most and np.isnan(self.value[i])]

    def split(self, node: int, feature: int, cut: int, gain: float, mean: float, left: int, right: int, depth: int) -> None:
        """Nodes are split in the order of their numbers, which keeps them listed level by level."""
        if feature == LEAF or self.level[node] >= depth:
            self.value[node] = mean
            return
        self.feature[node], self.cut[node] = feature, cut
        self.importance[feature] += gain
        for rows in (left, right):
            self.feature.append(LEAF)
            self.cut.append(0)
            self.rows.append(rows)
            self.level.append(self.level[node] + 1)
            self.value.append(np.nan)


def _rows(batch: pa.RecordBatch, bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, x, y, copies = (batch.column(i) for i in range(4))
    return np.asarray(ids), binned(np.asarray(x.flatten()).reshape(len(x), -1), bounds), np.asarray(y), np.asarray(copies)


def _blobs(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(v, kind) for v in table.column(name).to_pylist()])


def _split_large(table: DataFrame, tops: list[Top], large: list[tuple[int, int]], bounds: list[np.ndarray], origin: float, seed: int, depth: int) -> None:
    """One level of the named nodes: sums by feature and bin from all tasks; a row per node comes back."""
    count, trees = len(bounds), len(tops)
    wanted = {t: [n for u, n in large if u == t] for t, _ in large}
    shapes = {t: tops[t].arrays()[:2] for t in wanted}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {t: np.zeros((len(nodes), 3, count, BINS)) for t, nodes in wanted.items()}
        for batch in batches:
            ids, bins, y, copies = _rows(batch, bounds)
            for t, nodes in wanted.items():
                place = np.full(len(shapes[t][0]), -1)
                place[nodes] = np.arange(len(nodes))
                w = draws(ids, copies, t, seed, trees)
                local = place[walk(*shapes[t], bins)]
                keep = (w > 0) & (local >= 0)
                local, seen, w, moved = local[keep], bins[keep], w[keep], (w * (y - origin))[keep]
                for i in range(count):
                    key = local * BINS + seen[:, i]
                    for j, weight in enumerate((None, w, moved)):
                        totals[t][:, j, i] += np.bincount(key, weight, len(nodes) * BINS).reshape(-1, BINS)
        for t, nodes in wanted.items():
            blobs = [part.tobytes() for part in totals[t]]
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), pa.array(blobs, pa.binary())], names=["tree", "node", "sums"])

    def choose(found: pa.Table) -> pa.Table:
        n, w, moved = sum(np.frombuffer(v).reshape(3, count, BINS) for v in sorted(found.column("sums").to_pylist()))
        weight, total = w[0].sum(), moved[0].sum()
        mean = total / weight if weight else 0.0
        gain, at = best_cut(w, moved - w * mean)
        i = int(gain.argmax())
        chosen = i if gain[i] > LEAST_GAIN**2 * total * mean else LEAF  # less is the rounding of equal labels
        left = int(n[i, : at[i] + 1].sum())
        return pa.Table.from_pylist(
            [{"tree": found["tree"][0].as_py(), "node": found["node"][0].as_py(), "feature": chosen, "cut": int(at[i]), "gain": float(gain[i]),
              "mean": origin + mean, "left": left, "right": int(n[i].sum()) - left}],
            pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()), ("mean", pa.float64()), ("left", pa.int64()), ("right", pa.int64())]),
        )

    cuts = table.mapInArrow(add_up, SUMS).groupBy("tree", "node").applyInArrow(choose, CUTS).collect()
    for r in sorted(cuts, key=lambda r: (r.tree, r.node)):
        tops[r.tree].split(r.node, r.feature, r.cut, r.gain, r.mean, r.left, r.right, depth)


def _grow_parts(table: DataFrame, tops: list[Top], bounds: list[np.ndarray], seed: int, depth: int) -> DataFrame:
    """Rows go to the part of each tree that they fall into, in blocks; a task grows a part in memory."""
    count, trees = len(bounds), len(tops)
    shapes = [top.arrays() for top in tops]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bins, y, copies = _rows(batch, bounds)
            out = []
            for t, (feature, cut, value, _) in enumerate(shapes):
                w = draws(ids, copies, t, seed, trees)
                at = walk(feature, cut, bins)
                keep = np.flatnonzero((w > 0) & np.isnan(value[at]))
                keep = keep[np.argsort(at[keep], kind="stable")]
                for rows in np.split(keep, np.flatnonzero(np.diff(at[keep])) + 1):
                    if len(rows):
                        out.append((t, int(at[rows[0]]), ids[rows].tobytes(), bins[rows].tobytes(), y[rows].tobytes(), w[rows].tobytes()))
            if out:
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                names = ["tree", "part", "id", "bins", "label", "weight"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def finish(found: pa.Table) -> pa.Table:
        tree, part = found["tree"][0].as_py(), found["part"][0].as_py()
        order = np.argsort(_blobs(found, "id", np.int64), kind="stable")
        bins = _blobs(found, "bins", np.uint8).reshape(-1, count)
        row = packed(tree, part, *grow(bins[order], _blobs(found, "label", float)[order], _blobs(found, "weight", np.int64)[order], depth - int(shapes[tree][3][part])))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
        names = ["tree", "part", "feature", "cut", "value", "importance"]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    parts = sum(int(((s[0] == LEAF) & np.isnan(s[2])).sum()) for s in shapes)
    tasks = min(max(parts, 1), 4 * table.sparkSession.sparkContext.defaultParallelism)
    return table.mapInArrow(deal, BLOCKS).repartition(tasks, "tree", "part").groupBy("tree", "part").applyInArrow(finish, PARTS)


class ForestModel(Model, MLWritable):
    """Bounds of the bins and a table with the trees' nodes: a row per part, and one (part -1) for each tree's first levels."""

    def __init__(self, bounds: list[np.ndarray], parts: DataFrame, trees: int) -> None:
        super().__init__()
        self.bounds, self.parts, self.trees = bounds, parts, trees

    @cached_property
    def featureImportances(self) -> DenseVector:
        """Every tree's gains sum to one; trees count alike."""
        gains = np.zeros((self.trees, len(self.bounds)))
        tall = self.parts.select("tree", F.posexplode("importance").alias("place", "gain"))
        for r in tall.groupBy("tree", "place").agg(F.sum("gain").alias("gain")).collect():  # trees x features
            gains[r.tree, r.place] = r.gain
        each = gains.sum(1, keepdims=True)
        total = np.where(each > 0, gains / np.where(each > 0, each, 1), 0).sum(0)
        return Vectors.dense(total / (total.sum() or 1))

    @cached_property
    def nodes(self):
        """The trees, sent to the tasks once: two or three bytes an inner node, ten a leaf."""
        rows = self.parts.select("tree", "part", "feature", "cut", "value").collect()
        trees = [{} for _ in range(self.trees)]
        for r in rows:
            trees[r.tree][r.part] = tuple(bytes(v) for v in r[2:])
        return self.parts.sparkSession.sparkContext.broadcast(trees)

    @cached_property
    def size(self) -> int:
        """Bytes of all nodes."""
        return self.parts.agg(F.sum(F.length("feature") + F.length("cut") + F.length("value"))).first()[0] or 0

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.size <= BROADCAST_BYTES:
            return self._by_row(dataset)
        if dataset.isStreaming:
            raise ValueError("a forest of this size scores a stream batch by batch, see run_available_batches")
        return self._by_part(dataset)

    def _by_row(self, dataset: DataFrame) -> DataFrame:
        """Every task has all trees."""
        bounds, nodes = self.bounds, self.nodes

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            bins = binned(np.asarray(x.flatten()).reshape(len(x), -1), bounds)
            total = np.zeros(len(bins))
            for parts in nodes.value:
                feature, cut, value = unpacked(*parts[-1])
                at = walk(feature, cut, bins)
                found = value[at]
                for part in np.unique(at[np.isnan(found)]):
                    rows = np.flatnonzero(at == part)
                    feature, cut, value = unpacked(*parts[part])
                    found[rows] = value[walk(feature, cut, bins[rows])]
                total += found
            return pa.array(total / len(nodes.value))

        return dataset.withColumn("prediction", predicted(vector_to_array("features")))

    def _by_part(self, dataset: DataFrame) -> DataFrame:
        """Different rows of bins go to the part of each tree that they fall into; only the first levels go over the driver."""
        count, bounds = len(self.bounds), self.bounds
        tops = {r.tree: unpacked(*map(bytes, r[1:])) for r in self.parts.where("part < 0").select("tree", "feature", "cut", "value").collect()}

        @F.arrow_udf("binary")
        def seen(x: pa.Array) -> pa.Array:
            bins = binned(np.asarray(x.flatten()).reshape(len(x), -1), bounds)
            return pa.FixedSizeBinaryArray.from_buffers(pa.binary(count), len(bins), [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())

        def gather(rows: pa.Table) -> pa.Table:
            blob = b"".join(rows.sort_by("_bins").column("_bins").to_pylist())
            return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "bins": pa.array([blob], pa.binary())})

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    bins, out = np.frombuffer(blob, np.uint8).reshape(-1, count), []
                    for t, (feature, cut, value) in tops.items():
                        at = walk(feature, cut, bins)
                        part = np.where(np.isnan(value[at]), at, -1)
                        order = np.argsort(part, kind="stable")
                        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                            out.append((t, int(part[rows[0]]), block // per_slice, block, rows.astype(np.uint16).tobytes(), bins[rows].tobytes()))
                    kinds = [*[pa.int32()] * 4, *[pa.binary()] * 2]
                    names = ["tree", "part", "slice", "block", "place", "bins"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def meet(rows: pa.Table, nodes: pa.Table) -> pa.Table:
            values = []
            if rows.num_rows:
                feature, cut, value = unpacked(*(nodes[c][0].as_py() for c in ("feature", "cut", "value")))
                values = [value[walk(feature, cut, np.frombuffer(b, np.uint8).reshape(-1, count))].tobytes() for b in rows["bins"].to_pylist()]
            return rows.select(["block", "tree", "place"]).append_column("value", pa.array(values, pa.binary()))

        def add_up(rows: pa.Table, found: pa.Table) -> pa.Table:
            bins = [v for blob in rows["bins"].to_pylist() for v in np.frombuffer(blob, f"V{count}").tolist()]
            total = np.zeros(len(bins))
            found = found.sort_by("tree")  # the order of sums that every row has
            for place, value in zip(found["place"].to_pylist(), found["value"].to_pylist(), strict=True):
                total[np.frombuffer(place, np.uint16)] += np.frombuffer(value)
            return pa.table({"_bins": pa.array(bins, pa.binary()), "prediction": pa.array(total / len(tops))})

        rows = dataset.withColumn("_bins", seen(vector_to_array("features")))
        distinct = materialize(rows.select("_bins").distinct())
        blocks = distinct.count() // BLOCK_ROWS + 1
        per_slice = max(MEET_ROWS // BLOCK_ROWS * (sum(int(np.isnan(value).sum()) for _, _, value in tops.values()) // len(tops)), 1)
        block = F.pmod(F.xxhash64("_bins"), F.lit(blocks)).cast("int").alias("block")
        blocked = distinct.select(block, "_bins").groupBy("block").applyInArrow(gather, "block int, bins binary")
        dealt = blocked.mapInArrow(deal, DEALT).groupBy("tree", "part", "slice")
        slices = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // per_slice))).alias("_slice")
        nodes = self.parts.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), slices, "feature", "cut", "value")
        found = dealt.cogroup(nodes.groupBy("_tree", "_part", "_slice")).applyInArrow(meet, FOUND)
        predicted = blocked.withColumnRenamed("block", "_block").groupBy("_block").cogroup(found.groupBy("block")).applyInArrow(add_up, "_bins binary, prediction double")
        return same_keys(rows, predicted, ["_bins"]).drop("_bins")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @staticmethod
    def load(path: str) -> ForestModel:
        spark = SparkSession.active()
        about = json.loads(spark.read.text(f"{path}/metadata").first().value)
        return ForestModel([np.array(b, float) for b in about["bounds"]], spark.read.schema(PARTS).parquet(f"{path}/parts"), about["trees"])


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        kind = type(self.model)
        about = {"class": f"{kind.__module__}.{kind.__name__}", "trees": self.model.trees, "bounds": [b.tolist() for b in self.model.bounds]}
        spark = self.model.parts.sparkSession
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        self.model.parts.write.parquet(f"{path}/parts")


def different_rows(rows: DataFrame) -> tuple[DataFrame, int, float]:
    """Rows of an array ``x`` and a label ``y`` once each with their hash and number; how many these are, the mean label."""
    label = F.col("y").cast("double")
    finite = label.isNotNull() & ~F.isnan(label) & (F.abs(label) < float("inf"))
    checked = F.when(finite, label).otherwise(F.raise_error(F.lit("labels must be finite numbers")).cast("double"))
    distinct = rows.select("x", checked.alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("copies"))
    table = materialize(distinct.select(F.xxhash64("x", "y").alias("id"), "x", "y", "copies"))
    size, origin = table.agg(F.count(F.lit(1)), F.sum(F.col("y") * F.col("copies")) / F.sum("copies")).first()
    if not size:
        raise ValueError("a forest needs training rows")
    return table, size, origin


def all_bounds(table: DataFrame) -> list[np.ndarray]:
    sample = table.orderBy("id").limit(BOUND_ROWS).select("x", "copies").toArrow().combine_chunks()  # at most BOUND_ROWS rows
    copies, x = np.asarray(sample["copies"]), np.array(sample["x"].to_pylist(), float).reshape(sample.num_rows, -1)
    return [bin_bounds(x[:, i], copies) for i in range(x.shape[1])]


class Node:
    """A node of a tree that stays in memory; without a feature it is a leaf."""

    __slots__ = ("below", "feature", "gain", "gone", "level", "rows")

    def __init__(self, rows: np.ndarray, level: int) -> None:
        self.rows, self.level, self.feature, self.gain, self.below, self.gone = rows, level, -1, 0.0, (), False


class ShrinkingTree:
    """A tree that loses features: only nodes split by a lost one are grown again, with what is below them.

    The best cut of any other node is still its best, so that the tree is the one that would be grown anew.
    """

    def __init__(self, bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> None:
        self.bins, self.y, self.w, self.depth = bins, y, w.astype(float), depth
        self.left, self.gains = np.arange(bins.shape[1]), np.zeros(bins.shape[1])
        self.split_by: list[set[Node]] = [set() for _ in self.left]
        self._grow([Node(np.flatnonzero(w > 0).astype(np.int32), 0)])

    def drop(self, features: list[int]) -> None:
        self.left = self.left[~np.isin(self.left, features)]
        torn = sorted({n for f in features for n in self.split_by[f]}, key=lambda n: n.level)
        touched, again = set(), []
        for node in torn:
            if not node.gone:
                under, first = [node], True
                while under:
                    one = under.pop()
                    if one.feature >= 0:
                        self.split_by[one.feature].discard(one)
                        touched.add(one.feature)
                    under.extend(one.below)
                    one.gone, first = not first, False
                node.feature, node.below = -1, ()
                again.append(node)
        self._grow(again, touched)

    def _grow(self, nodes: list[Node], touched: set[int] | None = None) -> None:
        touched, nodes = touched or set(), list(nodes)
        while nodes:
            node = nodes.pop()
            feature, cut, gain = self._best(node)
            if feature < 0:
                node.rows = None  # a leaf stays one
                continue
            right = self.bins[node.rows, feature] > cut
            node.feature, node.gain = feature, gain
            node.below = Node(node.rows[~right], node.level + 1), Node(node.rows[right], node.level + 1)
            self.split_by[feature].add(node)
            touched.add(feature)
            nodes.extend(node.below)
        for f in touched:
            self.gains[f] = math.fsum(n.gain for n in self.split_by[f])

    def _best(self, node: Node) -> tuple[int, int, float]:
        y, w = self.y[node.rows], self.w[node.rows]
        if node.level >= self.depth or (y == y[:1]).all():
            return -1, 0, 0.0
        away = y - (w * y).sum() / w.sum()
        t, found = w * away, (-1, 0, LEAST_GAIN * (w * away * away).sum())
        step = max(LOOK // len(y), 1)
        for i in range(0, len(self.left), step):
            some = self.left[i : i + step]
            key = (self.bins[np.ix_(node.rows, some)] + np.arange(len(some)) * BINS).ravel()
            sums = (np.bincount(key, np.repeat(v, len(some)), len(some) * BINS).reshape(-1, BINS) for v in (w, t))
            gain, at = best_cut(*sums)
            best = int(gain.argmax())
            if gain[best] > found[2]:
                found = int(some[best]), int(at[best]), float(gain[best])
        return found


def executor_cores(spark: SparkSession) -> int:
    """Cores of one executor, about."""
    context = spark.sparkContext
    others = context._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is listed too
    return int(context.getConf().get("spark.executor.cores", str(context.defaultParallelism // max(others, 1))))


def eliminate(rows: DataFrame, k: int, step: int, trees: int, depth: int, seed: int) -> list[int] | None:
    """Places in ``x`` of the ``k`` features left when the ``step`` weakest of a forest go until no more are too many.

    All forests see the same draws of the same rows.  One task keeps the trees, dealt out to a process for each core of
    its executor, and of these only what a lost feature changes is grown again.  None where the binned features are
    too many for a task.
    """
    table, size, _ = different_rows(rows)
    bounds = all_bounds(table)
    count = len(bounds)
    if size * count > HELD_BYTES:
        table.unpersist()
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in _rows(batch, bounds)], names=["id", "bins", "y", "copies"])

    cores = max(min(trees, executor_cores(table.sparkSession)), 1)

    def keep(pipe, ids: np.ndarray, bins: np.ndarray, y: np.ndarray, copies: np.ndarray, some: range) -> None:
        try:
            own = [ShrinkingTree(bins, y, draws(ids, copies, t, seed, trees), depth) for t in some]
            while True:
                pipe.send([t.gains / (t.gains.sum() or 1) for t in own])
                lost = pipe.recv()
                if lost is None:
                    return
                for t in own:
                    t.drop(lost)
        except EOFError:
            return

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not found:
            return
        ids, bins, y, copies = (np.concatenate([np.frombuffer(b[i], kind) for b in found]) for i, kind in enumerate((np.int64, np.uint8, float, np.int64)))
        order = np.argsort(ids, kind="stable")
        ids, bins, y, copies = ids[order], bins.reshape(-1, count)[order], y[order], copies[order]
        fork, pipes, left = multiprocessing.get_context("fork"), [], list(range(count))
        for i in range(cores):
            here, there = fork.Pipe()
            fork.Process(target=keep, args=(there, ids, bins, y, copies, range(i, trees, cores)), daemon=True).start()
            there.close()
            pipes.append(here)
        while len(left) > k:
            told = [pipe.recv() for pipe in pipes]
            weight = sum(told[t % cores][t // cores] for t in range(trees))  # in one order, whatever the cores
            lost = sorted(left, key=lambda f: weight[f])[: min(step, len(left) - k)]
            left = [f for f in left if f not in lost]
            for pipe in pipes:
                pipe.send(lost)
        for pipe in pipes:
            pipe.recv()
            pipe.send(None)
            pipe.close()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32())], names=["place"])

    blocks = table.mapInArrow(pack, "id binary, bins binary, y binary, copies binary")
    left = [r.place for r in blocks.repartition(1).mapInArrow(shrink, "place int").collect()]
    table.unpersist()
    return left


class RandomForest:
    """Settings of a forest; ``fit`` takes rows with a vector ``features`` and a ``label``."""

    def __init__(self, trees: int, depth: int, seed: int = 42, part_rows: int = PART_ROWS) -> None:
        self.trees, self.depth, self.seed, self.part_rows = trees, depth, seed, part_rows

    def fit(self, rows: DataFrame) -> ForestModel:
        """Equal rows are kept once with their number.  All draws go by the rows' hashes, not by partitions."""
        table, size, origin = different_rows(rows.select(vector_to_array("features").alias("x"), F.col("label").alias("y")))
        bounds = all_bounds(table)
        tops = [Top(size, len(bounds)) for _ in range(self.trees)]
        while large := [(t, n) for t, top in enumerate(tops) for n in top.large(self.part_rows)]:
            _split_large(table, tops, large[:NODES], bounds, origin, self.seed, self.depth)
        first = [packed(t, -1, *top.arrays()[:3], top.importance) for t, top in enumerate(tops)]
        grown = _grow_parts(table, tops, bounds, self.seed, self.depth)
        model = ForestModel(bounds, materialize(grown.unionByName(rows.sparkSession.createDataFrame(first, PARTS))), self.trees)
        model.featureImportances  # noqa: B018  (grows the parts)
        table.unpersist()
        return model
