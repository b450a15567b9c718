"""Isolation forest on one value column.

Each tree is grown from a sample of fixed size, as the method prescribes, drawn from all rows of a key.  On one column a
forest is a step function of the value; it is stored in chunks of a few hundred steps that rows reach
through two binary searches inside the expression, so scoring stays in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid import KEYS
from airgrid.core import attach, exact_quantiles, lookup, materialize, same_keys

SUBSAMPLE = 256
TREES = 100
CHUNK = 200
#: rows of a key that one task scores, about
PART = 32_768
#: rows of a key that each tree chooses its sample from
SEEN = 4 * SUBSAMPLE


def average_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_steps(values: np.ndarray, rng: np.random.Generator, depth: int, limit: int, steps: list) -> None:
    """Append (right edge, path length) of the leaves, left to right."""
    if depth >= limit or len(values) <= 1 or values[0] == values[-1]:
        steps.append((math.inf, depth + average_path(len(values))))
        return
    cut = rng.uniform(values[0], values[-1])
    at = int(np.searchsorted(values, cut, "right"))
    grow_steps(values[:at], rng, depth + 1, limit, steps)
    steps[-1] = (cut, steps[-1][1])
    grow_steps(values[at:], rng, depth + 1, limit, steps)


def forest_steps(samples: Sequence[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges and anomaly scores of the forest's step function; score ``i`` holds up to edge ``i``.

    ``samples`` has one sorted sample of values per tree.
    """
    rng = np.random.default_rng(seed)
    size = max(map(len, samples))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    edges, paths = [], []
    for sample in samples:
        steps: list[tuple[float, float]] = []
        grow_steps(sample, rng, 0, limit, steps)
        edges.append(np.array([s[0] for s in steps[:-1]]))
        paths.append(np.array([s[1] for s in steps]))
    cuts = np.unique(np.concatenate(edges))
    probes = np.append(cuts, math.inf)
    total = sum(p[np.searchsorted(e, probes, "left")] for e, p in zip(edges, paths, strict=True))
    return cuts, np.exp2(-(total / len(samples)) / max(average_path(size), 1e-12))


def count_below(sorted_array: Column, v: Column, size: int) -> Column:
    """Number of array elements below ``v``, by binary search; the array has at most ``size`` elements."""
    steps, s = [], 1 << (max(size, 1).bit_length() - 1)
    while s:
        steps.append(s)
        s //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda acc, s: F.when(F.get(sorted_array, acc + s - 1) < v, acc + s).otherwise(acc),
    )


def tree_samples(df: DataFrame, keys: Sequence[str], value: str, trees: int, seed: int) -> DataFrame:
    """``keys, _tree, _values``: for each tree the ``SUBSAMPLE`` rows with the smallest hashes, out of all rows.

    Every row stands for as many trees as it takes for each of them to see ``SEEN`` rows of its key: all
    trees in a short series, one tree in a long one.  Of the rows that stand for a tree, only hashes
    below ``SEEN`` times their mean spacing go on, so that a tree's task gets about ``SEEN`` rows at any
    size of the key.  Rows in any order and partitions give the same samples.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.xxhash64(*df.columns).alias("_row"), F.col(value).cast("double").alias("_v"))
    rows = rows.agg(F.count(F.lit(1)).alias("_copies"))
    sized = attach(rows, rows.groupBy(*keys).agg(F.sum("_copies").alias("_n")), keys)
    every = sized.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    turns = F.least(F.lit(trees), F.ceil(F.lit(trees * SEEN) / F.col("_n"))).cast("int")
    start = F.pmod(F.xxhash64(F.lit(seed), "_row", "_copy"), F.lit(trees)).cast("int")
    drawn = every.withColumns({"_turns": turns, "_start": start}).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))
    drawn = drawn.withColumn("_tree", (F.col("_start") + F.col("_turn")) % trees).withColumn("_h", F.xxhash64(F.lit(seed), "_tree", "_row", "_copy"))
    share = F.col("_h") / float(1 << 64) + 0.5
    seen = drawn.where(share < F.lit(float(SEEN * trees)) / (F.col("_n") * F.col("_turns")))
    few = F.slice(F.array_sort(F.collect_list(F.struct("_h", "_v"))), 1, SUBSAMPLE)
    return seen.groupBy(*keys, "_tree").agg(F.transform(few, lambda d: d["_v"]).alias("_values"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of integer columns, of four bytes or else eight."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    out = np.full(1, 42, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            if c.dtype == np.int32:
                h = (out + five + np.uint64(4)) ^ (c.view(np.uint32).astype(np.uint64) * one)
                out = _mixed(_turned(h, 23) * two + three)
            else:
                h = (out + five + np.uint64(8)) ^ (_turned(c.astype(np.int64).view(np.uint64) * two, 31) * one)
                out = _mixed(_turned(h, 27) * one + four)
    return out.view(np.int64)


def key_samples(row: np.ndarray, v: np.ndarray, trees: int, seed: int) -> list[np.ndarray]:
    """What ``tree_samples`` draws from the known values ``v`` of one key and the hashes of their rows, sorted by value."""
    if not len(v):
        return []
    order = np.lexsort((v, row))
    row, v, n = row[order], v[order], len(v)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    copy = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n])) + 1
    seeded, turns = np.full(1, seed, np.int32), min(trees, math.ceil(trees * SEEN / n))
    start = xxhash64(seeded, row, copy) % trees
    tree = ((start[:, None] + np.arange(turns)) % trees).astype(np.int32).ravel()
    at = np.repeat(np.arange(n), turns)
    h = xxhash64(seeded, tree, row[at], copy[at])
    seen = np.flatnonzero(h / float(1 << 64) + 0.5 < float(SEEN * trees) / (n * turns))
    tree, h, v = tree[seen], h[seen], v[at[seen]]
    order = np.lexsort((v, h, tree))
    parts = np.split(v[order], np.flatnonzero(np.diff(tree[order])) + 1)
    return [np.sort(p[:SUBSAMPLE]) for p in parts if len(p)]


def fit_isolation(
    df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", trees: int = TREES, seed: int = 42
) -> DataFrame:
    """``keys, chunk, starts, edges, scores``: the step function in chunks of at most ``CHUNK`` steps."""
    keys = list(keys)
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    samples = tree_samples(df, keys, value, trees, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_tree")
        cuts, scores = forest_steps([np.sort(np.asarray(v, dtype=float)) for v in pdf["_values"]], seed)
        first = np.arange(0, len(scores), CHUNK)
        starts = [float(cuts[i - 1]) for i in first[1:]]
        head = {k: [pdf[k].iloc[0]] * len(first) for k in keys}
        return pd.DataFrame(
            {
                **head,
                "chunk": np.arange(len(first), dtype=np.int32),
                "starts": [starts] * len(first),
                "edges": [cuts[i : i + CHUNK].tolist() for i in first],
                "scores": [scores[i : i + CHUNK].tolist() for i in first],
            }
        )

    schema = f"{types}, chunk int, starts array<double>, edges array<double>, scores array<double>"
    return samples.groupBy(*keys).applyInPandas(grow, schema)


def anomalies_isolation(
    df: DataFrame, contamination: float = 0.1, keys: Sequence[str] = KEYS, value: str = "value", trees: int = TREES, seed: int = 42
) -> DataFrame:
    """Adds ``score`` and ``is_anomaly``: the ``contamination`` share with the highest scores.

    A key of at most ``PART`` rows is drawn from, scored and cut by one task that sees each row once.  The rows of a
    longer one meet its trees' samples, which are smaller than the forest's step function, in parts of about
    ``PART`` rows; each part grows the same forest and looks its rows up in it.
    """
    keys = list(keys)
    sizes = materialize(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts")))
    most = sizes.agg(F.max("_parts")).first()[0] or 0
    if not keys:
        return _long_keys(df, sizes, contamination, keys, value, trees, seed)
    if most <= 1:
        return _short_keys(df, contamination, keys, value, trees, seed)
    sized = lookup(df, sizes, keys)
    long = _long_keys(sized.where(F.col("_parts") > 1).drop("_parts"), sizes.where(F.col("_parts") > 1), contamination, keys, value, trees, seed)
    return long.unionByName(_short_keys(sized.where(F.col("_parts") <= 1).drop("_parts"), contamination, keys, value, trees, seed))


def quantile(values: np.ndarray, p: float) -> float:
    """As ``exact_quantiles`` has it."""
    values = np.sort(values)
    at = p * (len(values) - 1)
    lo, hi, t = float(values[math.floor(at)]), float(values[math.ceil(at)]), at - math.floor(at)
    return lo if lo == hi else lo + (hi - lo) * t if t < 0.5 else hi - (hi - lo) * (1 - t)


def _short_keys(df: DataFrame, contamination: float, keys: list[str], value: str, trees: int, seed: int) -> DataFrame:
    columns = df.columns

    def score(rows: pa.Table) -> pa.Table:
        found = np.full(rows.num_rows, np.nan)
        valid = rows.column("_v").is_valid().to_numpy()
        values = rows.column("_v").to_numpy()[valid]
        flags = np.zeros(rows.num_rows, bool)
        if len(values):
            samples = key_samples(rows.column("_row").to_numpy()[valid], values, trees, seed)
            cuts, scores = forest_steps(samples, seed)
            found[valid] = scores[np.searchsorted(cuts, values, "left")]
            flags[valid] = found[valid] > quantile(found[valid], 1 - contamination)
        return rows.select(columns).append_column("score", pa.array(found, from_pandas=True)).append_column("is_anomaly", pa.array(flags))

    rows = df.withColumns({"_v": F.col(value).cast("double"), "_row": F.xxhash64(*columns)})
    kind = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("is_anomaly", T.BooleanType())])
    return rows.groupBy(*keys).applyInArrow(score, kind)


def _long_keys(df: DataFrame, sizes: DataFrame, contamination: float, keys: list[str], value: str, trees: int, seed: int) -> DataFrame:
    # rows and samples of a part meet in one group; the sums of rows need no other order
    rows = attach(df, sizes, keys).withColumn("_part", F.pmod(F.xxhash64(*df.columns) + F.spark_partition_id(), F.col("_parts")).cast("int"))
    samples = same_keys(tree_samples(df, keys, value, trees, seed), sizes, keys)
    samples = samples.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    samples = samples.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    group, columns = [*keys, "_part"], df.columns

    def score(rows: pa.Table, samples: pa.Table) -> pa.Table:
        found = np.full(rows.num_rows, np.nan)
        if samples.num_rows:
            trees = samples.sort_by("_tree").column("_values")
            cuts, scores = forest_steps([np.sort(np.asarray(v.values, dtype=float)) for v in trees], seed)
            values = rows.column("_v").to_numpy()
            valid = rows.column("_v").is_valid().to_numpy()
            found[valid] = scores[np.searchsorted(cuts, values[valid], "left")]
        return rows.select(columns).append_column("score", pa.array(found, from_pandas=True))

    rows = rows.drop("_parts").withColumn("_v", F.col(value).cast("double"))
    kind = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    # read several times below
    scored = materialize(rows.groupBy(*group).cogroup(samples.groupBy(*[f"_k{i}" for i in range(len(keys))], "_at")).applyInArrow(score, kind))
    cut = exact_quantiles(scored, keys, "score", {"_cut": 1 - contamination})
    out = attach(scored, cut, keys, "left")
    return out.withColumn("is_anomaly", F.coalesce(F.col("score") > F.col("_cut"), F.lit(False))).drop("_cut")
