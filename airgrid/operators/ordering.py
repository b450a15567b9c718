"""Pair statistics without pairs: concordance of two orderings by counting digits of ranks.

``sum over i < j of sign(x_j - x_i) * sign(y_j - y_i)`` is needed by the Mann-Kendall test and by
Kendall's tau.  Both axes become ranks from 0, ties sharing the lowest one, written in ``BASE`` digits.  Two
rows with different x differ first at one digit of x, and where y differs too, first at one digit of y: so
every pair that counts is met in exactly one group "same x digits up to level a, same y digits up to level
b", as two cells of its table of next digits.  Rows are counted into these tables, one for each pair of
levels; a table has ``BASE`` squared cells at most, and its sum needs one small window.

For n rows that is (log n)**2 partial counts of each row and no group that grows with n; all variable pairs
go through together as one more key.  The counts pay off for long keys only: a key of at most ``WHOLE`` rows is
counted by one task in memory, bit by bit of the ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.core import BUCKET, by, lookup, materialize, tied_ranks
from airgrid.operators.aggregates import merge_on

#: digits of ranks
BASE = 32
#: rows of a key that one task counts at once
WHOLE = 65_536


def _levels(n: int) -> int:
    """How many digits the ranks below ``n`` need."""
    levels = 1
    while BASE**levels < n:
        levels += 1
    return levels


def digit_balance(ranked: DataFrame, keys: Sequence[str], x: str, y: str, levels: int) -> DataFrame:
    """``keys, s``: concordant minus discordant pairs of the ranks ``x`` and ``y`` (below ``BASE ** levels``)."""
    keys, tables = list(keys), [*keys, "_a", "_b", "_u", "_w"]
    scale = F.array(*[F.lit(BASE ** (levels - 1 - i)) for i in range(levels)])
    every = F.sequence(F.lit(0), F.lit(levels - 1))

    def digits(rank: Column, level: Column) -> tuple[Column, Column]:
        unit = F.get(scale, level)
        return F.floor(rank / unit / BASE), F.floor(rank / unit) % BASE

    rows = ranked.select(*keys, x, y, F.explode(every).alias("_a")).withColumn("_b", F.explode(every))
    (u, dx), (w, dy) = digits(F.col(x), F.col("_a")), digits(F.col(y), F.col("_b"))
    cells = rows.select(*keys, "_a", "_b", u.alias("_u"), w.alias("_w"), dx.alias("_dx"), dy.alias("_dy"))
    cells = cells.groupBy(*tables, "_dx", "_dy").agg(F.count(F.lit(1)).alias("_m"))
    # one row per first digit, with the counts of all second digits
    counts = [F.coalesce(F.sum(F.when(F.col("_dy") == d, F.col("_m"))), F.lit(0)) for d in range(BASE)]
    lines = cells.groupBy(*tables, "_dx").agg(F.array(*counts).alias("_line"))
    earlier_lines = by(tables, "_dx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list("_line").over(earlier_lines)  # fewer than BASE lines of BASE counts
    zero = F.array(*[F.lit(0).cast("long")] * BASE)
    lines = lines.withColumn("_sum", F.aggregate(before, zero, lambda acc, one: F.zip_with(acc, one, lambda p, q: p + q)))
    # a row of digit d meets smaller ones before it (concordant) and greater ones (discordant)
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("below"))
    total = F.aggregate("_sum", F.lit(0).cast("long"), lambda acc, c: acc + c)
    met = F.zip_with("_line", "_sum", lambda own, earlier: F.struct(own.alias("own"), earlier.alias("earlier")))
    step = lambda acc, c: F.struct(
        (acc["s"] + c["own"] * (2 * acc["below"] + c["earlier"] - F.col("_total"))).alias("s"), (acc["below"] + c["earlier"]).alias("below")
    )
    scored = lines.withColumn("_total", total).withColumn("_s", F.aggregate(met, start, step)["s"])
    return scored.groupBy(*keys).agg(F.sum("_s").alias("s"))


def balance(x: np.ndarray, y: np.ndarray) -> int:
    """Concordant minus discordant pairs; equal values, NaN too, are ties."""
    x, y = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    total = 0
    for bit in range(int(y.max(initial=0)).bit_length()):
        # pairs that differ first at this bit meet in the group of their higher bits, in the order of x
        at = np.argsort(y >> (bit + 1), kind="stable")
        group, one = y[at] >> (bit + 1), y[at] >> bit & 1
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, len(at)])
        ones = np.cumsum(one) - one
        ones -= np.repeat(ones[start], size)
        zeros = np.arange(len(at)) - np.repeat(start, size) - ones
        total += int(np.where(one == 1, zeros, -ones).sum())
    # rows of one x stand in the order of y, so that each of their pairs with different y was counted once
    pairs = lambda m: int((m * (m - 1) // 2).sum())
    return total - pairs(np.bincount(x)) + pairs(np.unique(x * len(y) + y, return_counts=True)[1])


def _whole_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``concordance`` of keys that fit into a task."""

    def count(table: pa.Table) -> pa.Table:
        s = balance(*(table.column(c).to_numpy() for c in ("_x", "_y")))
        return table.select(keys).slice(0, 1).append_column("n", pa.array([table.num_rows], pa.int64())).append_column("s", pa.array([s], pa.int64()))

    kind = T.StructType([*rows.select(*keys).schema.fields, T.StructField("n", T.LongType()), T.StructField("s", T.LongType())])
    return rows.select(*keys, "_x", "_y").groupBy(*keys).applyInArrow(count, kind)


def concordance(df: DataFrame, keys: Sequence[str], x: str, y: str, bucket: int = BUCKET, whole: int = WHOLE) -> DataFrame:
    """``keys, n, s``: number of complete rows and their concordant minus discordant pairs."""
    keys = list(keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    rows = materialize(rows)
    counts = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    largest = counts.agg(F.max("n")).first()[0] or 0
    if keys and largest <= whole:
        return _whole_keys(rows, keys)
    short = None
    if keys:
        sized = lookup(rows, counts, keys)
        short, rows = _whole_keys(sized.where(F.col("n") <= whole), keys), sized.where(F.col("n") > whole).drop("n")
        counts = counts.where(F.col("n") > whole)
    for column in ("_x", "_y"):
        rows = tied_ranks(rows, keys, column, f"_rank{column}", False, bucket).drop(column)
    rows = materialize(rows.withColumns({c: F.col(c) - 1 for c in ("_rank_x", "_rank_y")}))
    long = merge_on(counts, digit_balance(rows, keys, "_rank_x", "_rank_y", _levels(largest)), keys)
    return long if short is None else long.unionByName(short)


def tied_pairs(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Number of pairs with equal values."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).cast("double").alias("_m"))
    return sizes.groupBy(*keys).agg(F.sum(F.col("_m") * (F.col("_m") - 1) / 2).alias(out))


__all__ = ["balance", "concordance", "digit_balance", "tied_pairs"]
