"""Shared building blocks: keys, null rules, skew-proof joins, exact order statistics.

The operators never bring one whole key into one task unless its size has a fixed bound.  Three
devices make that work, all of them plain DataFrame code:

* ``attach``        joins per-key statistics back to rows over ``keys + salt``, so that a key which
                    holds a third of all rows is spread over many tasks;
* ``exact_quantiles``  finds the buckets of values that hold the wanted ranks by prefix sums over their
                    counts, and sorts only the distinct values of these;
* ``value_tree``    cuts a key's values into ordered buckets of bounded size, for ranks and positions;
* ``row_position`` / ``halo_blocks``  number the rows of a series through per-month counts and cut
                    it into blocks that carry the neighbouring rows a window needs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid import KEYS

#: rows of a series handled by one window partition
BLOCK = 8_192
#: rows, or distinct values, that one task sorts at once when values are ordered
BUCKET = 8_192
#: stretches that a crowded bucket of values is cut into, at most
PARTS = 65_536
#: rows of a small table that may be broadcast, once they are counted
BROADCAST_ROWS = 50_000


def session(app: str = "airgrid", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The cluster's shared checkpoint folder; ``fallback`` is only used where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    target = configured or fallback
    if target and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(target)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once for several uses: a reliable checkpoint where the cluster names a folder, else a cache.

    Either survives the loss of executors; the checkpoint also cuts the lineage.
    """
    if ensure_checkpoint_dir(df.sparkSession):
        return df.checkpoint()
    return df.persist()


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes null in the given (default: all) floating columns."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    chosen = [c for c in (columns or df.columns) if c in floats]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in chosen}) if chosen else df


def by(keys: Sequence[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def running(keys: Sequence[str], *order) -> Window:
    return by(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(keys: Sequence[str], *order) -> Window:
    return by(keys, *order).rowsBetween(Window.unboundedPreceding, -1)


def ratio(num: Column, den: Column) -> Column:
    """Division that gives null instead of an error for a zero divisor."""
    return num / F.nullif(den.cast("double"), F.lit(0.0))


def sign(c: Column) -> Column:
    return F.signum(c.cast("double"))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# ---------------------------------------------------------------- skew-proof join


def salt_count(df: DataFrame) -> int:
    """As many salts as shuffle partitions, so that a hot key may use the whole cluster."""
    return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def salt(df: DataFrame, n: int) -> Column:
    """A salt that depends on the row's content only, so that retried tasks agree on it."""
    return F.pmod(F.xxhash64(*_hashable(df)), F.lit(n)).cast("int")


def _join_salt(df: DataFrame, n: int) -> Column:
    """Salt for a join whose other side is replicated over all salts.

    The task index is added to the content hash, so that even exact copies of one row, coming from
    many tasks, spread out.  Both parts are the same when a lost task is run again.
    """
    return F.pmod(F.xxhash64(*_hashable(df)) + F.spark_partition_id(), F.lit(n)).cast("int")


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one-row-per-key ``stats`` to ``rows`` on ``keys`` (null keys match each other).

    ``stats`` is replicated over a fixed number of salts and every row picks one, hence a hot key is
    read by that many tasks.  Where ``stats`` turns out small at run time, adaptive execution
    checks its size and broadcasts it instead.
    """
    n = salt_count(rows)
    renamed = {k: f"_k{i}" for i, k in enumerate(keys)}
    right = stats.withColumnsRenamed(renamed).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    left = rows.withColumn("_salt", _join_salt(rows, n))
    on = all_of([F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()] + [F.col("_salt") == F.col("_s")])
    return left.join(right, on, how).drop("_salt", "_s", *renamed.values())


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Plain join on keys of many groups; null keys match each other.

    Nothing is copied, so that ``right`` may be as large as the rows; adaptive execution splits the tasks of a
    group that holds far more rows than others.
    """
    renamed = {k: f"_j{i}" for i, k in enumerate(keys)}
    on = all_of([F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    return left.join(right.withColumnsRenamed(renamed), on, how).drop(*renamed.values())


# ---------------------------------------------------------------- exact order statistics


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a small ``table`` (unique ``keys``, nulls match) to ``rows``.

    The table is computed and counted first: up to ``BROADCAST_ROWS`` rows are broadcast, so that ``rows``
    aren't shuffled; a greater one, with about as many groups as there are rows, is joined without copies.
    """
    table = materialize(table)
    small = table.count() <= BROADCAST_ROWS
    return same_keys(rows, F.broadcast(table) if small else table, keys, how)


def _octave(v: Column) -> Column:
    """A number that never falls as ``v`` grows: 256 steps per power of two, at most 2**20 of them in all.

    Zero, the infinities and NaN (greatest, as in Spark's order) have numbers of their own.
    """
    steps = F.floor(F.greatest(F.least(F.log2(F.abs(v)) * 256, F.lit(262_200.0)), F.lit(-275_200.0))) + 280_000
    return F.when(F.isnan(v), 1 << 21).when(v == 0, 0).otherwise(F.signum(v).cast("long") * steps).cast("long")


def _part_of(v: Column, low: Column, high: Column, parts: Column | int) -> Column:
    """Which of ``parts`` equal stretches of ``low`` to ``high`` (both in one octave) a value is in; never falls
    as it grows, and is another one for ``high`` than for ``low``."""
    return F.floor((v - low) / F.when(high > low, high - low).otherwise(1.0) * parts).cast("long")


def _wanted(ranks: Column, start: Column, size: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= start) & (r < start + size))


def values_at(values: DataFrame, keys: Sequence[str], ranks: Callable[[Column], Column], bucket: int = BUCKET) -> DataFrame:
    """``keys, _n, _r, _v``: the values at some 0-based ranks of ``_v`` within each key, and the key's size.

    ``ranks`` gives the array of ranks from the column of sizes.  Values are counted by ``_octave``; prefix
    sums over these counts (at most 2**20 a key, whatever its size) show which bucket holds a rank.  Only the
    distinct values of such buckets are looked at again, with their counts: while a bucket has more than
    ``bucket`` of them it is cut into ``PARTS`` equal stretches and only the stretch that holds the rank stays.
    No window is ever larger than the greatest of these bounds.
    """
    keys, v = list(keys), F.col("_v")
    values = values.withColumn("_b", _octave(v))
    counted = values.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    counted = counted.withColumns(
        {
            "_n": F.sum("_c").over(Window.partitionBy(*keys)),
            "_start": F.coalesce(F.sum("_c").over(earlier(keys, "_b")), F.lit(0)),
        }
    )
    placed = ["_n", "_start", "_want"]
    held = counted.withColumn("_want", _wanted(ranks(F.col("_n")), F.col("_start"), F.col("_c"))).where(F.size("_want") > 0)
    held = materialize(held.select(*keys, "_b", "_lo", "_hi", *placed))
    single = F.col("_lo").eqNullSafe(F.col("_hi"))
    alike = held.where(single).select(*keys, "_n", F.explode("_want").alias("_r"), F.col("_lo").alias("_v"))
    group = [*keys, "_b"]
    near = lookup(values, held.where(~single), group)
    near = materialize(near.groupBy(*group, "_v", "_lo", "_hi", *placed).agg(F.count(F.lit(1)).alias("_m")))
    while (near.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) > bucket:
        part = f"_p{len(group)}"
        near = near.withColumn(part, _part_of(v, F.col("_lo"), F.col("_hi"), PARTS))
        cells = near.groupBy(*group, part, *placed).agg(F.sum("_m").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        start = F.col("_start") + F.coalesce(F.sum("_c").over(earlier(group, part)), F.lit(0))
        cells = cells.withColumn("_s", start).withColumn("_w", _wanted(F.col("_want"), F.col("_s"), F.col("_c"))).where(F.size("_w") > 0)
        group.append(part)
        near = same_keys(near, cells.select(*group, "_s", "_w", "_l", "_h"), group)
        near = near.drop("_start", "_want", "_lo", "_hi").withColumnsRenamed({"_s": "_start", "_w": "_want", "_l": "_lo", "_h": "_hi"})
        near = materialize(near)
    start = F.col("_start") + F.coalesce(F.sum("_m").over(earlier(group, "_v")), F.lit(0))
    hit = _wanted(F.col("_want"), F.col("_s"), F.col("_m"))
    found = near.withColumn("_s", start).select(*keys, "_n", F.explode(hit).alias("_r"), "_v")
    return alike.unionByName(found)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], bucket: int = BUCKET) -> DataFrame:
    """Linear-interpolated quantiles per key, exact at any group size (see ``values_at``)."""
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    at = lambda p, n: F.lit(float(p)) * (n - 1)
    ranks = lambda n: F.array_distinct(F.array(*[f(at(p, n)).cast("long") for p in probs.values() for f in (F.floor, F.ceil)]))
    aggs, outs = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = at(p, F.col("_n"))
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when(F.col("_r") == rank, F.col("_v"))).alias(f"_{tag}{i}"))
        lo, hi, t = F.col(f"_lo{i}"), F.col(f"_hi{i}"), pos - F.floor(pos)
        # interpolate from the nearer end, so that both ends are hit exactly
        between = F.when(t < 0.5, lo + (hi - lo) * t).otherwise(hi - (hi - lo) * (1 - t))
        outs.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    found = values_at(values, keys, ranks, bucket)
    return found.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs).select(*keys, *outs)


@dataclass(frozen=True)
class ValueTree:
    """Rows with the columns ``path`` of an ordered bucket, and per bucket ``_start``, ``_size``, ``_tied`` and ``_n``."""

    rows: DataFrame
    path: list[str]
    buckets: DataFrame


def value_tree(df: DataFrame, keys: Sequence[str], value: str, bucket: int = BUCKET) -> ValueTree:
    """A sample sort's buckets without the sample: a bucket has at most ``bucket`` rows or one single value.

    Buckets are those of ``_octave``; one with too many rows and more than one value is cut into equal stretches
    between its ends, about four times as many as needed but at most ``PARTS``, until none is left.
    ``_start`` adds up the buckets before by prefix sums within each level, so that no window has more rows
    than a bucket has parts.
    """
    keys, v = list(keys), F.col(value).cast("double")
    rows, path = df.withColumn("_b0", _octave(v)), ["_b0"]
    single = F.col("_lo").eqNullSafe(F.col("_hi"))
    while True:
        ends = [F.count(F.lit(1)).alias("_size"), F.min(v).alias("_lo"), F.max(v).alias("_hi")]
        counted = materialize(rows.groupBy(*keys, *path).agg(*ends))
        large = counted.where((F.col("_size") > bucket) & ~single)
        if not large.limit(1).count():
            break
        parts = F.least(F.ceil(F.col("_size") * 4 / bucket), F.lit(PARTS)).cast("long")
        rows = lookup(rows, large.select(*keys, *path, "_lo", "_hi", parts.alias("_parts")), [*keys, *path], "left")
        path = [*path, f"_b{len(path)}"]
        cut = F.when(F.col("_parts").isNotNull(), _part_of(v, F.col("_lo"), F.col("_hi"), F.col("_parts"))).otherwise(0)
        rows = rows.withColumn(path[-1], cut).drop("_lo", "_hi", "_parts")
    placed = counted.withColumns({"_tied": single, "_start": F.lit(0)})
    for depth in range(len(path)):
        level = counted.groupBy(*keys, *path[: depth + 1]).agg(F.sum("_size").alias("_c"))
        above = [*keys, *path[:depth]]
        level = level.withColumn("_before", F.coalesce(F.sum("_c").over(earlier(above, path[depth])), F.lit(0)))
        if not depth:
            level = level.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
        placed = same_keys(placed, level.drop("_c"), [*above, path[depth]])
        placed = placed.withColumn("_start", F.col("_start") + F.col("_before")).drop("_before")
    return ValueTree(rows, path, placed.select(*keys, *path, "_start", "_size", "_tied", "_n"))


def tied_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, average: bool, bucket: int = BUCKET) -> DataFrame:
    """Rank of every non-null value within its key, from 1: ties share their mean or else their lowest rank."""
    keys = list(keys)
    tree = value_tree(df.where(F.col(value).isNotNull()), keys, value, bucket)
    rows = lookup(tree.rows, tree.buckets.drop("_n"), [*keys, *tree.path])
    # rows of one single value need no sorting, so they may be spread at will
    spread = F.when(F.col("_tied"), salt(tree.rows, salt_count(df))).otherwise(0)
    w = Window.partitionBy(*keys, *tree.path, "_spread")
    rank, ties = F.rank().over(w.orderBy(value)), F.count(F.lit(1)).over(w.partitionBy(*keys, *tree.path, "_spread", value))
    rows = rows.withColumn("_spread", spread).withColumn("_r", rank)
    if average:
        rows = rows.withColumn("_r", F.col("_r") + (ties - 1) / 2)
    alike = (F.col("_size") + 1) / 2 if average else F.lit(1)
    placed = F.col("_start") + F.when(F.col("_tied"), alike).otherwise(F.col("_r"))
    return rows.withColumn(out, placed).drop(*tree.path, "_size", "_start", "_tied", "_spread", "_r")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """Average rank (1-based, ties share their mean rank) of every non-null value within its key."""
    return tied_ranks(df, keys, value, out, True, bucket)


def value_position(
    df: DataFrame, keys: Sequence[str], value: str, tiebreak: Sequence[str] = (), pos: str = "_pos", total: str = "_n",
    bucket: int = BUCKET,
) -> DataFrame:
    """0-based position of every non-null value in ascending order within its key, and the key's size."""
    keys = list(keys)
    tree = value_tree(df.where(F.col(value).isNotNull()), keys, value, bucket)
    rows = lookup(tree.rows, tree.buckets.drop("_size"), [*keys, *tree.path])
    # rows of one single value are numbered in parts by a hash of the row
    part = F.when(F.col("_tied"), salt(tree.rows, salt_count(df))).otherwise(0)
    group = [*keys, *tree.path, "_part"]
    rows = rows.withColumn("_part", part)
    sizes = rows.where("_tied").groupBy(*group).agg(F.count(F.lit(1)).alias("_own"))
    before = F.coalesce(F.sum("_own").over(earlier([*keys, *tree.path], "_part")), F.lit(0))
    rows = lookup(rows, sizes.withColumn("_before", before).drop("_own"), group, "left")
    number = F.row_number().over(by(group, value, *tiebreak)) - 1
    rows = rows.withColumn(pos, F.col("_start") + F.coalesce("_before", F.lit(0)) + number)
    out = rows if total == "_n" else rows.withColumnRenamed("_n", total)
    return out.drop(*tree.path, "_start", "_tied", "_part", "_before")


# ---------------------------------------------------------------- series positions and blocks


def row_position(
    df: DataFrame, keys: Sequence[str], time: str = "time", pos: str = "_pos", total: str | None = None
) -> DataFrame:
    """0-based position of every row of a series within its key, in time order.

    A series has one row per key and time, so that a (key, month) group is bounded by the time
    resolution; the rows of a month are numbered on their own and shifted by the counts of the
    months before.
    """
    keys = list(keys)
    month = F.date_trunc("month", F.col(time)).cast("date")
    dated = df.withColumn("_month", F.coalesce(month, F.lit("0001-01-01").cast("date")))
    sizes = dated.groupBy(*keys, "_month").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*keys)
    starts = sizes.select(
        *keys,
        "_month",
        F.coalesce(F.sum("_size").over(earlier(keys, "_month")), F.lit(0)).alias("_start"),
        *([F.sum("_size").over(whole).alias(total)] if total else []),
    )
    group = [*keys, "_month"]
    numbered = dated.withColumn("_rn", F.row_number().over(by(group, time)))
    return (
        same_keys(numbered, starts, group)
        .withColumn(pos, F.col("_start") + F.col("_rn") - 1)
        .drop("_month", "_rn", "_start")
    )


def halo_blocks(
    df: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int = 0,
    time: str = "time",
    block: int = BLOCK,
    total: str | None = None,
) -> DataFrame:
    """Cut each series into blocks of ``block`` rows plus the rows a window reaches beyond them.

    Adds ``_pos`` and ``_block``; windows then run over ``keys + _block`` and ``own_rows`` drops the
    borrowed rows again.
    """
    if block <= max(before, after):
        raise ValueError("a block must be longer than the window it serves")
    rows = row_position(df, keys, time, total=total)
    b = F.floor(F.col("_pos") / block)
    within = F.col("_pos") - b * block
    owners = F.array_compact(
        F.array(
            b,
            F.when(within >= block - before, b + 1) if before else F.lit(None).cast("long"),
            F.when((within < after) & (b > 0), b - 1) if after else F.lit(None).cast("long"),
        )
    )
    return rows.withColumn("_block", F.explode(owners))


def block_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy("_pos")


def own_rows(df: DataFrame, block: int = BLOCK) -> DataFrame:
    return df.where(F.col("_block") == F.floor(F.col("_pos") / block)).drop("_block")


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int,
    columns: Callable[[Window], Mapping[str, Column]] | Sequence[Callable[[Window], Mapping[str, Column]]],
    time: str = "time",
    block: int = BLOCK,
    keep_pos: bool = False,
) -> DataFrame:
    """Add row-window columns, layer by layer, with one sort per block."""
    layers = columns if isinstance(columns, (list, tuple)) else [columns]
    rows, w = halo_blocks(df, keys, before, after, time, block), block_window(keys)
    for layer in layers:
        rows = rows.withColumns(dict(layer(w)))
    rows = own_rows(rows, block)
    return rows if keep_pos else rows.drop("_pos")


def nearest_valid(
    df: DataFrame, keys: Sequence[str], value: str = "value", time: str = "time", block: int = BLOCK
) -> DataFrame:
    """Last valid and next valid (position, value) of every row: ``_prev``, ``_next``, ``_pos``, ``_n``.

    Blocks look inside themselves first; the value to carry over a block edge comes from the table of
    block ends, which has one row per block.
    """
    keys = list(keys)
    rows = row_position(df, keys, time, total="_n").withColumn("_block", F.floor(F.col("_pos") / block))
    valid = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col(value).alias("v")))
    group = [*keys, "_block"]
    rows = rows.withColumns(
        {
            "_prev": F.last(valid, True).over(running(group, F.col("_pos"))),
            "_next": F.last(valid, True).over(running(group, F.col("_pos").desc())),
        }
    )
    ends = rows.groupBy(*group).agg(F.max(valid).alias("_tail"), F.min(valid).alias("_head"))
    carried = ends.select(
        *group,
        F.last("_tail", True).over(earlier(keys, "_block")).alias("_from"),
        F.last("_head", True).over(earlier(keys, F.col("_block").desc())).alias("_to"),
    )
    return (
        same_keys(rows, carried, group)
        .withColumns({"_prev": F.coalesce("_prev", "_from"), "_next": F.coalesce("_next", "_to")})
        .drop("_from", "_to", "_block")
    )


__all__ = [n for n in dir() if not n.startswith("_")] + ["KEYS"]
