"""Sharding by a keyed permutation: a Feistel network with cycle walking over global row numbers.

The rows get their numbers 0..n-1 in the order of their ids.  The permutation moves number r to place
p; shard = p mod shards and slot = p div shards, so that the shards' row counts differ by one at most
(law ``rows``) and anyone who knows n, the seed and a row number can compute shard and slot.

The network works on pairs (left below a, right below b) with a = ceil(sqrt(n)), b = ceil(n / a); each
round adds a keyed number of one half to the other.  Its domain a * b has fewer than a numbers too
many; a number that lands there goes through the network again.  How many walks the worst number
needs is measured on exactly these surplus numbers, about sqrt(n) of them.

Cases: a null id comes last; equal ids and repeated rows get places of their own (order: id, size,
checksum, then place in the input); null text has size 1 and the checksum of no bytes; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.row_numbers import numbered

ROUNDS = 6
SHARDS = 8
SEED = 20_240_229


def sides(n: int) -> tuple[int, int]:
    """The domain a * b that holds n numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def network(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of number ``x`` through the rounds."""
    halves = F.struct((x % a).alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        even = F.struct(((left + F.pmod(F.xxhash64(right, i, F.lit(seed)), F.lit(a))) % a).alias("l"), right.alias("r"))
        odd = F.struct(left.alias("l"), ((right + F.pmod(F.xxhash64(left, i, F.lit(seed)), F.lit(b))) % b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: s["r"] * F.lit(a) + s["l"])


def walks_needed(spark: SparkSession, n: int, seed: int) -> int:
    """How often the worst number that comes from a row stays in the surplus.

    A surplus number that returns to itself lies on a cycle that no row enters.
    """
    a, b = sides(n)
    inside, walks = spark.range(n, a * b).select("id", F.col("id").alias("at")), 0
    while n and inside.limit(1).count():
        inside = inside.select("id", network(F.col("at"), a, b, seed).alias("at")).where((F.col("at") >= n) & (F.col("at") != F.col("id")))
        walks += 1
    return walks


def permuted(x: Column, n: int, seed: int, walks: int) -> Column:
    a, b = sides(n)
    once = network(x, a, b, seed)
    if not walks:
        return once
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(walks)), once, lambda y, _: F.when(y < n, y).otherwise(network(y, a, b, seed))
    )


def shard_rows(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, row, shard, slot): one row per row of ``docs``."""
    text = F.col(text_col).cast("string")
    slim = docs.select(
        F.col(id_col).alias(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
    )
    rows, n = numbered(slim, [F.col(id_col).asc_nulls_last(), F.col("size"), F.col("text_crc32")])
    place = permuted(F.col("row"), n, seed, walks_needed(docs.sparkSession, n, seed))
    return rows.withColumn("_place", place).select(
        id_col, "size", "text_crc32", "row", (F.col("_place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(n_shards)).cast("long").alias("slot"),
    )
