"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Texts are equal when they are identical after every run of white space has become one space.  Each
level works only on rows whose key, at the level before, is held by another row too; a text is hashed
as a whole only where length and beginning both meet another text's.  The keys are counted with
map-side partial sums and then restrict the rows in a join; the few keys that hold a large part of all
rows are broadcast, so that their rows stay where they are.  Texts travel once, dealt by their row's own hash.

Cases: null text is the empty text; a null id comes after all others (``keep_id`` is null only where all
ids of the group are); rows that repeat an id are rows of their own, and where the smallest id of a
group repeats, one of its rows stays; an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import NO_ID, SPACE_RUN, hot_join, id_or_last, text_or_empty, written

#: characters of the beginning that the second level hashes
PREFIX = 64


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), SPACE_RUN, " ")


def _repeated(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The rows whose keys at least two rows hold, of ``n`` rows."""
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return hot_join(rows, written(held, "repeated-keys"), keys, "_n", n).drop("_n")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """(id_col, keep_id, group_size, kept, *carry): one row per row of ``docs``.

    ``carry`` names further columns to compute for each row from ``text``, its normalised text.
    """
    carry = dict(carry or {})
    text = docs.select(id_or_last(id_col).alias("id"), normalised(text_col).alias("text"))
    start = F.xxhash64(F.substring("text", 1, PREFIX)).alias("prefix")
    sizes = written(text.select("id", F.length("text").alias("length"), start), "sizes")
    n = sizes.count()
    same_length = written(_repeated(sizes, ["length"], n), "same-length")
    met = written(_repeated(same_length, ["length", "prefix"], n).select("id").distinct(), "same-prefix")

    # only here whole texts are compared, those of rows that met another one so far
    extra = [c.alias(n) for n, c in carry.items()]
    row = F.monotonically_increasing_id().alias("row")
    full = written(text.join(met, "id", "left_semi").select("id", F.sha2("text", 256).alias("full"), row, *extra), "full-hashes")
    groups = full.groupBy("full").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    grouped = hot_join(full, written(groups, "groups"), ["full"], "group_size", n).select(
        "id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), *carry
    )
    alone = text.select("id", *extra).join(met, "id", "left_anti")
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carry)

    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return grouped.unionByName(alone).select(known("id").alias(id_col), known("keep_id").alias("keep_id"), "group_size", "kept", *carry)
