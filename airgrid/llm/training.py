"""Bounded, repeatable samples of documents that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed_labels(labels: DataFrame, label: str, learn: Column, of_two: str) -> DataFrame:
    """(id, label): the labels 0 and 1 that may be looked at, ``of_two`` ("min" or "max") where an id has both.

    ``learn`` says, of the column ``id``, which ones these are.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & learn)
    return rows.groupBy("id").agg(F.expr(f"{of_two}(label)").alias("label"))


def document_ids(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()


def first_by_hash(ids: DataFrame, most: int) -> list[int]:
    """At most ``most`` ids, in the order of a hash of the id: a lost task draws the same ones again."""
    return [r.id for r in ids.select("id").orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(most).collect()]


def texts_of(docs: DataFrame, ids: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, text) of a bounded number of ids; the filter runs in the scan.  One row per id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("text").alias("text"))
