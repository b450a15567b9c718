"""A corpus pipeline: clean documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what it returns as Parquet
to the shared folder and reads it again as the next one's docs.  All stages but the last return the
columns of their input.

Null and empty texts pass the classifiers with the score of a text without words; documents without an
id are scored, cut and packed like others; near-dedup goes by rows, so that ids may be null or repeat and
one row of each group of near copies stays; an empty table passes every stage.
"""

from __future__ import annotations

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import airgrid
from airgrid.llm import line_dedup, near_dedup, packing, quality, shingle_copies, toxicity
from airgrid.llm.common import id_or_last, written

cloudpickle.register_pickle_by_value(airgrid)

TOXIC_FROM = 0.7
QUALITY_FROM = 0.3
#: near copies share this much of their runs of five words
SHINGLE, SIMILARITY = 5, 0.8
#: bits in which fingerprints of near copies may differ
RADIUS = 4
TOKENIZER = "word_bpe_49k.json"


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = _free(docs, "toxicity")
    scored = toxicity.toxicity_scores(docs, _labels(spark, sf_dir), F.lit(True), out=score)
    return scored.where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = _free(docs, "quality")
    scored = quality.quality_scores(docs, _labels(spark, sf_dir), F.lit(True), out=score)
    return scored.where(F.col(score) >= QUALITY_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = (_free(docs, "n_lines"), _free(docs, "n_dropped"))
    cut = line_dedup.line_dedup(docs, outputs=counts).select(*docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, key = _free(docs, "row"), _free(docs, "key")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    # texts with near fingerprints are compared exactly, as are those that share a minwise table
    near = near_dedup.near_dedup(rows, RADIUS, SHINGLE, row).select(F.col(row).alias("row"), F.col("component_id").alias("near"))
    found = shingle_copies.copies(rows, SHINGLE, SIMILARITY, row, near=near).withColumnRenamed("row", row)
    # of each component the row with the smallest id stays, one without an id only where none has one
    place = F.struct(id_or_last("doc_id").alias("id"), F.col(row).alias("row"))
    found = written(found.join(rows.select(row, place.alias(key)), row), "components")
    first = found.groupBy("component").agg(F.min(key).alias("first"))
    copies = found.join(first, "component").where(F.col(key) != F.col("first")).select(row)
    return rows.join(copies, row, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: the classifiers, hashes and tokens of the stages have no SQL; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
