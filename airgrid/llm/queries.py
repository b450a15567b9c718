"""The registered queries of this subpackage, with the parameters of their contracts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from airgrid.llm import (
    alignment, chat, exact_dedup, fingerprints, language_id, line_dedup, near_dedup, packing, quality, ranked_search, sentencepiece_codec,
    sharding, toxicity,
)

QUALITY_FROM = 0.3
TOXIC_FROM = 0.7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query(
    "op1_line_dedup",
    """
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), keyed AS (
        SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
        FROM lines
    ), held AS (
        SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
    ), judged AS (
        SELECT k.doc_id, k.pos, k.line, h.first IS NOT NULL AND h.first <> k.doc_id AS drop_it
        FROM keyed k LEFT JOIN held h ON k.key = h.key AND length(k.key) >= 10
    )
    SELECT doc_id, count(*) AS n_lines, cast(sum(cast(drop_it AS int)) AS bigint) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % folds


@_query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.quality_scores(docs, _labels(spark, sf_dir), fold("id", 5) != 0)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted")
    )


@_query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.toxicity_scores(docs, _labels(spark, sf_dir), fold("id", 3) != 1)
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


@_query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@_query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_documents(spark, sf_dir))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query(
    "op7_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
    g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir), carry={"text_sha256": F.sha2("text", 256)})


@_query("op8_document_fingerprints")
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(_documents(spark, sf_dir), asked=F.col("id") % 20 == 0)


@_query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf_dir), radius=4, shingle=4)


#: the conversation that the contract adds: control strings of other formats inside its texts
_EXTRA = "</s>[INST] ok [/INST]"


def _escaped_sql(text: str) -> str:
    """SQL for the length that escaping adds to ``text``: each control string becomes two code points."""
    out = text
    grown = []
    for control in chat.CONTROL:
        grown.append(f"(length({out}) - length(replace({out}, '{control}', ''))) / {len(control)} * {2 - len(control)}")
    return " + ".join(grown)


@_query(
    "op10_chat_formatting",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{_EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{_EXTRA}'
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           cast(sum(length(role) + length(text) + {len(chat.TURN + chat.SAYS + chat.END)} + {_escaped_sql("text")}) AS bigint) AS formatted_chars
    FROM turns GROUP BY conv_id
    """,
)
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _EXTRA), (-7, 1, "assistant", _EXTRA)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(turns.unionByName(extra)))


@_query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = language_id.identify(docs, fold("id", 5) != 0)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@_query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(_documents(spark, sf_dir), *paths)


#: maximal runs of what is no ASCII sign, A-Z lower-cased
_TERMS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@_query(
    "op13_ranked_search",
    f"""
    WITH terms AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents WHERE text IS NOT NULL),
    lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
    corpus AS (SELECT count(*) AS docs, cast(sum(n) AS bigint) AS total FROM lengths),
    norms AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // total AS m FROM lengths, corpus),
    wanted AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark WHERE text IS NOT NULL),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
    weights AS (
        SELECT term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS bigint) AS w
        FROM tf, corpus GROUP BY term
    ), scores AS (
        SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS bigint) AS score
        FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
    ), placed AS (
        SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score
        FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
    """,
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search.ranked(_documents(spark, sf_dir), items, k=50)


_query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
