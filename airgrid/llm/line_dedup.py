"""Line dedup: shards of a minimal perfect hash index fingerprint and count arrays, which the documents probe.

A line's key is the line without white space at both ends, with A-Z lower-cased.  A key of at least
``min_chars`` code points that at least two documents hold loses all its lines except those in the
document with the smallest id.

1. Lines become 128-bit key hashes, folded per batch, then per key: first and last holder, count.
2. Keys with two holders go to shards; each shard's task builds a minimal perfect hash over its key
   hashes and fills three arrays: fingerprint, count, first holder.  A shard has a bounded number of
   keys, their number grows with the keys.
3. Documents send their line hashes to the shards; a shard's task loads its arrays and streams the
   probes past them, so that its memory doesn't depend on the number of probes.  A key with as many
   lines as a shard has on average (and 1/10,000 of all repeated lines at least) is probed where the
   document is: there are at most 10,000 such keys, so that their arrays are small enough to broadcast,
   and no shard has a hot key.
4. The hits (document, key) go back to their documents, as one set per id and text: rows that share an
   id, those without any included, spread by their texts.

Cases: null text is one empty line; a null id is one document behind all others; rows with the same
id are one document (each row keeps or loses its own lines); an empty table gives an empty table; an
input column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from airgrid.llm.common import LOWER, NO_ID, SPACE_BYTES, blocks, byte_texts, id_or_last, mapped, signed, written
from airgrid.llm.perfect_hash import PerfectHash

MIN_CHARS = 10
#: keys of one shard, on average
SHARD_KEYS = 65_536
#: a hot key has 1/HOT_SHARE of all repeated lines at least; there are at most HOT_SHARE of them
HOT_SHARE = 10_000
#: bytes of text whose lines are held at once
BLOCK_BYTES = 4_000_000


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The key of every line, None where it is shorter than ``min_chars`` code points."""
    keys = []
    for line in text.translate(LOWER).split(b"\n"):
        key = line.strip(SPACE_BYTES)
        long_enough = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        keys.append(key if long_enough else None)
    return keys


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _lines_of(batch: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key hashes of the lines of a batch, once per row, with the number of the row."""
    keys, owners = [], []
    for i, text in enumerate(byte_texts(batch.column(1))):
        own = {k for k in line_keys(text, min_chars) if k is not None}
        keys += own
        owners.append((i, len(own)))
    high, low = _hashes(keys)
    return high, low, np.repeat([i for i, _ in owners], [n for _, n in owners]).astype(np.int64)


class LineArrays:
    """One shard: the perfect hash and the arrays that it indexes."""

    def __init__(self, hash_: PerfectHash, marks: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.hash, self.marks, self.counts, self.firsts = hash_, marks, counts, firsts

    @classmethod
    def build(cls, high, low, counts, firsts) -> LineArrays:
        hash_ = PerfectHash.build(high, low)
        order = np.argsort(hash_.find(high, low))
        return cls(hash_, low[order], counts[order], firsts[order])

    def first_holder(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The first holder of every key, -1 - NO_ID where the shard doesn't hold the key."""
        at = self.hash.find(high, low)
        known = at >= 0
        known[known] = self.marks[at[known]] == low[known]
        out = np.full(len(high), -1 - NO_ID, dtype=np.int64)
        out[known] = self.firsts[at[known]]
        return out

    def pack(self) -> list[bytes]:
        return [a.tobytes() for a in (self.hash.sizes, self.hash.words, self.marks, self.counts, self.firsts)]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> LineArrays:
        kinds = (np.int64, np.uint64, np.uint64, np.int64, np.int64)
        sizes, words, marks, counts, firsts = (np.frombuffer(p, dtype=k) for p, k in zip(parts, kinds, strict=True))
        return cls(PerfectHash(sizes, words), marks, counts, firsts)


PARTS = ["sizes", "words", "marks", "counts", "firsts"]
INDEX = "shard long, " + ", ".join(f"{p} binary" for p in PARTS)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(id_or_last(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("mark"))


def repeated_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(high, low, first, n): the key hashes that at least two documents hold."""

    def fold(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in blocks(batch, 1, BLOCK_BYTES):
            high, low, row = _lines_of(part, min_chars)
            if not len(high):
                continue
            doc = np.asarray(part.column(0), dtype=np.int64)[row]
            order = np.lexsort((doc, low, high))
            high, low, doc = high[order], low[order], doc[order]
            new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(high))
            yield pa.RecordBatch.from_arrays(
                [signed(high[at]), signed(low[at]), doc[at], doc[ends - 1], ends - at], names=["high", "low", "first", "last", "n"]
            )

    folded = mapped(_slim(docs, id_col, text_col), fold, "high long, low long, first long, last long, n long")
    return (
        folded.groupBy("high", "low")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .where("first < last")
        .select("high", "low", "first", "n")
    )


def build_index(keys: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: the packed arrays."""

    def build(table: pa.Table) -> pa.Table:
        high, low = (np.asarray(table[c]).view(np.uint64) for c in ("high", "low"))
        arrays = LineArrays.build(high, low, np.asarray(table["n"]), np.asarray(table["first"]))
        row = {"shard": table["shard"][0].as_py()} | dict(zip(PARTS, arrays.pack(), strict=True))
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int64())] + [(p, pa.binary()) for p in PARTS]))

    return keys.withColumn("shard", F.pmod("high", F.lit(n_shards))).groupBy("shard").applyInArrow(build, INDEX)


def probe(docs: DataFrame, index: DataFrame, n_shards: int, hot: LineArrays, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, mark, drop): per id and text the high hashes of the keys, hot ones apart, that are lost."""

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in blocks(batch, 1, BLOCK_BYTES):
            high, low, row = _lines_of(part, min_chars)
            cold = hot.first_holder(high, low) == -1 - NO_ID
            high, low, row = signed(high[cold]), signed(low[cold]), pa.array(row[cold])
            columns = [high % n_shards, high, low, part.column(0).take(row), part.column(2).take(row)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "high", "low", "doc", "mark"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, arrays = None, None
        for batch in batches:
            shards = np.asarray(batch["shard"])
            is_index = np.asarray(batch["sizes"].is_valid())
            cuts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | is_index[1:]])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(shards)], strict=True):
                if shards[a] != shard:
                    shard, arrays = shards[a], None
                if is_index[a]:
                    arrays = LineArrays.unpack([batch[p][a].as_py() for p in PARTS])
                    a += 1
                if arrays is None or a >= b:
                    continue
                part = batch.slice(a, b - a)
                high, low, doc, mark = (np.asarray(part[c]) for c in ("high", "low", "doc", "mark"))
                first = arrays.first_holder(high.view(np.uint64), low.view(np.uint64))
                lost = (first != -1 - NO_ID) & (first != doc)
                yield pa.RecordBatch.from_arrays([doc[lost], mark[lost], high[lost]], names=["doc", "mark", "high"])

    probes = mapped(_slim(docs, id_col, text_col), emit, "shard long, high long, low long, doc long, mark long")
    rows = index.select("shard", *[F.lit(None).cast("long").alias(c) for c in ("high", "low", "doc", "mark")], *PARTS).unionByName(
        probes, allowMissingColumns=True
    )
    # the arrays of a shard come before its probes
    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.col("sizes").isNull())
    lost = dealt.mapInArrow(scan, "doc long, mark long, high long")
    return lost.groupBy("doc", "mark").agg(F.collect_set("high").alias("drop"))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    shard_keys: int = SHARD_KEYS,
    outputs: Sequence[str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """The rows with ``text_col`` cut to the lines that stay, and how many lines there were and went."""
    spark, size = docs.sparkSession, Observation()
    keys = written(repeated_keys(docs, id_col, text_col, min_chars).observe(size, F.count(F.lit(1)).alias("keys"), F.sum("n").alias("lines")), "lines")
    n_keys, n_lines = size.get["keys"] or 0, size.get["lines"] or 0
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // shard_keys))
    hot_from = max(2, -(-n_lines // HOT_SHARE), -(-n_lines // n_shards))
    top = keys.where(F.col("n") >= hot_from).toArrow() if n_lines else None
    u64 = lambda c: np.asarray(top[c]).view(np.uint64) if top is not None else np.zeros(0, np.uint64)
    i64 = lambda c: np.asarray(top[c]) if top is not None else np.zeros(0, np.int64)
    hot = LineArrays.build(u64("high"), u64("low"), i64("n"), i64("first"))
    index = written(build_index(keys.where(F.col("n") < hot_from), n_shards), "line-index")
    lost = probe(docs, index, n_shards, hot, id_col, text_col, min_chars)

    kept_columns = [c for c in docs.columns if c not in outputs]
    own = {"_llm_doc": id_or_last(id_col), "_llm_mark": F.xxhash64(F.col(text_col).cast("string"))}
    lost = lost.withColumnsRenamed({"doc": "_llm_doc", "mark": "_llm_mark", "drop": "_llm_drop"})
    joined = docs.select(*kept_columns, *[c.alias(n) for n, c in own.items()]).join(lost, [*own], "left")

    def cut_block(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, owners = byte_texts(batch[text_col]), np.asarray(batch["_llm_doc"])
        drops = batch["_llm_drop"].to_pylist()
        kept, counts, dropped = [], [], []
        for text, owner, drop in zip(texts, owners, drops, strict=True):
            keys_, lines = line_keys(text, min_chars), text.split(b"\n")
            at = [i for i, k in enumerate(keys_) if k is not None]
            gone = set()
            if at:
                high, low = _hashes([keys_[i] for i in at])
                first = hot.first_holder(high, low)
                lose = ((first != -1 - NO_ID) & (first != owner)) | np.isin(signed(high), np.array(drop or [], dtype=np.int64))
                gone = {at[i] for i in np.flatnonzero(lose)}
            kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
            counts.append(len(lines))
            dropped.append(len(gone))
        columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == text_col else batch[c] for c in kept_columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*kept_columns, *outputs])

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return map(cut_block, blocks(batch, text_col, BLOCK_BYTES))

    schema = docs.select(*kept_columns).withColumn(text_col, F.col(text_col).cast("string"))
    schema = schema.withColumns({c: F.lit(0).cast("long") for c in outputs}).schema
    return mapped(joined, cut, schema)
