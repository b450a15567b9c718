"""What the operators of this subpackage share: the written-table helper, byte rules, word tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the white space of all contracts: [\x20\x09-\x0D]
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: A-Z to a-z on UTF-8 bytes; other bytes stay
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: a null doc_id counts as this id, that is, as one document behind all others
NO_ID = (1 << 63) - 1
#: ``hot_join`` broadcasts a key that more than one in so many rows hold
HOT = 200


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local one only on a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="airgrid-llm-")
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once, read from there: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` with their line of ``table``, one per ``keys``, whose column ``size`` says how many of ``n`` rows hold it.

    Fewer than ``HOT`` keys can hold more than 1 / HOT of all rows each: these are broadcast, so that no
    task gets all rows of one of them.  The others are joined by key.
    """
    hot = table.where(F.col(size) > n // HOT)
    large = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return large.unionByName(rest.join(table.where(F.col(size) <= n // HOT), keys, how))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_or_last(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word code of every word, offsets per text, the distinct words) of one batch.

    Words are separated by the white space of the contracts.  Only distinct words need be looked at.
    """
    plain = pc.utf8_trim(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE)
    lists = pc.ascii_split_whitespace(plain)
    sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    empty = np.asarray(pc.equal(pc.binary_length(plain), 0), dtype=bool)  # these give one empty word
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    if empty.any():
        codes = np.delete(codes, (np.cumsum(sizes) - sizes)[empty])
        sizes[empty] = 0
    return codes, np.concatenate([[0], np.cumsum(sizes)]), coded.dictionary


def strings(array: pa.Array) -> list:
    """A string array's values as Python strings."""
    return array.to_numpy(zero_copy_only=False).tolist()


def blocks(batch: pa.RecordBatch, column: int | str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def hand_back() -> None:
    """Gives memory that is free again back to the system, as the worker may serve another stage next."""
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # only some C libraries have it
        return
    trim(0)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch that returns one batch, several, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
        hand_back()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
