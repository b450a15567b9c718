"""Near copies by the Jaccard similarity of word shingles: candidates from minwise tables, every one verified.

Shingles are those of ``near_dedup``: runs of ``size`` words, A-Z lower-cased, by their XXH64; a text of
fewer words is one shingle, one of no words has none.  Two texts are linked where the sets of their
shingles have a Jaccard similarity of ``similarity`` at least, counted exactly; texts with equal sets are
one entry.

Candidates.  A text is entered in ``TABLES`` tables under ``ROWS`` minwise hashes each.  A pair of
similarity s shares no table in (1 - s**ROWS)**TABLES of all cases: 7 in 100,000 at 0.8, 2 in 10**9 at 0.9.
Groups that another search found (``near``) are one more table: all pairs within them are candidates too.

Verifying.  Groups of a table with the same members as another group are verified once.  Greater groups
are cut into blocks of bounded size; every pair of blocks is a group of its own.  A text (the pivot) is
compared with all texts that it is not yet linked to, and a text goes on only where its size and the
parities of its shingles' hashes leave the similarity possible (both are bounds, nothing is lost).  Only
links that join two components are returned: no row is emitted per pair, and copies of one text cost
one pivot.  The shingles of texts without candidates don't travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import blocks, byte_texts, hand_back, mapped, mix64, signed, written
from airgrid.llm.near_dedup import components, shingle_hashes

TABLES, ROWS = 24, 5
#: texts and shingles of a block
BLOCK, BLOCK_SHINGLES = 4_096, 1 << 20
#: bytes of text whose shingles are held at once
BLOCK_BYTES = 1_000_000
#: bits of the parities
PARITY = 512
_FACTORS = mix64(np.arange(1, TABLES * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix64(np.arange(1, TABLES * ROWS + 1, dtype=np.uint64) + np.uint64(1 << 32))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def table_keys(shingles: np.ndarray) -> np.ndarray:
    """The key of a text in each table."""
    least = np.full(len(_FACTORS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        least = np.minimum(least, (shingles[at : at + (1 << 12)] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    key = np.arange(TABLES, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key ^ least[i::ROWS])
    return key


def _sketches(docs: DataFrame, size: int, row: str, text_col: str) -> DataFrame:
    """(row, d0, d1, n, keys): the digest of a text's set, its size, the keys of its tables."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in blocks(batch, 1, BLOCK_BYTES):
            sets = [shingle_set(t, size) for t in byte_texts(part.column(1))]
            digests = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], dtype=np.uint64)
            keys = pa.array(signed(np.concatenate([table_keys(s) for s in sets])))
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TABLES)
            columns = [part.column(0), signed(digests[:, 0]), signed(digests[:, 1]), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, keys)], names=["row", "d0", "d1", "n", "keys"])

    return mapped(docs.select(F.col(row).alias("row"), F.col(text_col).cast("string")), run, "row long, d0 long, d1 long, n long, keys array<long>")


def _sets(docs: DataFrame, size: int, row: str, text_col: str) -> DataFrame:
    """(node, shingles): the set of each text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in blocks(batch, 1, BLOCK_BYTES):
            sets = [shingle_set(t, size) for t in byte_texts(part.column(1))]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(sets))))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "shingles"])

    return mapped(docs.select(F.col(row).alias("node"), F.col(text_col).cast("string")), run, "node long, shingles array<long>")


# ------------------------------------------------------------------ verifying


def _parities(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each text, for each of ``PARITY`` buckets whether an odd number of its shingles is in it."""
    width = PARITY // 64
    out = np.empty((n, width), dtype=np.uint64)
    for at in range(0, n, 1024):
        a, b = np.searchsorted(owner, [at, min(at + 1024, n)])
        counts = np.bincount((owner[a:b] - at) * PARITY + codes[a:b], minlength=min(1024, n - at) * PARITY)
        out[at : at + 1024] = np.packbits((counts & 1).astype(np.uint8)).view(np.uint64).reshape(-1, width)
    return out


def verified(shingles: np.ndarray, sizes: np.ndarray, right: np.ndarray, inner: bool, similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that connect all texts joined by pairs of the similarity.

    ``shingles`` are the sets one after another.  Pairs are met between left and right texts and, where
    ``inner``, between any two.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    starts = np.cumsum(sizes) - sizes
    parity = _parities((mix64(shingles) % np.uint64(PARITY)).astype(np.int64), owner, n)
    most = (1 - similarity) / (1 + similarity)  # of both sizes together may differ
    labels, done, found = np.arange(n), np.zeros(n, dtype=bool), []
    sides = [np.arange(n)] if inner else [np.flatnonzero(~right), np.flatnonzero(right)]
    queues = [iter(s) for s in sides]
    turn = 0
    while True:
        pivot = next(queues[turn], None)
        if pivot is None:  # all pairs of this side are settled, and with them those of the other
            return found
        others = sides[(turn + 1) % len(sides)]
        turn = (turn + 1) % len(sides)
        done[pivot] = True
        others = others[~done[others] & (labels[others] != labels[pivot])]
        both = sizes[others] + sizes[pivot]
        apart = np.bitwise_count(parity[others] ^ parity[pivot]).sum(axis=1, dtype=np.int64)
        others = others[np.maximum(apart, np.abs(sizes[others] - sizes[pivot])) <= both * most + 1e-6]
        if not len(others):
            continue
        own = shingles[starts[pivot] : starts[pivot] + sizes[pivot]]
        flat = np.repeat(starts[others] - np.cumsum(sizes[others]) + sizes[others], sizes[others]) + np.arange(sizes[others].sum())
        at = np.searchsorted(own, shingles[flat])
        hit = own[np.minimum(at, max(len(own) - 1, 0))] == shingles[flat] if len(own) else np.zeros(len(flat), dtype=bool)
        shared = np.bincount(np.repeat(np.arange(len(others)), sizes[others]), hit, minlength=len(others)).astype(np.int64)
        union = sizes[others] + sizes[pivot] - shared
        for other in others[shared >= similarity * union - 1e-9].tolist():
            if labels[other] != labels[pivot]:
                found.append((int(pivot), other))
                labels[labels == labels[other]] = labels[pivot]


def _verify(dealt: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links within each (key, i, j)."""
    group = ["key", "i", "j"]

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        node, right = np.asarray(table["node"]), np.asarray(table["right"])
        lists = table["shingles"].combine_chunks()
        shingles = np.asarray(lists.flatten()).view(np.uint64)
        sizes = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
        pairs = np.array(verified(shingles, sizes, right, table["i"][0].as_py() == table["j"][0].as_py(), similarity), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([node[pairs[:, 0]], node[pairs[:, 1]]], names=["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch[c], dtype=np.int64) for c in group], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and tuple(keys[a]) != last:
                    yield settle(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(keys[a])
        if held:
            yield settle(held)
        hand_back()

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(scan, "a long, b long")


def copies(
    docs: DataFrame, size: int, similarity: float, row: str, text_col: str = "text", block: int = BLOCK, near: DataFrame | None = None
) -> DataFrame:
    """(row, component): the smallest row reachable over links.  ``row`` numbers the rows of ``docs``.

    ``near`` (row, near) are groups of rows whose pairs are verified as well.
    """
    prints = written(_sketches(docs, size, row, text_col), "sketches")
    entries = written(prints.groupBy("d0", "d1").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys")), "entries")
    named = prints.select("row", "d0", "d1").join(entries.select("d0", "d1", "node", "n"), ["d0", "d1"]).select("row", "node", "n")
    tables = entries.select("node", "n", F.explode("keys").alias("key"))
    if near is not None:
        # rows of one entry may be in several groups
        named = written(named, "named")
        further = named.join(near, "row").select("node", "n", F.xxhash64(F.lit("near"), "near").alias("key")).distinct()
        tables = tables.unionByName(written(further, "near"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in range(2)]
    groups = tables.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("weight"), *members).where("k > 1")
    groups = groups.groupBy("m0", "m1", "k", "weight").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    groups = written(groups.select("key", blocks.alias("blocks")), "groups")
    placed = written(tables.join(groups, "key").select("key", "blocks", "node"), "members")
    asked = placed.select("node").distinct()
    # one plan at every size: a broadcast of the candidates would hold only while they are few
    candidates = docs.join(asked.hint("merge"), docs[row] == asked["node"], "left_semi")
    sets = written(_sets(candidates, size, row, text_col), "sets")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    as_right = F.transform(F.filter(every, lambda i: i <= F.col("own")), lambda i: pair(i, F.col("own"), True))
    as_left = F.transform(F.filter(every, lambda j: j > F.col("own")), lambda j: pair(F.col("own"), j, False))
    dealt = placed.withColumn("own", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("g", F.explode(F.concat(as_right, as_left))).select("key", "g.i", "g.j", "g.right", "node")
    roots = components(_verify(dealt.join(sets, "node").select("key", "i", "j", "right", "node", "shingles"), similarity))
    return named.join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("component"))
