"""SimHash near-dedup: a generalised pigeonhole search over partitions of correlated bits.

Fingerprints.  Words are separated by white space, A-Z lower-cased; every run of ``shingle`` words,
repeats included, votes with its XXH64 (seed 42) on 64 bits; a bit is 1 where more than half the votes
are.  A text of fewer words votes once, one of no words has fingerprint 0.

Search.  Equal fingerprints are one.  The 64 bits are cut into partitions; correlated bits go together,
so that what a partition holds twice is repeated within it and the partitions tell different things.
If two fingerprints differ in at most r bits, and the partitions' thresholds t_i sum to r - m + 1, some
partition differs in at most t_i bits.  A threshold of -1 leaves a partition out.  The thresholds are
unequal: dynamic programming picks those with the least cost, which is made of the rows that probe and
of the candidates estimated from all fingerprints' bit counts; the number of partitions is the one
with the least cost at the given number of fingerprints.

Probing.  A fingerprint is entered under its own part and probes the greater parts within t_i bits.
Groups of the same key are cut into blocks of bounded size; every pair of blocks is a group of its own,
in which all pairs are verified (exclusive or, bit count) and only a spanning forest of the links is
returned: no row is emitted per pair.

Components.  The forests' links are contracted in rounds of joins and minima, written between rounds.

Cases: null text is a text without words; a document without id is linked like others, but lends its
component no id (``component_id`` is null where no document has one; ids are below 2**62); rows that
repeat an id are one document, whose fingerprints are in one component; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import LOWER, NO_ID, byte_texts, id_or_last, mapped, mix64, signed, written

BITS = 64
SEED = 42
#: fingerprints of a block
BLOCK = 8_192
#: cost of one probing row in units of one verified pair
ROW_COST = 1_000.0
PARTITIONS = range(1, 17)
#: fingerprints that only documents without an id have are numbered from here on
NO_NODE = 1 << 62


# ------------------------------------------------------------------ fingerprints


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The 64-bit hash of every shingle of a text, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    n = max(1, len(words) - size + 1)
    starts = [0] + [e + 1 for e in ends[: n - 1]]
    last = ends[min(size, len(words)) - 1 :]
    return np.fromiter((hash_(joined[a:b], SEED) for a, b in zip(starts, last, strict=True)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int, words: int = 1) -> list[int]:
    """The fingerprint, and ``words`` - 1 further ones from scrambled hashes to verify with."""
    hashes = shingle_hashes(text, shingle)
    return [majority(hashes)] + [majority(mix64(hashes + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64))) for i in range(1, words)]


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp0, fp1, ...): one row per row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, shingle, words) for t in byte_texts(batch.column(1))], dtype=np.uint64).reshape(-1, words)
        return pa.RecordBatch.from_arrays([batch.column(0), *(signed(prints[:, i]) for i in range(words))], names=["id", *_names(words)])

    return mapped(docs.select(id_or_last(id_col).alias("id"), F.col(text_col).cast("string")), run, "id long, " + ", ".join(f"{n} long" for n in _names(words)))


def _names(words: int) -> list[str]:
    return [f"fp{i}" for i in range(words)]


# ------------------------------------------------------------------ partitions and thresholds


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, in how many both are 1."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.unpackbits(np.asarray(batch.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both = (bits.T @ bits).astype(np.int64).ravel()
        return pa.RecordBatch.from_arrays([np.arange(-1, len(both)), np.append(batch.num_rows, both)], names=["at", "n"])

    rows = mapped(prints.select("fp0"), count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 64 x 64 + 1 rows
    found = dict(rows)
    both = np.array([found.get(i, 0) for i in range(BITS * BITS)], dtype=np.float64).reshape(BITS, BITS)
    return found.get(-1, 0), both


def correlations(n: int, both: np.ndarray) -> np.ndarray:
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)


def partitions(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal size: each grows by the bit most correlated with it."""
    free, groups = list(range(BITS)), []
    for i in range(m):
        size = len(free) // (m - i)
        pairs = correlation[np.ix_(free, free)] - 2 * np.eye(len(free))
        group = [free.pop(int(np.argmax(pairs.max(axis=1))))]
        while len(group) < size:
            group.append(free.pop(int(np.argmax(correlation[np.ix_(free, group)].sum(axis=1)))))
        groups.append(sorted(group))
    return groups


def near_share(agree: np.ndarray, most: int) -> np.ndarray:
    """The estimated share of pairs that differ in at most 0..most of the bits, from each bit's chance to agree."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for a in agree:
        chance[1:] = chance[1:] * a + chance[:-1] * (1 - a)
        chance[0] *= a
        chance[-1] = 0.0
    return np.cumsum(chance[: most + 1])


def thresholds(groups: list[list[int]], agree: np.ndarray, n: int, radius: int) -> tuple[float, list[int]]:
    """The least cost and the thresholds that have it: they sum to radius - m + 1, each -1 at least."""
    best = {0: (0.0, [])}  # by thresholds + 1 used so far
    for group in groups:
        share = near_share(agree[group], min(radius, len(group)))
        options = [(0, 0.0)]
        for t in range(min(radius, len(group)) + 1):
            rows = 1 + sum(math.comb(len(group), d) for d in range(1, t + 1)) / 2
            options.append((t + 1, n * rows * ROW_COST + n * n / 2 * share[t]))
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for step, more in options:
                key = used + step
                if key <= radius + 1 and (key not in grown or cost + more < grown[key][0]):
                    grown[key] = (cost + more, [*chosen, step - 1])
        best = grown
    return best.get(radius + 1, (math.inf, []))


def search_plan(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions that take part."""
    n = max(n, 2)
    p = np.diag(both) / n
    agree, correlation, choices = p * p + (1 - p) * (1 - p), correlations(n, both), []
    for m in PARTITIONS:
        groups = partitions(correlation, m)
        cost, chosen = thresholds(groups, agree, n, radius)
        if chosen:
            choices.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


# ------------------------------------------------------------------ probing and verifying


def _pick(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def _masks(width: int, most: int) -> np.ndarray:
    """All changes of 1..most of ``width`` bits."""
    sets = [c for d in range(1, most + 1) for c in itertools.combinations(range(width), d)]
    return np.array([sum(1 << b for b in c) for c in sets], dtype=np.uint64)


def probes(entries: DataFrame, plan: list[tuple[list[int], int]], words: int) -> DataFrame:
    """(part, key, probe, node, fp...): each fingerprint under its own key, and as a probe under greater near keys."""
    masks = [_masks(len(bits), t) for bits, t in plan]
    names = ["node", *_names(words)]

    def emit(batch: pa.RecordBatch):
        columns = [np.asarray(batch[n]) for n in names]
        fp = columns[1].view(np.uint64)
        for part, (bits, _) in enumerate(plan):
            own = _pick(fp, bits)
            every = np.arange(len(fp))
            at, key, probe = [every], [own], [np.zeros(len(fp), dtype=bool)]
            for mask in masks[part]:
                other = own ^ mask
                up = other > own  # the pair of keys is met once, from the smaller one
                at.append(every[up])
                key.append(other[up])
                probe.append(np.ones(int(up.sum()), dtype=bool))
                if len(at) == 64:  # bounded batches
                    yield _rows(part, at, key, probe, columns, names)
                    at, key, probe = [], [], []
            if at:
                yield _rows(part, at, key, probe, columns, names)

    def _rows(part, at, key, probe, columns, names):
        at = np.concatenate(at)
        arrays = [pa.array(np.full(len(at), part, dtype=np.int32)), pa.array(signed(np.concatenate(key))), pa.array(np.concatenate(probe))]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c[at]) for c in columns)], names=["part", "key", "probe", *names])

    return mapped(entries.select(*names), emit, "part int, key long, probe boolean, " + ", ".join(f"{n} long" for n in names))


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: the smallest reachable one."""
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            short = labels[labels]
            if (short == labels).all():
                break
            labels = short
        if (labels == before).all():
            return labels


def forest(left: np.ndarray, right: np.ndarray, inner: bool, radius: int, spread: int) -> np.ndarray:
    """(node, root) for all nodes that links join to a smaller one; nodes are numbered left, then right.

    Links go from left to right and, where ``inner``, among the right ones.  Rows are fingerprints,
    columns their words; the first word decides by ``radius``, all together by ``spread``.
    """
    nodes, shift = np.concatenate([left, right]), len(left)
    labels, step = np.arange(len(nodes)), max(1, (1 << 21) // max(len(right), 1))
    for at in range(0, len(nodes) if inner else shift, step):
        part = nodes[at : min(at + step, len(nodes) if inner else shift)]
        a, b = np.nonzero(np.bitwise_count(part[:, None, 0] ^ right[None, :, 0]) <= radius)
        if nodes.shape[1] > 1 and len(a):
            near = np.bitwise_count(part[a] ^ right[b]).sum(axis=1, dtype=np.int64) <= spread
            a, b = a[near], b[near]
        a, b = a + at, b + shift
        a, b = a[a < b], b[a < b]
        if len(a):
            labels = _settle(labels, a, b)
    child = np.flatnonzero(labels != np.arange(len(nodes)))
    return np.stack([child, labels[child]], axis=1)


def links(entries: DataFrame, plan: list[tuple[list[int], int]], words: int, radius: int, spread: int, block: int = BLOCK) -> DataFrame:
    """(a, b): nodes in one component, a spanning forest of each pair of blocks."""
    names = _names(words)
    rows = written(probes(entries, plan, words), "probes")
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("lone")).where("n > 1 AND NOT lone")
    sizes = sizes.select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    as_right = F.transform(every, lambda i: pair(i, F.col("own"), True))
    as_left = F.transform(F.filter(every, lambda j: F.col("probe") | (j > F.col("own"))), lambda j: pair(F.col("own"), j, False))
    # block i on the left meets block j on the right: entries for i <= j, probes for all i and j
    dealt = rows.join(sizes, ["part", "key"]).withColumn("own", own)
    dealt = dealt.withColumn("g", F.explode(F.when(F.col("probe"), as_left).otherwise(F.concat(as_right, as_left))))
    dealt = dealt.select("part", "key", "g.i", "g.j", "g.right", "node", *names)
    group = ["part", "key", "i", "j"]

    def joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        right, node = np.asarray(table["right"]), np.asarray(table["node"])
        prints = np.stack([np.asarray(table[n]).view(np.uint64) for n in names], axis=1)
        order = np.concatenate([node[~right], node[right]])
        found = forest(prints[~right], prints[right], table["i"][0].as_py() == table["j"][0].as_py(), radius, spread)
        return order[found[:, 0]], order[found[:, 1]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(tables: list[pa.Table]) -> pa.RecordBatch | None:
            a, b = map(np.concatenate, zip(*map(joined, tables), strict=True))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch[c], dtype=np.int64) for c in group], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            parts = [pa.Table.from_batches([batch.slice(a, b - a)]) for a, b in zip(cuts, cuts[1:], strict=False)]
            if held and tuple(keys[0]) != last:
                yield out([pa.concat_tables(held)])
                held = []
            held.append(parts[0])
            if len(parts) > 1:
                yield out([pa.concat_tables(held), *parts[1:-1]])
                held = [parts[-1]]
            last = tuple(keys[-1])
        if held:
            yield out([pa.concat_tables(held)])

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(scan, "a long, b long")


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches, itself left out.

    Every round first hangs a node's greater neighbours, then its smaller ones, on the smallest of them;
    minima are partial sums, and joins on a node with many neighbours can be split.
    """
    hung = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    hung, before = written(hung, "links"), None
    while True:
        state = hung.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return hung
        before = state
        both = hung.unionByName(hung.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("least"))
        larger = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        larger = written(larger, "links")
        least = larger.groupBy("node").agg(F.min("root").alias("least"))
        smaller = larger.join(least, "node").where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        hung = written(smaller.unionByName(least.withColumnRenamed("least", "root")).distinct(), "links")


def near_components(prints: DataFrame, radius: int, words: int = 1, spread: int | None = None, block: int = BLOCK) -> DataFrame:
    """``prints`` (id, fp0, ...) and ``component``: the smallest id reachable over links of near fingerprints."""
    names = _names(words)
    prints = written(prints, "fingerprints")
    least = F.min("id")
    # entries without any id get numbers behind all ids
    unnamed = F.lit(NO_NODE) + F.xxhash64(*names).bitwiseAND(F.lit(NO_NODE - 1))
    entries = prints.groupBy(*names).agg(F.when(least != NO_ID, least).alias("node")).withColumn("node", F.coalesce("node", unnamed))
    entries = written(entries, "entries")
    n, both = bit_statistics(entries)
    found = links(entries, search_plan(n, both, radius), words, radius, BITS * words if spread is None else spread, block)
    # rows with one id are one document
    placed = prints.join(entries, names)
    twice = placed.where(F.col("id") != NO_ID).groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    same_id = placed.join(twice, "id").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    roots = components(found.unionByName(same_id))
    return placed.join(roots, "node", "left").select("id", *names, F.coalesce("root", "node").alias("component"))


def near_dedup(docs: DataFrame, radius: int, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id): one row per row of ``docs``."""
    known = lambda c: F.when(F.col(c) < NO_NODE, F.col(c))
    found = near_components(fingerprints(docs, shingle, 1, id_col, text_col), radius)
    return found.select(
        known("id").alias(id_col), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), known("component").alias("component_id")
    )
