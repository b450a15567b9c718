"""Ranked lexical search: many items at once, sharing the partial sums that they have in common.

An item's score of a document is a sum over the item's terms, so that items with common terms repeat
additions.  Per block of items a *sharing graph* is mined first: terms held by exactly the same items
become one node, then the pair of nodes that most items share becomes a node, again and again, until no
pair is shared.  A node's value over a block of documents (its accumulator) is added up once, sparse
where few documents have it, and every node and item above it uses that array.

Two passes over the documents: the first finds length and occurrences of the items' terms in every
text (written, as the corpus counts N, L and df must be whole before anything can be scored), the second
works out the accumulators.  Each task keeps the ``k`` best documents per item, and a window over these
rows takes the best of all.

What is broadcast is one block of items (about ``BLOCK_TERMS`` terms): more items mean more blocks,
each with its own passes.

Cases: a null or empty text has no terms and is never found; null ids rank as the largest id and come
back as null; each row of the documents is ranked on its own, repeated ids included; each row of the items
is an item of its own, one without terms has no result; empty tables give an empty table; other columns
of both tables are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import NO_ID, blocks, id_or_last, mapped, split_words, written

#: items are worked off in blocks of about this many (item, term) pairs
BLOCK_TERMS = 50_000
#: bytes of text cut into terms at once, and documents scored at once
BLOCK_BYTES, BLOCK_DOCS = 4_000_000, 2_048
#: of an item's operands, the most shared ones that a round of mining pairs up; the rest wait for a later round
PAIRED = 64

#: what a byte is in a term: A-Z lower-cased, white space for ASCII that is neither letter nor digit
_TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def term_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of every term occurrence, offsets per text, the distinct terms)."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(plain) else np.zeros(0, np.uint8)
    cut = pa.LargeStringArray.from_buffers(len(plain), pa.py_buffer(offsets - offsets[:1].sum()), pa.py_buffer(_TERM_BYTES[data]))
    return split_words(cut)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, block, terms): one row per item, written; ``block`` spreads them evenly by a hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, offsets, words = term_lists(batch["text"])
        lists = [sorted(set(codes[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        names = words.to_pylist()
        terms = pa.array([[names[c] for c in own] for own in lists], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch["item"], batch["row"], terms], names=["item", "row", "terms"])

    slim = items.select(F.col(id_col).alias("item"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = slim.select("item", "row", F.array(F.lit("")).alias("terms")).schema
    return written(mapped(slim, run, schema).where(F.size("terms") > 0), "items")


@dataclass
class SharingGraph:
    """Nodes 0 .. terms-1 are the terms; node ``terms + i`` is the sum of ``parts[i]``, which come before it."""

    terms: int
    parts: list[tuple[int, ...]]
    roots: list[tuple[int, ...]]  # what each item adds up
    uses: np.ndarray  # how many nodes and items read each node

    @property
    def additions(self) -> int:
        return sum(map(len, self.parts)) + sum(map(len, self.roots))

    def expanded(self, operands: tuple[int, ...]) -> list[int]:
        """The terms below some operands."""
        out: list[int] = []
        for x in operands:
            out.extend([x] if x < self.terms else self.expanded(self.parts[x - self.terms]))
        return out


def mine(items: list[list[int]], terms: int, paired: int = PAIRED) -> SharingGraph:
    """The sharing graph of items that hold these term numbers (each at most once per item)."""
    parts: list[tuple[int, ...]] = []
    holders: dict[int, list[int]] = defaultdict(list)
    for i, own in enumerate(items):
        for t in own:
            holders[t].append(i)
    operands: list[set[int]] = [set() for _ in items]
    same: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t, where in holders.items():
        same[tuple(where)].append(t)
    for where, own in sorted(same.items()):
        if len(own) > 1 and len(where) > 1:
            parts.append(tuple(own))
            own = [terms + len(parts) - 1]
        for i in where:
            operands[i].update(own)
    shared = True
    while shared:
        held = Counter(x for own in operands for x in own)
        support: Counter[tuple[int, int]] = Counter()
        for own in operands:
            many = sorted((x for x in own if held[x] > 1), key=lambda x: (-held[x], x))[:paired]
            many.sort()
            support.update((a, b) for n, a in enumerate(many) for b in many[n + 1 :])
        shared, taken = False, [set() for _ in items]
        at: dict[int, list[int]] = defaultdict(list)
        for i, own in enumerate(operands):
            for x in own:
                at[x].append(i)
        for (a, b), n in sorted(support.items(), key=lambda e: (-e[1], e[0])):
            if n < 2:
                break
            # an operand that went into another pair of this round waits for the next one
            both = [i for i in at[a] if b in operands[i] and a in operands[i] and not taken[i] & {a, b}]
            if len(both) > 1:
                node, shared = terms + len(parts), True
                parts.append((a, b))
                for i in both:
                    operands[i] -= {a, b}
                    operands[i].add(node)
                    taken[i].add(node)
    roots = [tuple(sorted(own)) for own in operands]
    uses = np.zeros(terms + len(parts), np.int64)
    for group in (*parts, *roots):
        uses[list(group)] += 1
    return SharingGraph(terms, parts, roots, uses)


class Accumulators:
    """The nodes' values over one block of documents: (rows, values) where few have it, else one array."""

    def __init__(self, graph: SharingGraph, size: int, leaves: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.graph, self.size = graph, size
        self.held: dict[int, tuple[np.ndarray | None, np.ndarray]] = dict(leaves)
        self.left = graph.uses.copy()
        for i, group in enumerate(graph.parts):
            total = self.add_up(group)
            if total is not None:
                rows = np.flatnonzero(total)
                sparse = 4 * len(rows) < size
                self.held[graph.terms + i] = (rows, total[rows]) if sparse else (None, total)

    def add_up(self, group: tuple[int, ...]) -> np.ndarray | None:
        """The sum of some nodes; a node that nothing reads any more is let go.  None: no document has any."""
        total = None
        for x in group:
            found = self.held.get(x)
            self.left[x] -= 1
            if found is None:
                continue
            if not self.left[x]:
                del self.held[x]
            if total is None:
                total = np.zeros(self.size, np.int64)
            rows, values = found
            if rows is None:
                total += values
            else:
                total[rows] += values  # a document is in ``rows`` once
        return total


class Best:
    """The k best (score, id) of one item so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, totals: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[-1] if len(self.scores) == self.k else 1
        rows = np.flatnonzero(totals >= max(least, 1))
        if len(rows):
            scores, names = np.concatenate([self.scores, totals[rows]]), np.concatenate([self.ids, ids[rows]])
            order = np.lexsort((names, -scores))[: self.k]
            self.scores, self.ids = scores[order], names[order]


def occurrences(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of every text: its length in terms, and which of the vocabulary it has how often."""
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(wanted.value, pa.large_string()), len(wanted.value)
        for batch in batches:
            for part in blocks(batch, 1, BLOCK_BYTES):
                codes, offsets, words = term_lists(part.column(1))
                number = np.asarray(pc.fill_null(pc.index_in(words.cast(pa.large_string()), value_set=known), -1), np.int64)
                number = number[codes] if len(codes) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                cells, counts = np.unique((row * size + number)[number >= 0], return_counts=True)
                at = pa.array(np.searchsorted(cells // size, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(at, pa.array((cells % size).astype(np.int32))),
                        pa.ListArray.from_arrays(at, pa.array(counts.astype(np.int64))),
                    ],
                    names=["id", "n", "terms", "counts"],
                )

    slim = docs.select(id_or_last(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def contributions(weights: np.ndarray, counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What an occurring term adds to a score, in whole numbers."""
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * norms))


def best_documents(found: DataFrame, graph: SharingGraph, weights: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(item, id, score): each task's ``k`` best documents per item."""
    plan = found.sparkSession.sparkContext.broadcast((graph, weights, documents, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights, documents, terms = plan.value
        best = [Best(k) for _ in graph.roots]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                ids, n = np.asarray(part["id"]), np.asarray(part["n"])
                sizes = np.asarray(pc.list_value_length(part["terms"]), np.int64)
                row, term = np.repeat(np.arange(part.num_rows), sizes), np.asarray(part["terms"].flatten(), np.int64)
                norms = 100 - 50 + (50 * n * documents) // terms
                worth = contributions(weights[term], np.asarray(part["counts"].flatten(), np.int64), norms[row])
                order = np.argsort(term, kind="stable")
                row, term, worth = row[order], term[order], worth[order]
                cuts = [*np.flatnonzero(np.diff(term, prepend=-1)), len(term)]
                leaves = {int(term[a]): (row[a:b], worth[a:b]) for a, b in itertools.pairwise(cuts)}
                sums = Accumulators(graph, part.num_rows, leaves)
                for own, root in zip(best, graph.roots, strict=True):
                    total = sums.add_up(root)
                    if total is not None:
                        own.offer(total, ids)
        for i, own in enumerate(best):
            columns = [pa.array(np.full(len(own.ids), i, np.int32)), pa.array(own.ids), pa.array(own.scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    return found.mapInArrow(run, "item int, id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_col, rank, id_col, score): each item's ``k`` best documents."""
    spark = docs.sparkSession
    queries = item_terms(items, item_col, item_text_col)
    pairs = queries.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    n_blocks = max(1, math.ceil(pairs / block_terms))
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks))
    kind = items.schema[item_col].dataType
    out = None
    for b in range(n_blocks):
        own = queries.where(block == b).select("row", "terms").orderBy("row").collect()  # a block is bounded
        vocabulary = sorted({t for r in own for t in r.terms})
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        found = written(occurrences(docs, vocabulary, id_col, text_col), "occurrences")
        counts = found.agg(F.sum("n").alias("terms"), F.count(F.when(F.col("n") > 0, 1)).alias("documents")).first()
        if not counts.documents:
            continue
        holding = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df = {r.term: r.df for r in holding.collect()}  # one row per term of the block
        weights = np.array([term_weight(counts.documents, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
        graph = mine([[number[t] for t in r.terms] for r in own], len(vocabulary))
        hits = best_documents(found, graph, weights, counts.documents, counts.terms, k)
        rows = spark.createDataFrame([(i, r.row) for i, r in enumerate(own)], "item int, _row long")
        hits = hits.join(F.broadcast(rows), "item").select("_row", "id", "score")  # as many rows as the block has items
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, `{id_col}` long, score long")
    order = Window.partitionBy("_row").orderBy(F.col("score").desc(), "id")
    first = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = queries.select(F.col("row").alias("_row"), "item")
    return first.join(names, "_row").select(
        F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(NO_ID)).alias(id_col), "score"
    )
