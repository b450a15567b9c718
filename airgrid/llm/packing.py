"""Best-fit packing: large pieces are matched in pairs, smaller ones go where they leave the least room.

Each document becomes its token ids plus an end id; one that is longer than a sequence is cut into
whole sequences and a rest.  Every piece then has a length of 1..``capacity``, and all that a packing
depends on is how many pieces of each length there are: a table of at most ``capacity`` counters.  The
plan is worked out on this table, in runs of equal sequences:

* pieces above a third of the capacity: at most two of them fit in a sequence; the longest open one
  is matched with the longest open one that still fits beside it;
* smaller pieces, longest first, go into the sequence with the smallest gap that takes them, and into
  a new sequence only where no gap does.

A run says "so many sequences hold these lengths", hence the plan's size depends on the number of
different lengths, not on that of documents, and it can be broadcast.  Which piece takes which place
follows from its number among the pieces of its length: tasks number their own pieces while they
tokenize, and the counts of the tasks before them are added.  No piece meets another one in a group.

Cases: null and empty texts are the end id alone; a null id is carried as it is; repeated rows are
packed once each; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import os
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import blocks, hand_back, split_words, strings, written

CAPACITY = 2_048
END_ID = 0
#: bytes of words and ids that a task remembers
REMEMBERED_BYTES = 20_000_000
#: bytes of text tokenized at once
BLOCK_BYTES = 3_000_000


def _byte_signs() -> dict[int, int]:
    """The sign for each byte in byte-level vocabularies: itself where it is printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_SIGNS = _byte_signs()


def _chosen(sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Positions, in a flat array of stretches of ``sizes``, of the stretches ``index`` one after another."""
    n = sizes[index]
    ends = np.cumsum(n)
    return np.repeat((np.cumsum(sizes) - sizes)[index] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)


class WordTable:
    """Ids of words in flat arrays, a few dozen bytes a word; at most about ``limit`` bytes stay."""

    def __init__(self, limit: int = REMEMBERED_BYTES):
        self.limit, self.words = limit, pa.array([], pa.large_string())
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.sizes.nbytes + self.ids.nbytes

    def find(self, words: pa.Array) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1), dtype=np.int64)

    def keep(self, index: np.ndarray) -> None:
        index = np.unique(index)
        self.ids, self.words = self.ids[_chosen(self.sizes, index)], self.words.take(pa.array(index))
        self.sizes = self.sizes[index]

    def add(self, words: pa.Array, ids: list[np.ndarray]) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.ids = np.concatenate([self.ids, *ids]).astype(np.uint32)


#: what a vocabulary is tried with before its texts are cut at white space, or words at their last letter
PROBES = (
    "One, two; (three) it's 42nd 3.14 a-b. C++ e.g. x_y_ Ångström naïve? İI.", "don't 'tis 'S O'RE'. ÀÉ,. \u00aa\u00ba. a\u0301. 12'34' ...!?",
    "<|x|> < | a<|b . [c]| {d} #e @f $1,000.00% ^~` \\n/", " lead  trail ", "日本語。かな, 中文! ß. ÿ: ﬁ; Ωμέγα, Привет. 五5. \U0001f600. ½.",
)
_TAIL = r"(?s)^.*?([!-/:-@\[-`{-~]*)$"


class WordTokenizer:
    """Token ids of texts, word by word where the vocabulary allows it.

    Three ways, tried with ``PROBES`` when the file is read, the first that gives the file's own ids is used:
    "parts" (no token reaches across white space, nor from an ASCII letter or digit to punctuation behind
    it, letters are lower-cased), "words" (the first of these only), "texts" (none).  Only words of ASCII are
    taken apart: other letters may change what follows them.  What a task remembers is bounded in bytes.
    """

    def __init__(self, path: str, limit: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        probes = pa.array(PROBES, pa.large_string())
        whole = np.concatenate(self.encoded(list(PROBES)))
        for self.way in ("parts", "words", "texts"):
            self.table = WordTable(limit)
            if np.array_equal(self.texts(probes)[0], whole):
                break

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 4_096):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4_096], add_special_tokens=False)]
        return out

    def parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word's beginning and the punctuation at its end."""
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        core = pc.ascii_lower(pc.ascii_rtrim(words, string.punctuation))
        cut = pc.and_(plain, pc.match_substring_regex(core, "[0-9a-z]$"))
        core = pc.if_else(cut, core, pc.if_else(plain, pc.ascii_lower(words), words))
        return core, pc.if_else(cut, pc.replace_substring_regex(words, _TAIL, r"\1"), "")

    def new_ids(self, parts: list[str]) -> list[np.ndarray]:
        if self.way != "parts":
            return self.encoded(parts)
        ids: list = [None] * len(parts)
        rest = []
        for i, part in enumerate(parts):
            if part.isalpha() and max(part) <= "\u00ff":  # one word of letters is one unit of the model, in the signs of its bytes
                signs = part.lower().encode().decode("latin-1").translate(_BYTE_SIGNS)
                ids[i] = np.array([t.id for t in self.model.tokenize(signs)], np.uint32)
            else:
                rest.append(i)
        for i, found in zip(rest, self.encoded([parts[i] for i in rest]), strict=True):
            ids[i] = found
        return ids

    def looked_up(self, parts: pa.Array) -> np.ndarray:
        """Where each of ``parts`` is in the table, which holds all of them afterwards."""
        coded = parts.dictionary_encode()
        distinct, table = coded.dictionary, self.table
        at = table.find(distinct)
        if table.nbytes > table.limit:  # only what these texts have stays
            table.keep(at[at >= 0])
            at = table.find(distinct)
        if (at < 0).any():
            new = distinct.filter(pa.array(at < 0))
            at[at < 0] = len(table.sizes) + np.arange(len(new))
            table.add(new, self.new_ids(strings(new)))
        return at[np.asarray(coded.indices, dtype=np.int64)]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text begins."""
        if self.way == "texts":
            ids = self.encoded(pc.fill_null(texts.cast(pa.large_string()), "").to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])
        codes, offsets, words = split_words(texts)
        words = words.cast(pa.large_string())
        if self.way == "parts":
            core, tail = self.parts(words)
            found = self.looked_up(pa.concat_arrays([core, tail]))
            found = np.stack([found[: len(words)], found[len(words) :]], axis=1)
        else:
            found = self.looked_up(words)[:, None]
        sizes = self.table.sizes
        of_word = self.table.ids[_chosen(sizes, found.ravel())]
        n = sizes[found].sum(axis=1)
        ends = np.concatenate([[0], np.cumsum(n[codes])])
        return of_word[_chosen(n, codes)], ends[offsets]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece, with the task and the piece's number among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        encoder, seen = WordTokenizer(tokenizer), np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in blocks(batch, 1, BLOCK_BYTES):
                ids, begins = encoder.texts(part.column(1))
                flat = np.insert(ids, begins[1:], END_ID).astype("<u4")
                whole = np.diff(begins) + 1
                n = -(-whole // capacity)
                row = np.repeat(np.arange(part.num_rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(whole[row] - start, capacity)
                ends = np.cumsum(length)
                crc = [zlib.crc32(flat[a:b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
                # numbers of equal lengths follow each other
                order = np.argsort(length, kind="stable")
                first = np.flatnonzero(np.diff(length[order], prepend=-1))
                count = np.diff(first, append=len(order))
                own = np.empty(len(order), np.int64)
                own[order] = np.arange(len(order)) - np.repeat(first, count) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length)]
                columns += [pa.array(crc, pa.int64()), pa.array(own), pa.array(np.full(len(row), task, np.int32))]
                names = [id_col, "piece", "start", "length", "ids_crc32", "_own", "_task"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        hand_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, _own long, _task int"
    slim = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


@dataclass
class Run:
    """``count`` sequences that all hold the pieces of ``lengths`` in this order."""

    lengths: tuple[int, ...]
    count: int

    def room(self, capacity: int) -> int:
        return capacity - sum(self.lengths)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of sequences for ``counts`` pieces by length."""
    return _fill(_match({x: n for x, n in counts.items() if 3 * x > capacity}, capacity), counts, capacity)


def _match(large: dict[int, int], capacity: int) -> list[Run]:
    """Each time the longest open piece, with the longest open one that fits beside it if there is one."""
    left, open_, runs = dict(large), sorted(large), []
    while open_:
        a = open_[-1]
        at = bisect.bisect_right(open_, capacity - a) - 1
        if at < 0:
            n, lengths = left[a], (a,)
        elif open_[at] == a:
            n, lengths = left[a] // 2, (a, a)
            if not n:  # one piece of this length is left: its partner is the next shorter one
                lengths, n = ((a, open_[at - 1]), 1) if at else ((a,), 1)
        else:
            n, lengths = min(left[a], left[open_[at]]), (a, open_[at])
        runs.append(Run(lengths, n))
        for x in lengths:
            left[x] -= n
            if not left[x]:
                open_.remove(x)
    return runs


@dataclass
class _Gaps:
    """Open runs by the room they have left."""

    runs: dict[int, list[Run]] = field(default_factory=lambda: defaultdict(list))
    rooms: list[int] = field(default_factory=list)

    def add(self, run: Run, capacity: int) -> None:
        room = run.room(capacity)
        if not self.runs[room]:
            bisect.insort(self.rooms, room)
        self.runs[room].append(run)

    def tightest(self, length: int) -> Run | None:
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        run = self.runs[room].pop()
        if not self.runs[room]:
            del self.rooms[at]
        return run


def _fill(matched: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    gaps = _Gaps()
    for run in matched:
        gaps.add(run, capacity)
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        left = counts[length]
        while left:
            run = gaps.tightest(length) or Run((), left)
            # the gap stays the tightest one until it takes no more of this length
            each = run.room(capacity) // length
            whole = min(run.count, left // each)
            if whole:
                gaps.add(Run(run.lengths + (length,) * each, whole), capacity)
            left -= whole * each
            rest = run.count - whole
            if rest and left:  # one sequence takes the last pieces of this length
                gaps.add(Run(run.lengths + (length,) * left, 1), capacity)
                left, rest = 0, rest - 1
            if rest and run.lengths:
                gaps.add(Run(run.lengths, rest), capacity)
    return [r for runs in gaps.runs.values() for r in runs]


class Places:
    """Where the k-th piece of each length goes."""

    def __init__(self, runs: list[Run]):
        found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        first, taken = 0, defaultdict(int)
        for run in runs:
            offset = 0
            for length in dict.fromkeys(run.lengths):
                each = run.lengths.count(length)
                found[length].append((taken[length], first, each, offset))
                taken[length] += each * run.count
                offset += each * length
            first += run.count
        self.tables = {x: np.array(rows, dtype=np.int64).T for x, rows in found.items()}
        self.sequences = first

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in np.unique(length).tolist():
            here = length == x
            begins, first, each, start = self.tables[x]
            at = np.searchsorted(begins, number[here], side="right") - 1
            inside = number[here] - begins[at]
            sequence[here] = first[at] + inside // each[at]
            offset[here] = start[at] + inside % each[at] * x
        return sequence, offset


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]): one row per piece.

    ``tokenizer`` is the path of a vocabulary file that all executors can read.
    """
    pieces = written(tokenized_pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), "pieces")
    sizes = pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = sizes.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))
    numbered = pieces.join(starts, ["_task", "length"]).withColumn("_number", F.col("_own") + F.col("_before"))
    outputs = [id_col, "piece", "start", "length", "ids_crc32"]
    extra = ["ids"] if with_ids else []

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places.value.of(np.asarray(batch["length"]), np.asarray(batch["_number"]))
            columns = [batch[c] for c in outputs] + [pa.array(a) for a in at] + [batch[c] for c in extra]
            yield pa.RecordBatch.from_arrays(columns, names=[*outputs, "sequence_id", "offset", *extra])

    schema = numbered.select(*outputs, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *extra).schema
    return numbered.select(*outputs, "_number", *extra).mapInArrow(placed, schema)
