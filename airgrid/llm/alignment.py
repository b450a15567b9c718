"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizers read the whole text first.  Where a token of each ends at the same byte and the next token
of each begins with a space, the text is cut; the offsets are compared, so that only *verified* shared ends
cut it.  Between two such anchors lies a window, a pair of short id tuples, which repeats as words do: the
distinct windows of a block of documents are found first, each is aligned once per task and remembered by
its id tuples (bounded; a forgotten window is aligned again).

Inside a window the byte ends of both sides are merged: each end they share closes a group, and the two
tokens that end there are linked.

How often an id pair is linked in the whole corpus can't be known while the texts are read.  Each block
of documents writes its documents as window numbers and, once, its windows as pairs with their counts; the
pairs are added up over all blocks, each id's most frequent partner is found, and the results go back to the
blocks by block number, where documents add up their windows.  No row per token or link is shuffled,
and a frequent pair has one row per block.

Cases: null and empty texts, and texts whose tokens don't spell them (a text that has U+2581, say), have no
tokens: zeros and an empty string; null and repeated ids and repeated rows are aligned on their own, and all
of them count; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import blocks, written
from airgrid.llm.packing import _BYTE_SIGNS

#: bytes of text per block, and per call of the tokenizers
BLOCK_BYTES = 6_000_000
#: windows that a task remembers
REMEMBERED = 100_000
#: parts the ids of a window's two sides; no id of either vocabulary
_PARTED = 0xFFFF
#: how the byte-level vocabulary cuts texts before it merges: the public pattern of its kind
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: a run of so much white space goes to the library that has no limit for it
SPACES_FROM = 20_000
_SPACES = re.compile(r"\s{%d}" % SPACES_FROM)


class ByteLevel:
    """Ids and token bytes of a byte-level vocabulary file; strings of special tokens are plain text.

    Merges of such a vocabulary are numbered by rank, so that its ids are the ranks.  The file's own library
    reads the texts that the faster one can't (runs of white space too long for its pattern).
    """

    def __init__(self, path: str, pattern: str = BYTE_PATTERN):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte = {chr(sign): b for b, sign in _BYTE_SIGNS.items()}
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        size = 1 + max(self.whole.get_vocab().values())
        self.bytes = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= SPACES_FROM and _SPACES.search(text):
            return np.array(self.whole.encode(" " + text, add_special_tokens=False).ids)
        return self.fast.encode_to_numpy(" " + text, disallowed_special=())


class Pieces:
    """Ids and token bytes of a SentencePiece model that adds a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


class Spelling:
    """The bytes of a vocabulary's tokens, one after another."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.space = np.array([t.startswith(b" ") for t in tokens])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spells(self, ids: np.ndarray, text: bytes, step: int = 200_000) -> bool:
        done = 0
        for i in range(0, len(ids), step):
            own = ids[i : i + step]
            size = self.length[own]
            ends = np.cumsum(size)
            at = np.repeat(self.start[own] - ends + size, size) + np.arange(ends[-1])
            if self.flat[at].tobytes() != text[done : done + len(at)]:
                return False
            done += len(at)
        return done == len(text)


#: the alignment of one window: its groups as text, and A id << 16 | B id of each link as 32-bit numbers
Aligned = tuple[str, bytes]


class Aligner:
    """Aligns texts of one task and remembers windows."""

    def __init__(self, a, b, remembered: int = REMEMBERED):
        self.a, self.b, self.limit = a, b, remembered
        self.spelling_a, self.spelling_b = Spelling(a.bytes), Spelling(b.bytes)
        self.known: dict[bytes, Aligned] = {}
        self.aligned = 0  # how many windows had to be worked out
        # decimal ids with what follows them inside a group, at its end, and (side B) at a window's end
        self.text_a = [np.array([f"{i}{sign}" for i in range(len(a.bytes))], dtype=object) for sign in ",|"]
        self.text_b = [np.array([f"{i}{sign}" for i in range(len(b.bytes))], dtype=object) for sign in (",", ";", "")]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both sides, none where either doesn't spell the text."""
        none = np.zeros(0, np.uint16)
        if not text:
            return none, none
        spelt = (" " + text).encode()
        a = self.a.encode(text).astype(np.uint16)
        if not self.spelling_a.spells(a, spelt):
            return none, none
        b = self.b.encode(text).astype(np.uint16)
        return (a, b) if self.spelling_b.spells(b, spelt) else (none, none)

    def work_out(self, keys: list[bytes]) -> list[Aligned]:
        """Merges the byte ends of both sides of some windows, all of them at once.

        Both sides of a window have the same number of bytes, so that ends added up over all windows
        meet where they meet inside the windows.
        """
        flat = np.frombuffer(b"".join(keys), np.uint16)
        sizes = np.fromiter(map(len, keys), np.int64, len(keys)) // 2
        window, parted = np.repeat(np.arange(len(keys)), sizes), np.flatnonzero(flat == _PARTED)[np.repeat(np.arange(len(keys)), sizes)]
        left, right = np.arange(len(flat)) < parted, np.arange(len(flat)) > parted
        a, b, of_a, of_b = flat[left].astype(np.int64), flat[right].astype(np.int64), window[left], window[right]
        ends_a, ends_b = np.cumsum(self.spelling_a.length[a]), np.cumsum(self.spelling_b.length[b])
        near = np.searchsorted(ends_b, ends_a)
        closes_a = ends_b[near] == ends_a
        last_a, last_b = np.flatnonzero(closes_a), near[closes_a]
        closes_b = np.zeros(len(b), np.int64)
        closes_b[last_b] = 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        closes_b[np.flatnonzero(np.diff(of_b, append=-1))] = 2  # the window's end
        texts = np.empty(len(a) + len(b), dtype=object)
        texts[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = np.where(closes_a, self.text_a[1][a], self.text_a[0][a])
        texts[np.arange(len(b)) + last_a[group_b] + 1] = np.choose(closes_b, [t[b] for t in self.text_b])
        pairs = (a[last_a] << 16 | b[last_b]).astype("<u4").tobytes()
        ends = np.cumsum(sizes - 1).tolist()
        links = (4 * np.cumsum(np.bincount(of_a[last_a], minlength=len(keys)))).tolist()
        texts = texts.tolist()
        return [
            ("".join(texts[x:y]), pairs[u:v])
            for x, y, u, v in zip([0, *ends], ends, [0, *links], links, strict=False)
        ]

    def windows(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of each side the anchors have before them; the ends of documents are anchors too.

        ``last_a`` and ``last_b`` are the token counts up to the end of each document.
        """
        sides = []
        for ids, side, last in ((a, self.spelling_a, last_a), (b, self.spelling_b, last_b)):
            marked = np.zeros(len(ids) + 1, dtype=bool)
            marked[:-1] = side.space[ids]
            marked[last] = True
            marked[0] = False
            sides.append((np.cumsum(side.length[ids]), np.flatnonzero(marked)))
        (ends_a, at_a), (ends_b, at_b) = sides
        ends_b = ends_b[at_b - 1]
        near = np.searchsorted(ends_b, ends_a[at_a - 1])
        shared = ends_b[np.minimum(near, len(ends_b) - 1)] == ends_a[at_a - 1] if len(ends_b) else np.zeros(0, bool)
        return at_a[shared], at_b[near[shared]]

    def keys(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> pa.Array:
        """Every window as the bytes of its ids: side A, a parting number, side B."""
        n = len(cut_a)
        size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        number = np.arange(n)
        flat = np.empty(len(a) + len(b) + n, np.uint16)
        flat[np.arange(len(a)) + np.repeat(cut_b - size_b + number, size_a)] = a
        flat[cut_a + cut_b - size_b + number] = _PARTED
        flat[np.arange(len(b)) + np.repeat(cut_a + number + 1, size_b)] = b
        offsets = np.concatenate([[0], 2 * (cut_a + cut_b + number + 1)]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

    def remember(self, keys: list[bytes]) -> list[Aligned]:
        """The alignment of each window, worked out where it isn't remembered."""
        known = self.known
        new = [k for k in keys if k not in known]
        self.aligned += len(new)
        if len(known) + len(new) > self.limit:  # only what this block has had stays
            known = {k: known[k] for k in keys if k in known}
        found = dict(zip(new, self.work_out(new), strict=True)) if new else {}
        out = [known[k] if k in known else found[k] for k in keys]
        for k in new[: max(0, self.limit - len(known))]:
            known[k] = found[k]
        self.known = known
        return out

    def block(self, texts: list[str]) -> dict:
        """All that a block of documents writes: columns per document, and its windows as pairs."""
        all_a, all_b, n_a, n_b = [], [], [], []
        for text in texts:
            a, b = self.tokens(text)
            all_a.append(a)
            all_b.append(b)
            n_a.append(len(a))
            n_b.append(len(b))
        a, b = (np.concatenate(side) if side else np.zeros(0, np.uint16) for side in (all_a, all_b))
        n_a, n_b = np.array(n_a, np.int64), np.array(n_b, np.int64)
        cut_a, cut_b = self.windows(a, b, np.cumsum(n_a), np.cumsum(n_b))
        coded = self.keys(a, b, cut_a, cut_b).dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        distinct = self.remember(coded.dictionary.to_pylist())
        of_doc = np.searchsorted(cut_a, np.concatenate([[0], np.cumsum(n_a)]), side="right")
        strings = [w[0] for w in distinct]
        digests = []
        for x, y in zip(of_doc[:-1].tolist(), of_doc[1:].tolist(), strict=True):
            joined = ";".join(map(strings.__getitem__, codes[x:y].tolist()))
            digests.append(hashlib.sha256(joined.encode()).hexdigest() if joined else "")
        sizes = np.fromiter((len(w[1]) for w in distinct), np.int64, len(distinct)) // 4
        groups = np.concatenate([[0], np.cumsum(sizes[codes])]) if len(codes) else np.zeros(1, np.int64)
        pairs, of_pair = np.unique(np.frombuffer(b"".join(w[1] for w in distinct), "<u4"), return_inverse=True)
        often = np.bincount(codes, minlength=len(distinct)) if len(distinct) else np.zeros(0, np.int64)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": groups[of_doc[1:]] - groups[of_doc[:-1]], "groups_sha256": digests,
            "windows": [codes[x:y].astype("<u4").tobytes() for x, y in zip(of_doc[:-1], of_doc[1:], strict=True)],
            "pairs": pairs, "times": np.bincount(of_pair, weights=np.repeat(often, sizes), minlength=len(pairs)).astype(np.int64),
            "window_pairs": of_pair.astype("<u4"), "window_ends": np.cumsum(sizes).astype("<u4"),
        }


_DOCUMENT = "n_a long, n_b long, n_groups long, groups_sha256 string, windows binary"
_BLOCK = "pairs binary, times binary, window_pairs binary, window_ends binary"


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, remembered: int) -> DataFrame:
    """One row per document and one per block (``block_row``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "block", "block_row", *(c.split()[0] for c in f"{_DOCUMENT}, {_BLOCK}".split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteLevel(path_a), Pieces(path_b), remembered)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch, 1, BLOCK_BYTES):
                made = aligner.block(pc.fill_null(part.column(1), "").to_pylist())
                n = part.num_rows
                own = [part.column(0), pa.array(np.full(n, number)), pa.array(np.zeros(n, bool))]
                own += [pa.array(made[c]) for c in ("n_a", "n_b", "n_groups")] + [pa.array(made["groups_sha256"], pa.string())]
                own += [pa.array(made["windows"], pa.binary())] + [pa.nulls(n, pa.binary())] * 4
                yield pa.RecordBatch.from_arrays(own, names=names)
                rest = [pa.nulls(1, part.column(0).type), pa.array([number]), pa.array([True])] + [pa.nulls(1, pa.int64())] * 3
                rest += [pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
                rest += [pa.array([made[c].tobytes()], pa.binary()) for c in ("pairs", "times", "window_pairs", "window_ends")]
                yield pa.RecordBatch.from_arrays(rest, names=names)
                number += 1

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, block long, block_row boolean, {_DOCUMENT}, {_BLOCK}")


def block_pairs(made: DataFrame) -> DataFrame:
    """(block, code, pair, n): the pairs of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, times in zip(*(batch[c].to_pylist() for c in ("block", "pairs", "times")), strict=True):
                pair, n = np.frombuffer(pairs, np.uint32), np.frombuffer(times, np.int64)
                columns = [np.full(len(pair), block), np.arange(len(pair), dtype=np.int32), pair.astype(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "code", "pair", "n"])

    return made.where("block_row").select("block", "pairs", "times").mapInArrow(run, "block long, code int, pair long, n long")


def link_counts(pairs: DataFrame) -> DataFrame:
    """(pair, total, is_best): links of each id pair in all documents, and whether its B id has none more frequent."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFF))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("is_best"))


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per document.

    ``path_a`` is a byte-level vocabulary file, ``path_b`` a SentencePiece model that adds a space; executors
    can read both.
    """
    made = written(aligned_blocks(docs, path_a, path_b, id_col, text_col, remembered), "aligned")
    pairs = written(block_pairs(made), "pairs")
    counted = pairs.select("block", "code", "pair").join(link_counts(pairs), "pair").select("block", "code", "total", "is_best")
    outputs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def add_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        own, docs = (rows.filter(pc.equal(rows["block_row"], value)) for value in (True, False))
        code = np.asarray(found["code"])
        total, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        total[code], best[code] = np.asarray(found["total"]), np.asarray(found["is_best"]).astype(np.int64)
        used = np.frombuffer(own["window_pairs"][0].as_py(), "<u4")
        ends = np.frombuffer(own["window_ends"][0].as_py(), "<u4").astype(np.int64)
        sums = []
        for values in (total, best):
            before = np.concatenate([[0], np.cumsum(values[used])])
            of_window = np.diff(before[ends], prepend=0)
            sums.append([int(of_window[np.frombuffer(w, "<u4")].sum()) for w in docs["windows"].to_pylist()])
        columns = {"n_links": docs["n_groups"], "count_sum": pa.array(sums[0], pa.int64()), "n_best": pa.array(sums[1], pa.int64())}
        return pa.table([docs["id"]] + [columns.get(c, docs[c] if c in docs.column_names else None) for c in outputs], names=[id_col, *outputs])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    slim = made.drop("pairs", "times")
    return slim.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(add_up, schema)
