"""SentencePiece encoding and decoding with a streaming Viterbi search.

The vocabulary is a public pair-merge model.  Its segmentation of a text is the only one in which
every two neighbouring pieces are the segmentation of their own two strings; hence the search has, for
every end position, exactly one surviving piece, the one whose left neighbour is the survivor where it
begins and whose pair with it is stable.  This replaces a sum of scores, which would give other ids
than the model's own merges.

The search keeps a window: no back pointer reaches further than the longest piece, and as soon as all
back pointers of the open positions lead through one boundary, the ids before it are committed and
forgotten.  Between two characters that stand side by side in no piece there always is such a boundary,
so that texts fall into short stretches; a stretch is searched only where a task hasn't met it yet.  A
text without such places streams through the window.

A character that is no piece becomes its UTF-8 bytes' pieces.  Decoding joins the pieces, turns byte
pieces back to bytes and drops the blank that encoding put in front.

Cases: null and empty texts have no ids; characters outside the vocabulary are encoded by bytes; a null
id is carried as it is; repeated rows are encoded once each; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import blocks, byte_texts, strings

BLANK = "▁"
#: stretches whose ids, and pairs whose stability, a task remembers
REMEMBERED = 500_000
BLOCK_BYTES = 16_000_000


class Codec:
    """The pieces of a model file, its pair test, encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.ids), default=1)
        #: characters that stand side by side in a piece
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: lengths of the pieces by their last two characters
        self.lengths: dict[str, list[int]] = {}
        for p in self.ids:
            if len(p) > 1 and len(p) not in self.lengths.setdefault(p[-2:], []):
                self.lengths[p[-2:]].append(len(p))
        self.spines: dict[str, tuple[list[str], list[str]]] = {}
        self.stable: dict[tuple[str, str], bool] = {}
        self.stretches: dict[str, bytes] = {}
        # what each id says, as bytes one after another
        said = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            said[i] = bytes([b])
        self.said_sizes = np.fromiter(map(len, said), dtype=np.int64, count=n)
        self.said_begins = np.cumsum(self.said_sizes) - self.said_sizes
        self.said = np.frombuffer(b"".join(said), dtype=np.uint8)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Pair merges, best score first, leftmost among equals, until ``least`` parts are left: for short strings."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, piece: str) -> tuple[list[str], list[str]]:
        """What a piece begins with and what it ends with, from a character to the whole, merge by merge."""
        known = self.spines.get(piece)
        if known is None:
            if len(piece) == 1:
                known = ([piece], [piece])
            else:
                left, right = self.merged(piece, 2)
                known = ([*self.spine(left)[0], piece], [*self.spine(right)[1], piece])
            self.spines[piece] = known
        return known

    def is_stable(self, left: str, right: str) -> bool:
        """Whether the merges of the two strings together leave the place between them alone."""
        pair = (left, right)
        known = self.stable.get(pair)
        if known is None:
            if len(self.stable) > REMEMBERED:
                self.stable.clear()
            known = self.stable[pair] = left[-1] + right[0] not in self.beside or self._is_stable(left, right)
        return known

    def _is_stable(self, left: str, right: str) -> bool:
        if BLANK * 2 in left + right:  # several pieces of blanks share one score
            return self.merged(left + right) == [left, right]
        ending, beginning, score = self.spine(left)[1], self.spine(right)[0], self.score
        i = j = 0
        never = -float("inf")
        while True:  # a piece's parts have better scores than itself, so both sides grow in the order of their scores
            across = score.get(ending[i] + beginning[j])
            grow_left = score[ending[i + 1]] if i + 1 < len(ending) else never
            grow_right = score[beginning[j + 1]] if j + 1 < len(beginning) else never
            # among equal scores the leftmost merge comes first
            if across is not None and across > grow_left and across >= grow_right:
                return False
            if grow_left == never and grow_right == never:
                return True
            if grow_left >= grow_right:
                i += 1
            else:
                j += 1

    def _survivor(self, window: str, ends: list[str | None], at: int) -> str | None:
        """The piece that survives with its end at ``at``, from the survivors before."""
        left, char = ends[at - 1], window[at - 1]
        # a single character survives even where it is no piece
        if left is not None and (not left or self.is_stable(left, char)):
            return char
        for size in self.lengths.get(window[at - 2 : at], ()):
            left = ends[at - size] if size <= at else None
            if left is not None:
                piece = window[at - size : at]
                if piece in self.ids and (not left or self.is_stable(left, piece)):
                    return piece
        return None

    def survivors(self, text: Iterator[str]) -> Iterator[str]:
        """The pieces of a stream of characters, committed as soon as they are certain."""
        window, ends = "", [""]  # the open characters; for each position, the surviving piece that ends there
        for char in text:
            window += char
            at = len(window)
            ends.append(self._survivor(window, ends, at))
            if at >= 2 * self.longest:
                # the open positions are those that a later piece can begin at; do their paths meet in one boundary?
                met = self._meet(ends, at)
                if met:
                    yield from self._path(ends, met)
                    window = window[met:]
                    ends = ends[met:]
        yield from self._path(ends, len(window))

    def _meet(self, ends: list[str | None], at: int) -> int:
        open_ = {p for p in range(at - self.longest + 1, at + 1) if ends[p] is not None}
        while len(open_) > 1:
            last = max(open_)
            if not last:
                return 0
            open_.discard(last)
            open_.add(last - len(ends[last]))
        return open_.pop() if open_ else 0

    @staticmethod
    def _path(ends: list[str | None], at: int) -> list[str]:
        path = []
        while at > 0:
            path.append(ends[at])
            at -= len(ends[at])
        return path[::-1]

    def numbers(self, pieces: list[str]) -> bytes:
        """The ids of pieces, as 32-bit little-endian numbers."""
        out: list[int] = []
        for piece in pieces:
            found = self.ids.get(piece)
            out += [found] if found is not None else [self.byte_ids[b] for b in piece.encode()]
        return struct.pack(f"<{len(out)}i", *out)

    def search(self, texts: list[str]) -> dict[str, bytes]:
        """The ids of stretches in sorted order: one that begins like the one before resumes its search there."""
        found, before, ends = {}, "", [""]
        for text in texts:
            if len(text) > 2 * self.longest:
                found[text] = self.numbers(list(self.survivors(iter(text))))
                continue
            same, most = 0, min(len(before), len(text))
            while same < most and before[same] == text[same]:
                same += 1
            del ends[same + 1 :]
            for at in range(same + 1, len(text) + 1):
                ends.append(self._survivor(text, ends, at))
            before, found[text] = text, self.numbers(self._path(ends, len(text)))
        return found

    def cut(self, marked: str) -> list[str]:
        """The stretches of a text in which blanks are marked: no piece holds the two characters at a cut."""
        beside = self.beside
        at = [i for i, (a, b) in enumerate(zip(marked, marked[1:], strict=False), 1) if a + b not in beside]
        return [marked[a:b] for a, b in zip([0, *at], [*at, len(marked)], strict=True)] if at else [marked]

    def marked_all(self, texts: list[str]) -> list[bytes]:
        """The ids of texts in which blanks are marked."""
        cuts, known = [self.cut(t) for t in texts], self.stretches
        new = {x for parts in cuts for x in parts if x not in known}
        fresh = self.search(sorted(new))
        if len(known) + len(new) > REMEMBERED:
            self.stretches = known = {x: known[x] for parts in cuts for x in parts if x in known}
        known.update(fresh)
        out = [b"".join([known[x] for x in parts]) for parts in cuts]
        for x in fresh:
            if len(x) > 64:
                del known[x]
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return np.frombuffer(self.marked_all([BLANK + text.replace(" ", BLANK)])[0], dtype="<i4").tolist()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text begins."""
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(plain, " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, offsets = np.asarray(coded.indices, dtype=np.int64), offsets - offsets[0]
        words = strings(coded.dictionary)
        # a word's blank is its own only where no other one stands beside it; other texts are encoded as a whole
        bare = np.array([w == "" or BLANK in w for w in words], dtype=bool)[codes]
        odd = np.add.reduceat(bare, offsets[:-1]).astype(bool) if len(texts) else np.zeros(0, dtype=bool)
        sizes = np.diff(offsets)
        codes, sizes = codes[~np.repeat(odd, sizes)], np.where(odd, 0, sizes)
        used = np.unique(codes)
        found = self.marked_all([BLANK + words[k] for k in used.tolist()])
        of_word = np.zeros(len(words), dtype=np.int64)
        of_word[used] = np.fromiter(map(len, found), dtype=np.int64, count=len(used)) // 4
        begins = np.cumsum(of_word) - of_word  # words that are not used have no ids
        ids, ends = gathered(np.frombuffer(b"".join(found), dtype="<i4"), begins[codes], of_word[codes])
        cuts = ends[np.concatenate([[0], np.cumsum(sizes)])]
        if odd.any():
            parts = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.array(self.encode(plain[i].as_py()), dtype=np.int32)
            ids, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, cuts

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes that the ids of each text say."""
        said, ends = gathered(self.said, self.said_begins[ids], self.said_sizes[ids])
        data, at = said.tobytes(), ends[cuts].tolist()
        return [data[a + 1 : b] if data[a : a + 1] == b" " and b > a else data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        flat = np.array(ids, dtype=np.int64)
        return self.decode_all(flat, np.array([0, len(flat)]))[0].decode("utf-8", "replace")


def gathered(table: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``table`` one after another, and where each begins and the last ends."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return table[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])], ends


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, n_ids, restored): ``restored`` says whether decoding gives the text back.

    The sign that stands for blanks can't be told from a blank after encoding; a text that holds it is
    restored with blanks in those places.  ``model`` is a file that all executors can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for part in blocks(batch, 1, BLOCK_BYTES):
                ids, cuts = codec.encode_all(part.column(1))
                back = codec.decode_all(ids, cuts)
                sign = BLANK.encode()
                restored = [a == b or a == b.replace(sign, b" ") for a, b in zip(back, byte_texts(part.column(1)), strict=True)]
                column = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(np.diff(cuts)), pa.array(restored)], names=[id_col, "ids", "n_ids", "restored"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_ids long, restored boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) from (id_col, ids); null ids are no ids, ids outside the vocabulary an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            cuts = np.asarray(lists.offsets, dtype=np.int64)
            flat = np.asarray(lists.flatten(), dtype=np.int64)
            texts = [t.decode("utf-8", "replace") for t in codec.decode_all(flat, cuts - cuts[0])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
