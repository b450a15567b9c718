"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio or document.  A visitor flattens the parts,
in order, into text and placeholders; each placeholder stands for an attachment, whose reference and
number of tokens, once expanded, are recorded.  A template marks the turns:

    <|turn|>role<|says|>content<|end|>

The template's control strings, the placeholders and control strings of other formats that occur in a
text or role are escaped by the sign U+241B and a number, that sign itself too; ``unescaped`` undoes
this.  Hence the formatted text can be read back without loss, and the loss mask - the spans of all
that the assistant says - can be cut out of it.

The output has one row per turn, in order of turns; a conversation's text is what its rows say one
after another.  So a conversation of any length stays in bounded memory.

Cases: null text or role is the empty text; a turn without parts has its text as its only part; a null
part or one of unknown type is left out; turns are ordered by number (none first), then role, then
text, so that repeated turns keep a place; a null conversation id is a conversation of its own; an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
ESCAPE = "␛"
#: fixed values: what is escaped inside texts, by number; control strings of common formats among them
CONTROL = [
    ESCAPE, TURN, SAYS, END, "<|image|>", "<|audio|>", "<|document|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
]
_TO_ESCAPE = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_NUMBER = {c: f"{ESCAPE}{chr(ord('A') + i)}" for i, c in enumerate(CONTROL)}
_ESCAPED = re.compile(f"{ESCAPE}(.)", re.DOTALL)
_READ = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.DOTALL)

#: pixels of an image patch, milliseconds of an audio frame, characters of a document's token
PATCH, FRAME, CHARS = 14, 40, 4
PART = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("width", "height", "millis", "chars")]
)
ATTACHMENT = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType())]
)


def escaped(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _NUMBER[m[0]], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: CONTROL[ord(m[1]) - ord("A")], text)


@dataclass
class Flattened:
    """Visits parts in order and collects their text, placeholders and attachments."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    chars: int = 0

    def visit(self, part: dict | None) -> None:
        if part is not None and part["type"] in ("text", *PLACEHOLDERS):
            getattr(self, f"visit_{part['type']}")(part)

    def _put(self, text: str) -> None:
        self.pieces.append(text)
        self.chars += len(text)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"type": part["type"], "ref": part["ref"], "at": self.chars, "tokens": tokens})
        self._put(PLACEHOLDERS[part["type"]])

    def visit_text(self, part: dict) -> None:
        self._put(escaped(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        sides = [max(1, math.ceil((part[s] or 1) / PATCH)) for s in ("width", "height")]
        self._attach(part, sides[0] * sides[1])

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part["millis"] or 1) / FRAME)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part["chars"] or 1) / CHARS)))


def formatted_turn(role: str, parts: list[dict | None], learn_from: str) -> tuple[str, int, int, list[dict]]:
    """(formatted text, begin and end of the loss span in it, attachments with places in it)."""
    seen = Flattened()
    for part in parts:
        seen.visit(part)
    head, content = TURN + escaped(role) + SAYS, "".join(seen.pieces)
    for a in seen.attachments:
        a["at"] += len(head)
    span = (len(head), len(head) + len(content)) if role == learn_from else (0, 0)
    return head + content + END, *span, seen.attachments


FORMATTED = "pos long, formatted string, loss_from int, loss_to int, attachments array<struct<type string, ref string, at long, tokens long>>"


def format_turns(turns: DataFrame, learn_from: str = "assistant", id_col: str = "conv_id") -> DataFrame:
    """(id_col, pos, formatted, loss_from, loss_to, attachments): one row per turn, in order within its partition.

    ``turns`` has ``turn, role, text`` and may have ``parts``, an array of ``PART``.
    """
    own = F.col("parts") if "parts" in turns.columns else F.lit(None)
    rows = turns.select(
        F.col(id_col).cast("long").alias(id_col), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"), own.cast(T.ArrayType(PART)).alias("parts"),
    )
    dealt = rows.repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pos = object(), 0
        for batch in batches:
            out = []
            for conv, role, text, parts in zip(*(batch[c].to_pylist() for c in (id_col, "role", "text", "parts")), strict=True):
                pos = pos + 1 if conv == last else 0
                last = conv
                done = formatted_turn(role, parts or [{"type": "text", "text": text}], learn_from)
                out.append((conv, pos, *done))
            names = [id_col, "pos", "formatted", "loss_from", "loss_to", "attachments"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            kinds.append(pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, f"`{id_col}` long, {FORMATTED}")


def read_back(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn; placeholders stay in the text."""
    found = _READ.fullmatch(formatted)
    if found is None:
        raise ValueError("not one formatted turn")
    return unescaped(found[1]), unescaped(found[2])


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted turns say when read back, one row per conversation.

    The turns must come in order within their partition, as ``format_turns`` leaves them; a
    conversation's hashes grow turn by turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv, state = None, None

        def row() -> tuple:
            return (conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

        for batch in batches:
            out = []
            for own, pos, text, a, b in zip(*(batch[c].to_pylist() for c in (id_col, "pos", "formatted", "loss_from", "loss_to")), strict=True):
                if pos == 0:
                    if state is not None:
                        out.append(row())
                    conv, state = own, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                role, said = read_back(text)
                learnt = unescaped(text[a:b])
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
                state["loss_chars"] += len(learnt)
                state["loss"].update(learnt.encode())
                state["chars"] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), kinds, strict=True)], names=names)

    slim = formatted.select(id_col, "pos", "formatted", "loss_from", "loss_to")
    return slim.mapInArrow(run, f"`{id_col}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
