"""Language identification by string kernels: Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of n-grams of 1 to 4 bytes that both have (blended spectrum,
presence only), divided by the root of the product of their own numbers.  n-grams are those of the
lower-cased UTF-8 text, hashed to ``GRAMS`` numbers, so that a text is a set of bounded size.

``LANDMARKS`` texts, spread over the languages, stand for the whole kernel matrix: a text is described by
its kernel values with them, and ridge regression in the space they span gives one function per language.
Values of a block of texts are one matrix product (presence by landmarks), scores a second one.

What is learnt from is bounded: ``SAMPLE`` texts, an equal number per language, the first by a hash of
the id.  Their n-grams are found on the executors; the driver gets bit sets of the landmarks (8 KB each) and
one vector per text of the sample.

Cases: a null text or one without a letter is ``und`` with score 0; a text that shares no n-gram with any
landmark gets the language with most texts; rows without a language or an id are not learnt from; a language
known from one text alone is learnt like others; without any labelled text all are ``und``; repeated rows are
scored alike; an empty table gives an empty table; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import blocks, mix64, written

#: lengths of n-grams in bytes
SPECTRUM = (1, 2, 3, 4)
GRAMS = 1 << 16
LANDMARKS, SAMPLE = 96, 8_000
#: texts per matrix product, and bytes of text held as Python objects or hashed at once
BLOCK_TEXTS, BLOCK_BYTES = 64, 1_000_000
RIDGE = 1.0
UNKNOWN = "und"
_LETTER = r"\pL"


def presence(texts: list[bytes], out: np.ndarray) -> np.ndarray:
    """Marks in ``out`` (texts by n-grams, zeroed here) which n-grams each text has."""
    out = out[: len(texts)]
    out[:] = 0
    for row, text in zip(out, texts, strict=True):
        for start in range(0, len(text), BLOCK_BYTES):  # pieces overlap, so that no n-gram is lost
            data = np.frombuffer(text[start : start + BLOCK_BYTES + SPECTRUM[-1] - 1], np.uint8).astype(np.uint64)
            packed = data
            for n in SPECTRUM:
                if n > 1:
                    packed = (packed[:-1] << np.uint64(8)) | data[n - 1 :]
                row[mix64(packed + np.uint64(n << 40)) >> np.uint64(48)] = 1
    return out


def lowered(texts: pa.Array) -> list[bytes]:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary()).to_pylist()


@dataclass
class Landmarks:
    """The landmarks' n-grams as bit sets, unpacked once per task."""

    bits: np.ndarray  # landmarks x GRAMS / 8

    def __post_init__(self):
        self.matrix, self.buffer = None, None

    def __getstate__(self):
        return {"bits": self.bits, "matrix": None, "buffer": None}

    def values(self, texts: list[bytes]) -> np.ndarray:
        """Kernel values, texts by landmarks."""
        if self.matrix is None:
            self.matrix = np.unpackbits(self.bits, axis=1).astype(np.float32).T.copy()
            self.own = np.maximum(self.matrix.sum(0), 1)
            self.buffer = np.empty((BLOCK_TEXTS, GRAMS), np.float32)
        out = np.empty((len(texts), len(self.bits)), np.float32)
        for i in range(0, len(texts), BLOCK_TEXTS):
            held = presence(texts[i : i + BLOCK_TEXTS], self.buffer)
            out[i : i + BLOCK_TEXTS] = held @ self.matrix / np.sqrt(np.maximum(held.sum(1, keepdims=True), 1) * self.own)
        return out

    def between(self) -> np.ndarray:
        sets = np.unpackbits(self.bits, axis=1).astype(np.float32)
        own = np.maximum(sets.sum(1), 1)
        return (sets @ sets.T / np.sqrt(np.outer(own, own))).astype(np.float64)


def ridge(values: np.ndarray, classes: np.ndarray, n_classes: int, between: np.ndarray, penalty: float = RIDGE) -> np.ndarray:
    """(landmarks + 1) x classes: minimises squared error + penalty * squared norm in the landmarks' space.

    The last row is the constant, which is not penalised.
    """
    x = np.hstack([values.astype(np.float64), np.ones((len(values), 1))])
    y = np.eye(n_classes)[classes]
    m = len(between)
    norm = np.zeros((m + 1, m + 1))
    norm[:m, :m] = penalty * (between + 1e-6 * np.eye(m))  # equal landmarks would make it singular
    return np.linalg.solve(x.T @ x + norm + 1e-9 * np.eye(m + 1), x.T @ y)


@dataclass
class LanguageModel:
    landmarks: Landmarks
    weights: np.ndarray
    languages: list[str]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        scored = np.asarray(pc.match_substring_regex(plain, _LETTER), dtype=bool) if len(plain) else np.zeros(0, bool)
        names, scores = np.full(len(plain), UNKNOWN, dtype=object), np.zeros(len(plain))
        if self.languages and scored.any():
            values = self.landmarks.values(lowered(plain.filter(pa.array(scored))))
            f = np.clip(values @ self.weights[:-1] + self.weights[-1], 1e-9, 1.0)
            names[scored] = np.array(self.languages, dtype=object)[f.argmax(1)]
            scores[scored] = f.max(1) / f.sum(1)
        return names.tolist(), scores


def language_sample(docs: DataFrame, learn: Column, lang_col: str, id_col: str, text_col: str, most: int) -> tuple[DataFrame, list[str]]:
    """(lang, rank, text) of an equal number of texts per language, and the languages, most frequent first.

    ``learn`` says, of the column ``id``, which rows may be looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & learn & F.col("text").rlike(r"\p{L}"))
    held = rows.groupBy("lang").count().collect()  # one row per language
    languages = [r.lang for r in sorted(held, key=lambda r: (-r["count"], r.lang))]
    each = max(1, most // max(1, len(languages)))
    # a hash below the share that has twice the texts wanted: the sort is as large as the sample, whatever the table
    share = F.create_map(*[x for r in held for x in (F.lit(r.lang), F.lit((2.0 * each + 50) / r["count"]))]) if held else None
    if held:
        drawn = F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 40)) / float(1 << 40)
        rows = rows.where(drawn < share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 40)), "id", "hash")
    ranked = rows.select("id", "lang", F.xxhash64("text").alias("hash")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    same = ["id", "lang", "hash"]
    chosen = ranked.groupBy(*same).agg(F.min("rank").alias("rank"))
    found = rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), same)  # at most ``most`` short rows
    return written(found.groupBy(*same, "rank").agg(F.min("text").alias("text")).select("lang", "rank", "text"), "languages"), languages


def fit(sample: DataFrame, languages: list[str], landmarks: int, penalty: float = RIDGE) -> LanguageModel:
    """The model of a bounded sample."""
    if not languages:
        return LanguageModel(Landmarks(np.zeros((0, GRAMS // 8), np.uint8)), np.zeros((1, 0)), [])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = np.empty((1, GRAMS), np.uint8)
        for batch in batches:
            sets = [np.packbits(presence([text], buffer)[0]).tobytes() for text in lowered(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["rank"], pa.array(sets, pa.binary())], names=["lang", "rank", "bits"])

    each = max(1, landmarks // len(languages))
    chosen = sample.where(F.col("rank") <= each).mapInArrow(bits, "lang string, rank int, bits binary").collect()
    chosen.sort(key=lambda r: (r.lang, r.rank))
    marks = Landmarks(np.frombuffer(b"".join(r.bits for r in chosen), np.uint8).reshape(len(chosen), -1))
    shipped = sample.sparkSession.sparkContext.broadcast(marks)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(i, BLOCK_TEXTS)
                rows = pa.array([v.tobytes() for v in shipped.value.values(lowered(part["text"]))], pa.binary())
                yield pa.RecordBatch.from_arrays([part["lang"], part["rank"], rows], names=["lang", "rank", "vector"])

    rows = sample.mapInArrow(vectors, "lang string, rank int, vector binary").collect()  # bounded by the sample
    rows.sort(key=lambda r: (r.lang, r.rank))
    values = np.frombuffer(b"".join(r.vector for r in rows), np.float32).reshape(len(rows), -1)
    number = {name: i for i, name in enumerate(languages)}
    classes = np.array([number[r.lang] for r in rows])
    return LanguageModel(marks, ridge(values, classes, len(languages), marks.between(), penalty), languages)


def identify(
    docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", landmarks: int = LANDMARKS,
    sample: int = SAMPLE, outputs: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """All columns of ``docs`` and ``outputs``: the predicted language and its share of all languages' scores."""
    texts, languages = language_sample(docs, learn, lang_col, id_col, text_col, sample)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, languages, landmarks))
    kept = [c for c in docs.columns if c not in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col, BLOCK_BYTES):
                names, scores = model.value.predict(part[text_col])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*kept, *outputs])

    schema = docs.select(*kept).withColumns({outputs[0]: F.lit(""), outputs[1]: F.lit(0.0)}).schema
    return docs.select(*kept).mapInArrow(run, schema)
