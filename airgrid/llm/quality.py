"""Quality classifier: the nearest labelled documents vote, by the cosine of latent-semantic vectors.

A document is a bag of terms: its byte pairs (hashed to ``PAIR_BITS`` bits) and what it repeats, as
pseudo-terms - the share of words that equal the word before, of words that are not new in the
document, and of lines that are not new, each in ``STEPS`` steps.  Term weights are square roots of
counts times the inverse document frequency over *all* documents.

The labelled documents that may be learnt from are cut to a bounded sample, at most ``PER_CLASS`` of
each label, by the order of a hash of their ids.  A truncated singular value decomposition of their
weighted term matrix gives the latent space.  The sample's vectors, at most 2 * PER_CLASS of ``RANK``
floats, and the projection have a fixed size and are broadcast; every document computes its cosines to
all of them in blocks and lets the ``NEIGHBOURS`` nearest vote with their label, weighted by similarity.

Cases: an empty or null text is a document without byte pairs; it has the vector of its pseudo-terms
and gets a score like any other; a document without id is scored but never learnt from; a document
with two labels counts as the lower one; with no label of a class at all every score is the share of
label 1 (0.5 without labels); an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import byte_texts, mapped, split_words
from airgrid.llm.training import allowed_labels, document_ids, first_by_hash, texts_of

PAIR_BITS = 11
STEPS = 16
TERMS = (1 << PAIR_BITS) + 3 * (STEPS + 1)
#: labelled documents of each class that are learnt from, at most
PER_CLASS = 3_000
RANK = 64
NEIGHBOURS = 200
#: similarities count with this power
SHARPNESS = 32
#: documents whose terms or cosines are held at once
BLOCK = 256


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of all terms, one row per text."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    raw = byte_texts(texts)
    for i, text in enumerate(raw):
        if len(text) > 1:
            data = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
            pair = ((data[:-1] << 8 | data[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - PAIR_BITS)
            out[i, : 1 << PAIR_BITS] = np.bincount(pair.astype(np.int64), minlength=1 << PAIR_BITS)
    codes, offsets, _ = split_words(texts)
    for i, text in enumerate(raw):
        own = codes[offsets[i] : offsets[i + 1]]
        words, lines = max(len(own), 1), text.split(b"\n")
        same = np.count_nonzero(own[1:] == own[:-1]) / words
        old = 1 - len(np.unique(own)) / words if len(own) else 0.0
        repeated = 1 - len(set(lines)) / len(lines)
        for j, share in enumerate((same, old, repeated)):
            # a text's pseudo-terms weigh as much as a fixed share of its byte pairs
            out[i, (1 << PAIR_BITS) + j * (STEPS + 1) + int(share * STEPS)] = max(len(text), 1) / 8
    return out


def document_counts(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are."""

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros(TERMS, dtype=np.int64)
        for i in range(0, batch.num_rows, BLOCK):
            counts += np.count_nonzero(term_counts(batch.column(0).slice(i, BLOCK)), axis=0)
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [np.append(at, -1), np.append(counts[at], batch.num_rows)], names=["term", "n"]
        )

    rows = mapped(docs.select(F.col(text_col).cast("string")), held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(TERMS, dtype=np.int64)  # one row per term
    total = 0
    for term, n in rows:
        if term < 0:
            total = n
        else:
            counts[term] = n
    return counts, total


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, id_col: str, text_col: str
) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most ``per_class`` documents of each label."""
    known = allowed_labels(labels, label, learn, "min").join(document_ids(docs, id_col), "id")
    chosen = {i: y for y in (0, 1) for i in first_by_hash(known.where(F.col("label") == y), per_class)}
    rows = texts_of(docs, list(chosen), id_col, text_col).toArrow().sort_by("id")
    return rows["text"].combine_chunks(), np.array([chosen[i] for i in rows["id"].to_pylist()], dtype=np.int64)


@dataclass
class LatentVotes:
    """The projection into the latent space and the labelled vectors in it."""

    weights: np.ndarray  # terms x rank, inverse document frequency included
    vectors: np.ndarray  # rank x labelled documents, of length 1
    labels: np.ndarray
    share: float

    def place(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts) @ self.weights
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled documents."""
        out = np.full(len(texts), self.share)
        if not 0 < self.labels.sum() < len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), BLOCK):
            cosines = self.place(term_counts(texts.slice(i, BLOCK))) @ self.vectors
            near = np.argpartition(cosines, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
            out[i : i + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def fit(texts: pa.Array, labels: np.ndarray, held: np.ndarray, total: int, rank: int = RANK) -> LatentVotes:
    share = float(labels.mean()) if len(labels) else 0.5
    idf = np.log((1 + total) / (1 + held)).astype(np.float32) + np.float32(0.1)
    if not len(labels):
        return LatentVotes(np.zeros((TERMS, 1), np.float32), np.zeros((1, 0), np.float32), labels, share)
    rows = np.concatenate([np.sqrt(term_counts(texts.slice(i, BLOCK))) for i in range(0, len(texts), BLOCK)])
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    # randomised subspace iteration for the leading right singular vectors
    q = np.linalg.qr(rows.T @ np.random.default_rng(7).standard_normal((len(rows), min(rank + 16, len(rows)))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(rows.T @ (rows @ q))[0]
    right = np.linalg.svd(rows @ q, full_matrices=False)[2][:rank] @ q.T
    model = LatentVotes(np.ascontiguousarray((right * idf).T, dtype=np.float32), np.zeros((0, 0), np.float32), labels.astype(np.float64), share)
    v = rows @ right.T
    model.vectors = np.ascontiguousarray((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T, dtype=np.float32)
    return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = PER_CLASS,
    rank: int = RANK,
    out: str = "score",
) -> DataFrame:
    """All columns of ``docs`` and ``out``: 0 to 1, higher where label 1 is likelier."""
    held, total = document_counts(docs, text_col)
    texts, marks = labelled_sample(docs, labels, label, learn, per_class, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, marks, held, total, rank))
    kept = [c for c in docs.columns if c != out]

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.score(batch[text_col]))], names=[*kept, out])

    return mapped(docs.select(*kept), scored, docs.select(*kept).withColumn(out, F.lit(0.0)).schema)
