"""Toxicity by non-negative positive-unlabelled learning: numpy classifiers from confirmed toxic texts and unlabelled ones.

Only "confirmed toxic" is learnt from a label; all other training texts count as unlabelled, toxic ones
among them.  With the share of toxic texts (the class prior) p, the risk of calling a text clean is
estimated as R_u - p * R_p, the unlabelled risk minus what the hidden toxic texts add to it; where that
estimate turns negative the classifier is fitting single texts, and the step goes the other way
(non-negative correction).

A text is the bag of its words without punctuation at their end, A-Z lower-cased: each word counts as
itself, to its end, and by its beginnings of ``PREFIXES`` bytes, hashed to ``BITS`` bits.  A run without
white space counts as a whole, by the parts between its punctuation and, where a part is longer than
``LONGEST`` bytes or has characters of three bytes or more (Chinese, Japanese, Thai), by windows of
``WINDOW`` bytes from each of its characters on, so that every byte reaches features that don't depend
on what stands far from it.  The bag is divided by the
square root of the number of words, so that chance weights of clean words stay alike at every length
while a toxic share shows the more, the longer the text is.  Scores are means over ``MEMBERS``
classifiers, which differ in their hashes and in their unlabelled texts.

The training texts are a bounded sample: at most ``POSITIVE`` confirmed toxic and, for each classifier,
at most ``UNLABELLED`` others, by the order of a hash of their ids.  The prior comes from all labels
that may be looked at.  The classifiers have a fixed size and are broadcast.

Cases: empty and null texts have no word and get the bias alone; a document without id is scored but
not learnt from; a document with two labels counts as toxic if one says so; without any confirmed toxic
text every score is 0; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import LOWER, blocks, mapped, mix64, split_words, written
from airgrid.llm.training import allowed_labels, document_ids, first_by_hash, texts_of

BITS = 18
PREFIXES = (4, 5, 6, 7)
POSITIVE = 4_000
UNLABELLED = 6_000
MEMBERS = 2
STEPS = 250
RATE = 0.1
DECAY = 1e-6
#: a feature is used from so many standard errors on
EVIDENCE = 5.0
#: texts with fewer distinct words are divided by the root of this many
SHORT = 25
#: bytes of a part of a run that counts only as a whole
LONGEST = 40
#: bytes of the windows of other parts
WINDOW = 12
#: texts held as bags at once, and their bytes, except of a single longer text
BLOCK, BLOCK_BYTES = 512, 4 << 20
_FOLD = np.frombuffer(LOWER, dtype=np.uint8)
_PLAIN = np.array([not (33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126) for b in range(256)])
#: bytes that don't part a run: an apostrophe belongs to its word
_JOINED = _PLAIN | (np.arange(256) == ord("'"))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each begins and ends without the punctuation at both ends."""
    large = pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64 if large else np.int32)
    ends = ends[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    # the first plain byte from each byte on, and behind the last one before it
    plain, n = _PLAIN[data], len(data)
    after = np.minimum.accumulate(np.where(plain, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
    behind = np.maximum.accumulate(np.where(plain, np.arange(1, n + 1), 0)) if n else np.zeros(0, np.int64)
    start = np.minimum(np.append(after, n)[ends[:-1]], ends[1:])
    stop = np.maximum(np.insert(behind, 0, 0)[ends[1:]], start)
    return data, start, stop


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def units(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(unit codes of all words, offsets per word, the distinct units): what a run without white space counts by."""
    data, start, stop = _bytes_of(words)
    size = stop - start
    joined, wide = (np.insert(np.cumsum(x), 0, 0) for x in (_JOINED[data], data >= 0xE0))
    whole = joined[stop] - joined[start] == size
    parted = np.flatnonzero(~whole)
    # parts between punctuation
    at, owner = _flat(start[parted], size[parted]), np.repeat(parted, size[parted])
    inside, edge = _JOINED[data[at]], np.append(owner[1:] != owner[:-1], True) if len(at) else np.zeros(0, bool)
    first = inside & (np.insert(edge[:-1] | ~inside[:-1], 0, True) if len(at) else inside)
    last = inside & (edge | np.append(~inside[1:], True) if len(at) else inside)
    part = [np.append(np.flatnonzero(whole), owner[first]), np.append(start[whole], at[first]), np.append(stop[whole], at[last] + 1)]
    length = part[2] - part[1]
    cut = (length > LONGEST) | ((wide[part[2]] > wide[part[1]]) & (length > WINDOW))
    at, owner = _flat(part[1][cut], length[cut]), np.repeat(part[0][cut], length[cut])
    until = np.minimum(at + WINDOW, np.repeat(part[2][cut], length[cut]))
    begins = (data[at] & 0xC0) != 0x80  # a character, not its further bytes
    more = np.arange(len(part[0])) >= whole.sum()  # whole runs are there already
    owners = np.concatenate([np.arange(len(words)), part[0][more], owner[begins]])
    begin = np.concatenate([start, part[1][more], at[begins]])
    size = np.concatenate([stop, part[2][more], until[begins]]) - begin
    offsets = pa.array(np.insert(np.cumsum(size), 0, 0))
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, offsets.buffers()[1], pa.py_buffer(_FOLD[data[_flat(begin, size)]])])
    coded = held.dictionary_encode()
    order = np.argsort(owners, kind="stable")
    return np.asarray(coded.indices, dtype=np.int64)[order], np.searchsorted(owners[order], np.arange(len(words) + 1)), coded.dictionary


def word_features(words: pa.Array, seed: int) -> np.ndarray:
    """The hashed features of each distinct word, one row per word."""
    data, start, stop = _bytes_of(words)
    size = stop - start
    out = np.empty((len(words), len(PREFIXES) + 1), dtype=np.int64)
    h = np.full(len(words), seed * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
    for i in range(min(LONGEST, int(size.max(initial=0)))):
        alive = size > i
        letter = _FOLD[data[start[alive] + i]].astype(np.uint64)
        h[alive] = (h[alive] ^ letter) * np.uint64(0x100000001B3)
        if i + 1 in PREFIXES:
            out[:, PREFIXES.index(i + 1)] = (mix64(h + np.uint64(i + 1)) >> np.uint64(64 - BITS)).astype(np.int64)
    for p in PREFIXES:
        if p > int(size.max(initial=0)):
            out[:, PREFIXES.index(p)] = (mix64(h + np.uint64(p)) >> np.uint64(64 - BITS)).astype(np.int64)
    longer = np.flatnonzero(size > LONGEST)
    rest = size[longer] - LONGEST
    if len(longer):  # the hash goes on to the end: a sum of the bytes, each scrambled with its place
        place = _flat(np.zeros(len(rest), np.int64), rest).astype(np.uint64)
        letters = _FOLD[data[_flat(start[longer] + LONGEST, rest)]].astype(np.uint64)
        h[longer] = mix64(h[longer]) + np.add.reduceat(mix64(place * np.uint64(256) + letters), np.cumsum(rest) - rest)
    whole = h ^ mix64(size.astype(np.uint64))
    out[:, -1] = (mix64(whole) >> np.uint64(64 - BITS)).astype(np.int64)
    return out


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(owner, unit code) of each distinct unit of each text, the number of distinct units per text, the units."""
    codes, offsets, words = split_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    owner, codes = np.divmod(np.unique(owner * max(len(words), 1) + codes), max(len(words), 1))
    of_word, cuts, found = units(words)
    counts = np.diff(cuts)[codes]
    pairs = np.repeat(owner, counts) * max(len(found), 1) + of_word[_flat(cuts[codes], counts)]
    owner, codes = np.divmod(np.unique(pairs), max(len(found), 1))
    return owner, codes, np.bincount(owner, minlength=len(texts)), found


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BLOCK):
        yield from blocks(batch.slice(at, BLOCK), column, BLOCK_BYTES)


@dataclass
class Member:
    """One linear classifier."""

    seed: int
    weights: np.ndarray
    bias: float

    def logits(self, owner: np.ndarray, codes: np.ndarray, sizes: np.ndarray, words: pa.Array) -> np.ndarray:
        of_word = self.weights[word_features(words, self.seed)].sum(axis=1) if len(words) else np.zeros(0)
        return self.bias + np.bincount(owner, of_word[codes], minlength=len(sizes)) / np.sqrt(np.maximum(sizes, SHORT))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def counted(sample: DataFrame, roles: dict[int, int]) -> DataFrame:
    """(member, feature, pos, un): in how many confirmed and in how many unlabelled texts of the sample each feature is.

    ``roles`` says of each sampled id: -1 confirmed toxic, which all members learn from, else the member
    that takes it as unlabelled.  Feature -1 counts the texts.
    """

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        width = 1 << BITS
        for part in _slices(batch, "text"):
            role = np.array([roles[i] for i in part["id"].to_pylist()])
            owner, codes, _, words = bags(part["text"])
            for member in range(MEMBERS):
                features = word_features(words, member)
                pairs = np.unique((owner[:, None] * width + features[codes]).ravel())  # once per text
                of, feature = np.divmod(pairs, width)
                pos = np.bincount(feature[role[of] == -1], minlength=width)
                un = np.bincount(feature[role[of] == member], minlength=width)
                held = np.flatnonzero(pos + un)
                columns = [np.append(held, -1), np.append(pos[held], (role == -1).sum()), np.append(un[held], (role == member).sum())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held) + 1, member)), *map(pa.array, columns)], names=["member", "feature", "pos", "un"])

    rows = mapped(sample, count, "member long, feature long, pos long, un long")
    return rows.groupBy("member", "feature").agg(F.sum("pos").alias("pos"), F.sum("un").alias("un"))


def telling_features(counts: DataFrame) -> dict[int, np.ndarray]:
    """For each member the features whose share among the toxic texts is ``EVIDENCE`` standard errors from that of the others."""
    totals = counts.where("feature = -1").select("member", F.col("pos").alias("n_pos"), F.col("un").alias("n_un"))
    n_pos, n_un = (F.greatest(F.col(c), F.lit(1)) for c in ("n_pos", "n_un"))
    spread = F.sqrt((F.col("un") / n_un + 1 / n_pos) * (1 / n_pos + 1 / n_un))
    rows = counts.where("feature >= 0").join(totals, "member").where(F.abs(F.col("pos") / n_pos - F.col("un") / n_un) / spread >= EVIDENCE)
    found: dict[int, list[int]] = {m: [] for m in range(MEMBERS)}
    for r in rows.select("member", "feature").collect():  # 2**BITS rows at most
        found[r.member].append(r.feature)
    return {m: np.array(sorted(v), dtype=np.int64) for m, v in found.items()}


def reduced(sample: DataFrame, roles: dict[int, int], used: dict[int, np.ndarray]) -> pa.Table:
    """(id, member, size, features): the telling words of each sampled text, as places in ``used``, a row of places per word."""

    def reduce_(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in _slices(batch, "text"):
            ids = np.asarray(part["id"])
            owner, codes, sizes, words = bags(part["text"])
            for member, features in used.items():
                place = np.full(1 << BITS, len(features), dtype=np.int32)  # the last place is that of all unused features
                place[features] = np.arange(len(features))
                places = place[word_features(words, member)].reshape(len(words), -1)
                keep = (places < len(features)).any(axis=1)[codes]
                own, flat = owner[keep], places[codes[keep]]
                cuts = np.searchsorted(own, np.arange(part.num_rows + 1)) * flat.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.ravel()))
                mine = pa.array([roles[i] in (-1, member) for i in ids.tolist()])
                columns = [pa.array(ids), pa.array(np.full(len(ids), member)), pa.array(sizes), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "member", "size", "features"]).filter(mine)

    return mapped(sample, reduce_, "id long, member long, size long, features array<int>").toArrow().sort_by([("member", "ascending"), ("id", "ascending")])


def fit(sizes: np.ndarray, owner: np.ndarray, places: np.ndarray, used: np.ndarray, positive: np.ndarray, prior: float, seed: int) -> Member:
    """One classifier by full-batch steps on the corrected risk, with the logistic loss.

    ``places`` has a row for each telling word of a text, ``owner`` says whose it is.
    """
    n, width = len(sizes), len(used) + 1
    scale = 1 / np.sqrt(np.maximum(sizes, SHORT))
    n_pos, n_un = max(positive.sum(), 1), max((~positive).sum(), 1)
    theta = np.zeros(width + 1)  # the weights, the unused place, the bias
    theta[-1] = np.log(prior / (1 - prior))
    m1, m2 = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(owner, theta[places].sum(axis=1), minlength=n) * scale
        p = sigmoid(z)
        loss_clean = np.logaddexp(0, z)
        clean_risk = loss_clean[~positive].sum() / n_un - prior * loss_clean[positive].sum() / n_pos
        # slope of prior * R_p(toxic) + max(0, R_u(clean) - prior * R_p(clean))
        clean_part = np.where(positive, -prior * p / n_pos, p / n_un)
        toxic_part = np.where(positive, prior * (p - 1) / n_pos, 0.0)
        slope = toxic_part + clean_part if clean_risk >= 0 else -clean_part
        g = np.bincount(places.ravel(), np.repeat((slope * scale)[owner], places.shape[1]), minlength=width + 1) + DECAY * theta
        g[width - 1], g[-1] = 0.0, slope.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta -= RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m1 / (np.sqrt(m2) + 1e-8)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[used] = theta[: len(used)]
    return Member(seed, weights, float(theta[-1]))


def trained(docs: DataFrame, confirmed: list[int], others: list[int], prior: float, id_col: str, text_col: str) -> list[Member]:
    """The classifiers.  Texts stay on the executors; the driver gets counters and the telling words of the sample."""
    roles = {i: k % MEMBERS for k, i in enumerate(others)} | dict.fromkeys(confirmed, -1)
    sample = written(texts_of(docs, list(roles), id_col, text_col), "toxicity-sample")
    used = telling_features(counted(sample, roles))
    rows, members = reduced(sample, roles, used), []
    for member, features in used.items():
        own = rows.filter(pa.compute.equal(rows["member"], member))
        positive = np.array([roles[i] == -1 for i in own["id"].to_pylist()], dtype=bool)
        places = np.asarray(own["features"].combine_chunks().flatten(), dtype=np.int64).reshape(-1, len(PREFIXES) + 1)
        counts = np.asarray(pa.compute.list_value_length(own["features"]), dtype=np.int64) // (len(PREFIXES) + 1)
        members.append(fit(np.asarray(own["size"]), np.repeat(np.arange(len(own)), counts), places, features, positive, prior, member))
    return members


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    positive: int = POSITIVE,
    unlabelled: int = UNLABELLED,
    out: str = "score",
) -> DataFrame:
    """All columns of ``docs`` and ``out``: 0 to 1, higher where a text is likelier toxic."""
    known = allowed_labels(labels, label, learn, "max")
    ids = document_ids(docs, id_col).where(learn)
    here = known.join(ids, "id")
    n, toxic = here.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    members: list[Member] = []
    if toxic:
        prior = min(max(toxic / n, 1e-3), 0.5)
        confirmed = here.where("label = 1")
        chosen = first_by_hash(confirmed, positive)
        others = first_by_hash(ids.join(confirmed, "id", "left_anti"), MEMBERS * unlabelled)
        members = trained(docs, chosen, others, prior, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(members)
    kept = [c for c in docs.columns if c != out]

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, i = np.zeros(batch.num_rows), 0
        for part in _slices(batch, text_col) if shared.value else ():
            bag = bags(part[text_col])
            scores[i : i + part.num_rows] = np.mean([sigmoid(m.logits(*bag)) for m in shared.value], axis=0)
            i += part.num_rows
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*kept, out])

    return mapped(docs.select(*kept), scored, docs.select(*kept).withColumn(out, F.lit(0.0)).schema)
