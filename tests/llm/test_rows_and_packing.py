"""Sharding, fingerprints of edited texts and packing against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from fixtures import no_documents, odd_documents, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from airgrid.llm import fingerprints, packing, queries, sharding

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def spark_hash(*values):
    """Spark's xxhash64 of longs and ints."""
    h = 42
    for v, size in values:
        h = xxhash.xxh64_intdigest((v % 2 ** (8 * size)).to_bytes(size, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def brute_place(x, n, seed):
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    while True:
        left, right = x % a, x // a
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + spark_hash((right, 8), (i, 4), (seed, 4)) % a) % a
            else:
                right = (right + spark_hash((left, 8), (i, 4), (seed, 4)) % b) % b
        x = right * a + left
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1_037])
def test_places_are_a_permutation(spark, n):
    walks = sharding.walks_needed(spark, n, 5)
    got = [r.p for r in spark.range(n).orderBy("id").select(sharding.permuted(sharding.F.col("id"), n, 5, walks).alias("p")).collect()]
    assert got == [brute_place(x, n, 5) for x in range(n)]
    assert sorted(got) == list(range(n))


def test_sharding_is_even_and_complete(spark):
    got = sharding.shard_rows(odd_documents(spark)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for r in got:
        assert r.slot * 8 + r.shard == brute_place(r.row, len(got), sharding.SEED)
    assert sharding.shard_rows(no_documents(spark)).count() == 0


def test_sharding_is_reproducible(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id % 7) AS text")
    one, two = (sharding.shard_rows(d).select("doc_id", "shard", "slot").toPandas().sort_values("doc_id") for d in (docs, docs.repartition(11)))
    assert (one.to_numpy() == two.to_numpy()).all()


def brute_print(text):
    words = fingerprint_words(text)
    terms = list(zip(words, words[1:], strict=False)) or [(words[0], "")]
    out = []
    hashes = []
    for a, b in terms:
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        hashes.append((h, len(a) + len(b)))
    for word in range(fingerprints.WORDS):
        if word:
            own = [(spark_hash((h, 8), (word, 4)) % 2**64, w) for h, w in hashes]
        else:
            own = hashes
        total = sum(w for _, w in own)
        out.append(sum(1 << b for b in range(64) if 2 * sum(w for h, w in own if h >> b & 1) > total))
    return out


def fingerprint_words(text):
    import re

    return re.split("[\x20\x09-\x0d]+", text.lower().strip(" \t\n\x0b\x0c\r"))


def test_fingerprints_of_texts_and_edited_texts(spark):
    docs = [(i, t) for i, t, *_ in rows() if i is not None and i not in (10, 11)]
    df = odd_documents(spark).where("doc_id IS NOT NULL AND doc_id NOT IN (10, 11)")
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(df).collect()}
    order = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(order):
        text, following = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = brute_print(text), brute_print(edited), brute_print(following)
        assert r.fingerprint == "".join(f"{x:016x}" for x in a) and r.edited_fingerprint == "".join(f"{x:016x}" for x in b)
        like = lambda x, y: max(0.0, math.cos(math.pi * sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) / 128))
        assert r.near_edited == pytest.approx(like(a, b), abs=1e-8) and r.near_next == pytest.approx(like(a, c), abs=1e-8)


def test_fingerprints_of_odd_tables(spark):
    got = fingerprints.fingerprint_pairs(odd_documents(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows())
    assert fingerprints.fingerprint_pairs(no_documents(spark)).count() == 0
    one = fingerprints.fingerprint_pairs(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()
    assert one.near_next == 1.0 and one.n_near is None


def test_neighbours_of_the_rows_asked_for(spark):
    """Rows that repeat an id or a text, and those without an id, count each for itself."""
    radius = 10
    got = fingerprints.fingerprint_pairs(odd_documents(spark), asked=F.col("id") % 2 == 0, radius=radius).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    for r, p in zip(got, prints, strict=True):
        near = sum((p ^ q).bit_count() <= radius for q in prints) - 1
        assert r.n_near == (near if r.doc_id is not None and r.doc_id % 2 == 0 else None)
    assert len({r.n_near for r in got} - {None}) > 1
    assert fingerprints.fingerprint_pairs(no_documents(spark), asked=F.col("id") % 2 == 0).count() == 0


@pytest.mark.parametrize("crowded", [64, 1])
def test_block_tables_find_all_near_fingerprints(spark, monkeypatch, crowded):
    """Also where keys are crowded and thus refined, as a third of the fingerprints agree in the first 48 bits."""
    import random

    monkeypatch.setattr(fingerprints, "CROWDED", crowded)

    rng = random.Random(4)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = []
    for _ in range(15):
        centre = [rng.getrandbits(64), rng.getrandbits(64)]
        if len(prints) % 3 == 0:
            centre[0] = centre[0] >> 48 << 48
        for _ in range(12):
            own = list(centre)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(2)] ^= 1 << rng.randrange(64)
            prints.append(own)
    df = spark.createDataFrame([(i, signed(a), signed(b)) for i, (a, b) in enumerate(prints)], "id long, fp0 long, fp1 long")
    got = {(r.query_id, r.id): r.distance for r in fingerprints.within_radius(df.where("id % 20 = 0"), df, 3).collect()}
    want, first = {}, {}
    for i, p in enumerate(prints):
        first.setdefault(tuple(p), i)
    for q in range(0, len(prints), 20):
        for p, i in first.items():
            d = sum((x ^ y).bit_count() for x, y in zip(prints[q], p, strict=True))
            if d <= 3:
                want[(q, i)] = d
    assert got == want
    assert fingerprints.block_count(10**11, 3) > fingerprints.block_count(100, 3) == 4


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 64).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=200))))
def test_plan_places_every_piece_once(case):
    capacity, lengths = case
    counts = Counter(lengths)
    runs = packing.plan(dict(counts), capacity)
    got = Counter()
    for run in runs:
        assert 0 < sum(run.lengths) <= capacity and run.count > 0
        assert sum(3 * x > capacity for x in run.lengths) <= 2
        for x in run.lengths:
            got[x] += run.count
    assert got == counts
    # no more than first-fit's bound
    assert sum(r.count for r in runs) <= 1.7 * -(-sum(lengths) // capacity) + 1


def test_plan_does_not_grow_with_the_pieces():
    import random

    rng = random.Random(1)
    counts = Counter(rng.randint(1, 2_048) for _ in range(50_000))
    small, large = packing.plan(dict(counts)), packing.plan({x: n * 10**6 for x, n in counts.items()})
    assert len(large) < 4 * 2_048 and len(small) < 4 * 2_048
    assert sum(r.count for r in small) <= 1.1 * sum(x * n for x, n in counts.items()) / 2_048


@pytest.mark.parametrize("text", ["", " \n", "It's we'll <|endoftext|> x.y, z!!", "ΟΔΟΣ. İ ﬁ ́a é½ ²x", "a\x85b　c \x1c d", "’tis «quoted». don't.'"])
def test_word_by_word_tokens_are_the_tokenizers(text):
    import pyarrow as pa

    ids, begins = packing.WordTokenizer(VOCABULARY).texts(pa.array([text, None, prose(3, 50)]))
    whole = Tokenizer.from_file(VOCABULARY)
    assert ids[begins[0] : begins[1]].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert ids[begins[2] : begins[3]].tolist() == whole.encode(prose(3, 50), add_special_tokens=False).ids


def test_random_texts_have_the_tokenizers_ids():
    import pyarrow as pa

    rng = random.Random(3)
    signs = list("aBcİiIßÉé'’.,;:!?-_<|>/@#$()[]0129½²٣ \t\n\x85\xa0\u2003\u200b\u0338\u0301\u0307ﬁΣςд日ÿµª\x00\x1c\x7f\U0001f600") + ["<|endoftext|>", "'s", "'T", " "]
    anywhere = lambda: chr(rng.choice([rng.randrange(32, 592), rng.randrange(592, 0xD800), rng.randrange(0xE000, 0x20000)]))
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(50_000)]
    texts += ["".join(anywhere() for _ in range(rng.randrange(1, 16))) + rng.choice(["", ".", ",!", " x", "'s"]) for _ in range(50_000)] + ["KENDİ.", "İ,"]
    words = packing.WordTokenizer(VOCABULARY)
    assert words.way == "parts"
    ids, begins = words.texts(pa.array(texts))
    whole = Tokenizer.from_file(VOCABULARY).encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [e.ids for e in whole]


def test_other_vocabularies_are_read_in_their_own_way():
    """A byte-level vocabulary keeps white space and case: its texts are not cut at all."""
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["One, two;  Three.", None, prose(4, 200), ""]
    words = packing.WordTokenizer(path)
    assert words.way == "texts"
    ids, begins = words.texts(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [e.ids for e in want]


def test_the_word_table_is_bounded_and_loses_nothing():
    import pyarrow as pa

    small, large = packing.WordTokenizer(VOCABULARY, limit=20_000), packing.WordTokenizer(VOCABULARY)
    for i in range(12):
        texts = pa.array([prose(100 * i + k, 300) for k in range(4)])
        (a, x), (b, y) = small.texts(texts), large.texts(texts)
        assert np.array_equal(a, b) and np.array_equal(x, y)
        assert small.table.nbytes < 120_000
    assert large.table.nbytes > small.table.nbytes


def test_packing_fills_sequences_without_gaps(spark):
    docs = odd_documents(spark)
    got = packing.pack(docs, VOCABULARY, with_ids=True).collect()
    whole = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t, *_ in rows():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2_048)):
            cut = ids[start : start + 2_048]
            want[(i, piece, start, len(cut), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in cut)), tuple(cut))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2_048
    assert len(held) <= -(-sum(r.length for r in got) // 2_048) + 1
    assert packing.pack(no_documents(spark), VOCABULARY).count() == 0


def test_registered_shards_have_the_law(spark):
    got = queries.op4_sharding(spark, "/root/testdata/sf0.001").toPandas()
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all() and got.groupby("shard").size().agg(lambda s: s.max() - s.min()) <= 1
