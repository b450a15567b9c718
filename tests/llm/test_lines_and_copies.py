"""Line dedup, exact dedup and SimHash near-dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from fixtures import SPACES, brute_words, no_documents, odd_documents, prose, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from airgrid.llm import exact_dedup, line_dedup, near_dedup, queries
from airgrid.llm.common import NO_ID
from airgrid.llm.perfect_hash import PerfectHash


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute_lines(docs):
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders[key_of(line)].add(NO_ID if i is None else i)
    out = []
    for i, text in docs:
        own, lines = NO_ID if i is None else i, (text or "").split("\n")
        keep = [x for x in lines if len(key_of(x)) < 10 or len(holders[key_of(x)]) < 2 or min(holders[key_of(x)]) == own]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return Counter(out)


@pytest.mark.parametrize("shard_keys", [1, 65_536])
def test_line_dedup_is_brute_force(spark, shard_keys):
    docs = odd_documents(spark)
    got = line_dedup.line_dedup(docs, shard_keys=shard_keys)
    assert set(got.columns) == set(docs.columns)
    want = brute_lines([(r[0], r[1]) for r in rows()])
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == want
    assert line_dedup.line_dedup(no_documents(spark)).count() == 0


def test_cold_keys_go_through_the_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 2)  # only keys with half of all repeated lines are hot
    docs = [(i, "\n".join(f"line number {k} of some" for k in range(i % 7, 40, 1 + i % 5)) + "\nthe hot line that all have") for i in range(60)]
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(docs)


def test_shards_are_probed_on_small_tables_too(spark, monkeypatch):
    """Only keys with more lines than a shard has on average skip the shards."""
    held = []
    monkeypatch.setattr(line_dedup, "build_index", lambda keys, n, f=line_dedup.build_index: (held.append(keys.count()), f(keys, n))[1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    cut = line_dedup.line_dedup(docs).agg({"n_dropped": "sum"}).first()[0]
    repeated = line_dedup.repeated_keys(docs, "doc_id", "text", 10).count()
    assert cut > 0 and held[0] > 0.9 * repeated > 100


def test_rows_without_an_id_are_one_document_but_not_one_cell(spark):
    docs = [(None, f"line of row {k} alone\nshared line {k % 9} of many\nx") for k in range(300)] + [(1, "shared line 3 of many")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = line_dedup.line_dedup(df)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(docs)
    lost = line_dedup.probe(df, line_dedup.build_index(line_dedup.repeated_keys(df, "doc_id", "text", 10), 4), 4,
                            line_dedup.LineArrays.build(*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2), "doc_id", "text", 10)
    assert max(len(r.drop) for r in lost.collect()) <= 2  # a cell holds lines of one text


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300))
def test_perfect_hash_is_minimal(keys):
    high, low = (np.array([k[i] for k in sorted(keys)], dtype=np.uint64) for i in (0, 1))
    hash_ = PerfectHash.build(high, low)
    assert sorted(hash_.find(high, low).tolist()) == list(range(len(keys)))
    arrays = line_dedup.LineArrays.build(high, low, np.arange(len(keys)), np.arange(len(keys)))
    again = line_dedup.LineArrays.unpack(arrays.pack())
    assert (again.first_holder(high, low) == np.arange(len(keys))).all()
    assert (again.first_holder(high, low ^ np.uint64(1))[[(h, x ^ 1) not in keys for h, x in sorted(keys)]] == -1 - NO_ID).all()


def test_exact_dedup_with_one_hot_key(spark):
    """Most rows share length and beginning, a third are copies; the rest is spread over keys that aren't broadcast."""
    same = "x" * exact_dedup.PREFIX
    docs = [(i, same + ("copy" if i % 2 else f"{i:04d}") if i % 3 else "y" * (1 + i % 90)) for i in range(900)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    groups = {}
    for i, t in docs:
        groups.setdefault(t, []).append(i)
    want = {(i, ids[0], len(ids), i == ids[0]) for ids in groups.values() for i in ids}
    assert len(got) == 900 and {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == want


def test_exact_dedup_is_brute_force(spark, tmp_path):
    docs = odd_documents(spark)
    groups, want = defaultdict(list), Counter()
    for i, text, *_ in rows():
        groups[SPACES.sub(" ", text or "")].append(i)
    for norm, ids in groups.items():
        first, kept = min(ids, key=lambda i: NO_ID if i is None else i), False
        for i in sorted(ids, key=lambda i: NO_ID if i is None else i):
            want[(i, first, len(ids), not kept, hashlib.sha256(norm.encode()).hexdigest())] += 1
            kept = True
    got = queries.op7_exact_dedup(spark, table(spark, tmp_path, documents=docs))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want
    assert exact_dedup.exact_dedup(no_documents(spark)).count() == 0


def brute_fingerprint(text, size):
    words = brute_words(text)
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """{index: component}: index of the smallest row reachable."""
    label = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_dedup_fingerprints_and_cases(spark):
    docs = odd_documents(spark)
    got = near_dedup.near_dedup(docs, 4, 4).collect()
    want = Counter((i, f"{brute_fingerprint(t, 4):016x}") for i, t, *_ in rows())
    assert Counter((r.doc_id, r.fingerprint) for r in got) == want
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.component_id)
    assert by_id[2] == by_id[3] == {1} and by_id[6] == by_id[7] == {5} and by_id[10] in ({-3}, {10})
    assert len(by_id[11]) == 1  # rows with one id are one document
    assert near_dedup.near_dedup(no_documents(spark), 4, 4).count() == 0


@pytest.mark.parametrize(("radius", "block"), [(4, 8_192), (4, 8), (2, 5), (7, 16)])
def test_components_are_brute_force(spark, radius, block):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**63, size=12, dtype=np.uint64)
    prints = []
    for k in range(160):
        value = int(centres[k % 12])
        for b in rng.integers(0, 64, size=int(rng.integers(0, radius + 2))):
            value ^= 1 << int(b)
        prints.append(value)
    prints += [prints[0]] * 40  # exact copies
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, fp0 long").repartition(4)
    got = {r.id: r.component for r in near_dedup.near_components(df, radius, block=block).collect()}
    assert [got[i] for i in range(len(prints))] == brute_components(prints, radius)


@pytest.mark.parametrize("n", [10, 50_000, 10**8, 10**11])
def test_thresholds_keep_every_near_pair(n):
    """The plan's promise: two fingerprints within the radius differ little enough in one partition."""
    rng = np.random.default_rng(3)
    both = np.full((64, 64), 0.25 * n)
    np.fill_diagonal(both, rng.uniform(0.2, 0.8, 64) * n)
    for radius in (0, 1, 4, 8):
        plan = near_dedup.search_plan(n, both, radius)
        assert sum(t + 1 for _, t in plan) == radius + 1
        assert len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)
        for _ in range(200):
            apart = set(rng.choice(64, size=radius, replace=False).tolist())
            assert any(len(apart & set(bits)) <= t for bits, t in plan)


def test_links_survive_a_third_of_copies_and_probes(spark):
    """Thresholds above 0 probe; copies are one entry."""
    base = 0x0F0F_3355_9A6C_1248
    near = [base] * 50 + [base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 9) for j in range(1, 64, 13)]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(near)], "id long, fp0 long")
    entries = df.groupBy("fp0").agg({"id": "min"}).withColumnRenamed("min(id)", "node")
    plan = [(list(range(32)), 1), (list(range(32, 64)), 1)]
    found = near_dedup.components(near_dedup.links(entries, plan, 1, 3, 64, block=7)).collect()
    assert {r.root for r in found} == {0} and len(found) == len(set(near)) - 1


def test_wide_words_reject_chance_candidates():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**63, size=(50, 4), dtype=np.uint64)
    right = left.copy()
    right[:, 1:] = rng.integers(0, 2**63, size=(50, 3), dtype=np.uint64)  # equal first words, unlike otherwise
    assert len(near_dedup.forest(left, right, False, 4, 41)) == 0
    assert len(near_dedup.forest(left, left.copy(), False, 4, 41)) == 50


def test_long_texts_have_their_fingerprint():
    text = prose(9, 70_000)
    assert near_dedup.fingerprint(text.encode(), 4)[0] == brute_fingerprint(text, 4)
