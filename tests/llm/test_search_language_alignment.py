"""Ranked search, language identification and tokenizer alignment against brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import no_documents, odd_documents, prose, rows, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from airgrid.llm import alignment, language_id, queries, ranked_search

SF = "/root/testdata/sf0.01"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- ranked search


def brute_terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute_ranking(documents, items, k):
    """documents: (id, text) with ids that may repeat; items: (id, text)."""
    counted = [(i, Counter(brute_terms(t))) for i, t in documents]
    lengths = [sum(c.values()) for _, c in counted]
    n_docs, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(counted, lengths, strict=True):
            score = 0
            for t in set(brute_terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * n * n_docs) // total)))
            if score > 0:
                scores.append((-score, 2**63 if i is None else i))
        out += [(item, r, None if i == 2**63 else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [
    (1, "the shared line of Text"), (2, "a shared line of text number"), (3, "shared LINE, of text; nine"), (4, None), (5, "?!"), (6, "日本語のテキスト über"),
    (7, prose(1, 60)), (8, prose(1, 60) + " shared"), (9, "nowhereword"), (None, "line own"), (3, "line"),
]


@pytest.mark.parametrize("block_terms", [50_000, 12])
def test_ranking_equals_brute_force(spark, block_terms):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("x") for c in ("row", "rank", "terms", "score")})
    got = ranked_search.ranked(odd_documents(spark), items, k=4, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranking([r[:2] for r in rows()], ITEMS, 4)


def test_ranking_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked(no_documents(spark), items).count() == 0
    assert ranked_search.ranked(odd_documents(spark), items.limit(0)).count() == 0
    wordless = spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string")
    assert ranked_search.ranked(wordless, items).count() == 0


def test_equal_scores_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (9, 3, 7, 5, -1, 3)] + [(20, "others")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = ranked_search.ranked(docs.repartition(4), items, k=4).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [-1, 3, 3, 5] and len({r.score for r in got}) == 1


def test_sharing_graph_holds_each_term_once_and_saves_additions():
    rng = random.Random(5)
    common = rng.sample(range(300), 40)
    items = [sorted(set(rng.sample(common, 25)) | set(rng.sample(range(300), 8))) for _ in range(60)] + [[], [7]]
    graph = ranked_search.mine(items, 300)
    assert [sorted(graph.expanded(root)) for root in graph.roots] == items
    assert graph.additions < 0.75 * sum(map(len, items))
    wide = ranked_search.mine(items, 300, paired=4)  # a narrow look at each item changes the plan, not the sums
    assert [sorted(wide.expanded(root)) for root in wide.roots] == items


def test_shared_node_is_added_up_once(monkeypatch):
    items = [[0, 1, 2], [0, 1, 2, 3], [0, 1, 2, 4], [3, 4]]
    graph = ranked_search.mine(items, 5)
    assert graph.parts == [(0, 1, 2)]
    calls = []
    monkeypatch.setattr(ranked_search.Accumulators, "add_up", lambda self, group, f=ranked_search.Accumulators.add_up: (calls.append(group), f(self, group))[1])
    leaves = {t: (np.array([t]), np.array([10 + t])) for t in range(5)}
    sums = ranked_search.Accumulators(graph, 6, leaves)
    totals = [sums.add_up(root).tolist() for root in graph.roots]
    assert calls.count((0, 1, 2)) == 1
    assert totals == [[10, 11, 12, 0, 0, 0], [10, 11, 12, 13, 0, 0], [10, 11, 12, 0, 14, 0], [0, 0, 0, 13, 14, 0]]
    assert not sums.held  # every accumulator is let go after its last use


def test_ranking_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    once = {tuple(r) for r in ranked_search.ranked(docs.coalesce(1), items, k=20).collect()}
    many = {tuple(r) for r in ranked_search.ranked(docs.repartition(13), items, k=20, block_terms=200).collect()}
    assert once == many and len(once) == 20 * items.count()


# ---------------------------------------------------------------- language identification


def grams(text):
    data = text.lower().encode()
    return {(n, data[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(data) - n + 1)}


def test_held_out_languages(spark):
    got = queries.op11_language_id(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    assert len(got) == len(truth) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got.held_out].merge(truth.dropna(), on="doc_id")
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.95


def test_kernel_is_the_number_of_common_n_grams():
    texts = [prose(i, 30 + 40 * i) for i in range(6)] + ["", "a", "Ärger ÄRGER"]
    lowered = [t.lower().encode() for t in texts]
    sets = language_id.presence(lowered, np.empty((len(texts), language_id.GRAMS), np.uint8)).copy()
    hashed = [{int(g) for g in np.flatnonzero(s)} for s in sets]
    assert all(len(h) <= len(grams(t)) and len(h) >= 0.9 * len(grams(t)) for h, t in zip(hashed, texts, strict=True))
    marks = language_id.Landmarks(np.packbits(sets[:4], axis=1))
    got = marks.values(lowered)
    for i, h in enumerate(hashed):
        for j in range(4):
            assert got[i, j] == pytest.approx(len(h & hashed[j]) / max(1, math.sqrt(len(h) * len(hashed[j]))), rel=1e-5)
    assert np.allclose(marks.between(), got[:4], rtol=1e-5)


def test_long_texts_lose_no_n_gram(monkeypatch):
    text = prose(3, 2_000).lower().encode()
    whole = language_id.presence([text], np.empty((1, language_id.GRAMS), np.uint8)).copy()
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 97)
    assert (language_id.presence([text], np.empty((1, language_id.GRAMS), np.uint8)) == whole).all()


def test_ridge_equals_the_dual_solution():
    """With every text a landmark, kernel ridge regression has the closed form (K + penalty I)^-1 (y - c)."""
    texts = [prose(i, 25).lower().encode() for i in range(12)]
    marks = language_id.Landmarks(np.packbits(language_id.presence(texts, np.empty((12, language_id.GRAMS), np.uint8)), axis=1))
    classes = np.arange(12) % 3
    got = language_id.ridge(marks.values(texts), classes, 3, marks.between(), 0.7)
    k, y = marks.between(), np.eye(3)[classes]
    inverse = np.linalg.inv(k + 0.7 * np.eye(12))
    constant = inverse.sum(0) @ y / inverse.sum()
    assert np.allclose(k @ got[:-1] + got[-1], k @ inverse @ (y - constant) + constant, atol=1e-4)


def test_languages_of_odd_tables(spark):
    docs = odd_documents(spark)
    got = language_id.identify(docs, F.col("id") > 0)
    assert set(got.columns) == {*docs.columns, "lang_pred", "score"}
    for r in got.collect():
        has_letter = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if has_letter else "und") and 0 <= r.score <= 1
    assert language_id.identify(no_documents(spark), F.lit(True)).count() == 0
    unknown = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in unknown] == [("und", 0.0)]


def test_prediction_reads_neither_language_nor_id_nor_source(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").select("doc_id", "text", "lang")
    learn = F.col("id") < 200
    base = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, learn).where("doc_id >= 200").collect()}
    changed = docs.withColumn("lang", F.when(F.col("doc_id") < 200, F.col("lang")).otherwise("zz"))
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(changed, learn).where("doc_id >= 200").collect()}
    assert base == again and len({x for x, _ in base.values()}) > 2


# ---------------------------------------------------------------- alignment

_A = Tokenizer.from_file(A_PATH)
_A.encode_special_tokens = True
_B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
_SIGN = {chr(s): b for b, s in alignment._BYTE_SIGNS.items()}


def brute_tokens(text):
    if not text:
        return [], [], [], []
    a, b = _A.encode(" " + text, add_special_tokens=False).ids, _B.encode(text)
    spelt_a = [bytes(_SIGN[c] for c in _A.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(_B.id_to_piece(i)[3:-1], 16)]) if _B.is_byte(i) else _B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    return (a, b, spelt_a, spelt_b) if b"".join(spelt_a) == whole == b"".join(spelt_b) else ([], [], [], [])


def ends(tokens):
    return np.cumsum([len(t) for t in tokens]).tolist()


def brute_alignment(documents):
    """One tuple per document, in their order."""
    found, count = [], Counter()
    for i, text in documents:
        a, b, spelt_a, spelt_b = brute_tokens(text)
        end_a, end_b = ends(spelt_a), ends(spelt_b)
        at_b = {e: j for j, e in enumerate(end_b)}
        links = [(x, at_b[e]) for x, e in enumerate(end_a) if e in at_b]
        groups, p, q = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, a[p : x + 1])) + "|" + ",".join(map(str, b[q : y + 1])))
            p, q = x + 1, y + 1
        pairs = [(a[x], b[y]) for x, y in links]
        count.update(pairs)
        found.append((i, len(a), len(b), len(groups), pairs, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (i, n_a, n_b, n, len(pairs), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(s.encode()).hexdigest() if s else "")
        for i, n_a, n_b, n, pairs, s in found
    ]


def aligned(docs):
    return sorted((tuple(r) for r in alignment.align(docs, A_PATH, B_PATH).collect()), key=str)


def test_alignment_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250")
    want = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert aligned(docs.repartition(5)) == sorted(want, key=str)


def test_alignment_of_odd_documents(spark):
    odd = [*((r[0], r[1]) for r in rows()), (30, "<s> and </s> <|endoftext|> <0x41> <unk>"), (31, "a▁b"), (32, "  two  spaces \n\n and\ttabs "), (33, "\u0000x"),
           (34, " "), (35, "é ﬁ \U0001f600\U0001f468‍\U0001f469  x　y"), (36, " " * 3_000 + "z"), (37, "q" * 50_000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "block", "pairs", "total", "windows", "n_a")})
    assert aligned(docs.repartition(4)) == sorted(brute_alignment(odd), key=str)
    assert alignment.align(no_documents(spark), A_PATH, B_PATH).count() == 0


def test_blocks_and_forgetting_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    base = aligned(docs.coalesce(1))
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 5_000)
    few = sorted((tuple(r) for r in alignment.align(docs.coalesce(1), A_PATH, B_PATH, remembered=50).collect()), key=str)
    assert few == base


def test_windows_repeat_and_are_aligned_once():
    aligner = alignment.Aligner(alignment.ByteLevel(A_PATH), alignment.Pieces(B_PATH))
    text = prose(2, 400)
    aligner.block([text, text])
    once = aligner.aligned
    assert 0 < once < 500
    made = aligner.block([text + " " + text])
    assert aligner.aligned <= once + 2  # only the seam and the end may be new
    assert made["n_groups"][0] > 800


def test_faster_library_gives_the_file_s_ids():
    rng = random.Random(11)
    side = alignment.ByteLevel(A_PATH)
    signs = "aB zÄİß'’s\t\n    日本é́٣५½\U0001f600.,!?-_0123<|>\r\x85​\x1c"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]
    want = [e.ids for e in _A.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [side.encode(t).tolist() for t in texts] == want
    for long in (" " * 1_500_000 + "x", "\t" * 19_999, "z" + "\u3000" * 20_001, "<|endoftext|>" * 3, "y" * 200_000):
        assert side.encode(long).tolist() == _A.encode(" " + long, add_special_tokens=False).ids


def test_queries_read_whole_tables(spark, tmp_path):
    sf = table(spark, tmp_path, documents=odd_documents(spark, False), benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert queries.op12_tokenizer_alignment(spark, sf).count() == len(rows())
    assert queries.op11_language_id(spark, sf).count() == len(rows())
    got = sorted((tuple(r) for r in queries.op13_ranked_search(spark, sf).collect()), key=str)
    assert got == brute_ranking([r[:2] for r in rows()], ITEMS, 50)
