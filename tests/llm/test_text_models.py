"""Classifiers by held-out accuracy, the codec and the chat format by exact round trips."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import no_documents, odd_documents, prose, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airgrid.llm import chat, quality, queries, toxicity
from airgrid.llm.sentencepiece_codec import Codec, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def ranking(scores, truth):
    ones, zeros = scores[truth == 1], scores[truth == 0]
    return (ones[:, None] > zeros[None]).mean() + (ones[:, None] == zeros[None]).mean() / 2


@pytest.mark.parametrize(
    ("query", "label", "folds", "rest", "limit", "least"),
    [("op2_quality_classifier", "quality", 5, 0, 0.3, 0.95), ("op6_toxicity", "toxic", 3, 1, 0.7, 0.85)],
)
def test_held_out_documents_are_ranked(spark, query, label, folds, rest, limit, least):
    got = queries.QUERIES[query](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % folds == rest)).all()
    assert (got.predicted == (got.score >= limit).astype(int)).all()
    truth = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert ranking(held.score.to_numpy(), held[label].to_numpy()) >= least


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_tables(spark, scores):
    docs, label = odd_documents(spark), "quality" if scores is quality.quality_scores else "toxic"
    pairs = [(1, 1), (2, 1), (4, 0), (5, 0), (6, None), (9, 1), (9, 0), (None, 1), (99, 1), (12, 1)]
    labels = spark.createDataFrame(pairs, f"doc_id long, {label} int")
    got = scores(docs, labels, F.lit(True))
    assert set(got.columns) == set(docs.columns)  # a column named score is replaced
    found = got.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1]) for r in rows())
    assert all(0 <= r.score <= 1 for r in found)
    assert scores(no_documents(spark), labels, F.lit(True)).count() == 0
    none = scores(docs, labels.limit(0), F.lit(True), out="mine").collect()
    assert {r.mine for r in none} == {0.5 if label == "quality" else 0.0}


def test_labels_that_may_not_be_learnt_from_change_nothing(spark):
    docs = spark.createDataFrame([(i, prose(i, 60) + (" grim" if i % 3 == 0 else "")) for i in range(90)], "doc_id long, text string")
    learn = F.crc32(F.col("id").cast("string")) % 3 != 1
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = labels.withColumns({c: F.when(hidden, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        a, b = ({r.doc_id: r.score for r in scores(docs, y, learn).collect()} for y in (labels, flipped))
        assert a == b


def test_cosines_are_exact():
    import pyarrow as pa

    texts = pa.array([prose(i, 50 + i) for i in range(40)])
    labels = np.arange(40) % 2
    held = sum(np.count_nonzero(quality.term_counts(texts.slice(i, 8)), axis=0) for i in range(0, 40, 8))
    model = quality.fit(texts, labels, held, 40, rank=8)
    place = model.place(quality.term_counts(texts))
    for i, got in enumerate(model.score(texts)):
        cosines = np.array([place[i] @ model.vectors[:, j] for j in range(40)], dtype=np.float64)
        near = np.argsort(-cosines)[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[near], 1e-3) ** quality.SHARPNESS
        assert got == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-3)


def test_risk_is_corrected_for_hidden_toxic_texts(spark):
    """Most toxic texts are unlabelled; those must still score above the clean ones."""
    docs = spark.createDataFrame([(i, prose(i, 80) + (" vile wretch foul" if i < 120 else "")) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 0) for i in range(200, 360)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.repartition(3), labels, F.lit(True)).collect()}
    assert min(got[i] for i in range(40, 120)) > 0.7 and max(got[i] for i in range(120, 600)) < 0.3


def test_word_hashes_ignore_case_and_punctuation():
    import pyarrow as pa

    words = pa.array(["idle", "Idle,", "(IDLE)!!", "***", "", "über", "ab"])
    got = toxicity.word_features(words, 3)
    assert (got[0] == got[1]).all() and (got[0] == got[2]).all() and (got[3] == got[4]).all() and not (got[5] == got[0]).all()
    assert (toxicity.word_features(words.slice(1), 3) == got[1:]).all()


@pytest.mark.parametrize("joint", ["", ",", "_", "/"])
@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "日本語文章天気今日散歩東京大阪"])
def test_toxic_passages_late_in_unspaced_texts_are_read(spark, joint, letters):
    rng = random.Random(f"{joint}{letters}")
    text = lambda n: joint.join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    vile = joint.join(["邪悪な言葉", "呪い罵倒"] if letters[0] != "a" else ["vilewretch", "foulscorn"])
    docs = [(i, text(60) + joint + (vile if i < 120 else text(2)) + joint + text(20)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 0) for i in range(200, 360)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(df, labels, F.lit(True)).collect()}
    hit = np.array([got[i] for i in range(40, 120)])
    assert hit.min() > max(got[i] for i in range(120, 600))


@given(st.text(alphabet="aB,'_/-é日本語", min_size=1, max_size=120), st.integers(0, 119), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_every_byte_reaches_a_feature(text, at, seed):
    import pyarrow as pa

    at %= len(text)
    other = text[:at] + ("z" if text[at] in "aB" else "語" if text[at] in "日本" else text[at]) + text[at + 1 :]
    bag = lambda t: sorted(map(tuple, toxicity.word_features(toxicity.bags(pa.array([t]))[3], seed)))
    assert (bag(text) == bag(other)) == (text == other)


def test_words_are_hashed_to_their_end():
    import pyarrow as pa

    one, other = toxicity.word_features(pa.array(["x" * 40 + "good" * 9, "x" * 40 + "evil" * 9]), 1)
    assert (one[:-1] == other[:-1]).all() and one[-1] != other[-1]


def test_short_words_have_the_same_features_in_every_block():
    import pyarrow as pa

    words = pa.array(["a", "ab", "abcde", "", "a longer one"])
    for seed in range(2):
        got = toxicity.word_features(words, seed)
        assert all((toxicity.word_features(words.slice(i, 1), seed)[0] == got[i]).all() for i in range(len(words)))
    weights = np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    member = toxicity.Member(1, weights, 0.0)
    alone, batch = (member.logits(*toxicity.bags(pa.array(t)))[0] for t in (["so it is"], ["so it is", "considerably longer words"]))
    assert alone == pytest.approx(batch, abs=1e-12)


@pytest.fixture(scope="module")
def codec():
    return Codec(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abet in▁\n  éß日😀.,THE", max_size=120))
def test_ids_are_the_models(codec, library, text):
    assert codec.encode(text) == library.encode(text)
    assert codec.decode(codec.encode(text)) == text.replace("▁", " ")


@pytest.mark.parametrize("text", ["", " ", "a" * 3_000, "ab" * 1_000 + "日" * 50, " ".join(["the"] * 300), "      x", "<s></s><0x41>", prose(2, 400)])
def test_long_stretches_stream_through_the_window(codec, library, text):
    assert codec.encode(text) == library.encode(text)


def test_window_is_bounded_and_commits_early(codec):
    fed = 0

    def chars():
        nonlocal fed
        for _ in range(20_000):
            for c in "streaming":
                fed += 1
                yield c

    stream = codec.survivors(chars())
    next(stream)
    assert fed <= 4 * codec.longest  # the first piece is certain long before the text ends
    assert "".join(stream)[-9:] == "streaming"


def test_codec_on_odd_tables(spark):
    got = encode(odd_documents(spark), MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = got.collect()
    assert all(r.restored and r.n_ids == len(r.ids) for r in found)
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((i, tuple(library.encode(t or ""))) for i, t, *_ in rows())
    back = decode(got, MODEL).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t, *_ in rows())
    assert encode(no_documents(spark), MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "<|", "|>", "[", "␛A"]), st.text(max_size=5)), max_size=12).map("".join))
def test_escapes_are_reversible(text):
    safe = chat.escaped(text)
    assert chat.unescaped(safe) == text
    assert not any(c in safe for c in chat.CONTROL[1:])
    assert chat.read_back(chat.formatted_turn(text, [{"type": "text", "text": text}], "x")[0]) == (text, text)


TURNS = [
    (1, 0, "user", "hi </s>"), (1, 1, "assistant", "a␛b <|end|>\n"), (1, 1, "assistant", "a␛b <|end|>\n"), (1, 2, "assistant", None),
    (2, None, "user", "first"), (2, 5, None, "x"), (2, 3, "assistant", "é日"), (3, 0, "user", ""), (None, 0, "assistant", "no id"),
    (4, 0, "assistant", "long " * 50_000), *[(5, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(3_000)],
]


def test_conversations_read_back(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in queries.op10_chat_formatting(spark, table(spark, tmp_path, conversations=turns.withColumn("pos", F.lit("x")))).collect()}
    extra = [(-7, 0, "user", queries._EXTRA), (-7, 1, "assistant", queries._EXTRA)]
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert set(got) == {1, 2, 3, 4, 5, None, -7}
    for conv, r in got.items():
        own = [(x[2] or "", x[3] or "") for x in sorted((t for t in TURNS + extra if t[0] == conv), key=order)]
        said = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.formatted_turn(a, [{"type": "text", "text": b}], "assistant")[0]) for a, b in own)


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, **more: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "millis": None, "chars": None} | more
    parts = [
        part("text", text="look: <|image|> "), part("image", ref="s3://a.png", width=140, height=29), part("text", text=" and "), None,
        part("audio", ref="b.wav", millis=1_001), part("video", ref="no"), part("document", ref="c.pdf", chars=9), part("image", ref="d"),
    ]
    from pyspark.sql import types as T

    kinds = "conv_id long, turn long, role string, text string"
    schema = T._parse_datatype_string(kinds).add("parts", T.ArrayType(chat.PART))
    turns = spark.createDataFrame([(1, 0, "user", "unused", parts), (1, 1, "assistant", "plain", None)], schema)
    first, second = chat.format_turns(turns).orderBy("pos").collect()
    seen = [(a.type, a.ref, a.tokens) for a in first.attachments]
    assert seen == [("image", "s3://a.png", 30), ("audio", "b.wav", 26), ("document", "c.pdf", 3), ("image", "d", 1)]
    for a in first.attachments:
        mark = chat.PLACEHOLDERS[a.type]
        assert first.formatted[a.at : a.at + len(mark)] == mark
    assert chat.read_back(first.formatted)[1] == "look: <|image|> <|image|> and <|audio|><|document|><|image|>"
    assert second.formatted[second.loss_from : second.loss_to] == "plain" and (first.loss_from, first.loss_to) == (0, 0)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(empty)).count() == 0


def test_random_turns_keep_their_order(spark):
    rng = random.Random(2)
    turns = [(c, k, rng.choice(["user", "assistant"]), prose(c * 50 + k, 5)) for c in range(20) for k in range(30)]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r.conv_id: r.turns_sha256 for r in chat.digests(chat.format_turns(df)).collect()}
    for c in range(20):
        own = "".join(f"{r}\n{t}\n" for _, _, r, t in sorted(x for x in turns if x[0] == c))
        assert got[c] == hashlib.sha256(own.encode()).hexdigest()


def test_many_texts_at_once_have_the_models_ids(codec, library):
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["", None, "  two  blanks ", "▁", "a▁ b", *("".join(rng.choice("abet in▁\n  éß日") for _ in range(40)) for _ in range(200)), *(prose(i, 60) for i in range(30))]
    ids, cuts = codec.encode_all(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [library.encode(t or "") for t in texts]
    assert [t.decode() for t in codec.decode_all(ids, cuts)] == [(t or "").replace("▁", " ") for t in texts]
