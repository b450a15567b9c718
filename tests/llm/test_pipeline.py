"""The pipeline's stages, each against its own input, and the registered queries against their SQL."""

import os

import corpus_pipeline
import duckdb
import numpy as np
import oracle
import pytest
from fixtures import brute_words, odd_documents, prose, table

from airgrid.llm import queries, shingle_copies
from airgrid.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = oracle.duck("/root/testdata/sf0.01")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert oracle.rows_of(df.columns, [tuple(r) for r in df.collect()]) == oracle.rows_of(columns, cursor.fetchall())
    assert duckdb.__version__


def test_registered_names():
    assert [n for n in queries.QUERIES if n.startswith("op")] and {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "near_dedup", "packing"]


def planted(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").collect()
    plain = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    text = prose(77, 300)
    words = text.split(" ")
    near = " ".join(words[:100] + ["changed"] + words[101:])
    copies = [(1_000, text), (1_001, text), (1_002, near), (1_003, prose(78, 300))]
    return plain + [(i, t, "en", "planted", len(t)) for i, t in copies]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.createDataFrame(planted(spark), "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    folder = table(spark, tmp_path, documents=docs, labels=labels)
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in rows.collect()}
        rows = written(stage(spark, rows, folder), f"test-{name}")
        if name == "packing":
            break
        assert rows.columns == docs.columns
        after = {r.doc_id: r for r in rows.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
        if name == "near_dedup":
            prints = {i: brute_words(r.text) for i, r in before.items()}
            shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in prints.items()}
            for i in set(before) - set(after):
                best = max(len(shingles[i] & shingles[j]) / max(len(shingles[i] | shingles[j]), 1) for j in before if j < i)
                assert best >= 0.8  # a document goes only for one like it
            kept = sorted(after)
            same = [(i, j) for k, i in enumerate(kept) for j in kept[k + 1 :] if shingles[i] == shingles[j]]
            assert not same
    pieces = rows.toPandas()
    assert set(pieces.doc_id) == set(after) and pieces.groupby("sequence_id").length.sum().max() <= 2_048


def test_near_stage_finds_planted_copies(spark, tmp_path):
    docs = spark.createDataFrame(planted(spark), "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert {1_000, 1_003} <= left and not {1_001, 1_002} & left


def test_run_equals_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"again-{name}")
    one = corpus_pipeline.run(spark, SF).toPandas().sort_values(["doc_id", "piece"]).to_numpy()
    assert (one == docs.toPandas().sort_values(["doc_id", "piece"]).to_numpy()).all() and np.isfinite(one.astype(float)).all()


def test_odd_documents_pass_every_stage(spark, tmp_path):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (12, 1, 0)], "doc_id long, quality int, toxic int")
    folder = table(spark, tmp_path, labels=labels)
    for start in (docs, docs.limit(0)):
        rows, before = start, start.count()
        for name, stage in corpus_pipeline.STAGES:
            packed = written(stage(spark, rows, folder), f"odd-{name}")
            if name == "packing":
                assert packed.where("piece = 0").count() == rows.count()
            else:
                rows = packed
                assert rows.columns == docs.columns and rows.count() <= before
        assert (rows.count() > 0) == (before > 0)


def test_shared_folder_is_the_clusters():
    from types import SimpleNamespace as Named

    from airgrid.llm.common import shared_path

    session = lambda folder, master: Named(conf=Named(get=lambda k, d: folder or d), sparkContext=Named(master=master))
    assert shared_path(session("hdfs://shared/tmp/", "yarn"), "x").startswith("hdfs://shared/tmp/llm-x-")
    assert os.path.isdir(os.path.dirname(shared_path(session(None, "local[4]"), "x")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(session(None, "spark://master:7077"), "x")


def _changed(text: str, similarity: float) -> tuple[str, float]:
    """``text`` with words replaced at its end, and how similar its runs of five words still are."""
    words = brute_words(text)
    runs = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    best = None
    for cut in range(1, len(words)):
        other = words[:-cut] + [f"new{i}" for i in range(cut)]
        a, b = runs(words), runs(other)
        if len(a & b) / len(a | b) < similarity:
            return best
        best = (" ".join(other), len(a & b) / len(a | b))
    return best


def test_near_stage_takes_pairs_from_the_similarity_on_and_no_others(spark, tmp_path):
    goes, stays, docs = [], [], []
    for i in range(200):
        text = prose(1_000 + i, 250 + i)
        for wanted, found in ((0.7, stays), (0.775, stays), (0.8, goes), (0.85, goes), (0.9, goes)):
            other, similarity = _changed(text + f" own{i} {wanted}", wanted)
            first = 10 * len(docs)
            assert (similarity >= 0.8) == (found is goes)
            # each pair has words of its own, so that nothing closer links it
            own = lambda t: " ".join(f"{w}_{first}" for w in brute_words(t))  # noqa: E731, B023
            docs += [(first, own(text + f" own{i} {wanted}")), (first + 1, own(other))]
            found.append(first + 1)
    table_ = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table_, str(tmp_path)).collect()}
    assert left == {i for i, _ in docs} - set(goes)


@pytest.mark.parametrize("block", [4, 4_096])
def test_shingle_links_are_brute_force(spark, block):
    texts = []
    for i in range(6):
        words = prose(i, 60).split()
        for j in range(15):
            texts.append(" ".join(words[: 60 - j] + [f"x{i}" for _ in range(j % 4)]))
    texts += ["", None, "one", "ONE", "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r.row: r.component for r in shingle_copies.copies(docs, 5, 0.8, "row", block=block).collect()}
    runs = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(brute_words, texts)]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]) - 1e-9:
                low, high = sorted((want[a], want[b]))
                want = [low if w == high else w for w in want]
    assert got == dict(enumerate(want))


def test_near_stage_goes_by_rows(spark, tmp_path):
    one, two, three, four = (prose(i, 80) for i in (901, 902, 903, 904))
    docs = [(1, one), (1, one), (None, one), (2, one), (None, two), (None, two), (3, three), (3, four), (4, four), (5, prose(905, 80))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    left = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, str(tmp_path)).collect()))
    assert left == sorted([(1, one), (0, two), (3, three), (3, four), (5, prose(905, 80))])


def test_near_stage_searches_by_fingerprints(spark, tmp_path, monkeypatch):
    # no two texts share a minwise table, so that only near fingerprints make candidates
    monkeypatch.setattr(shingle_copies, "table_keys", lambda s: np.array([hash((s.tobytes(), i)) % 2**63 for i in range(shingle_copies.TABLES)], dtype=np.uint64))
    text = prose(77, 2_000)
    words = text.split(" ")
    docs = [(1, text), (2, " ".join(words[:1_000] + ["changed"] + words[1_001:])), (3, prose(78, 2_000)), (4, prose(79, 2_000))]
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).collect()}
    assert left == {1, 3, 4}


def test_groups_of_another_search_are_verified(spark):
    one, two = prose(5, 100), prose(6, 100)
    docs = spark.createDataFrame([(0, one), (1, two), (2, one + " more"), (3, one)], "row long, text string")
    near = spark.createDataFrame([(i, 0) for i in range(4)], "row long, near long")
    got = {r.row: r.component for r in shingle_copies.copies(docs, 5, 0.8, "row", near=near).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}  # a group alone links nothing
