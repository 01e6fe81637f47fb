"""Exact top-k under pruning, copies, hot words and odd inputs, against scores computed in plain Python."""

import random

import pytest
from brute import scores, top

from rankloom.operators import negatives as neg
from rankloom.operators.lexical import build_index, corpus_vectors, postings
from rankloom.operators.retrieval import Bm25, TfIdf, retrieve, score_pairs

K = 9


def frames(spark, corpus, queries):
    return (
        spark.createDataFrame([("all", d, t) for d, t in corpus.items()], "split string, docno string, text string"),
        spark.createDataFrame([("all", q, t) for q, t in queries.items()], "split string, qid string, query string"),
    )


def hits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r.rank, r.docno, r.score))
    return {q: [(d, s) for _, d, s in sorted(rows)] for q, rows in out.items()}


def expected(corpus, queries, k, **model):
    answers = {q: top(scores(corpus, t, **model), k) for q, t in queries.items()}
    return {q: a for q, a in answers.items() if a}


def assert_same(got, want):
    assert got.keys() == want.keys()
    for q, answer in want.items():
        assert [d for d, _ in got[q]] == [d for d, _ in answer], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in answer], abs=2e-6)


@pytest.fixture(scope="module")
def skewed():
    """A third of the documents are copies, a word stands in most documents, some queries hold common words only."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    corpus = {}
    for i in range(300):
        body = rng.choices(vocabulary, weights, k=rng.randint(3, 60))
        corpus[f"d{i}"] = " ".join(["the", *body] if rng.random() < 0.9 else body)
    for i in range(300, 450):
        corpus[f"d{i}"] = "the w5 W7, w9 w11 w300 w301"
    queries = {f"q{i}": " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 25))) for i in range(80)}
    queries |= {f"q{i}": "w7 w300 the!" for i in range(80, 120)}
    queries |= {"q_the": "the", "q_common": "the w0 the", "q_none": "zebra", "q_empty": "", "q_one": "w399", "q_mix": "the w399"}
    return corpus, queries


@pytest.mark.parametrize("k", [1, K])
def test_exact_top_k(spark, ws, skewed, k):
    corpus, queries = skewed
    c, q = frames(spark, corpus, queries)
    index = build_index(ws, c, "skewed", depth=10)
    assert_same(hits(retrieve(ws, index, q, k=k)), expected(corpus, queries, k))


@pytest.mark.parametrize(
    ("model", "plain"), [(TfIdf(), {"model": "tfidf"}), (Bm25(idf="plus1"), {"idf": "plus1"})], ids=["tfidf", "plus1"]
)
def test_other_weights_pruned(spark, ws, skewed, model, plain):
    corpus, queries = skewed
    c, q = frames(spark, corpus, queries)
    index = build_index(ws, c, "skewed", depth=10)
    assert_same(hits(retrieve(ws, index, q, model, k=K)), expected(corpus, queries, K, **plain))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_top_k_short_queries(spark, ws, seed):
    """Short queries over long documents make the saturation ranges matter."""
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    corpus = {f"d{i}": " ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 40, 200]))) for i in range(400)}
    queries = {f"q{i}": " ".join(rng.choices(vocabulary, k=rng.randint(1, 3))) for i in range(60)}
    c, q = frames(spark, corpus, queries)
    index = build_index(ws, c, f"short-{seed}", depth=10)
    assert_same(hits(retrieve(ws, index, q, k=K)), expected(corpus, queries, K))


def test_hand_computed_scores(spark, ws):
    corpus, queries = {"d1": "a b", "d2": "a c c", "d3": "d"}, {"q": "c, a!"}
    c, q = frames(spark, corpus, queries)
    index = build_index(ws, c, "hand", depth=10)
    assert hits(retrieve(ws, index, q, k=3)) == {"q": [("d2", 0.276576), ("d1", -0.736966)]}
    pairs = spark.createDataFrame([("all", "q", d) for d in corpus], "split string, qid string, docno string")
    got = {r.docno: (r.score, r.overlap) for r in score_pairs(ws, index, q, pairs).collect()}
    assert got == {"d1": (-0.736966, 1), "d2": (0.276576, 2), "d3": (0.0, 0)}


def test_splits_do_not_mix(spark, ws):
    rows = [("a", "d1", "x y"), ("a", "d2", "x z"), ("b", "d1", "x x"), ("b", "d3", "w")]
    c = spark.createDataFrame(rows, "split string, docno string, text string")
    q = spark.createDataFrame([("a", "q1", "x z"), ("b", "q1", "x")], "split string, qid string, query string")
    index = build_index(ws, c, "two-splits", depth=10)
    found = {(r.split, r.docno) for r in retrieve(ws, index, q, k=5).collect()}
    assert found == {("a", "d1"), ("a", "d2"), ("b", "d1")}


def test_frequent_words_can_be_dropped(spark, ws, skewed):
    corpus, _ = skewed
    c, q = frames(spark, corpus, {"q1": "the", "q2": "the w399"})
    index = build_index(ws, c, "skewed", depth=10)
    assert set(hits(retrieve(ws, index, q, k=K, max_df_ratio=0.5))) <= {"q2"}


def test_vectors_count_terms(spark):
    c, _ = frames(spark, {"d1": "b a, B c", "d2": "", "d3": "..."}, {})
    got = {(r.docno, r.term): r.tf for r in postings(corpus_vectors(c)).collect()}
    assert got == {("d1", "a"): 1, ("d1", "b"): 2, ("d1", "c"): 1}
    assert {r.docno: r.length for r in corpus_vectors(c).collect()} == {"d1": 4, "d2": 0, "d3": 0}


def groups(spark, ws, corpus, queries, truth, k=3, **kw):
    c, q = frames(spark, corpus, queries)
    r = spark.createDataFrame([("all", a, b, 1) for a, b in truth.items()], "split string, qid string, docno string, label int")
    index = build_index(ws, c, f"groups-{sorted(corpus.items())}", depth=10)
    rows = neg.labelled_groups(neg.lexical_negatives(ws, index, q, r, k, **kw), q, r, k)
    out = {}
    for row in rows.collect():
        out.setdefault(row.qid, []).append((row.pos, row.docno, row.score, row.label))
    return {q: sorted(v) for q, v in out.items()}


def test_relevant_document_is_removed_after_the_cut(spark, ws):
    corpus = {f"d{i}": "x " + "pad " * i for i in range(8)} | {f"e{i}": "other" for i in range(20)}
    got = groups(spark, ws, corpus, {"q": "x", "none": "zzz"}, {"q": "d0", "none": "e1"})
    assert [row[1] for row in got["q"]] == ["d1", "d2", "d0"]
    assert [row[3] for row in got["q"]] == [0, 0, 1]
    assert got["none"] == [(4, "e1", 0.5, 1)]
    refilled = groups(spark, ws, corpus, {"q": "x"}, {"q": "d0"}, refill=True)
    assert [row[1] for row in refilled["q"]] == ["d1", "d2", "d3", "d0"]
    assert [row[2] for row in refilled["q"]][0::2] == [1.0, 0.0]


def test_min_max(spark):
    rows = [("all", "n", "a", 4.0), ("all", "n", "b", 2.0), ("all", "n", "c", 1.0), ("all", "e", "a", 3.0),
            ("all", "e", "b", 3.0), ("all", "s", "a", 7.0)]
    df = spark.createDataFrame(rows, "split string, qid string, docno string, score double")
    got = {(r.qid, r.docno): r.score for r in neg.min_max(df).collect()}
    assert got == {("n", "a"): 1.0, ("n", "b"): 0.333333, ("n", "c"): 0.0, ("e", "a"): 1.0, ("e", "b"): 1.0, ("s", "a"): 1.0}
