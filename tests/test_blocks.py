"""Retrieval in blocks: the same hits however documents and queries are dealt, and no table with a row per pair."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import scores, top

from rankloom.functions import text
from rankloom.operators import blocks, retrieval
from rankloom.operators.lexical import build_index


def tables(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(150)]
    weights = [1 / (i + 1) for i in range(150)]
    corpus = {f"d{i}": " ".join(["the", *rng.choices(vocabulary, weights, k=rng.randint(2, 30))]) for i in range(160)}
    corpus |= {f"e{i}": "the w3 w149" for i in range(20)}
    queries = {f"q{i}": " ".join(["the", *rng.choices(vocabulary, weights, k=rng.randint(1, 9))]) for i in range(60)}
    queries |= {"the": "the", "none": "zebra", "rare": "w149", "low": "the w0"}
    c = spark.createDataFrame([("all", d, t) for d, t in corpus.items()], "split string, docno string, text string")
    q = spark.createDataFrame([("all", d, t) for d, t in queries.items()], "split string, qid string, query string")
    return corpus, queries, c, q


@pytest.mark.parametrize(("block", "piece"), [(400, 60), (10**6, 10**6)])
def test_hits_do_not_depend_on_blocks(spark, ws, monkeypatch, block, piece):
    corpus, queries, c, q = tables(spark)
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "SLICE", piece)
    index = build_index(ws, c, "blocks", depth=10)
    got = {}
    for r in retrieval.retrieve(ws, index, q, k=9).collect():
        got.setdefault(r.qid, {})[r.rank] = (r.docno, r.score)
    for name, text in queries.items():
        want = top(scores(corpus, text), 9)
        found = [got.get(name, {})[n] for n in sorted(got.get(name, {}))]
        assert [d for d, _ in found] == [d for d, _ in want], name
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=2e-6)


def test_no_table_holds_a_row_per_pair(spark, ws):
    """Every query shares a word with every document; what is written stays near the number of rows read."""
    corpus, queries, c, q = tables(spark)
    index = build_index(ws, c, "no-pairs", depth=10)
    before = len(ws._staged)
    assert retrieval.retrieve(ws, index, q, k=9).count() > 0
    words = sum(len(set(t.split())) for t in [*corpus.values(), *queries.values()])
    assert all(spark.read.parquet(path).count() <= words for path in ws._staged[before:])


def test_scores_of_given_pairs(spark, ws):
    corpus, queries, c, q = tables(spark)
    index = build_index(ws, c, "given", depth=10)
    rng = random.Random(5)
    keys = sorted({(rng.choice([*queries]), rng.choice([*corpus])) for _ in range(200)})
    pairs = spark.createDataFrame([("all", a, b) for a, b in keys], "split string, qid string, docno string")
    for r in retrieval.score_pairs(ws, index, q, pairs).collect():
        assert r.score == pytest.approx(dict(scores(corpus, queries[r.qid])).get(r.docno, 0.0), abs=2e-6)
        assert r.overlap == len(set(queries[r.qid].split()) & set(corpus[r.docno].split()))


def test_null_texts_and_rows_that_come_twice(spark, ws):
    rows = [("all", "d1", "a b"), ("all", "d1", "a b"), ("all", "d2", "a c c"), ("all", "d3", None), ("all", "d4", "e f")]
    c = spark.createDataFrame(rows, "split string, docno string, text string")
    q = spark.createDataFrame([("all", "q1", "c b"), ("all", "q2", None), ("all", "q3", "f")], "split string, qid string, query string")
    index = build_index(ws, c, "odd", depth=10)
    got = [(r.qid, r.docno) for r in retrieval.retrieve(ws, index, q, k=9).collect()]
    assert set(got) == {("q1", "d1"), ("q1", "d2"), ("q3", "d4")}
    assert got.count(("q1", "d2")) == got.count(("q3", "d4")) == 1


@pytest.mark.parametrize(("words", "asked", "cores"), [(10**7, 1_200_000, 8), (2_000_000, 250_000, 12), (6 * 10**8, 7 * 10**7, 12), (10**8, 4000, 8)])
def test_copies_of_documents_and_queries_are_balanced(words, asked, cores):
    """All cores have a cell, none holds more than ``BLOCK`` words, and no other dealing copies far fewer words."""
    blocks, slices = retrieval.dealing(words, asked, cores)
    wanted = min(3 * cores, asked // retrieval.SLICE)
    cost = lambda b, s: words * s + retrieval.ASKED * asked * b
    allowed = [
        (b, s)
        for b in range(1, 400)
        for s in range(1, 400)
        if b * s >= wanted and words <= b * retrieval.BLOCK and asked <= s * retrieval.BLOCK
    ]
    assert blocks * slices >= wanted and words <= blocks * retrieval.BLOCK and asked <= slices * retrieval.BLOCK
    assert cost(blocks, slices) <= 1.3 * min(cost(b, s) for b, s in allowed)


def test_vectors_travel_packed():
    """Parts hold each word once and give back what went in, rows of other keys apart."""
    docs = [(i % 2, i, [f"word{j}" for j in range(i % 5, 40)], [1 + j % 3 for j in range(i % 5, 40)]) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*docs)], names=["block", "doc", "terms", "tfs"])
    (parts,) = blocks.packed(["block"], "terms")([batch])
    assert sorted(parts["block"].to_pylist()) == [0, 1]
    assert sum(len(p) for p in parts["part"].to_pylist()) < batch.nbytes / 10
    back = [r for p in blocks._unpacked(pa.chunked_array([parts["part"]])) for r in p.to_pylist()]
    assert sorted((r["doc"], r["terms"], r["tfs"]) for r in back) == [d[1:] for d in docs]


def test_further_models_move_nothing_more(spark, ws):
    """Pairs carry counts of their query's words, which serve all models."""
    corpus, queries, c, q = tables(spark)
    index = build_index(ws, c, "models", depth=10)
    pairs = spark.createDataFrame([("all", "q1", "d1"), ("all", "low", "d5")], "split string, qid string, docno string")

    def exchanges(**models):
        plan = retrieval.score_pairs_by(ws, index, q, pairs, models)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(bm25=retrieval.Bm25(), tf_idf=retrieval.TfIdf()) == exchanges(bm25=retrieval.Bm25()) > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="disagree"):
        retrieval.score_pairs_by(ws, index, q, pairs, {"bm25": retrieval.Bm25(k1=2.0)})


def cell(docs, queries, n_blocks):
    """Packed parts of documents (doc, norm, {word: tf}) in blocks, and of queries (q, {word: weight})."""
    names = ["block", "doc", "norm", "terms", "tfs"]
    rows = [(d % n_blocks, d, norm, [*tfs], [*tfs.values()]) for d, norm, tfs in docs]
    held = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)
    asked = [(0, q, [*weights], [*weights.values()]) for q, weights in queries]
    wanted = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*asked)], names=["slice", "q", "words", "weights"])
    parts = lambda key, words, batch: pa.Table.from_batches([*blocks.packed([key], words)(iter([batch]))])
    return parts("block", "terms", held), parts("slice", "words", wanted)


@pytest.mark.parametrize("loose", [blocks.LOOSE, 0.0])  # 0: double precision from the start
@pytest.mark.parametrize("n_docs", [5, 300, 3000])
def test_a_cell_returns_k_documents_however_many_blocks(monkeypatch, n_docs, loose):
    monkeypatch.setattr(blocks, "LOOSE", loose)
    monkeypatch.setattr(blocks, "LONG", 20)
    rng = random.Random(n_docs)
    vocabulary = [f"w{i}" for i in range(200)]
    chance = [1 / (i + 1) for i in range(200)]
    docs = [(d, 0.5 + rng.random(), {w: rng.randint(1, 3) for w in rng.choices(vocabulary, chance, k=25)}) for d in range(n_docs)]
    queries = [(q, {w: rng.uniform(-1 if q % 3 else 0, 8) for w in rng.choices(vocabulary, chance, k=9)}) for q in range(40)]
    queries += [(40, {"w0": -3.0, "w1": -2.0}), (41, {"nowhere": 5.0}), (42, {"w199": 4.0})]
    for n_blocks in (1, 4):
        got = {}
        for r in blocks.first_k_of_cell(9)(*cell(docs, queries, n_blocks)).to_pylist():
            got.setdefault(r["q"], {})[r["doc"]] = r["score"]
        for q, weights in queries:
            want = {d: sum(weights[w] * tf / (tf + norm) for w, tf in tfs.items() if w in weights) for d, norm, tfs in docs if weights.keys() & tfs}
            first = sorted(want.items(), key=lambda item: -item[1])[:9]
            found = got.get(q, {})
            assert len(found) == len(first), q
            assert sorted(found.values(), reverse=True) == pytest.approx([s for _, s in first], abs=1e-12)
            assert all(want[d] == pytest.approx(s, abs=1e-12) for d, s in found.items())


@pytest.mark.parametrize(("n_blocks", "slices", "wanted"), [(27, 5, 36), (7, 4, 24), (1, 1, 0), (144, 17, 36), (600, 40, 36)])
def test_groups_have_equally_many_blocks(n_blocks, slices, wanted):
    groups, each = retrieval.grouping(n_blocks, slices, wanted)
    assert groups * slices >= min(wanted, n_blocks * slices) and 1 <= each <= retrieval.TOGETHER
    assert n_blocks <= groups * each < n_blocks + each


def test_shared_words_of_lists():
    asked = pa.array([["b", "x", "a"], [], None, ["a"], ["c", "b"]], pa.list_(pa.string()))
    held = pa.array([["a", "b", "c"], ["a"], ["a"], None, ["c", "c"]], pa.list_(pa.string()))
    got = [[(x["i"], x["at"]) for x in row] for row in text._shared(asked, held).to_pylist()]
    assert got == [[(0, 2), (2, 1)], [], [], [], [(0, 1)]]
    assert text._shared(asked.slice(3), held.slice(3)).to_pylist()[1] == [{"i": 0, "at": 1}]
    assert text._shared(asked[:0], held[:0]).to_pylist() == []
    rng = np.random.default_rng(3)
    lists = [[[f"w{w}" for w in rng.permutation(30)[: rng.integers(0, 20)]] for _ in range(200)] for _ in range(2)]
    for a, h, met in zip(*lists, text._shared(*(pa.array(x, pa.list_(pa.string())) for x in lists)).to_pylist(), strict=True):
        assert [(x["i"], x["at"]) for x in met] == [(i, h.index(w) + 1) for i, w in enumerate(a) if w in h]
