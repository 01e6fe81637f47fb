"""The pipeline's stages, one by one, against brute force on a small table."""

import random

import corpus_pipeline
import public_tokenizers
from odd import docs_of
from test_orderhash import brute as brute_classes
from test_suffixes import brute as brute_removed

from rankloom.llm.common import staged
from rankloom.llm.library import tokenizer

SF = "/root/testdata/sf0.001"


def made():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(120)
    bench = text(12)
    docs = [(k, text(rng.randrange(60, 120))) for k in range(12)]
    docs += [(20, docs[0][1]), (21, docs[1][1] + " end."), (22, docs[2][1].replace(docs[2][1].split()[30], "zz"))]
    docs += [(30, text(30) + " " + passage + " " + text(30)), (31, text(25) + " " + passage)]
    docs += [(40, text(40) + " " + bench + " " + text(20)), (50, "idiot moron scum trash " * 30)]
    return docs, [(1, bench)]


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = made()
    folder = f"file:{tmp_path}"
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(i == 50)) for i, _ in docs]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame = docs_of(spark, docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "repeated_strings", "decontamination", "tokens"]

    near = staged(spark, stages["near_duplicates"](spark, frame, folder), "t")
    firsts = {c for _, c, _ in brute_classes(docs)}
    assert {r.doc_id for r in near.collect()} == firsts and near.columns == frame.columns
    left = [(r.doc_id, r.text) for r in near.collect()]

    cut = staged(spark, stages["repeated_strings"](spark, near, folder), "t")
    want = {doc: n - gone for doc, n, gone, _, _ in brute_removed(left, 400)}
    assert {r.doc_id: len(r.text.encode()) for r in cut.collect()} == want and cut.columns == frame.columns
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    clean = staged(spark, stages["decontamination"](spark, cut, folder), "t")
    assert {r.doc_id for r in clean.collect()} == set(want) - {40} and clean.columns == frame.columns

    library = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in stages["tokens"](spark, clean, folder).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0.6 * docs.count() <= len(ids) < docs.count()
