"""The classifier chain on held-out documents and odd tables."""

import numpy as np
from odd import odd_docs, odd_texts
from pyspark.sql import functions as F

from rankloom.llm import chains

BIG = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    chain = chains.learn(spark, docs, labels.where(seen), chains.toxicity_categories())
    truth = labels.where(~seen).select("doc_id", F.col("toxic").alias("truth"))
    found = chains.judged(spark, docs, chain).join(truth, "doc_id").select("toxic", "truth").collect()
    hits = [r[0] for r in found if r[1] == 1]
    clean = [r[0] for r in found if r[1] == 0]
    assert sum(hits) / len(hits) >= 0.85 and sum(clean) / len(clean) <= 0.02


def test_later_models_get_earlier_probabilities():
    rng = np.random.default_rng(1)
    n = 400
    cols = rng.integers(0, 3, n)
    x = chains.Sparse(np.arange(n), cols, np.ones(n), n, 3)
    first = (cols == 0).astype(float)
    chain = chains.fit_chain(x, np.column_stack([first, first]), np.arange(n) % 3, ["a", "b"], {"p": 0, "q": 1, "r": 2})
    assert [len(m.weights) for m in chain.models] == [3, 4] and chain.models[1].weights[3] > 0
    assert chain.probabilities("p")[1] > 0.5 > chain.probabilities("q")[1]


def test_odd_tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 0), (5, 0), (5, 1), (7, 1), (None, 1), (9, None), (8, 0)], "doc_id bigint, toxic int")
    chain = chains.learn(spark, docs, labels, chains.toxicity_categories())
    assert chains.judged(spark, docs, chain).count() == len(odd_texts())
    left = chains.without_toxic(spark, docs, labels)
    assert left.columns == docs.columns and left.count() <= len(odd_texts())
    none = chains.learn(spark, docs, labels.limit(0), chains.toxicity_categories())
    assert not any(r.toxic for r in chains.judged(spark, docs, none).collect())
    one_class = chains.learn(spark, docs, labels.where("toxic = 0"), chains.toxicity_categories())
    assert not any(r.toxic for r in chains.judged(spark, docs, one_class).collect())
    assert chains.judged(spark, docs.limit(0), chain).count() == 0
