"""Smoothing, schedules, plans, splits, sampling, evaluation, encoding and the ranker on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.functions import smoothing as sm
from rankloom.functions.ordering import sequential_ids, shuffled_positions
from rankloom.functions.text import clean, tokens
from rankloom.operators import encoding, evaluation, ranker, splits
from rankloom.operators import negatives as neg
from rankloom.operators import relations as rel
from rankloom.plans import grids
from rankloom.plans.training import history, plan_targets, training_plan


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def groups_of(spark, sizes, split="all"):
    rows = [
        (split, f"q{i}", f"d{i}_{j}", 0.0 if j < n - 1 else 0.5, int(j == n - 1), j + 1, float(j % 3))
        for i, n in enumerate(sizes)
        for j in range(n)
    ]
    return spark.createDataFrame(
        rows, "split string, qid string, docno string, score double, label int, pos int, logit double"
    )


def test_cleaning(spark):
    text = "café x² é(combining) a_b - don't 你好"
    got = one(spark, clean(F.lit(text)).alias("c"), tokens(F.lit(text)).alias("t"))
    assert got.c == "café x² é combining  a_b   don t 你好"
    assert got.t == ["café", "x²", "é", "combining", "a_b", "don", "t", "你好"]
    assert one(spark, clean(F.lit("é")).alias("c")).c == "e "


@pytest.mark.parametrize(
    ("label", "score", "classic", "weak"), [(1, 0.5, 0.9, 0.9), (0, 1.0, 0.1, 0.2), (0, 0.0, 0.1, 0.0), (0, -1.0, 0.1, 0.0)]
)
def test_smoothing(spark, label, score, classic, weak):
    got = one(
        spark,
        sm.smooth_classic(F.lit(label), 0.2).alias("c"),
        sm.smooth_weak(F.lit(label), F.lit(score), 0.2).alias("w"),
        sm.smooth_weak(F.lit(label), F.lit(score), 0.0).alias("same"),
    )
    assert (got.c, got.w, got.same) == pytest.approx((classic, weak, label))


def test_schedules(spark):
    table = {
        0.0: (0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2),
        0.25: (0.2, 0.15, 0.057301, 0.170711, 0.15, 0.199805, 0.047461, 0.179297),
        0.5: (0, 0.1, 0.016417, 0.1, 0.1, 0.19375, 0.00625, 0.1),
        0.75: (0, 0.05, 0.004704, 0.029289, 0.05, 0.152539, 0.000195, 0.020703),
    }
    p = F.col("p")
    columns = [sm.decayed(d, 0.2, p) for d in ("step", "linear", "exp", "cosine")]
    columns += [sm.decayed("beta", 0.2, p, a, b) for a, b in ((1, 1), (5, 1), (1, 5), (3, 3))]
    rows = spark.createDataFrame([(x,) for x in table], "p double").select(
        "p", F.array(*[c.cast("double") for c in columns]).alias("eps")
    )
    for row in rows.collect():
        assert row.eps == pytest.approx(table[row.p], abs=1e-6)
    got = one(
        spark,
        sm.step_by_instances(0.2, F.lit(2), F.lit(5)).alias("whole"),
        sm.decayed("step", 0.2, F.lit(2) / F.lit(5)).alias("real"),
    )
    assert (got.whole, got.real) == (0.0, 0.2)


@pytest.mark.parametrize(("a", "b"), [(2.5, 1.5), (0.5, 0.5), (30.25, 2.5), (2.5, 80.5), (200.5, 200.5)])
def test_general_beta(spark, a, b):
    points = [0.0, 0.01, 0.3, 0.5, 0.77, 0.99, 1.0]
    got = spark.createDataFrame([(x,) for x in points], "x double").select("x", sm.beta_cdf(F.col("x"), a, b).alias("y"))

    def area(x, n=20000):  # midpoints of t = x sin(u)^2, which removes the end points' poles
        ln = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        h = math.asin(math.sqrt(x)) / n
        return sum(
            math.exp(ln + (2 * a - 1) * math.log(math.sin(u)) + (2 * b - 1) * math.log(math.cos(u))) * 2 * h
            for u in ((i + 0.5) * h for i in range(n))
        )

    for row in got.collect():
        assert row.y == pytest.approx(area(row.x) if 0 < row.x < 1 else row.x, abs=2e-6)


def test_integer_and_general_beta_agree(spark):
    row = one(
        spark, sm._beta_cdf_integer(F.lit(0.37), 3, 4).alias("a"), sm._beta_cdf_series(F.lit(0.37), 3.0, 4.0).alias("b")
    )
    assert row.a == pytest.approx(row.b, abs=1e-12)


def test_plan_batches(spark):
    rows = groups_of(spark, [10] * 10)
    plan = training_plan(rows, batch_size=32, seed=1, total=250)
    got = sorted((r.seen, r["count"]) for r in plan.groupBy("seen").count().collect())
    assert got == [(0, 32), (32, 32), (64, 32), (96, 4), (100, 32), (132, 32), (164, 32), (196, 4), (200, 32), (232, 32)]
    epochs = {e: {(r.qid, r.docno) for r in plan.filter(F.col("epoch") == e).collect()} for e in (0, 1)}
    assert len(epochs[0]) == len(epochs[1]) == 100
    order = [[r.docno for r in plan.filter(F.col("epoch") == e).orderBy("seen", "docno").collect()] for e in (0, 1)]
    assert order[0] != order[1]


def test_plan_reads_only_the_start_of_a_large_table(spark):
    rows = groups_of(spark, [10] * 200)
    assert training_plan(rows, batch_size=32, seed=0, total=40).count() == 64


def test_plan_ignores_partitioning(spark):
    rows = groups_of(spark, [10] * 30)
    a, b = (
        {(r.seen, r.docno) for r in training_plan(df, 32, 0, epochs=1.5).collect()}
        for df in (rows.repartition(1), rows.repartition(7, "docno"))
    )
    assert a == b


def test_history(spark):
    plan = plan_targets(training_plan(groups_of(spark, [10] * 4), 8, 0, total=40), "twsls", 0.2, "step")
    got = history(plan).orderBy("instances_vues").collect()
    assert [r.epsilon for r in got] == [0.2, 0.2, 0.2, 0.0, 0.0]
    for r in got:
        rows = plan.filter(F.col("seen") == r.instances_vues).collect()
        loss = [-(x.target * math.log(1 / (1 + math.exp(-x.logit))) + (1 - x.target) * math.log(1 - 1 / (1 + math.exp(-x.logit)))) for x in rows]
        assert r.loss == pytest.approx(sum(loss) / len(loss))


def test_loss_of_large_logits_is_finite(spark):
    row = one(spark, sm.bce_with_logits(F.lit(800.0), F.lit(0.0)).alias("a"), sm.bce_with_logits(F.lit(-800.0), F.lit(0.0)).alias("b"))
    assert (row.a, row.b) == (800.0, 0.0)


def test_modes(spark):
    row = one(spark, *[sm.epsilon(m, 0.4, F.lit(0.75), "linear").alias(m) for m in ("baseline", "ls", "twsls")])
    assert (row.baseline, row.ls, row.twsls) == pytest.approx((0.0, 0.4, 0.1))
    with pytest.raises(ValueError):
        sm.epsilon("other", 0.4, F.lit(0.0))


def test_sequential_ids_follow_the_keys(spark, ws):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(5)
    got = [(r.k, r.row_no) for r in sequential_ids(ws, df, ["k"]).collect()]
    assert sorted(got) == [(i, i + 1) for i in range(1000)]


def test_shuffled_positions_number_each_group(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("k"))
    got = shuffled_positions(df, ["k"], [5], ["g"]).collect()
    for g in range(3):
        assert sorted(r.position for r in got if r.g == g) == list(range(sum(1 for i in range(500) if i % 3 == g)))
    below = shuffled_positions(df, ["k"], [5], ["g"], below=20).collect()
    assert {(r.g, r.k) for r in below} == {(r.g, r.k) for r in got if r.position < 20}


def relations_of(spark, n):
    identified = rel.with_ids(
        spark.range(n).select(
            F.lit("all").alias("split"), "id", F.concat(F.lit("c"), "id").alias("context"), F.concat(F.lit("r"), "id").alias("response")
        ),
        F.col("id"),
    )
    return rel.relations(identified)


def test_random_negatives(spark):
    queries, corpus, qrels = relations_of(spark, 50)
    draw = lambda seed: neg.random_negatives(queries, qrels, corpus, 9, seed)
    got = draw(0).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.qid, []).append(r.docno)
    assert len(by_query) == 50
    assert all(len(set(d)) == 9 and "d" + q[1:] not in d for q, d in by_query.items())
    assert {tuple(r) for r in got} == {tuple(r) for r in draw(0).collect()} != {tuple(r) for r in draw(1).collect()}
    queries, corpus, qrels = relations_of(spark, 10)
    assert neg.random_negatives(queries, qrels, corpus, 9).count() == 90  # every other document
    queries, corpus, qrels = relations_of(spark, 9)
    with pytest.raises(Exception, match="fewer than 9"):
        neg.random_negatives(queries, qrels, corpus, 9).collect()


def test_qrels_violations(spark):
    queries = spark.createDataFrame([("all", q, "") for q in "abc"], "split string, qid string, query string")
    qrels = spark.createDataFrame(
        [("all", "a", "d1", 1), ("all", "b", "d1", 1), ("all", "b", "d2", 1), ("all", "c", "d1", 0)],
        "split string, qid string, docno string, label int",
    )
    assert {(r.qid, r.n_relevant) for r in rel.qrels_violations(queries, qrels).collect()} == {("b", 2), ("c", 0)}


def test_split_keeps_queries_together(spark):
    rows = groups_of(spark, [10, 9] * 21)
    got = splits.split_by_query(rows, 0.9, 3)
    sides = {r.qid: r.sides for r in got.groupBy("qid").agg(F.collect_set("side").alias("sides")).collect()}
    assert all(len(s) == 1 for s in sides.values())
    assert sum(s == ["train"] for s in sides.values()) == int(42 * 0.9)
    summary = {r.side: (r.n_rows, r.n_queries) for r in splits.split_summary(got).collect()}
    assert sum(n for n, _ in summary.values()) == rows.count()


def test_r10(spark, ws):
    rows = [("all", "tie", "a", 0, 1, 2.0), ("all", "tie", "b", 1, 2, 2.0), ("all", "win", "a", 0, 1, 1.0),
            ("all", "win", "b", 1, 2, 1.5), ("all", "nan", "a", 0, 1, 9.0), ("all", "nan", "b", 1, 2, float("nan"))]
    df = spark.createDataFrame(rows, "split string, qid string, docno string, label int, pos int, logit double")
    got = evaluation.r10_at_1(df).first()
    assert (got.n_queries, got.n_correct) == (3, 2)
    short = groups_of(spark, [9] * 11).withColumn("logit", F.col("label").cast("double"))
    per_query, blocks = evaluation.r10_at_1(short).first(), evaluation.r10_batched(ws, short).first()
    assert (per_query.n_queries, per_query.n_correct) == (11, 11)
    assert (blocks.n_queries, blocks.n_correct) == (10, 10)  # 99 rows make ten blocks, one with two positives
    audit = {(r.n_rows, r.n_relevant): r.n_queries for r in evaluation.group_sizes(short).collect()}
    assert audit == {(9, 1): 11}


def test_encoding(spark):
    queries = spark.createDataFrame([("all", "q1", "a b a"), ("all", "q2", "")], "split string, qid string, query string")
    corpus = spark.createDataFrame([("all", "d1", "a c " + "b " * 9), ("all", "d2", "zz")], "split string, docno string, text string")
    vocab = encoding.vocabulary(queries, corpus, 3)
    ids = {r.term: r.id for r in vocab.collect()}
    assert ids == {"b": 4, "a": 5, "c": 6}
    rows = spark.createDataFrame([("all", "q1", "d1", 1), ("all", "q2", "d2", 0)], "split string, qid string, docno string, label int")
    got = {r.qid: r for r in encoding.encode_pairs(rows, queries, corpus, vocab, 10).collect()}
    assert got["q1"].input_ids == [2, 5, 4, 5, 3, 5, 6, 4, 4, 3]
    assert got["q1"].attention_mask == [1] * 10
    assert got["q2"].input_ids == [2, 3, 1, 3, 0, 0, 0, 0, 0, 0]
    assert got["q2"].attention_mask == [1] * 4 + [0] * 6
    profile = encoding.truncation_profile(encoding.encode_pairs(rows, queries, corpus, vocab, 10)).collect()
    assert {(r.label, r.n_truncated) for r in profile} == {(0, 0), (1, 1)}


def test_ranker_recovers_soft_labels(spark, ws):
    x = F.col("id") / 500.0 - 1.0
    zero = F.lit(0.0)
    rows = spark.range(1000).select(
        x.alias("bm25"),
        (F.col("id") % 7).cast("double").alias("tf_idf"),
        (F.col("id") % 5).cast("double").alias("overlap"),
        (F.col("id") % 3).cast("double").alias("length_ratio"),
        (1 / (1 + F.exp(-(2 * x - 1)))).alias("target"),
        zero.alias("unused"),
    )
    model = ranker.fit_ranker(ws, rows, max_iter=100)
    got = {r.feature: r.coefficient for r in ranker.coefficients(model, spark).collect()}
    assert got["bm25"] == pytest.approx(2.0, abs=0.01)
    assert got["intercept"] == pytest.approx(-1.0, abs=0.01)


def test_grids():
    assert len(set(grids.main_grid())) == 100
    assert len(set(grids.ablation_grid())) == 25


@pytest.mark.parametrize("relevant", [0, 1, 2])
def test_exactly_one_relevant_document(spark, relevant):
    queries = spark.createDataFrame([("all", "q7", "x")], "split string, qid string, query string")
    rows = [("all", "q7", f"d{i}", 1) for i in range(relevant)] + [("all", "q7", "other", 0)]
    qrels = spark.createDataFrame(rows, "split string, qid string, docno string, label int")
    truth = rel.ground_truth(queries, qrels)
    if relevant == 1:
        assert [r.gt for r in truth.collect()] == ["d0"]
    else:
        with pytest.raises(Exception, match=f"query q7 of split all has {relevant} relevant documents"):
            truth.collect()


def test_blocks_follow_the_order_of_rows(spark, ws):
    rows = []
    for ordinal, qid, n, relevant in ((2, "q2", 9, 9), (10, "q10", 10, 1), (11, "q11", 10, 10)):
        for pos in range(1, n + 1):
            hit = int(pos == relevant)
            rows.append(("all", qid, ordinal, f"d{pos}", pos, hit, float(hit)))
    df = spark.createDataFrame(
        rows, "split string, qid string, ordinal int, docno string, pos int, label int, logit double"
    )
    # q2 comes first and q10's relevant row falls into its block: the second block has none.
    by_row = evaluation.r10_batched(ws, df, order=("ordinal",)).first()
    assert (by_row.n_queries, by_row.n_correct) == (3, 2)
    by_text = evaluation.r10_batched(ws, df).first()  # q10, q11, q2: no block is mixed
    assert (by_text.n_queries, by_text.n_correct) == (3, 3)


def test_classic_mode(spark):
    rows = spark.createDataFrame([(1, 0.5, 0, 10), (0, 1.0, 0, 10)], "label int, score double, seen int, total int")
    plan = rows.withColumn("split", F.lit("all"))
    got = {r.label: (r.eps, round(r.target, 6)) for r in plan_targets(plan, "classic", 0.2).collect()}
    assert got == {1: (0.2, 0.9), 0: (0.2, 0.1)}
    got = {r.label: round(r.target, 6) for r in plan_targets(plan, "ls", 0.2).collect()}
    assert got == {1: 0.9, 0: 0.2}
