"""Training along a plan against a plain loop, and the preparation of several splits from TSV."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import ranker
from rankloom.plans.fitting import AdamW, fit_history, fit_on_plan
from rankloom.plans.preparation import prepare_from_tsv
from rankloom.plans.training import plan_targets, training_plan
from rankloom.sources.tables import read_training_table

FEATURES = ["a", "b"]


def rows(spark, n=90):
    draw = random.Random(5)
    data = []
    for i in range(n):
        label = int(i % 3 == 0)
        data.append(("all", f"q{i // 3}", f"d{i}", draw.random() + label, 7.0 * draw.random(), draw.random(), label))
    return spark.createDataFrame(data, "split string, qid string, docno string, a double, b double, score double, label int")


def targets(spark, ws, mode, n=90):
    plan = training_plan(rows(spark, n), batch_size=8, seed=1, epochs=2.5)
    return ws.stage(plan_targets(plan, mode, 0.4, "linear").withColumn("mode", F.lit(mode)), "targets")


def by_loop(data, steps, adam):
    """Blocks in order, one update each, in NumPy; returns the weights and the loss of each batch."""
    x = np.array([[r.a, r.b] for r in data])
    mean, sd = np.round(x.mean(0), 6), np.round(x.std(0), 6)
    x = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    y = np.array([r.target for r in data])
    block = np.array([min(r.seen * steps // r.total, steps - 1) for r in data])
    w, m, v, t, losses = np.zeros(3), np.zeros(3), np.zeros(3), 0, {}
    for step in range(steps):
        here = block == step
        if not here.any():
            continue
        z = x[here] @ w
        for seen, zi, yi in zip(np.array([r.seen for r in data])[here], z, y[here]):
            losses.setdefault(int(seen), []).append(max(zi, 0) - zi * yi + math.log1p(math.exp(-abs(zi))))
        g = ((1 / (1 + np.exp(-z)) - y[here])[:, None] * x[here]).mean(0)
        t += 1
        m, v = adam.beta1 * m + (1 - adam.beta1) * g, adam.beta2 * v + (1 - adam.beta2) * g * g
        keep = 1 - adam.rate * adam.decay * np.array([0, 1, 1])
        w = w * keep - adam.rate * (m / (1 - adam.beta1**t)) / (np.sqrt(v / (1 - adam.beta2**t)) + adam.eps)
    return w, {s: sum(l) / len(l) for s, l in losses.items()}, mean, sd


@pytest.mark.parametrize("steps", [1, 6, 60])  # 60 is more than there are batches: some blocks are empty
def test_fit_equals_a_plain_loop(spark, ws, steps):
    both = {mode: targets(spark, ws, mode) for mode in ("baseline", "twsls")}
    fit = fit_on_plan(ws, both["baseline"].unionByName(both["twsls"]), FEATURES, ["mode"], steps)
    history = {(r.mode, r.instances_vues): r.loss for r in fit_history(fit).collect()}
    for mode, df in both.items():
        w, losses, mean, sd = by_loop(df.collect(), steps, AdamW())
        assert np.allclose(fit.weights[(mode,)], w, atol=1e-9)
        assert {s for m, s in history if m == mode} == set(losses)
        assert all(abs(history[mode, s] - loss) < 1e-9 for s, loss in losses.items())
        given = fit.coefficients((mode,))
        assert np.allclose([given["a"], given["b"]], w[1:] / sd)
        assert abs(given["intercept"] - (w[0] - (w[1:] / sd) @ mean)) < 1e-9


def test_schedule_and_order_change_the_model(spark, ws):
    found = []
    for mode, decay, seed in (("twsls", "linear", 1), ("twsls", "step", 1), ("twsls", "linear", 2)):
        plan = ws.stage(training_plan(rows(spark), batch_size=8, seed=seed, epochs=2.5), "plan")
        fit = fit_on_plan(ws, plan_targets(plan, mode, 0.4, decay), FEATURES, steps=8)
        found.append(tuple(round(w, 9) for w in fit.weights[("all",)]))
    assert len(set(found)) == 3


@pytest.mark.parametrize("decay", ["step", "linear", "exp", "cosine"])
def test_a_plan_with_targets_is_made_once(spark, decay):
    plan = training_plan(rows(spark), batch_size=8, seed=1, epochs=2.5)
    scans = [df._jdf.queryExecution().executedPlan().toString().count("Scan ") for df in (plan, plan_targets(plan, "twsls", 0.4, decay))]
    assert scans[0] == scans[1] > 0
    eps = {r.seen: r.eps for r in plan_targets(plan, "twsls", 0.4, decay).collect()}
    assert eps[0] == pytest.approx(0.4) and all(0 <= e <= 0.4 for e in eps.values()) and len(eps) > 20


def test_fit_on_nothing_constant_features_and_nulls(spark, ws):
    df = targets(spark, ws, "baseline")
    assert fit_on_plan(ws, df.limit(0), FEATURES, ["mode"], 3).weights == {}
    flat = fit_on_plan(ws, df.withColumn("b", F.lit(2.0)), FEATURES, ["mode"], 3)
    assert flat.weights[("baseline",)][2] == 0.0
    with pytest.raises(Exception, match="lacks a feature"):
        fit_on_plan(ws, df.withColumn("a", F.when(F.col("docno") != "d3", F.col("a"))), FEATURES, ["mode"], 3)


def test_learned_model_ranks_relevant_rows_higher(spark, ws):
    fit = fit_on_plan(ws, targets(spark, ws, "baseline"), FEATURES, ["mode"], 24)
    given = fit.coefficients(("baseline",))
    assert given["a"] > 0
    assert set(given) == {"intercept", *FEATURES} and set(ranker.GIVEN) >= {"intercept"}


def write_tsv(path, texts):
    path.write_text("context\tresponse\n" + "".join(f"{q}\t{d}\n" for q, d in texts))


def test_three_splits_from_tsv_and_one_alone(spark, ws, tmp_path):
    def texts(split, n):
        return [(f"{split} topic{i} word{i % 3}", f"reply topic{i} word{i % 3} {split}") for i in range(n)]

    sizes = {"train": 8, "valid": 4, "test": 5}
    for split, n in sizes.items():
        write_tsv(tmp_path / f"{split}.tsv", texts(split, n) + texts(split, 1))  # one pair twice
    paths = {split: f"file:{tmp_path}/{split}.tsv" for split in sizes}
    out = f"file:{tmp_path}/out"
    table = prepare_from_tsv(ws, paths, out, k=3)
    got = {r["split"]: r for r in table.groupBy("split").agg(F.sum("label").alias("n"), F.countDistinct("qid").alias("ids")).collect()}
    assert {s: (r.n, r.ids) for s, r in got.items()} == {s: (n + 1, n + 1) for s, n in sizes.items()}
    assert {r.qid for r in table.filter("split = 'valid'").collect()} == {f"q{i}" for i in range(1, 6)}
    assert all(r.split in r.query and r.split in r.text for r in table.collect())  # no text of another split

    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("split=*/*/*.parquet") if "valid" not in str(p)}
    write_tsv(tmp_path / "valid.tsv", texts("valid", 2))
    again = prepare_from_tsv(ws, paths, out, k=3, only=["valid"])
    assert again.filter("label = 1").count() == 2
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("split=*/*/*.parquet") if "valid" not in str(p)} == before
    prepare_from_tsv(ws, paths, out, k=1, method="random", only=["train"])
    whole = read_training_table(spark, out)
    assert {tuple(r) for r in whole.groupBy("split", "method").agg(F.sum("label")).collect()} == {
        ("train", "BM25", 9), ("test", "BM25", 6), ("valid", "BM25", 2), ("train", "random", 9)
    }
    with pytest.raises(ValueError, match="no file"):
        prepare_from_tsv(ws, paths, out, only=["dev"])
