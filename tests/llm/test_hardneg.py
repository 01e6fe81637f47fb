"""Four-Russians scores and the negatives mined with them, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import hardneg, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, of string, part int, slice int, ids string, found int, world string"


def brute(rows):
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = label, [math.floor(256 * float(np.float32(x))) for x in vector]
        kept[vec_id] = min(kept.get(vec_id, row), row)
    out = []
    for a in (i for i in kept if i % 100 == 0):
        label, vector = kept[a]
        by_score = sorted((-sum(x * y for x, y in zip(vector, v)), i, other) for i, (other, v) in kept.items() if i != a)
        for negated, positive, _ in [x for x in by_score if x[2] == label][:5]:
            fit = [(-s, i) for s, i, other in by_score if other != label and 30 * -negated <= 100 * -s <= 90 * -negated]
            out += [(a, positive, n, i, -negated, s) for n, (s, i) in enumerate(fit[:10], 1)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_registered_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries.LLM_REGISTRY["op11_four_russians"](spark, SF)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(out) == brute(rows) and out.count() > 0


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 13) / 8).tolist(), int(rng.integers(3))) for i in range(260)]
    rows += [(i, [0.25] * 13, 1) for i in range(300, 420)]  # ties
    rows += [rows[0], rows[100], (200, None, 1), (200, [0.5] * 13, 2)]  # repeated ids
    rows += [(500, None, 1), (600, [0.5] * 13, None), (None, [0.5] * 13, 1), (700, [float("nan")] * 13, 1)]
    rows += [(800, [None] + [0.5] * 12, 1), (900, [float("inf")] * 13, 2), (901, [-float("inf")] * 13, 2)]
    rows += [(1000, [], 0), (1100, [0.5] * 4, 1), (1101, [0.25] * 21, 1), (1200, [0.0] * 13, 77)]
    return rows


@pytest.mark.parametrize("block, anchors", [(4096, 256), (16, 2)])
def test_odd_table(spark, block, anchors):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y", 3, "z") for r in rows], SCHEMA).repartition(3)
    is_anchor, label = F.expr("vec_id % 100 = 0"), F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    out = hardneg.mined(spark, frame, is_anchor, label, block=block, anchors_per_block=anchors)
    assert got(out) == brute(rows) and out.count() > 100
    if block == 16:
        assert hardneg.mined(spark, frame.limit(0), is_anchor, label).count() == 0


def test_too_large_components_are_named(spark):
    frame = spark.createDataFrame([(5, [1e9], 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(Exception, match="too large: row 5"):
        hardneg.usable(frame).collect()


def test_scores_are_inner_products():
    rng = np.random.default_rng(2)
    for top in (1, 2, 9, 300, 1 << 23):
        a, b = rng.integers(-top, top, (7, 24)), rng.integers(-top, top, (50, 24))
        assert (hardneg.scores(hardneg.subset_sums(a), hardneg.planes(b)) == a @ b.T).all()
    ones = np.full((2, 8), -1)
    assert hardneg.planes(ones).shape == (1, 1, 2) and (hardneg.scores(hardneg.subset_sums(ones), hardneg.planes(ones)) == 8).all()
