"""Statistics against counting, learned lists on labelled tables."""

import re
from collections import Counter

from odd import odd_docs, odd_texts
from pyspark.sql import functions as F

from rankloom.llm import rules
from rankloom.llm.queries import LLM_REGISTRY

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len({*lines}), len(inside)


def failed(n_words, n_repeat):
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def test_query(spark, sf_docs):
    texts = {r.doc_id: r.text for r in sf_docs.collect()}
    got = LLM_REGISTRY["op4_decision_list"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert tuple(r)[1:6] == want and r.base_failed == failed(want[0], want[4]) and not (r.base_failed and r.kept)


def test_odd_table(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 0)], "doc_id bigint, quality int")
    got = Counter(tuple(r)[:6] for r in rules.judged(spark, odd_docs(spark), labels).collect())
    assert got == Counter((i, *brute(t)) for i, t in odd_texts())
    assert rules.judged(spark, odd_docs(spark).limit(0), labels).count() == 0
    kept = rules.judged(spark, odd_docs(spark), labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in kept)


def test_list_learns_a_conjunction(spark):
    rows = spark.createDataFrame(
        [(k, *((k * p % 997) / 997 for p in (3, 7, 11, 13, 17, 19, 23, 29))) for k in range(3000)],
        "doc_id bigint, " + ", ".join(f"{n} double" for n in rules.RATIOS),
    )
    bad = (F.col("symbol_share") > 0.7) & (F.col("length") <= 0.5)
    labels = rows.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality"))
    found = rules.learn(spark, rows, labels)
    wrong = rows.join(labels, "doc_id").where(rules.verdict(found) != (F.col("quality") == 1)).count()
    assert found and wrong / 3000 < 0.03
    assert all(len(r) <= 3 for r in found) and "symbol_share >" in " ".join(map(str, found[0]))


def test_main_path_is_native(spark, sf_docs):
    plan = rules.statistics(sf_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
