"""Decontamination against a scan of every window."""

import hashlib
import re
from collections import Counter

from compare import duck, mismatch
from odd import docs_of, odd_docs, odd_texts

from rankloom.llm import decontam
from rankloom.llm.oracle import LLM_ORACLE
from rankloom.llm.queries import LLM_REGISTRY

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = Counter()
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                items_here = windows.get(tuple(w[k : k + n]))
                if items_here:
                    hit |= set(range(k, k + n))
                    found |= items_here
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[doc, len(w), len(hit), len(found), sha, bool(hit)] += 1
    return out


ITEMS = [
    (1, "Two three four"), (2, "three FOUR five six seven eight nine ten eleven twelve thirteen"), (10, "two, three: four!"),
    (3, None), (4, ""), (5, "x é 世界"), (6, "é 世界 😀 and"), (None, "same line"), (7, "word5 other5 word6 other6 word7 other7 word8 other8 word9 other9 word10"),
]


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id bigint, text string, phrase string")


def test_odd_table(spark):
    items = [r for r in ITEMS if r[0] is not None]
    got = Counter(tuple(r) for r in decontam.judged(spark, odd_docs(spark), items_of(spark, items)).collect())
    assert got == brute(odd_texts(), items)
    assert decontam.judged(spark, odd_docs(spark).limit(0), items_of(spark, items)).count() == 0
    clean = decontam.judged(spark, odd_docs(spark), items_of(spark, [])).collect()
    assert len(clean) == len(odd_texts()) and not any(r.contaminated for r in clean)


def test_null_item_ids_do_not_crash(spark):
    got = decontam.judged(spark, odd_docs(spark), items_of(spark, ITEMS)).where("doc_id = 9").first()
    assert got.contaminated and got.n_hit == 100


def test_rows_without_hits_stay(spark):
    items = items_of(spark, [(1, "two three four")])
    left = decontam.without_contaminated(spark, odd_docs(spark), items)
    assert left.columns == odd_docs(spark).columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, [0, 1, 2, 3, 7, None, 8, 9]))


def test_proximity(spark):
    docs = docs_of(spark, [(1, "alpha beta extra gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha gamma")])
    items = items_of(spark, [(1, "alpha beta gamma delta")])
    _, found = decontam.matches(spark, docs, items, size=4, slop=2)
    assert {(r.doc_id, r.exact) for r in found.collect()} == {(1, False), (2, True)}


def test_query(spark, sf_docs):
    docs = [(r.doc_id, r.text) for r in sf_docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in LLM_REGISTRY["op9_positional_index"](spark, SF).collect()) == brute(docs, items)


def test_query_equals_its_twin(spark):
    assert mismatch(LLM_REGISTRY["op9_positional_index"](spark, SF).toPandas(), duck(SF).execute(LLM_ORACLE["op9_positional_index"]).df()) is None
