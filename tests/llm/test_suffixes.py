"""Removal of repeated strings against counting every string."""

import hashlib
import random
from collections import Counter

import pytest
from odd import docs_of, odd_docs, odd_texts

from rankloom.llm import suffixes
from rankloom.llm.queries import LLM_REGISTRY

SF = "/root/testdata/sf0.001"


def brute(docs, length):
    seen = Counter(b[k : k + length] for _, t in docs for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    out = Counter()
    for doc, text in docs:
        b = (text or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                hit[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if hit[k] and (k == 0 or not hit[k - 1]))
        out[doc, len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()] += 1
    return out


def made(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cdé") for _ in range(200)) for _ in range(5)]
    docs = []
    for k in range(80):
        kind = rng.random()
        if kind < 0.1:
            text = rng.choice(["", None, "a" * rng.randrange(200), "abc" * rng.randrange(60)])
        else:
            text = ""
            for _ in range(rng.randrange(1, 5)):
                b, at = rng.choice(base), rng.randrange(180)
                text += b[at : at + rng.choice([5, 30, 60, 200])] + rng.choice(["", "x", "éé"])
        docs.append((k, text))
    return docs + docs[:5]


@pytest.mark.parametrize("seed,length,start", [(0, 40, 13), (1, 24, 8), (2, 30, 4)])
def test_equals_brute_force(spark, seed, length, start):
    docs = made(seed)
    got = Counter(tuple(r) for r in suffixes.removed(spark, docs_of(spark, docs), length, start).collect())
    assert got == brute(docs, length)


def test_odd_table(spark):
    got = Counter(tuple(r) for r in suffixes.removed(spark, odd_docs(spark), 50, 20).collect())
    assert got == brute(odd_texts(), 50)
    kept = suffixes.removed(spark, odd_docs(spark), 50, 20, keep_text=True)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(odd_texts())
    assert suffixes.removed(spark, odd_docs(spark).limit(0), 50, 20).count() == 0


def test_query(spark, sf_docs):
    docs = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert Counter(tuple(r) for r in LLM_REGISTRY["op6_repeated_strings"](spark, SF).collect()) == brute(docs, 400)
