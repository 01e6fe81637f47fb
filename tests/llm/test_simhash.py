"""SimHash components against comparing all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from odd import docs_of, odd_docs, odd_texts

from rankloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    size = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, distance=4):
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    array = np.array(prints, np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= distance):
            root[find(prints[i + 1 + j])] = find(p)
    return {p: find(p) for p in prints}


def brute(docs):
    prints = [(doc, plain(text)) for doc, text in docs]
    found = classes(p for _, p in prints)
    least = {}
    for doc, p in prints:
        if doc is not None:
            least[found[p]] = min(doc, least.get(found[p], doc))
    return sorted(((doc, f"{p:016x}", least.get(found[p])) for doc, p in prints), key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.LLM_REGISTRY["op12_deletion_variants"](spark, SF)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    want = brute(docs)
    assert rows(out) == want and len({c for _, _, c in want}) < len(want)


def test_odd_table(spark):
    assert rows(simhash.component_ids(spark, odd_docs(spark))) == brute(odd_texts())
    assert simhash.component_ids(spark, odd_docs(spark).limit(0)).count() == 0


def test_only_null_ids(spark):
    out = rows(simhash.component_ids(spark, docs_of(spark, [(None, "a b c d e"), (None, "")])))
    assert [c for _, _, c in out] == [None, None]


def test_words_of_any_blanks_and_letters(spark):
    texts = ["A\tB\x0bC\x0cD\rE\nF G", "Ä É ﷺ   two　words\x1cmore here again", "a b c d", "a b c", "x" * 10, "ONE two"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain(t)


def test_slices_do_not_change_fingerprints(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "b", "c" * 50, "dd\n\n", "E"]) for _ in range(rng.randrange(400))) for _ in range(20)]
    want = [simhash.fingerprint(t.encode()) for t in texts]
    monkeypatch.setattr(simhash, "SLICE", 16)
    assert [simhash.fingerprint(t.encode()) for t in texts] == want == [plain(t) for t in texts]


def test_linked_prints_share_a_variant_and_a_segment():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, 300, np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    free = rng.integers(0, 1 << 64, 300, np.uint64) | np.uint64(31)
    for work in (lambda p: simhash.struck(p, 3), lambda p: simhash.agreed(p, a, free, a, 5)):
        same = sum((x == y).astype(int) for (_, x, _), (_, y, _) in zip(work(a), work(b)))
        assert len(same) == 300 and min(same) >= 1


def test_one_variant_reports_a_link(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 64, 400, np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in rng.choice([0, 21, 22, 42, 43, 63, *range(64)], i % 5):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    shared = np.stack([x == y for (_, x, _), (_, y, _) in zip(simhash.struck(a, 3), simhash.struck(b, 3))])
    rows = zip(range(400), a.view(np.int64).tolist(), b.view(np.int64).tolist())
    frame = spark.createDataFrame(rows, "i int, hub bigint, node bigint")
    got = {r.i: r.s for r in frame.select("i", simhash.first_spot(3).alias("s")).collect()}
    assert got == dict(enumerate(shared.argmax(axis=0)))


def crowded(seed):
    """Balls, chains of steps and strangers that share two thirds of their bits."""
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(80):
        p = base
        for b in rng.sample(range(64), rng.choice([2, 4, 5, 7, 9])):
            p ^= 1 << b
        prints.add(p)
    p = base ^ (0xFFFF << 40)
    for _ in range(20):
        for b in rng.sample(range(64), 4):
            p ^= 1 << b
        prints.add(p)
    low = base & (1 << 43) - 1
    prints |= {low | rng.getrandbits(21) << 43 for _ in range(60)}
    return sorted(prints)


@pytest.mark.parametrize("crowd", [32, 10**9])
def test_crowds(spark, crowd):
    prints = crowded(8)
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print bigint")
    edges = simhash.links(spark, frame, crowd=crowd)
    roots = {r.node: r.root for r in simhash.components(spark, edges).collect()}
    got, want = {}, {}
    for p, s in zip(prints, signed):
        got.setdefault(roots.get(s, s), set()).add(p)
    for p, r in classes(prints).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(len(x) for x in want.values()) > 20 and len(want) > 40


def test_too_small_crowds_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark, spark.createDataFrame([], "print bigint"), crowd=8)
