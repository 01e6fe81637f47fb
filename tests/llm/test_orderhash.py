"""Order MinHash classes against comparing all pairs."""

import random
from collections import Counter

import numpy as np
from odd import docs_of, odd_docs, odd_texts
from pyspark.sql import functions as F

from rankloom.llm import orderhash


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def linked(a, b, least=0.8):
    u, v = a.split(), b.split()
    if not u or not v:
        return False
    return indel(u, v) <= int((1 - least) * (len(u) + len(v)) + 1e-9)


def brute(docs):
    texts = sorted({t or "" for _, t in docs})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if linked(a, b):
                root[find(b)] = find(a)
    groups = {}
    for t in texts:
        groups.setdefault(find(t), set()).add(t)
    out = Counter()
    for doc, t in docs:
        group = groups[find(t or "")]
        named = [d for d, x in docs if (x or "") in group and d is not None]
        out[doc, min(named, default=None), len(group)] += 1
    return out


def varied(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 80, 150]))] for _ in range(25)]
    docs = []
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], [rng.choice(vocabulary)]])
            w = w or ["one"]
        docs.append((k, " ".join(w)))
    return docs


def test_classes_equal_all_pairs(spark):
    for seed in (1, 2):
        docs = varied(seed)
        assert Counter(tuple(r) for r in orderhash.classes(spark, docs_of(spark, docs)).collect()) == brute(docs)


def test_members_of_different_hubs_are_linked(spark):
    w = [f"v{k}" for k in range(100)]
    text = {"h1": w[:60], "a": w[10:70], "b": w[20:80], "h2": w[30:90]}
    text = {n: " ".join(x) for n, x in text.items()} | {"h3": " ".join(f"u{k}" for k in range(60))}
    edges = {(x, y) for x in text for y in text if x < y and linked(text[x], text[y])}
    assert edges == {("a", "h1"), ("b", "h2"), ("a", "b")}
    # Further buckets, of texts that are not linked, give the weights: h1, h2, h3, then a and b.
    names = ["h1", "h2", "h3", "a", "b"]
    own = {"h1": [2, 3, 4, 5], "h2": [6, 7, 8], "h3": [9, 10], "a": [], "b": []}
    docs = [(k, text[n]) for k, n in enumerate(names)]
    sketch = {k: [1, *own[n]] for k, n in enumerate(names)}
    for k, bucket in enumerate(range(2, 11), 5):
        docs.append((k, " ".join(f"o{k}x{j}" for j in range(30))))
        sketch[k] = [bucket]
    rows = docs_of(spark, docs)
    keys = {r.doc_id: r.k for r in rows.select("doc_id", orderhash.text_key().alias("k")).collect()}
    sizes = {k: len(t.split()) for k, t in docs}
    nodes = spark.createDataFrame(
        [(k, keys[k], sizes[k], s) for k, s in sketch.items()], "node bigint, key binary, words bigint, sketch array<bigint>"
    )
    roots = {r.node: r.root for r in orderhash.class_roots(spark, rows, nodes).collect()}
    assert {roots.get(k) for k in (0, 1, 3, 4)} == {0} and roots.get(2) in (None, 2)


def test_chains_of_links_become_one_class(spark):
    words = [f"v{k}" for k in range(100)]
    docs = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(13)]
    docs = [(100 - i, t) for i, t in docs]
    assert Counter(tuple(r) for r in orderhash.classes(spark, docs_of(spark, docs)).collect()) == brute(docs)


def short_pairs():
    """Pairs of 8 to 16 words, and of 50 to 62 k-mers, that differ at one end, each of its own words."""
    docs, at = [], 0

    def words(n):
        nonlocal at
        at += 1
        return [f"p{at}x{k}" for k in range(n)]

    for n in range(8, 17):
        for more in (1, 2):
            for front in (False, True):
                w, extra = words(n), words(more)
                docs += [" ".join(w), " ".join(extra + w if front else w + extra)]
        w = words(n)
        docs += [" ".join(w), " ".join(w[:-1] + words(1)), " ".join(w[: n // 2] + words(1) + w[n // 2 :])]
    for n, more in ((50, 12), (50, 13), (49, 12), (51, 12), (62, 15)):
        w = words(n + 4)
        docs += [" ".join(w), " ".join(w + words(more))]
    line = words(9)
    docs += [" ".join(line + words(4 + k % 9)) for k in range(40)]
    return [(k, t) for k, t in enumerate(docs)]


def test_short_texts_equal_all_pairs(spark):
    docs = short_pairs()
    want = brute(docs)
    assert sum(n == 2 for _, _, n in want) > 60
    assert Counter(tuple(r) for r in orderhash.classes(spark, docs_of(spark, docs)).collect()) == want


def test_a_common_line_is_no_bucket_of_short_texts(spark):
    docs = docs_of(spark, [(k, "this one line is in all of the short texts " + " ".join(f"c{k}x{j}" for j in range(24 + k % 9))) for k in range(60)])
    nodes = orderhash.sketched(docs).withColumnRenamed("doc_id", "node")
    assert orderhash.prefixes(nodes).isEmpty()


def test_odd_table(spark):
    docs = [(i, t) for i, t in odd_texts() if i != 7]
    assert Counter(tuple(r) for r in orderhash.classes(spark, docs_of(spark, docs)).collect()) == brute(docs)
    kept = orderhash.deduplicated(spark, odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [0, 2, 3, 4, 7, None, 8, 9]))
    assert orderhash.classes(spark, odd_docs(spark).limit(0)).count() == 0


def test_alignment():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randrange(30))]
        b = [rng.choice("abc") for _ in range(rng.randrange(30))] if rng.random() < 0.5 else a[:5] + ["x"] + a[5:]
        want, limit = indel(a, b), rng.randrange(40)
        assert orderhash.banded_distance(a, b, limit) == (want if want <= limit else None)


def test_sketch_depends_on_order_and_occurrence():
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    # With 8 picks; of the query's 4, all come from one half in one of eight sketches, which then does not see the exchange.
    x, y = (orderhash.sketches(orderhash.kmers(t), 8, 40) for t in (f"{a} {b}", f"{b} {a}"))
    assert sum(p == q for p, q in zip(x, y)) <= 2
    twice = orderhash.kmers("a b c d e " * 9)
    assert len(np.unique(twice)) == len(twice)


def test_blocks_do_not_change_sketches(monkeypatch):
    codes = orderhash.kmers(" ".join(f"z{k % 411}" for k in range(3000)))
    want = orderhash.sketches(codes)
    monkeypatch.setattr(orderhash, "BLOCK", 100)
    assert orderhash.sketches(codes) == want


def test_parities_never_exceed_the_distance():
    rng = random.Random(5)
    for n in (1, 12, 80, 700, 3000):
        a = [f"w{rng.randrange(n)}" for _ in range(n)]
        for _ in range(8):
            b = list(a)
            for _ in range(rng.choice([0, 1, n // 8, n])):
                b.insert(rng.randrange(len(b) + 1), f"w{rng.randrange(2 * n)}")
                b.pop(rng.randrange(len(b)))
            one, two = (orderhash.parities(" ".join(w)) for w in (a, b))
            found = sum(int(x).bit_count() for x in (one ^ two).view(np.uint64))
            assert found <= orderhash.banded_distance(a, b, len(a) + len(b))
            assert a != b or not found


def test_parities_see_words_that_occur_unequally_often():
    one, two = orderhash.parities("a a a a b"), orderhash.parities("b a a")
    assert sum(int(x).bit_count() for x in (one ^ two).view(np.uint64)) == 2


def test_parities_hold_long_texts_of_few_words_apart(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(200)]
    base = rng.choices(words, [1 / (k + 1) for k in range(200)], k=900)

    def varied(share: float, pool: str) -> str:
        return " ".join(w if rng.random() > share else f"{pool}{rng.randrange(2000)}" for w in base)

    texts = spark.createDataFrame(
        [(0, " ".join(base)), (1, varied(0.1, "x")), (2, varied(0.3, "y")), (3, " ".join(sorted(base)))], "node bigint, text string"
    )
    odd = orderhash.parities_of(spark, texts)
    sides = [odd.select(F.col("node").alias(f"n{k}"), F.col("odd").alias(f"odd{k}")) for k in (1, 2)]
    pairs = sides[0].crossJoin(sides[1]).where("n1 < n2").where(orderhash.in_reach("odd1", "odd2", F.lit(360.0)))
    # 0 and 2 differ in 526 words, 1 and 2 in 642: 1,024 parities of words without occurrences, as before, differ in 226 and 276.
    assert sorted((r.n1, r.n2) for r in pairs.collect()) == [(0, 1), (0, 3), (1, 3)]


def test_texts_of_one_bucket_that_parities_hold_apart_are_no_pairs(spark, monkeypatch):
    line = " ".join(f"common{k}" for k in range(12))
    docs = [(k, f"{line} " + " ".join(f"own{k}x{j}" for j in range(30))) for k in range(40)]
    docs += [(100 + k, text.replace("x7", f"y{k}")) for k, text in docs[:3]]
    rows = docs_of(spark, docs)
    keys = {r.doc_id: r.k for r in rows.select("doc_id", orderhash.text_key().alias("k")).collect()}
    nodes = spark.createDataFrame(
        [(k, keys[k], 42, [1, 2 + k % 100]) for k, _ in docs], "node bigint, key binary, words bigint, sketch array<bigint>"
    )
    asked = []
    verified = orderhash.verified
    monkeypatch.setattr(orderhash, "verified", lambda spark, pairs, *rest: asked.append(pairs.distinct().count()) or verified(spark, pairs, *rest))
    roots = {r.node: r.root for r in orderhash.class_roots(spark, rows, nodes).collect()}
    assert roots == {0: 0, 100: 0, 1: 1, 101: 1, 2: 2, 102: 2}
    assert sum(asked[1:]) == 0 and asked[0] <= 45
