"""Cross-tokenizer alignment against plain loops over tokens and dense matrices."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd import docs_of, odd_docs, odd_texts
from tokenizers import Tokenizer

from rankloom.llm import alignment, queries
from rankloom.llm.bpe import byte_alphabet

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    value = {c: b for b, c in enumerate(byte_alphabet())}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def first(text):
        ids = whole.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(value[c] for c in whole.id_to_token(i)) for i in ids]

    def second(text):
        names = sp.encode(text, out_type=str)
        raw = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in names]
        return sp.encode(text), raw

    return first, second


def ends(parts):
    return np.cumsum([len(p) for p in parts]).tolist()


def brute(docs, sides):
    rows, counts = [], Counter()
    for doc, text in docs:
        (a, raw_a), (b, raw_b) = (side(text or "") for side in sides)
        want = b" " + (text or "").encode()
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            rows.append((doc, [], [], [], ""))
            continue
        at_a, at_b = ends(raw_a), ends(raw_b)
        links = [(x, at_b.index(e)) for x, e in enumerate(at_a) if e in set(at_b)]
        groups, i, j = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        rows.append((doc, a, b, pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (doc, len(a), len(b), len(p), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), sha)
            for doc, a, b, p, sha in rows
        ),
        key=str,
    )


def got(frame):
    return sorted((tuple(r)[:8] for r in frame.collect()), key=str)


def test_registered_query(spark, sides):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 20_000]
    out = queries.LLM_REGISTRY["op13_token_incidence"](spark, SF)
    assert out.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert len(docs) > 0.9 * len(whole) and got(out) == brute(whole, sides)


def texts():
    return odd_texts()[:7] + [
        (20, "naïve café — 世界 😀😀 don't  two  blanks\n\n\tand <|endoftext|> or <s> </s> <unk> <0x41>"),
        (21, " leading"), (22, "▁ lower block"), (23, " "), (24, "\x00\x01 control"), (25, "ﬁne ① ｆｕｌｌ"), (26, "a\r\nb"),
    ]


@pytest.mark.parametrize("few", [0, 10**6])
def test_odd_table(spark, sides, few):
    docs = texts()
    assert got(alignment.digests(spark, docs_of(spark, docs), A, B, few)) == brute(docs, sides)
    if few:
        assert alignment.digests(spark, odd_docs(spark), A, B).count() == len(odd_texts())
        assert alignment.digests(spark, odd_docs(spark).limit(0), A, B).count() == 0


def random_ends(rng, n):
    cuts = np.flatnonzero(rng.random(n - 1) < rng.choice([0.1, 0.4, 0.9])) + 1
    return np.append(cuts, n)


def test_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(alignment, "SLICE", 5)
    for _ in range(100):
        n = int(rng.integers(1, 60))
        x, y = random_ends(rng, n), random_ends(rng, n)
        dense = [np.array([[lo <= k < hi for k in range(n)] for lo, hi in zip([0, *e[:-1]], e)], int) for e in (x, y)]
        want = dense[0] @ dense[1].T
        seen = np.zeros_like(want)
        for i, j, v in zip(*alignment.overlaps(x, y)):
            seen[i, j] += v
        assert (seen == want).all()
        found = alignment.aligned(x, y)
        assert list(zip(found.links_a, found.links_b)) == [(i, j) for i, e in enumerate(x) for j, f in enumerate(y) if e == f]
        group = [np.searchsorted(x[found.links_a], e) for e in (x, y)]
        pairs = {(i, j) for i in range(len(x)) for j in range(len(y)) if group[0][i] == group[1][j]}
        assert set(zip(*map(list, alignment.shared_links(found)))) == pairs and found.n_shared == len(pairs)
        some = set(zip(*map(list, alignment.shared_links(found, 1, 2))))
        assert some == {(i, j) for i, j in pairs if 1 <= group[0][i] <= 2}


def test_pairs_of_groups_come_from_the_product(monkeypatch):
    """The token-group matrices are multiplied, in slices that also cut a group; a broken product shows in the count."""
    monkeypatch.setattr(alignment, "SLICE", 7)
    x, y = np.array([1, 2, 3, 4, 5, 9, 10, 12]), np.array([5, 6, 7, 8, 10, 11, 12])
    assert alignment.aligned(x, y).n_shared == 5 + 2 * 4 + 2
    whole, widths = alignment.product, []
    monkeypatch.setattr(alignment, "product", lambda a, b: widths.append(a.width) or whole(a, b))
    alignment.aligned(x, y)
    # Bytes of the overlaps' slices, then groups.
    assert sum(widths) > 12 and min(widths) <= 3


def test_any_sparse_product():
    rng = np.random.default_rng(3)
    for _ in range(50):
        m, k, n = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (m, k)), rng.integers(0, 3, (k, n))
        csr = [alignment.Csr(np.concatenate(([0], np.cumsum((d > 0).sum(1)))), np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in (x, y)]
        out = alignment.product(*csr)
        dense = np.zeros((m, n), int)
        for r in range(m):
            dense[r, out.columns[out.begins[r] : out.begins[r + 1]]] = out.values[out.begins[r] : out.begins[r + 1]]
        assert (dense == x @ y).all()


def test_runs_of_blanks_fall_back_to_the_library(sides):
    one = alignment.byte_level(A)
    for text in (" " * 2_000_000, "\n" * 2_000_000):
        assert list(one.encode(text)) == sides[0](text)[0]
