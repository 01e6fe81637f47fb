"""Plain Python answers for small inputs."""

import math
import re
from collections import Counter


def words(text):
    return [w for w in re.split(r"\s+", re.sub(r"[^\w\s]", " ", text).lower()) if w]


def scores(corpus, query, idf="classic", model="bm25"):
    bags = {d: Counter(words(t)) for d, t in corpus.items()}
    n = len(bags)
    avg = sum(sum(b.values()) for b in bags.values()) / n
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for d, bag in bags.items():
        k = 1.2 * (0.25 + 0.75 * sum(bag.values()) / avg)
        total, hit = 0.0, False
        for w, qtf in Counter(words(query)).items():
            if w not in bag:
                continue
            hit = True
            sat = bag[w] / (bag[w] + k)
            if model == "tfidf":
                total += math.log2(n / df[w] + 1) * 1.2 * sat * qtf
                continue
            odds = (n - df[w] + 0.5) / (df[w] + 0.5)
            total += (math.log2(odds) if idf == "classic" else math.log1p(odds)) * 2.2 * sat * 9 * qtf / (8 + qtf)
        if hit:
            out[d] = round(total, 6)
    return out


def top(scored, k):
    return sorted(scored.items(), key=lambda item: (-item[1], item[0]))[:k]
