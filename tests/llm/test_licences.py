"""License scans against comparing every window exactly."""

import random

from odd import docs_of, odd_docs, odd_texts

from rankloom.llm import licences


def words(text):
    return licences.WORD.findall(text.lower())


def exact(text, template, least=0.8):
    """Whether some window of the size class holds enough of the template's shingles."""
    t, d = words(template), words(text)
    k = min(5, len(t))
    wanted = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    size, _ = licences.window_of(len(wanted))
    have = [tuple(d[i : i + k]) for i in range(len(d) - k + 1)]
    return any(len(wanted & {*have[i : i + len(wanted)]}) >= least * len(wanted) for i in range(len(have)))


def made(seed, n=120):
    rng = random.Random(seed)
    filler = [f"f{k}" for k in range(50)]
    out = []
    for k in range(n):
        w = [rng.choice(filler) for _ in range(rng.randrange(300))]
        for _ in range(rng.choice([0, 1, 2])):
            t = words(rng.choice(list(licences.TEMPLATES.values())))
            if rng.random() < 0.4:
                t[rng.randrange(len(t))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        out.append((k, " ".join(w)))
    return out


def test_scan_finds_what_an_exact_comparison_finds(spark):
    docs = made(1)
    got = {r.doc_id: set(r.licenses) for r in licences.scanned(spark, docs_of(spark, docs)).collect()}
    for doc, text in docs:
        want = {n for n, t in licences.TEMPLATES.items() if exact(text, t)}
        assert want <= got[doc]
        for name in got[doc] - want:  # only where the window is wider than the template
            assert licences.window_of(len(licences.TemplateBands(licences.TEMPLATES).shingles[name]))[1] > 1


def test_blocks_do_not_matter(monkeypatch):
    bands = licences.TemplateBands(licences.TEMPLATES)
    texts = [t for _, t in made(2, 40)]
    want = [bands.scan(t) for t in texts]
    monkeypatch.setattr(licences, "BLOCK", 64)
    assert [bands.scan(t) for t in texts] == want


def test_bands_guarantee():
    for similarity in (0.2, 0.5, 0.9, 1.0):
        assert (1 - similarity) ** licences.bands_needed(similarity, 1e-6) <= 1e-6


def test_templates_of_few_words_and_with_repeats_are_found():
    rng = random.Random(3)
    filler = lambda n: [f"f{rng.randrange(50)}" for _ in range(n)]
    passages = [[f"r{j}x{k}" for k in range(8)] for j in range(4)]
    repeats = " ".join(" ".join(p * 5) for p in passages)
    templates = {"one": "CC0", "two": "MIT License", "four": "Some Rights Reserved here", "repeats": repeats, **licences.TEMPLATES}
    bands = licences.TemplateBands(templates)
    for name, text in templates.items():
        for front, back in ((0, 0), (1, 1), (30, 0), (0, 30), (200, 70)):
            found = bands.scan(" ".join([*filler(front), text, *filler(back)]))
            assert found.get(name) == 1.0, (name, front, back)
    assert bands.scan("License MIT and CC 0, some rights here reserved") == {}


def test_odd_table(spark):
    docs = odd_texts() + [(20, "x Released under the MIT License."), (20, "x Released under the MIT License.")]
    got = licences.scanned(spark, docs_of(spark, docs)).collect()
    assert len(got) == len(docs) and [r.licenses for r in got if r.n_licenses] == [["MIT"], ["MIT"]]
    assert licences.scanned(spark, odd_docs(spark).limit(0)).count() == 0
