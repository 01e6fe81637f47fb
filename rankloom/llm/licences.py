"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case, shingles runs of five of them. A template of fewer is one shingle, and
looked for among the document's shingles of its own size. A template of ``m`` shingles, repeated ones included, is looked for in windows that overlap so far that any run of ``m`` lies in one: of ``m`` shingles
at every place while ``m`` is below 8, else of three times the largest power of two within ``m``, at steps of that power. A
window that holds at least ``least`` of the template has a Jaccard similarity of at least ``least * m / (window + m -
least * m)``; every band is one MinHash, and a size class has as many bands as bring the probability of no collision at
that similarity below ``miss``. Candidates are then compared exactly: the share of the template's shingles in the window.

Templates are the caller's and go to every task; documents are scanned whole, in blocks, without a shuffle.

Defined results: null and empty texts have no license; a template found more often counts once, with its best containment;
templates with equal text are all reported, by name; equal rows get equal results; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import by_batch, small_batches, text_of

WORD = re.compile(r"[^\W_]+")
SHINGLE, LEAST, MISS = 5, 0.8, 1e-6
BLOCK = 1 << 14

# Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}


class WordHashes(dict):
    """64-bit hashes of words, for as many words as a worker should remember."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles in text order."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(codes))
    out = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - size + 1 + k])
    return out


def bands_needed(similarity: float, miss: float = MISS) -> int:
    """MinHash values of which none collides with probability ``miss`` at most."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - similarity)))


def window_of(m: int) -> tuple[int, int]:
    """Window size and step, in shingles, for a template of ``m`` shingles."""
    if m < 8:
        return m, 1
    scale = 1 << (m.bit_length() - 1)
    return 3 * scale, scale


class TemplateBands:
    """MinHash values of the templates by size class, ready to be looked up."""

    def __init__(self, templates: dict[str, str], least: float = LEAST, miss: float = MISS):
        self.least = least
        whole = {n: s for n, t in templates.items() if len(s := shingles(t))}
        self.shingles = {n: np.unique(s) for n, s in whole.items()}
        classes: dict[tuple[int, int, int], list[str]] = defaultdict(list)
        for name, s in whole.items():
            words = min(SHINGLE, len(WORD.findall(templates[name].lower())))
            classes[words, *window_of(len(s))].append(name)
        self.classes = []
        rng = np.random.default_rng(77)
        for (words, size, step), names in sorted(classes.items()):
            m = min(len(self.shingles[n]) for n in names)
            held = math.ceil(least * m - 1e-9)
            bands = bands_needed(held / (size + m - held), miss)
            factors = rng.integers(1, 1 << 63, bands, dtype=np.uint64) | np.uint64(1)
            table: dict[tuple[int, int], list[str]] = defaultdict(list)
            flags = np.zeros(1 << 16, bool)
            for name in names:
                for band, value in enumerate((self.shingles[name][None, :] * factors[:, None]).min(axis=1).tolist()):
                    table[band, value].append(name)
                    flags[value >> 48] = True
            self.classes.append((words, size, step, factors, flags, dict(table)))
        self.sizes = sorted({c[0] for c in self.classes})

    def candidates(self, codes: np.ndarray, words: int = SHINGLE) -> set[tuple[str, int, int]]:
        """(template, begin, end) of windows that share a band with a template; any end of the text closes a window.

        ``codes`` are the text's shingles of ``words`` words; only templates with such shingles are looked for.
        """
        found = set()
        for own, size, step, factors, flags, table in self.classes:
            if own != words:
                continue
            for base in range(0, len(codes), BLOCK):
                part = codes[base : base + BLOCK + size]
                values = part[None, :] * factors[:, None]
                if step > 1:
                    short = (-values.shape[1]) % step
                    cells = np.pad(values, ((0, 0), (0, short)), constant_values=np.iinfo(np.uint64).max)
                    cells = cells.reshape(len(factors), -1, step).min(axis=2)
                    reach = size // step
                else:
                    cells, reach = values, size
                least = cells
                count = max(1, cells.shape[1] - reach + 1)
                if reach > 1:
                    least = cells[:, :count].copy()
                    for k in range(1, min(reach, cells.shape[1])):
                        np.minimum(least, cells[:, k : k + count], out=least)
                for band, at in zip(*np.nonzero(flags[(least >> np.uint64(48)).astype(np.int64)])):
                    for name in table.get((int(band), int(least[band, at])), ()):
                        begin = base + int(at) * step
                        found.add((name, begin, min(begin + size, len(codes))))
        return found

    def scan(self, text: str) -> dict[str, float]:
        """Containment of each template found in a text."""
        out: dict[str, float] = {}
        for words in self.sizes:
            codes = shingles(text, words)
            for name, begin, end in self.candidates(codes, words) if len(codes) else ():
                wanted = self.shingles[name]
                share = len(np.intersect1d(wanted, codes[begin:end])) / len(wanted)
                if share >= self.least - 1e-12:
                    out[name] = max(share, out.get(name, 0.0))
        return out


def scanned(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, licenses (names, sorted), n_licenses, best containment (null without a license) of every row."""
    small_batches(spark)
    bands = spark.sparkContext.broadcast(TemplateBands(templates or TEMPLATES, least))
    schema = pa.schema([("doc_id", pa.int64()), ("licenses", pa.list_(pa.string())), ("n_licenses", pa.int64()), ("containment", pa.float64())])

    def work(batch: pa.RecordBatch) -> dict:
        found = [bands.value.scan(t) for t in batch.column(1).to_pylist()]
        return {
            "doc_id": batch.column(0), "licenses": [sorted(f) for f in found], "n_licenses": [len(f) for f in found],
            "containment": [max(f.values(), default=None) for f in found],
        }

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(by_batch(work, schema), "doc_id bigint, licenses array<string>, n_licenses bigint, containment double")
