"""Alignment of two tokenizers by sparse token-byte matrices.

A text's tokens under tokenizer A are the rows of a matrix with one column per byte and a one for each byte that the token
covers; B's tokens are those of another. Both are held as CSR arrays. The product of A with B transposed, row by row after
Gustavson, has an entry for every pair of tokens that share bytes: the overlap links, with the number of bytes shared. Pairs
whose ranges end at one byte cut the text into groups. The tokens' incidence with groups makes two further matrices, whose
product holds the pairs of one group. Rows are multiplied in slices, so memory follows the tokens of a slice of the text.

Counts of linked id pairs are taken over the whole corpus: each text's pairs are counted in the text first, then by Spark.
The counts return to the texts by a join, sent to all tasks only if there are few different pairs.

Defined results: null and empty texts, and texts whose joined tokens are not the text, have no tokens; strings of special
tokens inside texts are plain text; rows are handled one by one, so repeated rows count as often as they occur; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.bpe import byte_alphabet
from rankloom.llm.common import by_batch, dropped, small_batches, staged, text_of
from rankloom.llm.library import blank_for_long, ranked, tokenizer
from rankloom.session import configure

SLICE = 1 << 16  # rows of A that are multiplied at once
FEW = 2_000_000  # id pairs that may be sent to all tasks, of about 32 bytes each


class Csr(NamedTuple):
    """A sparse matrix: row i has the columns ``columns[begins[i]:begins[i + 1]]`` with these values."""

    begins: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int


def incidence(first: np.ndarray, last: np.ndarray, width: int) -> Csr:
    """Rows of ones from column ``first`` up to, not including, ``last``."""
    size = last - first
    begins = np.concatenate(([0], np.cumsum(size)))
    columns = np.arange(begins[-1]) + np.repeat(first - begins[:-1], size)
    return Csr(begins, columns, np.ones(len(columns), np.int64), width)


def transposed(m: Csr) -> Csr:
    rows, values = np.repeat(np.arange(len(m.begins) - 1), np.diff(m.begins)), m.values
    if (m.columns[1:] < m.columns[:-1]).any():
        order = np.argsort(m.columns, kind="stable")
        rows, values = rows[order], values[order]
    begins = np.concatenate(([0], np.cumsum(np.bincount(m.columns, minlength=m.width))))
    return Csr(begins, rows, values, len(m.begins) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """Each row of ``a`` gathers the rows of ``b`` that its columns name, and adds up what falls on one column."""
    spans = b.begins[a.columns + 1] - b.begins[a.columns]
    ends = np.cumsum(spans)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) + np.repeat(b.begins[a.columns] - (ends - spans), spans)
    rows = np.repeat(np.repeat(np.arange(len(a.begins) - 1), np.diff(a.begins)), spans)
    columns = b.columns[source]
    value = np.repeat(a.values, spans) * b.values[source]
    step = np.diff(rows * b.width + columns)
    if (step < 0).any():
        order = np.argsort(rows * b.width + columns, kind="stable")
        rows, columns, value = rows[order], columns[order], value[order]
        step = np.diff(rows * b.width + columns)
    if not step.all():
        new = np.flatnonzero(np.concatenate(([True], step != 0)))
        rows, columns, value = rows[new], columns[new], np.add.reduceat(value, new)
    counts = np.bincount(rows, minlength=len(a.begins) - 1)
    return Csr(np.concatenate(([0], np.cumsum(counts))), columns, value, b.width)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A token, B token and shared bytes of every overlap link, in text order; A's rows are multiplied slice by slice."""
    parts = [[], [], []]
    for begin in range(0, len(a_ends), SLICE):
        ends = a_ends[begin : begin + SLICE]
        low, high = int(a_ends[begin - 1]) if begin else 0, int(ends[-1])
        head, tail = np.searchsorted(b_ends, low, "right"), np.searchsorted(b_ends, high, "left") + 1
        near = np.clip(b_ends[head:tail], low, high) - low  # the slice's bytes only
        a = incidence(np.concatenate(([0], ends[:-1] - low)), ends - low, high - low)
        b = incidence(np.concatenate(([0], near[:-1])), near, high - low)
        found = product(a, transposed(b))
        parts[0].append(np.repeat(np.arange(len(ends)), np.diff(found.begins)) + begin)
        parts[1].append(found.columns + head)
        parts[2].append(found.values)
    return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)


class Aligned(NamedTuple):
    """Links as token numbers: ``links_a[k]`` of A and ``links_b[k]`` of B end together, and with them group k."""

    links_a: np.ndarray
    links_b: np.ndarray
    n_overlaps: int
    n_shared: int


def group_sizes(links: np.ndarray) -> np.ndarray:
    """Tokens of each group, from the last token of each."""
    return np.diff(links, prepend=-1)


def shared_slices(links_a: np.ndarray, links_b: np.ndarray, group: int = 0, last: int | None = None):
    """A and B tokens of all pairs inside the groups, some rows at a time: the product of both token-group matrices."""
    last = len(links_a) if last is None else min(len(links_a), last)
    if last <= group:
        return
    sizes_a, sizes_b = group_sizes(links_a)[group:last], group_sizes(links_b)[group:last]
    heads = [int(links[group - 1]) + 1 if group else 0 for links in (links_a, links_b)]
    of_a, of_b = (np.repeat(np.arange(last - group), sizes) for sizes in (sizes_a, sizes_b))
    first_b = np.concatenate(([0], np.cumsum(sizes_b)))
    entries = np.cumsum(sizes_b[of_a])  # of A's rows up to this one
    begin = 0
    while begin < len(of_a):
        done = int(entries[begin - 1]) if begin else 0
        end = max(int(np.searchsorted(entries, done + SLICE, "right")), begin + 1)
        low, high = int(of_a[begin]), int(of_a[end - 1]) + 1
        columns = of_b[first_b[low] : first_b[high]] - low
        rows = of_a[begin:end] - low
        a, b = incidence(rows, rows + 1, high - low), incidence(columns, columns + 1, high - low)
        found = product(a, transposed(b))
        yield (
            np.repeat(np.arange(begin, end), np.diff(found.begins)) + heads[0],
            found.columns + int(first_b[low]) + heads[1],
        )
        begin = end


def shared_links(aligned: Aligned, group: int = 0, groups: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A and B tokens of all pairs inside the given groups."""
    parts = [*shared_slices(aligned.links_a, aligned.links_b, group, None if groups is None else group + groups)]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))


def aligned(a_ends: np.ndarray, b_ends: np.ndarray) -> Aligned:
    """Links of two token sequences over the same bytes, from where each token ends; no token is empty."""
    i, j, _ = overlaps(a_ends, b_ends)
    together = a_ends[i] == b_ends[j]
    links_a, links_b = i[together], j[together]
    n_shared = sum(len(x) for x, _ in shared_slices(links_a, links_b))
    return Aligned(links_a, links_b, len(i), n_shared)


class Side(NamedTuple):
    """A tokenizer: ids of a text, the bytes of each token, how many, and its decimal id with a comma, bar or semicolon."""

    encode: Callable[[str], Sequence[int]]
    raw: list[bytes]
    sizes: np.ndarray
    signed: list[np.ndarray]


def side(encode: Callable[[str], Sequence[int]], raw: list[bytes]) -> Side:
    signed = [np.array([f"{k}{sign}" for k in range(len(raw))], object) for sign in ",|;"]
    return Side(encode, raw, np.array([len(x) for x in raw], np.int64), signed)


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """Ids of a blank and the text; special strings are plain text."""
    whole = tokenizer(path)
    whole.encode_special_tokens = True
    fast = ranked(path)

    def encode(text: str) -> Sequence[int]:
        if blank_for_long(text):
            return whole.encode(" " + text, add_special_tokens=False).ids
        return fast.encode_ordinary(" " + text)

    value = {c: b for b, c in enumerate(byte_alphabet())}
    vocabulary = whole.get_vocab(with_added_tokens=True)
    raw = [b""] * (max(vocabulary.values()) + 1)
    for entry, k in vocabulary.items():
        raw[k] = bytes(value[c] for c in entry) if all(c in value for c in entry) else entry.encode()
    return side(encode, raw)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    whole = SentencePieceProcessor(model_file=path)

    def of_piece(k: int) -> bytes:
        piece = whole.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if whole.is_byte(k) else piece.replace("▁", " ").encode()

    return side(lambda text: whole.encode(text, num_threads=1), [of_piece(k) for k in range(whole.get_piece_size())])


def tokens_of(one: Side, text: str, data: bytes) -> np.ndarray | None:
    """Ids of the text if their bytes are ``data``."""
    ids = one.encode(text)
    return np.array(ids, np.int64) if b"".join(map(one.raw.__getitem__, ids)) == data else None


def listed(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned):
    """The groups as ``a1,a2|b1;a3|b2,b3``, some at a time: every id is written with the sign that follows it."""
    i = j = 0
    for begin in range(0, len(found.links_a), SLICE):
        ends_a, ends_b = found.links_a[begin : begin + SLICE], found.links_b[begin : begin + SLICE]
        names = np.empty(int(ends_a[-1] + 1 - i + ends_b[-1] + 1 - j), object)
        for one, ids, ends, first, other, sign in ((a, ids_a, ends_a, i, ends_b, 1), (b, ids_b, ends_b, j, ends_a, 2)):
            last = ends - first
            group = np.repeat(np.arange(len(last)), np.diff(last, prepend=-1))
            # A's tokens of a group stand behind B's of the groups before it, B's behind A's up to its own.
            before = np.concatenate(([0], other - (j if sign == 1 else i) + 1))[group if sign == 1 else group + 1]
            texts = one.signed[0][ids[first : first + len(group)]]
            texts[last] = one.signed[sign][ids[ends]]
            names[np.arange(len(group)) + before] = texts
        i, j = int(ends_a[-1]) + 1, int(ends_b[-1]) + 1
        part = "".join(names.tolist())
        yield part if begin + SLICE < len(found.links_a) else part[:-1]


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")),
        ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int32())),
    ]
)
DDL = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, n_shared bigint, "
    "groups_sha256 string, pairs array<bigint>, times array<int>"
)


def linked(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """One row per text: sizes, digest of the groups, and its linked id pairs (A id, B id in one number) with their counts."""

    def work(batch: pa.RecordBatch) -> dict:
        a, b = byte_level(byte_file), pieces(piece_file)
        out: dict[str, list] = {f.name: [] for f in SCHEMA}
        for text in batch.column(1).to_pylist():
            data = b" " + text.encode()
            ids_a = tokens_of(a, text, data) if text else None
            ids_b = tokens_of(b, text, data) if ids_a is not None else None
            if ids_b is None:
                row = [0] * 6 + ["", [], []]
            else:
                found = aligned(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]))
                digest = hashlib.sha256()
                for part in listed(a, b, ids_a, ids_b, found):
                    digest.update(part.encode())
                pairs, times = np.unique(ids_a[found.links_a] << 32 | ids_b[found.links_b], return_counts=True)
                n = len(found.links_a)
                row = [len(ids_a), len(ids_b), n, n, found.n_overlaps, found.n_shared, digest.hexdigest(), pairs, times.astype(np.int32)]
            for name, value in zip(SCHEMA.names[1:], row):
                out[name].append(value)
        out["doc_id"] = batch.column(0)
        return out

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(by_batch(work, SCHEMA), DDL)


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, links (corpus-wide), best (whether no pair of its B id has more) of all linked id pairs."""
    counts = texts.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum(F.col("p.times").cast("bigint")).alias("links")
    )
    # A B id has as many pairs as A has ids at most.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return counts.withColumn("best", F.col("links") == F.max("links").over(of_b))


def digests(spark: SparkSession, docs: DataFrame, byte_file: str, piece_file: str, few: int = FEW) -> DataFrame:
    """The alignment of every text, with ``n_best`` and ``count_sum`` over its links."""
    configure(spark)
    small_batches(spark)
    texts = staged(spark, linked(docs, byte_file, piece_file), "aligned").withColumn("row", F.monotonically_increasing_id())
    counts = staged(spark, pair_counts(texts), "pairs")
    counts = F.broadcast(counts) if counts.count() <= few else counts
    rest = [n for n in SCHEMA.names if n not in ("pairs", "times")]
    flat = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("bigint").alias("times")
    )
    sums = flat.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum")
    )
    joined = texts.select("row", *rest).join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared"]
    return joined.select(*out)
