"""Some blocks of documents against one slice of queries, inside a task: the first k documents of each query, exactly.

Vectors travel in parts: the rows of a block or slice that a task had at hand, as compressed Arrow data with each word once.
Blocks are unpacked one after the other; a later one returns only what reaches the k-th score of those before.
A block's postings are lists by word; those of common words are rows of a matrix with a column per document, so that the
common words of many queries are scored by one product. The lists of a query's other words are added to its row of scores:
short lists of many queries at once, long ones each. This first pass is in single precision; documents that can be among
the first k, by a bound on its error, are scored again in double precision from their own words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLACK = 1e-5  # covers rounding of scores and the order of additions
COMMON = 8  # a word in more than one of so many documents is held as a row of all documents
GROUP = 32  # the k-th largest is looked for among the largest of so many numbers each
LONG = 256  # a list of more documents is added on its own
TOTALS = 1 << 21  # scores held at once
LOOSE = 0.01  # single precision is used as long as its error is bounded by this
SCHEMA = "q bigint, doc bigint, score double"
_FIELDS = pa.schema([("q", pa.int64()), ("doc", pa.int64()), ("score", pa.float64())])


class Slice(NamedTuple):
    """Query i asks for words ``codes[starts[i]:starts[i + 1]]``, numbered by their place in ``words``."""

    numbers: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    weights: np.ndarray
    words: pa.Array

    def some(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes and weights of some queries, and which of these a word belongs to."""
        part = slice(self.starts[first], self.starts[last])
        owner = np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1]))
        return self.codes[part], self.weights[part], owner


class Block(NamedTuple):
    """Word i is in documents ``rows[starts[i]:starts[i + 1]]``, with saturations ``sats``; document j holds words
    ``codes[firsts[j]:firsts[j + 1]]``, with saturations ``own``."""

    numbers: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    sats: np.ndarray
    firsts: np.ndarray
    codes: np.ndarray
    own: np.ndarray

    def of(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[code], self.starts[code + 1])
        return self.rows[part], self.sats[part]


def packed(keys: list[str], words: str) -> Callable:
    """For ``mapInArrow``: a row per batch and combination of ``keys``, the other columns packed as ``part``."""

    def pack(rows: pa.RecordBatch) -> bytes:
        lists = rows.column(words)
        coded = pa.ListArray.from_arrays(lists.offsets, lists.values.dictionary_encode())
        rows = rows.set_column(rows.schema.get_field_index(words), words, coded)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.Table.from_batches([batch.select(keys)]).append_column("row", pa.array(range(batch.num_rows)))
            members = numbered.group_by(keys).aggregate([("row", "list")])
            rest = batch.drop_columns(keys)
            parts = pa.array([pack(rest.take(rows.values)) for rows in members["row_list"]], pa.binary())
            found = members.select(keys).append_column("part", parts)
            yield from found.combine_chunks().to_batches()

    return run


def _unpacked(parts: pa.ChunkedArray) -> list[pa.RecordBatch]:
    return [pa.ipc.open_stream(part.as_buffer()).read_next_batch() for part in parts]


def _joined(parts: list[pa.RecordBatch], column: str) -> np.ndarray:
    """A column of all parts; of lists all elements."""
    arrays = [part.column(column) for part in parts]
    return np.concatenate([(a.flatten() if pa.types.is_list(a.type) else a).to_numpy() for a in arrays])


def _sizes(parts: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([pc.list_value_length(part.column(column)).to_numpy() for part in parts]).astype(np.int64)


def _codes(parts: list[pa.RecordBatch], column: str, words: pa.Array) -> np.ndarray:
    """The place in ``words`` of every listed word, else -1; a part's words are looked up once."""
    found = []
    for part in parts:
        listed = part.column(column).flatten()
        places = pc.fill_null(pc.index_in(listed.dictionary, value_set=words), -1).to_numpy()
        found.append(places[listed.indices.to_numpy()])
    return np.concatenate(found)


def _before(sizes: np.ndarray) -> np.ndarray:
    """Where each of some consecutive parts begins, and the end of the last."""
    return np.append(0, np.cumsum(sizes))


def _spans(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``starts[i]`` to ``starts[i + 1]`` of all ``which``, one after the other, and how many each has."""
    sizes = starts[which + 1] - starts[which]
    begins = _before(sizes)
    return np.arange(begins[-1]) + np.repeat(starts[which] - begins[:-1], sizes), sizes


def query_slice(parts: list[pa.RecordBatch]) -> Slice:
    """Queries in the order of their most frequent word, so that neighbours ask for the same common words."""
    words = pa.chunked_array([part.column("words").flatten().dictionary for part in parts]).unique()
    starts = _before(_sizes(parts, "words"))
    codes = _codes(parts, "words", words)
    frequent = np.argsort(np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable"))
    order = np.argsort(np.minimum.reduceat(frequent[codes], starts[:-1]), kind="stable")
    places, sizes = _spans(starts, order)
    return Slice(_joined(parts, "q")[order], _before(sizes), codes[places], _joined(parts, "weights")[places], words)


def document_block(docs: list[pa.RecordBatch], words: pa.Array) -> Block:
    """The documents with the words asked for; contributions of a document that is listed twice count twice."""
    listed = _joined(docs, "doc")
    _, firsts, times = np.unique(listed, return_index=True, return_counts=True)
    order = np.argsort(firsts)  # documents stay in the order they are listed in
    firsts, times = firsts[order], times[order]
    place = np.full(len(listed), -1)
    place[firsts] = np.arange(len(firsts))
    rows = np.repeat(place, _sizes(docs, "terms"))
    codes = _codes(docs, "terms", words)
    known = np.flatnonzero((codes >= 0) & (rows >= 0))
    rows, codes, tfs = rows[known], codes[known], _joined(docs, "tfs")[known]
    own = tfs / (tfs + _joined(docs, "norm")[firsts][rows]) * times[rows]
    by_word = np.argsort(codes, kind="stable")
    starts = _before(np.bincount(codes, minlength=len(words)))
    ends = _before(np.bincount(rows, minlength=len(firsts)))
    return Block(listed[firsts], starts, rows[by_word], own[by_word], ends, codes, own)


def common_words(block: Block) -> np.ndarray:
    """The words in a good part of the documents."""
    return np.flatnonzero(np.diff(block.starts) * COMMON > len(block.numbers))


def exact(block: Block, asked: tuple[np.ndarray, np.ndarray, np.ndarray], owners: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The scores of ``docs`` for the queries ``owners`` out of some, in double precision."""
    codes, weights, owner = asked
    words, local = np.unique(codes, return_inverse=True)
    column = np.zeros(len(block.starts), np.int32)  # 0 is the word nobody asks for
    column[words] = np.arange(1, len(words) + 1)
    table = np.zeros((owner[-1] + 1, len(words) + 1))
    table[owner, local + 1] = weights
    places, sizes = _spans(block.firsts, docs)
    parts = table[np.repeat(owners, sizes), column[block.codes[places]]] * block.own[places]
    return np.bincount(np.repeat(np.arange(len(docs)), sizes), weights=parts, minlength=len(docs))


def _sharing(block: Block, codes: np.ndarray, total: np.ndarray, k: int, floor: float, slack: float) -> np.ndarray:
    """Of the documents that share a word, those that can be among the first ``k``: scores below 0 may be among these."""
    shares = np.zeros(len(block.numbers), bool)
    for code in codes:
        shares[block.of(code)[0]] = True
    found = np.flatnonzero(shares)
    if len(found) >= k:
        floor = max(floor, np.partition(total[found], len(found) - k)[len(found) - k])
    return found[total[found] >= floor - slack]


def hits_of_block(asked: Slice, block: Block, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, documents and scores that can be among the first ``k``, given scores that ``k`` earlier ones reach."""
    n, n_queries = len(block.numbers), len(asked.numbers)
    counts = np.diff(asked.starts)
    sums = np.add.reduceat(np.abs(asked.weights), asked.starts[:-1])
    error = np.finfo(np.float32).eps * (counts + 3) * sums * block.own.max(initial=1.0)
    single = error.max() < LOOSE
    kind = np.float32 if single else np.float64
    slacks = SLACK + 2 * error * single
    group = GROUP if n >= 2 * k * GROUP else 1
    width = -(-n // group) * group  # what is beyond the documents keeps 0
    sizes, sats, rows = np.diff(block.starts), block.sats.astype(kind), block.rows
    common = common_words(block)
    number = np.full(len(sizes), -1)
    number[common] = np.arange(len(common))
    matrix = np.zeros((len(common), width), kind)
    for i, code in enumerate(common):
        matrix[i, block.of(code)[0]] = sats[block.starts[code] : block.starts[code + 1]]
    begins, answers = block.starts.tolist(), []
    step = max(TOTALS // width, 1)
    for first in range(0, n_queries, step):
        last = min(first + step, n_queries)
        some = asked.some(first, last)
        codes, weights, owner = some[0], some[1].astype(kind), some[2]
        is_common = number[codes] >= 0
        used, column = np.unique(number[codes[is_common]], return_inverse=True)
        dense = np.zeros((last - first, len(used)), kind)
        dense[owner[is_common], column] = weights[is_common]
        totals = dense @ matrix[used]
        short = ~is_common & (sizes[codes] <= LONG)
        places, lengths = _spans(block.starts, codes[short])
        at = np.repeat(owner[short] * width, lengths) + rows[places]
        np.add.at(totals.reshape(-1), at, np.repeat(weights[short], lengths) * sats[places])
        long = ~is_common & ~short
        for i, code, weight in zip(owner[long].tolist(), codes[long].tolist(), weights[long].tolist(), strict=True):
            part = slice(begins[code], begins[code + 1])
            np.add.at(totals[i], rows[part], sats[part] * kind(weight))
        tops = totals.reshape(last - first, group, -1).max(axis=1)
        floor, slack = floors[first:last].copy(), slacks[first:last]
        loose = (tops >= (floor - slack)[:, None]).sum(axis=1) > 4 * k  # a document each: the k-th of them is a better floor
        if tops.shape[1] >= k and loose.any():
            floor[loose] = np.maximum(floor[loose], np.partition(tops[loose], -k, axis=1)[:, -k])
        bar = floor - slack
        # Documents without a shared word have 0.
        query, column = np.nonzero((tops >= bar[:, None]) & (bar > 0)[:, None])
        near = totals.reshape(last - first, group, -1)[query, :, column] >= bar[query, None]
        which, row = np.nonzero(near)
        found = [(query[which], row * tops.shape[1] + column[which])]
        for i in np.flatnonzero(bar <= 0):
            docs = _sharing(block, codes[owner == i], totals[i], k, floors[first + i], slack[i])
            found.append((np.full(len(docs), i), docs))
        owners, docs = (np.concatenate(x) for x in zip(*found, strict=True))
        answers.append((owners + first, docs, exact(block, some, owners, docs)))
    owners, docs, scores = (np.concatenate(x) for x in zip(*answers, strict=True))
    return owners, block.numbers[docs], scores


def best(owners: np.ndarray, docs: np.ndarray, scores: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first ``k`` of each query, those that tie with the last one included; its score goes into ``floors``."""
    order = np.lexsort((-scores, owners))
    owners, docs, scores = owners[order], docs[order], scores[order]
    counts = np.bincount(owners, minlength=len(floors))
    full = counts >= k
    floors[full] = scores[_before(counts)[:-1][full] + k - 1]
    keep = scores >= floors[owners] - SLACK
    return owners[keep], docs[keep], scores[keep]


def first_k_of_cell(k: int):
    """For ``applyInArrow`` on parts of blocks of documents (doc, norm, terms, tfs) cogrouped with parts of a slice of queries
    (q, words, weights): ``SCHEMA``."""

    def run(doc_parts: pa.Table, query_parts: pa.Table) -> pa.Table:
        if not doc_parts.num_rows or not query_parts.num_rows:
            return _FIELDS.empty_table()
        asked = query_slice(_unpacked(query_parts["part"]))
        floors = np.full(len(asked.numbers), -np.inf)
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for number in pc.unique(doc_parts["block"]):
            parts = doc_parts.filter(pc.equal(doc_parts["block"], number))["part"]
            hits = hits_of_block(asked, document_block(_unpacked(parts), asked.words), k, floors)
            kept = best(*(np.concatenate(x) for x in zip(kept, hits, strict=True)), k, floors)
        owners, docs, scores = kept
        return pa.Table.from_arrays([pa.array(asked.numbers[owners]), pa.array(docs), pa.array(scores)], schema=_FIELDS)

    return run
