"""Top-k retrieval over the index tables: exact, in bounded memory, without writing the pairs that share a word.

1.  Queries with one bag of words are answered once, documents with one bag are scored once.
2.  Documents are dealt into blocks of ``BLOCK`` words at most, queries into slices. A task scores one slice against some blocks,
    one after the other (``blocks``), and returns the first k documents of each query: what is shuffled are packed vectors
    and short lists, never a row per pair or per shared word. Documents go to every slice and queries to every group of
    blocks, so both are balanced.
3.  The first k of the groups' lists are the hits; they get their names back at the end.

The work is still that of all queries against all documents, so time grows with the product of both.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shared_words, term_vectors
from ..session import Workspace
from .blocks import SCHEMA, first_k_of_cell, packed
from .lexical import LexicalIndex, length_norm, saturation

SCORE_DIGITS = 6
BLOCK = 1 << 22  # words of the documents in a block, and of the queries in a slice: a task holds one of each
SLICE = 1 << 12  # a slice of fewer query words is not worth a task of its own
TOGETHER = 16  # blocks of a group at most: a task holds them packed
SPREAD = 8  # partitions per cell, so that hardly two cells share one
ASKED = 3  # what a query's word costs a block, weight and hits included, beside what a document's word costs a slice


@dataclass(frozen=True)
class Bm25:
    """log2((N-df+.5)/(df+.5)) * (k1+1)tf/(K+tf) * (k3+1)qtf/(k3+qtf); ``plus1`` uses ln(1+...), never negative."""

    k1: float = 1.2
    b: float = 0.75
    k3: float = 8.0
    idf: str = "classic"

    def weight(self, df: Column, n_docs: Column, qtf: Column) -> Column:
        odds = (n_docs - df + 0.5) / (df + 0.5)
        idf = F.log2(odds) if self.idf == "classic" else F.log1p(odds)
        return idf * (F.lit(self.k3 + 1.0) * qtf / (F.lit(self.k3) + qtf)) * F.lit(self.k1 + 1.0)


@dataclass(frozen=True)
class TfIdf:
    """log2(N/df + 1) * k1*tf/(tf+K) * qtf."""

    k1: float = 1.2
    b: float = 0.75

    def weight(self, df: Column, n_docs: Column, qtf: Column) -> Column:
        return F.log2(n_docs / df + 1.0) * qtf * F.lit(self.k1)


def query_vectors(queries: DataFrame) -> DataFrame:
    """``q`` numbers the rows: write the vectors before they are read twice."""
    return term_vectors(queries, "query", ["qid", "split"]).withColumn("q", F.monotonically_increasing_id())


def query_numbers(vectors: DataFrame) -> DataFrame:
    """``split, bag, q``: queries with one bag of words are asked once, under the least of their numbers."""
    return vectors.groupBy("split", "bag").agg(F.min("q").alias("q"))


def asked_terms(index: LexicalIndex, vectors: DataFrame) -> DataFrame:
    """``split, bag, q, term, qtf, df, n_docs`` of every distinct query bag, of words the index knows."""
    flat = (
        vectors.join(query_numbers(vectors).select("q"), "q", "left_semi")
        .select("split", "bag", "q", F.explode(F.arrays_zip("terms", "tfs")).alias("_p"))
        .select("split", "bag", "q", F.col("_p.terms").alias("term"), F.col("_p.tfs").alias("qtf"))
    )
    return flat.join(index.terms, ["term", "split"])


def weighted(model: Bm25 | TfIdf, df: Column, n_docs: Column, qtf: Column) -> Column:
    return model.weight(df.cast("double"), n_docs.cast("double"), qtf.cast("double"))


def _agree(index: LexicalIndex, model: Bm25 | TfIdf) -> None:
    if (model.k1, model.b) != (index.k1, index.b):
        raise ValueError("model and index disagree on k1 or b")


def query_terms(
    index: LexicalIndex, vectors: DataFrame, model: Bm25 | TfIdf, max_df_ratio: float | None = None
) -> DataFrame:
    """``split, bag, q, term, w`` of every distinct query bag; ``w * sat`` is a posting's contribution.

    ``max_df_ratio`` drops words found in more than that share of the documents, in place of a stop-word list. It
    changes scores, so it is off unless asked for.
    """
    _agree(index, model)
    known = asked_terms(index, vectors)
    if max_df_ratio is not None:
        known = known.filter(F.col("df") <= F.lit(max_df_ratio) * F.col("n_docs"))
    weight = weighted(model, F.col("df"), F.col("n_docs"), F.col("qtf"))
    return known.select("split", "bag", "q", "term", weight.alias("w"))


def top_k(scored: DataFrame, group: list[str], k: int, tie: str = "docno") -> DataFrame:
    """First ``k`` rows per group by score, then ``tie``; adds ``rank`` from 1. Tasks keep ``k`` before shuffling."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _cells(index: LexicalIndex, terms: DataFrame) -> tuple[int, int, int]:
    """The number of document blocks, of query slices and of groups of blocks; a task has a slice and a group."""
    words = index.corpus.agg(F.sum("n_tokens")).first()[0] or 0  # one row per split
    asked, cores = terms.count(), terms.sparkSession.sparkContext.defaultParallelism
    blocks, slices = dealing(words, asked, cores)
    groups, each = grouping(blocks, slices, min(3 * cores, asked // SLICE))
    return groups * each, slices, groups


def grouping(blocks: int, slices: int, wanted: int) -> tuple[int, int]:
    """Groups of equally many blocks, and how many: as few groups as give the wanted cells, as each has a copy of the queries
    and lists k documents for each of them."""
    each = min(max(blocks * slices // max(wanted, 1), 1), TOGETHER, blocks)
    return -(-blocks // each), each


def dealing(words: int, asked: int, cores: int) -> tuple[int, int]:
    """Blocks and slices of at most ``BLOCK`` words that keep all cores busy and shuffle little."""
    blocks, slices = max(-(-words // BLOCK), 1), max(-(-asked // BLOCK), 1)
    wanted = min(3 * cores, asked // SLICE)
    if blocks * slices >= wanted:
        return blocks, slices
    # As many cells, dealt so that copies of documents and of queries cost the same.
    balanced = round(sqrt(wanted * words / (ASKED * asked)))
    blocks = max(blocks, min(balanced, wanted // slices))
    return blocks, max(slices, ceil(wanted / blocks))


def _contents(index: LexicalIndex, terms: DataFrame, k: int) -> DataFrame:
    """``q, doc, score`` of all documents that can be among the first ``k``."""
    blocks, slices, groups = _cells(index, terms)
    documents = index.representatives().filter("terms IS NOT NULL").select(
        "split",
        _dealt("doc", blocks).alias("block"),
        "doc",
        length_norm(F.col("length"), F.col("avgdl"), index.k1, index.b).alias("norm"),
        "terms",
        "tfs",
    )
    queries = (
        terms.groupBy("split", "q")
        .agg(F.collect_list("term").alias("words"), F.collect_list("w").alias("weights"))
        .select("split", _dealt("q", slices).alias("slice"), "q", "words", "weights")
    )
    doc_parts = documents.mapInArrow(packed(["split", "block"], "terms"), "split string, block int, part binary").select(
        "split", (F.col("block") % groups).alias("group"), _copied("slice", slices), "block", "part"
    )
    query_parts = queries.mapInArrow(packed(["split", "slice"], "words"), "split string, slice int, part binary").select(
        "split", _copied("group", groups), "slice", "part"
    )
    cell = ["split", "group", "slice"]
    spread = SPREAD * groups * slices
    found = (
        doc_parts.repartition(spread, *cell).groupBy(*cell)
        .cogroup(query_parts.repartition(spread, *cell).groupBy(*cell))
        .applyInArrow(first_k_of_cell(k), SCHEMA)
    )
    return found.withColumn("score", F.round("score", SCORE_DIGITS))


def _copied(name: str, times: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(name)


def _dealt(number: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(parts)).cast("int")


def hits_by_bag(ws: Workspace, index: LexicalIndex, terms: DataFrame, k: int) -> DataFrame:
    """``split, q, docno, score, rank`` of the first ``k`` documents per query number."""
    if k > index.depth:
        raise ValueError(f"the index numbers copies up to {index.depth}; build it with depth >= {k}")
    scored = _contents(index, terms, k)
    # Documents that tie with the k-th stay until their names decide.
    best = Window.partitionBy("q").orderBy(F.col("score").desc())
    contents = scored.withColumn("_rank", F.rank().over(best)).filter(F.col("_rank") <= k).drop("_rank")
    named = contents.join(index.representatives().select("doc", "split", F.col("docno").alias("rep")), "doc").drop("doc")
    # k bags suffice: each holds at least one document that precedes those of later bags. Bags of one have no copies.
    documents = named.join(index.copies.select("split", "rep", "docno"), ["rep", "split"], "left").withColumn(
        "docno", F.coalesce("docno", "rep")
    )
    return top_k(documents.drop("rep"), ["q"], k)


def retrieve(
    ws: Workspace,
    index: LexicalIndex,
    queries: DataFrame,
    model: Bm25 | TfIdf = Bm25(),
    k: int = 9,
    max_df_ratio: float | None = None,
) -> DataFrame:
    """``split, qid, docno, rank, score`` of the first ``k`` documents per query; ties go to the smaller docno."""
    vectors = ws.stage(query_vectors(queries), "query-vectors")
    terms = ws.stage(query_terms(index, vectors, model, max_df_ratio), "query-terms")
    answered = hits_by_bag(ws, index, terms, k)
    # One row per bag on this side, so that many equal queries do not multiply the other one before the join.
    lists = answered.groupBy("q").agg(F.collect_list(F.struct("docno", "rank", "score")).alias("_hits"))
    return (
        vectors.select("split", "qid", "bag")
        .join(query_numbers(vectors), ["bag", "split"])
        .join(lists, "q")
        .select("split", "qid", F.inline("_hits"))
    )


def score_pairs(
    ws: Workspace,
    index: LexicalIndex,
    queries: DataFrame,
    pairs: DataFrame,
    model: Bm25 | TfIdf = Bm25(),
) -> DataFrame:
    """Add ``score`` and ``overlap`` to given (split, qid, docno) rows; 0 where no word is shared."""
    return score_pairs_by(ws, index, queries, pairs, {"score": model})


def score_pairs_by(
    ws: Workspace, index: LexicalIndex, queries: DataFrame, pairs: DataFrame, models: dict[str, Bm25 | TfIdf]
) -> DataFrame:
    """Add a score for each of ``models``, under its name, and ``overlap``: documents are unpacked and joined once for all."""
    for model in models.values():
        _agree(index, model)
    vectors = ws.stage(query_vectors(queries), "query-vectors")
    # Counts travel, not weights: they are the same for all models, and small numbers.
    listed = [F.collect_list(c).alias(f"_{c}") for c in ("term", "qtf", "df")]
    packed = asked_terms(index, vectors).groupBy("bag", "split").agg(*listed, F.max("n_docs").alias("_n_docs"))
    of_query = vectors.select("split", "qid", "bag").join(packed, ["bag", "split"]).drop("bag")
    # A pair carries its query's words to the document, which may be any copy; only scores leave that join.
    both = pairs.select("qid", "docno", "split").join(of_query, ["qid", "split"]).join(
        index.documents.select("docno", "split", "length", "avgdl", "terms", "tfs"), ["docno", "split"]
    )
    shared = both.select(
        "qid", "docno", "split", "length", "avgdl", "tfs", "_qtf", "_df", "_n_docs", F.inline(shared_words("_term", "terms"))
    )
    sat = saturation(F.get("tfs", F.col("at") - 1), F.col("length"), F.col("avgdl"), index.k1, index.b)

    def given(model: Bm25 | TfIdf) -> Column:
        return weighted(model, F.get("_df", F.col("i")), F.col("_n_docs"), F.get("_qtf", F.col("i"))) * sat

    # A row per shared word lives inside the task only: tasks add them up before the shuffle.
    sums = [F.round(F.sum(given(m)), SCORE_DIGITS).alias(n) for n, m in models.items()]
    scored = shared.groupBy("qid", "docno", "split").agg(*sums, F.count("*").alias("overlap"))
    return pairs.join(scored, ["qid", "docno", "split"], "left").fillna({**dict.fromkeys(models, 0.0), "overlap": 0})
