"""Negatives per query: lexical winners or reproducible random draws, and the labelled groups built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_number
from ..functions.ordering import shuffled_positions
from ..session import Workspace
from .lexical import LexicalIndex
from .relations import ground_truth
from .retrieval import SCORE_DIGITS, Bm25, TfIdf, retrieve

POSITIVE_SCORE = 0.5  # one over the number of classes


def min_max(hits: DataFrame) -> DataFrame:
    """Scale ``score`` to [0, 1] per query; a query whose scores are all equal gets 1."""
    per_query = Window.partitionBy("split", "qid")
    lo, hi = F.min("score").over(per_query), F.max("score").over(per_query)
    spread = hits.withColumns({"_lo": lo, "_hi": hi})
    scaled = F.when(
        F.col("_hi") > F.col("_lo"),
        F.round((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), SCORE_DIGITS),
    ).otherwise(1.0)
    return spread.withColumn("score", scaled).drop("_lo", "_hi")


def lexical_negatives(
    ws: Workspace,
    index: LexicalIndex,
    queries: DataFrame,
    qrels: DataFrame,
    k: int = 9,
    model: Bm25 | TfIdf = Bm25(),
    refill: bool = False,
    max_df_ratio: float | None = None,
) -> DataFrame:
    """``split, qid, docno, score, pos``: the first ``k`` hits without the relevant document, scores scaled.

    By default the relevant document is removed after the cut, so a query that retrieves it has k-1 negatives.
    ``refill`` retrieves one more and cuts after the removal.
    """
    hits = retrieve(ws, index, queries, model, k + 1 if refill else k, max_df_ratio)
    others = hits.join(ground_truth(queries, qrels), ["split", "qid"]).filter(F.col("docno") != F.col("gt"))
    by_rank = Window.partitionBy("split", "qid").orderBy("rank")
    placed = others.withColumn("pos", F.row_number().over(by_rank)).filter(F.col("pos") <= k)
    return min_max(placed).select("split", "qid", "docno", "score", "pos")


def corpus_positions(corpus: DataFrame) -> DataFrame:
    """A reproducible numbering 0..n-1 of each split's documents."""
    return shuffled_positions(
        corpus.select("split", "docno"), key=["docno"], salt=["corpus"], within=["split"], out="doc_at"
    )


def sample_without_replacement(k: int, n: Column, draw) -> Column:
    """``k`` distinct numbers below ``n`` in ``k`` steps (Floyd): ``draw(i, bound)`` gives step i's number < bound.

    Step i draws from the first n-k+i+1 numbers and takes that range's last one when the draw is already taken.
    """

    def step(taken: Column, i: Column) -> Column:
        last = n - F.lit(k) + i
        drawn = draw(i, last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, drawn), last).otherwise(drawn)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), step)


def random_negatives(
    queries: DataFrame,
    qrels: DataFrame,
    corpus: DataFrame,
    k: int = 9,
    seed: int = 0,
    random_score: float = 0.0,
    positions: DataFrame | None = None,
) -> DataFrame:
    """``split, qid, docno, score, pos``: ``k`` distinct other documents per query, drawn per query.

    The draws are positions in the corpus numbering, shifted past the relevant document, so documents are found by
    an equi-join. A split with fewer than ``k`` other documents is an error. ``positions`` is the corpus numbering
    where it is already written; it is read twice.
    """
    numbered = corpus_positions(corpus) if positions is None else positions
    sizes = corpus.groupBy("split").agg(F.count("*").alias("n_docs"))  # one row per split
    gt = ground_truth(queries, qrels).join(
        numbered.select("split", F.col("docno").alias("gt"), F.col("doc_at").alias("_gt_at")), ["split", "gt"]
    )
    others = F.col("n_docs") - 1
    sized = gt.join(F.broadcast(sizes), "split").withColumn(
        "_others",
        F.when(others >= k, others).otherwise(
            F.raise_error(F.concat(F.lit(f"fewer than {k} other documents in split "), F.col("split"))).cast("bigint")
        ),
    )
    drawn = sample_without_replacement(
        k,
        F.col("_others"),
        lambda i, bound: hash_number(seed, F.col("qid"), i.cast("string")) % bound,
    )
    picks = sized.select("split", "qid", "_gt_at", F.posexplode(drawn).alias("_i", "_at")).select(
        "split",
        "qid",
        (F.col("_i") + 1).alias("pos"),
        (F.col("_at") + (F.col("_at") >= F.col("_gt_at")).cast("bigint")).alias("doc_at"),
    )
    return picks.join(numbered, ["split", "doc_at"]).select(
        "split", "qid", "docno", F.lit(float(random_score)).alias("score"), "pos"
    )


def labelled_groups(negatives: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 9) -> DataFrame:
    """Negatives and the relevant document of every query, which comes last: ``split, qid, docno, score, label, pos``.

    The relevant document is taken from the judgements, so a query without any negative keeps it.
    """
    truth = ground_truth(queries, qrels)
    positives = truth.select(
        "split", "qid", F.col("gt").alias("docno"), F.lit(POSITIVE_SCORE).alias("score"), F.lit(k + 1).alias("pos")
    )
    # A negative is never the relevant document, so the label follows from the branch.
    return negatives.withColumn("label", F.lit(0)).unionByName(positives.withColumn("label", F.lit(1))).select(
        "split", "qid", "docno", "score", "label", "pos"
    )


def with_texts(groups: DataFrame, queries: DataFrame, corpus: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Attach both texts last, so that no earlier shuffle carries them; ``keep`` names further columns of ``groups``.

    Documents come after queries: their texts are the longer ones and are not shuffled once they stand in many groups.
    """
    return (
        groups.join(queries, ["split", "qid"], "left")
        .join(corpus, ["split", "docno"], "left")
        .select("split", "qid", "query", "docno", "text", "score", "label", "pos", *keep)
    )
