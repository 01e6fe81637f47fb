"""Pairs to queries, corpus and judgements, and checks on the judgements."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..schemas import require_columns


class Relations(NamedTuple):
    queries: DataFrame  # split, qid, query
    corpus: DataFrame  # split, docno, text
    qrels: DataFrame  # split, qid, docno, label


def with_ids(pairs: DataFrame, row_id: Column) -> DataFrame:
    """One row per pair: ``split, qid, query, docno, text, label``; ``row_id`` is unique inside a split."""
    require_columns(pairs, ["split", "context", "response"], "pairs")
    key = row_id.cast("string")
    return pairs.withColumnsRenamed({"context": "query", "response": "text"}).select(
        "split",
        F.concat(F.lit("q"), key).alias("qid"),
        "query",
        F.concat(F.lit("d"), key).alias("docno"),
        "text",
        F.lit(1).alias("label"),
    )


def relations(identified: DataFrame) -> Relations:
    return Relations(
        identified.select("split", "qid", "query"),
        identified.select("split", "docno", "text"),
        identified.select("split", "qid", "docno", "label"),
    )


def clean_queries(queries: DataFrame) -> DataFrame:
    return queries.select("split", "qid", clean(F.col("query")).alias("query"))


def ground_truth(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """The relevant document of each query, as ``split, qid, gt``; fails for a query without exactly one."""
    relevant = qrels.filter("label = 1").groupBy("split", "qid").agg(
        F.count("*").alias("_n"), F.min("docno").alias("_gt")
    )
    found = F.coalesce("_n", F.lit(0))
    wrong = F.format_string("query %s of split %s has %d relevant documents, not one", "qid", "split", found)
    return queries.select("split", "qid").join(relevant, ["split", "qid"], "left").select(
        "split", "qid", F.when(found == 1, F.col("_gt")).otherwise(F.raise_error(wrong).cast("string")).alias("gt")
    )


def qrels_violations(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that do not have exactly one relevant document, with the number they have."""
    counts = qrels.filter("label = 1").groupBy("split", "qid").agg(F.count("*").alias("n_relevant"))
    return (
        queries.select("split", "qid")
        .join(counts, ["split", "qid"], "left")
        .select("split", "qid", F.coalesce("n_relevant", F.lit(0)).cast("bigint").alias("n_relevant"))
        .filter("n_relevant <> 1")
    )
