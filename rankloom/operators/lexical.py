"""The lexical index as tables: document term vectors, term statistics, corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import term_vectors, tokens
from ..session import Workspace

FORMAT = 4  # of the stored tables: raise it with every change of tokens, weights or layout


def corpus_tokens(corpus: DataFrame) -> DataFrame:
    """One row per token occurrence."""
    return corpus.select("split", "docno", F.explode(tokens(F.col("text"))).alias("term"))


def postings(vectors: DataFrame) -> DataFrame:
    """``split, docno, term, tf`` from document term vectors."""
    return vectors.select("split", "docno", F.explode(F.arrays_zip("terms", "tfs")).alias("_p")).select(
        "split", "docno", F.col("_p.terms").alias("term"), F.col("_p.tfs").cast("bigint").alias("tf")
    )


def document_lengths(vectors: DataFrame) -> DataFrame:
    return vectors.select("split", "docno", F.col("length").alias("dl"))


def term_statistics(vectors: DataFrame) -> DataFrame:
    """Document and collection frequency of each term; both sums are combined before the shuffle."""
    return postings(vectors).groupBy("split", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_statistics(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("split").agg(
        F.count("*").alias("n_docs"),
        F.sum("length").alias("n_tokens"),
        (F.sum("length").cast("double") / F.count("*")).alias("avgdl"),
    )


def corpus_vectors(corpus: DataFrame) -> DataFrame:
    return term_vectors(corpus, "text", ["split", "docno"])


def length_norm(length: Column, avgdl: Column, k1: float, b: float) -> Column:
    return F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / avgdl)


def saturation(tf: Column, length: Column, avgdl: Column, k1: float, b: float) -> Column:
    """tf / (tf + K), the part of a term's weight that depends on the document; in (0, 1)."""
    return tf / (tf + length_norm(length, avgdl, k1, b))


@dataclass(frozen=True)
class LexicalIndex:
    """Index tables for one corpus.

    documents  split, docno, doc, bag, copy_no, length, avgdl, terms, tfs. Documents with one bag of words are copies of
               each other for any scoring; copy 1 stands for all of them, copies up to ``depth`` are numbered, the
               rest have no number and can never be among the first ``depth`` hits.
    copies     split, rep, docno, copy_no for the numbered copies of bags that have more than one.
    terms      split, term, df, n_docs
    corpus     split, n_docs, n_tokens, avgdl: one row per split

    ``doc`` numbers the documents of all splits; retrieval returns these numbers, names come back with the hits.
    """

    documents: DataFrame
    copies: DataFrame
    terms: DataFrame
    corpus: DataFrame
    depth: int
    k1: float
    b: float

    def representatives(self) -> DataFrame:
        return self.documents.filter("copy_no = 1")


def build_index(
    ws: Workspace,
    corpus: DataFrame,
    source: object,
    depth: int = 10,
    k1: float = 1.2,
    b: float = 0.75,
) -> LexicalIndex:
    """Build the index tables, or load those built from the same ``source`` under the same parameters.

    ``source`` describes the corpus (paths, sizes, times) and is part of every table's fingerprint.
    """
    mark = {"source": source, "depth": depth, "k1": k1, "b": b, "format": FORMAT}

    # Texts are read once and never shuffled: what moves is docno, digest and, of copies only, a number.
    bare = ws.build_or_load("index-bare", mark, lambda: corpus_vectors(corpus).withColumn("doc", F.monotonically_increasing_id()))

    def number_copies() -> DataFrame:
        several = (
            bare.groupBy("split", "bag").agg(F.count("*").alias("_n"), F.min("docno").alias("rep"))
            .filter("_n > 1").select("split", "bag", "rep")
        )
        by_bag = Window.partitionBy("split", "bag", "rep").orderBy("docno")
        return (
            bare.select("split", "docno", "bag")
            .join(several, ["bag", "split"])
            .withColumn("copy_no", F.row_number().over(by_bag))  # at most ``depth`` rows per bag and task are shuffled
            .filter(F.col("copy_no") <= depth)
            .select("split", "rep", "docno", "copy_no")
        )

    numbered = ws.build_or_load("index-copies", mark, number_copies)

    def number_documents() -> DataFrame:
        reps = numbered.select("split", "rep").distinct()
        names = bare.select("split", "docno", "doc", "bag")
        bags = names.join(reps.withColumnRenamed("rep", "docno"), ["docno", "split"], "left_semi").select(
            "split", "bag", F.lit(True).alias("_several")
        )
        # A bag without copies is its own first and not listed; of the others only the numbered documents have a number.
        marked = names.join(bags, ["bag", "split"], "left").join(
            numbered.select("split", "docno", F.col("copy_no").alias("_no")), ["docno", "split"], "left"
        )
        number = F.when(F.col("_several"), F.col("_no")).otherwise(1).cast("int")
        return marked.filter("_several OR _no IS NOT NULL").select("doc", F.lit(True).alias("_listed"), number.alias("_no"))

    # The vectors are written once: what else is known of a document is joined by its number.
    numbers = ws.build_or_load("index-numbers", mark, number_documents)
    vectors = bare.join(numbers, "doc", "left").withColumn(
        "copy_no", F.when(F.col("_listed"), F.col("_no")).otherwise(1)
    ).select("split", "docno", "doc", "copy_no", "length", "bag", "terms", "tfs")
    stats = ws.build_or_load("index-corpus", mark, lambda: corpus_statistics(vectors))
    # One row per split; splits are a handful by construction (train, valid, test).
    documents = vectors.join(F.broadcast(stats.select("split", "avgdl")), "split")

    def describe_terms() -> DataFrame:
        flat = documents.select("split", F.explode("terms").alias("term"))
        frequencies = flat.groupBy("split", "term").agg(F.count("*").alias("df"))
        return frequencies.join(F.broadcast(stats.select("split", "n_docs")), "split")

    terms = ws.build_or_load("index-terms", mark, describe_terms)
    return LexicalIndex(documents, numbered, terms, stats, depth, k1, b)
