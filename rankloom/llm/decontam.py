"""Benchmark decontamination on a positional inverted index, with DataFrame operations only.

An item's windows are its runs of ``size`` consecutive words; an item of fewer words is one window. The training texts are
read twice. The first pass counts, over all texts, the postings of every benchmark term. The second stores the postings
of each window's rarest term: term, document, position, and the words around, so that the lists of the window's other
terms, shifted by their offsets, are intersected where the posting lies, the second rarest first, without moving the
postings of frequent words. A window with a term that no text has is dropped before that pass. What is left are exact
phrase matches and, with ``slop``, proximity matches: all terms of a window within so many words more.

The benchmark's tables are written once, so Spark joins them by their measured size: broadcast while they are small, by a
shuffle that adaptive execution splits at hot terms otherwise. A document's postings are never gathered in one row.

Defined results: null and empty texts have no words and no hits, null items no windows; equal rows each get the same
result; rows that share a document id but not the text are judged apart; a null document id is kept; an empty benchmark
leaves every document clean; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import staged, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are runs of a-z, 0-9 and everything beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EDGE = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)  # lower() is the same there, and faster
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    core = F.btrim(low, F.lit(EDGE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, GAP))


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item_id, phrase (words with blanks between), terms, of every window."""
    words = items.select("item_id", words_of(text_of()).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    return words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at")).select(
        "item_id", F.slice("words", F.col("at") + 1, F.lit(size)).alias("terms")
    ).select("item_id", F.array_join("terms", " ").alias("phrase"), "terms").distinct()


def text_key(docs: DataFrame) -> DataFrame:
    """doc_id, mark of the text, words: equal rows share the key."""
    return docs.select(
        F.col("doc_id"), F.xxhash64(text_of()).alias("mark"), words_of(text_of()).alias("words")
    )


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: postings over all documents of the terms asked for."""
    return (
        docs.select(F.explode(words_of(text_of())).alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each phrase with its rarest term and that term's offset, and the second rarest and its offset."""
    placed = windows.select("phrase", "terms").distinct().select("phrase", "terms", F.posexplode("terms").alias("offset", "term"))
    known = placed.join(counts, "term", "left").select(
        "phrase", "terms", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term").alias("t")
    )
    ranked = known.groupBy("phrase", "terms").agg(F.sort_array(F.collect_list("t")).alias("t"))  # at most ``size`` each
    return ranked.where(F.col("t")[0]["n"] > 0).select(
        F.col("t")[0]["term"].alias("term"),
        F.col("t")[0]["offset"].alias("offset"),
        F.get("t", F.lit(1))["term"].alias("next_term"),
        F.get("t", F.lit(1))["offset"].alias("next_offset"),
        "phrase",
        "terms",
    )


def postings(docs: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """term, doc_id, mark, pos, begin, near: every posting of ``terms`` with the words up to ``around`` places away."""
    return (
        text_key(docs)
        .select("doc_id", "mark", "words", F.posexplode("words").alias("pos", "term"))
        .join(terms, "term", "left_semi")
        .select(
            "term",
            "doc_id",
            "mark",
            "pos",
            F.greatest(F.col("pos") - around, F.lit(0)).alias("begin"),
            F.slice("words", F.greatest(F.col("pos") - around, F.lit(0)) + 1, F.lit(2 * around + 1)).alias("near"),
        )
    )


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Windows (item_id, phrase), and matches (doc_id, mark, phrase, start, length, exact)."""
    windows = staged(spark, windows_of(items, size), "windows")
    vocabulary = staged(spark, windows.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = staged(spark, term_counts(docs, vocabulary), "counts")
    anchors = staged(spark, anchored(windows, counts), "anchors")
    rarest = staged(spark, anchors.select("term").distinct(), "rarest")
    index = staged(spark, postings(docs, rarest, size + slop - 1), "postings")
    start = F.col("pos") - F.col("offset")
    local = start - F.col("begin")
    placed = index.join(anchors, "term").select("*", start.alias("start"), local.alias("local"))
    second = F.col("next_term").isNull() | (F.get("near", F.col("local") + F.col("next_offset")) == F.col("next_term"))
    phrase = (F.col("start") >= 0) & second & (
        F.slice("near", F.greatest(F.col("local"), F.lit(0)) + 1, F.size("terms")) == F.col("terms")
    )
    close = F.size(F.array_except("terms", "near")) == 0 if slop else F.lit(False)
    found = placed.where(phrase | close).select(
        "doc_id", "mark", "phrase", "start", F.size("terms").alias("length"), phrase.alias("exact")
    )
    return windows, staged(spark, found.distinct(), "matches")


def judged(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    windows, found = matches(spark, docs, items, size)
    found = found.where("exact")
    before = Window.partitionBy("doc_id", "mark").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("doc_id", "mark", "start").agg(F.max("length").alias("length"))
    end = F.col("start") + F.col("length")
    fresh = end - F.greatest(F.col("start"), F.least(end, F.coalesce(F.max(end).over(before), F.lit(0))))
    hits = spans.select("doc_id", "mark", fresh.alias("fresh")).groupBy("doc_id", "mark").agg(F.sum("fresh").alias("n_hit"))
    named = (
        found.select("doc_id", "mark", "phrase").distinct()
        .join(windows.select("item_id", "phrase"), "phrase")
        .select("doc_id", "mark", F.col("item_id").cast("string").alias("item"))
        .groupBy("doc_id", "mark")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    size_of = text_key(docs).select("doc_id", "mark", F.size("words").cast("bigint").alias("n_words"))
    d, h, m = size_of.alias("d"), hits.alias("h"), named.alias("m")
    same = lambda other: F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("d.mark") == F.col(f"{other}.mark"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    return d.join(h, same("h"), "left").join(m, same("m"), "left").select(
        F.col("d.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns kept."""
    _, found = matches(spark, docs, items, size)
    bad = found.where("exact").select(F.col("doc_id").alias("bad_doc"), F.col("mark").alias("bad_mark")).distinct()
    columns = [docs[c] for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), docs["doc_id"].alias("own_doc"), F.xxhash64(text_of()).alias("own_mark"))
    clean = rows.join(bad, F.col("own_doc").eqNullSafe(F.col("bad_doc")) & (F.col("own_mark") == F.col("bad_mark")), "left_anti")
    return clean.select("row.*")
