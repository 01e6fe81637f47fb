"""Word-level pair encoding to fixed-length ids and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

# Ids of the marker tokens; words follow.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_WORD = 4
MARKERS = 3  # [CLS] query [SEP] text [SEP]


def vocabulary(queries: DataFrame, corpus: DataFrame, size: int) -> DataFrame:
    """``term, n, id`` of the ``size`` most frequent words, ties by spelling."""
    words = queries.select(F.explode(tokens(F.col("query"))).alias("term")).unionAll(
        corpus.select(F.explode(tokens(F.col("text"))).alias("term"))
    )
    top = words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    order = Window.orderBy(F.desc("n"), "term")  # over ``size`` rows at most
    return top.withColumn("id", F.row_number().over(order) + F.lit(FIRST_WORD - 1))


def encode_texts(texts: DataFrame, key: str, text_col: str, vocab: DataFrame, max_len: int) -> DataFrame:
    """``split, key, n_tokens, ids``: the ids that can survive the cut, and the full number of tokens."""
    room = max_len - MARKERS
    words = (
        texts.select("split", key, tokens(F.col(text_col)).alias("_words"))
        .select("split", key, F.size("_words").alias("n_tokens"), F.slice("_words", 1, room).alias("_words"))
        .repartition("split", key)  # of the words that can survive; the regrouping below then needs no further shuffle
        .select("split", key, "n_tokens", F.posexplode_outer("_words").alias("_at", "term"))
    )
    known = words.join(F.broadcast(vocab.select("term", "id")), "term", "left")  # at most ``size`` rows
    item = F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("id", F.lit(UNK)).alias("id")))
    return (
        known.groupBy("split", key, "n_tokens")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select("split", key, "n_tokens", F.col("_items.id").alias("ids"))
    )


def kept_lengths(n_query: Column, n_text: Column, max_len: int) -> tuple[Column, Column]:
    """Cut the longer side first; neither side falls below half the room while the other is longer."""
    room = max_len - MARKERS
    keep_query = F.least(n_query, F.greatest(F.lit(room) - n_text, F.lit((room + 1) // 2)))
    return keep_query, F.least(n_text, F.lit(room) - keep_query)


def encode_pairs(
    rows: DataFrame, queries: DataFrame, corpus: DataFrame, vocab: DataFrame, max_len: int = 256
) -> DataFrame:
    """Add ``input_ids, attention_mask`` of length ``max_len``, and token counts before and after the cut.

    Each query and document that occurs is encoded once; rows then join their encodings.
    """
    asked = queries.join(rows.select("split", "qid").distinct(), ["split", "qid"], "left_semi")
    shown = corpus.join(rows.select("split", "docno").distinct(), ["split", "docno"], "left_semi")
    q = encode_texts(asked, "qid", "query", vocab, max_len).withColumnsRenamed(
        {"n_tokens": "n_query", "ids": "_q_ids"}
    )
    t = encode_texts(shown, "docno", "text", vocab, max_len).withColumnsRenamed({"n_tokens": "n_text", "ids": "_t_ids"})
    keep_query, keep_text = kept_lengths(F.col("n_query"), F.col("n_text"), max_len)
    cut = (
        rows.join(q, ["split", "qid"])
        .join(t, ["split", "docno"])
        .withColumn("kept_query", keep_query)
        .withColumn("kept_text", keep_text)
        .withColumn("_used", F.col("kept_query") + F.col("kept_text") + MARKERS)
    )
    padding = F.lit(max_len) - F.col("_used")
    ids = F.concat(
        F.array(F.lit(CLS)),
        F.slice("_q_ids", F.lit(1), F.col("kept_query")),
        F.array(F.lit(SEP)),
        F.slice("_t_ids", F.lit(1), F.col("kept_text")),
        F.array(F.lit(SEP)),
        F.array_repeat(F.lit(PAD), padding),
    )
    mask = F.concat(F.array_repeat(F.lit(1), F.col("_used")), F.array_repeat(F.lit(0), padding))
    return cut.withColumns({"input_ids": ids, "attention_mask": mask}).drop("_q_ids", "_t_ids", "_used")


def truncation_profile(encoded: DataFrame) -> DataFrame:
    """Per label: pairs, pairs that lost tokens, and mean lengths before and after the cut."""
    lost = (F.col("n_query") + F.col("n_text")) > (F.col("kept_query") + F.col("kept_text"))
    return encoded.groupBy("split", "label").agg(
        F.count("*").alias("n_pairs"),
        F.count(F.when(lost, 1)).alias("n_truncated"),
        F.round(F.avg(F.col("n_query") + F.col("n_text")), 6).alias("avg_tokens"),
        F.round(F.avg(F.col("kept_query") + F.col("kept_text")), 6).alias("avg_kept"),
    )
