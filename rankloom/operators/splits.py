"""Splitting labelled rows so that a query's rows stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_share
from ..functions.ordering import shuffled_positions


def split_by_query(rows: DataFrame, train_ratio: float = 0.9, seed: int = 0) -> DataFrame:
    """Add ``side``: exactly ``floor(n * train_ratio)`` of a split's n queries are train, the others test."""
    qids = rows.select("split", "qid").distinct()
    sizes = qids.groupBy("split").agg(F.count("*").alias("_n"))  # one row per split
    placed = shuffled_positions(qids, key=["qid"], salt=[seed], within=["split"], out="_at").join(
        F.broadcast(sizes), "split"
    )
    side = F.when(F.col("_at") < F.floor(F.col("_n") * F.lit(train_ratio)), "train").otherwise("test")
    return rows.join(placed.select("split", "qid", side.alias("side")), ["split", "qid"])


def split_by_query_hash(rows: DataFrame, train_ratio: float = 0.9, seed: int = 0) -> DataFrame:
    """Add ``side`` without any shuffle; the share of train queries is ``train_ratio`` only on average."""
    train = hash_share(seed, F.col("qid")) < F.lit(train_ratio)
    return rows.withColumn("side", F.when(train, "train").otherwise("test"))


def split_summary(sided: DataFrame) -> DataFrame:
    return sided.groupBy("split", "side").agg(
        F.count("*").alias("n_rows"), F.countDistinct("qid").alias("n_queries")
    )
