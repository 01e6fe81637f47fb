"""R_10@1 per query and per block of rows, and the audit that explains their difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import sequential_ids
from ..session import Workspace


def _share_of_hits(best: DataFrame, group: Sequence[str]) -> DataFrame:
    hit = F.when(F.col("_label") == 1, 1).otherwise(0)
    return best.groupBy(*group).agg(
        F.count("*").alias("n_queries"),
        F.sum(hit).alias("n_correct"),
        F.round(F.sum(hit) / F.count("*"), 6).alias("r10_at_1"),
    )


def _best(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The label of the highest logit, ties to the first position; NaN counts as highest."""
    return rows.groupBy(*keys).agg(F.max_by("label", F.struct("logit", -F.col("pos"))).alias("_label"))


def r10_at_1(rows: DataFrame, group: Sequence[str] = ("split",)) -> DataFrame:
    """Share of queries whose highest-scored candidate is relevant; needs ``qid, pos, label, logit``."""
    return _share_of_hits(_best(rows, [*group, "qid"]), group)


def r10_batched(ws: Workspace, rows: DataFrame, block: int = 10, order: Sequence[str] = ("qid",)) -> DataFrame:
    """The same over blocks of ``block`` consecutive rows, whatever query they belong to.

    ``order`` names the columns that put the queries in the order of their rows.
    """
    ordered = sequential_ids(ws, rows, ["split", *order, "pos"], "row_no")
    firsts = ordered.groupBy("split").agg(F.min("row_no").alias("_first"))  # one row per split
    blocks = ordered.join(F.broadcast(firsts), "split").withColumn(
        "_block", F.floor((F.col("row_no") - F.col("_first")) / block)
    )
    return _share_of_hits(_best(blocks.withColumn("pos", F.col("row_no")), ["split", "_block"]), ["split"])


def group_sizes(rows: DataFrame) -> DataFrame:
    """How many queries have how many rows and relevant rows."""
    sizes = rows.groupBy("split", "qid").agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_relevant"))
    return sizes.groupBy("split", "n_rows", "n_relevant").agg(F.count("*").alias("n_queries"))
