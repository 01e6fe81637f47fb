"""Row numbers over whole tables, without ever sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace
from .hashing import digest

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id keeps the row's ordinal in its low 33 bits


def sequential_ids(ws: Workspace, df: DataFrame, keys: Sequence[str], out: str = "row_no") -> DataFrame:
    """Number rows 1..N in the order of ``keys``, which must identify a row.

    Range partitions are sorted on their own; the counts of earlier partitions give each its first number. The
    sorted rows are written once, since a recomputed range partitioning might draw other bounds.
    """
    ordered = (
        df.repartitionByRange(*keys)  # adaptive execution may merge neighbouring ranges, which keeps their order
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    staged = ws.stage(ordered, "ordered")
    part = F.shiftright("_slot", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (  # one row per partition
        staged.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    )
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(firsts), "_part")
        .withColumn(out, F.col("_first") + F.col("_slot").bitwiseAND(F.lit(_IN_PARTITION)) + 1)
        .drop("_part", "_first", "_slot")
    )


def shuffled_positions(
    df: DataFrame,
    key: Sequence[str],
    salt: Sequence[Column | str | int],
    within: Sequence[str],
    out: str = "position",
    below: int | Column | None = None,
    prefix: int = 4,
) -> DataFrame:
    """Number rows 0..n-1 inside each ``within`` group in the order of md5(salt, key): a reproducible shuffle.

    A digest's first hex digits cut a group into evenly filled slices, so the position is the count of earlier
    slices plus the rank inside the slice. ``below`` drops whole slices that start at or after that position.
    """
    # What is sorted and shuffled are bytes of the digest, in the same order as its digits.
    hexed = df.withColumn("_hex", digest(*salt, *[F.col(k) for k in key]))
    marked = hexed.withColumns(
        {
            "_slice": F.conv(F.substring("_hex", 1, prefix), 16, 10).cast("bigint"),
            "_digest": F.unhex(F.substring("_hex", prefix + 1, 32 - prefix)),
        }
    ).drop("_hex")
    before = Window.partitionBy(*within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (  # at most 16**prefix rows per group
        marked.groupBy(*within, "_slice")
        .agg(F.count("*").alias("_rows"))
        .select(*within, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    )
    placed = marked.join(firsts, [*within, "_slice"])
    if below is not None:
        placed = placed.filter(F.col("_first") < below)
    inside = Window.partitionBy(*within, "_slice").orderBy("_digest", *key)
    numbered = placed.withColumn(out, F.col("_first") + F.row_number().over(inside) - 1)
    if below is not None:
        numbered = numbered.filter(F.col(out) < below)
    return numbered.drop("_digest", "_slice", "_first")
