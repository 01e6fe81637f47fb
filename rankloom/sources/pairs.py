"""Context/response pairs: from TSV files, one per split, or from a table of conversation turns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import split_of
from ..schemas import RAW_PAIRS, require_columns
from ..session import path_status
from .records import records

_TSV = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
_CELLS = {k: _TSV[k] for k in ("sep", "quote", "escape")}


def read_tsv_pairs(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Read one TSV per split into ``split, context, response``.

    A doubled quote and a line break inside quotes belong to the field; byte ranges of a file are read in parallel all the
    same. ``NA`` stays text; rows with a missing field stay until ``drop_incomplete``.
    """
    missing = [p for p in paths.values() if path_status(spark, p) is None]
    if missing:
        raise ValueError(f"input not found: {missing}")
    parts = []
    for split, path in paths.items():
        headed = spark.read.options(**_TSV).csv(path)
        require_columns(headed, RAW_PAIRS.fieldNames(), path)
        # The declared types are applied to the file's own column order.
        schema = ", ".join(f"`{c}` string" for c in headed.columns)
        cells = F.from_csv("record", schema, _CELLS).alias("cells")
        rows = records(spark, path, _TSV["sep"], _TSV["quote"]).filter(~F.col("first")).select(cells)
        parts.append(rows.select(F.lit(split).alias("split"), "cells.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_tsv_pairs(df: DataFrame, path: str) -> None:
    df.write.options(sep="\t", header="true", quote='"', escape='"', quoteAll="true").csv(path)


def drop_incomplete(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with both texts, and the number of dropped rows per split."""
    complete = F.col("context").isNotNull() & F.col("response").isNotNull()
    dropped = pairs.filter(~complete).groupBy("split").agg(F.count("*").alias("dropped"))
    return pairs.filter(complete), dropped


def ingest_tsv_pairs(spark: SparkSession, paths: Mapping[str, str], out: str) -> DataFrame:
    """Read the TSV files once and keep their complete rows as parquet by split; later reads are parallel."""
    complete, _ = drop_incomplete(read_tsv_pairs(spark, paths))
    complete.repartition("context").write.mode("overwrite").partitionBy("split").parquet(out)
    return read_ingested_pairs(spark, out)


def read_ingested_pairs(spark: SparkSession, path: str) -> DataFrame:
    if path_status(spark, path) is None:
        raise ValueError(f"input not found: {path}")
    schema = "context string, response string, split string"
    return spark.read.schema(schema).parquet(path).select("split", "context", "response")


def read_rows(spark: SparkSession, path: str, *spread_by: str) -> DataFrame:
    """Read parquet; ``spread_by`` deals the rows out anew, for inputs of a few files with one row group each."""
    df = spark.read.parquet(path)
    return df.repartition(*spread_by) if spread_by else df


def one_split(key: str) -> Column:
    """The split name ``all``, tied to a column: joins on a constant would lose their key to constant folding."""
    return F.when(F.col(key).isNotNull(), "all")


def conversation_pairs(spark: SparkSession, sf_dir: str, by_split: bool = False) -> DataFrame:
    """Every user turn with the assistant turn that follows it, as ``split, conv_id, turn, context, response``.

    An equi-join on (conversation, turn) spreads the turns of one very long conversation over all tasks.
    """
    turns = read_rows(spark, f"{sf_dir}/conversations.parquet")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("context"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    split = split_of(F.col("conv_id").cast("string")) if by_split else one_split("conv_id")
    return asked.join(answered, ["conv_id", "turn"]).select(
        split.alias("split"), "conv_id", "turn", "context", "response"
    )
