"""Training tables, loss histories and the results ledger on storage."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import HISTORY_CONFIG, LEDGER, TRAINING_COLUMNS, require_columns
from ..session import committed, path_status, publish, published


def _written(rows: DataFrame, path: str, *folders: str) -> None:
    """Texts occur once per group they stand in: equal ones side by side and a codec that sees them take far less room."""
    ordered = rows.sortWithinPartitions(*folders, "docno", "qid")
    ordered.write.mode("overwrite").option("compression", "zstd").partitionBy(*folders).parquet(path)


def write_training_table(rows: DataFrame, path: str) -> None:
    """One folder per split and method; readers that filter on either never open the others."""
    require_columns(rows, [*TRAINING_COLUMNS, "method"], "training table")
    _written(rows, path, "split", "method")


def read_training_table(spark: SparkSession, path: str) -> DataFrame:
    if path_status(spark, path) is None:
        raise ValueError(f"input not found: {path}")
    return require_columns(spark.read.parquet(path), [*TRAINING_COLUMNS, "method"], path)


def replace_training_parts(rows: DataFrame, path: str) -> None:
    """Write the (split, method) folders that occur in ``rows`` anew and leave all others as they are."""
    require_columns(rows, [*TRAINING_COLUMNS, "method"], "training table")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "method").parquet(path)


def write_sides(sided: DataFrame, path: str, sides: Sequence[str] = ("train", "test")) -> dict[str, str]:
    """One training table per side of a split by query, all written in one pass below ``path``; returns their paths."""
    require_columns(sided, [*TRAINING_COLUMNS, "method", "side"], "training table")
    _written(sided.filter(F.col("side").isin(*sides)), path, "side", "split", "method")
    return {side: f"{path}/side={side}" for side in sides}


def append_results(results: DataFrame, path: str, run: str | None = None) -> None:
    """Add a run to the ledger; earlier results stay, and a run key that is already there is not added again.

    Readers see a run as a whole or not at all. Without a key every call is a run of its own.
    """
    require_columns(results, LEDGER.fieldNames(), "results")
    rows = results.select(*LEDGER.fieldNames())
    _add_run(rows.sparkSession, path, run, lambda out: rows.write.option("header", True).csv(out))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return _read_runs(spark, path, LEDGER)


def write_history(history: DataFrame, path: str, run: str | None = None) -> None:
    """The loss history of a run as CSV, split and full configuration in the folder names; commits as the ledger does."""
    config = HISTORY_CONFIG.fieldNames()
    require_columns(history, ["instances_vues", "loss", "epsilon", *config], "history")
    rows = history.select("instances_vues", "loss", "epsilon", *config)
    _add_run(rows.sparkSession, path, run, lambda out: rows.write.option("header", True).partitionBy(*config).csv(out))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    losses = T.StructType().add("instances_vues", T.LongType()).add("loss", T.DoubleType()).add("epsilon", T.DoubleType())
    return _read_runs(spark, path, T.StructType([*losses, *HISTORY_CONFIG]))


def _add_run(spark: SparkSession, path: str, run: str | None, write: Callable[[str], None]) -> None:
    key = uuid.uuid4().hex if run is None else hashlib.sha256(run.encode()).hexdigest()[:24]
    folder = f"{path}/run={key}"
    if published(spark, folder) is None:
        publish(spark, folder, write)


def _read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folders = committed(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema).options(header="true", basePath=path)
    return read.csv(folders).select(*schema.fieldNames())
