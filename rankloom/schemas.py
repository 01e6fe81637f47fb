"""Declared schemas and the checks made before any work starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_PAIRS = T.StructType([T.StructField("context", T.StringType()), T.StructField("response", T.StringType())])

TRAINING_COLUMNS = ["split", "qid", "query", "docno", "text", "score", "label", "pos"]

LEDGER = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("train_method", T.StringType()),
        T.StructField("test_method", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("decay", T.StringType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("beta", T.DoubleType()),
        T.StructField("eps", T.DoubleType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("r10_at_1", T.DoubleType()),
    ]
)

# The configuration of a run, without which two histories in one folder cannot be told apart.
HISTORY_CONFIG = T.StructType(
    [T.StructField("split", T.StringType()), *[LEDGER[c] for c in LEDGER.fieldNames() if c not in ("test_method", "r10_at_1")]]
)


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; it has {df.columns}")
    return df
