"""From pairs of several splits to stored training tables, all splits in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import sequential_ids
from ..operators import negatives as neg
from ..operators.lexical import build_index
from ..operators.relations import relations, with_ids
from ..session import Workspace, path_status
from ..sources.pairs import ingest_tsv_pairs
from ..sources.tables import read_training_table, replace_training_parts


def number_pairs(ws: Workspace, pairs: DataFrame) -> DataFrame:
    """Add ``number``: 1..n inside each split, in the order of context and response; equal rows get one each."""
    # The arrival number spreads copies of one pair over the range partitions; which copy has which number is no matter.
    placed = ws.stage(pairs.withColumn("_arrival", F.monotonically_increasing_id()), "arrived")
    numbered = ws.stage(sequential_ids(ws, placed, ["split", "context", "response", "_arrival"]), "numbered")
    firsts = numbered.groupBy("split").agg(F.min("row_no").alias("_first"))  # one row per split
    return (
        numbered.join(F.broadcast(firsts), "split")
        .withColumn("number", F.col("row_no") - F.col("_first") + 1)
        .drop("_arrival", "_first", "row_no")
    )


def prepare_training(
    ws: Workspace,
    pairs: DataFrame,
    row_id: Column,
    out: str,
    source: object,
    k: int = 9,
    method: str = "BM25",
    seed: int = 0,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Write the labelled training table of every split below ``out`` and return it, pruned to what was written.

    Each split has a corpus and an index of its own, so a query never gets a negative from another split; one job does
    them all. ``only`` names splits to build anew: the folders of the others, and of other methods, keep their files.
    A split that has no pairs any more keeps its folder too. ``row_id`` is unique inside a split; ``source`` describes
    the pairs and is part of the index tables' fingerprint.
    """
    chosen = pairs if only is None else pairs.filter(F.col("split").isin(list(only)))
    queries, corpus, qrels = relations(with_ids(chosen, row_id))
    if method == "BM25":
        mark = {"pairs": source, "only": sorted(only) if only is not None else None}
        index = build_index(ws, corpus, mark, depth=k + 1)
        negatives = neg.lexical_negatives(ws, index, queries, qrels, k)
    elif method == "random":
        negatives = neg.random_negatives(queries, qrels, corpus, k, seed)
    else:
        raise ValueError(f"unknown method {method!r}")
    groups = ws.stage(neg.labelled_groups(negatives, queries, qrels, k), "groups")
    replace_training_parts(neg.with_texts(groups, queries, corpus).withColumn("method", F.lit(method)), out)
    stored = read_training_table(ws.spark, out).filter(F.col("method") == method)
    return stored if only is None else stored.filter(F.col("split").isin(list(only)))


def prepare_from_tsv(
    ws: Workspace,
    paths: Mapping[str, str],
    out: str,
    k: int = 9,
    method: str = "BM25",
    seed: int = 0,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """The same from one TSV per split; a split's rows are numbered 1..n by their texts, so ids do not depend on the others."""
    wanted = {split: path for split, path in paths.items() if only is None or split in only}
    missing = set(only or ()) - set(paths)
    if missing:
        raise ValueError(f"no file for split(s) {sorted(missing)}")
    source = {split: path_status(ws.spark, path) for split, path in wanted.items()}
    pairs = number_pairs(ws, ingest_tsv_pairs(ws.spark, wanted, ws.new_path("ingested")))
    return prepare_training(ws, pairs, F.col("number"), out, source, k, method, seed, only)
