"""Records of delimited text files with line breaks inside quotes, read by all tasks.

A reader of byte ranges cannot know whether its first line begins inside a quoted field. But what a line does is a function
of that one bit: from either state it ends in a known one. The functions of a range's lines compose to one of four: always
outside, always inside, unchanged, turned over. A running composition over the ranges (one row each) gives the state in
which every range begins. Then every range cuts its own lines into records; a record that goes on in later ranges is put
together from one piece of each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def after(line: str, inside: bool, sep: str, quote: str) -> bool:
    """Whether a line that begins ``inside`` a quoted field ends inside one; a quote opens a field at its start only."""
    at = line.find(quote)
    if at < 0:
        return inside
    at = 0
    while True:
        if not inside:
            if not line.startswith(quote, at):
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at, inside = at + 1, True
        at = line.find(quote, at)
        if at < 0:
            return True
        if line.startswith(quote, at + 1):  # a doubled quote belongs to the field
            at += 2
            continue
        inside, at = False, line.find(sep, at) + 1
        if not at:
            return False


def _by_range(batches: Iterable[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """``file, block, lines, more``: the lines of each batch that belong to one range, in order."""
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("file", "block", "value", *more)]
        begin = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or (columns[0][k], columns[1][k]) != (columns[0][begin], columns[1][begin]):
                yield columns[0][begin], columns[1][begin], columns[2][begin:k], *[c[begin] for c in columns[3:]]
                begin = k


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Tasks read whole ranges, and the lines of a range in file order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def range_states(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """``file, block, inside``: the state in which each byte range begins."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("a", pa.bool_()), ("b", pa.bool_())])

    def run(batches):
        held = None
        for file, block, found in _by_range(batches):
            if held is None or held[:2] != [file, block]:
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held, schema)], schema=schema)
                held = [file, block, False, True]
            for line in found:
                if quote in line:
                    held[2:] = after(line, held[2], sep, quote), after(line, held[3], sep, quote)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held, schema)], schema=schema)

    ranges = lines.mapInArrow(run, "file string, block bigint, a boolean, b boolean")
    in_file = Window.partitionBy("file").orderBy("block")  # as many rows as the file has ranges
    turned = F.sum(F.when(F.col("a") & ~F.col("b"), 1).otherwise(0)).over(in_file)
    settled = F.last(F.when(F.col("a") == F.col("b"), F.struct("a", "turns")), ignorenulls=True).over(in_file)
    turns = F.col("turns") - F.coalesce(F.col("settled.turns"), F.lit(0))
    ends = F.coalesce(F.col("settled.a"), F.lit(False)) != (turns % 2 == 1)
    return (
        ranges.withColumn("turns", turned)
        .withColumn("settled", settled)
        .withColumn("ends", ends)
        .select("file", "block", F.coalesce(F.lag("ends").over(in_file), F.lit(False)).alias("inside"))
    )


def records(spark: SparkSession, path: str, sep: str = "\t", quote: str = '"') -> DataFrame:
    """``file, first, record``: every record as text; ``first`` marks a file's first one. Blank lines are none."""
    lines = _lines(spark, path)
    # One row per byte range of the files: their size over ``spark.sql.files.maxPartitionBytes``.
    begun = lines.join(F.broadcast(range_states(lines, sep, quote)), ["file", "block"])
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("no", pa.int64()), ("kind", pa.string()), ("text", pa.string())])

    def run(batches):
        now, inside, pending, no, rows = None, False, [], 0, []

        def put(kind: str) -> None:
            rows.append((*now, no, kind, "\n".join(pending)))
            pending.clear()

        def flush():
            out = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, schema=schema)

        for file, block, found, begins in _by_range(batches, "inside"):
            if now != (file, block):
                if pending:
                    put("tail" if no else "head")
                now, inside, no = (file, block), begins, 0 if begins else 1
            for line in found:
                if not inside and not pending and not line.strip("\r"):
                    continue
                pending.append(line)
                inside = after(line, inside, sep, quote)
                if not inside:
                    put("whole" if no else "head")
                    no += 1
            if rows:
                yield flush()
        if pending:
            put("tail" if no else "head")
        if rows:
            yield flush()

    pieces = begun.select("file", "block", "value", "inside").mapInArrow(
        run, "file string, block bigint, no bigint, kind string, text string"
    )
    whole = pieces.filter("kind = 'whole'").select("file", ((F.col("block") == 0) & (F.col("no") == 1)).alias("first"), "text")
    # A tail goes on in the heads of the ranges behind it: two pieces of a range at most, so a file has few of them.
    order = Window.partitionBy("file").orderBy("block", "no")
    parts = pieces.filter("kind <> 'whole'").withColumn("of", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(order))
    stitched = parts.groupBy("file", "of").agg(
        F.min(F.struct("block", "no")).alias("at"), F.sort_array(F.collect_list(F.struct("block", "no", "text"))).alias("p")
    )
    joined = stitched.select(
        "file", ((F.col("at.block") == 0) & (F.col("at.no") == 1)).alias("first"), F.array_join("p.text", "\n").alias("text")
    )
    return whole.unionByName(joined).select("file", "first", F.regexp_replace("text", "\r$", "").alias("record"))
