"""Hard negatives by Four-Russians scoring: table lookups in place of multiplications, all scores exact.

Vectors become integers, ``floor(SCALE * x)``. A candidate's integers are stored as bit planes, one byte for eight
dimensions and one bit of their two's complement. For an anchor, a table of 256 entries per group of eight dimensions holds
the sums of all subsets of its eight integers, so one lookup with a candidate's byte gives what that bit of eight dimensions
adds. Lookups are summed over the groups and planes are added by doubling, from the sign down: the full inner product.

Rows are packed into blocks of about ``BLOCK`` candidates and ``ANCHORS`` anchors; the anchors are the stated query set,
and a pair of blocks is one row of a join. Positives are looked for among blocks of the anchor's own label only, negatives
among all blocks. A join key names one block of anchors and ``SPAN`` blocks of candidates, so the work of a key is bounded
whatever share of the rows a label has. What leaves a pair of blocks are the first rows of each anchor (positives) or of
each anchor and positive (negatives); the first of those are picked by a window. Nothing is sent to all tasks.

Defined results: rows with a null id, a null label, a null vector, or a null, infinite or undefined component take no part;
rows that share an id are one row, that of the least label and vector; a vector of other length counts as padded with zeros;
an empty vector scores 0; equal scores go by id; anchors without positives, and positives without negatives, have no rows.
Scaled components beyond 2 ** 24 are an error, as sums might leave 64 bits. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import by_batch, dropped, small_batches, staged
from rankloom.session import configure

SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 10, 30, 90
BLOCK, ANCHORS, SPAN, GROUP = 4096, 256, 16, 8
LIMIT = 1 << 24
BITS = (np.arange(256)[:, None] >> np.arange(GROUP)) & 1  # which of eight dimensions a byte holds


def usable(rows: DataFrame, relabel: Column | None = None) -> DataFrame:
    """vec_id, label, vector (integers) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(
        x,
        lambda v: F.when(F.abs(v) * SCALE < LIMIT, F.floor(v * F.lit(float(SCALE)))).otherwise(
            F.raise_error(F.concat(F.lit("a component is too large: row "), F.col("vec_id").cast("string"))).cast("bigint")
        ),
    ).cast("array<int>")
    label = F.col("label") if relabel is None else relabel
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), scaled.alias("vector"))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("one")).select("vec_id", "one.*")


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros up to ``width`` columns."""
    sizes = np.asarray(vectors.value_lengths())
    out = np.zeros((len(sizes), width), np.int64)
    inside = np.arange(width) < sizes[:, None]
    out[inside] = np.asarray(vectors.flatten())
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """Packed bits of two's complement, sign first: an array of (planes, groups, rows) bytes."""
    top = int(max(values.max(initial=0), -1 - values.min(initial=0))).bit_length()
    cells = values.reshape(len(values), -1, GROUP)
    weights = (1 << np.arange(GROUP)).astype(np.int64)
    return np.stack([(((cells >> p) & 1) @ weights).T.astype(np.uint8) for p in range(top, -1, -1)])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """For each anchor and group of eight dimensions the sums of all subsets: an array of (anchors, groups, 256)."""
    return anchors.reshape(len(anchors), -1, GROUP) @ BITS.T


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all candidates of a block."""
    total = np.zeros((len(tables), packed.shape[2]), np.int64)
    groups = min(tables.shape[1], packed.shape[1])
    for p, plane in enumerate(packed):
        total = total * 2
        for g in range(groups):
            looked_up = np.take(tables[:, g], plane[g], axis=1)
            if p:
                total += looked_up
            else:
                total -= looked_up  # the sign bit weighs minus its place
    return total


def first_of_each(values: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest allowed values of each row, equal ones by smaller id."""
    low = np.iinfo(np.int64).min
    values = np.where(allowed, values, low)
    if values.shape[1] > k:
        bound = np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]
        rows, columns = np.nonzero(allowed & (values >= bound[:, None]))
    else:
        rows, columns = np.nonzero(allowed)
    order = np.lexsort((ids[columns], -values[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    begins = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else rows
    place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
    return rows[place < k], columns[place < k]


def dealt(rows: DataFrame, world: Column, block: int, anchors: int) -> DataFrame:
    """Add ``world, slice, slices, part, parts``: the blocks that a row belongs to, as candidate and as anchor of its world."""
    placed = rows.withColumn("world", world)
    sizes = placed.groupBy("world").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("n_anchors"))
    at = lambda seed, many: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(many))
    return (
        placed.join(sizes, "world")
        .withColumns({"slices": F.ceil(F.col("n") / block), "parts": F.ceil(F.col("n_anchors") / anchors)})
        .where("parts > 0")  # rows of a world without anchors are asked for by none
        .withColumns({"slice": at(1, "slices"), "part": at(2, "parts")})
        .drop("n", "n_anchors")
    )


def packed_blocks(rows: DataFrame) -> DataFrame:
    """world, span, part, ids, labels, shape, planes: blocks of candidates, each once for every block of anchors it meets."""
    fields = [("world", pa.int64()), ("slice", pa.int64()), ("parts", pa.int64())]
    lists = [(n, pa.list_(pa.int64())) for n in ("ids", "labels", "shape")]
    schema = pa.schema([*fields, *lists, ("planes", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        vectors = table.column("vector").combine_chunks()
        found = planes(matrix(vectors, width_of(vectors)))
        ids, labels = ([table.column(n).to_pylist()] for n in ("vec_id", "label"))
        columns = {n: table.column(n)[:1] for n, _ in fields}
        return pa.table(columns | {"ids": ids, "labels": labels, "shape": [list(found.shape)], "planes": [found.tobytes()]}, schema=schema)

    ddl = "world bigint, slice bigint, parts bigint, ids array<bigint>, labels array<bigint>, shape array<bigint>, planes binary"
    blocks = rows.select("world", "slice", "parts", "vec_id", "label", "vector").groupBy("world", "slice").applyInArrow(pack, ddl)
    return blocks.select(
        "world",
        F.floor(F.col("slice") / SPAN).alias("span"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
        "ids", "labels", "shape", "planes",
    )


def anchor_blocks(rows: DataFrame, *columns: str) -> DataFrame:
    """world, span, part, anchors, and lists of ``columns``: blocks of anchors, each once for every span of candidates."""
    fields = ["vec_id", "label", "vector", *columns]
    listed = rows.where("is_anchor").groupBy("world", "part").agg(
        F.max("slices").alias("slices"), F.sort_array(F.collect_list(F.struct(*fields))).alias("all")
    )
    spans = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slices") - 1) / SPAN))
    return listed.select("world", F.explode(spans).alias("span"), "part", *[F.col(f"all.{c}").alias(f"anchor_{c}") for c in fields])


def met(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    return blocks.join(anchors, ["world", "part", "span"])


def width_of(vectors: pa.ListArray) -> int:
    """Dimensions of the longest vector, filled up to whole groups; one group at least."""
    longest = int(np.asarray(vectors.value_lengths()).max(initial=1))
    return max(-(-longest // GROUP), 1) * GROUP


def scored_pairs(batch: pa.RecordBatch):
    """Of each pair of blocks: its row, ids and labels of anchors and candidates, and the scores of all anchors."""
    column = {n: batch.column(n) for n in batch.schema.names}
    tables, last = None, None
    for r in range(batch.num_rows):
        key = column["world"][r].as_py(), column["part"][r].as_py()
        if key != last:  # the join puts pairs of one block of anchors side by side
            vectors = column["anchor_vector"][r].values
            tables, last = subset_sums(matrix(vectors, width_of(vectors))), key
        packed = np.frombuffer(column["planes"][r].as_buffer(), np.uint8).reshape(column["shape"][r].as_py())
        names = "anchor_vec_id", "anchor_label", "ids", "labels"
        yield r, *(np.asarray(column[n][r].values) for n in names), scores(tables, packed)


def positives(anchors: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, place: the first ``k`` other rows of each anchor's world, which is its label."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def work(batch: pa.RecordBatch) -> dict:
        parts = [[], [], []]
        for _, own, _, ids, _, found in scored_pairs(batch):
            rows, columns = first_of_each(found, own[:, None] != ids, ids, k)
            for part, values in zip(parts, (own[rows], ids[columns], found[rows, columns])):
                part.append(values)
        return {f.name: np.concatenate(part) for f, part in zip(schema, parts)}

    pairs = met(anchors, blocks).mapInArrow(
        by_batch(work, schema), "anchor_id bigint, positive_id bigint, positive_score bigint"
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def negatives(anchors: DataFrame, blocks: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` also have ``anchor_found``: for each anchor its positives (positive_id, positive_score).
    """
    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")])

    def work(batch: pa.RecordBatch) -> dict:
        parts = [[] for _ in schema]
        for r, own, label, ids, labels, found in scored_pairs(batch):
            lists = batch.column("anchor_found")[r].values
            held = np.asarray(lists.value_lengths())
            flat = lists.flatten()
            begin = np.cumsum(held) - held
            for j in range(int(held.max(initial=0))):
                some = np.flatnonzero(held > j)
                positive = np.asarray(flat.field("positive_id"))[begin[some] + j]
                score = np.asarray(flat.field("positive_score"))[begin[some] + j]
                mine = found[some]
                allowed = (label[some][:, None] != labels) & (mine * 100 >= score[:, None] * least) & (mine * 100 <= score[:, None] * most)
                rows, columns = first_of_each(mine, allowed, ids, k)
                for part, values in zip(parts, (own[some][rows], positive[rows], ids[columns], score[rows], mine[rows, columns])):
                    part.append(values)
        return {f.name: np.concatenate(part or [np.zeros(0, np.int64)]) for f, part in zip(schema, parts)}

    pairs = met(anchors, blocks).mapInArrow(
        by_batch(work, schema),
        "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint",
    )
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def mined(
    spark: SparkSession,
    rows: DataFrame,
    is_anchor: Column,
    relabel: Column | None = None,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    block: int = BLOCK,
    anchors_per_block: int = ANCHORS,
) -> DataFrame:
    """Negatives of another label that score from ``least`` to ``most`` per cent of each of an anchor's positives."""
    configure(spark)
    small_batches(spark)
    clean = staged(spark, usable(rows, relabel).withColumn("is_anchor", is_anchor), "vectors")
    of_label = staged(spark, dealt(clean, F.col("label"), block, anchors_per_block), "of_label")
    found = staged(spark, positives(anchor_blocks(of_label), packed_blocks(of_label), n_positives), "positives")
    lists = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found")
    )
    # A constant that hangs on a column: the optimiser would fold a plain one away and lose the key of the join.
    of_all = staged(spark, dealt(clean, F.when(F.col("vec_id").isNotNull(), F.lit(0).cast("bigint")), block, anchors_per_block), "of_all")
    asked = staged(spark, of_all.where("is_anchor").join(lists, "vec_id"), "asked")
    out = staged(
        spark, negatives(anchor_blocks(asked, "found"), packed_blocks(of_all), n_negatives, least, most), "negatives"
    )
    dropped(spark, clean, of_label, found, of_all, asked)
    return out
