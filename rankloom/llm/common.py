"""What the operators share: written stages in the shared folder, bounded Arrow batches, null-safe texts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import shared_folder

# A task holds one batch of texts at a time: at most so many rows and bytes of them.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def small_batches(spark: SparkSession) -> None:
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)


def staged(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once in the shared folder and read back: lineage ends here and survives lost executors."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def by_batch(work: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable:
    """A ``mapInArrow`` function that turns each batch into columns of ``schema``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = work(batch)
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    return run


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, and lets Spark's cleaner free the shuffles behind them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("llm-"):
                path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component of the links (hub, node), for nodes that have a link.

    Every node takes its smallest neighbour as parent, which makes trees; trees are flattened by jumping from parent to
    parent and become one node each. What is left are the links between trees, and there are fewer of them every round.
    """
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = edges.select(F.col("hub").alias("a"), F.col("node").alias("b")).where("a <> b").select(*ordered)
    left = staged(spark, left.distinct(), "edges")
    named = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        trees = staged(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "trees")
        while True:
            above = trees.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = staged(
                spark, trees.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "trees"
            )
            flat = higher.where("moved").isEmpty()
            trees = higher.select("node", "root")
            if flat:
                break
        up = trees.select(F.col("node").alias("root"), F.col("root").alias("top"))
        named = trees if named is None else staged(
            spark, named.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "named"
        )
        ends = [trees.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root")) for n in ("a", "b")]
        between = left.join(ends[0], "a").join(ends[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        left = staged(spark, between.where("a <> b").select(*ordered).distinct(), "edges")
    return spark.createDataFrame([], "node bigint, root bigint") if named is None else named
