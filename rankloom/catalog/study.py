"""The tables a registered query starts from, each built once per session, source and parameter set."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import negatives as neg
from ..operators.lexical import LexicalIndex, build_index
from ..operators.relations import Relations, relations, with_ids
from ..operators.retrieval import score_pairs
from ..operators.splits import split_by_query
from ..plans.preparation import prepare_training
from ..plans.training import training_plan
from ..session import Workspace, path_status
from ..sources.pairs import conversation_pairs, one_split, read_rows
from ..sources.tables import read_training_table, write_sides

K = 9
BATCH = 32
EPOCHS = 2.5
EPS = 0.2
SEED = 0


class Study:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.ws = Workspace.of(spark)
        self._sides: dict[str, dict[str, str]] = {}

    @cached_property
    def source(self) -> dict[str, object] | None:
        return path_status(self.spark, f"{self.sf_dir}/conversations.parquet")

    @cached_property
    def pairs(self) -> DataFrame:
        """The pairs every later step starts from, written once."""
        mark = {"source": self.source, "format": 1}
        return self.ws.build_or_load("pairs", mark, lambda: conversation_pairs(self.spark, self.sf_dir))

    @cached_property
    def identified(self) -> DataFrame:
        return with_ids(self.pairs, F.concat_ws("_", "conv_id", "turn"))

    @cached_property
    def rel(self) -> Relations:
        return relations(self.identified)

    @cached_property
    def index(self) -> LexicalIndex:
        return build_index(self.ws, self.rel.corpus, self.source, depth=K + 1)

    @cached_property
    def library(self) -> Relations:
        """``documents`` as corpus, ``benchmark`` as queries."""
        documents = read_rows(self.spark, f"{self.sf_dir}/documents.parquet", "doc_id")
        items = self.spark.read.parquet(f"{self.sf_dir}/benchmark.parquet")
        return Relations(
            items.select(one_split("item_id").alias("split"), F.concat(F.lit("q"), "item_id").alias("qid"), F.col("text").alias("query")),
            documents.select(one_split("doc_id").alias("split"), F.concat(F.lit("d"), "doc_id").alias("docno"), "text"),
            None,
        )

    @cached_property
    def library_index(self) -> LexicalIndex:
        source = path_status(self.spark, f"{self.sf_dir}/documents.parquet")
        return build_index(self.ws, self.library.corpus, source, depth=K + 1)

    @cached_property
    def positions(self) -> DataFrame:
        mark = {"source": self.source, "format": 1}
        return self.ws.build_or_load("corpus-positions", mark, lambda: neg.corpus_positions(self.rel.corpus))

    def groups(self, method: str) -> DataFrame:
        """Labelled groups without texts: the result of data preparation."""
        mark = {"source": self.source, "method": method, "k": K, "seed": SEED, "format": 1}
        return self.ws.build_or_load("groups", mark, lambda: self._build_groups(method))

    def _build_groups(self, method: str) -> DataFrame:
        queries, corpus, qrels = self.rel
        if method == "random":
            negatives = neg.random_negatives(queries, qrels, corpus, K, SEED, positions=self.positions)
        else:
            negatives = neg.lexical_negatives(self.ws, self.index, queries, qrels, K, refill=method == "BM25_refill")
        return neg.labelled_groups(negatives, queries, qrels, K)

    def table(self, method: str) -> DataFrame:
        return neg.with_texts(self.groups(method), self.rel.queries, self.rel.corpus)

    def table_by_split(self) -> DataFrame:
        """Train, valid and test prepared in one job, then ``valid`` once more on its own."""
        pairs = self.ws.stage(conversation_pairs(self.spark, self.sf_dir, by_split=True), "pairs-by-split")
        row_id = F.concat_ws("_", "conv_id", "turn")
        out = self.ws.new_path("training-by-split")
        for only in (None, ["valid"]):
            prepare_training(self.ws, pairs, row_id, out, self.source, K, "BM25", only=only)
        return read_training_table(self.spark, out)

    def side_tables(self, method: str) -> dict[str, str]:
        """Paths of the train and the test table of a method, cut by query; written when they are first asked for."""
        if method not in self._sides:
            sided = neg.with_texts(
                split_by_query(self.groups(method), 0.9, SEED), self.rel.queries, self.rel.corpus, keep=["side"]
            )
            self._sides[method] = write_sides(sided.withColumn("method", F.lit(method)), self.ws.new_path(f"{method}-sides"))
        return self._sides[method]

    def scored(self, method: str) -> DataFrame:
        """Groups with the raw BM25 score of every pair, also the relevant one, as ``logit``."""
        mark = {"source": self.source, "method": method, "k": K, "seed": SEED, "logit": "BM25"}

        def build() -> DataFrame:
            groups = self.groups(method)
            logits = score_pairs(self.ws, self.index, self.rel.queries, groups.select("split", "qid", "docno"))
            return groups.join(
                logits.select("split", "qid", "docno", F.col("score").alias("logit")), ["split", "qid", "docno"]
            )

        return self.ws.build_or_load("scored", mark, build)

    def plan(self, method: str = "BM25", seed: int = SEED) -> DataFrame:
        """The order in which a run sees its rows; scores of the ranker are joined only where a loss is asked for."""
        mark = {"source": self.source, "method": method, "k": K, "batch": BATCH, "epochs": EPOCHS, "seed": seed, "format": 1}
        return self.ws.build_or_load("plan", mark, lambda: training_plan(self.groups(method), BATCH, seed, epochs=EPOCHS))

    def scored_plan(self, method: str = "BM25") -> DataFrame:
        logits = self.scored(method).select("split", "qid", "docno", "logit")
        return self.plan(method).join(logits, ["qid", "docno", "split"])
