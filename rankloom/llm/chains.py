"""Toxicity by a classifier chain: linear models in a fixed order, each fed the probabilities of the earlier ones.

Features are counts of words and word beginnings. Those that tell the classes apart best (chi-square over documents) are
chosen by one aggregation over the labelled sample. Category after category, a logistic model is fitted on them and on the
earlier categories' probabilities; for training these are out of fold, so a later model learns how far to trust an earlier
one on unseen texts. Scoring runs the chain in each row.

Only the fit is bounded: at most ``sample`` labelled rows, those with the smallest hash of their id, and ``features``
columns reach the driver. Every document is scored over its whole text.

Defined results: a null or empty text has no features; its probabilities are those of the intercepts. Labels that are null
are left out, of several labels of a document the larger counts. Without labels, or for a category without both classes,
the probability is the share of the category in the sample (0 without labels). Ties in the choice of features go to the
smaller feature. Equal rows are scored alike; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import by_batch, small_batches, staged, text_of

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
FOLDS = 3


def features_of(text: str) -> Counter:
    """Counts of a text's words and of their beginnings (marked with ``^``)."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        for k in BEGINNINGS:
            if len(word) > k:
                out["^" + word[:k]] += n
    return out


@dataclass
class Linear:
    """Intercept and weights of a logistic model."""

    bias: float
    weights: np.ndarray

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(values @ self.weights + self.bias, -30, 30)))


@dataclass
class Sparse:
    """Rows of few features each, with some dense columns behind them."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n: int
    width: int
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.bincount(self.rows, self.values * w[: self.width][self.columns], self.n)
        return out + self.dense @ w[self.width :] if self.dense.size else out

    def back(self, r: np.ndarray) -> np.ndarray:
        head = np.bincount(self.columns, self.values * r[self.rows], self.width).astype(float)
        return np.concatenate([head, self.dense.T @ r]) if self.dense.size else head

    def subset(self, keep: np.ndarray) -> Sparse:
        at, place = keep[self.rows], np.cumsum(keep) - 1
        dense = self.dense[keep] if self.dense.size else self.dense
        return Sparse(place[self.rows[at]], self.columns[at], self.values[at], int(keep.sum()), self.width, dense)


def fit(x: Sparse, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> Linear:
    """Logistic regression by accelerated gradient steps."""
    size = x.width + (x.dense.shape[1] if x.dense.size else 0)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Linear(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(size))
    norms = np.bincount(x.rows, x.values**2, x.n) + 1 + ((x.dense**2).sum(axis=1) if x.dense.size else 0)
    probe = np.ones(size)  # largest singular value, by power steps
    for _ in range(8):
        probe /= np.linalg.norm(probe)
        probe = x.back(x.times(probe))
    pace = 1 / (0.25 * min(norms.max(), (np.linalg.norm(probe) / x.n + 1)) + penalty)
    w, bias = np.zeros(size), float(np.log(share / (1 - share)))
    v, vb = w, bias
    for k in range(steps):
        r = 1 / (1 + np.exp(-np.clip(x.times(v) + vb, -30, 30))) - y
        new, nb = v - pace * (x.back(r) / x.n + penalty * v), vb - pace * r.mean()
        v, vb = new + k / (k + 3) * (new - w), nb + k / (k + 3) * (nb - bias)
        w, bias = new, nb
    return Linear(bias, w)


@dataclass
class Chain:
    """The fitted chain: feature columns, and a model per category in order."""

    categories: list[str]
    columns: dict[str, int]
    models: list[Linear]

    def probabilities(self, text: str) -> list[float]:
        values = np.zeros(len(self.columns) + len(self.categories))
        for name, n in features_of(text).items():
            at = self.columns.get(name)
            if at is not None:
                values[at] = np.log1p(n)
        width = len(self.columns)
        out: list[float] = []
        for k, model in enumerate(self.models):
            out.append(float(model.probability(values[: width + k])))
            values[width + k] = out[-1]
        return out


def fit_chain(x: Sparse, labels: np.ndarray, folds: np.ndarray, categories: list[str], columns: dict[str, int]) -> Chain:
    """Fits category after category; later ones are trained with out-of-fold probabilities of the earlier ones."""
    models, seen = [], np.zeros((x.n, 0))
    for k in range(len(categories)):
        full = Sparse(x.rows, x.columns, x.values, x.n, x.width, seen)
        y, outside = labels[:, k], np.zeros(x.n)
        for fold in range(FOLDS):
            rest, held = folds != fold, folds == fold
            part = fit(full.subset(rest), y[rest])
            outside[held] = 1 / (1 + np.exp(-np.clip(full.subset(held).times(part.weights) + part.bias, -30, 30)))
        models.append(fit(full, y))
        seen = np.column_stack([seen, outside])
    return Chain(categories, columns, models)


def learn(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = 10_000, features: int = 1500
) -> Chain:
    """Fits the chain; ``categories`` names 0/1 columns over ``docs`` joined with ``labels``, in order."""
    small_batches(spark)
    given = [c for c in labels.columns if c != "doc_id"]
    chosen = (
        labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in given))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    joined = docs.drop(*given).join(chosen, "doc_id").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"),
        F.array(*(c.cast("double") for c in categories.values())).alias("y"),
    )
    known = joined.where(~F.exists("y", lambda v: v.isNull())).dropDuplicates(["doc_id"])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("y", pa.list_(pa.float64())), ("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))
    ])

    def work(batch: pa.RecordBatch) -> dict:
        found = [features_of(t) for t in batch.column(1).to_pylist()]
        return {
            "doc_id": batch.column(0), "y": batch.column(2).to_pylist(),
            "names": [list(f) for f in found], "counts": [list(f.values()) for f in found],
        }

    rows = staged(
        spark, known.mapInArrow(by_batch(work, schema), "doc_id bigint, y array<double>, names array<string>, counts array<bigint>"), "features"
    )
    width = len(categories)
    total = rows.agg(F.count(F.lit(1)), *(F.sum(F.col("y")[k]) for k in range(width))).first()
    n = total[0]
    names = list(categories)
    if not n:
        return Chain(names, {}, [Linear(-30.0, np.zeros(k)) for k in range(width)])
    each = rows.select("y", F.explode("names").alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("docs"), *(F.sum(F.col("y")[k]).alias(f"p{k}") for k in range(width))
    ).where("docs >= 3")
    score = F.greatest(*(
        F.pow(F.col(f"p{k}") - F.col("docs") * (total[k + 1] / n), 2) / (F.col("docs") * max(total[k + 1] / n, 1e-9)) for k in range(width)
    ), F.lit(0.0))
    best = [r["name"] for r in each.orderBy(score.desc(), "name").limit(features).collect()]
    columns = {name: k for k, name in enumerate(best)}
    order = staged(spark, rows.withColumn("row", F.row_number().over(Window.orderBy("doc_id")) - 1), "ordered")  # the sample only
    wanted = spark.createDataFrame([(name, k) for name, k in columns.items()], "name string, col int")
    cells = (
        order.select("row", F.explode(F.arrays_zip("names", "counts")).alias("c")).select("row", F.col("c.names").alias("name"), F.col("c.counts").alias("n"))
        .join(F.broadcast(wanted), "name").select("row", "col", "n").toArrow()
    )
    heads = order.orderBy("row").select("y", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold")).toArrow()
    as_int = lambda c: cells.column(c).to_numpy().astype(np.int64)
    x = Sparse(as_int("row"), as_int("col"), np.log1p(as_int("n")), n, len(columns))
    y = np.array(heads.column("y").to_pylist(), float).reshape(n, width)
    return fit_chain(x, y, heads.column("fold").to_numpy().astype(int), names, columns)


def judged(spark: SparkSession, docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, the probability of each category, toxic (the last category's reaches ``threshold``)."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in names), ("toxic", pa.bool_())])

    def work(batch: pa.RecordBatch) -> dict:
        found = [model.value.probabilities(t) for t in batch.column(1).to_pylist()]
        out: dict = {n: [p[k] for p in found] for k, n in enumerate(names)}
        return out | {"doc_id": batch.column(0), "toxic": [p[-1] >= threshold for p in found]}

    ddl = "doc_id bigint, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(by_batch(work, schema), ddl)


def toxicity_categories() -> dict[str, Column]:
    """The label table has one toxicity flag; its categories are the flag by language group, then the flag itself."""
    flag = F.col("toxic")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return {
        "toxic_english": F.when(english, flag).when(flag.isNotNull(), F.lit(0)),
        "toxic_other": F.when(~english, flag).when(flag.isNotNull(), F.lit(0)),
        "toxic": flag,
    }


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **learning) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, all columns kept."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(learn(spark, docs, labels, toxicity_categories(), **learning))

    def run(batches):
        for batch in batches:
            rows = batch.column(0)
            texts = (t.as_py() or "" for t in rows.field("text"))
            keep = [model.value.probabilities(t)[-1] < threshold for t in texts]
            yield pa.RecordBatch.from_arrays([rows.filter(pa.array(keep, pa.bool_()))], names=["row"])

    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, f"row struct<{fields}>").select("row.*")
