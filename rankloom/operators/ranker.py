"""A pointwise linear ranker on soft labels.

Binary cross-entropy on a soft label y equals that of two weighted hard rows, (1, y) and (0, 1-y). The loss is convex
and linear in y, so rows seen several times under changing targets count as one row with their mean target: the order
of a curriculum has no effect here, only the average it produces.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .lexical import LexicalIndex, document_lengths
from .retrieval import Bm25, TfIdf, query_vectors, score_pairs_by

FEATURES = ["bm25", "tf_idf", "overlap", "length_ratio"]
# Coefficients for scoring without a fit, so that another engine can repeat it digit by digit.
GIVEN = {"intercept": -2.0, "bm25": 0.25, "tf_idf": 0.0625, "overlap": 0.125, "length_ratio": 1.5}


def pair_features(ws: Workspace, index: LexicalIndex, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Add the lexical features of each (qid, docno) row; the rows' own ``score`` is not among them."""
    keys = rows.select("split", "qid", "docno").distinct()
    models = {"bm25": Bm25(k1=index.k1, b=index.b), "tf_idf": TfIdf(k1=index.k1, b=index.b)}
    both = score_pairs_by(ws, index, queries, keys, models)
    q_len = query_vectors(queries).select("split", "qid", F.col("length").alias("_ql"))
    ratio = F.round(F.col("_ql") / F.greatest(F.col("_ql") + F.col("dl"), F.lit(1)), 6)
    features = (
        both.join(q_len, ["split", "qid"])
        .join(document_lengths(index.documents), ["split", "docno"])
        .withColumn("length_ratio", ratio)
        .withColumn("overlap", F.col("overlap").cast("double"))
        .select("split", "qid", "docno", *FEATURES)
    )
    return rows.join(features, ["split", "qid", "docno"])


def _vectors(featured: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured)


def fit_ranker(ws: Workspace, featured: DataFrame, max_iter: int = 25) -> LogisticRegressionModel:
    """Fit on ``target`` in [0, 1]; rows repeated in a plan may be given once with their mean target."""
    hard = featured.select(
        *FEATURES,
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("hard_label"), F.col("target").alias("weight")),
                F.struct(F.lit(0.0).alias("hard_label"), (F.lit(1.0) - F.col("target")).alias("weight")),
            )
        ),
    ).filter("weight > 0")
    data = ws.stage(hard, "ranker-rows")
    learner = LogisticRegression(
        featuresCol="features", labelCol="hard_label", weightCol="weight", maxIter=max_iter, regParam=0.0
    )
    return learner.fit(_vectors(data).select("features", "hard_label", "weight"))


def apply_ranker(model: LogisticRegressionModel, featured: DataFrame) -> DataFrame:
    """Add ``logit``."""
    scored = model.transform(_vectors(featured))
    return scored.withColumn("logit", vector_to_array("rawPrediction")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def apply_coefficients(given: dict[str, float], featured: DataFrame) -> DataFrame:
    """Add ``logit`` of a linear ranker whose coefficients are known."""
    logit = F.lit(given["intercept"])
    for name in FEATURES:
        logit = logit + F.lit(given[name]) * F.col(name)
    return featured.withColumn("logit", logit)


def coefficients(model: LogisticRegressionModel, spark) -> DataFrame:
    """One row per feature and one for the intercept."""
    rows = [("intercept", float(model.intercept)), *zip(FEATURES, map(float, model.coefficients), strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double")
