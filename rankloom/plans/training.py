"""The order in which a training run sees its rows: epochs, seeded shuffles, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import shuffled_positions
from ..functions.smoothing import bce_with_logits, epsilon, smoothed


def training_plan(
    rows: DataFrame,
    batch_size: int = 32,
    seed: Column | int = 0,
    total: int | None = None,
    epochs: float | None = None,
    group: Sequence[str] = ("split",),
) -> DataFrame:
    """Add ``epoch, batch, seen, total`` to each row and each time it is seen.

    Epochs repeat until ``total`` instances were seen (or ``epochs`` times the number of rows), each in its own
    shuffled order. An epoch's last batch may be short and the last batch may pass ``total``. ``seen`` counts the
    instances before the batch. Rows are identified by (qid, docno) inside ``group``.
    """
    if (total is None) == (epochs is None):
        raise ValueError("give either total or epochs")
    group = list(group)
    goal = F.lit(total).cast("bigint") if total is not None else F.floor(F.col("_n") * F.lit(float(epochs)))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n")).withColumn("total", goal)
    begun = rows.join(F.broadcast(sizes), group).withColumn(  # one row per split (and method)
        "epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("total") / F.col("_n")) - 1))
    )
    left = F.col("total") - F.col("epoch") * F.col("_n")
    placed = shuffled_positions(
        begun,
        key=["qid", "docno"],
        salt=[seed, F.col("epoch").cast("string")],
        within=[*group, "epoch"],
        out="_at",
        below=F.ceil(left / batch_size) * batch_size,
    )
    return placed.withColumn("batch", F.floor(F.col("_at") / batch_size)).withColumn(
        "seen", F.col("epoch") * F.col("_n") + F.col("batch") * batch_size
    ).drop("_n", "_at")


def plan_targets(
    plan: DataFrame, mode: str, eps: float, decay: str = "step", alpha: float = 1.0, beta: float = 1.0
) -> DataFrame:
    """Add the batch's ``eps`` and each instance's smoothed ``target``; the costly schedule is computed once per batch."""
    progress = F.col("seen") / F.col("total")
    value = epsilon(mode, eps, progress, decay, alpha, beta)
    if mode == "twsls" and decay == "beta":  # the others cost less than finding the batches: the plan would be made twice
        batches = plan.select("seen", "total").distinct().withColumn("eps", value)
        placed = plan.join(batches, ["seen", "total"])
    else:
        placed = plan.withColumn("eps", value)
    return placed.withColumn("target", smoothed(mode, F.col("label"), F.col("score"), F.col("eps")))


def history(targets: DataFrame, group: Sequence[str] = ("split",)) -> DataFrame:
    """``instances_vues, loss, epsilon`` per batch, from rows with ``seen, logit, target, eps``."""
    return targets.groupBy(*group, F.col("seen").alias("instances_vues")).agg(
        F.avg(bce_with_logits(F.col("logit"), F.col("target"))).alias("loss"), F.max("eps").alias("epsilon")
    )
