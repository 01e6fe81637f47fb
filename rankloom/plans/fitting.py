"""A linear ranker trained along a training plan, so that schedules and the order of batches matter.

A plan is cut into ``steps`` blocks of whole batches. Each step is one aggregation over its block, read from its own
folder: the mean gradient of the cross-entropy on the smoothed targets under the weights so far. Rows of many runs
(methods, modes, seeds) are trained side by side in the same pass. Only the optimiser's state, one row per run, is on the
driver; all steps together read the plan once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.smoothing import bce_with_logits
from ..session import Workspace

Run = tuple


@dataclass(frozen=True)
class AdamW:
    """Adam with weight decay apart from the gradient; the intercept does not decay."""

    rate: float = 0.1
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    decay: float = 0.01

    def step(self, state: State, gradient: Sequence[float]) -> State:
        t = state.t + 1
        mean = [self.beta1 * m + (1 - self.beta1) * g for m, g in zip(state.mean, gradient, strict=True)]
        square = [self.beta2 * v + (1 - self.beta2) * g * g for v, g in zip(state.square, gradient, strict=True)]
        weights = [
            w * (1 - (self.rate * self.decay if j else 0.0))
            - self.rate * (m / (1 - self.beta1**t)) / (sqrt(v / (1 - self.beta2**t)) + self.eps)
            for j, (w, m, v) in enumerate(zip(state.weights, mean, square, strict=True))
        ]
        return State(weights, mean, square, t)


@dataclass(frozen=True)
class State:
    weights: list[float]  # intercept, then one per feature, on standardised features
    mean: list[float]
    square: list[float]
    t: int = 0

    @classmethod
    def new(cls, n_features: int) -> State:
        return cls([0.0] * (n_features + 1), [0.0] * (n_features + 1), [0.0] * (n_features + 1))


@dataclass(frozen=True)
class Fit:
    features: list[str]
    by: list[str]
    before: dict[Run, list[list[float]]] = field(repr=False)  # per run: the weights each step began with
    weights: dict[Run, list[float]]
    scale: dict[Run, list[tuple[float, float]]]  # per feature: mean and deviation
    rows: DataFrame = field(repr=False)  # the plan's rows with their block

    def coefficients(self, run: Run) -> dict[str, float]:
        """The final weights on unscaled features, as ``apply_coefficients`` takes them."""
        slopes = [w / sd for w, (_, sd) in zip(self.weights[run][1:], self.scale[run], strict=True)]
        shift = sum(b * mean for b, (mean, _) in zip(slopes, self.scale[run], strict=True))
        return {"intercept": self.weights[run][0] - shift, **dict(zip(self.features, slopes, strict=True))}

    def scored(self) -> DataFrame:
        """The plan's rows with the ``logit`` that the model in training gave them when their batch came up."""
        rows = [(*run, step, w) for run, steps in self.before.items() for step, w in enumerate(steps)]
        return _attach(self.rows, self.by, rows, self.scale, step=True).withColumn("logit", _logit(self.features)).drop(
            "_w", "_scale", "block"
        )


def fit_on_plan(
    ws: Workspace,
    targets: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = ("split",),
    steps: int = 16,
    optimizer: AdamW = AdamW(),
) -> Fit:
    """Train on rows of ``plan_targets`` with their features; ``by`` names the columns that tell runs apart.

    ``steps`` is the number of updates, and a parameter of the result. A block without a batch changes nothing. A run
    without rows has no weights. Rows with a null feature or target are an error.
    """
    features, by = list(features), list(by)
    block = F.least(F.floor(F.col("seen") * steps / F.col("total")), F.lit(steps - 1)).cast("int")
    complete = F.assert_true(
        ~F.greatest(*[F.col(c).isNull() for c in [*features, "target"]]), "a training row lacks a feature or its target"
    )
    checked = targets.withColumn("block", F.when(complete.isNull(), block))
    rows = ws.stage(checked, "fit-rows", ["block"])
    scale = _scales(rows, features, by)
    states = {run: State.new(len(features)) for run in scale}
    before: dict[Run, list[list[float]]] = {run: [] for run in scale}
    slope = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))) - F.col("target")
    for step in range(steps):
        for run, state in states.items():
            before[run].append(state.weights)
        current = [(*run, state.weights) for run, state in states.items()]
        met = _attach(rows.filter(F.col("block") == step), by, current, scale).withColumn("_z", _logit(features))
        sums = [F.avg(slope * x).alias(f"_g{j}") for j, x in enumerate([F.lit(1.0), *_scaled(features)])]
        for r in met.groupBy(*by).agg(F.count("*").alias("_n"), *sums).collect():  # one row per run
            if r["_n"]:
                run = tuple(r[c] for c in by)
                states[run] = optimizer.step(states[run], [r[f"_g{j}"] for j in range(len(features) + 1)])
    return Fit(features, by, before, {run: s.weights for run, s in states.items()}, scale, rows)


def _scales(rows: DataFrame, features: list[str], by: list[str]) -> dict[Run, list[tuple[float, float]]]:
    """Mean and deviation of each feature over a run's plan; a constant feature is only centred."""
    stats = [f(c).alias(f"{n}{j}") for j, c in enumerate(features) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))]
    found = rows.groupBy(*by).agg(F.count("*").alias("_n"), *stats).collect()  # one row per run
    return {
        tuple(r[c] for c in by): [
            (round(r[f"_m{j}"], 6), round(r[f"_s{j}"], 6) or 1.0) for j in range(len(features))
        ]
        for r in found
        if r["_n"]
    }


def _attach(
    rows: DataFrame, by: list[str], weights: list[tuple], scale: Mapping[Run, list[tuple[float, float]]], step: bool = False
) -> DataFrame:
    """Add the run's weights and scales; the frame joined has a row per run (and step)."""
    keys = [*by, "block"] if step else by
    types = dict(rows.dtypes)
    fields = [f"`{c}` {types[c]}" for c in keys] + ["_w array<double>", "_scale array<struct<mean:double,sd:double>>"]
    full = [(*w, scale[w[: len(by)]]) for w in weights]
    small = rows.sparkSession.createDataFrame(full, T._parse_datatype_string(", ".join(fields)))
    return rows.join(F.broadcast(small), keys)


def _scaled(features: Sequence[str]) -> list[Column]:
    return [
        (F.col(c) - F.col("_scale")[j]["mean"]) / F.col("_scale")[j]["sd"] for j, c in enumerate(features)
    ]


def _logit(features: Sequence[str]) -> Column:
    z = F.col("_w")[0]
    for j, x in enumerate(_scaled(features)):
        z = z + F.col("_w")[j + 1] * x
    return z


def fit_history(fit: Fit) -> DataFrame:
    """``instances_vues, loss, epsilon`` per run and batch: the loss of the model in training."""
    return fit.scored().groupBy(*fit.by, F.col("seen").alias("instances_vues")).agg(
        F.avg(bce_with_logits(F.col("logit"), F.col("target"))).alias("loss"), F.max("eps").alias("epsilon")
    )
