"""Experiment grids as rows, attached to data by a generator instead of a cross join."""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Run(NamedTuple):
    train_method: str
    test_method: str
    mode: str
    decay: str
    alpha: float
    beta: float
    eps: float
    seed: int


# The grids that the experiments use.
METHODS = ("random", "BM25")
SEEDS = (0, 1, 2, 3, 4)
MODES = (("baseline", 0.0), ("ls", 0.2), ("ls", 0.4), ("twsls", 0.2), ("twsls", 0.4))
DECAY_PROFILES = (("step", 1.0, 1.0), ("beta", 1.0, 1.0), ("beta", 5.0, 1.0), ("beta", 1.0, 5.0), ("beta", 3.0, 3.0))
ABLATION_EPS = 0.4


def main_grid() -> list[Run]:
    return [
        Run(train, test, mode, "step", 1.0, 1.0, eps, seed)
        for train, test, seed, (mode, eps) in product(METHODS, METHODS, SEEDS, MODES)
    ]


def ablation_grid() -> list[Run]:
    return [
        Run("BM25", "BM25", "twsls", decay, alpha, beta, ABLATION_EPS, seed)
        for seed, (decay, alpha, beta) in product(SEEDS, DECAY_PROFILES)
    ]


def grid_array(runs: list[Run]) -> Column:
    return F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in run._asdict().items()]) for run in runs])


def attach_grid(df: DataFrame, runs: list[Run]) -> DataFrame:
    """Every row once per run, the run's settings as columns; the grid travels inside the plan."""
    return df.select("*", F.inline(grid_array(runs)))


def grid_frame(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """The runs as rows, to be joined on their keys."""
    return spark.range(1).select(F.inline(grid_array(runs)))
