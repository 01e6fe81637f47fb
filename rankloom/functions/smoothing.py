"""Label smoothing, epsilon schedules and the loss, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SCORE = -1.0  # fixed value: a row without a weak score keeps its label


def smooth_classic(label: Column, eps: Column | float) -> Column:
    eps = _column(eps)
    return (F.lit(1.0) - eps) * label + eps * F.lit(0.5)


def smooth_weak(label: Column, score: Column, eps: Column | float) -> Column:
    eps = _column(eps)
    return F.when(score != NO_SCORE, (F.lit(1.0) - eps) * label + eps * score).otherwise(label.cast("double"))


def smoothed(mode: str, label: Column, score: Column, eps: Column | float) -> Column:
    """The target of a mode: ``classic`` blends in 0.5, the others the weak score."""
    return smooth_classic(label, eps) if mode == "classic" else smooth_weak(label, score, eps)


def beta_cdf(x: Column, a: float, b: float) -> Column:
    """Regularised incomplete beta function at ``x`` in [0, 1]."""
    if a <= 0 or b <= 0:
        raise ValueError("alpha and beta must be positive")
    if float(a).is_integer() and float(b).is_integer() and a + b <= 60:
        return _beta_cdf_integer(x, int(a), int(b))
    return _beta_cdf_series(x, float(a), float(b))


def _beta_cdf_integer(x: Column, a: int, b: int) -> Column:
    """The chance of at least ``a`` successes in a+b-1 trials."""
    n = a + b - 1
    total = F.lit(0.0)
    for j in range(a, n + 1):
        total = total + F.lit(float(math.comb(n, j))) * F.pow(x, F.lit(j)) * F.pow(F.lit(1.0) - x, F.lit(n - j))
    return total


def _beta_cdf_series(x: Column, a: float, b: float) -> Column:
    """Power series with positive terms, on the side of the mean where it falls from the start."""
    ln_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    turn = (a + 1.0) / (a + b + 2.0)
    n_terms = math.ceil(50 * (a + b + 2.0) / min(a + 1.0, b + 1.0) + 20 * math.sqrt(a + b))

    def lower(y: Column, p: float, q: float) -> Column:
        def add(acc: Column, n: Column) -> Column:
            term = acc["term"] * (F.lit(p + q) + n) / (F.lit(p + 1.0) + n) * y
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
        series = F.aggregate(F.sequence(F.lit(0), F.lit(n_terms)), start, add)["total"]
        return F.exp(F.lit(p) * F.ln(y) + F.lit(q) * F.ln(F.lit(1.0) - y) - F.lit(ln_beta + math.log(p))) * series

    return (
        F.when(x <= 0, 0.0)
        .when(x >= 1, 1.0)
        .when(x <= turn, lower(x, a, b))
        .otherwise(F.lit(1.0) - lower(F.lit(1.0) - x, b, a))
    )


def decayed(decay: str, eps: Column | float, progress: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Epsilon at ``progress`` in [0, 1) under a schedule: step, linear, exp, cosine or beta."""
    eps = _column(eps)
    if decay == "step":
        return F.when(progress < 0.5, eps).otherwise(0.0)
    if decay == "linear":
        return eps * (F.lit(1.0) - progress)
    if decay == "exp":
        return eps * F.exp(F.lit(-5.0) * progress)
    if decay == "cosine":
        return eps * F.lit(0.5) * (F.lit(1.0) + F.cos(F.pi() * progress))
    if decay == "beta":
        return eps * (F.lit(1.0) - beta_cdf(progress, alpha, beta))
    raise ValueError(f"unknown decay {decay!r}")


def step_by_instances(eps: Column | float, seen: Column, total: Column) -> Column:
    """The step schedule on whole numbers: the second half starts at ``total div 2``."""
    return F.when(seen < F.floor(total / 2), _column(eps)).otherwise(0.0)


def epsilon(
    mode: str,
    eps: Column | float,
    progress: Column,
    decay: str = "step",
    alpha: float = 1.0,
    beta: float = 1.0,
) -> Column:
    """baseline: none; ls and classic: constant; twsls: scheduled."""
    if mode == "baseline":
        return F.lit(0.0)
    if mode in ("ls", "classic"):
        return _column(eps)
    if mode == "twsls":
        return decayed(decay, eps, progress, alpha, beta)
    raise ValueError(f"unknown mode {mode!r}")


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Binary cross-entropy that neither overflows nor loses digits for large logits."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
