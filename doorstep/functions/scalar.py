"""Native column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def flag(col: str | Column) -> Column:
    """Three-valued outcome to two-valued event flag: NULL counts as False."""
    return F.coalesce(_c(col), F.lit(False))


def ratio(num: str | Column, den: str | Column) -> Column:
    """Double ratio, NULL when the denominator is zero or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def raw_rate(successes: str | Column, trials: str | Column, digits: int = 4) -> Column:
    """Observed rate, NULL without trials; half-even rounding."""
    return F.bround(ratio(successes, trials), digits)


def shrunk_rate(successes: str | Column, trials: str | Column, prior: float = P.RTO_PRIOR,
                k: float = P.SHRINKAGE_K) -> Column:
    """Empirical-Bayes rate: ``prior`` when there are no trials. Bad counts fail the job."""
    if k <= 0 or not 0 <= prior <= 1:
        raise ValueError(f"prior must lie in [0, 1] and k be positive, got {prior}, {k}")
    s, n = _c(successes), _c(trials)
    value = (s + F.lit(k * prior)) / (n + F.lit(float(k)))
    return F.when((s < 0) | (n < 0) | (s > n), F.raise_error(
        F.lit("shrunk_rate needs 0 <= successes <= trials"))).otherwise(value)


def half_even_mean(money_sum: str | Column, count: str | Column) -> Column:
    """Exact mean of a two-place decimal sum, half-even at two places, NULL without rows."""
    cents, n = (_c(money_sum) * 100).cast("long"), _c(count)
    rest = F.try_mod(cents, n)
    whole = F.try_divide((cents - rest).cast("double"), n.cast("double")).cast("long")
    up = (rest * 2 > n) | ((rest * 2 == n) & (F.pmod(whole, F.lit(2)) == 1))
    return ((whole + up.cast("long")) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(10,2)")


def logistic(x: str | Column) -> Column:
    """Overflow-safe logistic."""
    x = _c(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: str | Column) -> Column:
    """Log-odds; a probability outside (0, 1) fails the job."""
    p = _c(p)
    return F.when((p <= 0) | (p >= 1), F.raise_error(F.lit("logit needs 0 < p < 1"))
                  ).otherwise(F.log(p / (1 - p)))


def clipped_logit(p: str | Column, eps: float = 1e-9) -> Column:
    p = F.greatest(F.least(_c(p), F.lit(1 - eps)), F.lit(eps))
    return F.log(p / (1 - p))


def lookup(key: str | Column, mapping: Mapping, *, default=None, kind: str | None = None) -> Column:
    """Small fixed map as a CASE; an unmapped non-null key fails unless ``default`` is given."""
    key = _c(key)
    expr = None
    for name, value in mapping.items():
        value = F.lit(value) if kind is None else F.lit(value).cast(kind)
        expr = F.when(key == name, value) if expr is None else expr.when(key == name, value)
    if default is not None:
        return expr.otherwise(F.lit(default) if kind is None else F.lit(default).cast(kind))
    message = F.concat(F.lit("no value declared for level "), key)
    return expr.when(key.isNotNull(), F.raise_error(message))


def tenure_bucket(delivered: str | Column) -> Column:
    """Right-closed completed-order buckets 0, 1-2, 3-5, 6-15, 16+."""
    d = F.coalesce(_c(delivered), F.lit(0))
    return (F.when(d <= 0, "0").when(d <= 2, "1-2").when(d <= 5, "3-5")
            .when(d <= 15, "6-15").otherwise("16+"))


def softmax(scores: Column) -> Column:
    """Row-wise softmax over an array column, shifted by its maximum."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return F.transform(weights, lambda w: w / total)


def rule_tier_m1(shrunk: str | Column, is_new: str | Column) -> Column:
    s, new = _c(shrunk), _c(is_new)
    return (F.when(s >= P.HIGH_RTO_SHRUNK, "HIGH").when((s >= P.MED_RTO_SHRUNK) | new, "MED")
            .otherwise("LOW"))


def rule_tier_m2(m1_tier: str | Column, method: str | Column) -> Column:
    """The M1 tier moved up one step for COD, capped at HIGH."""
    rank = lookup(m1_tier, {t: i for i, t in enumerate(P.RISK_TIERS)})
    rank = F.least(rank + (_c(method) == "COD").cast("int"), F.lit(len(P.RISK_TIERS) - 1))
    return F.element_at(F.array(*[F.lit(t) for t in P.RISK_TIERS]), rank + 1)


def score_tier(score: str | Column, p_star: float = P.P_STAR) -> Column:
    s = _c(score)
    return F.when(s >= p_star, "HIGH").when(s >= P.MED_SCORE_FLOOR, "MED").otherwise("LOW")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---- driver scalars ------------------------------------------------------------------
def chi2_tail_1df(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def normal_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def latent_noise_attenuation(noise_sd: float) -> float:
    """Shrinkage of logit coefficients when noise of ``noise_sd`` is left out of the model."""
    return 1.0 / math.sqrt(1.0 + 3.0 / math.pi ** 2 * noise_sd ** 2)


def scalar_logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


# ---- intervals on aggregated columns ------------------------------------------------------
def diff_ci_columns(mean_a: Column, var_a: Column, n_a: Column,
                    mean_b: Column, var_b: Column, n_b: Column) -> list[Column]:
    """Difference of means in percentage points with a 95 % normal interval."""
    d = mean_a - mean_b
    se = F.sqrt(F.try_divide(var_a, n_a.cast("double")) + F.try_divide(var_b, n_b.cast("double")))
    return [(d * 100).alias("diff_pp"), ((d - 1.96 * se) * 100).alias("ci_low_pp"),
            ((d + 1.96 * se) * 100).alias("ci_high_pp")]


def katz_columns(x1: Column, n1: Column, x0: Column, n0: Column) -> list[Column]:
    """Ratio of two proportions with the log-method interval; NULL when a cell is empty."""
    p1, p0 = ratio(x1, n1), ratio(x0, n0)
    lift = F.try_divide(p1, p0)
    se = F.sqrt(F.try_divide(1 - p1, x1.cast("double")) + F.try_divide(1 - p0, x0.cast("double")))
    log_lift = F.when(lift > 0, F.log(lift))
    return [lift.alias("lift"), F.exp(log_lift - 1.96 * se).alias("ci_low"),
            F.exp(log_lift + 1.96 * se).alias("ci_high")]
