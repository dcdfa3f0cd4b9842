"""Stored daily sketches of distinct ids and of a value's distribution, merged for any period.

A day's sketch is a few kilobytes whatever the day holds, so a report over years merges sketches
and never reads the facts again. Merging is associative; days may be added in any order, and a day
that is recomputed replaces its own row alone.

Null ids and null values are not counted, a null day is a day of its own. A period without values has
null quantiles. Errors are bounded in probability: an id count has a relative standard error of
``1.04 / sqrt(2 ** lg_k)``, a quantile's rank is off by ``2.296 / k ** 0.9723`` at most with 99 %.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 400
QUANTILES = (0.25, 0.5, 0.9)
#: Standard errors, and 99 % bounds, that a check allows for.
SIGMAS, RANK_BOUNDS = 4.0, 2.0


def daily(facts: DataFrame, day: str, ids: str, value: str, lg_k: int = LG_K, k: int = K) -> DataFrame:
    """(day, rows, ids, quantiles): one row of sketches a day."""
    return facts.groupBy(F.col(day).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(ids, lg_k).alias("ids"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("quantiles"))


def merged(sketches: DataFrame, period: Column | str = "day") -> DataFrame:
    """(period, rows, ids, quantiles) from daily rows or from rows that were merged before."""
    period = F.col(period) if isinstance(period, str) else period
    return sketches.groupBy(period.alias("period")).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("ids").alias("ids"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"))


def estimates(sketches: DataFrame, probabilities: Sequence[float] = QUANTILES) -> DataFrame:
    """(period, rows, n_ids, n_values, estimates): ``estimates`` has a value for each probability.

    A sketch that never was merged estimates from the order of its rows as well, a merged one from its
    registers alone. Merged with itself, each is read the second way, so ids count the same however rows
    were dealt.
    """
    n = F.kll_sketch_get_n_double("quantiles")
    return sketches.select(
        "period", "rows", F.hll_sketch_estimate(F.hll_union("ids", "ids")).alias("n_ids"), n.alias("n_values"),
        F.when(n > 0, F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))
                                for p in probabilities])).alias("estimates"))


def errors(facts: DataFrame, period: Column, ids: str, value: str, found: DataFrame,
           probabilities: Sequence[float] = QUANTILES) -> DataFrame:
    """(period, exact_ids, id_error, rank_error) of estimates against the facts.

    ``rank_error`` is the largest distance, over the probabilities, from the range of ranks that an
    estimate takes among the period's values."""
    rows = facts.select(period.alias("period"), F.col(ids).alias("id"), F.col(value).cast("double").alias("x"))
    est = found.select("period", "n_ids", "estimates")
    own = rows.join(est, rows["period"].eqNullSafe(est["period"])).select(rows["period"], "id", "x", "n_ids", "estimates")
    q = [F.get("estimates", F.lit(i)) for i in range(len(probabilities))]
    counted = own.groupBy("period").agg(
        F.count_distinct("id").alias("exact_ids"), F.first("n_ids").alias("n_ids"), F.count("x").alias("n"),
        *[F.count_if(F.col("x") < c).alias(f"below{i}") for i, c in enumerate(q)],
        *[F.count_if(F.col("x") <= c).alias(f"upto{i}") for i, c in enumerate(q)])
    off = [F.greatest(F.lit(0.0), F.col(f"below{i}") / F.col("n") - p, p - F.col(f"upto{i}") / F.col("n"))
           for i, p in enumerate(probabilities)]
    return counted.select(
        "period", "exact_ids", F.try_divide(F.abs(F.col("n_ids") - F.col("exact_ids")), F.col("exact_ids")).alias("id_error"),
        F.when(F.col("n") > 0, F.array_max(F.array(*off))).alias("rank_error"))


def id_bound(lg_k: int = LG_K) -> float:
    return SIGMAS * 1.04 / 2 ** (lg_k / 2)


def rank_bound(k: int = K) -> float:
    return RANK_BOUNDS * 2.296 / k ** 0.9723


def report(facts: DataFrame, day: str, unit: str, ids: str, value: str) -> DataFrame:
    """One row a ``unit`` (month, year, ...): exact numbers, whether merged daily sketches keep their
    bounds, and whether they equal a sketch of the whole period."""
    parts = merged(daily(facts, day, ids, value), F.trunc("day", unit))
    own = facts.withColumn("period", F.trunc(day, unit))
    found = estimates(parts)
    direct = estimates(merged(daily(own, "period", ids, value))).select(
        F.col("period").alias("w"), F.col("n_ids").alias("w_ids"), F.col("n_values").alias("w_values"))
    off = errors(own, F.col("period"), ids, value, found).withColumnRenamed("period", "o")
    return found.join(direct, F.col("period").eqNullSafe(F.col("w"))).join(
        off, F.col("period").eqNullSafe(F.col("o"))).select(
        "period", "rows", "exact_ids", (F.coalesce("id_error", F.lit(0.0)) <= id_bound()).alias("ids_within"),
        (F.coalesce("rank_error", F.lit(0.0)) <= rank_bound()).alias("ranks_within"),
        ((F.col("n_ids") == F.col("w_ids")) & (F.col("n_values") == F.col("w_values"))).alias("merge_is_whole"))
