"""Seller tiers, cluster power, censoring tables and distribution summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag, lookup, ratio
from .ranks import quantiles


def seller_tiers(sellers: DataFrame) -> DataFrame:
    """A seller needs both the rating and the breach bar of a tier."""
    clears = {t: (F.col("seller_rating").cast("double") >= r)
              & (F.col("seller_sla_breach_rate").cast("double") <= b)
              for t, (r, b) in P.SELLER_TIER_BARS.items()}
    return sellers.select("seller_id", F.when(clears["GOLD"], "GOLD")
                          .when(clears["SILVER"], "SILVER").otherwise("BRONZE")
                          .alias("seller_tier"))


def cluster_power(geography: DataFrame, minimum: int = P.MIN_CLUSTERS_PER_TIER) -> DataFrame:
    """Clusters per tier and whether the tier is thick enough to audit."""
    g = geography.groupBy("geo_tier").agg(F.count(F.lit(1)).alias("clusters"))
    return g.withColumn("ok", F.col("clusters") >= minimum)


def category_scalars(products: DataFrame) -> DataFrame:
    """Realised over declared mean price per category, and its spread around the mean."""
    g = products.groupBy("category").agg(
        ratio(F.sum("list_price"), F.count(F.lit(1))).alias("mean_price"))
    declared = lookup("category", P.CATEGORY_MEAN_GMV).cast("double")
    scalar = ratio("mean_price", "declared")
    return g.withColumn("declared", declared).select(
        "category", "mean_price", "declared", F.round(scalar, 9).alias("implied_scalar"),
        F.round(scalar / F.avg(scalar).over(Window.partitionBy()) - 1, 9)
        .alias("relative_spread"))


def address_tier_correlation(t: Mapping[str, DataFrame]) -> DataFrame:
    geo = t["dim_geography"].select(F.col("geography_id").alias("delivery_geography_id"),
                                    "geo_tier")
    rank = lookup("geo_tier", {n: i for i, n in enumerate(P.GEO_TIERS)}).cast("double")
    j = t["fct_checkout_session"].select(
        "delivery_geography_id", F.col("address_completeness_score").cast("double").alias("a")
    ).join(geo, "delivery_geography_id")
    return j.agg(F.round(F.corr("a", rank), 8).alias("correlation"))


def daily_censoring(orders: DataFrame) -> DataFrame:
    """Censored share per order day over everything shipped."""
    return orders.where(F.col("is_shipped")).groupBy("order_date").agg(
        F.count(F.lit(1)).alias("orders"),
        ratio(F.count_if(F.col("is_censored")), F.count(F.lit(1))).alias("censored_share"))


def censoring_weeks(orders: DataFrame, last: int = 8) -> DataFrame:
    """The last weeks (Monday start): shipped, censored percent, return rate of resolved."""
    week = F.date_trunc("week", "order_date").cast("date").alias("week_of")
    g = orders.where(F.col("is_shipped")).groupBy(week).agg(
        F.count(F.lit(1)).alias("shipped"), F.count_if(F.col("is_censored")).alias("c"),
        F.count_if(flag("rto_flag")).alias("r"), F.count("rto_flag").alias("n"))
    return g.orderBy(F.desc("week_of")).limit(last).select(
        "week_of", "shipped", (ratio("c", "shipped") * 100).alias("censored_pct"),
        ratio("r", "n").alias("rto_rate_of_resolved"))


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per group."""
    v = F.col(value).cast("double")
    basic = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(v), 6).alias("mean"),
        F.round(F.stddev_samp(v), 6).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"))
    q = quantiles(df, value, [0.25, 0.5, 0.75], by).select(
        *by, *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    return basic.join(q, by).select(*by, "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, column: str, missing: str = "MISSING") -> DataFrame:
    """Level counts with NULL as its own level, most frequent first."""
    return (df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column))
