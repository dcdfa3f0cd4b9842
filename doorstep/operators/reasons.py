"""Return-reason scoring: driver table, posterior over ten reasons, code maps."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag, lookup, softmax
from ..session import keep
from .traces import with_z
from .views import first_attempt_delay

NAMES = tuple(P.REASONS)


def reason_codes(orders: DataFrame) -> DataFrame:
    """Class and non-delivery code of each return reason; an unknown reason fails."""
    return orders.where(flag("rto_flag")).select(
        "order_id", "rto_reason",
        lookup("rto_reason", {k: v[1] for k, v in P.REASONS.items()}).alias("rto_reason_class"),
        lookup("rto_reason", {k: v[2] for k, v in P.REASONS.items()}).alias("ndr_code"))


def reason_drivers(t: Mapping[str, DataFrame]) -> DataFrame:
    """One row per order with every driver the weight matrix names."""
    st = t["fct_customer_state_at_session"].select(
        "session_id", F.col("pit_is_new_customer").cast("double").alias("pit_is_new_customer"),
        "pit_orders_delivered")
    o = t["fct_order"].select("order_id", "session_id", "customer_id", "delivery_geography_id",
                              "order_date", "payment_method", "order_value", "discount_pct",
                              "estimated_delivery_days", "rto_flag")
    lat = t["truth_customer_latent"].select(
        "customer_id", F.col("latent_intent").cast("double").alias("latent_intent_z"),
        F.col("latent_liquidity").cast("double").alias("latent_liquidity_z"))
    s = t["fct_checkout_session"].select(
        "session_id", F.col("address_completeness_score").cast("double")
        .alias("address_completeness"), (F.col("cart_size") >= 3).cast("double")
        .alias("cart_size_ge3"))
    g = t["dim_geography"].select(
        F.col("geography_id").alias("delivery_geography_id"), "serviceability_score",
        "courier_reliability_score", (F.col("geo_tier") == "TIER3").cast("double")
        .alias("geo_tier_tier3"))
    j = (o.join(lat, "customer_id").join(s, "session_id").join(st, "session_id")
         .join(g, "delivery_geography_id").join(first_attempt_delay(t), "order_id", "left"))
    # read by the scalings and by the drivers
    j = with_z(keep(j), {"serviceability_z": "serviceability_score",
                   "courier_reliability_z": "courier_reliability_score",
                   "attempt_delay_days_z": "attempt_delay_days"})
    c = P.CENTERING
    value = F.greatest(F.col("order_value").cast("double"), F.lit(1.0))
    return j.select(
        "order_id", "rto_flag", "latent_intent_z", "latent_liquidity_z", "address_completeness",
        "serviceability_z", "courier_reliability_z",
        F.coalesce("attempt_delay_days_z", F.lit(0.0)).alias("attempt_delay_days_z"),
        "geo_tier_tier3", "pit_is_new_customer", "pit_orders_delivered", "cart_size_ge3",
        ((F.col("discount_pct").cast("double") - c["discount_pct_center"])
         / c["discount_pct_unit"]).alias("discount_pct_centered"),
        (F.col("estimated_delivery_days").cast("double") - c["est_delivery_days_center"])
        .alias("est_delivery_days_centered"),
        F.log(value / c["order_value_scale"]).alias("log_order_value"),
        (F.dayofmonth("order_date") >= 26).cast("double").alias("is_month_end"),
        (F.col("payment_method") == "COD").alias("is_cod"))


def reason_posterior(drivers: DataFrame) -> DataFrame:
    """Probability of each reason per returned order, after the two hard gates."""
    undeclared = {t for w in P.REASON_DRIVERS.values() for t, x in w.items() if x} \
        - set(drivers.columns)
    if undeclared:
        raise ValueError(f"declared weights without a driver: {sorted(undeclared)}")
    scores = []
    for name in NAMES:
        score = F.lit(math.log(P.REASONS[name][0]))
        for term, weight in P.REASON_DRIVERS[name].items():
            if weight:
                score = score + weight * F.col(term)
        if name == P.CASH_REASON:
            score = F.when(~F.col("is_cod"), F.lit(P.SUPPRESSED_SCORE)).otherwise(score)
        if name == P.LOW_INTENT_REASON:
            score = F.when(F.col("pit_orders_delivered") >= P.LOW_INTENT_MAX_DELIVERED,
                           F.lit(P.SUPPRESSED_SCORE)).otherwise(score)
        scores.append(score)
    scored = drivers.where(flag("rto_flag")).withColumn("scores", F.array(*scores))
    probs = scored.select("order_id", softmax(F.col("scores")).alias("p"))
    return probs.select("order_id", F.map_from_arrays(
        F.array(*[F.lit(n) for n in NAMES]), F.col("p")).alias("posterior"))


def posterior_means(posterior: DataFrame) -> DataFrame:
    """Expected share of each reason and class."""
    long = posterior.select(F.explode("posterior").alias("rto_reason", "p"))
    return long.groupBy("rto_reason").agg(
        F.round(F.avg("p"), 6).alias("expected_share")).withColumn(
        "rto_reason_class", lookup("rto_reason", {k: v[1] for k, v in P.REASONS.items()}))
