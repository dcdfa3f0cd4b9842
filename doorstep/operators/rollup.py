"""Customer-grain roll-ups of in-window orders on top of the pre-window counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import flag, ratio


def order_totals(orders: DataFrame, economics: DataFrame) -> DataFrame:
    """Per customer: orders, resolved, returned, COD count and contribution margin."""
    margins = economics.select("order_id", "contribution_margin")
    return (orders.join(margins, "order_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.count("rto_flag").alias("resolved"),
        F.sum(flag("rto_flag").cast("long")).alias("rto"),
        F.sum((F.col("payment_method") == "COD").cast("long")).alias("cod"),
        F.sum("contribution_margin").alias("cm")))


def customer_rollup(customers: DataFrame, orders: DataFrame, economics: DataFrame) -> DataFrame:
    """``dim_customer`` with its end-of-window (hence leaky) aggregates."""
    totals = order_totals(orders, economics)
    joined = customers.join(totals, "customer_id", "left").fillna(
        0, ["orders", "resolved", "rto", "cod"])
    placed = F.col("pre_window_orders") + F.col("orders")
    resolved = (F.col("pre_window_delivered") + F.col("pre_window_rto_count")
                + F.col("resolved"))
    rate = lambda n, d: F.coalesce(F.bround(ratio(n, d), 3), F.lit(0.0))
    out = joined.select(
        *customers.columns, placed.cast("int").alias("hist_orders_final"),
        rate(F.col("pre_window_rto_count") + F.col("rto"), resolved).cast("decimal(4,3)")
        .alias("hist_rto_rate_final"),
        rate(F.col("pre_window_cod_orders") + F.col("cod"), placed).cast("decimal(4,3)")
        .alias("hist_cod_share_final"),
        F.coalesce(F.col("cm"), F.lit(0)).cast("decimal(10,2)").alias("clv_estimate"))
    return out.withColumn("analytics_segment", segment())


def segment():
    """Tenure band (180 / 540 days) joined with COD-share band (0.3 / 0.8)."""
    days, cod = F.col("tenure_days_at_window_start"), F.col("hist_cod_share_final")
    return F.concat_ws(
        "_", F.when(days < 180, "NEW").when(days < 540, "GROWING").otherwise("ESTABLISHED"),
        F.when(cod < 0.3, "PREPAID").when(cod < 0.8, "MIXED").otherwise("COD"))


def mean_probability_by_customer(customers: DataFrame, sessions: DataFrame,
                                 probabilities: DataFrame, column: str) -> DataFrame:
    """Mean session probability per customer; NULL for customers without a session."""
    means = (sessions.select("session_id", "customer_id")
             .join(probabilities.select("session_id", column), "session_id")
             .groupBy("customer_id").agg(F.avg(column).alias(f"mean_{column}")))
    return customers.select("customer_id").join(means, "customer_id", "left")
