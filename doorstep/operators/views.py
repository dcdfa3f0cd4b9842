"""The four analysis views, the firewall in front of model input, and population filters.

Dimension joins carry no broadcast hint: Spark broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold`` and adaptive execution re-checks the real size,
otherwise it sorts and merges with skew splitting.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import rule_tier_m2

Tables = Mapping[str, DataFrame]


class FirewallError(ValueError):
    """A column that must not reach a model is present."""


def resolved(df: DataFrame) -> DataFrame:
    """The return-rate denominator: shipped and not censored."""
    return df.where(F.col("is_shipped") & ~F.col("is_censored"))


def _geo(t: Tables, *cols: str) -> DataFrame:
    return t["dim_geography"].select(F.col("geography_id").alias("delivery_geography_id"), *cols)


def funnel_view(t: Tables) -> DataFrame:
    """Session-grain funnel with the delivery tier."""
    s = t["fct_checkout_session"].join(_geo(t, "geo_tier"), "delivery_geography_id")
    return s.select(
        "session_id", "customer_id", "date_id", "device_type", "geo_tier", "cart_size",
        "estimated_delivery_days", "address_completeness_score", "checkout_started",
        "address_completed", "payment_page_reached", "intended_payment_method",
        "final_payment_method", "switched_to_cod_after_failure", "payment_attempt_count",
        "checkout_abandoned", "abandon_step", F.col("order_id").isNotNull().alias("converted"))


ORDER_COLUMNS = ("order_id", "session_id", "customer_id", "order_date", "payment_method",
                 "paid_via_switch", "quantity", "gmv", "discount_pct", "order_value",
                 "order_status", "is_cancelled_preship", "is_shipped", "is_censored",
                 "is_delivered", "rto_flag", "rto_reason", "rto_reason_class",
                 "delivery_attempts", "actual_delivery_days", "delivery_delay_days",
                 "outcome_resolved_date")
MARGIN_COLUMNS = ("net_revenue", "cogs", "total_variable_cost", "contribution_margin",
                  "counterfactual_cm_if_delivered", "rto_cash_loss", "foregone_cm",
                  "rto_economic_cost")


def order_enriched(t: Tables) -> DataFrame:
    """Order grain with realised economics; leaky by design, never a training source."""
    o = t["fct_order"].select(*ORDER_COLUMNS, "product_id", "seller_id", "delivery_geography_id")
    j = (o.join(t["fct_order_economics"].select("order_id", *MARGIN_COLUMNS), "order_id")
         .join(t["dim_product"].select("product_id", "category", "weight_band"), "product_id")
         .join(t["dim_seller"].select("seller_id", "seller_tier"), "seller_id")
         .join(_geo(t, "geo_tier"), "delivery_geography_id"))
    return j.select(*ORDER_COLUMNS, "category", "weight_band", "seller_tier", "geo_tier",
                    *MARGIN_COLUMNS)


def rto_base(t: Tables) -> DataFrame:
    """Resolved orders with their return economics; the filter runs before every join."""
    o = resolved(t["fct_order"]).select(
        "order_id", "session_id", "customer_id", "order_date", "payment_method",
        "paid_via_switch", "order_value", "rto_flag", "rto_reason", "rto_reason_class",
        "product_id", "delivery_geography_id")
    e = t["fct_order_economics"].select("order_id", "rto_economic_cost", "rto_cash_loss",
                                        "contribution_margin", "counterfactual_cm_if_delivered")
    return (o.join(e, "order_id")
            .join(t["dim_product"].select("product_id", "category"), "product_id")
            .join(_geo(t, "geo_tier"), "delivery_geography_id")
            .drop("product_id", "delivery_geography_id"))


def _star(t: Tables, state: DataFrame, orders: DataFrame) -> DataFrame:
    s = t["fct_checkout_session"].select(
        "session_id", "session_start_ts", "cart_size", "cart_value", "device_type",
        "estimated_delivery_days", "address_completeness_score", "payment_attempt_count")
    c = t["customer_base"] if "customer_base" in _names(t) else t["dim_customer"]
    return (orders.join(s, "session_id").join(state, "session_id")
            .join(c.select("customer_id", "has_saved_prepaid_instrument", "age_bucket",
                           "acquisition_channel"), "customer_id")
            .join(t["dim_product"].select("product_id", "category", "list_price",
                                          "product_rating", "review_count", "is_returnable"),
                  "product_id")
            .join(t["dim_seller"].select("seller_id", "seller_rating", "seller_rating_count",
                                         "seller_sla_breach_rate"), "seller_id")
            .join(t["dim_geography"].select(
                F.col("geography_id").alias("delivery_geography_id"), "geo_tier",
                "serviceability_score", "courier_reliability_score", "cod_cultural_index"),
                "delivery_geography_id")
            .join(t["dim_date"].select(F.col("date_id").alias("order_date"), "day_of_week",
                                       "is_month_end_window"), "order_date"))


def _names(t: Tables) -> set[str]:
    try:
        t["customer_base"]
        return {"customer_base"}
    except KeyError:
        return set()


def risk_model_input(t: Tables) -> DataFrame:
    """The only permitted training source: safe columns of resolved orders."""
    state = t["fct_customer_state_at_session"].drop("customer_id")
    o = resolved(t["fct_order"]).select(
        "order_id", "session_id", "customer_id", "product_id", "seller_id",
        "delivery_geography_id", "order_date", "order_value", "discount_pct", "payment_method",
        "paid_via_switch", "rto_flag", "is_shipped")
    hour = F.hour("session_start_ts").cast("short").alias("hour_of_day")
    return _star(t, state, o).select(*[hour if c == "hour_of_day" else c for c in P.SAFE_COLUMNS])


def causal_population(t: Tables) -> DataFrame:
    """Model input plus ``is_cod``: one row per resolved order."""
    return risk_model_input(t).withColumn("is_cod", (F.col("payment_method") == "COD").cast("int"))


def hypothesis_population(t: Tables) -> DataFrame:
    """Every order with state, dimensions, outcome columns and its first-attempt delay."""
    state = t["fct_customer_state_at_session"].drop("customer_id")
    o = t["fct_order"].select(
        "order_id", "session_id", "customer_id", "product_id", "seller_id",
        "delivery_geography_id", "order_date", "order_value", "discount_pct", "payment_method",
        "paid_via_switch", "rto_flag", "is_delivered", "is_shipped", "is_censored",
        "delivery_delay_days", "rto_reason")
    return _star(t, state, o).join(first_attempt_delay(t), "order_id", "left")


def first_attempt_delay(t: Tables) -> DataFrame:
    return (t["fct_delivery_event"].where(F.col("attempt_number") == 1)
            .groupBy("order_id").agg(F.max("attempt_delay_days").alias("attempt_delay_days")))


def first_delayed_attempt(orders: DataFrame, attempts: DataFrame) -> DataFrame:
    """(order_id, attempt_number, attempt_delay_days): the first attempt with a delay of each order.

    A lateral join asks each order for one row of its own attempts; equal numbers go to the
    longest delay, an order without such an attempt keeps nulls. Spark turns it into a window
    over the attempts of an order and an equi-join.
    """
    own = attempts.where((F.col("order_id") == F.col("o.order_id").outer())
                         & F.col("attempt_delay_days").isNotNull())
    first = own.orderBy("attempt_number", F.desc("attempt_delay_days")).limit(1)
    return orders.select("order_id").alias("o").lateralJoin(
        first.select("attempt_number", "attempt_delay_days").alias("a"), how="left").select(
        "o.order_id", "a.attempt_number", "a.attempt_delay_days")


# ---- firewall ------------------------------------------------------------------------------
def assert_firewall(columns: Iterable[str], allowed: Iterable[str] = P.SAFE_COLUMNS,
                    blocked: Iterable[str] = P.BLOCKED_COLUMNS) -> None:
    """Schema-only leakage check: blocked columns first, then the whitelist, then Stage 4."""
    present = set(columns)
    for title, bad in (("hard-blocked columns present", present & set(blocked)),
                       ("columns outside the whitelist", present - set(allowed)),
                       ("post-dispatch columns present", present & set(P.STAGE4_BAR))):
        if bad:
            raise FirewallError(f"{title}: {sorted(bad)}")


def training_input(t: Tables) -> DataFrame:
    view = risk_model_input(t)
    assert_firewall(view.columns)
    return view


def drop_stage3(df: DataFrame) -> DataFrame:
    """The view as the pre-payment model may see it."""
    return df.drop(*P.STAGE3_M2_ONLY)


def column_stages(df: DataFrame) -> DataFrame:
    """``(column, stage, used_by, exclusion)`` for each column, joined with null counts."""
    from ..schemas import stage_of
    from ..sources.tables import _long
    counts = _long(df.agg(*[F.count(c).alias(c) for c in df.columns]), df.columns, "column",
                   "non_null")
    rows = [(c, stage_of(c), "M2" if c in P.STAGE3_M2_ONLY else "M1+M2",
             P.FEATURE_EXCLUSIONS.get(c)) for c in df.columns]
    about = df.sparkSession.createDataFrame(
        rows, "`column` string, stage int, used_by string, exclusion string")
    return counts.join(about, "column")


# ---- join guards ------------------------------------------------------------------------------
def unique_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *,
                one_to_one: bool = False) -> DataFrame:
    """Join after checking that ``on`` is unique on the right (and left)."""
    for side, name, needed in ((right, "right", True), (left, "left", one_to_one)):
        if needed and side.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name} side repeats its join key {on}")
    return left.join(right, on, how)


def null_audit(left: DataFrame, right: DataFrame, on: list[str], column: str) -> DataFrame:
    """Left join, then how many rows found no match on ``column``."""
    j = left.join(right.select(*on, column), on, "left")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNull())
                 .alias("unmatched"))


def with_m2_tier(df: DataFrame) -> DataFrame:
    return df.withColumn("order_risk_tier_rule_based",
                         rule_tier_m2("pit_risk_tier_rule_based", "payment_method"))
