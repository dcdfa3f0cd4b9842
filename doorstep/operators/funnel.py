"""Funnel, conversion and return-economics metrics (Q1–Q14) in the DataFrame API.

Totals that every row needs come from the already aggregated rows, or from a one-row
scalar subquery; no cross join is involved.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag, ratio, tenure_bucket
from .views import resolved, rto_base

Tables = Mapping[str, DataFrame]


def _all() -> WindowSpec:
    """Every row of an already aggregated, handful-of-rows result."""
    return Window.partitionBy()


def _n(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def _money(cond: Column, col: str, name: str) -> Column:
    return F.sum(F.when(cond, F.col(col))).cast("double").alias(name)


def _method(m: str) -> Column:
    return F.coalesce(F.col("final_payment_method") == m, F.lit(False))


def _one(df: DataFrame, *aggs: Column) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery."""
    row = df.agg(*aggs)
    return row.select(F.struct(*row.columns).alias("s")).scalar()


def order_counts(t: Tables) -> DataFrame:
    return t["fct_order"].agg(
        F.count(F.lit(1)).alias("orders"), _n(F.col("is_shipped"), "shipped"),
        _n(flag("is_delivered"), "delivered"), _n(flag("rto_flag"), "rto"),
        _n(F.col("is_censored"), "censored"),
        _n(F.col("is_shipped") & ~F.col("is_censored"), "resolved"))


def funnel_steps(t: Tables) -> DataFrame:
    """Q1: started, address, payment page, orders, shipped, delivered on the session base."""
    one = t["fct_checkout_session"].agg(
        F.count(F.lit(1)).alias("sessions"), _n(F.col("address_completed"), "address"),
        _n(F.col("payment_page_reached"), "page"), _n(~F.col("checkout_abandoned"), "orders"))
    counts = order_counts(t)
    o = counts.select(F.struct("shipped", "delivered").alias("s")).scalar()
    one = one.withColumn("o", o)
    steps = (("sessions started", "sessions"), ("address completed", "address"),
             ("payment page reached", "page"), ("orders placed", "orders"),
             ("shipped", "o.shipped"), ("delivered", "o.delivered"))
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"),
                              F.col(c).alias("n")) for i, (name, c) in enumerate(steps, 1)])
    return one.select("sessions", F.inline(rows)).select(
        "step_no", "step", "n", ratio("n", "sessions").alias("pct_of_sessions"))


def step_conversion(t: Tables) -> DataFrame:
    """Q1b: each step over the step before it (six rows)."""
    return funnel_steps(t).withColumn("step_conversion",
                                      ratio("n", F.lag("n").over(Window.orderBy("step_no"))))


def conversions(t: Tables) -> DataFrame:
    """Q2: checkout against net conversion with the margin baseline."""
    e = t["fct_order_economics"].select("order_id", "contribution_margin", "rto_economic_cost")
    o = t["fct_order"].select("order_id", "is_delivered", "rto_flag", "is_shipped", "is_censored")
    base = o.join(e, "order_id").agg(
        F.count(F.lit(1)).alias("orders"), _n(flag("is_delivered"), "delivered"),
        _n(F.col("is_shipped") & ~F.col("is_censored"), "resolved"), _n(flag("rto_flag"), "rto"),
        _n(F.col("is_censored"), "censored"),
        F.sum("contribution_margin").cast("double").alias("cm"),
        _money(flag("is_delivered"), "contribution_margin", "cm_delivered"),
        _money(flag("rto_flag"), "rto_economic_cost", "rto_cost"))
    sessions = t["fct_checkout_session"].agg(F.count(F.lit(1)).alias("n")).scalar()
    b = base.withColumn("sessions", sessions)
    return b.select(
        "sessions", "orders", ratio("orders", "sessions").alias("checkout_conversion"),
        ratio("delivered", "sessions").alias("net_conversion"),
        ratio(F.col("orders") - F.col("delivered"), "sessions").alias("conversion_leak"),
        F.col("censored").alias("censored_excluded"),
        ratio("cm", "sessions").alias("cm_per_session_started"),
        ratio("cm_delivered", "delivered").alias("cm_per_delivered_order"),
        ratio("rto_cost", "sessions").alias("rto_drag_per_session"),
        (ratio("orders", "sessions") * ratio(F.col("resolved") - F.col("rto"), "resolved"))
        .alias("net_conversion_resolved_basis"))


def abandon_steps(t: Tables) -> DataFrame:
    """Q3: where sessions end; converted sessions have no share of the abandons."""
    g = t["fct_checkout_session"].groupBy("abandon_step").agg(F.count(F.lit(1)).alias("sessions"))
    lost = F.col("abandon_step").isNotNull()
    return g.select(
        F.coalesce("abandon_step", F.lit("CONVERTED")).alias("step"), "sessions",
        ratio("sessions", F.sum("sessions").over(_all())).alias("pct_of_sessions"),
        F.when(lost, ratio("sessions", F.sum(F.when(lost, F.col("sessions"))).over(_all())))
        .alias("pct_of_abandons"))


def payment_success(t: Tables) -> DataFrame:
    """Q4: prepaid reliability and the COD it creates."""
    return t["fct_checkout_session"].agg(
        _n(F.col("payment_attempt_count") > 0, "sessions_attempting_prepaid"),
        F.sum("payment_attempt_count").alias("total_attempts"),
        _n(_method("PREPAID"), "prepaid_orders"),
        ratio(F.count_if(_method("PREPAID")), F.count_if(F.col("payment_attempt_count") > 0))
        .alias("prepaid_success_rate"),
        _n(F.col("switched_to_cod_after_failure"), "switched_to_cod"),
        ratio(F.count_if(F.col("switched_to_cod_after_failure")), F.count_if(_method("COD")))
        .alias("pct_of_cod_from_failure"),
        _n(F.coalesce(F.col("abandon_step") == "PAYMENT_FAILURE", F.lit(False)),
           "abandoned_at_failure"))


def rto_by_method(t: Tables) -> DataFrame:
    """Q5: the return bill by payment method, annualised on resolved orders."""
    rto = flag("rto_flag")
    g = rto_base(t).groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("resolved_orders"), _n(rto, "rto_orders"),
        _money(rto, "rto_economic_cost", "cost"), _money(rto, "rto_cash_loss", "cash"))
    base = F.sum("resolved_orders").over(_all())
    return g.select(
        "payment_method", "resolved_orders", ratio("resolved_orders", base)
        .alias("share_of_resolved"), "rto_orders",
        ratio("rto_orders", "resolved_orders").alias("rto_rate"),
        ratio("cost", "rto_orders").alias("economic_cost_per_rto"),
        ratio("cash", "rto_orders").alias("cash_loss_per_rto"),
        (ratio("cost", base) * P.POPULATION_ANNUAL_ORDERS / 1e7).alias("annual_exposure_cr"))


def annualisation_factor(t: Tables) -> DataFrame:
    """Q6: derived, never assumed."""
    one = t["fct_order"].agg(F.count(F.lit(1)).alias("sample_orders"))
    factor = ratio(F.lit(P.POPULATION_ANNUAL_ORDERS), "sample_orders")
    return one.select(
        "sample_orders", F.lit(P.POPULATION_ANNUAL_ORDERS).alias("population_annual_orders"),
        factor.alias("annualisation_factor_derived"),
        F.lit(P.STATED_ANNUAL_FACTOR).alias("stated_factor"),
        (factor - P.STATED_ANNUAL_FACTOR).alias("difference"))


def avoidability(t: Tables) -> DataFrame:
    """Q7: addressable and structural returns by count and by cost."""
    g = rto_base(t).where(flag("rto_flag")).groupBy("rto_reason_class").agg(
        F.count(F.lit(1)).alias("rto_orders"),
        F.sum("rto_economic_cost").cast("double").alias("total_cost"))
    return g.select(
        "rto_reason_class", "rto_orders",
        ratio("rto_orders", F.sum("rto_orders").over(_all())).alias("share_of_rto_count"),
        "total_cost", ratio("total_cost", F.sum("total_cost").over(_all()))
        .alias("share_of_rto_cost"), ratio("total_cost", "rto_orders").alias("avg_cost_per_rto"))


def waterfall(t: Tables, efficacy: float = P.EFFICACY) -> DataFrame:
    """Q8: from annual exposure to the recoverable part, seven ordered lines."""
    rto = flag("rto_flag")
    one = rto_base(t).agg(
        F.count(F.lit(1)).alias("resolved"), _money(rto, "rto_economic_cost", "total"),
        _money(rto & (F.col("rto_reason_class") == "ADDRESSABLE"), "rto_economic_cost", "addr"),
        _money(rto, "rto_cash_loss", "cash"))
    annual = lambda c: ratio(c, "resolved") * P.POPULATION_ANNUAL_ORDERS / 1e7
    one = one.select(annual("total").alias("x"), annual("addr").alias("a"),
                     annual("cash").alias("c"), ratio("addr", "total").alias("share"))
    x, a, c, share = (F.col(n) for n in ("x", "a", "c", "share"))
    none = F.lit(None).cast("double")
    lines = [("annual exposure", x, none), ("cash out the door", c, ratio(c, x)),
             ("foregone contribution", x - c, 1 - ratio(c, x)),
             ("structurally unavoidable", a - x, 1 - share), ("addressable", a, share),
             ("assumed intervention efficacy", a * efficacy, F.lit(efficacy)),
             ("recoverable", a * efficacy, none)]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("line"), v.alias("value_cr"),
                 p.alias("pct")) for i, (name, v, p) in enumerate(lines, 1)])))


def segment_breakeven(t: Tables, p_star: float = P.P_STAR) -> DataFrame:
    """Q9: geography × method return rate against break-even."""
    rto = flag("rto_flag")
    g = rto_base(t).groupBy("geo_tier", "payment_method").agg(
        F.count(F.lit(1)).alias("resolved_orders"), _n(rto, "rto_orders"),
        F.sum("contribution_margin").cast("double").alias("cm"))
    rate = ratio("rto_orders", "resolved_orders")
    return g.select(
        "geo_tier", "payment_method", "resolved_orders", "rto_orders", rate.alias("rto_rate"),
        F.lit(p_star).alias("p_star"), (rate - p_star).alias("gap_to_breakeven"),
        F.when(rate > p_star, "ABOVE p*").otherwise("below p*").alias("verdict"),
        ratio("cm", "resolved_orders").alias("mean_cm_per_order"))


def reason_shares(t: Tables) -> DataFrame:
    """Q10: each reason's share of the count against its share of the cost."""
    g = rto_base(t).where(flag("rto_flag")).groupBy("rto_reason_class", "rto_reason").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("rto_economic_cost").cast("double").alias("total_cost"),
        _n(F.col("payment_method") == "COD", "cod_orders"),
        F.sum("order_value").cast("double").alias("value"))
    count_share = ratio("orders", F.sum("orders").over(_all()))
    cost_share = ratio("total_cost", F.sum("total_cost").over(_all()))
    g = g.withColumns({"count_share": count_share, "cost_share": cost_share})
    return g.select(
        "rto_reason_class", "rto_reason", "orders", "count_share", "total_cost", "cost_share",
        (F.col("cost_share") - F.col("count_share")).alias("cost_minus_count"),
        ratio("total_cost", "orders").alias("avg_cost"), "cod_orders",
        ratio("value", "orders").alias("avg_order_value"))


def method_crosstab(t: Tables) -> DataFrame:
    """Q11: raw return rate per method."""
    g = resolved(t["fct_order"]).groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("resolved_orders"), _n(flag("rto_flag"), "rto_orders"))
    return g.withColumn("rto_rate", ratio("rto_orders", "resolved_orders"))


def stratified_cells(t: Tables, minimum: int = P.MIN_CELL_PER_ARM) -> DataFrame:
    """Q12: tenure × geography cells with at least ``minimum`` orders in both arms."""
    state = t["fct_customer_state_at_session"].select("session_id", "pit_orders_delivered")
    base = resolved(t["fct_order"]).select("session_id", "payment_method", "rto_flag",
                                           "delivery_geography_id")
    geo = t["dim_geography"].select(F.col("geography_id").alias("delivery_geography_id"),
                                    "geo_tier")
    j = base.join(geo, "delivery_geography_id").join(state, "session_id")
    return two_arm_cells(
        j.withColumn("tenure", tenure_bucket("pit_orders_delivered")), ["tenure", "geo_tier"]
    ).where((F.col("n_cod") >= minimum) & (F.col("n_prepaid") >= minimum))


def two_arm_cells(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and return rates of both payment arms per cell, with the gap."""
    cod, rto = F.col("payment_method") == "COD", flag("rto_flag")
    g = df.groupBy(*by).agg(_n(cod, "n_cod"), _n(~cod, "n_prepaid"),
                            _n(cod & rto, "x_cod"), _n(~cod & rto, "x_prepaid"))
    g = g.withColumns({"cod_rate": ratio("x_cod", "n_cod"),
                       "prepaid_rate": ratio("x_prepaid", "n_prepaid")})
    return g.select(*by, "n_cod", "n_prepaid", "cod_rate", "prepaid_rate",
                    ((F.col("cod_rate") - F.col("prepaid_rate")) * 100).alias("gap_pp"))


def standardised(cells: DataFrame) -> DataFrame:
    """Q13: the cell gaps weighted to the treated, everyone, and the untreated."""
    w = lambda c: ratio(F.sum(F.col("gap_pp") * c), F.sum(c))
    cod, pre = F.col("n_cod"), F.col("n_prepaid")
    return cells.agg(F.count(F.lit(1)).alias("cells_used"), w(cod).alias("att_cod_weighted"),
                     w(cod + pre).alias("ate_pooled_weighted"),
                     w(pre).alias("atu_prepaid_weighted"))


def delay_reconciliation(t: Tables) -> DataFrame:
    """Q14: first-attempt delay may not exceed the delivery delay; where it does, is it a clip?"""
    o = t["fct_order"].where(flag("is_delivered")).select(
        "order_id", "delivery_delay_days", "actual_delivery_days")
    e = t["fct_delivery_event"].where(F.col("event_name") == "DELIVERED").select(
        "order_id", "attempt_delay_days")
    a, d = F.col("attempt_delay_days"), F.col("delivery_delay_days")
    bad = F.coalesce(a > d, F.lit(False))
    return o.join(e, "order_id").agg(
        F.count(F.lit(1)).alias("delivered_orders"), F.count(a).alias("with_attempt_delay"),
        _n(bad, "violations"), ratio(F.count_if(bad) * 100, F.count(F.lit(1)))
        .alias("violation_pct"), F.max(a.cast("int") - d.cast("int")).alias("worst_excess_days"),
        _n(bad & F.col("actual_delivery_days").isin(4, 25), "violations_at_clip"))


def delay_reachability(t: Tables) -> DataFrame:
    """Per outcome arm: orders with a delivery delay and with a first-attempt delay."""
    from .views import first_attempt_delay
    o = resolved(t["fct_order"]).select("order_id", "is_delivered", "rto_flag",
                                        "delivery_delay_days")
    j = o.join(first_attempt_delay(t), "order_id", "left")
    arm = F.when(flag("rto_flag"), "returned").otherwise("delivered").alias("arm")
    return j.groupBy(arm).agg(
        F.count(F.lit(1)).alias("orders"), F.count("delivery_delay_days").alias("with_delay"),
        F.count("attempt_delay_days").alias("with_attempt_delay"))


QUERIES = {
    "q1_funnel_steps": funnel_steps, "q1b_step_conversion": step_conversion,
    "q2_conversions": conversions, "q3_abandon_steps": abandon_steps,
    "q4_payment_success": payment_success, "q5_rto_by_method": rto_by_method,
    "q6_annualisation_factor": annualisation_factor, "q7_avoidability": avoidability,
    "q8_waterfall": waterfall, "q9_segment_breakeven": segment_breakeven,
    "q10_reason_shares": reason_shares, "q11_method_crosstab": method_crosstab,
    "q12_stratified_cells": stratified_cells,
    "q13_standardised": lambda t: standardised(stratified_cells(t)),
    "q14_delay_reconciliation": delay_reconciliation,
}
