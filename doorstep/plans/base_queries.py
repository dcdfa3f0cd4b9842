"""Metric library, views, point-in-time state, ledgers, costs, roll-ups, reasons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag, ratio
from ..operators import crosscheck, economics, events, funnel, pit, reasons, rollup, tiers, views
from ..schemas import columns, schema
from ..sources import tables as src
from ..sources.artefacts import fingerprint, manifest
from .registry import register
from .sql_twins import TWINS

for _name, _fn in funnel.QUERIES.items():
    register(_name, TWINS[_name])(_fn)


@register("q15_twin_check")
def twin_check(m):
    return crosscheck.compare_all(m)


register("delay_reachability", """
SELECT CASE WHEN coalesce(o.rto_flag, false) THEN 'returned' ELSE 'delivered' END AS arm,
       count(*) AS orders, count(o.delivery_delay_days) AS with_delay,
       count(d.ad) AS with_attempt_delay
FROM fct_order o LEFT JOIN (SELECT order_id, max(attempt_delay_days) AS ad
     FROM fct_delivery_event WHERE attempt_number = 1 GROUP BY order_id) AS d
  ON d.order_id = o.order_id
WHERE o.is_shipped AND NOT o.is_censored GROUP BY 1""")(funnel.delay_reachability)


# ---- views -------------------------------------------------------------------------------
register("view_funnel", """
SELECT session_id, customer_id, cast(date_id AS varchar) AS date_id, device_type, geo_tier,
       cart_size, estimated_delivery_days, address_completeness_score, checkout_started,
       address_completed, payment_page_reached, intended_payment_method, final_payment_method,
       switched_to_cod_after_failure, payment_attempt_count, checkout_abandoned, abandon_step,
       order_id IS NOT NULL AS converted
FROM fct_checkout_session JOIN dim_geography ON geography_id = delivery_geography_id
""")(views.funnel_view)

register("view_order_enriched", f"""
SELECT order_id, o.session_id, customer_id, cast(order_date AS varchar) AS order_date,
       payment_method, paid_via_switch, quantity, o.gmv, discount_pct, order_value, order_status,
       is_cancelled_preship, is_shipped, is_censored, cast(is_delivered AS int) AS is_delivered,
       cast(rto_flag AS int) AS rto_flag, rto_reason, rto_reason_class, delivery_attempts, actual_delivery_days, delivery_delay_days,
       cast(outcome_resolved_date AS varchar) AS outcome_resolved_date, category, weight_band,
       seller_tier, geo_tier, {', '.join(views.MARGIN_COLUMNS)}
FROM fct_order o JOIN fct_order_economics e USING (order_id)
JOIN dim_product p ON p.product_id = o.product_id
JOIN dim_seller s ON s.seller_id = o.seller_id
JOIN dim_geography g ON g.geography_id = o.delivery_geography_id""")(views.order_enriched)

register("view_rto_base", """
SELECT order_id, o.session_id, customer_id, cast(order_date AS varchar) AS order_date,
       payment_method, paid_via_switch, order_value, cast(rto_flag AS int) AS rto_flag, rto_reason,
       rto_reason_class, rto_economic_cost, rto_cash_loss, contribution_margin, counterfactual_cm_if_delivered,
       category, geo_tier
FROM fct_order o JOIN fct_order_economics e USING (order_id)
JOIN dim_product p ON p.product_id = o.product_id
JOIN dim_geography g ON g.geography_id = o.delivery_geography_id
WHERE is_shipped AND NOT is_censored""")(views.rto_base)

_MODEL_COLUMNS = {
    "session_id": "s.session_id", "customer_id": "s.customer_id",
    "session_start_ts": "strftime(s.session_start_ts, '%Y-%m-%d %H:%M:%S')",
    "hour_of_day": "hour(s.session_start_ts)", "order_value": "o.order_value",
    "delivery_geography_id": "o.delivery_geography_id",
    "estimated_delivery_days": "s.estimated_delivery_days", "payment_method": "o.payment_method",
    "paid_via_switch": "o.paid_via_switch", "rto_flag": "cast(o.rto_flag AS int)",
    "is_shipped": "o.is_shipped", "discount_pct": "o.discount_pct"}
MODEL_VIEW_SQL = f"""
SELECT {', '.join(f'{_MODEL_COLUMNS.get(c, c)} AS {c}' for c in P.SAFE_COLUMNS)}
FROM fct_order o JOIN fct_checkout_session s ON s.session_id = o.session_id
JOIN fct_customer_state_at_session st ON st.session_id = o.session_id
JOIN customer_base c ON c.customer_id = o.customer_id
JOIN dim_product p ON p.product_id = o.product_id
JOIN dim_seller sl ON sl.seller_id = o.seller_id
JOIN dim_geography g ON g.geography_id = o.delivery_geography_id
JOIN dim_date d ON d.date_id = o.order_date
WHERE o.is_shipped AND NOT o.is_censored"""
register("view_risk_model_input", MODEL_VIEW_SQL)(views.training_input)
register("column_stages")(lambda m: views.column_stages(views.risk_model_input(m)))


@register("economics_null_audit", """
SELECT count(*) AS rows, count(*) FILTER (WHERE e.order_id IS NULL) AS unmatched
FROM fct_order o LEFT JOIN fct_order_economics e ON e.order_id = o.order_id""")
def economics_null_audit(m):
    return views.null_audit(m["fct_order"], m["fct_order_economics"], ["order_id"],
                            "contribution_margin")


register("hypothesis_population", """
SELECT o.order_id, o.payment_method, o.is_shipped, o.is_censored, st.pit_orders_delivered,
       d.ad AS attempt_delay_days, o.delivery_delay_days
FROM fct_order o JOIN fct_customer_state_at_session st ON st.session_id = o.session_id
LEFT JOIN (SELECT order_id, max(attempt_delay_days) AS ad FROM fct_delivery_event
           WHERE attempt_number = 1 GROUP BY order_id) AS d ON d.order_id = o.order_id
""")(lambda m: views.hypothesis_population(m).select(
    "order_id", "payment_method", "is_shipped", "is_censored", "pit_orders_delivered",
    "attempt_delay_days", "delivery_delay_days"))

# ---- point in time, tiers, calendar ---------------------------------------------------------
register("pit_state", "SELECT * FROM fct_customer_state_at_session")(
    lambda m: m["fct_customer_state_at_session"])
register("pit_same_day_occurrence", """
SELECT session_id, customer_id, cast(date_id AS varchar) AS date_id,
       row_number() OVER (PARTITION BY date_id, customer_id
                          ORDER BY session_start_ts, session_id) AS occurrence
FROM fct_checkout_session""")(lambda m: pit.same_day_occurrence(m["fct_checkout_session"]))
register("calendar", """
SELECT cast(date_id AS varchar) AS date_id, day_index, day_of_week, is_weekend, day_of_month,
       is_month_end_window, is_salary_week FROM dim_date
""")(lambda m: m["dim_date"].drop("demand_index"))

register("rule_tier_m2", """
SELECT o.session_id, CASE least(2, CASE pit_risk_tier_rule_based WHEN 'HIGH' THEN 2
         WHEN 'MED' THEN 1 ELSE 0 END + CASE WHEN payment_method = 'COD' THEN 1 ELSE 0 END)
         WHEN 0 THEN 'LOW' WHEN 1 THEN 'MED' ELSE 'HIGH' END AS order_risk_tier_rule_based
FROM fct_order o JOIN fct_customer_state_at_session st ON st.session_id = o.session_id
""")(lambda m: views.with_m2_tier(
    m["fct_order"].select("session_id", "payment_method").join(
        m["fct_customer_state_at_session"].select("session_id", "pit_risk_tier_rule_based"),
        "session_id")).select("session_id", "order_risk_tier_rule_based"))

register("seller_tiers", """
SELECT seller_id, CASE WHEN seller_rating >= 4.5 AND seller_sla_breach_rate <= 0.06 THEN 'GOLD'
  WHEN seller_rating >= 4.0 AND seller_sla_breach_rate <= 0.12 THEN 'SILVER' ELSE 'BRONZE' END
  AS seller_tier FROM seller_base""")(lambda m: tiers.seller_tiers(m["seller_base"]))
register("tier_cluster_power", f"""
SELECT geo_tier, count(*) AS clusters, count(*) >= {P.MIN_CLUSTERS_PER_TIER} AS ok
FROM dim_geography GROUP BY geo_tier""")(lambda m: tiers.cluster_power(m["dim_geography"]))
register("category_price_spread", """
WITH g AS (SELECT category, cast(sum(list_price) AS double) / count(*) AS mean_price,
  cast(CASE category WHEN 'FASHION' THEN 850 WHEN 'BEAUTY' THEN 650 WHEN 'HOME_KITCHEN' THEN 1150
    WHEN 'MOBILE_ACC' THEN 550 WHEN 'ELECTRONICS' THEN 2900 ELSE 700 END AS double) AS declared
  FROM dim_product GROUP BY category)
SELECT category, mean_price, declared, round(mean_price / declared, 9) AS implied_scalar,
       round(mean_price / declared / avg(mean_price / declared) OVER () - 1, 9) AS relative_spread
FROM g""")(lambda m: tiers.category_scalars(m["dim_product"]))
register("address_tier_correlation", """
SELECT round(corr(cast(address_completeness_score AS double),
       CASE geo_tier WHEN 'METRO' THEN 0 WHEN 'TIER1' THEN 1 WHEN 'TIER2' THEN 2 ELSE 3 END), 8)
       AS correlation
FROM fct_checkout_session JOIN dim_geography ON geography_id = delivery_geography_id
""")(lambda m: tiers.address_tier_correlation(m))
register("censoring_by_week", """
WITH w AS (SELECT date_trunc('week', order_date) AS week_of, count(*) AS shipped,
  count(*) FILTER (WHERE is_censored) AS c, count(*) FILTER (WHERE rto_flag) AS r,
  count(rto_flag) AS n FROM fct_order WHERE is_shipped GROUP BY 1)
SELECT cast(cast(week_of AS date) AS varchar) AS week_of, shipped,
       cast(c AS double) / shipped * 100 AS censored_pct,
       CASE WHEN n > 0 THEN cast(r AS double) / n END AS rto_rate_of_resolved
FROM w ORDER BY week_of DESC LIMIT 8""")(lambda m: tiers.censoring_weeks(m["fct_order"]))
register("daily_censoring", """
SELECT cast(order_date AS varchar) AS order_date, count(*) AS orders,
       cast(count(*) FILTER (WHERE is_censored) AS double) / count(*) AS censored_share
FROM fct_order WHERE is_shipped GROUP BY order_date
""")(lambda m: tiers.daily_censoring(m["fct_order"]))

# ---- roll-ups ----------------------------------------------------------------------------
register("customer_rollup", """
SELECT customer_id, hist_orders_final, hist_rto_rate_final, hist_cod_share_final, clv_estimate,
       analytics_segment FROM dim_customer""")(lambda m: m["dim_customer"].select(
    "customer_id", "hist_orders_final", "hist_rto_rate_final", "hist_cod_share_final",
    "clv_estimate", "analytics_segment"))
register("segment_counts", """
SELECT analytics_segment, count(*) AS customers,
       cast(sum(clv_estimate) AS double) AS total_clv
FROM dim_customer GROUP BY analytics_segment""")(
    lambda m: m["dim_customer"].groupBy("analytics_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("clv_estimate").cast("double").alias("total_clv")))
register("mean_cod_intent_by_customer")(lambda m: rollup.mean_probability_by_customer(
    m["customer_base"], m["fct_checkout_session"], m["truth_order_probability"], "p_cod_intent"))

# ---- event projections -----------------------------------------------------------------------
register("checkout_events", """
SELECT session_id, event_seq, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, event_name,
       seconds_since_session_start FROM fct_checkout_event""")(
    lambda m: m["fct_checkout_event"].select(
        "session_id", "event_seq", "event_ts", "event_name", "seconds_since_session_start"))
register("checkout_method_detail", """
SELECT coalesce(final_payment_method, 'none') AS method, count(*) AS events
FROM fct_checkout_session WHERE payment_page_reached GROUP BY 1""")(
    lambda m: m["fct_checkout_event"].where("event_name = 'METHOD_SELECTED'").groupBy(
        F.coalesce(F.get_json_object("event_detail", "$.method"), F.lit("none")).alias("method"))
    .agg(F.count(F.lit(1)).alias("events")))
register("delivery_events", """
SELECT order_id, event_seq, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, event_name,
       attempt_number, attempt_delay_days, ndr_code, courier_partner FROM fct_delivery_event
""")(lambda m: m["fct_delivery_event"].drop("delivery_event_id"))
register("payment_attempts", """
WITH a AS (SELECT *, payment_attempt_count > 0 AND (payment_attempt_count > 1
    OR switched_to_cod_after_failure OR coalesce(abandon_step = 'PAYMENT_FAILURE', false)) AS f,
    coalesce(final_payment_method = 'PREPAID', false) AS paid FROM fct_checkout_session),
e AS (SELECT *, CASE WHEN switched_to_cod_after_failure THEN 'SWITCH_TO_COD' ELSE 'ABANDON' END
    AS fin FROM a)
SELECT session_id, 1 AS attempt_seq,
       strftime(session_start_ts + 45 * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS attempt_ts,
       cart_value AS attempt_amount, NOT f AS payment_success, false AS is_retry,
       CASE WHEN f THEN CASE WHEN payment_attempt_count > 1 THEN 'RETRY_SAME' ELSE fin END END
         AS post_failure_action
FROM e WHERE payment_attempt_count > 0
UNION ALL
SELECT session_id, 2, strftime(session_start_ts + 120 * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S'),
       cart_value, paid, true, CASE WHEN NOT paid THEN fin END
FROM e WHERE f AND payment_attempt_count > 1""")(lambda m: m["fct_payment_attempt"].select(
    "session_id", "attempt_seq", "attempt_ts", "attempt_amount", "payment_success", "is_retry",
    "post_failure_action"))
register("funnel_from_events", """
SELECT session_id, address_completed, payment_page_reached, payment_attempt_count > 0
         AS payment_attempted, switched_to_cod_after_failure, checkout_abandoned,
       final_payment_method, abandon_step
FROM fct_checkout_session""")(lambda m: events.funnel_from_events(
    m["fct_checkout_event"]).drop("events"))
register("resolved_funnel", """
SELECT session_id, address_completed, payment_page_reached, intended_payment_method,
       final_payment_method, switched_to_cod_after_failure, payment_attempt_count,
       checkout_abandoned, abandon_step FROM fct_checkout_session""")(
    lambda m: events.resolve_funnel(m["session_activity"].select(
        "session_id", F.col("address_completed").alias("cleared_address"),
        F.col("payment_page_reached").alias("reached_payment"),
        F.coalesce(F.col("intended_payment_method") == "COD", F.lit(False)).alias("cod_intent"),
        F.coalesce(F.col("final_payment_method") == "PREPAID", F.lit(False))
        .alias("pay_succeeded"),
        F.col("switched_to_cod_after_failure").alias("pay_switched"), "pay_abandoned",
        F.col("payment_attempt_count").alias("attempt_count"),
        F.col("attempted_rail").alias("rail"))).drop("payment_rail"))
register("fee_reveal_steps", """
SELECT session_id, CASE WHEN abandon_step = 'PAYMENT_PAGE' AND cart_size <= 2 AND
       estimated_delivery_days <= 4 THEN 'FEE_REVEAL' ELSE abandon_step END AS abandon_step
FROM fct_checkout_session""")(lambda m: _fee_reveal(m))


def _fee_reveal(m):
    """The fee branch under a positive fee: it fires when it outweighs the other terms."""
    terms = {"shipping_fee_charged_gt0": F.lit(-0.45),
             "cart_size_ge3": F.when(F.col("cart_size") >= 3, F.lit(-0.90)).otherwise(F.lit(0.0)),
             "est_delivery_days": F.when(F.col("estimated_delivery_days") > 4, F.lit(-0.60))
             .otherwise(F.lit(0.0))}
    a = m["session_activity"]
    fee = events.fee_is_dominant(terms, "shipping_fee_charged_gt0", 40.0)
    hurdles = a.select(
        "session_id", F.col("address_completed").alias("cleared_address"), "cart_size",
        "estimated_delivery_days", F.col("payment_page_reached").alias("reached_payment"),
        F.coalesce(F.col("intended_payment_method") == "COD", F.lit(False)).alias("cod_intent"),
        F.coalesce(F.col("final_payment_method") == "PREPAID", F.lit(False))
        .alias("pay_succeeded"), F.col("switched_to_cod_after_failure").alias("pay_switched"),
        "pay_abandoned", F.col("payment_attempt_count").alias("attempt_count"),
        F.col("attempted_rail").alias("rail"))
    return events.resolve_funnel(hurdles, fee).select("session_id", "abandon_step")


register("order_status_projection", """
SELECT order_id, cast(promised_delivery_date AS varchar) AS promised_delivery_date, order_status,
       cast(rto_flag AS int) AS rto_flag, cast(is_delivered AS int) AS is_delivered, actual_delivery_days, delivery_delay_days,
       cast(outcome_resolved_date AS varchar) AS outcome_resolved_date FROM fct_order
""")(lambda m: events.order_status(m["fct_order"].select(
    "order_id", "order_date", "estimated_delivery_days", "is_shipped", "is_censored",
    F.col("is_cancelled_preship").alias("is_cancelled"), flag("rto_flag").alias("returned"),
    F.col("actual_delivery_days").alias("days_to_resolve"))))

# ---- costs --------------------------------------------------------------------------------
register("order_economics", f"""
SELECT {', '.join(columns('fct_order_economics'))} FROM fct_order_economics
""")(lambda m: m["fct_order_economics"])
register("ndr_base", """
SELECT count(*) FILTER (WHERE rto_flag) AS rto_orders,
       avg(coalesce(delivery_attempts, 1)) FILTER (WHERE rto_flag) AS mean_attempts,
       18.0 - 3 * avg(coalesce(delivery_attempts, 1)) FILTER (WHERE rto_flag) AS ndr_base
FROM fct_order""")(lambda m: economics.ndr_base(m["fct_order"]))
register("breakeven", """
WITH x AS (SELECT
  cast(sum(contribution_margin) FILTER (WHERE is_delivered) AS double)
    / count(*) FILTER (WHERE is_delivered) AS d,
  cast(sum(rto_cash_loss) FILTER (WHERE rto_flag) AS double)
    / count(*) FILTER (WHERE rto_flag) AS c,
  cast(sum(rto_economic_cost) FILTER (WHERE rto_flag) AS double)
    / count(*) FILTER (WHERE rto_flag) AS e
  FROM fct_order JOIN fct_order_economics USING (order_id) WHERE payment_method = 'COD')
SELECT d AS cod_delivered_cm, -c AS cod_rto_cash_loss, -e AS cod_rto_economic_cost,
       d / (d + c) AS breakeven_rto_probability FROM x""")(
    lambda m: economics.breakeven(m["fct_order"], m["fct_order_economics"]))
register("annualised_exposure", f"""
WITH x AS (SELECT count(*) AS orders,
  count(*) FILTER (WHERE NOT is_cancelled_preship AND NOT is_censored) AS resolved,
  cast(sum(rto_economic_cost) FILTER (WHERE rto_flag) AS double) AS cost
  FROM fct_order JOIN fct_order_economics USING (order_id))
SELECT orders, resolved, orders - resolved AS excluded,
       cost / resolved * {P.POPULATION_ANNUAL_ORDERS} / 1e7 AS exposure_cr FROM x""")(
    lambda m: economics.annualised_exposure(m["fct_order"], m["fct_order_economics"]))
register("prepaid_economics", """
SELECT cast(count(*) FILTER (WHERE rto_flag) AS double) / count(*) AS prepaid_rto_rate,
  cast(sum(contribution_margin) FILTER (WHERE NOT rto_flag) AS double)
    / count(*) FILTER (WHERE NOT rto_flag) AS cm_delivered,
  cast(sum(contribution_margin) FILTER (WHERE rto_flag) AS double)
    / count(*) FILTER (WHERE rto_flag) AS cm_rto
FROM fct_order JOIN fct_order_economics USING (order_id)
WHERE payment_method = 'PREPAID' AND is_shipped AND NOT is_censored""")(
    lambda m: economics.prepaid_economics(m["fct_order"], m["fct_order_economics"]))

# ---- reasons ---------------------------------------------------------------------------------
register("reason_codes", """
SELECT o.order_id, o.rto_reason, o.rto_reason_class, f.ndr_code
FROM fct_order o JOIN order_fulfilment f ON f.order_id = o.order_id WHERE o.rto_flag
""")(lambda m: reasons.reason_codes(m["fct_order"]))
register("reason_drivers")(lambda m: reasons.reason_drivers(m))
register("reason_posterior")(lambda m: reasons.reason_posterior(reasons.reason_drivers(m)))
register("reason_posterior_means")(lambda m: reasons.posterior_means(
    reasons.reason_posterior(reasons.reason_drivers(m))))

# ---- distributions and small analytics ------------------------------------------------------------
register("cod_share_by_history", f"""
WITH c AS (SELECT customer_id, count(*) AS n,
  count(*) FILTER (WHERE payment_method = 'COD') AS k FROM fct_order GROUP BY customer_id)
SELECT least(n, 20) AS orders_placed, count(*) AS customers, cast(sum(k) AS bigint) AS cod_orders,
       cast(sum(k) AS double) / sum(n) AS cod_share FROM c GROUP BY 1""")(
    lambda m: m["fct_order"].groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("payment_method") == "COD").alias("k"))
    .groupBy(F.least("n", F.lit(20)).alias("orders_placed")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("k").alias("cod_orders"),
        ratio(F.sum("k"), F.sum("n")).alias("cod_share")))
register("top_reasons_per_tier", """
WITH g AS (SELECT geo_tier, rto_reason, count(*) AS orders
  FROM fct_order JOIN dim_geography ON geography_id = delivery_geography_id
  WHERE rto_flag GROUP BY 1, 2)
SELECT geo_tier, rto_reason, orders, place FROM (SELECT *, row_number() OVER (
  PARTITION BY geo_tier ORDER BY orders DESC, rto_reason) AS place FROM g) AS r WHERE place <= 3
""")(lambda m: views.rto_base(m).where(flag("rto_flag")).groupBy("geo_tier", "rto_reason").agg(
    F.count(F.lit(1)).alias("orders")).withColumn("place", F.row_number().over(
        Window.partitionBy("geo_tier").orderBy(F.desc("orders"), "rto_reason")))
    .where("place <= 3"))
register("order_value_describe", """
WITH n AS (SELECT count(*) AS n, round(avg(cast(order_value AS double)), 6) AS mean,
  round(stddev_samp(cast(order_value AS double)), 6) AS std, min(order_value) AS min,
  max(order_value) AS max FROM fct_order)
SELECT payment_method, count(*) AS n, round(avg(cast(order_value AS double)), 6) AS mean,
  round(stddev_samp(cast(order_value AS double)), 6) AS std, min(order_value) AS min,
  round(quantile_cont(cast(order_value AS double), 0.25), 6) AS p25,
  round(quantile_cont(cast(order_value AS double), 0.5), 6) AS p50,
  round(quantile_cont(cast(order_value AS double), 0.75), 6) AS p75, max(order_value) AS max
FROM fct_order GROUP BY payment_method""")(
    lambda m: tiers.describe(m["fct_order"], "order_value", ["payment_method"]))

# ---- load checks -------------------------------------------------------------------------------
register("preflight_fct_order")(lambda m: src.preflight(m["fct_order"], "fct_order"))
register("conform_report_fct_order")(
    lambda m: src.conform_report(m["fct_order"], schema("fct_order")))
register("partial_trace_columns")(
    lambda m: src.partial_columns(m["truth_order_probability"], "truth_order_probability"))
register("order_fingerprint")(lambda m: fingerprint(m["fct_order"]))
register("manifest")(lambda m: manifest(dict(m)))
register("json_value_stats", """
SELECT event_type, count(*) AS events, cast(sum(cast(json_extract_string(props, '$.k') AS int))
       AS bigint) AS total_k FROM events GROUP BY event_type""")(
    lambda m: m["events"].withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    .groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("total_k")))

