"""The metric library again as ANSI SQL over the canonical tables.

These texts run unchanged in Spark SQL (twin check of the DataFrame API) and, behind the
canonical table expressions, in DuckDB (oracle).
"""

from __future__ import annotations

from .. import params as P

_BASE = """
base AS (
  SELECT o.order_id, o.session_id, o.payment_method, o.order_value, o.rto_flag, o.rto_reason,
         o.rto_reason_class, g.geo_tier, e.contribution_margin, e.rto_economic_cost,
         e.rto_cash_loss
  FROM fct_order o
  JOIN fct_order_economics e ON e.order_id = o.order_id
  JOIN dim_geography g ON g.geography_id = o.delivery_geography_id
  WHERE o.is_shipped AND NOT o.is_censored
)"""

_CELLS = f"""{_BASE},
cells AS (
  SELECT CASE WHEN s.pit_orders_delivered = 0 THEN '0'
              WHEN s.pit_orders_delivered < 3 THEN '1-2'
              WHEN s.pit_orders_delivered < 6 THEN '3-5'
              WHEN s.pit_orders_delivered < 16 THEN '6-15' ELSE '16+' END AS tenure,
         b.geo_tier, sum(CASE WHEN payment_method = 'COD' THEN 1 ELSE 0 END) AS n_cod,
         sum(CASE WHEN payment_method = 'PREPAID' THEN 1 ELSE 0 END) AS n_prepaid,
         sum(CASE WHEN payment_method = 'COD' AND rto_flag THEN 1 ELSE 0 END) AS x_cod,
         sum(CASE WHEN payment_method = 'PREPAID' AND rto_flag THEN 1 ELSE 0 END) AS x_prepaid
  FROM base b JOIN fct_customer_state_at_session s ON s.session_id = b.session_id
  GROUP BY 1, 2
),
gaps AS (
  SELECT tenure, geo_tier, cast(n_cod AS bigint) AS n_cod, cast(n_prepaid AS bigint) AS n_prepaid,
         cast(x_cod AS double) / n_cod AS cod_rate,
         cast(x_prepaid AS double) / n_prepaid AS prepaid_rate,
         (cast(x_cod AS double) / n_cod - cast(x_prepaid AS double) / n_prepaid) * 100 AS gap_pp
  FROM cells WHERE n_cod >= {P.MIN_CELL_PER_ARM} AND n_prepaid >= {P.MIN_CELL_PER_ARM}
)"""

_FUNNEL = """
s AS (SELECT count(*) AS sessions, count(*) FILTER (WHERE address_completed) AS address,
             count(*) FILTER (WHERE payment_page_reached) AS page,
             count(*) FILTER (WHERE order_id IS NOT NULL) AS orders
      FROM fct_checkout_session),
o AS (SELECT count(*) FILTER (WHERE is_shipped) AS shipped,
             count(*) FILTER (WHERE is_delivered) AS delivered FROM fct_order),
steps AS (
  SELECT 1 AS step_no, 'sessions started' AS step, sessions AS n, sessions FROM s
  UNION ALL SELECT 2, 'address completed', address, sessions FROM s
  UNION ALL SELECT 3, 'payment page reached', page, sessions FROM s
  UNION ALL SELECT 4, 'orders placed', orders, sessions FROM s
  UNION ALL SELECT 5, 'shipped', (SELECT shipped FROM o), sessions FROM s
  UNION ALL SELECT 6, 'delivered', (SELECT delivered FROM o), sessions FROM s
)"""

TWINS: dict[str, str] = {
    "q1_funnel_steps": f"""WITH {_FUNNEL}
SELECT step_no, step, n, cast(n AS double) / sessions AS pct_of_sessions FROM steps""",
    "q1b_step_conversion": f"""WITH {_FUNNEL}
SELECT step_no, step, n, cast(n AS double) / sessions AS pct_of_sessions,
       cast(n AS double) / lag(n) OVER (ORDER BY step_no) AS step_conversion FROM steps""",
    "q2_conversions": """WITH
s AS (SELECT count(*) AS sessions FROM fct_checkout_session),
o AS (SELECT count(*) AS orders, count(*) FILTER (WHERE is_delivered) AS delivered,
             count(*) FILTER (WHERE is_shipped AND NOT is_censored) AS resolved,
             count(*) FILTER (WHERE rto_flag) AS rto,
             count(*) FILTER (WHERE is_censored) AS censored FROM fct_order),
e AS (SELECT cast(sum(contribution_margin) AS double) AS cm,
             cast(sum(contribution_margin) FILTER (WHERE is_delivered) AS double) AS cm_del,
             cast(sum(rto_economic_cost) FILTER (WHERE rto_flag) AS double) AS cost
      FROM fct_order_economics JOIN fct_order USING (order_id))
SELECT sessions, orders, cast(orders AS double) / sessions AS checkout_conversion,
       cast(delivered AS double) / sessions AS net_conversion,
       cast(orders - delivered AS double) / sessions AS conversion_leak,
       censored AS censored_excluded, cm / sessions AS cm_per_session_started,
       cm_del / delivered AS cm_per_delivered_order, cost / sessions AS rto_drag_per_session,
       cast(orders AS double) / sessions * (cast(resolved - rto AS double) / resolved)
         AS net_conversion_resolved_basis
FROM s JOIN o ON true JOIN e ON true""",
    "q3_abandon_steps": """WITH g AS (
  SELECT abandon_step, count(*) AS sessions FROM fct_checkout_session GROUP BY abandon_step),
tot AS (SELECT sum(sessions) AS n,
               sum(CASE WHEN abandon_step IS NOT NULL THEN sessions END) AS lost FROM g)
SELECT coalesce(abandon_step, 'CONVERTED') AS step, sessions,
       cast(sessions AS double) / n AS pct_of_sessions,
       CASE WHEN abandon_step IS NOT NULL THEN cast(sessions AS double) / lost END
         AS pct_of_abandons
FROM g JOIN tot ON true""",
    "q4_payment_success": """
SELECT attempting AS sessions_attempting_prepaid, total_attempts, prepaid AS prepaid_orders,
       cast(prepaid AS double) / nullif(attempting, 0) AS prepaid_success_rate,
       switched AS switched_to_cod, cast(switched AS double) / nullif(cod, 0)
         AS pct_of_cod_from_failure, at_failure AS abandoned_at_failure
FROM (SELECT count(*) FILTER (WHERE payment_attempt_count > 0) AS attempting,
             cast(sum(payment_attempt_count) AS bigint) AS total_attempts,
             count(*) FILTER (WHERE final_payment_method = 'PREPAID') AS prepaid,
             count(*) FILTER (WHERE final_payment_method = 'COD') AS cod,
             count(*) FILTER (WHERE switched_to_cod_after_failure) AS switched,
             count(*) FILTER (WHERE abandon_step = 'PAYMENT_FAILURE') AS at_failure
      FROM fct_checkout_session) AS x""",
    "q5_rto_by_method": f"""WITH {_BASE},
n AS (SELECT count(*) AS resolved FROM base),
m AS (SELECT payment_method, count(*) AS resolved_orders,
             count(*) FILTER (WHERE rto_flag) AS rto_orders,
             cast(sum(rto_economic_cost) FILTER (WHERE rto_flag) AS double) AS cost,
             cast(sum(rto_cash_loss) FILTER (WHERE rto_flag) AS double) AS cash
      FROM base GROUP BY payment_method)
SELECT payment_method, resolved_orders, cast(resolved_orders AS double) / resolved
         AS share_of_resolved, rto_orders,
       cast(rto_orders AS double) / resolved_orders AS rto_rate,
       cost / nullif(rto_orders, 0) AS economic_cost_per_rto,
       cash / nullif(rto_orders, 0) AS cash_loss_per_rto,
       cost / resolved * {P.POPULATION_ANNUAL_ORDERS} / 1e7 AS annual_exposure_cr
FROM m JOIN n ON true""",
    "q6_annualisation_factor": f"""
SELECT n AS sample_orders, {P.POPULATION_ANNUAL_ORDERS} AS population_annual_orders,
       cast({P.POPULATION_ANNUAL_ORDERS} AS double) / n AS annualisation_factor_derived,
       {P.STATED_ANNUAL_FACTOR} AS stated_factor,
       cast({P.POPULATION_ANNUAL_ORDERS} AS double) / n - {P.STATED_ANNUAL_FACTOR} AS difference
FROM (SELECT count(*) AS n FROM fct_order) AS x""",
    "q7_avoidability": f"""WITH {_BASE},
g AS (SELECT rto_reason_class, count(*) AS rto_orders,
             cast(sum(rto_economic_cost) AS double) AS total_cost
      FROM base WHERE rto_flag GROUP BY rto_reason_class)
SELECT rto_reason_class, rto_orders,
       cast(rto_orders AS double) / sum(rto_orders) OVER () AS share_of_rto_count, total_cost,
       total_cost / sum(total_cost) OVER () AS share_of_rto_cost,
       total_cost / rto_orders AS avg_cost_per_rto FROM g""",
    "q8_waterfall": f"""WITH {_BASE},
c AS (SELECT cast(count(*) AS double) AS resolved,
             cast(sum(rto_economic_cost) FILTER (WHERE rto_flag) AS double) AS total,
             cast(sum(rto_economic_cost) FILTER (WHERE rto_reason_class = 'ADDRESSABLE')
                  AS double) AS addr,
             cast(sum(rto_cash_loss) FILTER (WHERE rto_flag) AS double) AS cash FROM base),
a AS (SELECT total / resolved * {P.POPULATION_ANNUAL_ORDERS} / 1e7 AS x,
             addr / resolved * {P.POPULATION_ANNUAL_ORDERS} / 1e7 AS ad,
             cash / resolved * {P.POPULATION_ANNUAL_ORDERS} / 1e7 AS ca,
             addr / nullif(total, 0) AS share FROM c)
SELECT 1 AS step, 'annual exposure' AS line, x AS value_cr, cast(NULL AS double) AS pct FROM a
UNION ALL SELECT 2, 'cash out the door', ca, ca / x FROM a
UNION ALL SELECT 3, 'foregone contribution', x - ca, 1 - ca / x FROM a
UNION ALL SELECT 4, 'structurally unavoidable', ad - x, 1 - share FROM a
UNION ALL SELECT 5, 'addressable', ad, share FROM a
UNION ALL SELECT 6, 'assumed intervention efficacy', ad * cast({P.EFFICACY} AS double),
                 cast({P.EFFICACY} AS double) FROM a
UNION ALL SELECT 7, 'recoverable', ad * cast({P.EFFICACY} AS double), cast(NULL AS double)
          FROM a""",
    "q9_segment_breakeven": f"""WITH {_BASE},
g AS (SELECT geo_tier, payment_method, count(*) AS n, count(*) FILTER (WHERE rto_flag) AS r,
             cast(sum(contribution_margin) AS double) AS cm
      FROM base GROUP BY geo_tier, payment_method)
SELECT geo_tier, payment_method, n AS resolved_orders, r AS rto_orders,
       cast(r AS double) / n AS rto_rate, cast({P.P_STAR} AS double) AS p_star,
       cast(r AS double) / n - cast({P.P_STAR} AS double) AS gap_to_breakeven,
       CASE WHEN cast(r AS double) / n > cast({P.P_STAR} AS double) THEN 'ABOVE p*'
            ELSE 'below p*' END AS verdict, cm / n AS mean_cm_per_order FROM g""",
    "q10_reason_shares": f"""WITH {_BASE},
g AS (SELECT rto_reason_class, rto_reason, count(*) AS orders,
             cast(sum(rto_economic_cost) AS double) AS total_cost,
             count(*) FILTER (WHERE payment_method = 'COD') AS cod_orders,
             cast(sum(order_value) AS double) AS value
      FROM base WHERE rto_flag GROUP BY rto_reason_class, rto_reason),
h AS (SELECT *, cast(orders AS double) / sum(orders) OVER () AS count_share,
             total_cost / sum(total_cost) OVER () AS cost_share FROM g)
SELECT rto_reason_class, rto_reason, orders, count_share, total_cost, cost_share,
       cost_share - count_share AS cost_minus_count, total_cost / orders AS avg_cost,
       cod_orders, value / orders AS avg_order_value FROM h""",
    "q11_method_crosstab": """
SELECT payment_method, count(*) AS resolved_orders,
       count(*) FILTER (WHERE rto_flag) AS rto_orders,
       cast(count(*) FILTER (WHERE rto_flag) AS double) / count(*) AS rto_rate
FROM fct_order WHERE is_shipped AND NOT is_censored GROUP BY payment_method""",
    "q12_stratified_cells": f"""WITH {_CELLS}
SELECT tenure, geo_tier, n_cod, n_prepaid, cod_rate, prepaid_rate, gap_pp FROM gaps""",
    "q13_standardised": f"""WITH {_CELLS}
SELECT count(*) AS cells_used, sum(gap_pp * n_cod) / sum(n_cod) AS att_cod_weighted,
       sum(gap_pp * (n_cod + n_prepaid)) / sum(n_cod + n_prepaid) AS ate_pooled_weighted,
       sum(gap_pp * n_prepaid) / sum(n_prepaid) AS atu_prepaid_weighted FROM gaps""",
    "q14_delay_reconciliation": """WITH d AS (
  SELECT o.delivery_delay_days AS d, o.actual_delivery_days AS a, e.attempt_delay_days AS f
  FROM fct_order o JOIN fct_delivery_event e
    ON e.order_id = o.order_id AND e.event_name = 'DELIVERED'
  WHERE o.is_delivered)
SELECT count(*) AS delivered_orders, count(f) AS with_attempt_delay,
       count(*) FILTER (WHERE f > d) AS violations,
       cast(count(*) FILTER (WHERE f > d) * 100 AS double) / count(*) AS violation_pct,
       max(f - d) AS worst_excess_days,
       count(*) FILTER (WHERE f > d AND a IN (4, 25)) AS violations_at_clip FROM d""",
}
