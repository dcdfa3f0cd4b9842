"""DuckDB text of the canonical tables that Spark builds with operators.

The state table is counted by brute force (every earlier order of the customer), the
ledger tables are spelled out per path, so they check the Spark operators independently.
"""

from __future__ import annotations

from .. import params as P
from ..operators.economics import COST_LINES
from ..sources.driver_model import canonical_ctes


def half_even(num: str, den: str, digits: int) -> str:
    """Exact half-even rounding of an integer ratio, as DuckDB text."""
    scale = 10 ** digits
    q, r = f"(({num}) * {scale} // ({den}))", f"(({num}) * {scale} % ({den}))"
    return (f"(CASE WHEN ({den}) = 0 THEN NULL WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND "
            f"{q} % 2 = 1) THEN {q} + 1 ELSE {q} END) / {float(scale)}")


_ECON_LINES = f"""
  SELECT o.*, p.cogs_ratio, p.shrink_rate, p.weight_band,
         coalesce(o.is_delivered, false) AS del, coalesce(o.rto_flag, false) AS rto,
         o.payment_method = 'COD' AS cod, g.forward_freight_base,
         cast(CASE p.weight_band WHEN 'LIGHT' THEN 0.85 WHEN 'MEDIUM' THEN 1.00 ELSE 1.45 END
              AS decimal(3,2)) AS wf,
         cast(CASE p.weight_band WHEN 'LIGHT' THEN 9 WHEN 'MEDIUM' THEN 13 ELSE 21 END
              AS decimal(6,2)) AS pack,
         cast(CASE o.payment_rail WHEN 'UPI_INTENT' THEN 0.009 WHEN 'UPI_COLLECT' THEN 0.009
                   WHEN 'CARD' THEN 0.021 WHEN 'NETBANKING' THEN 0.016 WHEN 'WALLET' THEN 0.019
                   ELSE 0 END AS decimal(4,3)) AS fee_rate,
         cast(p.cogs_ratio * o.order_value AS decimal(14,5)) AS goods
  FROM fct_order o JOIN dim_product p ON p.product_id = o.product_id
  JOIN dim_geography g ON g.geography_id = o.delivery_geography_id"""

_ECON_ROUNDED = f"""
  SELECT order_id, is_cancelled_preship AS x, rto,
    CASE WHEN is_cancelled_preship THEN 0 ELSE gmv END AS gmv,
    CASE WHEN is_cancelled_preship THEN 0 ELSE gmv - order_value END AS discount_cost,
    cast(0 AS decimal(6,2)) AS shipping_fee_revenue, cast(0 AS decimal(6,2)) AS cod_fee_revenue,
    cast(CASE WHEN del THEN order_value ELSE 0 END AS decimal(10,2)) AS net_revenue,
    cast(CASE WHEN del THEN goods ELSE 0 END AS decimal(10,2)) AS cogs,
    cast(CASE WHEN is_cancelled_preship THEN 0 ELSE goods END AS decimal(10,2)) AS cogs_value,
    cast(CASE WHEN is_shipped THEN forward_freight_base * wf ELSE 0 END AS decimal(6,2))
      AS forward_shipping_cost,
    cast(CASE WHEN is_shipped THEN pack ELSE 0 END AS decimal(6,2)) AS packaging_cost,
    cast(CASE WHEN is_cancelled_preship THEN 0 ELSE fee_rate * order_value END AS decimal(6,2))
      AS payment_processing_fee,
    cast(CASE WHEN cod AND del THEN 0.015 * order_value + 8 ELSE 0 END AS decimal(6,2))
      AS cod_handling_cost,
    cast(CASE WHEN rto THEN 1.09 * forward_freight_base * wf ELSE 0 END AS decimal(6,2))
      AS reverse_shipping_cost,
    cast(CASE WHEN rto THEN 35 * wf ELSE 0 END AS decimal(6,2)) AS reverse_handling_cost,
    cast(CASE WHEN rto THEN shrink_rate * goods ELSE 0 END AS decimal(8,2)) AS shrink_cost,
    cast(CASE WHEN rto AND cod THEN 14 ELSE 0 END AS decimal(6,2)) AS cod_failed_attempt_cost,
    cast(CASE WHEN rto THEN goods * {P.WC_FACTOR} ELSE 0 END AS decimal(6,2))
      AS working_capital_cost,
    cast(CASE WHEN rto THEN 9 + 3 * delivery_attempts WHEN del THEN 2 ELSE 0 END AS decimal(6,2))
      AS support_ndr_cost,
    cast(CASE WHEN del THEN 10 ELSE 0 END AS decimal(6,2)) AS ops_allocation_cost,
    cast(CASE WHEN is_cancelled_preship THEN 0 ELSE order_value - goods
         - CASE WHEN is_shipped THEN forward_freight_base * wf + pack ELSE 0 END
         - fee_rate * order_value - CASE WHEN cod THEN 0.015 * order_value + 8 ELSE 0 END
         - 12 END AS decimal(10,2)) AS counterfactual_cm_if_delivered
  FROM econ_lines"""

_STATE = f"""
  SELECT session_id, customer_id, date_diff('day', signup_date, date_id) AS pit_tenure_days,
    placed AS pit_orders_placed, delivered AS pit_orders_delivered,
    resolved AS pit_orders_resolved, rto AS pit_rto_count,
    {half_even('rto', 'resolved', 4)} AS pit_rto_rate_raw,
    {half_even('100 * rto + 132', '100 * (resolved + 8)', 4)} AS pit_rto_rate_shrunk,
    cod AS pit_cod_orders, {half_even('cod', 'placed', 4)} AS pit_cod_share,
    succ AS pit_prepaid_success_count, fail AS pit_payment_failure_count,
    {half_even('fail', 'succ + fail', 4)} AS pit_payment_failure_rate,
    date_diff('day', last_day, date_id) AS pit_days_since_last_order,
    {half_even('cents', 'in_placed * 100', 2)} AS pit_avg_order_value,
    placed > 0 AS pit_has_history, delivered = 0 AS pit_is_new_customer,
    delivered >= 3 AND rto = 0 AS pit_has_clean_record,
    CASE WHEN {half_even('100 * rto + 132', '100 * (resolved + 8)', 4)} >= {P.HIGH_RTO_SHRUNK}
         THEN 'HIGH'
         WHEN {half_even('100 * rto + 132', '100 * (resolved + 8)', 4)} >= {P.MED_RTO_SHRUNK}
              OR delivered = 0 THEN 'MED' ELSE 'LOW' END AS pit_risk_tier_rule_based
  FROM (SELECT s.session_id, s.customer_id, s.date_id, c.signup_date,
               c.pre_window_orders + po.placed AS placed, po.placed AS in_placed, po.cents,
               c.pre_window_delivered + po.delivered AS delivered,
               c.pre_window_delivered + c.pre_window_rto_count + po.resolved AS resolved,
               c.pre_window_rto_count + po.rto AS rto, c.pre_window_cod_orders + po.cod AS cod,
               c.pre_window_prepaid_success + pp.succ AS succ,
               c.pre_window_payment_failures + pp.fail AS fail, po.last_day
        FROM fct_checkout_session s JOIN customer_base c ON c.customer_id = s.customer_id
        JOIN pit_orders po ON po.session_id = s.session_id
        JOIN pit_payments pp ON pp.session_id = s.session_id) AS z"""


def ctes() -> dict[str, str]:
    """Every canonical table as DuckDB text, in dependency order."""
    out = canonical_ctes()
    out["dim_date"] = """
      SELECT cast(d AS date) AS date_id, date_diff('day', c_start, cast(d AS date)) AS day_index,
             isodow(d) AS day_of_week, isodow(d) >= 6 AS is_weekend, day(d) AS day_of_month,
             day(d) >= 26 AS is_month_end_window, day(d) <= 7 AS is_salary_week
      FROM calendar_bounds, unnest(generate_series(c_start, c_end, INTERVAL 1 DAY)) AS u(d)"""
    out["econ_lines"] = _ECON_LINES
    out["econ_rounded"] = _ECON_ROUNDED
    out["econ_totals"] = f"""
      SELECT *, cast({' + '.join(COST_LINES)} AS decimal(10,2)) AS total_variable_cost
      FROM econ_rounded"""
    out["fct_order_economics"] = """
      SELECT * EXCLUDE (x, rto),
             cast(net_revenue - cogs - total_variable_cost AS decimal(10,2))
               AS contribution_margin,
             cast(CASE WHEN rto THEN -(net_revenue - cogs - total_variable_cost) ELSE 0 END
                  AS decimal(10,2)) AS rto_cash_loss,
             cast(CASE WHEN rto THEN counterfactual_cm_if_delivered ELSE 0 END
                  AS decimal(10,2)) AS foregone_cm,
             cast(CASE WHEN rto THEN counterfactual_cm_if_delivered
                       - (net_revenue - cogs - total_variable_cost) ELSE 0 END
                  AS decimal(10,2)) AS rto_economic_cost
      FROM econ_totals"""
    out["pit_orders"] = """
      SELECT s.session_id, count(*) FILTER (WHERE o.order_ts < s.session_start_ts) AS placed,
             count(*) FILTER (WHERE o.order_ts < s.session_start_ts
                              AND o.payment_method = 'COD') AS cod,
             coalesce(sum(cast(o.order_value * 100 AS bigint))
                      FILTER (WHERE o.order_ts < s.session_start_ts), 0)::bigint AS cents,
             max(o.order_date) FILTER (WHERE o.order_ts < s.session_start_ts) AS last_day,
             count(*) FILTER (WHERE o.outcome_resolved_date < s.date_id) AS resolved,
             count(*) FILTER (WHERE o.outcome_resolved_date < s.date_id AND o.rto_flag) AS rto,
             count(*) FILTER (WHERE o.outcome_resolved_date < s.date_id AND o.is_delivered)
               AS delivered
      FROM fct_checkout_session s LEFT JOIN fct_order o ON o.customer_id = s.customer_id
      GROUP BY s.session_id"""
    out["pit_payments"] = """
      SELECT s.session_id, count(*) FILTER (WHERE p.final_payment_method = 'PREPAID') AS succ,
             count(*) FILTER (WHERE p.payment_attempt_count > 0 AND (p.payment_attempt_count > 1
               OR p.switched_to_cod_after_failure
               OR coalesce(p.abandon_step = 'PAYMENT_FAILURE', false))) AS fail
      FROM fct_checkout_session s
      LEFT JOIN fct_checkout_session p ON p.customer_id = s.customer_id
        AND p.session_start_ts < s.session_start_ts
      GROUP BY s.session_id"""
    out["fct_customer_state_at_session"] = _STATE
    out["delivery_steps"] = """
      SELECT o.order_id, o.order_ts, f.courier_partner, f.ndr_code, f.attempt_delay_days AS dl,
             f.dispatch_lag_days AS lag, o.actual_delivery_days AS days,
             o.estimated_delivery_days + f.attempt_delay_days AS first_try,
             o.is_cancelled_preship AS c, o.is_shipped AS s,
             coalesce(o.is_delivered, false) AS d, coalesce(o.rto_flag, false) AS r
      FROM fct_order o JOIN order_fulfilment f ON f.order_id = o.order_id"""
    part = ("SELECT order_id, order_ts, courier_partner, {rank} AS rank, '{name}' AS event_name, "
            "{day} AS day, {attempt} AS attempt_number, {delay} AS attempt_delay_days, "
            "{ndr} AS ndr_code FROM delivery_steps WHERE {when}")
    step = lambda rank, name, day, when, attempt="NULL", delay="NULL", ndr="NULL": part.format(
        rank=rank, name=name, day=day, when=when, attempt=attempt, delay=delay, ndr=ndr)
    out["delivery_rows"] = " UNION ALL ".join([
        step(0, "ORDER_PLACED", "0", "true"),
        step(1, "CANCELLED_PRESHIP", "least(lag, 1)", "c"), step(2, "DISPATCHED", "lag", "s"),
        step(3, "DELIVERED", "days", "d", "1", "dl"),
        *[step(3 + n, "DELIVERY_ATTEMPT_FAILED", f"first_try + {2 * (n - 1)}", "r", str(n), "dl",
               "ndr_code") for n in (1, 2, 3)],
        step(7, "RTO_INITIATED", "first_try + 6", "r"), step(8, "RTO_RECEIVED", "days", "r")])
    out["fct_delivery_event"] = """
      SELECT order_id, row_number() OVER (PARTITION BY order_id ORDER BY day, rank) AS event_seq,
             order_ts + day * INTERVAL 1 DAY AS event_ts, event_name, attempt_number,
             attempt_delay_days, ndr_code, courier_partner FROM delivery_rows"""
    offsets = [("CHECKOUT_STARTED", 0, "true"), ("ADDRESS_COMPLETED", 30, "address_completed"),
               ("PAYMENT_PAGE_REACHED", 60, "payment_page_reached"),
               ("FEE_DISPLAYED", 65, "payment_page_reached"),
               ("METHOD_SELECTED", 75, "payment_page_reached"),
               ("PAYMENT_ATTEMPTED", 105, "payment_attempt_count > 0"),
               ("METHOD_SWITCHED", 150, "switched_to_cod_after_failure"),
               ("ORDER_PLACED", 180, "NOT checkout_abandoned"),
               ("ABANDONED", 200, "checkout_abandoned")]
    out["checkout_rows"] = " UNION ALL ".join(
        f"SELECT session_id, session_start_ts, '{n}' AS event_name, {s} AS secs "
        f"FROM fct_checkout_session WHERE {w}" for n, s, w in offsets)
    out["fct_checkout_event"] = """
      SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY secs) AS event_seq,
             session_start_ts + secs * INTERVAL 1 SECOND AS event_ts, event_name,
             secs AS seconds_since_session_start FROM checkout_rows"""
    out["dim_customer"] = f"""
      SELECT customer_base.*, hist_orders_final, hist_rto_rate_final, hist_cod_share_final,
             clv_estimate,
             CASE WHEN tenure_days_at_window_start < 180 THEN 'NEW'
                  WHEN tenure_days_at_window_start < 540 THEN 'GROWING' ELSE 'ESTABLISHED' END
             || '_' || CASE WHEN hist_cod_share_final >= 0.8 THEN 'COD'
                            WHEN hist_cod_share_final >= 0.3 THEN 'MIXED' ELSE 'PREPAID' END
               AS analytics_segment
      FROM customer_base JOIN (
        SELECT c.customer_id, c.pre_window_orders + coalesce(t.n, 0) AS hist_orders_final,
          coalesce({half_even('c.pre_window_rto_count + coalesce(t.r, 0)',
                              'c.pre_window_delivered + c.pre_window_rto_count + coalesce(t.d, 0)',
                              3)}, 0) AS hist_rto_rate_final,
          coalesce({half_even('c.pre_window_cod_orders + coalesce(t.k, 0)',
                              'c.pre_window_orders + coalesce(t.n, 0)', 3)}, 0)
            AS hist_cod_share_final, coalesce(t.cm, 0) AS clv_estimate
        FROM customer_base c LEFT JOIN (
          SELECT customer_id, count(*) AS n, count(rto_flag) AS d,
                 count(*) FILTER (WHERE rto_flag) AS r,
                 count(*) FILTER (WHERE payment_method = 'COD') AS k,
                 sum(contribution_margin) AS cm
          FROM fct_order JOIN fct_order_economics USING (order_id) GROUP BY customer_id) AS t
        ON t.customer_id = c.customer_id) AS h USING (customer_id)"""
    return out


def with_ctes(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` behind every canonical table; a leading WITH of its own is folded in."""
    import re
    tables = {**ctes(), **(extra or {})}
    body = select.strip()
    own = ""
    if body.upper().startswith("WITH"):
        own, body = ", " + body[4:].strip(), ""
    needed, queue = set(), {t for t in tables if re.search(rf"\b{t}\b", own + body)}
    while queue:
        name = queue.pop()
        needed.add(name)
        queue |= {t for t in tables if t != name and t not in needed
                  and re.search(rf"\b{t}\b", tables[name])}
    head = ", ".join(f"{n} AS ({' '.join(tables[n].split())})"
                     for n in _ordered(tables, needed))
    return f"WITH {head}{own} {body}" if head else select


def _ordered(tables: dict[str, str], needed: set[str]) -> list[str]:
    import re
    done: list[str] = []
    left = [t for t in tables if t in needed]
    while left:
        ready = [t for t in left if not any(
            o != t and re.search(rf"\b{o}\b", tables[t]) for o in left)]
        done += ready
        left = [t for t in left if t not in ready]
        if not ready:
            raise ValueError(f"circular canonical tables {left}")
    return done
