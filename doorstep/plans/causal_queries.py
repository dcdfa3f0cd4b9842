"""Causal decomposition and hypothesis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, hypotheses as H, views
from ..session import cut, keep
from .registry import register


def population(m):
    """Resolved orders with every confounder; each fit reads it several times."""
    return keep(views.causal_population(m))


def orders_of(m, *columns):
    """All orders with state, dimensions and outcomes, for the hypotheses; of the columns, those named if any."""
    pop = views.hypothesis_population(m)
    return keep(pop.select(*columns) if columns else pop)


_RESOLVED = ("is_shipped", "is_censored", "rto_flag")
#: What the sixth hypothesis reads: the rest would travel through every join.
PROMISE = (*_RESOLVED, "geo_tier", "estimated_delivery_days")
DELAY = (*PROMISE, "serviceability_score", "attempt_delay_days")
#: What the review-count part of the fifth reads.
REVIEWS = (*PROMISE, "review_count", "product_rating", "seller_rating", "order_value",
           "address_completeness_score", "payment_method", "pit_rto_count", "category")


def _two(select: str, a: str, b: str, *, by: str = "", where: str = "") -> str:
    """Two-group comparison text over ``(in_a, y)`` rows."""
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""WITH z AS ({select}),
q AS (SELECT {key}count(*) FILTER (WHERE in_a) AS n_{a}, count(*) FILTER (WHERE NOT in_a) AS n_{b},
  avg(y) FILTER (WHERE in_a) AS {a}, avg(y) FILTER (WHERE NOT in_a) AS {b},
  var_samp(y) FILTER (WHERE in_a) AS va, var_samp(y) FILTER (WHERE NOT in_a) AS vb
  FROM z{group}),
r AS (SELECT *, {a} - {b} AS d, sqrt(va / n_{a} + vb / n_{b}) AS se FROM q)
SELECT {key}n_{a}, n_{b}, {a}, {b}, round(d * 100, 8) AS diff_pp,
  round((d - 1.96 * se) * 100, 8) AS ci_low_pp, round((d + 1.96 * se) * 100, 8) AS ci_high_pp
FROM r {where}"""


def _ci8(df):
    return df.withColumns({c: F.round(c, 8) for c in df.columns
                           if c in ("diff_pp", "ci_low_pp", "ci_high_pp", "ci_low", "ci_high")})


register("h1_raw_crosstab", _two(
    "SELECT payment_method = 'COD' AS in_a, cast(cast(rto_flag AS int) AS double) AS y "
    "FROM fct_order WHERE is_shipped AND NOT is_censored", "cod", "prepaid").replace(
    "n_cod, n_prepaid, cod, prepaid", "n_cod, n_prepaid, cod AS cod_rate, "
    "prepaid AS prepaid_rate"))(lambda m: _ci8(causal.raw_crosstab(
        views.resolved(m["fct_order"]).withColumn(
            "is_cod", (F.col("payment_method") == "COD").cast("int")))))


@register("h1_stratified")
def h1_stratified(m):
    return causal.stratified(population(m))


register("h1_logistic_adjusted")(lambda m: causal.logistic_adjusted(population(m)))
register("h1_propensity_matched")(lambda m: causal.propensity_matched(population(m)))
register("h1_suspect_ablation")(lambda m: causal.ablate_suspect(population(m)))
register("h1_confounder_contributions")(lambda m: causal.confounder_contributions(population(m)))
register("h1_latent_reconstructibility")(lambda m: causal.latent_reconstructibility(
    population(m), m["truth_customer_latent"]))
register("gt_coefficient_recovery")(lambda m: causal.recovery_table(population(m)))
register("gt_recovery_summary")(lambda m: causal.recovery_summary(
    cut(causal.recovery_table(population(m)))))

# ---- matching over a score SQL can reproduce ------------------------------------------------
_MATCH = """
SELECT session_id AS k, payment_method = 'COD' AS treated,
  cast((cast(substr(order_id, 5) AS bigint) * 7919) % 100003 AS double) / 1000 AS x,
  cast(cast(rto_flag AS int) AS double) AS y
FROM fct_order WHERE is_shipped AND NOT is_censored"""


def _match_frame(m):
    key = F.substring("order_id", 5, 20).cast("long")
    return views.resolved(m["fct_order"]).select(
        F.col("session_id").alias("k"), (F.col("payment_method") == "COD").cast("int")
        .alias("treated"), (((key * 7919) % 100003).cast("double") / 1000).alias("x"),
        F.col("rto_flag").cast("int").cast("double").alias("y"))


@register("caliper_match_pairs", f"""WITH f AS ({_MATCH}),
c AS (SELECT * FROM f WHERE NOT treated), t AS (SELECT * FROM f WHERE treated),
cd AS (SELECT x, min(k) AS kmin, max(k) AS kmax FROM c GROUP BY x),
lo AS (SELECT t.k, cd.x, cd.kmax AS ck FROM t ASOF JOIN cd ON t.x > cd.x),
hi AS (SELECT t.k, cd.x, cd.kmin AS ck FROM t ASOF JOIN cd ON t.x <= cd.x),
j AS (SELECT t.k, t.y, t.x, lo.x AS lx, lo.ck AS lk, hi.x AS hx, hi.ck AS hk
  FROM t LEFT JOIN lo ON lo.k = t.k LEFT JOIN hi ON hi.k = t.k),
b AS (SELECT k, y, CASE WHEN lx IS NOT NULL AND (hx IS NULL OR x - lx <= hx - x) THEN lk
    ELSE hk END AS ck, CASE WHEN lx IS NOT NULL AND (hx IS NULL OR x - lx <= hx - x)
    THEN x - lx ELSE hx - x END AS d FROM j)
SELECT b.k AS treated_key, b.y AS treated_outcome, CASE WHEN d <= 0.002 THEN ck END
  AS control_key, CASE WHEN d <= 0.002 THEN c.y END AS control_outcome,
  round(CASE WHEN d <= 0.002 THEN d END, 9) AS distance
FROM b LEFT JOIN c ON c.k = b.ck""")
def caliper_match_pairs(m):
    from ..operators.matching import nearest_controls
    pairs = nearest_controls(_match_frame(m), score="x", treated="treated", key="k", outcome="y",
                             caliper_width=0.002)
    return pairs.withColumn("distance", F.round("distance", 9))


@register("caliper_match_effect")
def caliper_match_effect(m):
    from ..operators.matching import matched_effect, nearest_controls
    return matched_effect(nearest_controls(
        _match_frame(m), score="x", treated="treated", key="k", outcome="y",
        caliper_width=0.002))


# ---- hypotheses --------------------------------------------------------------------------
_POP = """fct_order o JOIN fct_customer_state_at_session st ON st.session_id = o.session_id
  JOIN dim_geography g ON g.geography_id = o.delivery_geography_id"""
_NEW = (f"SELECT pit_is_new_customer AS in_a, geo_tier, CASE WHEN payment_method = 'COD' "
        f"THEN 1.0::double ELSE 0.0::double END AS y FROM {_POP}")
register("h2_new_customer_cod", _two(_NEW, "cod_share_new", "cod_share_established"))(
    lambda m: _ci8(H.new_customer_cod(orders_of(m))))
register("h2_cod_by_tenure", f"""WITH b AS (SELECT CASE WHEN pit_orders_delivered = 0 THEN '0'
    WHEN pit_orders_delivered < 3 THEN '1-2' WHEN pit_orders_delivered < 6 THEN '3-5'
    WHEN pit_orders_delivered < 16 THEN '6-15' ELSE '16+' END AS bucket, payment_method
  FROM {_POP})
SELECT bucket, count(*) AS orders,
  cast(count(*) FILTER (WHERE payment_method = 'COD') AS double) / count(*) AS cod_share
FROM b GROUP BY bucket""")(lambda m: H.cod_by_tenure(orders_of(m)))
register("h2_within_tier", _two(
    _NEW, "cod_share_new", "cod_share_established", by="geo_tier",
    where="WHERE n_cod_share_new >= 30 AND n_cod_share_established >= 30"))(
    lambda m: _ci8(H.new_customer_cod_within_tier(orders_of(m))))
register("h3_prior_rto_lift", f"""WITH c AS (
  SELECT count(*) FILTER (WHERE pit_rto_count > 0) AS n1,
    count(*) FILTER (WHERE pit_rto_count > 0 AND rto_flag) AS x1,
    count(*) FILTER (WHERE pit_rto_count = 0) AS n0,
    count(*) FILTER (WHERE pit_rto_count = 0 AND rto_flag) AS x0
  FROM {_POP} WHERE is_shipped AND NOT is_censored),
p AS (SELECT *, cast(x1 AS double) / n1 AS p1, cast(x0 AS double) / n0 AS p0 FROM c),
l AS (SELECT *, p1 / p0 AS lift, sqrt((1 - p1) / x1 + (1 - p0) / x0) AS se FROM p)
SELECT n1 AS n_with_prior, n0 AS n_without, p1 AS rto_rate_with_prior, p0 AS rto_rate_without,
  lift, round(exp(ln(lift) - 1.96 * se), 8) AS ci_low,
  round(exp(ln(lift) + 1.96 * se), 8) AS ci_high FROM l""")(
    lambda m: _ci8(H.prior_rto_lift(orders_of(m))))
register("h3_by_prior_count", f"""WITH g AS (SELECT least(pit_rto_count, 3) AS prior_rto,
  count(*) AS orders, count(*) FILTER (WHERE rto_flag) AS x
  FROM {_POP} WHERE is_shipped AND NOT is_censored GROUP BY 1)
SELECT prior_rto, orders, cast(x AS double) / orders AS rto_rate,
  cast(x AS double) / orders / first_value(cast(x AS double) / orders) OVER (ORDER BY prior_rto)
  AS lift_vs_zero FROM g""")(lambda m: H.rto_by_prior_count(orders_of(m)))
_EDGES = ", ".join(f"quantile_cont(cast(order_value AS double), {i / 10}) AS e{i}"
                   for i in range(1, 10))
register("h4_value_deciles", f"""WITH e AS (SELECT {_EDGES} FROM fct_order),
b AS (SELECT order_value, payment_method, CASE {' '.join(
        f'WHEN order_value <= e{i} THEN {i}' for i in range(1, 10))} ELSE 10 END AS decile
  FROM fct_order, e)
SELECT decile, count(*) AS orders, cast(count(*) FILTER (WHERE payment_method = 'COD') AS double)
  / count(*) AS cod_share, quantile_cont(cast(order_value AS double), 0.5) AS median_value
FROM b GROUP BY decile""")(lambda m: H.cod_by_value_decile(m["fct_order"]))
register("h4_order_value_cod")(lambda m: H.order_value_cod(m["fct_order"]))
register("h5a_ratings_on_cod")(lambda m: H.ratings_on_cod(orders_of(m)))
register("h5b_review_count_on_rto")(
    lambda m: H.review_count_on_rto(orders_of(m, *REVIEWS)))
register("h6_rto_by_promise", """
SELECT estimated_delivery_days, count(*) AS orders,
  cast(count(*) FILTER (WHERE rto_flag) AS double) / count(*) AS rto_rate
FROM fct_order WHERE is_shipped AND NOT is_censored GROUP BY 1""")(
    lambda m: H.rto_by_promise(m["fct_order"]))
register("h6_delay_availability", """
WITH j AS (SELECT o.*, d.ad FROM fct_order o LEFT JOIN (
    SELECT order_id, max(attempt_delay_days) AS ad FROM fct_delivery_event
    WHERE attempt_number = 1 GROUP BY order_id) AS d ON d.order_id = o.order_id
  WHERE is_shipped AND NOT is_censored)
SELECT count(*) FILTER (WHERE is_delivered AND delivery_delay_days IS NOT NULL)
    AS delivered_with_delay,
  count(*) FILTER (WHERE is_delivered AND delivery_delay_days IS NULL) AS delivered_without_delay,
  count(*) FILTER (WHERE rto_flag AND ad IS NOT NULL) AS returned_with_attempt_delay,
  count(*) FILTER (WHERE rto_flag AND ad IS NULL) AS returned_without_attempt_delay,
  avg(delivery_delay_days) FILTER (WHERE is_delivered) AS mean_delay_delivered,
  avg(ad) FILTER (WHERE rto_flag) AS mean_attempt_delay_returned FROM j""")(
    lambda m: H.delay_availability(m["fct_order"].join(
        views.first_attempt_delay(m), "order_id", "left")))
register("h6_promise_effect")(lambda m: H.promise_effect(orders_of(m, *PROMISE)))
register("h6_deviance_comparison")(
    lambda m: H.deviance_comparison(orders_of(m, *DELAY)))
register("h11_switch_cod", """
WITH b AS (SELECT * FROM fct_order WHERE is_shipped AND NOT is_censored),
s AS (SELECT count(*) FILTER (WHERE final_payment_method = 'COD') AS cod_orders,
  count(*) FILTER (WHERE switched_to_cod_after_failure) AS switched FROM fct_checkout_session),
q AS (SELECT count(*) FILTER (WHERE paid_via_switch) AS n1,
  count(*) FILTER (WHERE NOT paid_via_switch) AS n0,
  avg(cast(rto_flag AS int)) FILTER (WHERE paid_via_switch) AS a,
  avg(cast(rto_flag AS int)) FILTER (WHERE NOT paid_via_switch) AS b,
  var_samp(cast(rto_flag AS int)) FILTER (WHERE paid_via_switch) AS va,
  var_samp(cast(rto_flag AS int)) FILTER (WHERE NOT paid_via_switch) AS vb
  FROM b WHERE payment_method = 'COD')
SELECT cast(switched AS double) / cod_orders AS pct_of_cod_from_failure,
  switched AS switch_cod_orders, cod_orders, n1 AS n_rto_rate_switch_cod,
  n0 AS n_rto_rate_intent_cod, a AS rto_rate_switch_cod, q.b AS rto_rate_intent_cod,
  round((a - q.b) * 100, 8) AS diff_pp,
  round((a - q.b - 1.96 * sqrt(va / n1 + vb / n0)) * 100, 8) AS ci_low_pp,
  round((a - q.b + 1.96 * sqrt(va / n1 + vb / n0)) * 100, 8) AS ci_high_pp,
  (SELECT avg(cast(rto_flag AS int)) FROM b WHERE payment_method <> 'COD') AS rto_rate_prepaid
FROM q, s""")(lambda m: _ci8(H.switch_cod(m["fct_order"], m["fct_checkout_session"])))
register("h12_prior_scoreboard")(lambda m: H.prior_scoreboard(orders_of(m)))
