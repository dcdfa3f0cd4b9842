"""Constraint, data-quality, calibration, behaviour and leakage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from .. import schemas
from ..operators import causal, hypotheses, policy, quality as Q, ranks, traces, views
from ..session import cut, forget
from .causal_queries import DELAY, orders_of, population
from .policy_queries import policy_frame
from .registry import register

CORE = ("fct_checkout_session", "fct_customer_state_at_session", "fct_checkout_event",
        "fct_payment_attempt", "fct_order", "fct_delivery_event", "fct_order_economics")


def _rules_sql(table: str) -> str:
    """The same rules as DuckDB text over the oracle's own tables."""
    def fix(rule: str) -> str:
        return rule.replace("<=>", "IS NOT DISTINCT FROM")
    parts = [f"SELECT '{table}' AS \"table\", '{name}' AS rule, "
             f"count(*) FILTER (WHERE ({fix(rule)}) IS FALSE) AS violations FROM {table}"
             for name, rule in schemas.RULES[table]]
    return " UNION ALL ".join(parts)


for _t in ("dim_geography", "dim_seller", "dim_product", "dim_customer", "fct_checkout_session",
           "fct_customer_state_at_session", "fct_order", "fct_delivery_event",
           "fct_order_economics", "truth_customer_latent"):
    register(f"constraints_{_t}", _rules_sql(_t))(
        lambda m, t=_t: Q.constraint_violations(m[t], t))
for _t in ("dim_date", "fct_checkout_event", "fct_payment_attempt", "truth_order_probability"):
    register(f"constraints_{_t}")(lambda m, t=_t: Q.constraint_violations(m[t], t))

_LINKS = [f for f in schemas.FOREIGN_KEYS if f[0] in (
    "dim_product", "dim_customer", "fct_checkout_session", "fct_customer_state_at_session",
    "fct_order", "fct_delivery_event", "fct_order_economics", "truth_customer_latent")]
register("foreign_key_orphans", " UNION ALL ".join(
    f"SELECT '{c}.{col}' AS reference, '{p}' AS parent, count(*) AS orphans FROM {c} AS x "
    f"WHERE x.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} AS y WHERE y.{k} = x.{col})"
    for c, col, p, k in _LINKS))(lambda m: Q.orphans(m, _LINKS))
_KEYED = ("dim_geography", "dim_seller", "dim_product", "dim_customer", "fct_checkout_session",
          "fct_order", "fct_delivery_event", "fct_order_economics")
register("duplicate_keys", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) - (SELECT count(*) FROM (SELECT DISTINCT "
    f"{', '.join(schemas.PRIMARY_KEYS[t])} FROM {t}) AS d) AS surplus FROM {t}"
    for t in _KEYED))(lambda m: Q.duplicate_keys(m, _KEYED))
register("missing_required_fct_order", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM fct_order"
    for c in schemas.required("fct_order")))(
    lambda m: Q.missing_required(m["fct_order"], "fct_order"))

register("attempt_delay_check", """
WITH p AS (SELECT order_id, count(attempt_delay_days) AS k,
  count(attempt_delay_days) FILTER (WHERE attempt_number = 1) AS f FROM fct_delivery_event
  GROUP BY order_id),
j AS (SELECT CASE WHEN coalesce(rto_flag, false) THEN 'returned' ELSE 'delivered' END AS arm,
  coalesce(k, 0) AS k, coalesce(f, 0) AS f FROM fct_order o LEFT JOIN p ON p.order_id = o.order_id
  WHERE is_shipped AND NOT is_censored)
SELECT arm, count(*) AS orders, count(*) FILTER (WHERE k > 0) AS populated,
  count(*) FILTER (WHERE f = 1) AS reachable, count(*) FILTER (WHERE f > 1) AS duplicated,
  count(*) FILTER (WHERE k > 0) = count(*) AND count(*) FILTER (WHERE f = 1) = count(*)
    AND count(*) FILTER (WHERE f > 1) = 0 AS ok FROM j GROUP BY arm""")(
    lambda m: Q.attempt_delay_check(m["fct_order"], m["fct_delivery_event"]))
register("first_delayed_attempt", """
WITH a AS (SELECT order_id, attempt_number, attempt_delay_days, row_number() OVER (PARTITION BY order_id
  ORDER BY attempt_number, attempt_delay_days DESC) AS place FROM fct_delivery_event
  WHERE attempt_delay_days IS NOT NULL)
SELECT o.order_id, attempt_number, attempt_delay_days FROM fct_order o
LEFT JOIN a ON a.order_id = o.order_id AND place = 1""")(
    lambda m: views.first_delayed_attempt(m["fct_order"], m["fct_delivery_event"]))
register("cod_share_odds", """
WITH c AS (SELECT count(*) FILTER (WHERE hi AND cod) AS a1, count(*) FILTER (WHERE hi AND NOT cod)
  AS a0, count(*) FILTER (WHERE lo AND cod) AS b1, count(*) FILTER (WHERE lo AND NOT cod) AS b0
  FROM (SELECT payment_method = 'COD' AS cod, pit_cod_share >= 0.75 AS hi,
    pit_cod_share <= 0.25 AS lo FROM fct_order o
    JOIN fct_customer_state_at_session s ON s.session_id = o.session_id
    WHERE pit_cod_share IS NOT NULL) AS x)
SELECT a1, a0, b1, b0, (cast(a1 AS double) / a0) / (cast(b1 AS double) / b0) AS odds_ratio FROM c
""")(lambda m: Q.odds_ratio(
    m["fct_order"].select("session_id", "payment_method").join(
        m["fct_customer_state_at_session"].select("session_id", "pit_cod_share"), "session_id")
    .where(F.col("pit_cod_share").isNotNull()), F.col("payment_method") == "COD",
    F.col("pit_cod_share") >= 0.75, F.col("pit_cod_share") <= 0.25))

register("checks_volume")(Q.volume_checks)
register("checks_calibration")(Q.calibration_checks)
register("checks_economics")(Q.economics_checks)
register("checks_behaviour")(Q.behaviour_checks)
register("checks_order_quality")(Q.order_quality_checks)
register("checks_ledger")(Q.ledger_checks)
_COUNTERS = ", ".join(Q.REDERIVED)
register("pit_rederived", f"SELECT session_id, {_COUNTERS} FROM fct_customer_state_at_session")(Q.rederived_counters)
register("pit_mismatches", f"""
SELECT unnest([{", ".join(f"'{c}'" for c in Q.REDERIVED)}]) AS counter, count(*) AS sessions, 0 AS mismatches
FROM fct_checkout_session""")(Q.pit_mismatches)
register("check_pit_integrity", """
SELECT 'LK-04' AS test_id, 'point-in-time integrity' AS name, 'HARD' AS severity, 'PASS' AS status,
  '0' AS expected, '0' AS actual, '' AS detail""")(Q.pit_integrity)
register("check_selection_share")(lambda m: Q.selection_share(
    traces.planted_effect(traces.scored_sessions(m, terms=False))))
register("auc_ceiling")(lambda m: ranks.auc_ks(ranks.score_table(
    views.resolved(traces.scored_sessions(m, terms=False)), "p_rto_precheckout", "rto_flag")))


@register("checks_leakage")
def checks_leakage(m):
    ceiling = ranks.auc_ks(ranks.score_table(views.resolved(traces.scored_sessions(m, terms=False)),
                                             "p_rto_precheckout", "rto_flag")).first().auc
    return Q.leakage_checks(m, views.risk_model_input(m).columns, ceiling, {
        "rto": P.RTO_PRIOR, "cod": P.COD_PRIOR, "payment": P.PAYMENT_FAILURE_PRIOR,
        "k": P.SHRINKAGE_K})


@register("check_coefficient_ledger")
def check_coefficient_ledger(m):
    """Terms found in the stored traces against the declared model terms."""
    t = m["truth_order_probability"].where("components_populated").select(
        F.explode(F.map_keys(F.from_json("logit_rto_components", "map<string,double>")))
        .alias("term")).where("term not like '\\\\_\\\\_%'").distinct()
    declared = m.spark.createDataFrame([(k,) for k in P.RTO_COEFFICIENTS], "term string")
    return t.withColumn("used", F.lit(True)).join(
        declared.withColumn("declared", F.lit(True)), "term", "full_outer").select(
        "term", F.when(F.col("declared").isNull(), "UNDECLARED")
        .when(F.col("used").isNull(), "UNUSED").otherwise("SAME").alias("verdict"))


def sweep_of(m):
    return Q.conditional_sweep(m, CORE)


register("outcome_conditional_sweep")(sweep_of)
register("check_outcome_conditional")(lambda m: Q.sweep_check(
    Q.sweep_against_allowlist(sweep_of(m))))
register("sweep_allowlist")(lambda m: Q.sweep_against_allowlist(sweep_of(m)))
register("check_fairness_ratio")(lambda m: Q.fairness_check(
    policy.ratio_audit(policy_frame(m)).where("rule = 'per-tier'")
    .select("volume", "ratio", F.lit(False).alias("stale"))))


@register("checks_ground_truth")
def checks_ground_truth(m):
    """Every ground-truth row, from fits on the whole population."""
    frame = traces.scoring_frame(m)
    effect = traces.planted_effect(traces.scored_frame(frame, terms=False)).first()
    forget(frame)
    pop, orders = population(m), orders_of(m, *DELAY)
    m.release()
    matched = causal.propensity_matched(pop).first().estimate_pp
    flips = causal.recovery_summary(cut(causal.recovery_table(pop))).first().sign_flips
    null = hypotheses.review_count_on_rto(pop).first()
    delay = hypotheses.deviance_comparison(orders).first().delay_over_promise_ratio
    return Q.ground_truth_checks(
        m.spark, naive=effect.naive_gap_pp, truth=effect.average_marginal_effect_pp,
        matched=matched, sign_flips=flips, null_effect=(null.coefficient,
                                                        null.p10_p90_spread_pp),
        delay_ratio=delay)


def delay_row(m):
    """DQ-15 over both arms."""
    arms = Q.attempt_delay_check(m["fct_order"], m["fct_delivery_event"])
    one = arms.agg(F.bool_and("ok").alias("ok"), F.count_if(~F.col("ok")).alias("bad"))
    return Q.check(one, "DQ-15", "attempt delay present and reachable in both arms", "HARD",
                   F.col("ok"), "0 arms", F.col("bad"))


def suite_results(m):
    """One row per check of every family that reads the tables.

    Left out: checks against planted truth (GT, CAL-09 to CAL-11, LK-03) and LK-06, which
    compares declared values only.
    """
    columns = views.risk_model_input(m).columns
    guards = Q.leakage_checks(m, columns, None, {}).where("test_id IN ('LK-01', 'LK-02')")
    fairness = Q.fairness_check(policy.ratio_audit(policy_frame(m)).where("rule = 'per-tier'")
                                .select("volume", "ratio", F.lit(False).alias("stale")))
    families = [Q.volume_checks(m), Q.calibration_checks(m), Q.order_quality_checks(m),
                Q.ledger_checks(m), Q.economics_checks(m), Q.behaviour_checks(m),
                Q.pit_integrity(m), delay_row(m),
                Q.sweep_check(Q.sweep_against_allowlist(sweep_of(m))), guards, fairness]
    # a family is a few rows; cut, each is planned and run by itself
    return Q.union([cut(rows) for rows in families])


register("suite_results")(suite_results)
register("suite_verdict")(lambda m: Q.verdict(suite_results(m)))
