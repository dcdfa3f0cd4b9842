"""Risk-model queries: splits, designs, scorecards, baselines, challenger, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag
from ..operators import evaluate, features, irls, models, policy, ranks, traces, views
from ..session import cut, keep
from .base_queries import MODEL_VIEW_SQL
from .registry import register


def split_of(m):
    view = keep(views.training_input(m))
    clean, horizon = models.clean_window(view, m["fct_order"])
    return models.time_split(clean, horizon=horizon)


def prepared(m, model: str):
    """Scored train and test sides of one scorecard."""
    split = split_of(m)  # both sides are read from what it has written
    return models.fit_scorecard(split.train, model), split.train, split.test


_VIEW = """
view AS (SELECT s.session_start_ts, s.customer_id, o.payment_method, o.rto_flag, s.session_id,
    st.pit_risk_tier_rule_based
  FROM fct_order o JOIN fct_checkout_session s ON s.session_id = o.session_id
  JOIN fct_customer_state_at_session st ON st.session_id = o.session_id
  WHERE o.is_shipped AND NOT o.is_censored AND s.session_start_ts <
    (SELECT min(order_date) FROM fct_order WHERE is_shipped AND is_censored)),
cutday AS (SELECT cast(session_start_ts AS date) AS d FROM view ORDER BY session_start_ts
  LIMIT 1 OFFSET (SELECT cast(floor(count(*) * 0.70) AS bigint) FROM view)),
sides AS (SELECT *, CASE WHEN session_start_ts < (SELECT d FROM cutday) THEN 'train'
  ELSE 'test' END AS split FROM view)"""
register("model_split", f"""WITH {_VIEW}
SELECT split, count(*) AS rows, cast(cast(min(session_start_ts) AS date) AS varchar) AS from_day,
  cast(cast(max(session_start_ts) AS date) AS varchar) AS to_day,
  cast(count(*) FILTER (WHERE rto_flag) AS double) / count(*) AS rto_rate,
  cast(count(*) FILTER (WHERE payment_method = 'COD') AS double) / count(*) AS cod_share,
  count(DISTINCT customer_id) AS customers FROM sides GROUP BY split""")(
    lambda m: models.describe_split(split_of(m)))

register("rules_table_m1", f"""WITH {_VIEW},
g AS (SELECT pit_risk_tier_rule_based, count(*) AS n, count(*) FILTER (WHERE rto_flag) AS x
  FROM sides WHERE split = 'train' GROUP BY 1)
SELECT pit_risk_tier_rule_based, n, cast(x AS double) / n AS observed,
  cast(n AS double) / sum(n) OVER () * 100 AS share_pct, cast(x AS double) / n AS assigned_p,
  cast(x AS double) / n / (cast(sum(x) OVER () AS double) / sum(n) OVER ()) AS lift FROM g""")(
    lambda m: models.rules_table(split_of(m).train, "pit_risk_tier_rule_based"))
register("rules_auc_m1_m2")(lambda m: _rules_auc(m))


def _rules_auc(m):
    split = split_of(m)
    train, test = views.with_m2_tier(split.train), views.with_m2_tier(split.test)
    out = None
    for name, col in (("M1 rules", "pit_risk_tier_rule_based"),
                      ("M2 rules", "order_risk_tier_rule_based")):
        scored = models.rules_scores(train, test, col)
        row = ranks.auc_ks(ranks.score_table(scored, "score", "rto_flag")).withColumn(
            "model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


register("rules_tier_agreement")(lambda m: models.tier_agreement(
    views.training_input(m), m["fct_order"]))


@register("design_redundancy")
def design_redundancy(m):
    """Kept and dropped columns of the fitted M2 design."""
    split = split_of(m)
    design = models.DesignMatrix("M2").fit(split.train)
    rows = [(c, "kept", None) for c in design.columns] + [(c, "dropped", why)
                                                         for c, why in design.redundant]
    return m.spark.createDataFrame(rows, "feature string, status string, reason string")


_MEDIANS = ("pit_avg_order_value", "pit_days_since_last_order", "pit_cod_share", "order_value")
register("feature_medians", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS n, quantile_cont(cast({c} AS double), 0.25) AS q0,
  quantile_cont(cast({c} AS double), 0.5) AS q1, quantile_cont(cast({c} AS double), 0.75) AS q2
FROM ({MODEL_VIEW_SQL}) AS v HAVING count({c}) > 0""" for c in _MEDIANS))(lambda m: ranks.many_quantiles(
    keep(views.training_input(m)), ["pit_avg_order_value", "pit_days_since_last_order",
                              "pit_cod_share", "order_value"], [0.25, 0.5, 0.75]))
register("feature_correlations")(lambda m: features.correlation_matrix(
    views.training_input(m).select(*[F.col(c).cast("double").alias(c) for c in (
        "order_value", "cart_value", "list_price", "cart_size", "pit_orders_placed",
        "pit_orders_delivered")]),
    ["order_value", "cart_value", "list_price", "cart_size", "pit_orders_placed",
     "pit_orders_delivered"]))


@register("scorecard_m1_coefficients")
def scorecard_m1_coefficients(m):
    train = split_of(m).train
    return models.coefficient_table(train, models.fit_scorecard(train, "M1").fit)


@register("scorecard_m2_points")
def scorecard_m2_points(m):
    train = split_of(m).train
    return models.points_table(models.coefficient_table(
        train, models.fit_scorecard(train, "M2").fit))


def scoreboard(m, model: str):
    card, train, test = prepared(m, model)
    keep = ["session_id", "rto_flag"]
    rows = None
    for name, side in (("train", train), ("test", test)):
        row = evaluate.summarise(card.score(side, keep), "score", "rto_flag", "session_id",
                                 f"{model} scorecard - {name}")
        rows = row if rows is None else rows.unionByName(row)
    return rows


register("scorecard_m1_scoreboard")(lambda m: scoreboard(m, "M1"))
register("scorecard_m2_scoreboard")(lambda m: scoreboard(m, "M2"))


@register("scorecard_m2_policy")
def scorecard_m2_policy(m):
    """Ratio audit of the fitted M2 scorecard on its test side."""
    card, train, test = prepared(m, "M2")
    keep = ["session_id", "geo_tier", "payment_method", "rto_flag", "pit_has_clean_record",
            "pit_has_history"]
    return policy.ratio_audit(card.score(test, keep))


@register("scorecard_m1_scores")
def scorecard_m1_scores(m):
    card, train, test = prepared(m, "M1")
    return card.score(test, ["session_id", "customer_id"]).withColumn(
        "tier", policy.score_tier("score"))


@register("scorecard_regularised")
def scorecard_regularised(m):
    train = split_of(m).train
    design = models.DesignMatrix("M1").fit(train)
    coef, intercept = models.fit_regularised(design.transform(train, ["rto_flag"]),
                                             flag("row.rto_flag"), design.columns, 0.01)
    rows = [("(intercept)", intercept), *coef.items()]
    return m.spark.createDataFrame(rows, "feature string, coefficient double")


@register("challenger_gbm")
def challenger_gbm(m):
    """Boosted trees against the M2 scorecard under the ship rule, with the model gates."""
    card, train, test = prepared(m, "M2")
    keep = ["session_id", "rto_flag"]
    tr, te = card.design.transform(train, keep), card.design.transform(test, keep)
    _, score = models.fit_challenger(tr, flag("row.rto_flag"), card.design.columns)
    a = evaluate.auc(score(te), "score", "rto_flag")
    b = evaluate.auc(card.score(test, keep), "score", "rto_flag")
    margin, ships = models.ship_rule(a, b)
    return m.spark.createDataFrame([(a, b, margin, ships)],
                                   "challenger_auc double, scorecard_auc double, "
                                   "margin_pp double, ships boolean")


@register("model_gates")
def model_gates(m):
    card, train, test = prepared(m, "M2")
    value = evaluate.auc(card.score(test, ["session_id", "rto_flag"]), "score", "rto_flag")
    return models.model_gates(train, value, P.CALIBRATION["auc_ceiling"][0])


@register("geography_ablation")
def geography_ablation(m, volume: float = 0.17):
    """M1 refitted without feature blocks, with AUC and the TIER3/METRO ratio of each."""
    split = split_of(m)
    train, test = split.train.persist(), split.test.persist()
    design = models.DesignMatrix("M1").fit(train)
    keep = ["session_id", "geo_tier", "payment_method", "rto_flag", "pit_has_clean_record",
            "pit_has_history"]
    tr, te = design.transform(train, ["rto_flag"]).persist(), design.transform(test, keep).persist()
    drops = {"full model": [], "no geo_tier dummies": [c for c in design.columns
                                                       if c.startswith("geo_tier[")],
             "no geographic features at all": [c for c in P.GEOGRAPHIC_FEATURES
                                               if c in design.columns],
             "no point-in-time history": [c for c in design.columns if "pit_" in c]}
    rows = []
    fits, _ = irls.fit_many(tr, flag("row.rto_flag"), {
        name: [c for c in design.columns if c not in gone] for name, gone in drops.items()})
    for name, fit in fits.items():
        names = fit.names
        scored = fit.score(te).select("row.*", F.col("p").alias("score")).persist()
        audit = policy.geo_audit(scored, [volume]).first()
        rows.append((name, len(names), evaluate.auc(scored, "score", "rto_flag"), audit.METRO,
                     audit.TIER3, audit.tier3_over_metro, audit.verdict))
        scored.unpersist()
    for df in (tr, te, train, test):
        df.unpersist()
    return m.spark.createDataFrame(
        rows, "model string, features int, test_auc double, metro_flagged double, "
        "tier3_flagged double, tier3_over_metro double, verdict string")


# ---- trace scoring -------------------------------------------------------------------------
register("session_probabilities")(lambda m: m["truth_order_probability"].select(
    "session_id", "p_cod_intent", "p_rto_precheckout", "p_rto_final", "components_populated"))


@register("trace_reconstruction")
def trace_reconstruction(m):
    """Sum of each stored trace against the probability it explains."""
    t = m["truth_order_probability"].where("components_populated")
    rebuilt = t.select(
        traces.logistic(traces.trace_sum(F.col("logit_cod_components"))).alias("rebuilt"),
        F.get_json_object("logit_cod_components", "$.__probability__").cast("double")
        .alias("stored"))
    return traces.reconstruction_check(rebuilt, "rebuilt", "stored", 1e-6)


register("audit_sample_summary")(lambda m: traces.audit_summary(
    traces.audit_sample(keep(traces.scored_sessions(m, terms=False)))))
register("planted_effect")(lambda m: traces.planted_effect(traces.scored_sessions(m, terms=False)))
register("average_marginal_effect")(lambda m: traces.average_marginal_effect(
    traces.scored_sessions(m, terms=False).where(F.col("p_rto_final").isNotNull()).select(
        (F.col("rto_lp") - F.when(F.col("payment_method") == "COD",
                                  P.RTO_COEFFICIENTS["is_cod"]).otherwise(0.0)).alias("off")),
    "off", P.RTO_COEFFICIENTS["is_cod"]))


@register("recalibrated_intercept")
def recalibrated_intercept(m):
    """Shift that brings the mean return probability to its declared blended target."""
    lp = cut(traces.scored_sessions(m, terms=False).where(F.col("p_rto_final").isNotNull())
                    .select("rto_lp"))
    target = P.CALIBRATION["rto_rate_blended"][0]
    r = traces.recalibrate(lp, "rto_lp", target, bracket=P.INTERCEPT_BRACKETS["rto"],
                           tolerance=1e-6)
    return m.spark.createDataFrame(
        [(r.intercept, r.achieved, r.target, r.iterations, r.converged)],
        "intercept double, achieved double, target double, iterations int, converged boolean")
