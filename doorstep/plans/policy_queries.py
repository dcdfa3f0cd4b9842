"""Policy, fairness and score-evaluation queries over a deterministic order score."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag, lookup, ratio
from ..operators import economics, evaluate, policy, ranks, views
from ..session import keep
from .registry import register


def policy_frame(m):
    """Resolved orders with protections, margin and an integer-built score in thousandths."""
    st = m["fct_customer_state_at_session"].select("session_id", "pit_has_clean_record",
                                                   "pit_has_history")
    o = views.resolved(m["fct_order"]).select("order_id", "session_id", "payment_method",
                                              "rto_flag", "delivery_geography_id")
    g = m["dim_geography"].select(F.col("geography_id").alias("delivery_geography_id"),
                                  "geo_tier")
    e = m["fct_order_economics"].select("order_id", "contribution_margin")
    j = o.join(g, "delivery_geography_id").join(st, "session_id").join(e, "order_id")
    key = F.expr("substring(order_id, 5)").cast("long")
    tier = lookup("geo_tier", {t: i for i, t in enumerate(P.GEO_TIERS)})
    points = (key * 7919) % 700 + F.when(F.col("payment_method") == "COD", 200).otherwise(0) \
        + 25 * tier
    # every audit reads the frame several times (thresholds, selection, totals)
    return keep(j.select("session_id", "geo_tier", "payment_method", "rto_flag",
                         "pit_has_clean_record", "pit_has_history", "contribution_margin",
                         (points / F.lit(1000.0)).alias("score")))


_VOL = "(VALUES (0.05), (0.10), (0.17), (0.25)) AS v(volume)"
FRAME = """
frame AS (
  SELECT o.session_id, g.geo_tier, o.payment_method, o.rto_flag, st.pit_has_clean_record,
         st.pit_has_history, e.contribution_margin,
         cast((cast(substr(o.order_id, 5) AS bigint) * 7919) % 700
              + CASE WHEN o.payment_method = 'COD' THEN 200 ELSE 0 END
              + CASE g.geo_tier WHEN 'METRO' THEN 0 WHEN 'TIER1' THEN 25 WHEN 'TIER2' THEN 50
                ELSE 75 END AS double) / 1000.0 AS score
  FROM fct_order o JOIN dim_geography g ON g.geography_id = o.delivery_geography_id
  JOIN fct_customer_state_at_session st ON st.session_id = o.session_id
  JOIN fct_order_economics e ON e.order_id = o.order_id
  WHERE o.is_shipped AND NOT o.is_censored)"""
PICKS = f"""{FRAME},
vols AS (SELECT cast(volume AS double) AS volume FROM {_VOL}),
tcut AS (SELECT geo_tier, volume, quantile_cont(score, 1 - volume) AS cut
  FROM (SELECT geo_tier, score, volume FROM frame, vols) AS x GROUP BY geo_tier, volume, 1 - volume),
picks AS (
  SELECT f.*, volume, 'global' AS rule FROM frame f JOIN gcut ON score >= cut
  UNION ALL
  SELECT f.*, t.volume, 'per-tier' FROM frame f JOIN tcut t
    ON t.geo_tier = f.geo_tier AND f.score >= t.cut),
kept AS (SELECT *, NOT pit_has_clean_record AND pit_has_history AS keep FROM picks),
tot AS (SELECT geo_tier, count(*) AS orders, count(*) FILTER (WHERE rto_flag) AS rto
  FROM frame GROUP BY geo_tier)"""
# DuckDB wants constant quantile arguments, so each volume is spelled out
_GCUT = " UNION ALL ".join(
    f"SELECT cast({v} AS double) AS volume, quantile_cont(score, {round(1 - v, 2)}) AS cut "
    "FROM frame" for v in P.FAIRNESS_VOLUMES)
_TCUT = " UNION ALL ".join(
    f"SELECT geo_tier, cast({v} AS double) AS volume, quantile_cont(score, {round(1 - v, 2)}) "
    "AS cut FROM frame GROUP BY geo_tier" for v in P.FAIRNESS_VOLUMES)
_head, _tail = PICKS.split("tcut AS (", 1)
PICKS = (_head + f"gcut AS ({_GCUT}), tcut AS ({_TCUT}), picks AS ("
         + _tail.split("picks AS (", 1)[1])

EXPOSURE = f"""{PICKS},
r AS (SELECT volume, rule, geo_tier, count(*) AS restricted, min(score) AS score_cut,
    avg(score) AS ms, count(*) FILTER (WHERE rto_flag) AS x,
    count(*) FILTER (WHERE score < {P.P_STAR}) AS below FROM kept WHERE keep
  GROUP BY volume, rule, geo_tier),
grid AS (SELECT volume, rule, geo_tier, orders, rto FROM vols, tot,
  (VALUES ('global'), ('per-tier')) AS q(rule)),
exposure AS (SELECT g.volume, g.rule, g.geo_tier, g.orders, coalesce(r.restricted, 0)
    AS restricted, cast(coalesce(r.restricted, 0) AS double) / g.orders AS restriction_rate,
    cast(g.rto AS double) / g.orders AS tier_rto_rate, r.score_cut,
    round(r.ms, 9) AS mean_score_restricted,
    cast(r.x AS double) / r.restricted AS rto_rate_restricted,
    cast(r.below AS double) / r.restricted AS share_below_pstar
  FROM grid g LEFT JOIN r ON r.volume = g.volume AND r.rule = g.rule
    AND r.geo_tier = g.geo_tier)"""

register("policy_tier_exposure", f"WITH {EXPOSURE} SELECT * FROM exposure")(
    lambda m: policy.tier_exposure(policy_frame(m)))

_PIVOT = ", ".join(f"max(restriction_rate) FILTER (WHERE geo_tier = '{t}') AS {t}"
                   for t in P.GEO_TIERS)
register("policy_ratio_audit", f"""WITH {EXPOSURE}
SELECT volume, rule, {_PIVOT},
  arg_min(geo_tier, (1 - restriction_rate, geo_tier)) AS worst_tier,
  arg_min(geo_tier, (restriction_rate, geo_tier)) AS best_tier,
  CASE WHEN min(restriction_rate) > 0 THEN max(restriction_rate) / min(restriction_rate) END
    AS ratio,
  CASE WHEN min(restriction_rate) > 0
       AND max(restriction_rate) / min(restriction_rate) <= {P.FAIRNESS_LIMIT} THEN 'PASS'
       ELSE 'FAIL' END AS verdict
FROM exposure GROUP BY volume, rule""")(lambda m: policy.ratio_audit(policy_frame(m)))

register("policy_geo_audit", f"""WITH {PICKS},
s AS (SELECT volume, geo_tier, count(*) AS x FROM picks WHERE rule = 'global'
  GROUP BY volume, geo_tier),
e AS (SELECT v.volume, t.geo_tier, cast(coalesce(s.x, 0) AS double) / t.orders
    AS restriction_rate FROM vols v CROSS JOIN tot t LEFT JOIN s ON s.volume = v.volume
    AND s.geo_tier = t.geo_tier),
p AS (SELECT volume, {_PIVOT} FROM e GROUP BY volume)
SELECT p.volume, cut AS score_cut, METRO, TIER1, TIER2, TIER3,
  CASE WHEN METRO > 0 THEN TIER3 / METRO END AS tier3_over_metro,
  CASE WHEN METRO > 0 THEN '' ELSE 'no METRO order flagged' END AS note,
  CASE WHEN METRO > 0 AND TIER3 / METRO <= {P.FAIRNESS_LIMIT} THEN 'PASS' ELSE 'ESCALATE' END
    AS verdict
FROM p JOIN gcut ON gcut.volume = p.volume""")(lambda m: policy.geo_audit(policy_frame(m)))


def _factor(m):
    n = m["fct_order"].agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    return F.lit(float(P.POPULATION_ANNUAL_ORDERS)) / n


_ANNUAL = f"(SELECT cast({P.POPULATION_ANNUAL_ORDERS} AS double) / count(*) FROM fct_order)"
_MARGIN = f"""{PICKS},
g AS (SELECT volume, count(*) FILTER (WHERE rule = 'global') AS selected,
  count(*) FILTER (WHERE rule = 'global' AND keep) AS global_n,
  count(*) FILTER (WHERE rule = 'per-tier' AND keep) AS per_tier_n,
  cast(coalesce(sum(-contribution_margin) FILTER (WHERE rule = 'global' AND keep), 0) AS double)
    AS gd,
  cast(coalesce(sum(-contribution_margin) FILTER (WHERE rule = 'per-tier' AND keep), 0)
    AS double) AS td,
  count(*) FILTER (WHERE rule = 'global' AND keep AND payment_method = 'COD') AS gc,
  count(*) FILTER (WHERE rule = 'per-tier' AND keep AND payment_method = 'COD') AS tc
  FROM kept GROUP BY volume)"""
register("policy_margin_cost", f"""WITH {_MARGIN}
SELECT volume, selected, global_n, gd AS global_delta_cm,
  gd / greatest(global_n, 1) AS global_per_order, per_tier_n, td AS per_tier_delta_cm,
  td / greatest(per_tier_n, 1) AS per_tier_per_order, gd - td AS price_of_fairness,
  (gd - td) / greatest(global_n, 1) AS price_per_restricted_order,
  (gd - td) * {_ANNUAL} / 1e7 AS price_annualised_cr FROM g""")(
    lambda m: policy.margin_cost(policy_frame(m), _factor(m)))

register("policy_conversion_sensitivity", f"""WITH {_MARGIN},
pp AS (SELECT cast(count(*) FILTER (WHERE rto_flag) AS double) / count(*) AS r,
  cast(sum(contribution_margin) FILTER (WHERE NOT rto_flag) AS double)
    / count(*) FILTER (WHERE NOT rto_flag) AS d,
  cast(sum(contribution_margin) FILTER (WHERE rto_flag) AS double)
    / count(*) FILTER (WHERE rto_flag) AS b
  FROM fct_order JOIN fct_order_economics USING (order_id)
  WHERE payment_method = 'PREPAID' AND is_shipped AND NOT is_censored),
x AS (SELECT cast(s AS double) AS s, (1 - r) * d + r * b AS ev, gd, td, gc, tc
  FROM g, pp, (VALUES (0.0), (0.25), (0.5)) AS q(s) WHERE volume = 0.17)
SELECT s AS cod_switch_share, ev AS switched_order_ev, gd + s * ev * gc AS global_delta_cm,
  td + s * ev * tc AS per_tier_delta_cm,
  (gd + s * ev * gc) - (td + s * ev * tc) AS price_of_fairness,
  ((gd + s * ev * gc) - (td + s * ev * tc)) * {_ANNUAL} / 1e7 AS price_annualised_cr FROM x""")(
    lambda m: policy.conversion_sensitivity(
        policy_frame(m), economics.prepaid_economics(m["fct_order"], m["fct_order_economics"]),
        _factor(m)))

_TIERED = (f"CASE WHEN score >= {P.P_STAR} THEN 'HIGH' WHEN score >= {P.MED_SCORE_FLOOR} "
           "THEN 'MED' ELSE 'LOW' END")
register("policy_overlay_summary", f"""WITH {FRAME},
t AS (SELECT {_TIERED} AS raw, pit_has_clean_record OR NOT pit_has_history AS prot FROM frame),
u AS (SELECT raw, CASE WHEN raw = 'HIGH' AND prot THEN 'MED' ELSE raw END AS fin FROM t),
a AS (SELECT raw AS tier, count(*) AS n_raw, count(*) FILTER (WHERE raw <> fin) AS moved FROM u
  GROUP BY raw),
b AS (SELECT fin AS tier, count(*) AS n_final FROM u GROUP BY fin)
SELECT tier, coalesce(n_raw, 0) AS n_raw, coalesce(n_final, 0) AS n_final,
  coalesce(moved, 0) AS reclassified_out,
  cast(coalesce(n_raw, 0) AS double) / sum(n_raw) OVER () * 100 AS share_raw_pct,
  cast(coalesce(n_final, 0) AS double) / sum(n_final) OVER () * 100 AS share_final_pct,
  coalesce(cast(moved AS double) / n_raw * 100, 0) AS pct_of_tier_reclassified
FROM a FULL JOIN b USING (tier)""")(lambda m: policy.overlay_summary(
    policy_frame(m).withColumn("tier", policy.score_tier("score"))))
register("policy_protection_gradient", f"""WITH {FRAME}
SELECT geo_tier,
  cast(count(*) FILTER (WHERE pit_has_clean_record) AS double) / count(*) * 100
    AS clean_record_pct,
  cast(count(*) FILTER (WHERE NOT pit_has_history) AS double) / count(*) * 100
    AS zero_history_pct,
  cast(count(*) FILTER (WHERE pit_has_clean_record OR NOT pit_has_history) AS double)
    / count(*) * 100 AS protected_pct,
  cast(count(*) FILTER (WHERE rto_flag) AS double) / count(*) AS tier_rto_rate
FROM frame GROUP BY geo_tier""")(lambda m: policy.protection_gradient(policy_frame(m)))
register("policy_protection_coverage", f"""WITH {FRAME},
x AS (SELECT 'clean-record cap' AS protection, pit_has_clean_record AS hit, rto_flag FROM frame
  UNION ALL SELECT 'zero-history immunity', NOT pit_has_history, rto_flag FROM frame)
SELECT protection, count(*) FILTER (WHERE hit) AS orders,
  cast(count(*) FILTER (WHERE hit) AS double) / count(*) * 100 AS share_pct,
  cast(count(*) FILTER (WHERE hit AND rto_flag) AS double)
    / nullif(count(*) FILTER (WHERE hit), 0) AS rto_rate
FROM x GROUP BY protection""")(lambda m: policy.protection_coverage(policy_frame(m)))
register("policy_score_by_tier", f"""WITH {FRAME},
g AS (SELECT geo_tier, count(*) AS orders, count(*) FILTER (WHERE rto_flag) AS x,
  avg(score) AS ms, count(*) FILTER (WHERE payment_method = 'COD') AS c FROM frame
  GROUP BY geo_tier)
SELECT geo_tier, orders, cast(x AS double) / orders AS observed_rto, round(ms, 9) AS mean_score,
  cast(c AS double) / orders AS cod_share,
  round((ms - cast(x AS double) / orders) * 100, 7) AS score_minus_observed_pp,
  cast(x AS double) / orders / (cast(sum(x) OVER () AS double) / sum(orders) OVER ())
    AS rto_lift_vs_population FROM g""")(lambda m: policy.score_by_tier(policy_frame(m)))
register("policy_score_tiers", f"""WITH {FRAME},
g AS (SELECT {_TIERED} AS tier, count(*) AS orders, count(*) FILTER (WHERE rto_flag) AS x
  FROM frame GROUP BY 1)
SELECT tier, orders, cast(orders AS double) / sum(orders) OVER () * 100 AS share_pct,
  CASE tier WHEN 'LOW' THEN 45.0 WHEN 'MED' THEN 38.0 ELSE 17.0 END AS expected_share_pct,
  cast(x AS double) / orders AS observed_rto FROM g""")(
    lambda m: policy.score_tier_table(policy_frame(m)))
register("policy_restriction_flags", f"""WITH {PICKS}
SELECT f.session_id, f.score, {_TIERED.replace('score', 'f.score')} AS tier,
  {', '.join(f"coalesce(bool_or(k.keep) FILTER (WHERE k.volume = {v}), false) "
             f"AS restricted_pertier_{round(v * 100):02d}" for v in P.FAIRNESS_VOLUMES)}
FROM frame f LEFT JOIN kept k ON k.session_id = f.session_id AND k.rule = 'per-tier'
GROUP BY f.session_id, f.score""")(lambda m: policy.restriction_flags(policy_frame(m)))

# ---- evaluation ---------------------------------------------------------------------------
register("eval_auc_ks", f"""WITH {FRAME},
d AS (SELECT score, count(*) FILTER (WHERE rto_flag) AS p,
  count(*) FILTER (WHERE NOT rto_flag) AS n FROM frame GROUP BY score),
c AS (SELECT *, coalesce(sum(n) OVER w, 0) AS nb, coalesce(sum(p) OVER w, 0) AS pb,
  sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM d
  WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT cast(sum(p) AS bigint) AS positives, cast(sum(n) AS bigint) AS negatives,
  cast(sum(p * (2 * nb + n)) AS double) / 2 / (max(tp)::double * max(tn)::double) AS auc,
  max(abs(cast(nb + n AS double) / tn - cast(pb + p AS double) / tp)) AS ks FROM c""")(
    lambda m: ranks.auc_ks(ranks.score_table(policy_frame(m), "score", "rto_flag")))
register("eval_brier", f"""WITH {FRAME}
SELECT round(avg((score - cast(rto_flag AS int)) * (score - cast(rto_flag AS int))), 9) AS brier
FROM frame""")(lambda m: evaluate.brier(policy_frame(m), "score", "rto_flag").select(
    F.round("brier", 9).alias("brier")))
_REL = f"""{FRAME},
r AS (SELECT score, rto_flag, row_number() OVER (ORDER BY score, session_id) AS rn,
  count(*) OVER () AS n FROM frame),
b AS (SELECT cast(greatest(0, ceil((rn - 1) * 10.0 / (n - 1)) - 1) AS int) AS bin, score,
  rto_flag FROM r),
rel AS (SELECT bin, count(*) AS n, avg(score) AS predicted,
  cast(count(*) FILTER (WHERE rto_flag) AS double) / count(*) AS observed, min(score) AS p_low,
  max(score) AS p_high, count(*) FILTER (WHERE rto_flag) AS events FROM b GROUP BY bin)"""
_REL_OUT = ("round(predicted, 9) AS predicted, observed, p_low, p_high, "
            "round((observed - predicted) * 100, 7) AS gap_pp")


def _rounded(df):
    return df.withColumns({"predicted": F.round("predicted", 9),
                           "gap_pp": F.round("gap_pp", 7)})


def _reliability(m):
    return evaluate.reliability(policy_frame(m), "score", "rto_flag", "session_id")


register("eval_reliability", f"WITH {_REL} SELECT bin, n, events, {_REL_OUT} FROM rel")(
    lambda m: _rounded(_reliability(m)))
register("eval_ece", f"""WITH {_REL}
SELECT round(sum(n * abs(observed - predicted)) / sum(n), 9) AS ece FROM rel""")(
    lambda m: evaluate.ece_of(_reliability(m)).select(F.round("ece", 9).alias("ece")))
register("eval_decile_lift", f"""WITH {_REL}
SELECT row_number() OVER (ORDER BY bin DESC) AS decile, n, {_REL_OUT},
  observed / (cast(sum(events) OVER () AS double) / sum(n) OVER ()) AS lift,
  cast(sum(events) OVER (ORDER BY bin DESC) AS double) / sum(events) OVER () * 100
    AS captured_pct FROM rel""")(lambda m: _rounded(evaluate.decile_lift(_reliability(m))))
register("eval_score_quantiles", f"""WITH {FRAME}
SELECT geo_tier, count(*) AS n, round(quantile_cont(score, 0.1), 9) AS p10,
  round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.9), 9) AS p90
FROM frame GROUP BY geo_tier""")(lambda m: ranks.quantiles(
    policy_frame(m), "score", [0.1, 0.5, 0.9], ["geo_tier"]).select(
    "geo_tier", "n", *[F.round(f"q{i}", 9).alias(a) for i, a in enumerate(("p10", "p50",
                                                                          "p90"))]))
register("eval_average_ranks", f"""WITH {FRAME},
d AS (SELECT score, count(*) AS n FROM frame GROUP BY score)
SELECT score, n, coalesce(sum(n) OVER (ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rank FROM d""")(
    lambda m: ranks.average_ranks(policy_frame(m).select("score"), "score").groupBy(
        "score", "rank").agg(F.count(F.lit(1)).alias("n")))
register("eval_global_row_number", f"""WITH {FRAME}
SELECT session_id, row_number() OVER (ORDER BY score, session_id) AS row_number FROM frame""")(
    lambda m: ranks.row_numbers(policy_frame(m).select("session_id", "score"),
                                ["score", "session_id"]).select("session_id", "row_number"))
register("eval_summary")(lambda m: evaluate.summarise(
    policy_frame(m), "score", "rto_flag", "session_id", "integer score"))
register("eval_top_volume", f"""WITH {FRAME}
SELECT count(*) AS orders, cast(count(*) FILTER (WHERE rto_flag) AS double) / count(*)
  AS rto_rate FROM frame WHERE score >= (SELECT quantile_cont(score, 0.83) FROM frame)""")(
    lambda m: (lambda f: f.where(F.col("score") >= policy.cuts(f, [0.17]).select("cut").scalar())
               .agg(F.count(F.lit(1)).alias("orders"),
                    ratio(F.count_if(flag("rto_flag")), F.count(F.lit(1))).alias("rto_rate")))(
        policy_frame(m)))
