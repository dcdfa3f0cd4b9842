from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from doorstep import params as P
from doorstep import schemas
from doorstep.operators import (causal, economics, events, features, funnel, models, policy,
                                quality as Q, reasons, traces, views)
from doorstep.sources import artefacts, tables as src


# ---- funnel ------------------------------------------------------------------------------
def test_standardisation(spark):
    cells = spark.createDataFrame([(100, 300, 10.0), (300, 100, 20.0)],
                                  "n_cod long, n_prepaid long, gap_pp double")
    r = funnel.standardised(cells).first()
    assert (r.att_cod_weighted, r.ate_pooled_weighted, r.atu_prepaid_weighted) == (17.5, 15, 12.5)


def test_funnel_narrows(model):
    n = [r.n for r in funnel.funnel_steps(model).orderBy("step_no").collect()]
    assert n == sorted(n, reverse=True) and len(n) == 6


def test_waterfall_adds_up(model):
    v = {r.step: r.value_cr for r in funnel.waterfall(model).collect()}
    assert v[2] + v[3] == pytest.approx(v[1])
    assert v[1] + v[4] == pytest.approx(v[5])
    assert v[7] == pytest.approx(v[5] * P.EFFICACY)


# ---- economics ---------------------------------------------------------------------------
def test_ledger_identities_hold_exactly(model):
    e = model["fct_order_economics"]
    total = sum((F.col(c) for c in economics.COST_LINES), F.lit(0).cast("decimal(10,2)"))
    bad = e.where((total != F.col("total_variable_cost"))
                  | (F.col("net_revenue") - F.col("cogs") - F.col("total_variable_cost")
                     != F.col("contribution_margin"))
                  | (F.col("rto_cash_loss") + F.col("foregone_cm") != F.col("rto_economic_cost")))
    assert bad.count() == 0
    gone = model["fct_order"].where("is_cancelled_preship").select("order_id")
    assert e.join(gone, "order_id").where("gmv <> 0 or contribution_margin <> 0").count() == 0


def test_exemplar_meets_its_targets():
    shown = economics.exemplar()
    for key, (target, tol) in P.RECONCILIATION.items():
        assert abs(shown[key] - target) <= tol
    assert abs(shown["breakeven_rto_prob"] - P.BREAKEVEN_BAND[0]) <= P.BREAKEVEN_BAND[1]


# ---- firewall ------------------------------------------------------------------------------
@pytest.mark.parametrize("bad,text", [("rto_reason", "hard-blocked"),
                                      ("shoe_size", "outside the whitelist")])
def test_firewall_fires(bad, text):
    views.assert_firewall(["session_id", "geo_tier", "order_value", "rto_flag"])
    with pytest.raises(views.FirewallError, match=text):
        views.assert_firewall(["session_id", "geo_tier", bad])


def test_stage4_bar_holds_even_if_whitelisted():
    with pytest.raises(views.FirewallError, match="post-dispatch"):
        views.assert_firewall(["attempt_delay_days"], allowed=["attempt_delay_days"], blocked=[])


def test_model_view_shape(model):
    view = views.training_input(model)
    assert view.columns == list(P.SAFE_COLUMNS)
    assert not set(views.drop_stage3(view).columns) & set(P.STAGE3_M2_ONLY)


def test_unique_join_guard(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="repeats"):
        views.unique_join(a, b, ["k"])


# ---- events ----------------------------------------------------------------------------------
def test_checkout_sequence_is_gapless(model):
    e = model["fct_checkout_event"].groupBy("session_id").agg(
        F.count("*").alias("n"), F.max("event_seq").alias("m"), F.min("event_seq").alias("l"))
    assert e.where("n <> m or l <> 1").count() == 0


def test_delivery_paths(model):
    e = model["fct_delivery_event"].groupBy("order_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_seq",
                                                                      "event_name"))),
                                 lambda s: s["event_name"]), ">").alias("path"))
    j = e.join(model["fct_order"].select("order_id", "order_status"), "order_id")
    got = {r.order_status: r.path for r in j.where("order_status <> 'RTO'").distinct()
           .select("order_status", "path").distinct().collect()}
    assert got["DELIVERED"] == "ORDER_PLACED>DISPATCHED>DELIVERED"
    assert got["SHIPPED"] == "ORDER_PLACED>DISPATCHED"
    assert j.where("order_status = 'RTO'").where("size(split(path, '>')) <> 7").count() == 0


def test_fee_dominates_only_with_a_fee(spark):
    t = {"shipping_fee_charged_gt0": F.lit(-0.5), "x": F.lit(-0.2)}
    r = spark.range(1).select(events.fee_is_dominant(t, "shipping_fee_charged_gt0", 0.0).alias("a"),
                              events.fee_is_dominant(t, "shipping_fee_charged_gt0", 9.0).alias("b"),
                              events.fee_is_dominant({"x": F.lit(-1.0)}, "fee", 9.0).alias("c"))
    assert list(r.first()) == [False, True, False]


def test_unknown_trace_session_fails(spark):
    scores = spark.createDataFrame([("a", 0.1, 0.2, None, None, None)],
                                   "session_id string, p_convert double, p_cod_intent double, "
                                   "p_rto_precheckout double, p_rto_final double, "
                                   "post_dispatch_shock double")
    traces_ = spark.createDataFrame([("zz", "{}", None)],
                                    "session_id string, logit_cod_components string, "
                                    "logit_rto_components string")
    with pytest.raises(Exception, match="unknown session"):
        events.probability_table(scores, traces_).collect()


# ---- traces ------------------------------------------------------------------------------------
def test_trace_sums_to_its_total(spark):
    df = spark.createDataFrame([("METRO", 2.0), ("TIER3", -1.0)], "geo string, x double")
    model = traces.LogOdds.build(-1.0, {"geo": {"METRO": -0.35, "TIER3": 0.45}, "x": 0.5},
                                 {"geo": F.col("geo"), "x": F.col("x")})
    out = model.append(df, "m")
    out = out.select("m_lp", "m_p", traces.trace_json(out, "m").alias("j"))
    for r in out.select("m_lp", "m_p", traces.trace_sum("j").alias("s")).collect():
        assert r.s == pytest.approx(r.m_lp) and r.m_p == pytest.approx(1 / (1 + np.exp(-r.m_lp)))


def test_trace_guards(spark):
    with pytest.raises(ValueError, match="no driver"):
        traces.LogOdds.build(0.0, {"x": 1.0}, {})
    df = spark.createDataFrame([("MARS",)], "geo string")
    m = traces.LogOdds.build(0.0, {"geo": {"METRO": 1.0}}, {"geo": F.col("geo")})
    with pytest.raises(Exception, match="no value declared"):
        m.append(df, "m").collect()
    m = traces.LogOdds.build(0.0, {"x": 1.0}, {"x": F.lit(None).cast("double")})
    with pytest.raises(Exception, match="not finite"):
        m.append(df, "m").collect()


def test_recalibration_hits_target(spark):
    df = spark.range(2000).select((F.rand(3) * 4 - 3).alias("lp")).persist()
    r = traces.recalibrate(df, "lp", 0.4, bracket=(-1.0, 1.0), tolerance=1e-7)
    assert r.converged and r.achieved == pytest.approx(0.4, abs=1e-7)
    with pytest.raises(ValueError):
        traces.recalibrate(df, "lp", 0.4, bracket=(1.0, -1.0), tolerance=1e-3)


def test_audit_sample_reports_shortfall(spark):
    df = spark.createDataFrame(
        [(f"s{i}", i % 2 == 0, "COD" if i % 3 else "PREPAID", i / 50, True, False)
         for i in range(50)], "session_id string, rto_flag boolean, payment_method string, "
        "p_rto_precheckout double, is_shipped boolean, is_censored boolean")
    got = {r.stratum: r for r in traces.audit_summary(
        traces.audit_sample(df, {"random_sessions": 10, "cod_rto": 500}),
        {"random_sessions": 10, "cod_rto": 500}).collect()}
    assert got["random_sessions"].shortfall == 0 and got["cod_rto"].shortfall > 0


# ---- models ----------------------------------------------------------------------------------
def test_logit_on_one_flag_is_the_log_odds_ratio(spark):
    rows = [(1, 1)] * 30 + [(1, 0)] * 70 + [(0, 1)] * 10 + [(0, 0)] * 90
    fit = models.fit_logit(spark.createDataFrame(rows, "x int, y int"), "y", ["x"])
    assert fit.coef["x"] == pytest.approx(np.log(30 / 70 / (10 / 90)), abs=1e-6)
    assert fit.se["x"] == pytest.approx(np.sqrt(1 / 30 + 1 / 70 + 1 / 10 + 1 / 90), abs=1e-5)
    null = models.fit_logit(spark.createDataFrame(rows, "x int, y int"), "y", [])
    assert null.deviance == pytest.approx(fit.null_deviance)


def test_independent_columns_drop_the_redundant_one(spark):
    df = spark.range(200).select(F.rand(1).alias("a"), F.rand(2).alias("b")).select(
        "a", "b", (1 - F.col("a")).alias("c"), F.lit(3.0).alias("k"),
        (F.col("a") + F.col("b")).alias("d"))
    kept = features.independent_columns(df.persist(), ["a", "b", "c", "d", "k"])
    assert len(kept) == 2 and "k" not in kept


def test_blocks_group_dummies_and_missing_flags():
    assert features.blocks(["geo_tier_TIER1", "geo_tier_TIER2", "pit_cod_share",
                            "pit_cod_share_missing"]) == {
        "geo_tier": ["geo_tier_TIER1", "geo_tier_TIER2"],
        "pit_cod_share": ["pit_cod_share", "pit_cod_share_missing"]}


def test_planted_levels_become_contrasts():
    c = features.planted_contrasts(P.RTO_COEFFICIENTS)
    assert c["geo_tier[TIER3]"] == pytest.approx(0.80) and "geo_tier[METRO]" not in c
    assert not [t for t in c if t.startswith("latent_")]


def test_design_learns_on_train_only(spark, model):
    view = views.training_input(model).persist()
    split = models.time_split(view)
    assert split.train.count() + split.test.count() == view.count()
    top = split.train.agg(F.max("session_start_ts")).first()[0]
    assert top < split.test.agg(F.min("session_start_ts")).first()[0]
    d = models.DesignMatrix("M1").fit(split.train)
    assert not [c for c in d.columns if c.startswith("payment_method")]
    out = d.transform(split.train, ["rto_flag"])
    m = features.moments(out, d.columns)
    assert all(abs(a) < 1e-6 and abs(s - 1) < 1e-6 for a, s in m.values())
    with pytest.raises(ValueError):
        models.DesignMatrix("M3")


def test_ship_rule_and_gates(spark):
    assert models.ship_rule(0.80, 0.77)[1] and not models.ship_rule(0.79, 0.77)[1]
    rows = {r.bar: r.ok for r in models.model_gates(spark.range(1), 0.73, 0.76).collect()}
    assert all(rows.values())


# ---- policy ------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def orders_by_tier(spark):
    rows = []
    for t, tier in enumerate(P.GEO_TIERS):
        for i in range(50):
            risk = i / 50
            rows.append((f"{tier}{i}", tier, "COD" if i % 2 else "PREPAID", i >= 35, i % 10 == 0,
                         i % 7 != 0, 0.2 * t + 0.18 * risk,
                         Decimal("-300.00") if i >= 35 else Decimal("110.00")))
    return spark.createDataFrame(rows, "session_id string, geo_tier string, "
                                 "payment_method string, rto_flag boolean, "
                                 "pit_has_clean_record boolean, pit_has_history boolean, "
                                 "score double, contribution_margin decimal(10,2)").persist()


def test_per_tier_rule_equalises_before_protections(orders_by_tier):
    r = policy.restricted(orders_by_tier, [0.1], protections=False)
    n = {(x.rule, x.geo_tier): x["count"] for x in r.groupBy("rule", "geo_tier").count().collect()}
    assert {n[("per-tier", t)] for t in P.GEO_TIERS} == {5}
    assert n.get(("global", "TIER3")) == 20 and ("global", "METRO") not in n


def test_protections_release_protected_orders(orders_by_tier):
    kept = policy.restricted(orders_by_tier, P.FAIRNESS_VOLUMES).where("kept")
    assert kept.where("pit_has_clean_record or not pit_has_history").count() == 0
    s = {r.tier: r for r in policy.overlay_summary(
        orders_by_tier.withColumn("tier", F.lit("HIGH"))).collect()}
    assert s["HIGH"].n_raw == 200 and s["MED"].n_final == s["HIGH"].reclassified_out


def test_global_rule_escalates(orders_by_tier):
    a = policy.geo_audit(orders_by_tier, [0.1]).first()
    assert a.verdict == "ESCALATE" and a.tier3_over_metro is None


def test_ties_at_the_cut_stay_selected(spark, orders_by_tier):
    flat = orders_by_tier.withColumn("score", F.lit(0.5))
    assert policy.restricted(flat, [0.05], protections=False).where("rule = 'global'").count() \
        == 200


def test_switching_changes_only_the_earned_part(spark, orders_by_tier):
    prepaid = spark.createDataFrame([(0.1, 100.0, -200.0)],
                                    "prepaid_rto_rate double, cm_delivered double, cm_rto double")
    rows = policy.conversion_sensitivity(orders_by_tier, prepaid, 2.0, 0.25).orderBy(
        "cod_switch_share").collect()
    assert rows[0].switched_order_ev == pytest.approx(70.0)
    step = rows[1].global_delta_cm - rows[0].global_delta_cm
    assert rows[2].global_delta_cm - rows[1].global_delta_cm == pytest.approx(step)


# ---- reasons ----------------------------------------------------------------------------------
def test_posterior_gates(model):
    d = reasons.reason_drivers(model)
    p = reasons.reason_posterior(d).join(d.select("order_id", "is_cod", "pit_orders_delivered"),
                                         "order_id")
    cash = F.col("posterior")[P.CASH_REASON]
    low = F.col("posterior")[P.LOW_INTENT_REASON]
    total = F.aggregate(F.map_values("posterior"), F.lit(0.0), lambda a, b: a + b)
    assert p.where(~F.col("is_cod") & (cash > 0)).count() == 0
    assert p.where((F.col("pit_orders_delivered") >= 5) & (low > 0)).count() == 0
    assert p.where(F.abs(total - 1) > 1e-9).count() == 0


# ---- quality ----------------------------------------------------------------------------------
def test_null_satisfies_a_rule_and_false_breaks_it(spark, model):
    bad = model["dim_seller"].withColumn("seller_rating", F.when(
        F.col("seller_id") == F.lit("SEL_0000000001"), F.lit(9.9)).when(
        F.col("seller_id") == F.lit("SEL_0000000002"), F.lit(None)).otherwise(
        F.col("seller_rating")))
    v = {r.rule: r.violations for r in Q.constraint_violations(bad, "dim_seller").collect()}
    assert v["seller_rating_in_range"] == 1


def test_all_rules_hold_on_the_canonical_tables(model):
    rows = Q.all_constraints(model, [t for t in schemas.RULES
                                     if t != "truth_order_probability"]).where("violations > 0")
    assert rows.collect() == []


def test_orphans_and_duplicates_are_found(spark):
    t = {"a": spark.createDataFrame([(1,), (2,), (None,)], "x int"),
         "b": spark.createDataFrame([(1,)], "y int")}
    assert Q.orphans(t, [("a", "x", "b", "y")]).first().orphans == 1


def _results(spark, rows):
    return spark.createDataFrame([(f"T{i}", "n", s, st, "", "", "") for i, (s, st) in
                                  enumerate(rows)], Q.RESULT)


@pytest.mark.parametrize("rows,want", [
    ([("HARD", "PASS")], "DATASET READY"), ([("HARD", "FAIL")], "NOT READY"),
    ([("SOFT", "FAIL")] * 6, "NOT READY"), ([("SOFT", "FAIL")] * 3, "CONDITIONAL"),
    ([("HARD", "SKIP"), ("SOFT", "PASS")], "CONDITIONAL")])
def test_verdict(spark, rows, want):
    assert Q.verdict(_results(spark, rows)).first().verdict == want


def test_attempt_delay_check_sees_an_empty_arm(spark):
    orders = spark.createDataFrame(
        [(f"d{i}", True, False, False) for i in range(6)]
        + [(f"r{i}", True, False, True) for i in range(4)]
        + [("x", False, False, None), ("c", True, True, None)],
        "order_id string, is_shipped boolean, is_censored boolean, rto_flag boolean")
    ev = [(f"r{i}", 1, 2) for i in range(4)] + [(f"d{i}", 1, 0) for i in range(6)]
    ok = lambda rows: {r.arm: r.ok for r in Q.attempt_delay_check(
        orders, spark.createDataFrame(rows, "order_id string, attempt_number int, "
                                      "attempt_delay_days int")).collect()}
    assert ok(ev) == {"delivered": True, "returned": True}
    assert ok(ev[:4]) == {"delivered": False, "returned": True}
    assert ok([*ev, ("r0", 1, 3)]) == {"delivered": True, "returned": False}


def test_sweep_flags_a_conditional_column(spark, model):
    t = {"fct_order": model["fct_order"], "fct_delivery_event": model["fct_delivery_event"]}
    flagged = {r.declaration for r in Q.conditional_sweep(t, list(t)).collect()}
    assert "fct_order.rto_reason@rto_flag" in flagged
    assert "fct_order.order_value@rto_flag" not in flagged
    verdicts = Q.sweep_against_allowlist(Q.conditional_sweep(t, list(t)), ["x.y@z"])
    assert verdicts.where("verdict = 'STALE'").count() == 1
    assert Q.sweep_check(verdicts).first().status == "FAIL"


def test_fairness_publication(spark):
    mk = lambda rows: spark.createDataFrame(rows, "volume double, ratio double, stale boolean")
    good = [(v, 1.3, False) for v in P.FAIRNESS_VOLUMES]
    status = lambda rows: Q.fairness_check(mk(rows)).first().status
    assert status(good) == "PASS"
    assert status(good[:3]) == "SKIP"
    assert status([(v, r, True) for v, r, _ in good]) == "SKIP"
    assert status([*good[:3], (0.25, 3.0, False)]) == "FAIL"
    assert status([*good[:3], (0.25, None, False)]) == "FAIL"


def test_selection_share_needs_a_positive_gap(spark):
    f = lambda n, a: Q.selection_share(spark.createDataFrame(
        [(n, a)], "naive_gap_pp double, average_marginal_effect_pp double")).first().status
    assert (f(15.0, 10.0), f(15.0, 14.0), f(-1.0, 1.0)) == ("PASS", "FAIL", "FAIL")


def test_reason_weights_are_frozen(spark, monkeypatch):
    assert Q.frozen_reasons_check(spark).first().status == "PASS"
    monkeypatch.setitem(P.REASON_DRIVERS["OTHER_UNCLASSIFIED"], "latent_intent_z", 0.1)
    assert Q.frozen_reasons_check(spark).first().status == "FAIL"
    monkeypatch.undo()
    assert sum(v[0] for v in P.REASONS.values()) == pytest.approx(1.0)


def test_closed_share():
    assert causal.closed_share(12.0, 10.0, 18.0) == pytest.approx(0.75)
    assert causal.closed_share(1.0, 2.0, 2.0) is None


# ---- sources ----------------------------------------------------------------------------------
def test_write_and_read_back(spark, model, tmp_path):
    some = {t: src.conform(model[t], schemas.schema(t)) for t in ("dim_geography", "dim_seller",
                                                                  "fct_order")}
    counts = src.write_all(some, str(tmp_path))
    src.require_equal(counts)
    back = src.load(spark, str(tmp_path), "fct_order")
    a, b = artefacts.fingerprint(back).first(), artefacts.fingerprint(some["fct_order"]).first()
    assert a == b
    src.write_all({"dim_geography": some["dim_geography"]}, str(tmp_path))
    assert not (tmp_path / "fct_order").exists()


def test_row_count_mismatch_stops(spark):
    with pytest.raises(src.ContractError):
        src.require_equal(spark.createDataFrame([("t", 2, 1, False)],
                                                "`table` string, sent int, landed int, ok boolean"))


def test_conform_and_preflight(spark, model):
    with pytest.raises(src.ContractError, match="absent"):
        src.conform(model["dim_seller"].drop("seller_tier"), schemas.schema("dim_seller"))
    odd = model["dim_seller"].drop("seller_tier").withColumn("seller_name", F.lit(None)).withColumn(
        "extra", F.lit(1))
    s = {r.column: r.status for r in src.preflight(odd, "dim_seller").collect()}
    assert (s["seller_tier"], s["seller_name"], s["extra"]) == ("ABSENT", "ALL NULL", "UNDECLARED")


def test_fingerprint_ignores_order_and_sees_change(spark, model):
    g = model["dim_geography"]
    a = artefacts.fingerprint(g).first()
    assert a == artefacts.fingerprint(g.orderBy(F.desc("geography_id"))).first()
    changed = g.withColumn("city_name", F.when(F.col("geography_id") == "GEO_0000", "X")
                           .otherwise(F.col("city_name")))
    assert a.content_hash != artefacts.fingerprint(changed).first().content_hash


def test_published_checks_go_stale(spark, model, tmp_path):
    checks = spark.createDataFrame([(0.05, 1.3)], "volume double, ratio double")
    artefacts.publish_checks(checks, model["dim_geography"], f"{tmp_path}/c")
    read = lambda df: artefacts.read_checks(spark, f"{tmp_path}/c", df,
                                            "volume double, ratio double").first().stale
    assert read(model["dim_geography"]) is False and read(model["dim_seller"]) is True


def test_load_order_puts_parents_first():
    order = src.load_order()
    for child, _, parent, _ in schemas.FOREIGN_KEYS:
        if (child, parent) != ("fct_checkout_session", "fct_order"):
            assert order.index(parent) < order.index(child)


def test_long_keys_are_not_cut(spark):
    from doorstep.sources.driver_model import _id
    got = spark.sql(f"SELECT {_id('ORD', 'k')} AS i FROM VALUES (7), (123456789012), (123456789013) AS t(k)")
    assert sorted(r.i for r in got.collect()) == ["ORD_0000000007", "ORD_123456789012", "ORD_123456789013"]


def test_an_order_takes_part_and_supplier_of_its_first_line(model):
    first = model["lineitem"].groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    pairs = model["lineitem"].join(first, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", F.col("l_partkey").alias("lpk"), F.col("l_suppkey").alias("lsk"))
    made = model["order_lines"].drop("n_lines")
    assert made.count() == first.count() and made.join(pairs, made.columns, "left_anti").isEmpty()


def test_every_level_becomes_a_dummy(spark):
    from doorstep.operators.features import dummies
    frame = spark.range(300).select(F.format_string("v%03d", "id").alias("c"))
    assert len(dummies(frame, ["c"])) == 299
