"""Constraint replay, result rows, verdict, and the data-quality and validation families.

Each check becomes one row ``(test_id, name, severity, status, expected, actual, detail)``.
Counting checks on one table share one scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from .. import schemas
from ..functions.scalar import flag, katz_columns, ratio
from ..session import keep
from .economics import annualised_exposure, exemplar
from .rangesum import DAY_BITS, SECOND_BITS, totals_before
from .ranks import quantile_bins, quantiles, spearman
from .views import resolved

Tables = Mapping[str, DataFrame]
RESULT = ("test_id string, name string, severity string, status string, expected string, "
          "actual string, detail string")


# ---- constraints ---------------------------------------------------------------------------
def constraint_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that make each rule FALSE (NULL satisfies a rule), all rules in one scan."""
    rules = schemas.RULES[table]
    one = df.agg(*[F.count_if(F.expr(f"({rule}) IS FALSE")).alias(f"r{i}")
                   for i, (_, rule) in enumerate(rules)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table"), F.lit(name).alias("rule"),
                 F.col(f"r{i}").alias("violations")) for i, (name, _) in enumerate(rules)])))


def all_constraints(t: Tables, tables: Iterable[str] | None = None) -> DataFrame:
    out = None
    for name in tables or schemas.RULES:
        rows = constraint_violations(t[name], name)
        out = rows if out is None else out.unionByName(rows)
    return out


def orphans(t: Tables, links: Sequence[tuple[str, str, str, str]] = schemas.FOREIGN_KEYS
            ) -> DataFrame:
    """Per reference: child rows (key not NULL) without a parent."""
    out = None
    for child, column, parent, key in links:
        c = t[child].where(F.col(column).isNotNull()).select(F.col(column).alias("k"))
        p = t[parent].select(F.col(key).alias("k"))
        row = c.join(p, "k", "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(
            F.lit(f"{child}.{column}").alias("reference"), F.lit(parent).alias("parent"),
            "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def duplicate_keys(t: Tables, tables: Iterable[str]) -> DataFrame:
    """Surplus rows per declared primary key."""
    out = None
    for name in tables:
        per_key = t[name].groupBy(*schemas.PRIMARY_KEYS[name]).agg(
            F.count(F.lit(1)).alias("n"))
        row = per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus")).select(
            F.lit(name).alias("table"), "surplus")
        out = row if out is None else out.unionByName(row)
    return out


def missing_required(df: DataFrame, table: str) -> DataFrame:
    """NULLs in required columns."""
    from ..sources.tables import _long
    cols = schemas.required(table)
    return _long(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]), cols, "column",
                 "nulls")


# ---- result rows -----------------------------------------------------------------------------
def check(df: DataFrame, test_id: str, name: str, severity: str, ok: Column, expected: str,
          actual: Column, detail: str = "") -> DataFrame:
    """Turn a one-row frame into a result row; an undefined verdict is SKIP, never PASS."""
    status = F.when(ok.isNull(), "SKIP").when(ok, "PASS").otherwise("FAIL")
    return df.select(
        F.lit(test_id).alias("test_id"), F.lit(name).alias("name"),
        F.lit(severity).alias("severity"), status.alias("status"),
        F.lit(expected).alias("expected"), F.coalesce(actual.cast("string"), F.lit("undefined"))
        .alias("actual"), F.lit(detail).alias("detail"))


def skip(spark, test_id: str, name: str, severity: str, reason: str) -> DataFrame:
    return spark.createDataFrame(
        [(test_id, name, severity, "SKIP", "-", "not runnable", reason)], RESULT)


def in_band(value: Column, target: float, tol: float) -> Column:
    return F.abs(value.cast("double") - target) <= tol


def union(rows: Sequence[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def verdict(results: DataFrame) -> DataFrame:
    """NOT READY on a HARD failure or more than five SOFT ones; a HARD skip caps at
    CONDITIONAL, as do three SOFT failures."""
    is_ = lambda sev, st: (F.col("severity") == sev) & (F.col("status") == st)
    one = results.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(is_("HARD", "FAIL")).alias("hard_failed"),
        F.count_if(is_("SOFT", "FAIL")).alias("soft_failed"),
        F.count_if(is_("HARD", "SKIP")).alias("hard_skipped"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_("HARD", "FAIL"), F.col("test_id")))),
                     ",").alias("failed_ids"))
    return one.withColumn("verdict", F.when((F.col("hard_failed") > 0)
                                            | (F.col("soft_failed") > 5), "NOT READY")
                          .when((F.col("hard_skipped") > 0) | (F.col("soft_failed") >= 3),
                                "CONDITIONAL").otherwise("DATASET READY"))


# ---- families ----------------------------------------------------------------------------------
def volume_checks(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    orders = t["fct_order"].agg(n.alias("n"), F.count_distinct("customer_id").alias("c"))
    sessions = t["fct_checkout_session"].agg(
        n.alias("n"), F.count_if(F.col("order_id").isNotNull()).alias("o"))
    both = sessions.withColumn("orders", orders.select("n").scalar())
    lo, hi = P.VOLUME_SESSION_BAND
    drift = F.abs(ratio("orders", "n") - ratio("o", "n"))
    dims = None
    for name, target in P.DIMENSION_TARGETS.items():
        row = t[name].agg(n.alias("n")).select(
            (F.abs(F.col("n") - target) / target <= 0.01).alias("ok"))
        dims = row if dims is None else dims.unionByName(row)
    dims = dims.agg(F.bool_and("ok").alias("ok"), F.count_if("ok").alias("k"))
    c = F.col
    return union([
        check(orders, "VOL-01", "order rows", "HARD", c("n") >= P.VOLUME_MIN_ORDERS,
              f">= {P.VOLUME_MIN_ORDERS}", c("n")),
        check(sessions, "VOL-02a", "session rows in band", "SOFT", c("n").between(lo, hi),
              f"[{lo}, {hi}]", c("n")),
        check(both, "VOL-02b", "orders per session agrees with converted sessions", "HARD",
              drift < P.CONVERSION_DRIFT, f"< {P.CONVERSION_DRIFT}", drift),
        check(orders, "VOL-03", "customers with an order", "SOFT",
              c("c") >= P.VOLUME_MIN_CUSTOMERS, f">= {P.VOLUME_MIN_CUSTOMERS}", c("c")),
        check(dims, "VOL-04", "dimension tables within 1 %", "HARD", c("ok"), "4 of 4", c("k"))])


def calibration_checks(t: Tables) -> DataFrame:
    rto, cod = flag("rto_flag"), F.col("payment_method") == "COD"
    res = F.col("is_shipped") & ~F.col("is_censored")
    n = F.count(F.lit(1))
    o = t["fct_order"].agg(
        n.alias("orders"), ratio(F.count_if(cod), n).alias("cod_share"),
        ratio(F.count_if(~cod), n).alias("prepaid_share"),
        ratio(F.count_if(res & cod & rto), F.count_if(res & cod)).alias("rto_rate_cod"),
        ratio(F.count_if(res & ~cod & rto), F.count_if(res & ~cod)).alias("rto_rate_prepaid"),
        ratio(F.count_if(res & rto), F.count_if(res)).alias("rto_rate_blended"),
        ratio(F.count_if(F.col("paid_via_switch")), F.count_if(cod))
        .alias("pct_cod_from_payment_failure"))
    sessions = t["fct_checkout_session"].agg(n.alias("s")).scalar()
    o = o.withColumn("checkout_conversion", ratio(F.col("orders"), sessions))
    e = t["fct_order"].select("order_id", "rto_reason_class").where(
        F.col("rto_reason_class").isNotNull()).join(
        t["fct_order_economics"].select("order_id", "rto_economic_cost"), "order_id").agg(
        ratio(F.sum(F.when(F.col("rto_reason_class") == "ADDRESSABLE",
                           F.col("rto_economic_cost"))), F.sum("rto_economic_cost"))
        .alias("addressable_share_of_rto"))
    ids = ("cod_share", "prepaid_share", "rto_rate_cod", "rto_rate_prepaid", "rto_rate_blended",
           "checkout_conversion", "pct_cod_from_payment_failure", "addressable_share_of_rto")
    rows = []
    for i, key in enumerate(ids, 1):
        target, tol, severity = P.CALIBRATION[key]
        src = e if key == "addressable_share_of_rto" else o
        rows.append(check(src, f"CAL-0{i}", key, severity, in_band(F.col(key), target, tol),
                          f"{target} +/-{tol}", F.col(key)))
    return union(rows)


def coefficient_ledger(spark, used: Mapping[str, float], declared: Mapping[str, float],
                       complete: bool = True) -> DataFrame:
    """CAL-09: used against declared values, missing ones both ways; tolerance zero."""
    u = spark.createDataFrame(list(used.items()) or [("", None)], "term string, used double")
    d = spark.createDataFrame(list(declared.items()), "term string, declared double")
    j = u.where("term <> ''").join(d, "term", "full_outer")
    verdict_ = (F.when(F.col("declared").isNull(), "UNDECLARED")
                .when(F.col("used").isNull(), "UNUSED" if complete else "NOT YET USED")
                .when(F.col("used") == F.col("declared"), "SAME").otherwise("DIFFERS"))
    return j.withColumn("verdict", verdict_)


def frozen_reasons_hash() -> str:
    """CAL-10: hash of the reason weights, driver weights and classes."""
    import hashlib
    import json
    body = {"base": {k: v[0] for k, v in P.REASONS.items()},
            "class": {k: v[1] for k, v in P.REASONS.items()}, "drivers": P.REASON_DRIVERS}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def frozen_reasons_check(spark) -> DataFrame:
    """CAL-10 row: the weights in force are the approved ones."""
    now = frozen_reasons_hash()
    return check(spark.range(1), "CAL-10", "return-reason weights are frozen", "HARD",
                 F.lit(now == P.REASONS_SHA256), P.REASONS_SHA256[:16], F.lit(now[:16]))


def selection_share(effect: DataFrame) -> DataFrame:
    """CAL-11 on a ``planted_effect`` row; a gap that is not positive fails."""
    lo, hi = P.SELECTION_SHARE_BAND
    share = F.when(F.col("naive_gap_pp") > 0,
                   (F.col("naive_gap_pp") - F.col("average_marginal_effect_pp"))
                   / F.col("naive_gap_pp"))
    return check(effect, "CAL-11", "selection share of the naive gap", "HARD",
                 F.coalesce(share.between(lo, hi), F.lit(False)), f"[{lo}, {hi}]", share)


def economics_checks(t: Tables) -> DataFrame:
    o = t["fct_order"]
    n = F.count(F.lit(1))
    means = o.agg(ratio(F.sum("gmv"), n).alias("gmv"), ratio(F.sum("order_value"), n).alias("v"),
                  ratio(F.lit(P.POPULATION_ANNUAL_ORDERS), n).alias("factor"))
    median = quantiles(o, "order_value", [0.5])
    exposure = annualised_exposure(o, t["fct_order_economics"])
    c, rows = F.col, []
    for test, key, src, col in (("EC-01", "mean_gmv_per_order", means, c("gmv")),
                                ("EC-01b", "mean_order_value_per_order", means, c("v")),
                                ("EC-02", "median_order_value", median, c("q0"))):
        target, tol, severity = P.CALIBRATION[key]
        rows.append(check(src, test, key, severity, in_band(col, target, tol),
                          f"{target} +/-{tol}", col))
    shown = exemplar()
    for i, (key, (target, tol)) in enumerate(P.RECONCILIATION.items(), 3):
        value = F.lit(shown[key])
        rows.append(check(means, f"EC-0{i}", key, "HARD", in_band(value, target, tol),
                          f"{target} +/-{tol}", F.round(value, 4)))
    lo, hi = P.EXPOSURE_BAND_CR
    rows.append(check(exposure, "EC-07", "annual exposure in crore", "SOFT",
                      c("exposure_cr").between(lo, hi), f"[{lo}, {hi}]", c("exposure_cr")))
    lo, hi = P.ANNUAL_FACTOR_BAND
    rows.append(check(means, "EC-08", "derived annual factor", "HARD", c("factor").between(lo, hi),
                      f"[{lo}, {hi}]", c("factor")))
    return union(rows)


def odds_ratio(df: DataFrame, outcome: Column, in_a: Column, in_b: Column) -> DataFrame:
    """Odds of ``outcome`` in group a over group b; infinite when a needed cell is empty."""
    k = F.count_if
    one = df.agg(k(in_a & outcome).alias("a1"), k(in_a & ~outcome).alias("a0"),
                 k(in_b & outcome).alias("b1"), k(in_b & ~outcome).alias("b0"))
    value = F.when((F.col("a0") == 0) | (F.col("b1") == 0), F.lit(float("inf"))).otherwise(
        ratio("a1", "a0") / F.greatest(ratio("b1", F.greatest("b0", F.lit(1))), F.lit(1e-9)))
    return one.withColumn("odds_ratio", value)


def band_shares(df: DataFrame, value: str, outcome: Column, bands: int) -> DataFrame:
    """Outcome share per quantile band of ``value``."""
    b = quantile_bins(df, value, bands, "band")
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("n"),
                                 ratio(F.count_if(outcome), F.count(F.lit(1))).alias("share"))


def behaviour_checks(t: Tables) -> DataFrame:
    """BR-01 … BR-08, BR-10, BR-11 (BR-09 comes with the deviance comparison)."""
    cod, rto = F.col("payment_method") == "COD", flag("rto_flag")
    st = t["fct_customer_state_at_session"].select("session_id", "pit_is_new_customer",
                                                   "pit_rto_count", "pit_cod_share")
    s = t["fct_checkout_session"].select("session_id", "address_completeness_score")
    d = t["dim_date"].select(F.col("date_id").alias("order_date"), "is_month_end_window")
    j = keep(t["fct_order"].select(
        "order_id", "session_id", "product_id", "seller_id", "order_date", "order_value",
        "payment_method", "paid_via_switch", "rto_flag", "rto_reason", "is_shipped",
        "is_censored").join(st, "session_id").join(s, "session_id").join(d, "order_date")
        .join(t["dim_seller"].select("seller_id", "seller_rating"), "seller_id")
        .join(t["dim_product"].select("product_id", "product_rating"), "product_id"))
    base, c = resolved(j), F.col
    share = lambda cond, y: ratio(F.count_if(cond & y), F.count_if(cond))
    new = c("pit_is_new_customer")
    one = j.agg((share(new, cod) - share(~new, cod)).alias("br1"),
                ratio(F.count_if(c("paid_via_switch")), F.count_if(cod)).alias("br7"))
    prior = F.coalesce(c("pit_rto_count"), F.lit(0)) > 0
    cells = base.agg(F.count_if(prior).alias("n1"), F.count_if(prior & rto).alias("x1"),
                     F.count_if(~prior).alias("n0"), F.count_if(~prior & rto).alias("x0"))
    katz = cells.select(*katz_columns(c("x1"), c("n1"), c("x0"), c("n0")))
    odds = odds_ratio(j.where(c("pit_cod_share").isNotNull()), cod, c("pit_cod_share") >= 0.75,
                      c("pit_cod_share") <= 0.25)
    spread = lambda col: band_shares(j, col, cod, 4).agg(
        (F.max("share") - F.min("share")).alias("v"))
    peak = band_shares(j, "order_value", cod, 10).agg(
        F.min_by("band", F.struct(-c("share"), c("band"))).alias("v"))
    reasons = base.where(c("rto_reason").isNotNull())
    banded = quantile_bins(reasons, "address_completeness_score", 4, "band").withColumn(
        "hit", (c("rto_reason") == "ADDRESS_INCORRECT_INCOMPLETE").cast("int"))
    grad = banded.groupBy("band").agg(F.avg("hit").alias("s")).agg(
        F.try_divide(F.min_by("s", "band"), F.max_by("s", "band")).alias("g"))
    rho, p = spearman(banded.select("band", "hit"), "band", "hit")
    month = base.where(cod).agg(
        ((share(c("is_month_end_window"), rto) - share(~c("is_month_end_window"), rto)) * 100)
        .alias("v"))
    switch = base.where(cod).agg(((share(~c("paid_via_switch"), rto)
                                   - share(c("paid_via_switch"), rto)) * 100).alias("v"))
    ok8 = (c("g") >= 1.40) & F.lit(rho is not None and rho < 0 and p < 0.01)
    return union([
        check(one, "BR-01", "new customers use COD more", "HARD", c("br1") >= 0.10, ">= 0.10",
              c("br1")),
        check(katz, "BR-02", "prior-return lift, interval floor", "HARD", c("ci_low") > 1.5,
              "> 1.50", c("ci_low")),
        check(odds, "BR-03", "COD share predicts COD", "HARD", c("odds_ratio") >= 2.5, ">= 2.5",
              c("odds_ratio")),
        check(spread("seller_rating"), "BR-04", "COD spread over seller rating", "SOFT",
              c("v") >= 0.04, ">= 0.04", c("v")),
        check(spread("product_rating"), "BR-05", "COD spread over product rating", "SOFT",
              c("v") >= 0.03, ">= 0.03", c("v")),
        check(peak, "BR-06", "COD share peaks inside the deciles", "SOFT", c("v").between(5, 8),
              "band 5-8 from 0", c("v")),
        check(one, "BR-07", "payment failure precedes some COD", "HARD",
              c("br7").between(0.04, 0.10), "[0.04, 0.10]", c("br7")),
        check(grad, "BR-08", "address reason rises as completeness falls", "HARD", ok8,
              "gradient >= 1.40, rank correlation < 0 at p < 0.01", c("g"),
              f"rho {rho}, p {p}"),
        check(month, "BR-10", "month-end COD return lift", "SOFT", c("v") >= 1.5, ">= 1.5 pp",
              c("v")),
        check(switch, "BR-11", "switch-COD returns less than intent-COD", "HARD", c("v") >= 5.0,
              ">= 5 pp", c("v"))])


def leakage_checks(t: Tables, view_columns: Sequence[str], auc_ceiling: float | None,
                   used_priors: Mapping[str, float]) -> DataFrame:
    """LK-01, LK-02, LK-03 and LK-06 (LK-04 is :func:`pit_integrity`)."""
    spark = t["fct_order"].sparkSession
    one = spark.range(1)
    outside = sorted(set(view_columns) - set(P.SAFE_COLUMNS))
    overlap = sorted(set(P.SAFE_COLUMNS) & set(P.BLOCKED_COLUMNS))
    declared = {"rto": P.RTO_PRIOR, "cod": P.COD_PRIOR, "payment": P.PAYMENT_FAILURE_PRIOR,
                "k": float(P.SHRINKAGE_K)}
    moved = sorted(k for k, v in used_priors.items() if float(v) != declared[k])
    rows = [check(one, "LK-01", "view columns inside the whitelist", "HARD",
                  F.lit(not outside), "none outside", F.lit(",".join(outside) or "none")),
            check(one, "LK-02", "whitelist and block list are disjoint", "HARD",
                  F.lit(not overlap), "no overlap", F.lit(",".join(overlap) or "none")),
            check(one, "LK-06", "declared priors are the ones used", "HARD", F.lit(not moved),
                  "exact", F.lit(",".join(moved) or "same"))]
    rows.append(skip(spark, "LK-03", "safe-feature AUC below the guard", "HARD", "no ceiling")
                if auc_ceiling is None else
                check(one, "LK-03", "safe-feature AUC below the guard", "HARD",
                      F.lit(auc_ceiling < P.AUC_LEAK_LIMIT), f"< {P.AUC_LEAK_LIMIT}",
                      F.lit(auc_ceiling)))
    return union(rows)


#: Stored counter, what it starts from, and the re-derived sum that is added to it.
REDERIVED = {
    "pit_orders_placed": ("pre_window_orders", "placed"),
    "pit_orders_delivered": ("pre_window_delivered", "delivered"),
    "pit_orders_resolved": ("pre_window_delivered + pre_window_rto_count", "resolved"),
    "pit_rto_count": ("pre_window_rto_count", "rto"),
    "pit_cod_orders": ("pre_window_cod_orders", "cod"),
    "pit_prepaid_success_count": ("pre_window_prepaid_success", "success"),
    "pit_payment_failure_count": ("pre_window_payment_failures", "failure"),
}


def rederived_counters(t: Tables) -> DataFrame:
    """The ``pit_*`` counters of every session from orders, sessions and seeds, by range sums.

    Nothing is shared with the stored state's own path but the rules: placements and payment
    results count from the next second, outcomes from the day after they resolved.
    """
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    day = lambda c: F.unix_date(F.col(c))
    o, s = t["fct_order"], t["fct_checkout_session"]
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    zero = F.lit(0).cast("long")
    attempts = F.col("payment_attempt_count")
    failed = (attempts > 0) & ((attempts > 1) | F.col("switched_to_cod_after_failure")
                               | (F.col("abandon_step") == "PAYMENT_FAILURE"))
    moments = o.select("customer_id", second("order_ts").alias("at"), F.lit(1).cast("long").alias("placed"),
                       one(F.col("payment_method") == "COD").alias("cod"), zero.alias("success"),
                       zero.alias("failure")).unionByName(s.select(
        "customer_id", second("session_start_ts").alias("at"), zero.alias("placed"), zero.alias("cod"),
        one(F.col("final_payment_method") == "PREPAID").alias("success"), one(failed).alias("failure")))
    outcomes = o.where("outcome_resolved_date IS NOT NULL").select(
        "customer_id", day("outcome_resolved_date").alias("day"), F.lit(1).cast("long").alias("resolved"),
        one(F.col("rto_flag")).alias("rto"), one(F.col("is_delivered")).alias("delivered"))
    keys = s.select("session_id", "customer_id", second("session_start_ts").alias("at"), day("date_id").alias("day"))
    # each by itself, so that what the one shuffles is gone when the other begins
    early = keep(totals_before(keys, moments, "customer_id", "at", ["placed", "cod", "success", "failure"], SECOND_BITS))
    known = keep(totals_before(keys, outcomes, "customer_id", "day", ["resolved", "rto", "delivered"], DAY_BITS))
    seeds = t["customer_base"].select("customer_id", *[c for c in t["customer_base"].columns if c.startswith("pre_window_")])
    j = keys.join(early, ["customer_id", "at"]).join(known, ["customer_id", "day"]).join(seeds, "customer_id")
    return j.select("session_id", *[(F.expr(seed) + F.col(inner)).cast("long").alias(c)
                                    for c, (seed, inner) in REDERIVED.items()])


def pit_mismatches(t: Tables) -> DataFrame:
    """One row for each counter: sessions compared, and those whose stored value is another or missing."""
    # before the re-derivation, which then reads the orders and sessions the state has kept
    stored = t["fct_customer_state_at_session"].select("session_id", *[F.col(c).alias(f"_{c}") for c in REDERIVED])
    j = rederived_counters(t).join(stored, "session_id", "full_outer")
    wrong = [F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}").cast("long"))).alias(c) for c in REDERIVED]
    one = j.agg(F.count(F.lit(1)).alias("sessions"), *wrong)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col("sessions"), F.col(c).alias("mismatches"))
                                         for c in REDERIVED])))


def pit_integrity(t: Tables) -> DataFrame:
    """LK-04: every stored point-in-time counter against its re-derivation."""
    wrong = F.transform(F.array_sort(F.collect_list(F.when(F.col("mismatches") > 0, F.struct("counter", "mismatches")))),
                        lambda x: F.concat_ws(" ", x["counter"], x["mismatches"]))
    one = pit_mismatches(t).agg(F.sum("mismatches").alias("bad"), F.array_join(wrong, ", ").alias("which"))
    return check(one, "LK-04", "point-in-time integrity", "HARD", F.col("bad") == 0, "0",
                 F.when(F.col("bad") == 0, F.lit("0")).otherwise(F.col("which")))


def _bad(df: DataFrame, cond: Column) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(cond, F.lit(False))).alias("v"))


def zero(df: DataFrame, test_id: str, name: str, severity: str = "HARD") -> DataFrame:
    return check(df, test_id, name, severity, F.col("v") == 0, "0", F.col("v"))


def order_quality_checks(t: Tables) -> DataFrame:
    """DQ-02 … DQ-14 in the counting form."""
    c, o, rto = F.col, t["fct_order"], flag("rto_flag")
    cod = c("payment_method") == "COD"
    dupes = duplicate_keys(t, ("fct_order", "fct_checkout_session", "dim_customer",
                               "dim_product")).agg(F.sum("surplus").alias("v"))
    links = [f for f in schemas.FOREIGN_KEYS if f[0] == "fct_order"
             and f[1] in ("customer_id", "product_id", "session_id")]
    lost = orphans(t, links).agg(F.sum("orphans").alias("v"))
    e = t["fct_order_economics"]
    signed = {"order_id", "contribution_margin", "counterfactual_cm_if_delivered", "foregone_cm",
              "rto_cash_loss", "rto_economic_cost"}
    negative = e.agg(sum((F.count_if(c(x) < -0.01) for x in e.columns if x not in signed),
                         F.lit(0)).alias("v"))
    j = o.select("session_id", "order_ts").join(
        t["fct_checkout_session"].select("session_id", "session_start_ts"), "session_id")
    one = o.agg(
        F.count_if(c("outcome_resolved_date") < c("order_date")).alias("dq6"),
        F.count_if(rto & (~c("is_shipped") | flag("is_delivered"))).alias("dq8"),
        F.count_if(c("is_cancelled_preship") & (c("is_shipped") | rto)).alias("dq9"),
        F.count_if(F.coalesce(c("rto_reason") == P.CASH_REASON, F.lit(False)) & ~cod)
        .alias("dq11"),
        sum((F.count_if(c(x).isNull()) for x in ("order_id", "customer_id", "payment_method",
                                                 "gmv", "order_value", "is_shipped",
                                                 "is_censored")), F.lit(0)).alias("dq12"),
        F.count_if(c("payment_rail").isNull() != cod).alias("dq13"))
    at = lambda col: one.select(c(col).alias("v"))
    pairs = o.select("order_id").join(e.groupBy("order_id").agg(F.count(F.lit(1)).alias("k")),
                                      "order_id", "full_outer")
    last = o.agg(F.max("order_date").alias("d")).scalar()
    late = o.where(c("is_shipped") & (c("order_date") > F.date_sub(last, P.LATE_WINDOW_DAYS)))
    tail = late.agg(F.coalesce(ratio(F.count_if(c("is_censored")), F.count(F.lit(1))),
                               F.lit(0.0)).alias("v"))
    return union([
        zero(dupes, "DQ-02", "duplicate primary keys"),
        zero(lost, "DQ-03", "orphan references"), zero(negative, "DQ-04", "negative cost lines"),
        zero(_bad(j, c("order_ts") < c("session_start_ts")), "DQ-05", "order before session"),
        zero(at("dq6"), "DQ-06", "resolved before ordered"),
        zero(at("dq8"), "DQ-08", "return not shipped or also delivered"),
        zero(at("dq9"), "DQ-09", "cancelled but shipped or returned"),
        zero(_bad(pairs, ~c("k").eqNullSafe(F.lit(1))), "DQ-10", "not one economics row"),
        zero(at("dq11"), "DQ-11", "cash reason on a prepaid order"),
        zero(at("dq12"), "DQ-12", "missing required values"),
        zero(at("dq13"), "DQ-13", "rail missing iff COD"),
        check(tail, "DQ-14", "censoring present in the late window", "HARD",
              c("v") >= P.MIN_LATE_CENSORED_SHARE, f">= {P.MIN_LATE_CENSORED_SHARE}", c("v"))])


def ledger_checks(t: Tables) -> DataFrame:
    """DQ-07: order ledger identity, resolved-only rate, exclusions explained."""
    c = F.col
    per = t["fct_order"].groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("rto_flag").alias("d"),
        F.count_if(flag("rto_flag")).alias("r"))
    j = t["dim_customer"].join(per, "customer_id", "left").fillna(0, ["n", "d", "r"])
    rate = F.coalesce(ratio(c("pre_window_rto_count") + c("r"), c("pre_window_delivered")
                            + c("pre_window_rto_count") + c("d")), F.lit(0.0))
    one = j.agg(F.count_if(c("pre_window_orders") + c("n") != c("hist_orders_final")).alias("v"),
                F.max(F.abs(F.bround(rate, 3) - c("hist_rto_rate_final").cast("double")))
                .alias("drift"))
    ex = t["fct_order"].agg(
        F.count_if(c("rto_flag").isNull()).alias("excluded"),
        F.count_if(c("is_censored")).alias("censored"),
        F.count_if(c("is_cancelled_preship")).alias("cancelled"))
    return union([
        check(one, "DQ-07a", "resolved-only rate reconciles", "HARD", c("drift") <= 0.002,
              "<= 0.002", c("drift")),
        zero(one, "DQ-07b", "order ledger identity"),
        check(ex, "DQ-07c", "exclusions are censored or cancelled", "SOFT",
              (c("excluded") > 0) & (c("excluded") == c("censored") + c("cancelled")),
              "excluded = censored + cancelled", c("excluded"))])


def attempt_delay_check(orders: DataFrame, events: DataFrame) -> DataFrame:
    """DQ-15 per arm: delay present at all, and reachable through exactly one first attempt."""
    has = F.col("attempt_delay_days").isNotNull()
    per = events.groupBy("order_id").agg(
        F.bool_or(has).alias("present"),
        F.count_if(has & (F.col("attempt_number") == 1)).alias("firsts"))
    arm = F.when(flag("rto_flag"), "returned").otherwise("delivered").alias("arm")
    j = resolved(orders).select("order_id", arm).join(per, "order_id", "left")
    return j.groupBy("arm").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(flag("present")).alias("populated"),
        F.count_if(F.coalesce(F.col("firsts") == 1, F.lit(False))).alias("reachable"),
        F.count_if(F.coalesce(F.col("firsts") > 1, F.lit(False))).alias("duplicated")
    ).withColumn("ok", (F.col("populated") == F.col("orders"))
                 & (F.col("reachable") == F.col("orders")) & (F.col("duplicated") == 0))


# ---- outcome-conditional sweep -----------------------------------------------------------------
SKIP_COLUMNS = ("order_id", "session_id", "customer_id", "event_id", "delivery_event_id",
                "payment_attempt_id")


def _partitions() -> dict[str, Column]:
    """Partition name -> three-valued side of an order: true, false, or not in the base."""
    res = F.col("is_shipped") & ~F.col("is_censored")
    shipped = F.col("is_shipped")
    return {"rto_flag": F.when(res, flag("rto_flag")),
            "is_delivered": F.when(res, flag("is_delivered")), "is_shipped": shipped,
            "is_censored": F.when(shipped, F.col("is_censored")),
            "payment_method": F.col("payment_method") == "COD"}


#: Columns whose presence travels as the bits of one long.
_BITS = 60


def _order_masks(df: DataFrame, name: str, orders: DataFrame) -> tuple[DataFrame, list[str], list[str]] | None:
    """Does each order have each column at all? Any grain, OR over its rows.

    A column is one bit, so an order's row is its key and a long for every ``_BITS`` columns; also returned
    are the names of these and of the columns in the order of their bits.
    """
    cols = [c for c in df.columns if c not in SKIP_COLUMNS]
    masks = [f"_m{i}" for i in range(0, len(cols), _BITS)]

    def bits(own: list[str]) -> Column:
        each = [F.when(F.col(c).isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
                for i, c in enumerate(own)]
        return sum(each[1:], each[0])
    packed = [F.bit_or(bits(cols[i * _BITS:(i + 1) * _BITS])).alias(m) for i, m in enumerate(masks)]
    if "order_id" in df.columns and name != "fct_checkout_session":
        return df.groupBy("order_id").agg(*packed), masks, cols
    if "session_id" not in df.columns:
        return None
    # summed to one row of flags a session before they travel to its order
    flags = df.groupBy("session_id").agg(*packed)
    return (flags.join(orders.select("session_id", "order_id"), "session_id")
            .groupBy("order_id").agg(*[F.bit_or(m).alias(m) for m in masks])), masks, cols


def _has(masks: Sequence[str], i: int) -> Column:
    """Whether column ``i`` is present; null where an order has no row."""
    return F.col(masks[i // _BITS]).bitwiseAND(F.lit(1 << i % _BITS).cast("long")) != 0


def _order_grain(name: str, df: DataFrame, orders: DataFrame) -> DataFrame | None:
    """:func:`_order_masks` with one boolean for each column."""
    found = _order_masks(df, name, orders)
    if found is None:
        return None
    grain, masks, cols = found
    return grain.select("order_id", *[_has(masks, i).alias(c) for i, c in enumerate(cols)])


def conditional_sweep(t: Tables, tables: Iterable[str], present: float = 0.99,
                      absent: float = 0.01) -> DataFrame:
    """Columns filled on one side of an outcome partition and empty on the other.

    Per table one aggregate counts orders by outcome combination and by what is present.
    """
    tables = list(tables)
    if "fct_customer_state_at_session" in tables:
        t["fct_customer_state_at_session"]  # before orders and sessions, which it keeps
    orders = t["fct_order"]
    sides = _partitions()
    outcome = orders.select("order_id", *[c.alias(f"_p_{p}") for p, c in sides.items()])
    out = None
    for name in tables:
        found = _order_masks(t[name], name, orders)
        if found is None:
            continue
        grain, masks, cols = found
        j = outcome.join(grain, "order_id", "left")
        # a handful of outcome combinations carry everything the five partitions need
        alike = j.groupBy(*[f"_p_{p}" for p in sides], *masks).agg(F.count(F.lit(1)).alias("_k"))
        combos = alike.groupBy(*[f"_p_{p}" for p in sides]).agg(F.sum("_k").alias("_n"), *[
            F.sum(F.when(_has(masks, i), F.col("_k")).otherwise(0)).alias(c) for i, c in enumerate(cols)])
        cells = F.array(*[F.struct(F.lit(p).alias("partition"), F.col(f"_p_{p}").alias("side"))
                          for p in sides])
        per_column = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x"))
                               for c in cols])
        long = combos.select("_n", per_column.alias("cs"), F.inline(cells)).where(
            F.col("side").isNotNull()).select("_n", "partition", "side", F.inline("cs"))
        on = F.col("side")
        rows = long.groupBy("column", "partition").agg(
            F.sum(F.when(on, F.col("_n"))).alias("n_on"),
            F.sum(F.when(~on, F.col("_n"))).alias("n_off"),
            ratio(F.sum(F.when(on, F.col("x"))), F.sum(F.when(on, F.col("_n")))).alias("rate_on"),
            ratio(F.sum(F.when(~on, F.col("x"))), F.sum(F.when(~on, F.col("_n"))))
            .alias("rate_off")).select(F.lit(name).alias("table"), "*")
        out = rows if out is None else out.unionByName(rows)
    hi, lo = F.greatest("rate_on", "rate_off"), F.least("rate_on", "rate_off")
    both = F.col("rate_on").isNotNull() & F.col("rate_off").isNotNull()
    return out.where(both & (hi >= present) & (lo <= absent)).withColumn(
        "declaration", F.concat(F.col("table"), F.lit("."), F.col("column"), F.lit("@"),
                                F.col("partition")))


def sweep_against_allowlist(sweep: DataFrame, allowed: Sequence[str] = P.OUTCOME_CONDITIONAL_ALLOWED
                            ) -> DataFrame:
    """Flagged and declared, flagged but undeclared, or declared but no longer flagged."""
    spark = sweep.sparkSession
    want = spark.createDataFrame([(a,) for a in allowed], "declaration string").withColumn(
        "declared", F.lit(True))
    seen = sweep.select("declaration", F.lit(True).alias("flagged")).distinct()
    return want.join(seen, "declaration", "full_outer").select(
        "declaration", F.when(F.col("declared").isNull(), "UNDECLARED")
        .when(F.col("flagged").isNull(), "STALE").otherwise("DECLARED").alias("verdict"))


def sweep_check(verdicts: DataFrame) -> DataFrame:
    """DQ-16: undeclared flags fail; stale declarations are only reported."""
    one = verdicts.agg(F.count_if(F.col("verdict") == "UNDECLARED").alias("v"),
                       F.count_if(F.col("verdict") == "STALE").alias("stale"))
    return zero(one, "DQ-16", "undeclared outcome-conditional columns")


# ---- ground truth and fairness rows -----------------------------------------------------------
def ground_truth_checks(spark, *, naive: float, truth: float, matched: float | None = None,
                        sign_flips: int | None = None, null_effect: tuple | None = None,
                        delay_ratio: float | None = None, auc_ceiling: float | None = None
                        ) -> DataFrame:
    """GT-01 … GT-07 and BR-09 from already computed numbers; a missing number is a SKIP."""
    one = spark.range(1)
    put = lambda i, n, ok, want, got: check(
        one, i, n, "HARD", F.lit(bool(ok)), want, F.lit(str(got)))
    gone = lambda i, n: skip(spark, i, n, "HARD", "not fitted")
    lo, hi = P.CLOSURE_BAND
    rows = [gone("GT-01", "sign recovery") if sign_flips is None else
            put("GT-01", "sign recovery", sign_flips == 0, "no flips in scope", sign_flips),
            put("GT-02", "naive gap exceeds the effect", naive > truth, "naive > effect", naive)]
    if matched is None:
        rows += [gone("GT-03", "adjustment closes part of the gap"),
                 gone("GT-07", "matching lies between")]
    else:
        between = truth < matched < naive
        share = (naive - matched) / (naive - truth) if naive != truth else float("nan")
        rows += [put("GT-03", "adjustment closes part of the gap", between and lo <= share <= hi,
                     f"ordered and [{lo}, {hi}]", share),
                 put("GT-07", "matching lies between", between, "effect < matched < naive",
                     matched)]
    if null_effect is None:
        rows.append(gone("GT-04", "planted null holds"))
    else:
        coef, pp = null_effect
        rows.append(put("GT-04", "planted null holds", coef * P.PLANTED_NULL > 0
                        and abs(pp) < P.PLANTED_NULL_MAX_PP and abs(coef) <= abs(P.PLANTED_NULL),
                        "same sign, small, not inflated", coef))
    a, b = P.AUC_CEILING_BAND
    rows.append(gone("GT-05", "AUC ceiling in band") if auc_ceiling is None else
                put("GT-05", "AUC ceiling in band", a <= auc_ceiling <= b, f"[{a}, {b}]",
                    auc_ceiling))
    for i in ("GT-06", "BR-09"):
        name = "delay explains more than promise"
        rows.append(gone(i, name) if delay_ratio is None else
                    put(i, name, delay_ratio > 1, "> 1", delay_ratio))
    return union(rows)


def fairness_check(published: DataFrame, volumes: Sequence[float] = P.FAIRNESS_VOLUMES,
                   limit: float = P.FAIRNESS_LIMIT) -> DataFrame:
    """FA-01 re-derived from published ratios; stale or incomplete publications are SKIP.

    ``published`` holds ``volume, ratio`` (NULL ratio: nothing restricted in the best tier)
    and ``stale``.
    """
    seen = F.size(F.collect_set(F.when(F.round("volume", 4).isin(
        [round(float(v), 4) for v in volumes]), F.round("volume", 4))))
    one = published.agg(
        seen.alias("seen"), F.coalesce(F.bool_or("stale"), F.lit(True)).alias("stale"),
        F.max("ratio").alias("worst"),
        F.count_if(F.col("ratio").isNull() | (F.col("ratio") > limit)).alias("breaches"))
    usable = ~F.col("stale") & (F.col("seen") == len(volumes))
    return check(one, "FA-01", "restriction-rate ratio, worst over best tier", "HARD",
                 F.when(usable, F.col("breaches") == 0), f"<= {limit} at every volume",
                 F.when(usable, F.col("worst")))
