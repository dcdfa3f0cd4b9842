"""The pre-registered hypotheses on the order population."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import chi2_tail_1df, diff_ci_columns, flag, katz_columns, ratio, \
    scalar_logistic, tenure_bucket
from ..session import cut, forget, keep
from .features import dummies, independent_columns, pivots, weighted_correlation
from .irls import fit_many
from .models import LogitFit, fit_logit, with_columns
from .ranks import many_quantiles, quantile_bins, quantiles
from .views import resolved


def _is_cod() -> Column:
    return F.col("payment_method") == "COD"


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def two_groups(df: DataFrame, in_a: Column, y: Column, by: list[str] | None = None,
               names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Means of ``y`` in and out of a group, their difference in points and its interval."""
    a, b = names
    ya, yb = F.when(in_a, y), F.when(~in_a, y)
    aggs = [F.count(ya).alias(f"n_{a}"), F.count(yb).alias(f"n_{b}"), F.avg(ya).alias(a),
            F.avg(yb).alias(b), F.var_samp(ya).alias("va"), F.var_samp(yb).alias("vb")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    c = F.col
    return g.select(*(by or []), f"n_{a}", f"n_{b}", a, b,
                    *diff_ci_columns(c(a), c("va"), c(f"n_{a}"), c(b), c("vb"), c(f"n_{b}")))


# ---- H2 ----------------------------------------------------------------------------------
_H2 = ("cod_share_new", "cod_share_established")


def new_customer_cod(pop: DataFrame) -> DataFrame:
    return two_groups(pop, F.col("pit_is_new_customer"), _is_cod().cast("double"), names=_H2)


def cod_by_tenure(pop: DataFrame) -> DataFrame:
    g = pop.groupBy(tenure_bucket("pit_orders_delivered").alias("bucket")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(_is_cod()).alias("x"))
    return g.select("bucket", "orders", ratio("x", "orders").alias("cod_share"))


def new_customer_cod_within_tier(pop: DataFrame, minimum: int = P.MIN_CELL_PER_ARM) -> DataFrame:
    out = two_groups(pop, F.col("pit_is_new_customer"), _is_cod().cast("double"), ["geo_tier"],
                     _H2)
    return out.where((F.col(f"n_{_H2[0]}") >= minimum) & (F.col(f"n_{_H2[1]}") >= minimum))


# ---- H3 ----------------------------------------------------------------------------------
def prior_rto_lift(pop: DataFrame) -> DataFrame:
    """Ratio of return rates with and without a prior return, log-method interval."""
    base = resolved(pop)
    prior, y = F.coalesce(F.col("pit_rto_count"), F.lit(0)) > 0, flag("rto_flag")
    one = base.agg(F.count_if(prior).alias("n_with_prior"), F.count_if(prior & y).alias("x1"),
                   F.count_if(~prior).alias("n_without"), F.count_if(~prior & y).alias("x0"))
    c = F.col
    return one.select("n_with_prior", "n_without",
                      ratio("x1", "n_with_prior").alias("rto_rate_with_prior"),
                      ratio("x0", "n_without").alias("rto_rate_without"),
                      *katz_columns(c("x1"), c("n_with_prior"), c("x0"), c("n_without")))


def rto_by_prior_count(pop: DataFrame) -> DataFrame:
    """Return rate by prior returns (3 and more together) and its lift over none."""
    from pyspark.sql import Window
    g = resolved(pop).groupBy(F.least(F.coalesce(F.col("pit_rto_count"), F.lit(0)), F.lit(3))
                              .alias("prior_rto")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(flag("rto_flag")).alias("x"))
    g = g.withColumn("rto_rate", ratio("x", "orders"))
    # at most four rows
    first = F.first("rto_rate").over(Window.orderBy("prior_rto"))
    return g.select("prior_rto", "orders", "rto_rate",
                    F.try_divide("rto_rate", first).alias("lift_vs_zero"))


# ---- H4 ----------------------------------------------------------------------------------
def cod_by_value_decile(pop: DataFrame) -> DataFrame:
    """COD share and median value per order-value decile (1 = lowest)."""
    b = quantile_bins(pop.select("order_value", "payment_method"), "order_value", 10, "bin")
    b = b.withColumn("decile", F.col("bin") + 1)
    g = b.groupBy("decile").agg(F.count(F.lit(1)).alias("orders"), F.count_if(_is_cod())
                                .alias("x"))
    med = quantiles(b, "order_value", [0.5], ["decile"]).select("decile", F.col("q0")
                                                               .alias("median_value"))
    return g.join(med, "decile").select("decile", "orders", ratio("x", "orders")
                                        .alias("cod_share"), "median_value")


def order_value_cod(pop: DataFrame) -> DataFrame:
    """Linear against quadratic log-value model of COD choice, and where the curve peaks."""
    work = pop.select(_is_cod().cast("double").alias("y"),
                      F.col("order_value").cast("double").alias("v"),
                      F.log(F.greatest(F.col("order_value").cast("double"), F.lit(1.0)))
                      .alias("l"))
    row = work.agg(F.avg("l").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    data = work.select("y", (F.col("l") - row.m).alias("x"),
                       ((F.col("l") - row.m) ** 2).alias("xx")).persist()
    linear, quad = fit_logit(data, "y", ["x"]), fit_logit(data, "y", ["x", "xx"])
    data.unpersist()
    b1, b2 = quad.coef["x"], quad.coef["xx"]
    peak = math.exp(min(-b1 / (2 * b2) + row.m, 700)) if b2 else None
    lr = linear.deviance - quad.deviance
    deciles = cod_by_value_decile(pop)
    shape = deciles.agg(
        F.max_by("decile", F.struct(F.col("cod_share"), -F.col("decile"))).alias("peak"),
        F.max("cod_share").alias("best"),
        F.max_by("cod_share", "decile").alias("top")).first()
    return _rows(pop, [(linear.coef["x"], b1, b2, quad.se["xx"], b2 < 0, lr, chi2_tail_1df(lr),
                        peak, peak is not None and row.lo < peak < row.hi, shape.peak,
                        shape.top < shape.best, shape.best, shape.top)],
                 "linear_coefficient double, quad_linear_term double, quad_square_term double, "
                 "quad_square_se double, square_term_negative boolean, lr_stat double, "
                 "lr_p double, fitted_peak_order_value double, peak_inside_range boolean, "
                 "observed_peak_decile int, top_decile_below_peak boolean, "
                 "cod_share_at_peak double, cod_share_top_decile double")


# ---- H5 ----------------------------------------------------------------------------------
def _fit(work: DataFrame, y: Column, feats: dict[str, Column]) -> LogitFit:
    data = keep(with_columns(work, feats, [y.cast("double").alias("y")]))
    names = independent_columns(data, list(feats))
    fit = fit_logit(data, "y", names, cached=True)
    forget(data)
    return fit


def counted(work: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of the columns, how many orders hold them in ``weight`` and what share of these returned in ``y``.

    A fit on these is the fit on the orders. Tiers, whole days and scores of three decimals take
    few values together however many orders there are; were they many, a row stands for one order."""
    return cut(work.groupBy(*columns).agg(
        F.avg(flag("rto_flag").cast("double")).alias("y"), F.count(F.lit(1)).alias("weight")))


def _shift_pp(base: float, delta: float) -> float:
    return (scalar_logistic(math.log(base / (1 - base)) + delta) - base) * 100


def _log_value() -> Column:
    return F.log(F.greatest(F.col("order_value").cast("double"), F.lit(1.0)))


def ratings_on_cod(pop: DataFrame) -> DataFrame:
    """Effect of the ratings on choosing COD, value, cart, category and tier held."""
    d = lambda c: F.col(c).cast("double")
    feats = {"seller_rating": d("seller_rating"), "product_rating": d("product_rating"),
             "log1p_review_count": F.log1p(d("review_count")), "log_order_value": _log_value(),
             "cart_size": d("cart_size"),
             **dummies(pop, ("category", "geo_tier"), {"category": "cat", "geo_tier": "geo"})}
    fit = _fit(pop, _is_cod(), feats)
    base = pop.agg(F.avg(_is_cod().cast("double")).alias("b")).first().b
    spread = {r["column"]: r for r in many_quantiles(
        pop, ["seller_rating", "product_rating", "review_count"], [0.1, 0.9]).collect()}
    out = []
    for t, src in (("seller_rating", "seller_rating"), ("product_rating", "product_rating"),
                   ("log1p_review_count", "review_count")):
        c, se = fit.coef.get(t), fit.se.get(t)
        if c is None:
            continue
        out.append((t, c, se, c - 1.96 * se, c + 1.96 * se, _shift_pp(base, -c),
                    spread[src]["q0"], spread[src]["q1"]))
    return _rows(pop, out, "term string, coefficient double, se double, ci_low double, "
                           "ci_high double, one_unit_drop_pp double, p10 double, p90 double")


def review_count_on_rto(pop: DataFrame) -> DataFrame:
    """The planted null: review count should hardly move returns."""
    d = lambda c: F.col(c).cast("double")
    work = resolved(pop) if "is_censored" in pop.columns else pop
    feats = {"log1p_review_count": F.log1p(d("review_count")),
             "product_rating": d("product_rating"), "seller_rating": d("seller_rating"),
             "log_order_value": _log_value(),
             "address_completeness": d("address_completeness_score"),
             "estimated_delivery_days": d("estimated_delivery_days"),
             "is_cod": _is_cod().cast("double"),
             "pit_rto_count": F.coalesce(d("pit_rto_count"), F.lit(0.0)),
             **dummies(work, ("geo_tier", "category"), {"category": "cat", "geo_tier": "geo"})}
    fit = _fit(work, flag("rto_flag"), feats)
    c, se = fit.coef["log1p_review_count"], fit.se["log1p_review_count"]
    q = quantiles(work, "review_count", [0.1, 0.9]).first()
    base = work.agg(F.avg(flag("rto_flag").cast("double")).alias("b")).first().b
    spread = math.log1p(q.q1) - math.log1p(q.q0)
    return _rows(pop, [(c, se, c - 1.96 * se, c + 1.96 * se, fit.p_value["log1p_review_count"],
                        _shift_pp(base, c * spread), fit.coef.get("address_completeness"),
                        fit.coef.get("is_cod"))],
                 "coefficient double, se double, ci_low double, ci_high double, p_value double, "
                 "p10_p90_spread_pp double, address_completeness_coefficient double, "
                 "is_cod_coefficient double")


# ---- H6 ----------------------------------------------------------------------------------
def rto_by_promise(pop: DataFrame) -> DataFrame:
    g = resolved(pop).groupBy("estimated_delivery_days").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(flag("rto_flag")).alias("x"))
    return g.select("estimated_delivery_days", "orders", ratio("x", "orders").alias("rto_rate"))


def delay_availability(pop: DataFrame) -> DataFrame:
    """Which delay column is filled on which outcome arm."""
    work, y = resolved(pop), flag("rto_flag")
    delivered = flag("is_delivered")
    dd, ad = F.col("delivery_delay_days"), F.col("attempt_delay_days")
    return work.agg(
        F.count_if(delivered & dd.isNotNull()).alias("delivered_with_delay"),
        F.count_if(delivered & dd.isNull()).alias("delivered_without_delay"),
        F.count_if(y & ad.isNotNull()).alias("returned_with_attempt_delay"),
        F.count_if(y & ad.isNull()).alias("returned_without_attempt_delay"),
        F.avg(F.when(delivered, dd)).alias("mean_delay_delivered"),
        F.avg(F.when(y, ad)).alias("mean_attempt_delay_returned"))


def promise_effect(pop: DataFrame) -> DataFrame:
    """Promise length on returns with the tier held."""
    work = resolved(pop)
    work = counted(work, ("geo_tier", "estimated_delivery_days"))
    feats = {"estimated_delivery_days": F.col("estimated_delivery_days").cast("double"),
             **dummies(work, ("geo_tier",), {"geo_tier": "geo"})}
    data = with_columns(work, feats, ["y", "weight"])
    live, r = weighted_correlation(data, list(feats), "weight")
    fit = fit_many(data, "y", {"full": pivots(r, live)}, weight="weight")[0]["full"]
    base = work.agg(ratio(F.sum(F.col("y") * F.col("weight")), F.sum("weight")).alias("b")).first().b
    c = fit.coef["estimated_delivery_days"]
    return _rows(pop, [(c, fit.se["estimated_delivery_days"], _shift_pp(base, c),
                        fit.pseudo_r2)],
                 "promise_coefficient double, promise_se double, "
                 "promise_per_extra_day_pp double, promise_pseudo_r2 double")


def deviance_comparison(pop: DataFrame) -> DataFrame:
    """Promise against realised first-attempt delay by the deviance lost without each."""
    work = counted(resolved(pop).where(F.col("attempt_delay_days").isNotNull()), (
        "geo_tier", "serviceability_score", "estimated_delivery_days", "attempt_delay_days"))
    held = {**dummies(work, ("geo_tier",), {"geo_tier": "geo"}),
            "serviceability": F.col("serviceability_score").cast("double")}
    terms = {c: F.col(c).cast("double") for c in ("estimated_delivery_days",
                                                   "attempt_delay_days")}
    data = with_columns(work, {**held, **terms}, ["y", "weight"])
    live, r = weighted_correlation(data, [*held, *terms], "weight")
    at = [i for i, n in enumerate(live) if n in held]
    base = pivots(r[np.ix_(at, at)], [live[i] for i in at])
    fits, _ = fit_many(data, "y", {"full": [*base, *terms], "null": base, **{
        t: [*base, *(o for o in terms if o != t)] for t in terms}}, weight="weight")
    full, null = fits["full"], fits["null"]
    explained = null.deviance - full.deviance
    loss = {t: fits[t].deviance - full.deviance for t in terms}
    over = loss["attempt_delay_days"] / max(loss["estimated_delivery_days"], 1e-12)
    return _rows(pop, [(t, loss[t], loss[t] / explained if explained else None, full.coef[t],
                        full.se[t], full.rows, null.deviance, full.deviance, over, over > 1,
                        full.pseudo_r2) for t in terms],
                 "term string, deviance_contribution double, share_of_explained double, "
                 "coefficient double, se double, n long, null_deviance double, "
                 "full_deviance double, delay_over_promise_ratio double, "
                 "delay_dominates boolean, full_pseudo_r2 double")


# ---- H11 / H12 ---------------------------------------------------------------------------
def switch_cod(pop: DataFrame, sessions: DataFrame) -> DataFrame:
    """Share of COD created by a failed payment, and how those orders return."""
    base, y = resolved(pop), flag("rto_flag").cast("double")
    groups = two_groups(base.where(_is_cod()), flag("paid_via_switch"), y,
                        names=("rto_rate_switch_cod", "rto_rate_intent_cod"))
    final_cod = F.coalesce(F.col("final_payment_method") == "COD", F.lit(False))
    s = sessions.agg(F.count_if(final_cod).alias("cod_orders"),
                     F.count_if(F.col("switched_to_cod_after_failure")).alias("switched"))
    prepaid = base.where(~_is_cod()).agg(F.avg(y).alias("p")).scalar()
    return groups.withColumns({
        "s": s.select(F.struct("*").alias("s")).scalar(), "rto_rate_prepaid": prepaid}).select(
        ratio("s.switched", "s.cod_orders").alias("pct_of_cod_from_failure"),
        F.col("s.switched").alias("switch_cod_orders"), F.col("s.cod_orders").alias("cod_orders"),
        *groups.columns, "rto_rate_prepaid")


def prior_scoreboard(pop: DataFrame, auc_ceiling: float | None = None) -> DataFrame:
    """Each pre-registered prior next to what the data shows; neither replaces the other."""
    h2 = new_customer_cod(pop).first().diff_pp
    h3 = prior_rto_lift(pop).first().lift
    h11 = pop.agg(ratio(F.count_if(flag("paid_via_switch")), F.count_if(_is_cod()))
                  .alias("r")).first().r
    seen = {"H2_new_customer_cod_lift_pp": h2, "H3_prior_rto_lift_multiple": h3,
            "H11_pct_cod_from_payment_failure": h11, "H12_achievable_auc_ceiling": auc_ceiling}
    out = []
    for name, (text, lo, hi) in P.HYPOTHESIS_PRIORS.items():
        v = seen[name]
        verdict = ("NOT MEASURED" if v is None else "BELOW PRIOR" if v < lo
                   else "ABOVE PRIOR" if v > hi else "IN PRIOR")
        out.append((name, text, v, verdict))
    return _rows(pop, out, "hypothesis string, prior string, observed double, verdict string")
