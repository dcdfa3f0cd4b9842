"""The COD effect on returns: raw, stratified, regression-adjusted, matched; diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import diff_ci_columns, flag, latent_noise_attenuation, logistic, ratio, \
    tenure_bucket
from ..session import forget, keep
from . import features as X
from .funnel import standardised, two_arm_cells
from .irls import ManyFit, average_gains, fit_many
from .matching import matched_effect, nearest_controls
from .models import LogitFit, fit_logit, linear_r2s, with_columns
from .ranks import auc_ks, score_table, spearman


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def raw_crosstab(pop: DataFrame) -> DataFrame:
    """No controls: both rates, the gap and its interval."""
    y, cod = flag("rto_flag").cast("double"), F.col("is_cod") == 1
    a, b = F.when(cod, y), F.when(~cod, y)
    one = pop.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"),
                  F.var_samp(b).alias("vb"), F.count(a).alias("n_cod"),
                  F.count(b).alias("n_prepaid"))
    c = F.col
    return one.select(c("ma").alias("cod_rate"), c("mb").alias("prepaid_rate"),
                      *diff_ci_columns(c("ma"), c("va"), c("n_cod"), c("mb"), c("vb"),
                                       c("n_prepaid")), "n_cod", "n_prepaid")


def stratified(pop: DataFrame, minimum: int = P.MIN_CELL_PER_ARM) -> DataFrame:
    """Standardised effects with the cells and orders that were too thin to use."""
    cells = two_arm_cells(pop.withColumn("tenure", tenure_bucket("pit_orders_delivered")),
                          ["tenure", "geo_tier"])
    thick = (F.col("n_cod") >= minimum) & (F.col("n_prepaid") >= minimum)
    lost = cells.agg(F.count_if(~thick).alias("cells_dropped"),
                     F.coalesce(F.sum(F.when(~thick, F.col("n_cod") + F.col("n_prepaid"))),
                                F.lit(0)).alias("orders_dropped"))
    out = standardised(cells.where(thick))
    return out.withColumn("l", lost.select(F.struct("*").alias("s")).scalar()).select(
        *out.columns, "l.cells_dropped", "l.orders_dropped")


@dataclass
class Confounders:
    """The causal design, materialised once for every fit that shares it."""

    frame: DataFrame
    names: list[str]

    @classmethod
    def build(cls, pop: DataFrame, key: str = "session_id", *, blank: Sequence[str] = ()
              ) -> Confounders:
        for c in blank:
            pop = pop.withColumn(c, F.lit(0.0))
        feats = X.causal_features(pop)
        frame = with_columns(pop, feats, [
            F.col(key).alias("key"), F.col("is_cod").cast("double").alias("is_cod"),
            flag("rto_flag").cast("double").alias("y"), F.col("customer_id")])
        # as columns of a file, an indicator takes a bit a row; cached, eight bytes
        frame = keep(frame)
        return cls(frame, X.independent_columns(frame, list(feats)))

    def close(self) -> None:
        forget(self.frame)


def effects(conf: Confounders, names: Sequence[str] | None = None) -> tuple[LogitFit, float, float]:
    """Outcome model with treatment; returns the fit, the ATE and the ATT in points."""
    names = list(conf.names if names is None else names)
    fit = fit_logit(conf.frame, "y", ["is_cod", *names])
    b = fit.coef["is_cod"]
    off = F.col("lp") - b * F.col("is_cod")
    gain = logistic(off + b) - logistic(off)
    row = fit.score(conf.frame).agg(
        (100 * F.avg(gain)).alias("ate"),
        (100 * F.avg(F.when(F.col("is_cod") == 1, gain))).alias("att")).first()
    return fit, row.ate, row.att


def effects_of(conf: Confounders, specs: dict[str, Sequence[str]]) -> tuple[dict[str, ManyFit], dict[str, tuple[float, float]]]:
    """The outcome model with treatment for each list of confounders, fitted together, and each one's ATE and ATT."""
    fits, _ = fit_many(conf.frame, "y", {s: ["is_cod", *names] for s, names in specs.items()})
    return fits, average_gains(conf.frame, "is_cod", fits)


def logistic_adjusted(pop: DataFrame) -> DataFrame:
    """Average marginal effect with every observed confounder held."""
    conf = Confounders.build(pop)
    fit, ate, att = effects(conf)
    conf.close()
    b, se = fit.coef["is_cod"], fit.se["is_cod"]
    return _rows(pop, [(ate, att, b, math.exp(b), se, ate * (b - 1.96 * se) / b,
                        ate * (b + 1.96 * se) / b, len(fit.names), fit.pseudo_r2)],
                 "estimate_ate_pp double, estimate_att_pp double, log_odds_coefficient double, "
                 "odds_ratio double, coef_se double, ci_low_pp double, ci_high_pp double, "
                 "n_features int, pseudo_r2 double")


def match_pairs(conf: Confounders, caliper: float = 0.01) -> tuple[DataFrame, float | None]:
    """Matched pairs on the fitted propensity log-odds, and the propensity AUC."""
    fit = fit_logit(conf.frame, "is_cod", conf.names, cached=True)
    top = math.log((1 - 1e-9) / 1e-9)
    scored = fit.score(conf.frame).select(
        "key", "is_cod", "y", F.greatest(F.least("lp", F.lit(top)), F.lit(-top)).alias("lp"),
        "p").persist()
    sd = scored.agg(F.stddev_pop("lp").alias("s")).first().s
    ps_auc = auc_ks(score_table(scored, "p", "is_cod")).first().auc
    pairs = nearest_controls(scored, score="lp", treated="is_cod", key="key", outcome="y",
                             caliper_width=caliper * sd)
    scored.unpersist()  # the pairs start from checkpointed ranges
    return pairs, ps_auc


def propensity_matched(pop: DataFrame, caliper: float = 0.01, *, blank: Sequence[str] = ()
                       ) -> DataFrame:
    """Effect on the treated over pairs inside the caliper."""
    conf = Confounders.build(pop, blank=blank)
    pairs, ps_auc = match_pairs(conf, caliper)
    conf.close()
    out = matched_effect(pairs).withColumns({"caliper_logit_sd": F.lit(caliper),
                                             "ps_auc": F.lit(ps_auc)})
    return out


def closed_share(estimate: float, truth: float, naive: float) -> float | None:
    """Share of the naive-to-truth distance an estimate closes."""
    return None if naive == truth else (naive - estimate) / (naive - truth)


def gap_report(df: DataFrame, adjusted: float, truth: float, naive: float) -> DataFrame:
    """The quantities the closure check is graded on; it does not grade them."""
    share = closed_share(adjusted, truth, naive)
    return _rows(df, [(truth < adjusted < naive, naive - truth, naive - adjusted, share,
                       None if share is None else 1 - share)],
                 "ordered boolean, selection_pp double, recovered_pp double, "
                 "share_recovered double, share_remaining double")


# ---- diagnostics -------------------------------------------------------------------------
def ablate_suspect(pop: DataFrame, truth: float = 0.0,
                   suspect: str = "pit_rto_rate_shrunk") -> DataFrame:
    """Refit the adjusted model without one feature and its missing flag; rematch too.

    Shares are of the measured unadjusted gap; without a known ``truth`` they count towards 0.
    """
    conf = Confounders.build(pop)
    specs = {"full confounder set": conf.names,
             f"minus {suspect}": [n for n in conf.names if not n.startswith(suspect)]}
    fits, gains = effects_of(conf, {"none": [], **specs})
    naive = gains["none"][1]
    out = []
    for label, names in specs.items():
        ate, att = gains[label]
        out.append([label, len(names), att, ate, closed_share(att, truth, naive),
                    closed_share(ate, truth, naive), fits[label].coef["is_cod"], fits[label].pseudo_r2])
    conf.close()
    for row, blank in zip(out, ((), (suspect,))):
        psm = propensity_matched(pop, blank=blank).first()
        row += [psm.estimate_pp, psm.unmatched_share, psm.ps_auc]
    return _rows(pop, [tuple(r) for r in out],
                 "spec string, n_confounders int, logit_att_pp double, logit_ate_pp double, "
                 "closed_att double, closed_ate double, cod_coefficient double, pseudo_r2 double, "
                 "psm_pp double, psm_unmatched double, ps_auc double")


def confounder_contributions(pop: DataFrame, truth: float = 0.0,
                             only: Sequence[str] | None = None) -> DataFrame:
    """Deviance lost and effect shift when each confounder block is dropped.

    Shares are of the measured unadjusted gap, as in :func:`ablate_suspect`.
    """
    conf = Confounders.build(pop)
    chosen = {b: cols for b, cols in X.blocks(conf.names).items() if only is None or b in only}
    # names of two words can't be blocks
    fits, gains = effects_of(conf, {"all of them": conf.names, "none at all": [], **{
        block: [n for n in conf.names if n not in cols] for block, cols in chosen.items()}})
    full, null = fits["all of them"], fits["none at all"]
    full_att, null_att = gains["all of them"][1], gains["none at all"][1]
    explained = null.deviance - full.deviance
    naive = null_att
    full_closed = closed_share(full_att, truth, naive)
    out = []
    for block, cols in chosen.items():
        fit, att = fits[block], gains[block][1]
        loss = fit.deviance - full.deviance
        share = closed_share(att, truth, naive)
        out.append((block, len(cols), loss, loss / explained, att, share,
                    None if share is None else (full_closed - share) * 100, null_att, full_att))
    conf.close()
    return _rows(pop, sorted(out, key=lambda r: -r[2]),
                 "confounder string, n_columns int, deviance_contribution double, "
                 "share_of_explained double, att_without_pp double, closed_without double, "
                 "closure_lost_pp double, unadjusted_att_pp double, full_att_pp double")


def latent_reconstructibility(pop: DataFrame, latents: DataFrame) -> DataFrame:
    """R² of each hidden trait on the safe features, per order and per customer."""
    targets = ("latent_trust", "latent_liquidity", "latent_intent", "latent_price_sensitivity",
               "true_cod_propensity")
    joined = pop.join(latents.select("customer_id", *targets), "customer_id", "left")
    scopes = (("causal confounder set", X.causal_features(pop)),
              ("maximal safe set", X.maximal_safe_features(pop)))
    out = []
    for scope, feats in scopes:
        frame = with_columns(joined, feats, ["customer_id", *[F.col(t).cast("double").alias(t)
                                                              for t in targets]]).persist()
        if frame.where(F.greatest(*[F.col(t).isNull() for t in targets])).limit(1).count():
            raise ValueError("some customers have no latent row")
        names, by_order = linear_r2s(frame, targets, list(feats))
        means = frame.groupBy("customer_id").agg(
            *[F.avg(X.tick(c)).alias(c) for c in (*targets, *names)]).persist()
        n = means.count()
        _, by_customer = linear_r2s(means, targets, names)
        for t, order_r2, customer_r2 in zip(targets, by_order, by_customer, strict=True):
            out.append((scope, t, "choice channel" if t == targets[-1] else "latent", len(names),
                        order_r2, n, customer_r2))
        means.unpersist()
        frame.unpersist()
    return _rows(pop, out, "scope string, target string, kind string, n_features int, "
                           "order_r2 double, n_customers long, customer_r2 double")


# ---- coefficient recovery -------------------------------------------------------------------
IN_SCOPE = ("Strong", "Moderate-strong", "Moderate", "Moderate, interaction only")


def recovery_table(pop: DataFrame, planted: dict | None = None) -> DataFrame:
    """Planted against fitted coefficients: interval, sign, ratio, per term."""
    feats, frame = X.recovery_features(pop)
    data = keep(with_columns(frame, feats, [flag("rto_flag").cast("double").alias("y")]))
    names = X.independent_columns(data, list(feats))
    fit = fit_logit(data, "y", names, cached=True)
    forget(data)
    contrasts = X.planted_contrasts(dict(planted or P.RTO_COEFFICIENTS))
    rows = [(n, fit.coef[n], fit.se[n]) for n in names]
    fitted = _rows(pop, rows, "term string, fitted double, se double")
    plan = _rows(pop, [(t, float(v), P.RECOVERY_STRENGTH.get(t.split("[")[0], "Weak"))
                       for t, v in sorted(contrasts.items())],
                 "term string, planted double, strength string")
    lo, hi = F.col("fitted") - 1.96 * F.col("se"), F.col("fitted") + 1.96 * F.col("se")
    return plan.join(fitted, "term", "left").select(
        "term", "strength", "planted", "fitted", lo.alias("ci_low"), hi.alias("ci_high"),
        F.coalesce((lo <= F.col("planted")) & (F.col("planted") <= hi), F.lit(False))
        .alias("inside_ci"),
        F.coalesce((F.col("planted") == 0) | (F.signum("fitted") == F.signum("planted")),
                   F.lit(False)).alias("sign_ok"),
        F.try_divide("fitted", "planted").alias("ratio"),
        F.when(F.col("fitted").isNull(), "NOT IN MATRIX").otherwise("FITTED").alias("status"))


def recovery_summary(table: DataFrame, noise_sd: float = P.NOISE_SD) -> DataFrame:
    """Sign flips, interval share, attenuation and magnitude ranking of a recovery table."""
    scope = F.col("strength").isin(*IN_SCOPE) & F.col("fitted").isNotNull()
    watched = F.col("strength") == "Weak-moderate"
    straddles = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
    r = F.when(scope, F.col("ratio"))
    rho, _ = spearman(table.where(scope & (F.col("planted") != 0)).select(
        F.abs("planted").alias("a"), F.abs("fitted").alias("b")), "a", "b")
    return table.agg(
        F.count(F.lit(1)).alias("n_testable"), F.count_if(scope).alias("n_in_scope"),
        F.count_if(scope & ~F.col("sign_ok")).alias("sign_flips"),
        F.count_if(watched & ~F.col("sign_ok") & ~straddles).alias("watched_flips"),
        ratio(F.count_if(F.col("inside_ci")), F.count(F.lit(1))).alias("share_inside_ci"),
        F.avg(r).alias("ratio_mean"), F.stddev_samp(r).alias("ratio_sd"),
        F.min(r).alias("ratio_min"), F.max(r).alias("ratio_max"),
        F.count_if(r < 1).alias("n_attenuated"), F.count_if(r >= 1).alias("n_inflated")
    ).withColumns({"ratio_cv": F.try_divide("ratio_sd", "ratio_mean"),
                   "expected_attenuation": F.lit(latent_noise_attenuation(noise_sd)),
                   "magnitude_rank_rho": F.lit(rho).cast("double")})
