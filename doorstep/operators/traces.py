"""Additive log-odds scoring with per-term traces, checks on them, and recalibration.

A coefficient table becomes one column expression per term; a row's trace is the map of
those terms. Batch scoring needs no Python per row and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import clipped_logit, flag, logistic, lookup, scalar_logistic
from ..session import keep

INTERCEPT = "__intercept__"


@dataclass(frozen=True)
class LogOdds:
    """Named additive terms of one model: ``{term: column}``."""

    terms: Mapping[str, Column]
    #: The same terms without a check of their own; their sum is finite only if all are.
    plain: Mapping[str, Column] | None = None

    @classmethod
    def build(cls, intercept: float, coefficients: Mapping, drivers: Mapping[str, Column],
              extra: Mapping[str, Column] | None = None) -> LogOdds:
        """Multiply each coefficient with its driver.

        A nested mapping is categorical: every observed level must be declared. A
        coefficient without a driver, or a driver that is NULL or not finite, is an error.
        """
        missing = sorted(set(coefficients) - set(drivers))
        if missing:
            raise ValueError(f"no driver for declared terms {missing}")
        terms = {INTERCEPT: F.lit(float(intercept))}
        for name, value in coefficients.items():
            if isinstance(value, Mapping):
                terms[name] = lookup(drivers[name], value).cast("double")
            else:
                terms[name] = F.lit(float(value)) * drivers[name].cast("double")
        terms.update(extra or {})
        return cls({n: _finite(n, c) for n, c in terms.items()}, terms)

    def append(self, df: DataFrame, prefix: str) -> DataFrame:
        """Add ``<prefix>_terms`` (struct), ``<prefix>_lp`` and ``<prefix>_p``.

        The steps are separate projections, so each term is evaluated once per row.
        """
        total = None
        for name in self.terms:
            part = F.col(f"{prefix}_terms").getField(name)
            total = part if total is None else total + part
        df = df.withColumn(f"{prefix}_terms", F.struct(*[c.alias(n)
                                                         for n, c in self.terms.items()]))
        df = df.withColumn(f"{prefix}_lp", total)
        return df.withColumn(f"{prefix}_p", logistic(f"{prefix}_lp"))

    def append_score(self, df: DataFrame, prefix: str) -> DataFrame:
        """Add ``<prefix>_lp`` and ``<prefix>_p`` alone; the terms are added up in the same order."""
        total = None
        for part in (self.plain or self.terms).values():
            total = part if total is None else total + part
        df = df.withColumn(f"{prefix}_lp", total)
        df = df.withColumn(f"{prefix}_lp", _finite(f"of {prefix}", F.col(f"{prefix}_lp")))
        return df.withColumn(f"{prefix}_p", logistic(f"{prefix}_lp"))


def trace_json(df: DataFrame, prefix: str, digits: int = 9) -> Column:
    """JSON map of every term of ``<prefix>_terms`` with the total and the probability."""
    terms = [f.name for f in df.schema[f"{prefix}_terms"].dataType]
    named = {n: F.col(f"{prefix}_terms").getField(n) for n in terms}
    named.update({"__total__": F.col(f"{prefix}_lp"), "__probability__": F.col(f"{prefix}_p")})
    return F.to_json(F.create_map(*[x for n, c in named.items()
                                    for x in (F.lit(n), F.round(c, digits))]))


def _finite(name: str, col: Column) -> Column:
    bad = col.isNull() | F.isnan(col) | (F.abs(col) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"term {name} is not finite"))).otherwise(col)


def trace_sum(trace: str | Column) -> Column:
    """Sum of a JSON trace's terms, ignoring the ``__total__`` style entries."""
    parsed = F.from_json(trace, "map<string,double>")
    keep = F.map_filter(parsed, lambda k, _: (k == INTERCEPT) | ~k.startswith("__"))
    return F.aggregate(F.map_values(keep), F.lit(0.0), lambda a, b: a + b)


def reconstruction_check(scored: DataFrame, rebuilt: str, stored: str,
                         tolerance: float = P.RECONSTRUCTION_TOLERANCE) -> DataFrame:
    """Largest gap between a rebuilt and a stored probability, with a verdict."""
    gap = F.abs(F.col(rebuilt).cast("double") - F.col(stored).cast("double"))
    return scored.agg(
        F.count(stored).alias("rows"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_error")
    ).withColumn("ok", F.col("max_error") <= tolerance)


def flatten_coefficients(coefficients: Mapping, prefix: str = "") -> list[tuple[str, float]]:
    """Flatten nested coefficients to ``term`` / ``term[level]`` rows."""
    rows: list[tuple[str, float]] = []
    for term, value in coefficients.items():
        if isinstance(value, Mapping):
            rows += [(f"{prefix}{term}[{level}]", float(v)) for level, v in value.items()]
        else:
            rows.append((f"{prefix}{term}", float(value)))
    return rows


# ---- canonical scorers -----------------------------------------------------------------
def model_frame(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Session-grain drivers of the planted choice and return models."""
    state = tables["fct_customer_state_at_session"].drop("customer_id")
    s = tables["fct_checkout_session"].select(
        "session_id", "customer_id", "date_id", "candidate_product_id", "cart_size",
        "cart_value", "delivery_geography_id", "estimated_delivery_days",
        "address_completeness_score", "order_id")
    o = tables["fct_order"].select(
        "order_id", "seller_id", "payment_method", "paid_via_switch", "order_value",
        "discount_pct", "is_shipped", "is_censored", "rto_flag", "is_delivered")
    p = tables["dim_product"].select(F.col("product_id").alias("candidate_product_id"),
                                     "category", "product_rating", "review_count",
                                     F.col("seller_id").alias("listed_seller_id"))
    g = tables["dim_geography"].select(
        F.col("geography_id").alias("delivery_geography_id"), "geo_tier",
        "serviceability_score", "courier_reliability_score", "cod_cultural_index")
    c = tables["customer_base"].select("customer_id", "has_saved_prepaid_instrument")
    lat = tables["truth_customer_latent"]
    base = (s.join(o, "order_id", "left").join(state, "session_id")
            .join(p, "candidate_product_id").join(g, "delivery_geography_id")
            .join(c, "customer_id").join(lat, "customer_id")
            .withColumn("seller_id", F.coalesce("seller_id", "listed_seller_id")))
    sellers = tables["dim_seller"].select("seller_id", "seller_rating", "seller_sla_breach_rate")
    return base.join(sellers, "seller_id").withColumn(
        "is_month_end", (F.dayofmonth("date_id") >= 26).cast("double"))


def with_z(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Append population z-scores ``{output: input}``; zero spread gives 0."""
    stats = df.agg(F.struct(*[f(F.col(c).cast("double")).alias(f"{t}_{o}")
                              for o, c in names.items()
                              for t, f in (("m", F.avg), ("s", F.stddev_pop))]).alias("z"))
    return _attach(df, stats, {
        o: F.when(F.col(f"z.s_{o}") > 0,
                  (F.col(c).cast("double") - F.col(f"z.m_{o}")) / F.col(f"z.s_{o}"))
        .otherwise(F.lit(0.0)) for o, c in names.items()})


def _attach(df: DataFrame, one_row: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    (name,) = one_row.columns
    return df.withColumn(name, one_row.scalar()).withColumns(dict(new)).drop(name)


def drivers() -> dict[str, Column]:
    """Driver columns on ``model_frame`` (after :func:`with_z`)."""
    d = lambda c: F.col(c).cast("double")
    cen = P.CENTERING
    cod = F.coalesce((F.col("payment_method") == "COD").cast("double"), F.lit(0.0))
    value = F.coalesce(d("order_value"), d("cart_value"))
    log_value = F.log(F.greatest(value, F.lit(1.0)) / cen["order_value_scale"])
    prior_gap = lambda c, prior: F.coalesce(d(c) - prior, F.lit(0.0))
    return {
        "is_cod": cod, "paid_via_switch": F.coalesce(d("paid_via_switch"), F.lit(0.0)),
        "pit_rto_rate_shrunk": d("pit_rto_rate_shrunk") - P.RTO_PRIOR,
        "latent_intent": d("latent_intent"), "latent_liquidity": d("latent_liquidity"),
        "latent_trust": d("latent_trust"),
        "latent_price_sensitivity": d("latent_price_sensitivity"),
        "is_new_customer": d("pit_is_new_customer"),
        "log1p_orders_delivered": F.log1p(d("pit_orders_delivered")),
        "log1p_prepaid_success": F.log1p(d("pit_prepaid_success_count")),
        "pit_cod_share": prior_gap("pit_cod_share", P.COD_PRIOR),
        "payment_failure_rate": prior_gap("pit_payment_failure_rate", P.PAYMENT_FAILURE_PRIOR),
        "has_saved_instrument": d("has_saved_prepaid_instrument"),
        "geo_tier": F.col("geo_tier"), "category": F.col("category"),
        "serviceability_z": F.col("serviceability_z"),
        "cod_cultural_index_z": F.col("cod_cultural_index_z"),
        "address_completeness": d("address_completeness_score"),
        "seller_sla_breach_rate": d("seller_sla_breach_rate"),
        "seller_rating_centered": d("seller_rating") - cen["seller_rating_center"],
        "product_rating_centered": d("product_rating") - cen["product_rating_center"],
        "log1p_review_count_centered": F.col("log1p_review_count_centered"),
        "log_order_value": log_value, "log_order_value_sq": log_value * log_value,
        "discount_pct_centered": F.coalesce(
            (d("discount_pct") - cen["discount_pct_center"]) / cen["discount_pct_unit"],
            F.lit(0.0)),
        "cart_size_ge3": (F.col("cart_size") >= 3).cast("double"),
        "est_delivery_days_centered": d("estimated_delivery_days")
        - cen["est_delivery_days_center"],
        "is_month_end": F.col("is_month_end"), "month_end_x_cod": F.col("is_month_end") * cod,
    }


SCORED = (
    "session_id", "customer_id", "order_id", "payment_method", "is_shipped", "is_censored", "rto_flag",
    "geo_tier", "category", "product_rating", "review_count", "seller_rating", "seller_sla_breach_rate",
    "serviceability_score", "cod_cultural_index", "courier_reliability_score", "is_month_end", "order_value",
    "cart_value", "cart_size", "paid_via_switch", "discount_pct", "estimated_delivery_days",
    "address_completeness_score", "has_saved_prepaid_instrument", "latent_trust", "latent_liquidity",
    "latent_intent", "latent_price_sensitivity", "pit_rto_rate_shrunk", "pit_is_new_customer",
    "pit_orders_delivered", "pit_prepaid_success_count", "pit_cod_share", "pit_payment_failure_rate")


def scoring_frame(tables: Mapping[str, DataFrame]) -> DataFrame:
    """What both models read of ``model_frame``, written once for both scalings and the scores."""
    return keep(model_frame(tables).select(*SCORED).withColumn(
        "log1p_reviews", F.log1p(F.col("review_count").cast("double"))))


def scored_sessions(tables: Mapping[str, DataFrame], *, cod_intercept: float = 0.2,
                    rto_intercept: float = -2.4, terms: bool = True) -> DataFrame:
    """``model_frame`` with both models' probabilities and, unless ``terms`` is off, their terms."""
    return scored_frame(scoring_frame(tables), cod_intercept=cod_intercept,
                        rto_intercept=rto_intercept, terms=terms)


def scored_frame(frame: DataFrame, chosen: DataFrame | None = None, *, cod_intercept: float = 0.2,
                 rto_intercept: float = -2.4, terms: bool = True) -> DataFrame:
    """Scores of :func:`scoring_frame`; of the ``chosen`` sessions alone, scaled as in the whole frame."""
    frame = with_z(frame, {"serviceability_z": "serviceability_score",
                           "cod_cultural_index_z": "cod_cultural_index",
                           "courier_reliability_z": "courier_reliability_score"})
    mean = frame.agg(F.avg("log1p_reviews").alias("_m"))
    frame = _attach(frame, mean, {"log1p_review_count_centered":
                                  F.col("log1p_reviews") - F.col("_m")})
    if chosen is not None:
        frame = frame.join(chosen, "session_id", "left_semi")
    for prefix, intercept, weights in (("cod", cod_intercept, P.COD_COEFFICIENTS),
                                       ("rto", rto_intercept, P.RTO_COEFFICIENTS)):
        model = LogOdds.build(intercept, weights, drivers())
        frame = model.append(frame, prefix) if terms else model.append_score(frame, prefix)
    shipped = F.coalesce(F.col("is_shipped"), F.lit(False))
    frame = frame.withColumn("shock", P.SHOCK_COEFFICIENTS["courier_reliability_z_neg"]
                             * -F.col("courier_reliability_z"))
    return frame.select(
        "session_id", "customer_id", "order_id", "payment_method", "is_shipped", "is_censored",
        "rto_flag", "geo_tier", F.col("cod_p").alias("p_cod_intent"),
        F.when(shipped, F.col("rto_p")).alias("p_rto_precheckout"),
        F.when(shipped, logistic(F.col("rto_lp") + F.col("shock"))).alias("p_rto_final"),
        F.when(shipped, F.col("shock")).alias("post_dispatch_shock"),
        *[f"{m}_{c}" for m in ("cod", "rto") for c in ("terms", "lp", "p") if terms or c != "terms"])


def session_probabilities(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``truth_order_probability`` with traces for the stratified audit sample."""
    from .events import probability_table
    frame = scoring_frame(tables)
    scored = keep(scored_frame(frame, terms=False))
    chosen = audit_sample(scored).select("session_id")
    # terms are worked out again for the few chosen sessions, not written for all
    traced = scored_frame(frame, chosen)
    traces = traced.select(
        "session_id", trace_json(traced, "cod").alias("logit_cod_components"),
        F.when(F.col("p_rto_precheckout").isNotNull(), trace_json(traced, "rto"))
        .alias("logit_rto_components"))
    return probability_table(scored.withColumn("p_convert", F.lit(None).cast("double")), traces)


# ---- audit sample -----------------------------------------------------------------------
def audit_sample(scored: DataFrame, strata: Mapping[str, int] | None = None,
                 seed: int = 20260115, quantile: float = P.AUDIT_HIGH_RISK_QUANTILE) -> DataFrame:
    """Union of fixed-size strata: random sessions, COD and prepaid returns, high-risk delivered.

    Each stratum takes the rows with the smallest seeded hash, so the draw is exact in
    size and reproducible; ordering with a limit keeps only per-partition heads.
    """
    strata = dict(strata or P.AUDIT_STRATA)
    resolved = flag("is_shipped") & ~flag("is_censored")
    rto, cod = flag("rto_flag"), F.col("payment_method") == "COD"
    from .ranks import quantiles
    delivered = scored.where(resolved & ~rto).select(F.col("p_rto_precheckout").alias("p"))
    cut = quantiles(delivered, "p", [quantile]).select("q0").first()
    high = F.lit(False) if cut is None or cut[0] is None else \
        resolved & ~rto & (F.col("p_rto_precheckout") >= cut[0])
    pools = {"random_sessions": F.lit(True), "cod_rto": resolved & rto & cod,
             "prepaid_rto": resolved & rto & ~cod, "high_risk_delivered": high}
    picks = None
    for name, want in strata.items():
        pick = (scored.where(pools[name])
                .select("session_id", F.lit(name).alias("stratum"),
                        F.xxhash64(F.lit(seed), F.lit(name), F.col("session_id")).alias("draw"))
                .orderBy("draw", "session_id").limit(want))
        picks = pick if picks is None else picks.unionByName(pick)
    return picks.groupBy("session_id").agg(
        F.sort_array(F.collect_set("stratum")).alias("strata"))


def audit_summary(sample: DataFrame, strata: Mapping[str, int] | None = None) -> DataFrame:
    """Drawn versus wanted per stratum; a shortfall is reported, never hidden."""
    strata = dict(strata or P.AUDIT_STRATA)
    drawn = (sample.select(F.explode("strata").alias("stratum")).groupBy("stratum")
             .agg(F.count(F.lit(1)).alias("drawn")))
    spark = sample.sparkSession
    want = spark.createDataFrame(list(strata.items()), "stratum string, wanted long")
    return want.join(drawn, "stratum", "left").select(
        "stratum", "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn"),
        (F.col("wanted") - F.coalesce("drawn", F.lit(0))).alias("shortfall"))


# ---- marginal effects and recalibration -----------------------------------------------------
def marginal_effect_at(intercept: float, coefficient: float) -> float:
    """Percentage-point effect of switching one binary driver on at the reference row."""
    return 100 * (scalar_logistic(intercept + coefficient) - scalar_logistic(intercept))


def average_marginal_effect(df: DataFrame, lp_off: str | Column, coefficient: float) -> DataFrame:
    """Population mean of the same switch, in percentage points."""
    lp = F.col(lp_off) if isinstance(lp_off, str) else lp_off
    return df.agg((100 * F.avg(logistic(lp + coefficient) - logistic(lp))).alias("ame_pp"),
                  F.count(lp).alias("rows"))


def planted_effect(scored: DataFrame, coefficient: float = P.RTO_COEFFICIENTS["is_cod"]
                   ) -> DataFrame:
    """Naive COD gap and the true effect on resolved COD orders."""
    base = scored.where(flag("is_shipped") & ~flag("is_censored"))
    cod = F.col("payment_method") == "COD"
    rate = lambda cond: F.avg(F.when(cond, flag("rto_flag").cast("double")))
    lp = clipped_logit("p_rto_final", 1e-12)
    gap = F.when(cod, logistic(lp) - logistic(lp - coefficient))
    return base.agg((100 * (rate(cod) - rate(~cod))).alias("naive_gap_pp"),
                    (100 * F.avg(gap)).alias("average_marginal_effect_pp"),
                    F.count_if(cod).alias("cod_orders"))


@dataclass(frozen=True)
class Recalibration:
    intercept: float
    achieved: float
    target: float
    tolerance: float
    iterations: int
    converged: bool


def share_tolerance(n: int) -> float:
    if n <= 0:
        raise ValueError("tolerance needs at least one unit")
    return max(P.SHARE_TOLERANCE_FLOOR, P.SHARE_TOLERANCE_SCALING / math.sqrt(n))


def recalibrate(df: DataFrame, lp: str, target: float, *, bracket: tuple[float, float],
                tolerance: float, grid: int = 16, rounds: int = 12) -> Recalibration:
    """Intercept shift so that the mean probability equals ``target``.

    The mean is monotone in the shift, so each pass evaluates a whole grid of shifts in one
    aggregate and keeps the cell that brackets the target: a few passes replace dozens.
    """
    if bracket[0] >= bracket[1]:
        raise ValueError(f"bracket {bracket} is not ordered")
    col = F.col(lp)

    def means(points: list[float]) -> list[float]:
        row = df.agg(*[F.avg(logistic(col + F.lit(a))).alias(f"m{i}")
                       for i, a in enumerate(points)]).first()
        return [float(x) for x in row]

    lo, hi = bracket
    width = hi - lo
    for _ in range(5):
        f_lo, f_hi = means([lo, hi])
        if f_lo > f_hi:
            raise ValueError("the objective falls as the intercept rises")
        if f_lo <= target <= f_hi:
            break
        lo, hi = (lo - width, lo) if target < f_lo else (hi, hi + width)
        width *= 2
    else:
        raise ValueError(f"target {target} lies outside [{f_lo}, {f_hi}]")
    best, value = lo, f_lo
    for step in range(1, rounds + 1):
        points = [lo + (hi - lo) * i / grid for i in range(grid + 1)]
        values = means(points)
        best, value = min(zip(points, values), key=lambda pv: abs(pv[1] - target))
        if abs(value - target) <= tolerance:
            return Recalibration(best, value, target, tolerance, step, True)
        cell = max(i for i, v in enumerate(values[:-1]) if v <= target or i == 0)
        lo, hi = points[cell], points[cell + 1]
    return Recalibration(best, value, target, tolerance, rounds, False)


