"""Restriction policies on a scored order frame, their fairness and their price.

Frame columns: ``session_id, geo_tier, payment_method, rto_flag, pit_has_clean_record,
pit_has_history, score`` and, where money is priced, ``contribution_margin``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag, ratio, score_tier
from .ranks import quantiles

RULES = ("global", "per-tier")


def cuts(df: DataFrame, volumes: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact score thresholds ``(volume, cut)`` of the top share, overall or per group."""
    q = quantiles(df, "score", [1 - v for v in volumes], by)
    rows = F.array(*[F.struct(F.lit(float(v)).alias("volume"), F.col(f"q{i}").alias("cut"))
                     for i, v in enumerate(volumes)])
    return q.select(*by, F.inline(rows))


def with_thresholds(df: DataFrame, volumes: Sequence[float]) -> DataFrame:
    """Append both rules' thresholds as arrays, one entry per volume.

    Thresholds are a handful of numbers per tier; ties at a threshold stay selected.
    """
    pack = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(
        F.lit(0) - F.col("volume"), "cut"))), lambda s: s["cut"]).alias(c)
    order = sorted(volumes, reverse=True)
    world = cuts(df, order).agg(pack("global_cuts")).scalar()
    tier = cuts(df, order, ["geo_tier"]).groupBy("geo_tier").agg(pack("tier_cuts"))
    return df.join(tier, "geo_tier").withColumn("global_cuts", world)


def overlay(flagged: Column) -> tuple[Column, Column, Column, Column]:
    """Protections after the threshold: raw tier, final tier, moved?, reason.

    The clean-record cap is applied before the zero-history immunity.
    """
    clean = flag("pit_has_clean_record")
    fresh = ~F.coalesce(F.col("pit_has_history"), F.lit(True))
    raw = F.when(flagged, "HIGH").otherwise("LOW")
    return protect(raw, clean, fresh)


def protect(raw: Column, clean: Column, fresh: Column) -> tuple[Column, Column, Column, Column]:
    high = raw == "HIGH"
    final = F.when(high & (clean | fresh), "MED").otherwise(raw)
    reason = (F.when(high & clean, "clean-record cap")
              .when(high & fresh, "zero-history immunity").otherwise(""))
    return raw, final, final != raw, reason


def restricted(df: DataFrame, volumes: Sequence[float] = P.FAIRNESS_VOLUMES, *,
               protections: bool = True) -> DataFrame:
    """One row per order, volume and rule that is selected, with the final decision.

    Only selected rows are exploded, so the output is bounded by the restricted share.
    """
    order = sorted(volumes, reverse=True)
    base = with_thresholds(df, order)
    picks = []
    for i, v in enumerate(order):
        for rule, cut in (("global", F.col("global_cuts")[i]), ("per-tier", F.col("tier_cuts")[i])):
            picks.append(F.when(F.col("score") >= cut, F.struct(
                F.lit(float(v)).alias("volume"), F.lit(rule).alias("rule"))))
    chosen = base.withColumn("pick", F.explode(F.array_compact(F.array(*picks)))).select(
        *df.columns, "pick.volume", "pick.rule")
    _, final, _, reason = overlay(F.lit(True))
    keep = final == "HIGH" if protections else F.lit(True)
    return chosen.withColumns({"kept": keep, "reason": reason})


def tier_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("geo_tier").agg(F.count(F.lit(1)).alias("orders"),
                                      F.count_if(flag("rto_flag")).alias("rto"))


def tier_exposure(df: DataFrame, volumes: Sequence[float] = P.FAIRNESS_VOLUMES,
                  p_star: float = P.P_STAR) -> DataFrame:
    """Per volume, rule and tier: restriction rate and what the restricted orders look like."""
    picked = restricted(df, volumes).where("kept").groupBy("volume", "rule", "geo_tier").agg(
        F.count(F.lit(1)).alias("restricted"), F.min("score").alias("score_cut"),
        F.avg("score").alias("mean_score_restricted"),
        F.count_if(flag("rto_flag")).alias("x"),
        F.count_if(F.col("score") < p_star).alias("below"))
    grid = F.array(*[F.struct(F.lit(float(v)).alias("volume"), F.lit(r).alias("rule"))
                     for v in volumes for r in RULES])
    full = tier_totals(df).select("geo_tier", "orders", "rto", F.inline(grid))
    j = full.join(picked, ["volume", "rule", "geo_tier"], "left")
    n = F.coalesce(F.col("restricted"), F.lit(0))
    return j.select(
        "volume", "rule", "geo_tier", "orders", n.alias("restricted"),
        ratio(n, "orders").alias("restriction_rate"), ratio("rto", "orders").alias("tier_rto_rate"),
        "score_cut", F.round("mean_score_restricted", 9).alias("mean_score_restricted"),
        ratio("x", "restricted").alias("rto_rate_restricted"),
        ratio("below", "restricted").alias("share_below_pstar"))


def ratio_audit(df: DataFrame, volumes: Sequence[float] = P.FAIRNESS_VOLUMES,
                limit: float = P.FAIRNESS_LIMIT) -> DataFrame:
    """Worst over best tier restriction rate, after the protections."""
    e = tier_exposure(df, volumes, 1.0)
    g = e.groupBy("volume", "rule").agg(
        *[F.max(F.when(F.col("geo_tier") == t, F.col("restriction_rate"))).alias(t)
          for t in P.GEO_TIERS],
        F.min_by("geo_tier", F.struct(-F.col("restriction_rate"), "geo_tier")).alias("worst_tier"),
        F.min_by("geo_tier", F.struct("restriction_rate", "geo_tier")).alias("best_tier"),
        F.max("restriction_rate").alias("hi"), F.min("restriction_rate").alias("lo"))
    r = F.try_divide("hi", "lo")
    return g.select("volume", "rule", *P.GEO_TIERS, "worst_tier", "best_tier", r.alias("ratio"),
                    F.when(r <= limit, "PASS").otherwise("FAIL").alias("verdict"))


def geo_audit(df: DataFrame, volumes: Sequence[float] = P.FAIRNESS_VOLUMES,
              limit: float = P.FAIRNESS_LIMIT) -> DataFrame:
    """Flag rate per tier of the global rule, before protections, TIER3 over METRO."""
    sel = restricted(df, volumes, protections=False).where("rule = 'global'").groupBy(
        "volume", "geo_tier").agg(F.count(F.lit(1)).alias("x"))
    grid = F.array(*[F.lit(float(v)) for v in volumes])
    rates = tier_totals(df).select("geo_tier", "orders", F.explode(grid).alias("volume")).join(
        sel, ["volume", "geo_tier"], "left").select(
        "volume", "geo_tier", ratio(F.coalesce(F.col("x"), F.lit(0)), "orders").alias("r"))
    g = rates.groupBy("volume").agg(*[F.max(F.when(F.col("geo_tier") == t, F.col("r"))).alias(t)
                                      for t in P.GEO_TIERS])
    over = F.try_divide("TIER3", "METRO")
    out = g.join(cuts(df, volumes).withColumnRenamed("cut", "score_cut"), "volume")
    return out.select("volume", "score_cut", *P.GEO_TIERS, over.alias("tier3_over_metro"),
                      F.when(over.isNull(), "no METRO order flagged")
                      .otherwise("").alias("note"),
                      F.when(over <= limit, "PASS").otherwise("ESCALATE").alias("verdict"))


def _by_rule(col: Column, name: str) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("rule") == r, col)), F.lit(0)).cast("double")
            .alias(f"{r.replace('-', '_')}_{name}") for r in RULES]


def margin_cost(df: DataFrame, annualisation: float | Column,
                volumes: Sequence[float] = P.FAIRNESS_VOLUMES) -> DataFrame:
    """Margin effect of both rules at equal volume when a restricted order is abandoned."""
    sel = restricted(df, volumes)
    kept = F.col("kept")
    g = sel.groupBy("volume").agg(
        F.count_if(F.col("rule") == "global").alias("selected"),
        *[F.count_if((F.col("rule") == r) & kept).alias(f"{r.replace('-', '_')}_n")
          for r in RULES],
        *_by_rule(F.when(kept, -F.col("contribution_margin")), "delta_cm"))
    price = F.col("global_delta_cm") - F.col("per_tier_delta_cm")
    return g.select(
        "volume", "selected", "global_n", "global_delta_cm",
        ratio("global_delta_cm", F.greatest("global_n", F.lit(1))).alias("global_per_order"),
        "per_tier_n", "per_tier_delta_cm",
        ratio("per_tier_delta_cm", F.greatest("per_tier_n", F.lit(1))).alias("per_tier_per_order"),
        price.alias("price_of_fairness"),
        ratio(price, F.greatest("global_n", F.lit(1))).alias("price_per_restricted_order"),
        (price * annualisation / 1e7).alias("price_annualised_cr"))


def conversion_sensitivity(df: DataFrame, prepaid: DataFrame, annualisation: float | Column,
                           volume: float = 0.17,
                           shares: Sequence[float] = P.SWITCH_SHARES) -> DataFrame:
    """The same price when a share of restricted COD orders switches to prepaid."""
    p = prepaid.select(((1 - F.col("prepaid_rto_rate")) * F.col("cm_delivered")
                        + F.col("prepaid_rto_rate") * F.col("cm_rto")).alias("ev")).scalar()
    kept = F.col("kept")
    g = restricted(df, [volume]).groupBy().agg(
        *_by_rule(F.when(kept, -F.col("contribution_margin")), "cm"),
        *[F.count_if((F.col("rule") == r) & kept & (F.col("payment_method") == "COD"))
          .alias(f"{r.replace('-', '_')}_cod") for r in RULES])
    g = g.withColumn("switched_order_ev", p).withColumn(
        "cod_switch_share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    delta = lambda r: (F.col(f"{r}_cm") + F.col("cod_switch_share")
                       * F.col("switched_order_ev") * F.col(f"{r}_cod"))
    price = delta("global") - delta("per_tier")
    return g.select("cod_switch_share", "switched_order_ev",
                    delta("global").alias("global_delta_cm"),
                    delta("per_tier").alias("per_tier_delta_cm"),
                    price.alias("price_of_fairness"),
                    (price * annualisation / 1e7).alias("price_annualised_cr"))


def overlay_summary(df: DataFrame, tier: str = "tier") -> DataFrame:
    """Raw and final tier counts and the share each protection moved."""
    clean, fresh = flag("pit_has_clean_record"), ~F.col("pit_has_history")
    raw, final, moved, _ = protect(F.col(tier), clean, fresh)
    long = df.select(raw.alias("raw"), final.alias("final"), moved.alias("moved")).groupBy(
        "raw", "final").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("moved")).alias("m"))
    # at most a few rows from here on
    cells = long.select(F.inline(F.array(
        F.struct(F.col("raw").alias("tier"), F.col("n").alias("r"), F.lit(0).cast("long")
                 .alias("f"), F.col("m").alias("m")),
        F.struct(F.col("final").alias("tier"), F.lit(0).cast("long").alias("r"), F.col("n")
                 .alias("f"), F.lit(0).cast("long").alias("m")))))
    g = cells.groupBy("tier").agg(F.sum("r").alias("n_raw"), F.sum("f").alias("n_final"),
                                  F.sum("m").alias("reclassified_out"))
    everyone = Window.partitionBy()
    share = lambda c: ratio(c, F.sum(c).over(everyone)) * 100
    return g.select("tier", "n_raw", "n_final", "reclassified_out",
                    share("n_raw").alias("share_raw_pct"), share("n_final")
                    .alias("share_final_pct"),
                    F.coalesce(ratio("reclassified_out", "n_raw") * 100, F.lit(0.0))
                    .alias("pct_of_tier_reclassified"))


def protection_gradient(df: DataFrame) -> DataFrame:
    """How many orders of each tier the protections cover."""
    clean, fresh = flag("pit_has_clean_record"), ~F.col("pit_has_history")
    n = F.count(F.lit(1))
    return df.groupBy("geo_tier").agg(
        (ratio(F.count_if(clean), n) * 100).alias("clean_record_pct"),
        (ratio(F.count_if(fresh), n) * 100).alias("zero_history_pct"),
        (ratio(F.count_if(clean | fresh), n) * 100).alias("protected_pct"),
        ratio(F.count_if(flag("rto_flag")), n).alias("tier_rto_rate"))


def protection_coverage(df: DataFrame) -> DataFrame:
    """Orders, share and return rate under each protection."""
    clean, fresh, y = flag("pit_has_clean_record"), ~F.col("pit_has_history"), flag("rto_flag")
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(clean).alias("c"),
                 F.count_if(clean & y).alias("cx"), F.count_if(fresh).alias("f"),
                 F.count_if(fresh & y).alias("fx"))
    rows = F.array(*[F.struct(F.lit(name).alias("protection"), F.col(a).alias("orders"),
                              F.col(b).alias("x"))
                     for name, a, b in (("clean-record cap", "c", "cx"),
                                        ("zero-history immunity", "f", "fx"))])
    return one.select("n", F.inline(rows)).select(
        "protection", "orders", (ratio("orders", "n") * 100).alias("share_pct"),
        ratio("x", "orders").alias("rto_rate"))


def score_by_tier(df: DataFrame) -> DataFrame:
    """Observed return rate against mean score per tier: distorted, or reported?"""
    g = df.groupBy("geo_tier").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(flag("rto_flag")).alias("x"),
        F.avg("score").alias("m"), F.count_if(F.col("payment_method") == "COD").alias("c"))
    everyone = Window.partitionBy()
    rate = ratio("x", "orders")
    return g.select("geo_tier", "orders", rate.alias("observed_rto"),
                    F.round("m", 9).alias("mean_score"), ratio("c", "orders").alias("cod_share"),
                    F.round((F.col("m") - rate) * 100, 7).alias("score_minus_observed_pp"),
                    (rate / ratio(F.sum("x").over(everyone), F.sum("orders").over(everyone)))
                    .alias("rto_lift_vs_population"))


def score_tier_table(df: DataFrame, p_star: float = P.P_STAR) -> DataFrame:
    """Realised against expected shares of the break-even anchored tiers."""
    from ..functions.scalar import lookup
    g = df.groupBy(score_tier("score", p_star).alias("tier")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(flag("rto_flag")).alias("x"))
    return g.select("tier", "orders",
                    (ratio("orders", F.sum("orders").over(Window.partitionBy())) * 100)
                    .alias("share_pct"),
                    lookup("tier", P.EXPECTED_TIER_SHARE).alias("expected_share_pct"),
                    ratio("x", "orders").alias("observed_rto"))


def restriction_flags(df: DataFrame, volumes: Sequence[float] = P.FAIRNESS_VOLUMES) -> DataFrame:
    """The score sink: keys, score, tier and one per-tier restriction flag per volume."""
    order = sorted(volumes, reverse=True)
    base = with_thresholds(df, order)
    out = {}
    for i, v in enumerate(order):
        _, final, _, _ = overlay(F.col("score") >= F.col("tier_cuts")[i])
        out[f"restricted_pertier_{round(v * 100):02d}"] = final == "HIGH"
    return base.select("session_id", "score", score_tier("score").alias("tier"),
                       *[c.alias(n) for n, c in sorted(out.items())])


def intervention_table(spark) -> DataFrame:
    """The seven levers: restrictive ones rank inside their tier, offers globally."""
    return spark.createDataFrame(
        [(i, n, "RESTRICTIVE" if r else "offer", b) for i, n, r, b in P.INTERVENTIONS],
        "id string, intervention string, kind string, threshold_basis string")
