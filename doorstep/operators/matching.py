"""Nearest-neighbour caliper matching with replacement, without pairs or per-group sorts.

Rows are range-partitioned on ``(logit, is_control, key)``. Inside a range, two ordered
windows carry the last control before and the first control after each treated row; a
range that starts or ends without a control borrows it from its neighbours through one
summary row per range. The key in the ordering splits any pile of equal scores, so no
score value can collect in one task, and no candidate is ever dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import PART, ranged


def nearest_controls(df: DataFrame, *, score: str, treated: str, key: str, outcome: str,
                     caliper_width: float) -> DataFrame:
    """One row per treated row with its nearest control, or NULLs outside the caliper.

    A treated row sorts before controls of equal score. Of two equally distant controls
    the lower one wins.
    """
    rows = df.select(
        F.col(score).cast("double").alias("x"), (F.col(treated) == 0).alias("is_control"),
        F.col(key).alias("k"), F.col(outcome).cast("double").alias("y"))
    parts = ranged(rows, "x", "is_control", "k")
    control = F.when(F.col("is_control"), F.struct("x", "k", "y"))
    edges = parts.groupBy(PART).agg(F.max(control).alias("top"), F.min(control).alias("bottom"))
    # one row per range
    below = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(PART, F.max("top").over(below).alias("from_below"),
                         F.min("bottom").over(above).alias("from_above"))
    up = Window.partitionBy(PART).orderBy("x", "is_control", "k").rowsBetween(
        Window.unboundedPreceding, -1)
    down = Window.partitionBy(PART).orderBy(F.desc("x"), F.desc("is_control"),
                                            F.desc("k")).rowsBetween(
        Window.unboundedPreceding, -1)
    near = parts.select("*", F.last(control, ignorenulls=True).over(up).alias("lower"),
                        F.last(control, ignorenulls=True).over(down).alias("upper"))
    near = near.where(~F.col("is_control")).join(edges, PART).select(
        "k", "x", "y", F.coalesce("lower", "from_below").alias("lower"),
        F.coalesce("upper", "from_above").alias("upper"))
    d_low, d_up = F.col("x") - F.col("lower.x"), F.col("upper.x") - F.col("x")
    use_low = d_low.isNotNull() & (d_up.isNull() | (d_low <= d_up))
    best = F.when(use_low, F.struct(F.col("lower.k").alias("k"), F.col("lower.y").alias("y"),
                                    d_low.alias("d")))
    best = best.when(d_up.isNotNull(), F.struct(F.col("upper.k").alias("k"),
                                                F.col("upper.y").alias("y"), d_up.alias("d")))
    out = near.withColumn("m", best)
    inside = F.col("m.d") <= caliper_width
    return out.select(F.col("k").alias("treated_key"), F.col("y").alias("treated_outcome"),
                      F.when(inside, F.col("m.k")).alias("control_key"),
                      F.when(inside, F.col("m.y")).alias("control_outcome"),
                      F.when(inside, F.col("m.d")).alias("distance"))


def matched_effect(pairs: DataFrame) -> DataFrame:
    """Effect on the treated over matched pairs, with interval and unmatched share."""
    hit = F.col("control_key").isNotNull()
    t, c = F.when(hit, F.col("treated_outcome")), F.when(hit, F.col("control_outcome"))
    one = pairs.agg(F.count(F.lit(1)).alias("n_treated"), F.count_if(hit).alias("n"),
                    F.avg(t).alias("mt"), F.avg(c).alias("mc"), F.var_samp(t).alias("vt"),
                    F.var_samp(c).alias("vc"))
    gap, n = F.col("mt") - F.col("mc"), F.col("n")
    se = F.sqrt(F.try_divide(F.col("vt") + F.col("vc"), n))
    return one.select(
        (gap * 100).alias("estimate_pp"), ((gap - 1.96 * se) * 100).alias("ci_low_pp"),
        ((gap + 1.96 * se) * 100).alias("ci_high_pp"), n.alias("n_matched_pairs"), "n_treated",
        (F.col("n_treated") - n).alias("unmatched_cod"),
        (1 - F.try_divide(n.cast("double"), F.col("n_treated"))).alias("unmatched_share"))
