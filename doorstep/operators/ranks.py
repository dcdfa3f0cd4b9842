"""Exact global order statistics that never sort the data in one task.

``prefix_sums`` range-partitions the rows on the full ordering key, so a heavily tied score
is split by the tie-breaking columns, runs the window inside each range, and shifts each
range by the totals of the earlier ones. The ranges are checkpointed because a recomputed
range partitioning may draw other boundaries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import flag, ratio
from ..session import cut
from .narrowing import narrowed_quantiles

PART = "_range"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in range partitions over ``order``, with the partition number, checkpointed.

    The number of ranges follows the session; adaptive execution may merge neighbouring
    small ranges, which keeps their order.
    """
    return cut(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def prefix_sums(df: DataFrame, order: Sequence[str], sums: Sequence[str],
                by: Sequence[str] = ()) -> DataFrame:
    """Append ``before_<c>``: the sum of ``c`` over all rows strictly earlier in ``order``.

    ``order`` (within ``by``) must be unique per row.
    """
    parts = ranged(df, *by, *order)
    totals = parts.groupBy(*by, PART).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    # at most one row per range and group
    earlier = (Window.partitionBy(*(by or [F.lit(0)])).orderBy(PART)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*by, PART, *[
        F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums])
    inside = (Window.partitionBy(*by, PART).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = parts.withColumns(
        {f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return local.join(offsets, [*by, PART]).withColumns(
        {f"before_{c}": F.col(f"before_{c}") + F.col(f"_off_{c}") for c in sums}).drop(
        PART, *[f"_off_{c}" for c in sums])


def row_numbers(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
                name: str = "row_number") -> DataFrame:
    """Exact 1-based row number over a unique total order."""
    return (prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], by)
            .withColumn(name, F.col("before__one") + 1).drop("_one", "before__one"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles ``q0, q1, …`` per group, plus the count ``n``.

    Values are first reduced to distinct values with counts, so no aggregation buffer ever
    holds a group.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    placed = prefix_sums(counts, ["_v"], ["_n"], by)
    totals = placed.groupBy(*by).agg(F.sum("_n").alias("n"))
    if by:
        placed = placed.join(totals, list(by))
    else:
        placed = placed.withColumn("n", totals.scalar())
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        holds = lambda k: (F.col("before__n") <= k) & (k < F.col("before__n") + F.col("_n"))
        low, high = F.floor(pos), F.ceil(pos)
        v = F.col("_v").cast("double")
        out += [F.max(F.when(holds(low), v)).alias(f"_l{i}"),
                F.max(F.when(holds(high), v)).alias(f"_h{i}"), F.max(pos - low).alias(f"_f{i}")]
    picked = placed.groupBy(*by).agg(F.max("n").alias("n"), *out)
    return picked.select(*by, "n", *[
        (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
        for i in range(len(probs))])


def many_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of several numeric columns in one pass: rows ``(column, n, q0, …)``."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("e")).select("e.*")
    return narrowed_quantiles(long, "value", probs, by=["column"])


def quantile_bins(df: DataFrame, value: str, k: int, name: str = "bin",
                  table: DataFrame | None = None) -> DataFrame:
    """Right-closed quantile bins 0…, duplicate edges merged, lowest value included."""
    probs = [i / k for i in range(k + 1)]
    row = (quantiles(df, value, probs) if table is None else table).first()
    edges = sorted({row[f"q{i}"] for i in range(k + 1) if row[f"q{i}"] is not None}) if row else []
    v = F.col(value).cast("double")
    expr = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        expr = F.when(v <= edges[i + 1], i).otherwise(expr)
    expr = F.when(v.isNull() | (v < edges[0]), F.lit(None)).otherwise(expr) if edges else expr
    return df.withColumn(name, expr.cast("int"))


def equal_count_bins(df: DataFrame, order: Sequence[str], k: int, name: str = "bin") -> DataFrame:
    """Equal-count bins by rank, as pandas ``qcut(rank(method='first'), k)`` places them."""
    ranked = row_numbers(df, order, name="_r")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    place = F.ceil((F.col("_r") - 1) * F.lit(k) / F.greatest(n - 1, F.lit(1))) - 1
    return ranked.withColumn(name, F.greatest(place, F.lit(0)).cast("int")).drop("_r")


# ---- score tables ------------------------------------------------------------------------
def score_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores with ``pos``/``neg`` counts and the counts strictly below each."""
    y = flag(label) if dict(df.dtypes)[label] == "boolean" else F.col(label) == 1
    distinct = (df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score"))
                .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    return prefix_sums(distinct, ["score"], ["pos", "neg"])


def auc_ks(table: DataFrame) -> DataFrame:
    """One row: exact AUC (ties share ranks; NULL for one class) and KS separation."""
    one = table.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    totals = one.select(F.struct("P", "N").alias("t")).scalar()
    pairs = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)
    t = table.withColumn("t", totals)
    gap = F.abs(ratio(F.col("before_neg") + F.col("neg"), F.greatest(F.col("t.N"), F.lit(1)))
                - ratio(F.col("before_pos") + F.col("pos"), F.greatest(F.col("t.P"), F.lit(1))))
    return t.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        ratio(F.sum(pairs.cast("decimal(38,1)")),
              F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.max(gap).alias("ks"))


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Average rank (ties shared) of ``value`` over all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = prefix_sums(counts, [value], ["_n"])
    ranks = placed.select(F.col(value), (F.col("before__n") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, value)


def spearman(df: DataFrame, x: str, y: str) -> tuple[float | None, float | None]:
    """Rank correlation and its two-sided p-value (large-sample normal form)."""
    pair = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(
        F.count(F.lit(1)).alias("w"))
    rank = lambda c: prefix_sums(
        pair.groupBy(c).agg(F.sum("w").alias("_n")), [c], ["_n"]).select(
        c, (F.col("before__n") + (F.col("_n") + 1) / 2.0).alias(f"_rank_{c}"))
    joined = pair.join(rank(x), x).join(rank(y), y)
    a, b, w = F.col(f"_rank_{x}"), F.col(f"_rank_{y}"), F.col("w")
    r = joined.agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"),
                   F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"),
                   F.sum(w * a * b).alias("ab")).first()
    if not r.n or r.n < 3:
        return None, None
    va, vb = r.aa - r.a ** 2 / r.n, r.bb - r.b ** 2 / r.n
    if va <= 0 or vb <= 0:
        return None, None
    rho = (r.ab - r.a * r.b / r.n) / math.sqrt(va * vb)
    if abs(rho) >= 1:
        return rho, 0.0
    z = rho * math.sqrt((r.n - 2) / (1 - rho ** 2))
    return rho, math.erfc(abs(z) / math.sqrt(2))
