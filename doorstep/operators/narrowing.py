"""Exact quantiles of many columns, groups and levels by narrowing histograms.

Every wanted order statistic is a target with a range that holds it and the count of values below
that range. A pass counts, for all targets together, the values of each range in ``BINS`` equal bins
and moves every target to the bin that holds its rank. The first pass bins logarithms, so that
values of very different sizes part at once. When all ranges hold few values each (or one value), a
last pass counts the distinct values inside them and picks the ranks exactly. Rows are only counted,
with partial sums before each shuffle; nothing is sorted but bins and those few values.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BINS = 256
#: Values that a range may hold for the exact step.
FEW = 4096
#: A range of doubles can't be halved more often than this: 2,100 binary orders of size at most.
PASSES = 300


def _scaled(x: Column) -> Column:
    """Grows with x and tells sizes apart; near 0 it is linear."""
    return F.signum(x) * F.log1p(F.abs(x))


def _ranks(targets: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """A row for each level and each of the two ranks it lies between."""
    at = F.col("p") * (F.col("n") - 1)
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    rows = targets.select(*by, "n", "lo", "hi", levels.alias("l")).select(*by, "n", "lo", "hi", "l.*")
    return rows.select(*by, "n", "lo", "hi", "level", (at - F.floor(at)).alias("part"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(at).alias("rank")))).alias(
        "r")).select(*by, "n", "lo", "hi", "level", "part", "r.*")


def _bin(first: bool) -> Column:
    """Number of the bin of ``_v`` within lo and hi; grows with the value, and lo and hi differ after the first pass."""
    most = F.lit(sys.float_info.max)
    finite = lambda c: F.greatest(F.least(F.col(c), most), -most)
    x, low, high = (_scaled(finite(c)) if first else finite(c) for c in ("_v", "lo", "hi"))
    span = high - low
    share = F.when(span < F.lit(float("inf")), F.try_divide(x - low, span)).otherwise(F.try_divide(x / 2 - low / 2, high / 2 - low / 2))
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("int")


def _inside(values: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values of each range, with the range's columns."""
    v, r = values.alias("v"), ranges.alias("r")
    on = F.col("v._v").between(F.col("r.lo"), F.col("r.hi"))
    for c in by:
        on = on & F.col(f"v.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return v.join(r, on).select(*[F.col(f"r.`{c}`") for c in ranges.columns], "v._v", "v._n")


def narrowed(values: DataFrame, by: Sequence[str], targets: DataFrame) -> DataFrame:
    """Targets (by, rank, lo, hi, below, held) until each range holds few values or one."""
    for i in range(PASSES):
        wide = targets.where((F.col("held") > FEW) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        ranges = wide.select(*by, "lo", "hi").distinct()
        counted = _inside(values, ranges, by).withColumn("bin", _bin(i == 0)).groupBy(*by, "lo", "hi", "bin").agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("from"), F.max("_v").alias("to"))
        # at most BINS rows for each range
        earlier = Window.partitionBy(*by, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = counted.withColumn("before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        t, b = wide.alias("t"), bins.alias("b")
        place = F.col("t.rank") - F.col("t.below")
        on = (F.col("t.lo") == F.col("b.lo")) & (F.col("t.hi") == F.col("b.hi")) & (place >= F.col("b.before")) & (
            place < F.col("b.before") + F.col("b._n"))
        for c in by:
            on = on & F.col(f"t.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
        moved = t.join(b, on).select(*[F.col(f"t.`{c}`") for c in by], "t.rank", F.col("b.from").alias("lo"), F.col("b.to").alias("hi"),
                                     (F.col("t.below") + F.col("b.before")).alias("below"), F.col("b._n").alias("held"))
        rest = targets.where((F.col("held") <= FEW) | (F.col("lo") >= F.col("hi")))
        targets = cut(rest.unionByName(moved))
    return targets


def picked(values: DataFrame, by: Sequence[str], targets: DataFrame) -> DataFrame:
    """(by, rank, value): the exact value at each target's rank."""
    ranges = targets.select(*by, "lo", "hi", "below").distinct()
    counted = _inside(values, ranges, by).groupBy(*by, "lo", "hi", "below", "_v").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(*by, "lo", "hi", "below").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("from", F.col("below") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("c")
    t = targets.alias("t")
    on = (F.col("t.rank") >= F.col("c.from")) & (F.col("t.rank") < F.col("c.from") + F.col("c._n"))
    for c in ("lo", "hi", "below", *by):
        on = on & F.col(f"t.`{c}`").eqNullSafe(F.col(f"c.`{c}`"))
    return t.join(placed, on).select(*[F.col(f"t.`{c}`") for c in by], "t.rank", F.col("c._v").alias("value"))


def narrowed_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles ``q0, q1, …`` of each group with its count ``n``, exact.

    Nulls and NaN take no part; groups without values have no row (without ``by``, one row of
    nulls); a null group is a group. An
    infinite value is a value like others, but a quantile between infinite neighbours is NaN.
    """
    by = list(by)
    # equal values count once a task; the shuffle that a full reduction would take is not needed
    values = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").withColumn(
        "_n", F.lit(1).cast("long"))
    values = cut(values)
    totals = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("n > 0")
    wanted = cut(_ranks(totals, probs, by))
    targets = wanted.select(*by, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held")).distinct()
    found = picked(values, by, narrowed(values, by, targets))
    w, f = wanted.alias("w"), found.alias("f")
    on = F.col("w.rank") == F.col("f.rank")
    for c in by:
        on = on & F.col(f"w.`{c}`").eqNullSafe(F.col(f"f.`{c}`"))
    both = w.join(f, on).select(*[F.col(f"w.`{c}`") for c in by], "w.n", "w.level", "w.part", "w.side", "f.value")
    low = [F.max(F.when((F.col("level") == i) & (F.col("side") == 0), F.col("value"))) for i in range(len(probs))]
    high = [F.max(F.when((F.col("level") == i) & (F.col("side") == 1), F.col("value"))) for i in range(len(probs))]
    part = [F.max(F.when(F.col("level") == i, F.col("part"))) for i in range(len(probs))]
    return both.groupBy(*by).agg(F.max("n").alias("n"), *[
        F.when(a == b, a).otherwise(a + (b - a) * p).alias(f"q{i}") for i, (a, b, p) in enumerate(zip(low, high, part, strict=True))])
