"""Sums over everything earlier, by a range join on dyadic nodes instead of a window.

Time is a whole number below 2**``bits``. The instants before x split into one node for each set
bit k of x: the 2**k instants that begin where bit k of x is cleared. An event belongs to one node of
every level; those that a point can ask for have an even number, so about half of them are posted.
Points and events then meet by equality of (key, level, node), and a point adds up at most ``bits``
sums. No rows of one busy key are gathered: its events are summed for each node with partial sums
before the shuffle, and the key spreads over its nodes. A key of at most ``FEW`` instants needs no nodes:
each of its points meets these few instants directly, which costs less than posting and looking up nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days and seconds since 1970 fit in these until the year 2106.
DAY_BITS, SECOND_BITS = 16, 32
#: Instants of a key up to which its points meet them one by one.
FEW = 64


def asked_nodes(x: Column, bits: int) -> Column:
    """Array of (level, node) that make up all instants before x."""
    levels = F.sequence(F.lit(0), F.lit(bits - 1))
    of = lambda k: F.call_function("shiftright", x, k)
    return F.transform(F.filter(levels, lambda k: of(k) % 2 == 1), lambda k: F.struct(
        k.alias("level"), (of(k) - 1).alias("node")))


def posted_nodes(x: Column, bits: int) -> Column:
    """Array of (level, node) in which a point after x may look for x."""
    levels = F.sequence(F.lit(0), F.lit(bits - 1))
    of = lambda k: F.call_function("shiftright", x, k)
    return F.transform(F.filter(levels, lambda k: of(k) % 2 == 0), lambda k: F.struct(
        k.alias("level"), of(k).alias("node")))


def totals_before(points: DataFrame, events: DataFrame, key: str, at: str, sums: Sequence[str],
                  bits: int) -> DataFrame:
    """Distinct (key, at) of ``points`` with the sums of all events of the key strictly before.

    ``at`` is a whole number from 0 below 2**bits on both sides; rows without it, or without a key,
    take no part. Points without an earlier event have zeros.
    """
    place = F.col(at).cast("long")
    usable = F.col(key).isNotNull() & place.between(0, 2 ** bits - 1)
    asked = points.where(usable).select(key, place.alias(at)).distinct()
    posted = events.where(usable).groupBy(key, place.alias(at)).agg(*[F.sum(c).alias(c) for c in sums])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    busy = posted.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(key)
    of = lambda df, how: df.join(busy, key, how)
    few = of(posted, "left_anti").select(F.col(key).alias("_key"), F.col(at).alias("_at"), *sums)
    earlier = (F.col(key) == F.col("_key")) & (F.col("_at") < F.col(at))
    direct = of(asked, "left_anti").join(few, earlier, "left").groupBy(key, at).agg(*[F.sum(c).alias(c) for c in sums])
    nodes = of(posted, "left_semi").select(key, *sums, F.inline(posted_nodes(F.col(at), bits))).groupBy(
        key, "level", "node").agg(*[F.sum(c).alias(c) for c in sums])
    points_of_busy = of(asked, "left_semi")
    looked = points_of_busy.select(key, at, F.inline(asked_nodes(F.col(at), bits)))
    found = looked.join(nodes, [key, "level", "node"]).groupBy(key, at).agg(
        *[F.sum(c).alias(c) for c in sums])
    return direct.unionByName(points_of_busy.join(found, [key, at], "left").select(key, at, *sums)).select(
        key, at, *[zero(c) for c in sums])
