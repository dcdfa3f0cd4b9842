"""Fingerprint trees: what differs between two versions of a table, found from stored sums.

Rows fall into ``FAN ** levels`` leaves by a hash of their key; a node holds the number of its rows and
two order-free sums of their hashes, and is the sum of its children. Two versions are compared from the
root down; only children of differing nodes are looked at, and only rows of differing leaves are read
to name keys. The tree has a fixed size, so it can be kept with every version of a table.

Columns are compared by name, nulls included; a column that only one version has makes every row differ.
Null keys are keys. Rows that repeat a key are compared as one bag of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .artefacts import row_hash

FAN_BITS, LEVELS = 4, 4


def leaf(keys: Sequence[str], levels: int = LEVELS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FAN_BITS * levels)


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("x"),
            F.sum(F.col("h").cast("decimal(38,0)")).alias("s")]


def tree(df: DataFrame, keys: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """(level, node, rows, x, s): level 0 is the root."""
    leaves = df.select(leaf(keys, levels).alias("node"), row_hash(df).alias("h")).groupBy("node").agg(*_sums())
    up = leaves.select("*", F.posexplode(F.array(*[
        F.shiftright("node", FAN_BITS * (levels - level)) for level in range(levels + 1)])).alias("level", "of"))
    return up.groupBy("level", F.col("of").alias("node")).agg(
        F.sum("rows").alias("rows"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))


def differing(old: DataFrame, new: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(node) of the leaves that differ, by descent from the root."""
    found = None
    for level in range(levels + 1):
        a, b = (t.where(F.col("level") == level).select("node", F.struct("rows", "x", "s").alias(c))
                for t, c in ((old, "a"), (new, "b")))
        if found is not None:
            a, b = (t.join(found, F.shiftright("node", FAN_BITS) == F.col("parent"), "left_semi") for t in (a, b))
        found = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(
            F.col("node").alias("parent"))
    return found.withColumnRenamed("parent", "node")


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str], old_tree: DataFrame | None = None,
                 new_tree: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """Keys and ``change``: added, removed or changed. Trees that are not given are built and kept for the descent."""
    old_tree, new_tree = (t if t is not None else cut(tree(df, keys, levels))
                          for df, t in ((old, old_tree), (new, new_tree)))
    leaves = differing(old_tree, new_tree, levels)
    bags = [df.select(*keys, leaf(keys, levels).alias("node"), row_hash(df).alias("h"), F.lit(old_side).alias("old_side"))
            .join(leaves, "node", "left_semi") for df, old_side in ((old, True), (new, False))]
    side = lambda is_old: F.struct(
        F.count_if(F.col("old_side") == is_old).alias("rows"),
        F.coalesce(F.bit_xor(F.when(F.col("old_side") == is_old, F.col("h"))), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.when(F.col("old_side") == is_old, F.col("h").cast("decimal(38,0)"))), F.lit(0)).alias("s"))
    both = bags[0].unionByName(bags[1]).groupBy(*keys).agg(side(True).alias("a"), side(False).alias("b"))
    return both.where(F.col("a") != F.col("b")).select(*keys, F.when(F.col("a.rows") == 0, "added").when(
        F.col("b.rows") == 0, "removed").otherwise("changed").alias("change"))
