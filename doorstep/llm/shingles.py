"""Native word windows: hashes of consecutive words, and a filter by a fixed-size bitmap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter; with its 64-bit cells it takes 128 KB at any size of either side.
BITS = 20


def columns_of(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with computed columns that later expressions read instead of computing again."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def words_of(text: Column) -> Column:
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(text), r"\s+"))


def window_hashes(words: str, width: int) -> Column:
    """Hashes of each ``width`` consecutive entries of the array column ``words``."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        *[F.get(F.col(words), i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))


def bitmap(hashes: DataFrame) -> str:
    """SQL of an array of longs whose bits are set for the column ``h``: at most 2**BITS bits
    reach the driver, whatever the number of hashes."""
    cells = hashes.select((F.col("h").bitwiseAND(2 ** BITS - 1)).alias("b")).groupBy(
        F.floor(F.col("b") / 64).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("bits")).collect()
    values = [0] * (2 ** BITS // 64)
    for r in cells:
        values[r["cell"]] = r["bits"]
    return "array(" + ",".join(f"{v}L" if v > -2 ** 63 else "(-9223372036854775807L - 1L)" for v in values) + ")"


def maybe_in(h: Column, bits: str) -> Column:
    """Whether the bitmap has the hash's bit; false hits are left to the join."""
    low = h.bitwiseAND(2 ** BITS - 1)
    cell = F.get(F.expr(bits), F.shiftright(low, 6).cast("int"))
    return F.getbit(cell, h.bitwiseAND(63).cast("int")) == 1


def hits(hashes: str, bits: str) -> Column:
    """(i, h) of the windows whose hash may be in the bitmap."""
    return F.filter(F.transform(F.col(hashes), lambda h, i: F.struct(i.alias("i"), h.alias("h"))),
                    lambda x: maybe_in(x["h"], bits))


def edges(first: Column, last: Column) -> Column:
    """Hash of a window's first and last word."""
    return F.xxhash64(first, last)


def window_edges(words: str, width: int) -> Column:
    """For each ``width`` consecutive entries of the array column ``words`` the low bits of their ``edges``, and above them the place."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: edges(
        F.get(F.col(words), i), F.get(F.col(words), i + (width - 1))).bitwiseAND(2 ** BITS - 1).bitwiseOR(
        F.shiftleft(i.cast("long"), BITS)))).otherwise(F.array().cast("array<bigint>"))


def edge_hits(words: str, width: int, ends: str, known: str, bits: str) -> Column:
    """(i, h) of the windows whose edges, in column ``ends``, may be in the bitmap ``known`` and whose hash may be in ``bits``.

    The hash, as of ``window_hashes``, is made for windows of known edges alone."""
    places = F.transform(F.filter(ends, lambda x: maybe_in(x, known)), lambda x: F.shiftright(x, BITS).cast("int"))
    whole = F.transform(places, lambda i: F.struct(
        i.alias("i"), F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)]).alias("h")))
    return F.filter(whole, lambda x: maybe_in(x["h"], bits))
