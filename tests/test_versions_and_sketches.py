"""Fingerprint trees name what was planted; merged sketches keep their bounds."""

import datetime as dt

from pyspark.sql import functions as F

from doorstep.operators import sketches
from doorstep.sources import merkle
from doorstep.sources.artefacts import compare_manifests, manifest

SCHEMA = "k string, x int, y string"


def test_planted_changes_are_named(spark):
    rows = [(f"k{i}", i % 7, None if i % 5 == 0 else "v") for i in range(3000)] + [(None, 1, "n"), ("twice", 1, "a"), ("twice", 1, "a")]
    old = spark.createDataFrame(rows, SCHEMA)
    new = old.where("k IS DISTINCT FROM 'k17'").withColumn("x", F.when(F.col("k") == "k18", 99).otherwise(F.col("x"))).withColumn(
        "y", F.when(F.col("k").isNull(), None).when(F.col("k") == "k20", "now").otherwise(F.col("y"))).unionByName(
        spark.createDataFrame([("fresh", 1, "z"), ("twice", 1, "a")], SCHEMA))
    want = {"k17": "removed", "k18": "changed", "k20": "changed", None: "changed", "fresh": "added", "twice": "changed"}
    trees = [merkle.tree(d, ["k"]).persist() for d in (old, new)]
    assert {r.k: r.change for r in merkle.changed_keys(old, new, ["k"], *trees).collect()} == want
    assert {r.k: r.change for r in merkle.changed_keys(old, new, ["k"], levels=1).collect()} == want
    assert merkle.differing(*trees).count() <= len(want)
    assert merkle.changed_keys(old, old.repartition(7).select("y", "k", "x"), ["k"]).count() == 0
    empty = old.limit(0)
    assert merkle.changed_keys(empty, empty, ["k"]).count() == 0
    assert {r.change for r in merkle.changed_keys(empty, new, ["k"]).collect()} == {"added"}


def test_a_node_is_the_sum_of_its_children(spark):
    tree = merkle.tree(spark.range(500).withColumn("v", F.col("id") * 3), ["id"])
    root = tree.where("level = 0").first()
    for level in range(1, merkle.LEVELS + 1):
        r = tree.where(F.col("level") == level).agg(F.sum("rows"), F.bit_xor("x"), F.sum("s")).first()
        assert tuple(r) == (500, root.x, root.s) and root["rows"] == 500


def test_manifests_say_which_table_moved(spark):
    a, b = spark.range(10).toDF("k"), spark.range(11).toDF("k")
    got = compare_manifests(manifest({"same": a, "moved": a, "gone": a}), manifest({"same": a, "moved": b, "new": b}))
    assert {r.table: r.verdict for r in got.collect()} == {
        "same": "IDENTICAL", "moved": "DATA MOVED", "gone": "MISSING", "new": "NEW"}


def facts(spark):
    day = F.date_add(F.lit(dt.date(2024, 1, 20)), (F.col("id") % 60).cast("int"))
    return spark.range(40000).select(
        day.alias("day"), F.concat(F.lit("c"), (F.col("id") * 7919 % 15000).cast("string")).alias("who"),
        F.when(F.col("id") % 11 > 0, F.pow((F.col("id") * 31 % 1000) / 10, 2)).alias("v"))


def test_merged_days_keep_their_bounds(spark):
    got = sketches.report(facts(spark), "day", "month", "who", "v").collect()
    assert len(got) == 3 and sum(r["rows"] for r in got) == 40000
    assert all(r.ids_within and r.ranks_within and r.merge_is_whole for r in got)


def test_merging_in_steps_and_a_wrong_estimate(spark):
    df = facts(spark)
    days = sketches.daily(df, "day", "who", "v")
    months = sketches.merged(days, F.trunc("day", "month"))
    years = [sketches.estimates(sketches.merged(x, F.trunc(c, "year"))).first() for x, c in ((days, "day"), (months, "period"))]
    assert years[0].n_ids == years[1].n_ids and years[0].n_values == years[1].n_values == df.where("v IS NOT NULL").count()
    wrong = sketches.estimates(sketches.merged(days.where("day < '2024-02-10'"), F.trunc("day", "year")))
    off = sketches.errors(df, F.trunc("day", "year"), "who", "v", wrong.withColumn("estimates", F.transform("estimates", lambda x: x * 2))).first()
    assert off.rank_error > sketches.rank_bound()
    none = df.withColumns({"who": F.lit(None).cast("string"), "v": F.lit(None).cast("double"), "day": F.lit(None).cast("date")})
    r = sketches.report(none, "day", "month", "who", "v").first()
    assert (r["period"], r["rows"], r.exact_ids, r.ids_within, r.ranks_within) == (None, 40000, 0, True, True)
    assert sketches.report(df.limit(0), "day", "month", "who", "v").count() == 0


def test_a_week_of_one_partition_equals_its_days(spark):
    """One task sees the whole week, so the direct sketch is never merged; the days' sketches are."""
    rows = spark.range(0, 60_000, 1, 1).select(
        F.expr("date_add(date'2024-01-01', cast(id * 4 div 60000 as int))").alias("day"),
        (F.col("id") % 30_000).alias("user"), F.col("id").cast("double").alias("v"))
    row = sketches.report(rows, "day", "week", "user", "v").first()
    assert row.exact_ids == 30_000 and row.ids_within and row.ranks_within and row.merge_is_whole
