"""Rows are counted while they are written, and a short landing replaces nothing."""

import pytest
from pyspark.sql import functions as F

from doorstep.sources import tables as src


def ids(spark, folder, name):
    return sorted(r[0] for r in spark.read.parquet(f"{folder}/{name}").select("id").collect())


def lose_a_file(monkeypatch, part="incoming-b-"):
    """Takes one file away between writing and counting."""
    count = src.rows_in

    def shortened(spark, path, schema):
        if part in path:
            frame = spark.read.parquet(path)
            src.remove(spark, frame.where("id % 2 = 1").select(F.input_file_name()).first()[0])
        return count(spark, path, schema)
    monkeypatch.setattr(src, "rows_in", shortened)


def test_plan_runs_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch
    df = spark.range(1000, numPartitions=3).mapInArrow(seen, "id bigint")
    counts = src.write_all({"a": df}, str(tmp_path))
    assert runs.value == 1000
    assert [tuple(r) for r in counts.collect()] == [("a", 1000, 1000, True)]


def test_short_landing_keeps_every_old_table(spark, tmp_path, monkeypatch):
    old, new = spark.range(5), spark.range(100, 110, numPartitions=10)
    src.require_equal(src.write_all({"a": old, "b": old}, str(tmp_path)))
    lose_a_file(monkeypatch)
    with pytest.raises(src.ContractError, match="b: 10 rows sent, 9 landed"):
        src.write_all({"a": new, "b": new}, str(tmp_path))
    assert ids(spark, tmp_path, "a") == ids(spark, tmp_path, "b") == list(range(5))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    with pytest.raises(src.ContractError):
        src.write_table(new, str(tmp_path), "b")
    assert ids(spark, tmp_path, "b") == list(range(5))


def test_tables_are_replaced(spark, tmp_path):
    folder = str(tmp_path)
    assert src.write_table(spark.range(5), folder, "a") == 5
    assert src.write_table(spark.range(7, 9).withColumn("day", F.col("id")), folder, "a", ["day"]) == 2
    assert ids(spark, tmp_path, "a") == [7, 8]
    assert src.write_table(spark.range(3).where("id < 0").withColumn("day", F.col("id")), folder, "a", ["day"]) == 0
    assert spark.read.schema("id bigint, day bigint").parquet(f"{folder}/a").count() == 0


def test_a_table_may_be_written_from_itself(spark, tmp_path):
    folder = str(tmp_path)
    src.write_table(spark.range(5), folder, "a")
    assert src.write_table(spark.read.parquet(f"{folder}/a").where("id > 2"), folder, "a") == 2
    assert ids(spark, tmp_path, "a") == [3, 4]


def test_score_sink_is_counted(spark, tmp_path, monkeypatch):
    scores = spark.range(6, numPartitions=6).selectExpr(
        "cast(id as string) AS session_id", "'c' AS customer_id", "id / 6 AS score", "'LOW' AS tier",
        "id > 3 AS restricted_10", "id AS other")
    src.write_scores(scores, str(tmp_path), "m2")
    back = spark.read.parquet(f"{tmp_path}/m2_scores")
    assert back.columns == ["session_id", "customer_id", "score", "tier", "restricted_10"] and back.count() == 6
    monkeypatch.setattr(src, "rows_in", lambda *_: 5)
    with pytest.raises(src.ContractError, match="m2_scores: 6 rows sent, 5 landed"):
        src.write_scores(scores.limit(6), str(tmp_path), "m2")
    assert spark.read.parquet(f"{tmp_path}/m2_scores").count() == 6
