"""SQL functions against the column functions, with nulls and guards."""

import pytest
from pyspark.sql import functions as F

from doorstep.functions import scalar, shared_sql

RATES = "s bigint, n bigint, x double, new boolean"


def test_equal_to_the_columns_and_inlined(spark):
    shared_sql.install(spark)
    shared_sql.install(spark)
    rows = [(0, 0, -800.0, True), (1, 3, 800.0, False), (5, 8, 0.0, False), (None, 4, None, None), (2, None, -1.5, True), (9, 9, 2.0, False)]
    df = spark.createDataFrame(rows, RATES)
    got = spark.sql("""SELECT ratio(s, n), raw_rate(s, n), shrunk_rate(s, n), logistic(x),
                       rule_tier_m1(shrunk_rate(s, n), new) FROM {df}""", df=df)
    want = df.select(scalar.ratio("s", "n"), scalar.raw_rate("s", "n"), scalar.shrunk_rate("s", "n"),
                     scalar.logistic("x"), scalar.rule_tier_m1(scalar.shrunk_rate("s", "n"), F.col("new")))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "SQLFunction" not in plan and "Join" not in plan and plan.count("Project") <= 2


@pytest.mark.parametrize("s, n", [(2, 1), (-1, 4), (0, -1)])
def test_bad_counts_stop_the_query(spark, s, n):
    shared_sql.install(spark)
    df = spark.createDataFrame([(s, n)], "s bigint, n bigint")
    with pytest.raises(Exception, match="successes <= trials"):
        spark.sql("SELECT shrunk_rate(s, n) FROM {df}", df=df).collect()
