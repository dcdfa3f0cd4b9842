"""The lateral join of orders with their first delayed attempt, against the pre-aggregated form."""

from pyspark.sql import functions as F

from doorstep.operators import views


def aggregated(orders, attempts):
    first = attempts.where("attempt_delay_days IS NOT NULL").groupBy("order_id").agg(
        F.min(F.struct("attempt_number", (-F.col("attempt_delay_days")).alias("d"))).alias("f"))
    return orders.select("order_id").join(first, "order_id", "left").select(
        "order_id", "f.attempt_number", (-F.col("f.d")).alias("attempt_delay_days"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ties_nulls_and_orders_without_attempts(spark):
    orders = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), (None,)], "order_id string")
    attempts = spark.createDataFrame(
        [("a", 2, 5), ("a", 1, None), ("a", 3, 1), ("b", 1, 2), ("b", 1, 7), ("b", 1, 7), ("c", 1, None), ("d", 1, 0),
         ("z", 1, 4), (None, 1, 9)], "order_id string, attempt_number int, attempt_delay_days int")
    got = views.first_delayed_attempt(orders, attempts)
    assert rows(got) == rows(spark.createDataFrame(
        [("a", 2, 5), ("b", 1, 7), ("c", None, None), ("d", 1, 0), ("d", 1, 0), (None, None, None)], got.schema))
    assert rows(got) == rows(aggregated(orders, attempts))
    assert views.first_delayed_attempt(orders, attempts.where("false")).where("attempt_number IS NULL").count() == 6


def test_whole_tables_and_plan(model):
    got = views.first_delayed_attempt(model["fct_order"], model["fct_delivery_event"])
    assert rows(got) == rows(aggregated(model["fct_order"], model["fct_delivery_event"]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
