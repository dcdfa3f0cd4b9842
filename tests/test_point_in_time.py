import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from doorstep.operators import pit
from doorstep.schemas import schema
from doorstep.streaming import online

D0 = dt.date(2026, 1, 10)


def at(day, hour):
    return dt.datetime.combine(D0 + dt.timedelta(days=day), dt.time(hour))


def sessions(spark, rows):
    return spark.createDataFrame(
        [(s, c, ts, ts.date(), m, n, False, None) for s, c, ts, m, n in rows],
        "session_id string, customer_id string, session_start_ts timestamp_ntz, date_id date, "
        "final_payment_method string, payment_attempt_count int, "
        "switched_to_cod_after_failure boolean, abandon_step string")


def orders(spark, rows):
    return spark.createDataFrame(
        [(c, ts, Decimal(v), m, res, rto, None if rto is None else not rto)
         for c, ts, v, m, res, rto in rows],
        "customer_id string, order_ts timestamp_ntz, order_value decimal(10,2), "
        "payment_method string, outcome_resolved_date date, rto_flag boolean, "
        "is_delivered boolean")


CUSTOMER = "customer_id string, signup_date date, pre_window_orders int, " \
    "pre_window_delivered int, pre_window_rto_count int, pre_window_cod_orders int, " \
    "pre_window_prepaid_success int, pre_window_payment_failures int"


@pytest.mark.parametrize("resolved_after,resolved,rto", [(4, 3, 2), (5, 2, 1)])
def test_two_clocks(spark, resolved_after, resolved, rto):
    s = sessions(spark, [("s1", "c", at(0, 10), "COD", 0), ("s2", "c", at(0, 18), None, 0),
                         ("s3", "c", at(5, 9), None, 0)])
    o = orders(spark, [("c", at(0, 10), "100.00", "COD",
                        D0 + dt.timedelta(days=resolved_after), True)])
    c = spark.createDataFrame([("c", D0 - dt.timedelta(days=30), 2, 1, 1, 1, 1, 0)], CUSTOMER)
    got = {r.session_id: r for r in pit.state_at_session(s, c, o).collect()}
    assert (got["s1"].pit_orders_placed, got["s1"].pit_days_since_last_order) == (2, None)
    assert (got["s2"].pit_orders_placed, got["s2"].pit_orders_resolved) == (3, 2)
    assert got["s2"].pit_days_since_last_order == 0
    assert got["s2"].pit_avg_order_value == Decimal("100.00")
    assert (got["s3"].pit_orders_placed, got["s3"].pit_orders_resolved,
            got["s3"].pit_rto_count) == (3, resolved, rto)
    assert got["s3"].pit_tenure_days == 35


def test_simultaneous_orders_do_not_see_each_other(spark):
    s = sessions(spark, [("a", "c", at(0, 9), "COD", 0), ("b", "c", at(0, 9), "COD", 0)])
    o = orders(spark, [("c", at(0, 9), "10.00", "COD", None, None)] * 2)
    got = pit.counters_at_session(s, o).select("in_placed").toPandas()["in_placed"]
    assert got.tolist() == [0, 0]


def test_payment_results_count_from_the_next_session(spark):
    s = sessions(spark, [("a", "c", at(0, 9), "PREPAID", 2), ("b", "c", at(0, 11), None, 0)])
    got = {r.session_id: r for r in pit.counters_at_session(s, orders(spark, [])).collect()}
    assert (got["a"].in_success, got["a"].in_failure) == (0, 0)
    assert (got["b"].in_success, got["b"].in_failure) == (1, 1)


def test_busy_customer_matches_brute_force(spark, model):
    s, o = model["fct_checkout_session"], model["fct_order"]
    hot = lambda df: df.withColumn("customer_id", F.when(
        F.crc32(F.col("session_id").cast("binary")) % 3 == 0, "HOT")
        .otherwise(F.col("customer_id")))
    s, o = hot(s).persist(), hot(o).persist()
    want = s.alias("s").join(o.alias("o"), F.col("s.customer_id") == F.col("o.customer_id"),
                             "left").groupBy("s.session_id").agg(
        F.count_if(F.col("o.order_ts") < F.col("s.session_start_ts")).alias("p"),
        F.count_if(F.col("o.outcome_resolved_date") < F.col("s.date_id")).alias("r"))
    j = pit.counters_at_session(s, o).join(want, "session_id")
    assert j.count() == s.count()
    assert j.where("in_placed <> p or in_resolved <> r").count() == 0


def test_snapshot_has_one_row_per_session(model):
    assert model["fct_customer_state_at_session"].count() == model["fct_checkout_session"].count()


def test_stream_equals_batch(spark, model, tmp_path):
    from doorstep.sources.tables import conform
    s = conform(model["fct_checkout_session"], schema("fct_checkout_session"))
    o = conform(model["fct_order"], schema("fct_order"))
    feed = online.activity(s, o)
    cuts = ["1998-01-01", "2000-01-01", "2100-01-01"]
    low = "1900-01-01"
    for i, high in enumerate(cuts):
        feed.where((F.col("day") >= low) & (F.col("day") < high)).coalesce(1).write.parquet(
            f"{tmp_path}/in/part={i}")
        low = high
    src = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{tmp_path}/in/*")
    job = online.OnlineCounters(f"{tmp_path}/state")
    q = job.attach(src).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    cols = ["session_id", "in_placed", "in_cod", "in_resolved", "in_rto", "in_delivered"]
    got, want = job.result(spark).select(*cols), pit.counters_at_session(s, o).select(*cols)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_weeks_appear_only_once_matured(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 5) + dt.timedelta(days=d), "COD", d % 2 == 0)
            for d in range(60)]
    df = spark.createDataFrame(rows, "order_ts timestamp, payment_method string, rto_flag boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/o")
    out = online.matured_weeks(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/o"))
    q = out.writeStream.format("memory").queryName("weeks").outputMode("append").trigger(
        availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(r.week_of for r in spark.table("weeks").collect())
    last = rows[-1][0].date() - dt.timedelta(days=25)
    assert got and max(got) + dt.timedelta(days=7) <= last
    assert got[0] == dt.date(2026, 1, 5)
