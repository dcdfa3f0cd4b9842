"""Sessions against DuckDB texts written from the raw tables alone."""

import duckdb

from doorstep.operators import funnel
from doorstep.sources.driver_model import _id

from .conftest import SF


def raw(text):
    con = duckdb.connect()
    for name in ("orders", "customer", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con.execute(text).fetchall()


DAYS = """WITH days AS (
  SELECT user_id, ts::date AS day, count(*) AS n, bool_or(event_type = 'purchase') AS bought,
         count(*) FILTER (WHERE event_type = 'error') AS errors,
         bool_or(event_type <> 'view') AS acted
  FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY ALL)
"""


def test_every_event_is_in_a_session(model):
    assert model["user_days"].agg({"n": "sum"}).first()[0] == raw("SELECT count(*) FROM events")[0][0]
    sessions = model["fct_checkout_session"].where("session_id LIKE 'SES_E%'")
    assert sessions.count() == raw(DAYS + "SELECT count(*) FROM days")[0][0]
    assert sessions.select("session_id").distinct().count() == sessions.count()


def test_funnel_counts_from_raw_tables(model):
    got = [r.n for r in funnel.funnel_steps(model).orderBy("step_no").limit(4).collect()]
    want = raw(DAYS + """SELECT count(*), count(*) FILTER (WHERE acted),
        count(*) FILTER (WHERE errors > 0 OR bought), count(*) FILTER (WHERE bought) FROM days""")[0]
    orders = raw("SELECT count(*) FROM orders")[0][0]
    assert got == [n + orders for n in want]


def test_abandon_steps_from_raw_tables(model):
    got = {r.abandon_step: r.n for r in model["fct_checkout_session"].where("checkout_abandoned")
           .groupBy("abandon_step").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    want = dict(raw(DAYS + """SELECT CASE WHEN errors > 0 THEN 'PAYMENT_FAILURE' WHEN acted THEN 'PAYMENT_PAGE'
        ELSE 'ADDRESS' END, count(*) FROM days WHERE NOT bought GROUP BY 1"""))
    assert got == want


def test_long_keys_keep_every_digit(spark):
    keys = [123456789012, 123456789013, 7]
    ids = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").selectExpr(_id("ORD", "k")).collect()]
    assert ids == ["ORD_123456789012", "ORD_123456789013", "ORD_0000000007"]
