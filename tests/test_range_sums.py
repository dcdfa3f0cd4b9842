"""Sums before an instant against brute force; every stored counter's check catches a planted fault."""

import random

from pyspark.sql import functions as F

from doorstep.operators import quality as Q
from doorstep.operators.rangesum import totals_before


def test_totals_before_against_brute_force(spark):
    draw = random.Random(1)
    at = lambda: draw.choice([0, 1, 2, 1023, draw.randrange(1024), draw.randrange(1024)])
    events = [(draw.choice("abc"), at(), draw.randrange(9), 1) for _ in range(300)] + [("a", None, 5, 1), (None, 3, 5, 1), ("a", 5000, 1, 1)]
    points = [(draw.choice("abcd"), at()) for _ in range(200)] + [(None, 5), ("a", None), ("a", -1)]
    got = totals_before(spark.createDataFrame(points, "who string, at long"), spark.createDataFrame(
        events, "who string, at long, v long, n long"), "who", "at", ["v", "n"], 10).collect()
    want = {(w, t): tuple(sum(e[i] for e in events if e[0] == w and e[1] is not None and e[1] < t) for i in (2, 3))
            for w, t in points if w is not None and t is not None and t >= 0}
    assert {(r.who, r["at"]): (r.v, r.n) for r in got} == want and len(got) == len(want)
    none = spark.createDataFrame([], "who string, at long, v long, n long")
    assert totals_before(none, none, "who", "at", ["v", "n"], 10).count() == 0


def test_plan_has_no_window(spark, model):
    plan = Q.rederived_counters(model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    own = totals_before(spark.range(9).select(F.lit("a").alias("k"), F.col("id").alias("t")), spark.range(9).select(
        F.lit("a").alias("k"), F.col("id").alias("t"), F.lit(1).alias("n")), "k", "t", ["n"], 8)
    assert "Window" not in own._jdf.queryExecution().executedPlan().toString()


def test_a_wrong_counter_is_caught(spark, model):
    state = model["fct_customer_state_at_session"]
    some = [r.session_id for r in state.select("session_id").orderBy("session_id").limit(len(Q.REDERIVED)).collect()]
    wrong = state.withColumns({c: F.when(F.col("session_id") == s, F.col(c) + 1).otherwise(F.col(c))
                               for c, s in zip(Q.REDERIVED, some, strict=True)})
    tables = {**{n: model[n] for n in ("fct_order", "fct_checkout_session", "customer_base")}, "fct_customer_state_at_session": wrong}
    assert {r.counter: r.mismatches for r in Q.pit_mismatches(tables).collect()} == dict.fromkeys(Q.REDERIVED, 1)
    (r,) = Q.pit_integrity(tables).collect()
    assert r.status == "FAIL" and all(f"{c} 1" in r.actual for c in Q.REDERIVED)
    gone = {**tables, "fct_customer_state_at_session": state.where(F.col("session_id") != some[0])}
    assert {r.mismatches for r in Q.pit_mismatches(gone).collect()} == {1}
    whole = {**tables, "fct_customer_state_at_session": state}
    assert Q.pit_integrity(whole).first().status == "PASS"


def test_keys_of_few_instants_post_no_nodes(spark):
    few = spark.range(900).select((F.col("id") % 90).cast("string").alias("k"), F.col("id").alias("t"), F.lit(1).alias("n"))
    sums = totals_before(few, few, "k", "t", ["n"], 16)
    assert {(r.k, r.t): r.n for r in sums.collect()} == {(str(i % 90), i): i // 90 for i in range(900)}
    made = sums._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    assert "Generate" not in made
    busy = few.unionByName(spark.range(500).select(F.lit("0").alias("k"), (F.col("id") * 3 + 1).alias("t"), F.lit(1).alias("n")))
    got = {(r.k, r.t): r.n for r in totals_before(busy, busy, "k", "t", ["n"], 16).collect()}
    rows = [tuple(r) for r in busy.collect()]
    assert got == {(k, t): sum(a == k and b < t for a, b, _ in rows) for k, t, _ in rows}
