"""What several scans of one query read is derived once and written."""

import pytest
from pyspark.sql import functions as F

from doorstep.operators import quality as Q, reasons, traces, views
from doorstep.session import keep
from doorstep.sources.driver_model import DriverModel

from .conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kept_tables_hold_the_same_rows(spark):
    df = spark.range(7).select("id", (F.col("id") * F.lit("1.25").cast("decimal(5,2)")).alias("v"),
                               F.when(F.col("id") > 2, F.lit("x")).alias("s"), F.array("id").alias("a"))
    got = keep(df)
    assert got.dtypes == df.dtypes
    assert sorted(got.collect()) == sorted(df.collect())


@pytest.mark.parametrize("build", [views.risk_model_input, views.hypothesis_population, traces.model_frame,
                                   traces.scored_sessions, reasons.reason_drivers, Q.pit_mismatches,
                                   lambda m: Q.conditional_sweep(m, ["fct_customer_state_at_session", "fct_order"])])
def test_neither_state_nor_orders_are_derived_again(spark, build):
    plan = plan_of(build(DriverModel(spark, SF)))
    assert "Window" not in plan, "the state is derived inside the query's plan"
    assert "min_by" not in plan, "order lines are summed inside the query's plan"


def test_the_sweep_joins_one_row_of_flags_a_session(spark):
    orders = spark.createDataFrame([("o1", "s1"), ("o2", "s2"), ("o3", "s2")], "order_id string, session_id string")
    steps = spark.createDataFrame([("s1", "x", None), ("s1", None, None), ("s2", None, 1), ("s9", "y", 1)],
                                  "session_id string, a string, b int")
    grain = Q._order_grain("fct_checkout_event", steps, orders)
    assert {tuple(r) for r in grain.collect()} == {("o1", True, False), ("o2", False, True), ("o3", False, True)}
    plan = plan_of(grain)
    assert plan.count("Aggregate") == 2 and plan.index("Join") < plan.rindex("Aggregate")
