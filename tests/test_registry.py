"""Registered queries against their DuckDB text on the smallest tables."""

import os
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

FAST = ["q1_funnel_steps", "q2_conversions", "q3_abandon_steps", "q4_payment_success",
        "q5_rto_by_method", "q8_waterfall", "q12_stratified_cells", "q14_delay_reconciliation",
        "pit_state", "payment_attempts", "delivery_events", "order_economics", "customer_rollup",
        "policy_tier_exposure", "eval_auc_ks", "eval_reliability", "caliper_match_pairs",
        "h3_prior_rto_lift", "foreign_key_orphans", "constraints_fct_order"]


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(6) + 0.0
        else:
            df[c] = df[c].map(lambda v: "" if v is None or v != v else str(v))
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, duck, name):
    got = canonical(entry.queries()[name](spark, SF).toPandas())
    want = canonical(duck.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 80
    try:
        import doorstep.llm.registry  # noqa: F401
    except ImportError:
        assert not [n for n in q if n == "pipeline" or n.startswith("op")]


def test_entry_without_training_data_operators(monkeypatch):
    """A left-over folder without modules, or a missing library, takes only their queries away."""
    monkeypatch.setitem(sys.modules, "doorstep.llm.registry", None)
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 80
    assert not [n for n in q if n == "pipeline" or n.startswith("op")]


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 2


def test_twins_agree(spark, model):
    from doorstep.operators.crosscheck import compare_all
    names = ["q1_funnel_steps", "q3_abandon_steps", "q5_rto_by_method", "q9_segment_breakeven"]
    out = compare_all(model, names)
    assert out.count() > 30 and out.where("not ok").count() == 0


def test_a_wrong_twin_is_caught(spark):
    from doorstep.operators.crosscheck import compare
    a = spark.createDataFrame([("x.n", 1.0), ("x.rate", 0.50001)], "metric string, value double")
    b = spark.createDataFrame([("x.n", 2.0), ("x.rate", 0.5), ("y.n", 1.0)],
                              "metric string, value double")
    assert {r.metric: r.ok for r in compare(a, b).collect()} == {
        "x.n": False, "x.rate": True, "y.n": False}
