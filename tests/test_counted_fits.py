"""The sixth hypothesis on counted values against fits on single orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doorstep.operators import hypotheses as H, irls
from doorstep.operators.features import independent_columns
from doorstep.operators.models import fit_logit
from doorstep.plans import causal_queries as Q

DRAW = np.random.default_rng(5)


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(("METRO", "TIER2", "TIER3")[i % 3], float(s) / 10, int(d), int(a), bool(y)) for i, (s, d, a, y) in enumerate(zip(
        DRAW.integers(1, 9, 4000), DRAW.integers(2, 8, 4000), DRAW.integers(-2, 6, 4000), DRAW.random(4000) < 0.3))]
    # an attempt delay that all but decides the outcome leaves cells with one outcome alone
    rows += [("METRO", 0.5, 3, 9, True)] * 800 + [("METRO", 0.5, 3, 9, False)]
    return spark.createDataFrame(rows, "geo_tier string, serviceability_score double, estimated_delivery_days int, "
                                 "attempt_delay_days int, rto_flag boolean").withColumns(
        {"is_shipped": F.lit(True), "is_censored": F.lit(False), "paid": F.rand(1)})


def test_deviance_of_counted_values(orders, monkeypatch):
    sizes = []
    packed = irls._packed
    monkeypatch.setattr(irls, "_packed", lambda df, *a, **k: sizes.append(df.count()) or packed(df, *a, **k))
    got = {r.term: r for r in H.deviance_comparison(orders).collect()}
    assert sizes and max(sizes) < 2000  # a fit reads the values, not the 4,801 orders
    names = ["t2", "t3", "s", "estimated_delivery_days", "attempt_delay_days"]
    data = orders.select((F.col("geo_tier") == "TIER2").cast("double").alias("t2"), (F.col("geo_tier") == "TIER3").cast("double").alias("t3"),
                         F.col("serviceability_score").alias("s"), *[F.col(c).cast("double") for c in names[3:]],
                         F.col("rto_flag").cast("double").alias("y"))
    full = fit_logit(data, "y", names)
    for t in names[3:]:
        less = fit_logit(data, "y", [n for n in names if n != t])
        r = got[t]
        assert r.n == 4801 and abs(r.full_deviance - full.deviance) < 1e-6
        assert abs(r.deviance_contribution - (less.deviance - full.deviance)) < 1e-6
        assert abs(r.coefficient - full.coef[t]) < 1e-8 and abs(r.se - full.se[t]) < 1e-7


def test_promise_of_counted_values(orders):
    got = H.promise_effect(orders).first()
    data = orders.select((F.col("geo_tier") == "TIER2").cast("double").alias("t2"), (F.col("geo_tier") == "TIER3").cast("double").alias("t3"),
                         F.col("estimated_delivery_days").cast("double").alias("d"), F.col("rto_flag").cast("double").alias("y"))
    one = fit_logit(data, "y", independent_columns(data, ["t2", "t3", "d"]))
    assert abs(got.promise_coefficient - one.coef["d"]) < 1e-8 and abs(got.promise_se - one.se["d"]) < 1e-7
    assert abs(got.promise_pseudo_r2 - one.pseudo_r2) < 1e-9


def test_a_null_is_refused(orders):
    with pytest.raises(Exception, match="null"):
        H.promise_effect(orders.withColumn("estimated_delivery_days", F.lit(None).cast("int").alias("d")).union(orders)).collect()


def test_orders_hold_what_is_asked(model):
    assert Q.orders_of(model, *Q.PROMISE).columns == list(Q.PROMISE)
