"""Designs stand in files while a fit reads them, and are gone afterwards."""

import os
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from doorstep.operators import causal, hypotheses, models
from doorstep.session import checkpoint_dir, forget, keep
from doorstep.sources.driver_model import DriverModel

from .conftest import SF


def folders(spark):
    return {f for f in os.listdir(urlparse(checkpoint_dir(spark)).path) if f.startswith("kept-")}


def cached(spark):
    return spark.sparkContext._jsc.sc().getPersistentRDDs().size()


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    return spark.createDataFrame(
        [(f"S{i}", f"C{i % 40}", int(c), bool(y), ("BOOKS, NEW", "HOME & KITCHEN", "TOYS (ALL)")[i % 3], float(x))
         for i, (c, y, x) in enumerate(zip(draw.integers(0, 2, 900), draw.random(900) < 0.4, draw.normal(size=900)))],
        "session_id string, customer_id string, is_cod int, rto_flag boolean, category string, x double")


def test_forget_deletes_one_table(spark):
    a, b = keep(spark.range(10)), keep(spark.range(20))
    there = folders(spark)
    forget(a)
    assert len(there - folders(spark)) == 1 and b.count() == 20


def test_fit_leaves_nothing(spark, rows):
    before, held = folders(spark), cached(spark)
    feats = {"x": F.col("x"), **{f"cat_{v}": (F.col("category") == v).cast("double") for v in ("BOOKS, NEW", "TOYS (ALL)")}}
    fit = hypotheses._fit(rows, F.col("is_cod"), feats)
    data = rows.select(F.col("is_cod").cast("double").alias("y"), *[c.alias(n) for n, c in feats.items()])
    one = models.fit_logit(data, "y", list(feats))
    assert all(abs(fit.coef[n] - one.coef[n]) < 1e-9 for n in feats)
    assert folders(spark) == before and cached(spark) == held


def test_matching_leaves_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(causal.X, "causal_features", lambda df: {
        "x": F.col("x"), **{f"cat_{v}": (F.col("category") == v).cast("double") for v in ("BOOKS, NEW", "TOYS (ALL)")}})
    before, held = folders(spark), cached(spark)
    out = causal.propensity_matched(rows, caliper=0.5)
    assert folders(spark) == before and cached(spark) == held
    assert out.first().n_treated == rows.where("is_cod = 1").count()


def test_challenger_leaves_nothing(spark, rows):
    before, held = folders(spark), cached(spark)
    data = rows.select(F.struct("session_id", "rto_flag").alias("row"), F.col("x").alias("x[1]"), F.col("is_cod").cast("double").alias("cod"))
    _, score = models.fit_challenger(data, F.col("row.rto_flag"), ["x[1]", "cod"], rounds=2)
    assert folders(spark) == before and cached(spark) == held
    assert score(data).where("score BETWEEN 0 AND 1").count() == 900


def test_released_tables_are_made_again(spark):
    model = DriverModel(spark, SF)
    before = folders(spark)
    state = model["fct_customer_state_at_session"]
    n, made = state.count(), folders(spark) - before
    assert len(made) == 3  # orders, user-days and the state on them
    model.release()
    assert not made & folders(spark)
    assert model["fct_customer_state_at_session"].count() == n
