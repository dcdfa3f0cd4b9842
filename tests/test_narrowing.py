"""Exact quantiles by narrowing histograms against numpy."""

import numpy as np
import pytest

from doorstep.operators import narrowing
from doorstep.operators.ranks import many_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(3)
    rows = [("spread", float(x)) for x in np.exp(draw.normal(size=900) * 20)]
    rows += [("signed", float(x)) for x in draw.normal(size=700) * 1e-9]
    rows += [("ties", float(x)) for x in draw.integers(0, 3, 800)]
    rows += [("near", float(1e15 + x)) for x in draw.integers(0, 50, 500)] + [("one", 4.5)] * 300
    rows += [(None, float(x)) for x in draw.normal(size=200)] + [("holes", None), ("spread", None), ("holes", float("nan"))]
    rows += [("far", x) for x in (-1e308, 1e308, 0.0, 5e-324, -5e-324, 1.0, 1.0 + 2 ** -52)]
    return spark.createDataFrame(rows, "g string, v double").repartition(6)


@pytest.mark.parametrize("few", [1, 20, 4096])
def test_quantiles_against_numpy(spark, frame, monkeypatch, few):
    monkeypatch.setattr(narrowing, "FEW", few)
    got = {r.g: r for r in narrowing.narrowed_quantiles(frame, "v", PROBS, ["g"]).collect()}
    data = frame.toPandas()
    data = data[data.v.notna()]
    assert set(got) == {g if isinstance(g, str) else None for g in data.g.unique()}
    for g, r in got.items():
        v = np.sort(data[data.g.isna() if g is None else data.g == g].v.to_numpy())
        assert r.n == len(v)
        for i, p in enumerate(PROBS):
            at = p * (len(v) - 1)
            a, b = v[int(np.floor(at))], v[int(np.ceil(at))]
            want = a if a == b else a + (b - a) * (at - np.floor(at))
            assert r[f"q{i}"] == want or abs(r[f"q{i}"] - want) <= 1e-12 * abs(want)


def test_no_groups_no_rows(spark, frame):
    whole = narrowing.narrowed_quantiles(frame.where("g = 'one'"), "v", [0.5]).collect()
    assert [(r.n, r.q0) for r in whole] == [(300, 4.5)]
    assert [(r.n, r.q0) for r in narrowing.narrowed_quantiles(frame.where("false"), "v", [0.5]).collect()] == [(None, None)]
    assert narrowing.narrowed_quantiles(frame.where("false"), "v", [0.5], ["g"]).count() == 0


def test_columns_share_the_passes(spark, monkeypatch):
    data = spark.range(20_000).selectExpr("cast(id * id AS double) AS a", "cast(id % 7 AS double) AS b", "sqrt(id) AS c")
    seen = []
    own = narrowing.cut
    monkeypatch.setattr(narrowing, "cut", lambda df: seen.append(1) or own(df))
    got = {r["column"]: r for r in many_quantiles(data, ["a", "b", "c"], [0.1, 0.5]).collect()}
    together = len(seen)
    seen.clear()
    many_quantiles(data, ["a"], [0.5]).collect()
    assert together <= len(seen) + 1
    pdf = data.toPandas()
    assert all(np.isclose(got[c][f"q{i}"], pdf[c].quantile(p), rtol=1e-13) for c in "abc" for i, p in enumerate([0.1, 0.5]))
    assert narrowing.narrowed_quantiles(data, "a", [0.5])._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 0
