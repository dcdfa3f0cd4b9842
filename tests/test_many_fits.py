"""Models fitted together against single fits."""

import numpy as np
import pytest

from doorstep.operators import irls
from doorstep.operators.models import fit_logit


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(1500, 5))
    t = (draw.random(1500) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    y = (draw.random(1500) < 1 / (1 + np.exp(-(0.4 * t + x[:, 0] - 0.7 * x[:, 3] - 1)))).astype(float)
    rows = [(*map(float, a), float(b), float(c)) for a, b, c in zip(x, t, y)]
    return spark.createDataFrame(rows, "`a.1` double, b double, c double, `d[x]` double, e double, t double, y double").repartition(5)


MODELS = {"all": ["t", "a.1", "b", "c", "d[x]", "e"], "none": [], "treated": ["t"], "no d": ["t", "a.1", "b", "c", "e"],
          "twice": ["t", "b"]}


def test_together_equals_single(frame):
    fits, passes = irls.fit_many(frame, "y", MODELS)
    assert list(fits) != [] and set(fits) == set(MODELS) and passes < 15
    for name, names in MODELS.items():
        one = fit_logit(frame, "y", names)
        assert fits[name].converged and abs(fits[name].intercept - one.intercept) < 1e-8
        assert all(abs(fits[name].coef[n] - one.coef[n]) < 1e-8 for n in names)
        assert abs(fits[name].deviance - one.deviance) < 1e-6 and abs(fits[name].null_deviance - one.null_deviance) < 1e-6
        if names:
            a, b = (f.score(frame).groupBy().avg("p").first()[0] for f in (fits[name], one))
            assert abs(a - b) < 1e-10


def test_passes_do_not_grow_with_models(frame, monkeypatch):
    one = irls.fit_many(frame, "y", {"all": MODELS["all"]})[1]
    many = {f"m{i}": MODELS["all"][:1 + i % 6] for i in range(20)} | {"all": MODELS["all"]}
    assert irls.fit_many(frame, "y", many)[1] <= one + 1


def test_gains(frame):
    fits, _ = irls.fit_many(frame, "y", MODELS)
    got = irls.average_gains(frame, "t", fits)
    data = frame.toPandas()
    for name, fit in fits.items():
        off = 0 * data.t + fit.intercept + sum(fit.coef[n] * data[n] for n in fit.names if n != "t")
        gain = 1 / (1 + np.exp(-off - fit.coef.get("t", 0))) - 1 / (1 + np.exp(-off))
        assert np.allclose(got[name], (100 * gain.mean(), 100 * gain[data.t == 1].mean()), atol=1e-10)


def test_awkward_frames(spark, frame):
    nothing, _ = irls.fit_many(frame.where("false"), "y", MODELS)
    assert all(f.rows == 0 and np.isnan(f.intercept) for f in nothing.values())
    holes = frame.selectExpr("y", "t", "if(b > 1, null, b) AS b")
    fits, _ = irls.fit_many(holes, "y", {"b": ["b"], "t": ["t"]})
    assert fits["b"].rows == fits["t"].rows == frame.where("b <= 1").count()
    apart = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, y double")
    assert not irls.fit_many(apart, "y", {"x": ["x"]}, passes=12)[0]["x"].converged
    twins = frame.selectExpr("y", "b", "2 * b AS bb")
    one, two = irls.fit_many(twins, "y", {"one": ["b"], "two": ["b", "bb"]})[0].values()
    assert abs(one.deviance - two.deviance) < 1e-8
