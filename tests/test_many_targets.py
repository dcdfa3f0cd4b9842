"""R² of several labels from one correlation matrix against single fits."""

import numpy as np

from doorstep.operators import causal, models
from doorstep.operators.features import independent_columns


def frame(spark, rows=400):
    x = np.random.default_rng(3).normal(size=(rows, 6))
    return spark.createDataFrame([(*map(float, r[:4]), float(r[0] + 2 * r[1]), 1.0, float(r[0] - r[2] + r[4]), float(r[5] + 100))
                                  for r in x], "`a.1` double, b double, `c[x]` double, d double, twin double, flat double, y double, z double")


def test_equal_to_single_fits(spark):
    df = frame(spark)
    names = ["a.1", "b", "c[x]", "d", "twin", "flat"]
    chosen, found = models.linear_r2s(df, ["y", "z"], names)
    assert chosen == independent_columns(df, names) and len(chosen) == 4
    assert np.allclose(found, [models.linear_r2(df, label, chosen) for label in ("y", "z")], rtol=1e-9, atol=1e-9)


def test_latents_are_read_a_few_times_not_once_a_target(spark, monkeypatch):
    df = frame(spark).selectExpr("cast(b * 20 as int) as customer_id", "*")
    monkeypatch.setattr(causal.X, "causal_features", lambda pop: {n: causal.X.tick(n) for n in ("a.1", "b", "d")})
    monkeypatch.setattr(causal.X, "maximal_safe_features", lambda pop: {n: causal.X.tick(n) for n in ("a.1", "b", "c[x]", "d", "twin")})
    made = []
    monkeypatch.setattr(models, "correlation", lambda df, names, own=models.correlation: (made.append(len(names)), own(df, names))[1])
    latents = df.groupBy("customer_id").agg(*[models.F.avg(c).alias(n) for c, n in zip(
        ("`a.1`", "b", "y", "z", "d"), ("latent_trust", "latent_liquidity", "latent_intent", "latent_price_sensitivity", "true_cod_propensity"))])
    got = causal.latent_reconstructibility(df, latents).collect()
    assert len(got) == 10 and len(made) == 4 and {r["n_features"] for r in got} == {3, 4}
    assert all(0 <= r["order_r2"] <= 1 + 1e-9 for r in got)
