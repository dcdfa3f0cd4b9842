import math

import pytest
from pyspark.sql import functions as F

from doorstep import params as P
from doorstep.functions import scalar as S


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_shrunk_rate_prior_and_pull(spark):
    r = one(spark, S.shrunk_rate(F.lit(0), F.lit(0)), S.shrunk_rate(F.lit(1), F.lit(1)),
            S.raw_rate(F.lit(0), F.lit(0)))
    assert r.c0 == pytest.approx(0.165)
    assert r.c1 == pytest.approx((1 + 8 * 0.165) / 9)
    assert r.c2 is None


def test_shrunk_rate_lies_between_raw_and_prior(spark):
    df = spark.createDataFrame([(s, n) for n in range(1, 12) for s in range(n + 1)], "s int, n int")
    rows = df.select(S.shrunk_rate("s", "n").alias("v"), (F.col("s") / F.col("n")).alias("raw"))
    for r in rows.collect():
        assert min(r.raw, P.RTO_PRIOR) - 1e-12 <= r.v <= max(r.raw, P.RTO_PRIOR) + 1e-12


def test_shrunk_rate_rejects_bad_counts(spark):
    with pytest.raises(Exception, match="successes <= trials"):
        one(spark, S.shrunk_rate(F.lit(3), F.lit(2)))
    with pytest.raises(ValueError):
        S.shrunk_rate(F.lit(1), F.lit(2), k=0)


def test_logistic_is_stable_and_logit_guards(spark):
    r = one(spark, S.logistic(F.lit(-800.0)), S.logistic(F.lit(800.0)), S.logit(F.lit(0.25)))
    assert (r.c0, r.c1) == (0.0, 1.0) and r.c2 == pytest.approx(math.log(1 / 3))
    with pytest.raises(Exception, match="0 < p < 1"):
        one(spark, S.logit(F.lit(1.0)))


def test_softmax_with_suppressed_score(spark):
    r = one(spark, S.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(P.SUPPRESSED_SCORE))))
    assert r.c0 == pytest.approx([0.5, 0.5, 0.0])


@pytest.mark.parametrize("n,want", [(None, "0"), (0, "0"), (1, "1-2"), (2, "1-2"), (5, "3-5"),
                                    (15, "6-15"), (16, "16+")])
def test_tenure_bucket_is_right_closed(spark, n, want):
    assert one(spark, S.tenure_bucket(F.lit(n).cast("int"))).c0 == want


def test_rule_tiers(spark):
    t = lambda s, new: S.rule_tier_m1(F.lit(s), F.lit(new))
    r = one(spark, t(0.257, False), t(0.165, False), t(0.1, True), t(0.1, False),
            S.rule_tier_m2(F.lit("HIGH"), F.lit("COD")), S.rule_tier_m2(F.lit("LOW"),
                                                                        F.lit("COD")),
            S.rule_tier_m2(F.lit("LOW"), F.lit("PREPAID")))
    assert list(r) == ["HIGH", "MED", "MED", "LOW", "HIGH", "MED", "LOW"]


def test_lookup_fails_on_unknown_level(spark):
    with pytest.raises(Exception, match="no value declared"):
        one(spark, S.lookup(F.lit("PLASTIC"), {"LIGHT": 1}))


def test_half_even_mean(spark):
    d = lambda x: F.lit(x).cast("decimal(18,2)")
    r = one(spark, S.half_even_mean(d("0.05"), F.lit(2)), S.half_even_mean(d("0.03"), F.lit(2)),
            S.half_even_mean(d("1.00"), F.lit(3)), S.half_even_mean(d("0.00"), F.lit(0)))
    assert [None if x is None else float(x) for x in r] == [0.02, 0.02, 0.33, None]


def test_driver_scalars():
    assert S.chi2_tail_1df(3.841458820694124) == pytest.approx(0.05, abs=1e-9)
    assert S.latent_noise_attenuation(0) == 1.0
    assert S.latent_noise_attenuation(P.NOISE_SD) == pytest.approx(0.480, abs=1e-3)
