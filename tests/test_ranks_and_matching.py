import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doorstep.operators import evaluate, matching, ranks


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    # a third of the rows share one score
    rows = [(f"k{i:04d}", 0.5 if rng.random() < 0.33 else round(rng.random(), 2),
             int(rng.random() < 0.3)) for i in range(400)]
    return spark.createDataFrame(rows, "k string, score double, y int"), rows


def test_auc_and_ks_equal_brute_force(scored):
    df, rows = scored
    got = ranks.auc_ks(ranks.score_table(df, "score", "y")).first()
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert got.auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    grid = sorted({s for _, s, _ in rows})
    ks = max(abs(np.mean([p <= g for p in pos]) - np.mean([n <= g for n in neg])) for g in grid)
    assert got.ks == pytest.approx(ks, abs=1e-12)


def test_auc_edges(spark):
    f = lambda rows: ranks.auc_ks(ranks.score_table(
        spark.createDataFrame(rows, "s double, y int"), "s", "y")).first().auc
    assert f([(0.3, 0), (0.3, 1), (0.3, 1)]) == 0.5
    assert f([(0.1, 0), (0.2, 0), (0.9, 1)]) == 1.0
    assert f([(0.1, 1), (0.2, 1)]) is None


@pytest.mark.parametrize("k", [10, 8])
def test_equal_count_bins_match_pandas(scored, k):
    df, rows = scored
    pdf = pd.DataFrame(rows, columns=["k", "score", "y"]).sort_values(["score", "k"])
    pdf["want"] = pd.qcut(pdf["score"].rank(method="first"), k, labels=False)
    got = ranks.equal_count_bins(df, ["score", "k"], k).toPandas().set_index("k")["bin"]
    assert (got.loc[pdf["k"]].to_numpy() == pdf["want"].to_numpy()).all()


def test_quantile_bins_match_pandas(scored):
    df, rows = scored
    pdf = pd.DataFrame(rows, columns=["k", "score", "y"])
    want = pd.qcut(pdf["score"], 10, labels=False, duplicates="drop")
    got = ranks.quantile_bins(df, "score", 10).toPandas().set_index("k")["bin"]
    assert (got.loc[pdf["k"]].to_numpy() == want.to_numpy()).all()


def test_quantiles_match_numpy_by_group(scored):
    df, rows = scored
    probs = [0.0, 0.1, 0.5, 0.83, 1.0]
    got = {r.y: r for r in ranks.quantiles(df, "score", probs, ["y"]).collect()}
    for y in (0, 1):
        want = np.quantile([s for _, s, v in rows if v == y], probs)
        assert [got[y][f"q{i}"] for i in range(5)] == pytest.approx(list(want))


def test_average_ranks_and_spearman(spark):
    rows = [(1, 2.0), (2, 2.0), (3, 5.0), (4, 1.0), (5, 9.0), (5, 7.0)]
    df = spark.createDataFrame(rows, "a int, b double")
    got = {r.a: r.rank for r in ranks.average_ranks(df.select("a"), "a").distinct().collect()}
    assert got[5] == 5.5
    rho, p = ranks.spearman(df, "a", "b")
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    assert rho == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()))
    assert 0 < p < 1


def test_lift_captures_everything(scored):
    df, _ = scored
    t = evaluate.decile_lift(evaluate.reliability(df, "score", "y", "k")).toPandas()
    assert t["captured_pct"].iloc[-1] == pytest.approx(100)
    assert t["decile"].tolist() == list(range(1, 11))


def brute_match(rows, width):
    """Two candidates per treated row from a sorted control list."""
    ctrl = sorted((x, k, y) for k, t, x, y in rows if not t)
    xs = np.array([c[0] for c in ctrl])
    out = {}
    for k, t, x, y in rows:
        if not t:
            continue
        i, best, dist = int(np.searchsorted(xs, x)), None, float("inf")
        for j in (i - 1, i):
            if 0 <= j < len(ctrl) and abs(ctrl[j][0] - x) < dist:
                best, dist = ctrl[j], abs(ctrl[j][0] - x)
        out[k] = best[1] if best is not None and dist <= width else None
    return out


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_matching_equals_brute_force(spark, hot):
    rng = random.Random(11)
    rows = [(f"k{i:04d}", int(rng.random() < 0.6),
             1.0 if rng.random() < hot else round(rng.gauss(0, 1), 2), float(rng.random() < 0.3))
            for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double")
    pairs = matching.nearest_controls(df, score="x", treated="t", key="k", outcome="y",
                                      caliper_width=0.05)
    got = {r.treated_key: r.control_key for r in pairs.collect()}
    assert got == brute_match(rows, 0.05)
    e = matching.matched_effect(pairs).first()
    assert e.n_treated == sum(t for _, t, _, _ in rows)
    assert e.n_matched_pairs + e.unmatched_cod == e.n_treated


def test_matching_without_controls(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 1.0)], "k string, t int, x double, y double")
    out = matching.nearest_controls(df, score="x", treated="t", key="k", outcome="y",
                                    caliper_width=1.0).first()
    assert out.control_key is None


def test_row_numbers_are_global(scored):
    df, rows = scored
    got = ranks.row_numbers(df, ["score", "k"]).orderBy("score", "k").select(
        "row_number").toPandas()["row_number"].tolist()
    assert got == list(range(1, len(rows) + 1))
    assert df.agg(F.count("k")).first()[0] == len(rows)
