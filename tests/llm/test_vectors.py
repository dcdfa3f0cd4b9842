"""Hard negatives and whitening against brute force on small, awkward embeddings."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from doorstep.llm import hardneg, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, w string, salt int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "s", "w", 1, "i") for i, v, l in rows], SCHEMA)


def odd_rows():
    draw = np.random.default_rng(11)
    rows = [(i, (draw.integers(-2, 6, 6 + i % 3) / 64).tolist(), int(draw.integers(0, 3))) for i in range(240)]
    rows += [(7, None, 1), (300, [1.0, None], 1), (400, [NAN, 1.0], 0), (500, [INF], 0), (None, [0.5] * 6, 1), (600, [0.5] * 6, None),
             (700, [], 1), (800, [0.0] * 6, 2), (900, [-0.5] * 6, 0), (1000, [1e300, 1.0], 0), (901, [-0.25] * 6, 0), (902, [0.0] * 6, 1)]
    rows += [(0, rows[0][1], rows[0][2]), (100, [0.25] * 7, 1), (5, rows[5][1], rows[5][2])]  # an anchor again, one of two contents, a row again
    return rows


def brute_hard_negatives(rows):
    use = [(i, [int(np.floor(256 * x)) for x in v], l) for i, v, l in rows
           if i is not None and l is not None and v is not None and all(x is not None and abs(x) <= hardneg.LARGEST for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, seen = [], set()
    for i, v, l in use:
        if i % 100 or (i, tuple(v), l) in seen:
            continue
        seen.add((i, tuple(v), l))
        others = sorted((-dot(v, w), j, m) for j, w, m in use if j != i)
        for s, j, _ in [x for x in others if x[2] == l][:5]:
            window = [(t, k) for t, k, m in others if m != l and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(window)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, salts and merges
        monkeypatch.setattr(hardneg, "ROWS", 3)
        monkeypatch.setattr(hardneg, "SHARED", 9)
    rows = odd_rows()
    got = hardneg.mined(hardneg.usable(frame(spark, rows)), F.col("vec_id") % 100 == 0).collect()
    want = brute_hard_negatives(rows)
    assert collections.Counter(map(tuple, got)) == collections.Counter(want) and len(want) > 100
    assert any(x[4] == 0 for x in want)  # a window at 0


def test_hard_negatives_of_nothing(spark):
    rows = hardneg.usable(frame(spark, odd_rows()))
    anchor = F.col("vec_id") % 100 == 0
    assert hardneg.mined(rows.where("false"), anchor).count() == 0
    assert hardneg.mined(rows.where("vec_id % 100 > 0"), anchor).count() == 0
    assert hardneg.mined(rows.where("vec_id = 100"), anchor).count() == 0


def test_scores_are_exact_beyond_doubles():
    pack = lambda v: hardneg.Block({"rows": len(v), "ids": np.arange(len(v)).tobytes(), "labels": np.zeros(len(v), int).tobytes(),
                                    "keys": np.zeros(len(v), int).tobytes(), "lows": np.zeros((len(v), 5), int).tobytes(),
                                    "weights": np.array(v, np.int64).tobytes()})
    big = 2 ** 28
    assert pack([[big, 1]]).scores(pack([[big, 1], [big - 1, 3]])).tolist() == [[big * big + 1, big * (big - 1) + 3]]
    assert pack([[2 ** 40, 0]]).scores(pack([[2 ** 40, 1]])).tolist() == [[2 ** 63 - 1]]


def test_components_against_numpy():
    draw = np.random.default_rng(2)
    for d, scale in ((1, 1.0), (2, 1.0), (7, 10.0), (64, 1.0), (33, 1e4)):
        x = draw.normal(size=(500, d)) @ np.diag(scale ** -np.linspace(0, 1, d))
        v = np.cov(x.T, bias=True).reshape(d, d)
        e, u = whitening.principal(v)
        want, axes = np.linalg.eigh(v)
        assert np.allclose(e, want[::-1], rtol=1e-12) and np.allclose(u @ u.T, np.eye(d), atol=1e-13)
        assert np.allclose(np.abs((u * axes.T[::-1]).sum(axis=1)), 1, atol=1e-12)
    rank = draw.normal(size=(9, 3))
    e, u = whitening.principal(rank @ rank.T)
    assert len(e) == 3 and np.allclose(u.T * e @ u, rank @ rank.T)
    assert len(whitening.principal(np.zeros((4, 4)))[0]) == 0 and len(whitening.principal(np.zeros((0, 0)))[0]) == 0


def vectors():
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(size=12) * np.linspace(1, 3, 12) + 5) for i in range(400)]
    rows = [(i, v.tolist(), 0) for i, v in rows]
    return rows + [rows[3], rows[3], (None, rows[9][1], 0)], [(500, None, 1), (501, [None] + [1.0] * 11, 1), (502, [NAN] * 12, 1),
                                                              (503, [-INF] * 12, 1), (504, [1.0], 1), (505, [], 1), (506, [1e200] * 12, 0)]


def test_whitening_against_brute_force(spark):
    good, bad = vectors()
    got = whitening.whitened(frame(spark, good + bad).repartition(5)).collect()
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v, _ in good]
    n, s = len(x), [sum(col) for col in zip(*x)]
    centred = np.array(x) - np.array(s) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == n * 8 and {r.n for r in got} == {n} and {r.identity_error < 1e-9 for r in got} == {True}
    far = {(i, tuple(row)): sum((n * a - b) ** 2 for a, b in zip(row, s)) for (i, _, _), row in zip(good, x)}
    assert collections.Counter((r.vec_id, int(r.deviation)) for r in got) == collections.Counter(
        {k: 8 * c for k, c in collections.Counter((i, far[i, tuple(row)]) for (i, _, _), row in zip(good, x)).items()})
    by_component = collections.defaultdict(dict)
    for r in got:
        by_component[r.component][r.vec_id] = r.whitened
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12
    for c in range(8):
        want = {i: float(row @ axes[:, c] / np.sqrt(e[c])) for (i, _, _), row in zip(good, centred)}
        sign = np.sign(want[0] * by_component[c + 1][0])
        assert all(abs(sign * by_component[c + 1][i] - w) < 1e-9 for i, w in want.items())


def test_whitening_edges(spark):
    good, bad = vectors()
    run = lambda rows: whitening.whitened(frame(spark, rows))
    assert run(good).where("false").count() == 0 and run(bad[:4]).count() == 0
    assert whitening.whitened(frame(spark, good).where("false")).count() == 0
    assert run(good[:1]).count() == 0 and run([good[0]] * 5).count() == 0 and run([(1, [], 0), (2, [], 0)]).count() == 0
    two = run(good[:2]).collect()  # one component only
    assert sorted(round(abs(r.whitened), 9) for r in two) == [1.0, 1.0] and {r.component for r in two} == {1}
    flat = [(i, [*v[:3], 2.0], l) for i, v, l in good]
    assert {r.component for r in run(flat).select("component").distinct().collect()} == {1, 2, 3}
