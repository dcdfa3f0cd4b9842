"""The n-gram Jaccard join against all pairs, on texts around the threshold and awkward ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from doorstep.llm import jaccard


def brute(rows, percent=80, shingle=5):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())  # bytes: ASCII letters only
        sets.append(frozenset(tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)) if len(w) >= shingle
                    else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1, "s", "c") for i, t in rows], "doc_id bigint, text string, n int, node string, class string")
    return sorted(map(tuple, jaccard.joined(docs, **kw).collect()), key=str)


def edited(words, share, draw):
    return [w if draw.random() > share else f"e{draw.randrange(10 ** 6)}" for w in words]


def around_the_threshold():
    draw = random.Random(4)
    rows, at = [], 0
    for family in range(12):
        base = [f"f{family}w{draw.randrange(400)}" for _ in range(draw.choice([30, 80, 200]))]
        for _ in range(14):
            rows.append((at, " ".join(edited(base, draw.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]), draw))))
            at += 1
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(at + i, " ".join(f"x{i}_{k}" for k in range(50)) + " " + passage) for i in range(30)]
    return rows


@pytest.mark.parametrize("draws", [6, 1])
def test_links_against_all_pairs(spark, monkeypatch, draws):
    monkeypatch.setattr(jaccard, "DRAWS", draws)  # with one draw most groups fall apart, and the matrix has to join them
    monkeypatch.setattr(jaccard, "BATCH", 20_000)
    rows = around_the_threshold()
    want = brute(rows)
    assert joined(spark, rows) == want
    assert 20 < len({c for _, _, c in want}) < len(rows) - 60


def test_groups_of_one_lose_no_link(spark, monkeypatch):
    """Without any group formed beforehand, every link comes through the matrix."""
    def lone(sets, percent):
        none = sets.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
        return none, sets.select("node", F.col("node").alias("g"), "share")
    monkeypatch.setattr(jaccard, "grouped", lone)
    monkeypatch.setattr(jaccard, "RANGE", 2_000)
    rows = around_the_threshold()
    assert joined(spark, rows) == brute(rows)


def test_awkward_texts(spark):
    long = " ".join(f"l{i % 5003}" for i in range(60_000))
    rows = [(5, "a b c d e f"), (3, "A B\tC\nd e  f"), (9, None), (8, ""), (7, " \t\x0b "), (4, "a b c"), (2, "a  b c"), (1, "a b"),
            (None, "a b c d e f"), (None, "no id here at all really"), (6, "É b c d e"), (10, "é b c d e"), (11, long), (12, long + " more"),
            (13, "x\x85y \x1cz a b c"), (13, "x\x85y \x1cz a b c"), (13, "other text of this very id"), (14, "1 2 3 4 5 6 7 8"), (15, "1 2 3 4 5 6 7 8 9"),
            (16, "a b c d e"), (17, "w " * 40), (18, "w " * 90)]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, rows, percent=100) == brute(rows, 100)
    assert joined(spark, rows, shingle=2) == brute(rows, shingle=2)


def test_no_texts(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(2, None), (1, "")]) == [(1, 0, 1), (2, 0, 2)]
    assert joined(spark, [(1, "one text only of this kind")]) == [(1, 2, 1)]


def test_little_is_sent_to_all(spark, monkeypatch):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, seen = spark.conf.get(key), []
    classes = jaccard.set_classes
    monkeypatch.setattr(jaccard, "set_classes", lambda *a: seen.append(spark.conf.get(key)) or classes(*a))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text + f" end{i}") for i in range(4)] + [(9, "alone here")], "doc_id long, text string")
    out = jaccard.joined(docs)
    # tokens are sized as one value a list, so that tables of them must not come near a driver's memory
    assert seen == [str(256 << 10)] and spark.conf.get(key) == before
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {r.doc_id: r.component_id for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
