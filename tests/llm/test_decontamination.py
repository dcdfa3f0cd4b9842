"""Decontamination against its definition in plain Python, and its edge cases."""

import math
import time

import pytest
import regex
from pyspark.sql import functions as F

from doorstep.llm import decontam, shingles

UNITS = "|".join(decontam.UNITS)


def forms(text):
    """Template words and plain words."""
    text = text or ""
    t = regex.sub(r"[0-9]+(?:[.,:/][0-9]+)*", "#", text)
    t = regex.sub(rf"#(\s?)(?i:{UNITS})\b", r"#\1%", t)
    t = regex.sub(r"(?<=[\p{Ll},] )\p{Lu}\p{L}*", "@", t)
    plain = regex.sub(decontam.PUNCTUATION, "", text.lower())
    return regex.sub(decontam.PUNCTUATION, "", t.lower()).split(), plain.split()


def found(doc, item, contained=0.8):
    """(share of the item's windows, changed) or None."""
    (dt, do), (it, io) = forms(doc), forms(item)
    if len(io) < 5:
        whole = any(do[i:i + len(io)] == io for i in range(len(do))) and (len(io) > 1 or len(do) == 1)
        return (1.0, False) if io and whole else None
    windows = {tuple(io[j:j + 5]) for j in range(len(io) - 4)}
    mine = {tuple(do[i:i + 5]) for i in range(len(do) - 4)}
    shares = []
    if len(windows & mine) / len(windows) >= contained:
        shares.append((len(windows & mine) / len(windows), False))
    real = {j: tuple(it[j:j + 5]) for j in range(len(it) - 4) if not set(it[j:j + 5]) <= {"#", "%", "@"}}
    lines = {}
    for j, w in real.items():
        for i in range(len(dt) - 4):
            if tuple(dt[i:i + 5]) == w:
                hs, pairs = lines.setdefault(i - j, (set(), set()))
                hs.add(w)
                pairs |= {(io[j + k], do[i + k]) for k in range(5) if it[j + k] != io[j + k]}
    hs, pairs = set(), set()
    for _, (more, also) in sorted(lines.items(), key=lambda x: (-len(x[1][0]), x[0])):
        if len({b for b, _ in pairs | also}) == len(pairs | also):
            hs, pairs = hs | more, pairs | also
    if real and len(hs) / len(set(real.values())) >= contained:
        shares.append((len(hs) / len(set(real.values())), any(b != d for b, d in pairs)))
    return (max(s for s, _ in shares), min(c for _, c in shares)) if shares else None


ITEM = "A train leaves at 9 with 120 people and after 35 km it meets Anna who counts 120 seats in every wagon"
NAMES = "we asked whether Anna Smith or her friend Boris Brown had walked to Paris with 14 apples on that day"
ITEMS = [(1, ITEM), (2, "Paris is big"), (3, "yes"), (4, None), (None, NAMES), (6, "7 8 9 10 11 12 13 14 15"),
         (7, ""), (1, ITEM), (8, "each of the rows has # and each of the rows has 5 and each of the rows has 6 left")]
TEXTS = [ITEM, ITEM.replace("120", "77").replace("35", "4").replace("Anna", "Boris"),
         ITEM.replace("120 people", "77 people").replace("35", "4"), "Yes.", "yes it is so", "they say Paris is big, or so",
         "Paris was big", NAMES.upper(), NAMES.lower(), NAMES.replace("Anna", "Carla").replace("14", "15"), None, "", "  \n",
         "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "3 4 5 6 7 8 9 10 11 12 13 14", "nothing of the kind is said here at all",
         ITEM.replace("wagon", "carriage"), " ".join(ITEM.split()[:12]) + " and so on " + " ".join(ITEM.split()[8:]),
         (ITEM.replace("120", "50") + " then ") * 2 + ITEM, "filler words " * 500 + ITEM + " more filler" * 500,
         "each of the rows has 5 and each of the rows has 6 and each of the rows has 7 left", ITEM]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in enumerate(TEXTS)] + [(0, ITEM, 1, 2, "x", "y"), (None, ITEM, 1, 2, "x", "y")],
                                 "doc_id bigint, text string, _k1 int, _K2 int, h string, item string")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_against_the_definition(tables):
    docs, items = tables
    want = {(d, i): found(t, it) for d, t in [*enumerate(TEXTS), (None, ITEM)] for i, it in ITEMS}
    want = {k: (round(s, 6), c) for k, v in want.items() if v for s, c in [v]}
    got = decontam.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id): (round(r.contained, 6), r.changed) for r in got} == want and len(got) == len(want)
    assert {(7, None), (8, None), (9, None), (5, 2), (3, 3), (13, 6)} <= set(want) and (4, 3) not in want and (2, 1) not in want


def test_clean_rows_stay_with_all_their_columns(tables):
    docs, items = tables
    bad = {d for d, t in [*enumerate(TEXTS), (None, ITEM)] if any(found(t, it) for _, it in ITEMS)}
    kept = decontam.cleaned(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d in range(len(TEXTS)) if d not in bad]


@pytest.mark.parametrize("contained", [0.5, 0.8, 1.0])
def test_rarest_windows_miss_no_share(spark, contained):
    """Every share of an item's windows, so also those just at the bound."""
    words = [f"w{i}" for i in range(24)]
    texts = [" ".join(words[:n]) for n in range(5, 25)] * 2 + [" ".join(words[n:]) for n in range(1, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(n, " ".join(words[:n])) for n in (5, 14, 19, 24)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, contained).collect()}
    assert got == {(d, n) for d, t in enumerate(texts) for n in (5, 14, 19, 24) if found(t, " ".join(words[:n]), contained)}


def test_rows_of_numbers_are_no_copies(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0), F.lit(400)), lambda i: ((F.col("id") * 401 + i) * 7919 % 100003).cast("string"))).alias("text"))
    items = spark.range(50).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0), F.lit(59)), lambda i: ((F.col("id") * 60 + i) * 104729 % 99991).cast("string"))).alias("text"))
    copy = items.where("item_id = 7").select(F.lit(100).cast("bigint").alias("doc_id"), F.concat(F.lit("so: "), "text").alias("text"))
    start = time.time()
    got = decontam.contaminated(docs.union(copy), items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(100, 7)] and time.time() - start < 60
    assert math.isclose(got[0].contained, 1.0)


def test_texts_are_made_once_and_windows_hashed_where_their_ends_are_known(spark):
    """The split reads a column, and the bitmap of ends drops no window that the benchmark holds."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a x y z e q"), (3, "")], "doc_id long, text string")
    made = decontam.canonical(docs.withColumnRenamed("text", "_text"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(decontam.PUNCTUATION) == 2  # once for each form; before, each text was made twice
    asked = spark.createDataFrame([("a b c d e".split(),)], "w array<string>").withColumn("_w", F.col("w"))
    hashes = asked.select(F.explode(shingles.window_hashes("_w", 5)).alias("h"))
    ends = asked.select(shingles.edges(F.get("_w", F.lit(0)), F.element_at("_w", -1)).alias("h"))
    rows = shingles.columns_of(made, _e0=shingles.window_edges("_w", 5))
    got = rows.select("doc_id", shingles.edge_hits("_w", 5, "_e0", shingles.bitmap(ends), shingles.bitmap(hashes)).alias("x")).collect()
    want = hashes.first()["h"]
    assert {r["doc_id"]: [(x["i"], x["h"]) for x in r["x"]] for r in got} == {1: [(0, want)], 2: [], 3: []}
