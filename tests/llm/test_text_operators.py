"""Operators on texts against brute force on small, awkward documents."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doorstep.llm import decontam, licenses, lines, lmscore, neardup, pieces, quality, substrings


def words(text):
    return (text or "").encode().split()


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_substrings_against_brute_force(docs):
    width, given = 6, [(r.doc_id, words(r.text)) for r in docs.collect()]
    count = collections.Counter(tuple(w[i:i + width]) for _, w in given for i in range(len(w) - width + 1))
    want = []
    for doc, w in given:
        gone = {i + k for i in range(len(w) - width + 1) if count[tuple(w[i:i + width])] > 1 for k in range(width)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc, len(w), len(gone), kept.decode()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows(substrings.deduplicated(docs, width))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_substrings_of_nothing(docs):
    assert substrings.deduplicated(docs.where("false")).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines_against_brute_force(spark, least):
    texts = ["a\nb\nc\nd", "x\na\nb\nc", "b\n\nc\nd", "a\na\na\na", None, "", "c\nd\ne"]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        split = [] if t is None else t.split("\n")
        full = [k for k, s in enumerate(split) if s.strip()]
        gone = set()
        for p in range(len(full) - least + 1):
            run = tuple(split[k] for k in full[p:p + least])
            if run in seen:
                gone |= set(full[p:p + least])
            seen.add(run)
        want[i] = None if t is None else "\n".join(s for k, s in enumerate(split) if k not in gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = lines.deduplicated(docs, least)
    assert {r["doc_id"]: r["text"] for r in rows(got)} == want


def test_long_single_lines_against_brute_force(spark):
    long, short = " ".join(f"w{i}" for i in range(lines.MIN_WORDS)), " ".join(f"w{i}" for i in range(lines.MIN_WORDS - 1))
    texts = [f"a\n{long}\nb", f"c\n{long}\nd", f"e\n{short}\nf", f"g\n{short}\nh", f"{long}\n\n{long}", None, "", f"b\nx {long}\nx {long}\na"]
    texts += ["p\nq\nr", f"p\nq\n{long}"]  # a run and a single line side by side
    seen, want = set(), {}
    for i, t in enumerate(texts):
        split = [] if t is None else t.split("\n")
        full = [k for k, s in enumerate(split) if s.strip()]
        gone = set()
        for least in (1, 2):
            for p in range(len(full) - least + 1):
                run = tuple(split[k] for k in full[p:p + least])
                if least == 1 and len(run[0].split()) < lines.MIN_WORDS:
                    continue
                if run in seen:
                    gone |= set(full[p:p + least])
                seen.add(run)
        want[i] = None if t is None else "\n".join(s for k, s in enumerate(split) if k not in gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_chars", F.lit(0))
    got = {r["doc_id"]: r["text"] for r in rows(lines.line_dedup_stage(spark, docs, ""))}
    assert got == want and want[1] == "c\nd" and want[3] == texts[3] and want[9] == ""
    one = docs.where("doc_id < 2")  # no run of two lines at all
    assert {r["doc_id"]: r["text"] for r in rows(lines.line_dedup_stage(spark, one, ""))}[1] == "c\nd"


def test_lines_edges(docs):
    got = lines.deduplicated(docs)
    assert got.count() == docs.count() and set(docs.columns) <= set(got.columns)
    assert lines.deduplicated(docs.where("false")).count() == 0


def test_near_duplicates(docs):
    got = rows(neardup.classes(docs))
    assert len(got) == docs.count()
    named = collections.defaultdict(set)
    for r in got:
        named[r["_class"]].add(r["doc_id"])
    groups = {frozenset(x, ) for x in named.values()}
    assert frozenset({0, 1}) in groups or frozenset({0, 1, 7}) in groups
    assert frozenset({2, 3}) in groups  # null and empty are equal texts
    assert neardup.classes(docs.where("false")).count() == 0


def test_rest_of_a_bucket_is_joined_exactly(spark):
    """A chain of similar texts in one bucket, whose ends are not alike."""
    base = [f"t{i}" for i in range(100)]
    texts = [" ".join(base[:i * 5] and [f"u{i}_{k}" for k in range(i * 4)] + base[i * 4:]) if i else " ".join(base) for i in range(5)]
    docs = neardup.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    idf = np.ones(neardup.CELLS, np.float32)
    nodes = docs.select(neardup.node().alias("node"), "_text")
    members = nodes.select(F.lit(0).alias("band"), F.lit(1).cast("long").alias("key"), "node")
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    linked = {(i, j) for i in range(5) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    found = neardup.components(neardup.linked(members, nodes, idf, 0.8))
    want = {i: min(linked_with(i, linked)) for i in range(5) if len(linked_with(i, linked)) > 1}
    name = {r["node"]: texts.index(r["_text"]) for r in nodes.collect()}
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r["class"]].add(name[r["id"]])
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == low) for low in set(want.values()))


def linked_with(i, links):
    """All that ``i`` reaches, itself included."""
    seen, new = {i}, {i}
    while new:
        new = {b for p in links for a, b in (p, p[::-1]) if a in new} - seen
        seen |= new
    return seen


def test_consistent_samples_agree_as_often_as_weights_overlap():
    ids = np.random.default_rng(5).integers(0, 2 ** 44, 4000).astype(np.uint64)
    w = np.ones(4000, np.float32)
    one = neardup.samples(ids[:3000], w[:3000], np.array([0]), 400)
    two = neardup.samples(ids[500:3500], w[:3000], np.array([0]), 400)
    assert abs((one == two).mean() - 2500 / 3500) < 0.08


def test_pieces_against_the_library(docs):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for r in rows(pieces.encoded(docs, pieces.model_path())):
        ids = model.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == model.decode(ids)
    assert pieces.encoded(docs.where("false"), pieces.model_path()).count() == 0


def test_scores_are_probabilities(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = rows(lmscore.scored(docs, held))
    train = collections.Counter()
    given = [(r.doc_id, [x.lower() for x in words(r.text)] + [None]) for r in docs.collect()]
    for d, w in given:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            train.update(w)
    n, v = sum(train.values()), len(train)
    want = collections.Counter((d, len(w), round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)) for d, w in given)
    assert collections.Counter((r["doc_id"], r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lmscore.scored(docs.where("false"), held).count() == 0


def test_pooled_is_monotone():
    out = quality.pooled(np.array([1.0, 0.0, 3.0, 1.0]), np.array([2.0, 2.0, 3.0, 4.0]))
    assert (np.diff(out) >= 0).all() and len(out) == 4


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (5, 1), (8, 0), (8, 0), (None, 1), (9, None)], "doc_id bigint, quality int")
    got = rows(quality.scored(docs, labels))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in rows(quality.scored(docs, labels.where("false")))} == {0.5}
    assert quality.scored(docs.where("false"), labels).count() == 0


def test_decontamination_finds_new_parameters(spark):
    item = "A train leaves at 9 with 120 people and after 35 km it meets Anna who counts 120 seats in every wagon"
    texts = [item, item.replace("120", "77").replace("35", "4").replace("Anna", "Boris"),
             item.replace("120 people", "77 people").replace("35", "4"), "nothing of the kind is said here at all", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, "too short"), (None, None)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in rows(decontam.contaminated(docs, items))}
    assert set(got) == {0, 1}  # the third gives 120 two values
    assert not got[0]["changed"] and got[1]["changed"]
    assert decontam.cleaned(docs, items).count() == 4
    assert decontam.contaminated(docs.where("false"), items).count() == 0
    assert decontam.contaminated(docs, items.where("false")).count() == 0


def test_licenses(spark):
    texts = [f"some words\n{t}\nmore words" for _, t in licenses.TEMPLATES] + [None, "", "Licensed under CC", "Released under the MIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = rows(licenses.found(docs, licenses.templates(spark)))
    assert {(r["doc_id"], r["template"]) for r in got} >= {(i, i) for i in range(len(licenses.TEMPLATES))}
    assert {r["doc_id"] for r in got} == {*range(len(licenses.TEMPLATES)), len(texts) - 1}
    assert licenses.found(docs.where("false"), licenses.templates(spark)).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{folder}/documents.parquet").count()
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert 0.6 * before < len(got) < before and got.exact.all() and got.doc_id.is_unique


def test_digest_matches_the_text(docs):
    r = pieces.encoded(docs, pieces.model_path()).select("decoded", F.sha2("decoded", 256).alias("d")).first()
    assert r.d == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_context_tree_against_brute_force(spark):
    texts = [(1, "ab abc Ab"), (2, "abc  abd"), (3, None), (4, "zab abd q"), (5, "ab abc Ab")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    depth = lmscore.DEPTH

    def decisions(text):
        coded = b"".join(w.lower() + b" " for w in words(text)) + b"\n"
        padded = b"\n" * depth + coded
        for i, byte in enumerate(coded):
            for k in range(8):
                yield padded[i:i + depth], (256 | byte) >> (8 - k), byte >> (7 - k) & 1
    counts, below = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    for doc, text in texts:
        for context, at, bit in decisions(text):
            for d in range(depth + 1):
                counts[context[depth - d:], at][bit] += doc != 4
                if d:
                    below[context[depth - d + 1:], at].add((context[depth - d:], at))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mix(node):
        if len(node[0]) == depth:
            return kt(*counts[node])
        return math.log(0.5) + np.logaddexp(kt(*counts[node]), sum(map(mix, below[node])))
    want = {}
    for doc, text in texts:
        total = 0.0
        for context, at, bit in decisions(text):
            p = 0.5
            for d in range(depth, -1, -1):
                node = context[depth - d:], at
                own = 1.0 if d == depth else math.exp(math.log(0.5) + kt(*counts[node]) - mix(node))
                p = own * (counts[node][bit] + 0.5) / (sum(counts[node]) + 1) + (1 - own) * p
            total += math.log10(p)
        want[doc] = total
    got = {r["doc_id"]: r["score"] for r in rows(lmscore.scored(docs, F.col("doc_id") == 4))}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-4 for d in want)


def test_context_reaches_over_six_bytes(spark):
    """What follows five equal bytes is told by the byte before them."""
    texts = [(i, "pqrstu1 vqrstu2 " * 20) for i in range(3)] + [(3, "pqrstu1"), (4, "pqrstu2")]
    got = {r["doc_id"]: r["score"] for r in rows(lmscore.scored(spark.createDataFrame(
        texts, "doc_id bigint, text string"), F.col("doc_id") >= 3))}
    assert lmscore.DEPTH >= 6 and got[3] > got[4] + 0.8


def test_scores_do_not_depend_on_batches(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2

    def scores(**sizes):
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"])
                     for r in rows(lmscore.scored(docs.coalesce(1), held, **sizes)))
        return [x[:3] for x in got], np.array([x[3:] for x in got])
    whole = scores()
    for sizes in {"size": 4000, "chunk": 600}, {"size": 600, "chunk": 10 ** 6}:
        named, values = scores(**sizes)
        assert named == whole[0] and np.allclose(values, whole[1], rtol=1e-6, atol=1e-4)


def test_probabilities_of_listed_strings_sum_to_one(spark):
    known = int.from_bytes(bytes(range(1, lmscore.DEPTH + 1)), "big") << 8
    listed = lmscore.lists(np.arange(known, known + 256), np.array([3 if s in (65, 66) else 0 for s in range(256)]))
    strings = spark.createDataFrame([(r["b"], r["k"], r["c"]) for r in listed.to_pylist()], "b int, k binary, c binary")
    (r,) = rows(lmscore.string_scores(lmscore.list_counts(strings, lmscore.OPEN)))
    logs = lmscore.floats(pa.scalar(bytes(r["s"]), pa.binary()))
    assert len(logs) == 256 and abs((10 ** logs.astype(float)).sum() - 1) < 1e-5


def test_whole_license_bodies_are_found_when_edited(spark):
    bodies = [(i, a, " ".join(t.split())) for i, (a, t) in enumerate(licenses.TEMPLATES) if len(t.split()) > 2 * licenses.LONGEST]
    assert {a for _, a, _ in bodies} == {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"}
    texts = []
    for i, _, t in bodies:
        w = t.split()
        for at in 20, len(w) // 2:
            w[at] = f"changed{at}"
        texts.append((i, "some words\n" + " ".join(w[:40]) + "\n" + " ".join(w[40:]) + "\nmore words"))
        texts.append((100 + i, " ".join(t.split()[:len(t.split()) // 2])))  # half of a body is not the body
    texts += [(50, "Licensed under CC BY 4.0."), (51, "Licensed under CC BY-SA 4.0.")]
    got = {(r["doc_id"], r["license"], r["template"]) for r in rows(licenses.found(
        spark.createDataFrame(texts, "doc_id bigint, text string"), licenses.templates(spark)))}
    assert {(i, a, i) for i, a, _ in bodies} <= got and not any(d == 100 + t for d, _, t in got)
    assert {x[:2] for x in got if x[0] in (50, 51)} == {(50, "CC-BY-4.0"), (51, "CC-BY-SA-4.0")}
    parts = {r["template"]: r["n"] for r in rows(licenses.templates(spark).groupBy("template").agg(F.count("*").alias("n")))}
    assert all(parts[i] > 1 for i, _, _ in bodies)
