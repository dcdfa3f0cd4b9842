"""Extra columns named as the operators name their own: kept as they are, without a change of the result."""

import pytest
from pyspark.sql import functions as F

from doorstep.llm import lines, neardup, pieces, quality

NAMES = ["gone", "_lines", "_k1", "_K2", "y", "_l", "_x", "_text", "_t1", "_T2", "node", "band"]
PLAIN = [f"plain {c}" for c in NAMES]


@pytest.fixture(scope="module")
def both(spark):
    shared = "\n".join(f"line {i} of a passage that both documents hold" for i in range(12))
    texts = [f"first\n{shared}", f"second\n{shared}\nend", None, "", "apart from all others", "apart from all others"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    mark = F.concat(F.lit("v"), F.col("doc_id").cast("string"))
    return [docs.select("*", *[mark.alias(c) for c in names]) for names in (NAMES, PLAIN)]


def same(made, both):
    clashing, plain = made(both[0]), made(both[1])
    assert [c for c in clashing.columns if c in NAMES] == NAMES
    renamed = plain.withColumnsRenamed(dict(zip(PLAIN, NAMES))).select(clashing.columns)
    got, want = [sorted(map(str, x.collect())) for x in (clashing, renamed)]
    assert got == want and got
    assert all(r["gone"] == r["_K2"] == r["_text"] == f"v{r['doc_id']}" for r in clashing.collect())


def test_lines(both):
    same(lambda d: lines.deduplicated(d, min_words=9), both)
    assert lines.deduplicated(both[0]).agg(F.sum("n_removed")).first()[0] >= 12


def test_quality(spark, both):
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1), (5, 0)], "doc_id bigint, quality int")
    same(lambda d: quality.scored(d, labels), both)


def test_neardup_stage(spark, both):
    same(lambda d: neardup.neardup_stage(spark, d, ""), both)


def test_pieces(both):
    same(lambda d: pieces.encoded(d, pieces.model_path()), both)
