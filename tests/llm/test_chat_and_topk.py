"""Reply trees and exact top-k against brute force."""

import numpy as np
from pyspark.sql import functions as F

from doorstep.llm import chat, topk


def test_best_branch_is_formatted_and_read_back(spark):
    rows = [(1, 1, None, "user", "hi <|im_end|> &amp; &lt;|", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b\nc", 5.0),
            (1, 4, 3, "user", None, 0.0), (2, 1, 9, "user", "orphan", None), (3, 1, 2, "user", "cycle", 1.0),
            (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, None, "no id", 1.0), (1, 2, 1, "assistant", "a", 1.0)]
    messages = spark.createDataFrame(rows, "conv_id bigint, msg bigint, parent bigint, role string, text string, score double")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(messages)).collect()}
    assert set(got) == {1, 2, None}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hi <|im_end|> &amp; &lt;|"), ("assistant", "b\nc"), ("user", "")]
    assert got[1].loss_text == "b\nc" and [t.text for t in got[None].turns] == ["no id"]
    assert chat.formatted(messages.where("false")).count() == 0


def test_deep_chain(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(37)]
    messages = spark.createDataFrame(rows, "conv_id bigint, msg bigint, parent bigint, role string, text string, score double")
    (r,) = chat.read_back(chat.formatted(messages)).collect()
    assert [t.text for t in r.turns] == [str(i) for i in range(37)]


def test_top_k_against_brute_force(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, draw.integers(-3, 4, 5 + i % 3).astype(float).tolist()) for i in range(60)]
    vectors += [(60, None), (61, [1.0, None]), (62, [float("nan")]), (63, []), (0, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").select(
        "vec_id", topk.weights(F.col("embedding"), 1).alias("w")).where("w is not null")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 20 or vec_id = 21"), 4).collect()}
    use = [(i, v) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in (20, 21):
        mine = dict(use)[q]
        ranked = sorted((-sum(int(a) * int(b) for a, b in zip(mine, v)), i) for i, v in use if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, -s) for s, i in ranked]
