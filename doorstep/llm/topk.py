"""Exact top-k by inner product: term-at-a-time over blocks of postings.

Candidates are packed into blocks, each an inverted index (for every dimension the rows with a
non-zero weight). A block meets every block of queries by a join on the query block's number.
In the task, each dimension scatters query weight times postings into dense score arrays;
``argpartition`` keeps the best of a block and a sort merges blocks, in the task first and then
in a window over the few survivors of each query.

Defined results: null vectors, and vectors with a null or non-finite component, take no part;
a dimension that one side lacks adds nothing. Rows with the query's own id are no candidates.
Repeated rows are rows of their own. A null id takes no part. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Candidates and queries in a block: 1024 x 256 scores of 8 bytes stay in a core's cache.
CANDIDATES, QUERIES = 1024, 256
#: Tasks over which the candidates of one query block are spread.
SALTS = 16


def weights(vector: Column, scale: int = 256) -> Column:
    """Integer weights of a vector, null if a component is null or not finite."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)),
                  F.transform(whole, lambda x: F.floor(x * scale).cast("long")))


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *pa.compute.list_value_length(column).to_pylist()])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs rows (vec_id, w) into (ids, rows, dims, weights), postings in order of dimension."""
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(at, CANDIDATES)
            values, ends = _ragged(part.column("w"))
            row = np.repeat(np.arange(part.num_rows), np.diff(ends))
            dim = np.arange(len(values)) - ends[:-1][row]
            order = np.lexsort((row, dim))
            order = order[values[order] != 0]
            ids = part.column("vec_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (
                ids.astype(np.int64), row[order].astype(np.int32), dim[order].astype(np.int32), values[order])],
                ["ids", "row", "dim", "weight"])


def block_scores(q_vec: list[np.ndarray], row: np.ndarray, dim: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Scores of each query (rows) with each of n candidates, one dimension at a time."""
    score = np.zeros((len(q_vec), n), np.int64)
    starts = np.flatnonzero(np.diff(dim, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(dim)], strict=True):
        d = dim[a]
        has = np.array([i for i, v in enumerate(q_vec) if d < len(v) and v[d]], np.int64)
        if not len(has):
            continue
        w = np.array([q_vec[i][d] for i in has])[:, None]
        if b - a == n and len(has) == len(q_vec):
            score += w * weight[a:b]
        else:
            score[has[:, None], row[a:b]] += w * weight[a:b]
    return score


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best candidates with other ids, with all that tie at the last place cut by id."""
    out = []
    for i, own in enumerate(q):
        use = np.flatnonzero(ids != own)
        s = score[i, use]
        if len(use) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            use, s = use[s >= least], s[s >= least]
        order = np.lexsort((ids[use], -s))[:k]
        out.append((np.full(len(order), own), ids[use][order], s[order]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, w) against every row of ``vectors``."""
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b")).agg(
        F.collect_list(F.struct("vec_id", "w")).alias("q"))
    packed = vectors.mapInArrow(_blocks, "ids binary, row binary, dim binary, weight binary")
    spread = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = packed.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")).join(spread, ["b", "salt"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def flush() -> pa.RecordBatch:
            parts = [x for xs in kept.values() for x in xs]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)],
                                              ["query_id", "vec_id", "score"])
        for batch in batches:
            for j in range(batch.num_rows):
                asks = batch.column("q")[j].as_py()
                q = np.array([x["vec_id"] for x in asks], np.int64)
                ids, row, dim, weight = (np.frombuffer(batch.column(c)[j].as_buffer(), t) for c, t in (
                    ("ids", np.int64), ("row", np.int32), ("dim", np.int32), ("weight", np.int64)))
                score = block_scores([np.array(x["w"], np.int64) for x in asks], row, dim, weight, len(ids))
                kept.setdefault(batch.column("b")[j].as_py(), []).append(best(q, ids, score, k))
                if sum(map(len, kept.values())) >= 64:
                    yield flush()
        if kept:
            yield flush()
    found = met.mapInArrow(scored, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), weights(F.col("embedding")).alias("w")).where(
        "w IS NOT NULL AND vec_id IS NOT NULL")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


OP7_SQL = """
WITH parts AS (SELECT vec_id, i, CAST(floor(CAST(embedding[i] AS DOUBLE) * 256) AS BIGINT) AS w
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)
  WHERE embedding IS NOT NULL),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
