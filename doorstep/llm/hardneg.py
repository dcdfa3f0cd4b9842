"""Hard-negative mining: a secondary sort by (anchor, descending score, id) and a streaming window.

Anchors and candidates are packed into blocks of vectors and meet block by block, an anchor block
once for each salt of candidate blocks, which come past it one at a time. Two such passes, each
followed by the same secondary sort:

* The first keeps, for every anchor, a task's best candidates of the anchor's own label. Sorted by
  anchor and falling score, the first few are its positives.
* The second sends the anchors with the scores of their positives. A candidate of another label can
  only be reported if its score lies in the window of one of them, and of a task's candidates only
  the first few of each window can; that is all that is shuffled.

Positives and the negatives left are packed into keys (anchor, descending score, positives before
negatives, id), dealt out by anchor and sorted within partitions. An iterator over the sorted rows
opens a window at each positive and emits the negatives that fall into open windows as they come;
besides the at most ``POSITIVES`` windows of one anchor it holds nothing.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no
part, and neither do those whose components exceed ``LARGEST`` in size. A dimension that one side
lacks adds nothing; an empty vector scores 0 with all. Candidates are the rows of other ids than the
anchor's; repeated ones are rows of their own. Anchor rows that are alike in id, label and vector
are one anchor, others of the same id are anchors of their own. A window whose positive scores below
0 is empty, one at 0 holds the scores of 0. Products that don't fit in 64 bits stop at the largest number that does. Anchors without positives or negatives give no rows, as
does an empty table. Ties go to the smaller id. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
#: Vectors in a block at most, and the numbers they hold at most.
ROWS, CELLS = 2048, 1 << 18
#: Candidate blocks that share a salt, about: more mean fewer copies of the anchors, fewer mean more tasks.
SHARED = 4
#: Products of two such components, added up over 64 dimensions, fit in 64 bits.
LARGEST = 2.0 ** 20
_PLACE = "side int, rows int, ids binary, labels binary, keys binary, weights binary, lows binary"


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, w) of the rows that take part, with integer weights."""
    whole = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    use = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return rows.where(use).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.transform(whole, lambda x: F.floor(x * SCALE).cast("long")).alias("w"))


def blocks(rows: DataFrame, side: int) -> DataFrame:
    """Rows (vec_id, label, key, w, lows) packed into blocks; ``lows`` are scores of positives or null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("w").value_lengths().to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                widest = np.maximum.accumulate(lengths[at:at + ROWS]) * np.arange(1, len(lengths[at:at + ROWS]) + 1)
                to = at + max(1, int(np.searchsorted(widest, CELLS, "right")))
                part, size = batch.slice(at, to - at), lengths[at:to]
                weights = np.zeros((to - at, int(size.max())), np.int64)
                weights[np.arange(weights.shape[1]) < size[:, None]] = part.column("w").flatten().to_numpy(zero_copy_only=False)
                packed = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label", "key")]
                lows = np.full((to - at, POSITIVES), np.iinfo(np.int64).min)
                for i, x in enumerate(part.column("lows").to_pylist()):
                    lows[i, :len(x or ())] = x or ()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([side], pa.int32()), pa.array([to - at], pa.int32()),
                     *(pa.array([x.tobytes()], pa.binary()) for x in (*packed, weights, lows))],
                    ["side", "rows", "ids", "labels", "keys", "weights", "lows"])
                at = to
    return rows.select("vec_id", "label", "key", "w", "lows").mapInArrow(run, _PLACE)


class Block:
    def __init__(self, row: dict):
        self.n = row["rows"]
        self.ids, self.labels, self.keys = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "keys"))
        self.weights = np.frombuffer(row["weights"], np.int64).reshape(self.n, -1)
        self.lows = np.frombuffer(row["lows"], np.int64).reshape(self.n, -1)

    def scores(self, other: Block) -> np.ndarray:
        """Inner products with every row of another block, exact."""
        d = min(self.weights.shape[1], other.weights.shape[1])
        if not d:
            return np.zeros((self.n, other.n), np.int64)
        a, b = self.weights[:, :d], other.weights[:, :d].T
        most = float(np.abs(a).max()) * float(np.abs(b).max()) * d
        if most < 2.0 ** 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)  # whole numbers that a double holds
        if most < 2.0 ** 63:
            return a @ b
        return np.clip(a.astype(object) @ b.astype(object), -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    use = np.arange(len(score))
    if len(score) > k:
        use = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return use[np.lexsort((ids[use], -score[use]))[:k]]


def met(anchors: DataFrame, candidates: DataFrame, negatives: bool) -> DataFrame:
    """(anchor_id, anchor_key, score, negative, id, w) that can count, from each pair of an anchor block and a salt.

    w is the place among the anchor's positives of the one in whose window a negative lies."""
    salts = max(1, candidates.count() // SHARED)
    spread = candidates.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    anchors = staged(anchors.withColumn("name", F.xxhash64("ids", "keys")), "anchor-blocks")
    names = anchors.select("name").distinct()  # one for thousands of anchors
    numbers = names.withColumn("block", F.row_number().over(W.orderBy("name")))
    # every candidate block meets every block of the query set
    pairs = anchors.join(numbers, "name").drop("name").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).unionByName(
        spread.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(max(1, names.count()))))))
    kept = NEGATIVES if negatives else POSITIVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by anchor of the block at hand and window
        at, asks = None, None

        def cut(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            s, i = (np.concatenate(x) for x in zip(*pieces, strict=True))
            best = first(s, i, kept)
            return s[best], i[best]

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(*k, *cut(x)) for k, x in held.items()]
            held.clear()
            if rows:
                who, place = (np.repeat([r[i] for r in rows], [len(r[2]) for r in rows]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asks.ids[who]), pa.array(asks.keys[who]), pa.array(np.concatenate([r[2] for r in rows])),
                     pa.array(np.full(len(who), int(negatives), np.int32)), pa.array(np.concatenate([r[3] for r in rows])),
                     pa.array(place.astype(np.int32))],
                    ["anchor_id", "anchor_key", "score", "negative", "id", "w"])

        for batch in batches:
            for j in range(batch.num_rows):
                row = {c: batch.column(c)[j].as_py() for c in batch.schema.names}
                if (row["block"], row["salt"]) != at:
                    if asks is not None:
                        yield from flush()
                    at, asks = (row["block"], row["salt"]), None
                block = Block(row)
                if row["side"] == 0:
                    asks = block  # an anchor block comes before the candidates of its salt
                    continue
                if asks is None:
                    continue  # no anchors at all
                score = asks.scores(block)
                for q in range(asks.n):
                    other = block.ids != asks.ids[q]
                    own = block.labels == asks.labels[q]
                    if negatives:
                        for w, low in enumerate(asks.lows[q]):
                            if low < 0:
                                continue  # no positive, or one below 0
                            s = score[q]
                            use = np.flatnonzero(~own & other & (s >= -(-LOW * int(low) // 100)) & (s <= HIGH * int(low) // 100))
                            if len(use):
                                add(held, (q, w), score[q][use], block.ids[use], kept)
                    else:
                        use = np.flatnonzero(own & other)
                        if len(use):
                            add(held, (q, 0), score[q][use], block.ids[use], kept)
        if asks is not None:
            yield from flush()

    def add(held: dict, key: tuple[int, int], s: np.ndarray, ids: np.ndarray, k: int) -> None:
        best = first(s, ids, k)
        pieces = held.setdefault(key, [])
        pieces.append((s[best], ids[best]))
        if len(pieces) >= 8:
            s, ids = (np.concatenate(x) for x in zip(*pieces, strict=True))
            best = first(s, ids, k)
            held[key] = [(s[best], ids[best])]

    return pairs.repartition("block", "salt").sortWithinPartitions("block", "salt", "side").mapInArrow(
        run, "anchor_id bigint, anchor_key bigint, score bigint, negative int, id bigint, w int")


KEY = ["anchor_id", "anchor_key", "descending", "negative", "id"]


def sorted_by_anchor(scored: DataFrame) -> DataFrame:
    """The secondary sort: all rows of an anchor in one partition, falling scores, positives first among equals."""
    return scored.withColumn("descending", -F.col("score")).select(*KEY, "score", "w").repartition(
        "anchor_id", "anchor_key").sortWithinPartitions(*KEY)


def positives(sorted_rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, anchor_key, score, id): the first k rows of each anchor, which come one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for batch in batches:
            who = zip(batch.column("anchor_id").to_pylist(), batch.column("anchor_key").to_pylist(), strict=True)
            keep = []
            for i, anchor in enumerate(who):
                if anchor != now:
                    now, seen = anchor, 0
                seen += 1
                if seen <= k:
                    keep.append(i)
            if keep:
                yield batch.select(["anchor_id", "anchor_key", "score", "id"]).take(pa.array(keep))
    return sorted_rows.mapInArrow(run, "anchor_id bigint, anchor_key bigint, score bigint, id bigint")


def windows(sorted_rows: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """Negatives of the open windows, as the sorted rows of each anchor pass by."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = None, []  # [positive's id, its score, negatives emitted], in the order of the positives
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "anchor_key", "score", "negative", "id", "w")), strict=True)
            for anchor, key, score, negative, own, place in rows:
                if (anchor, key) != now:
                    now, opened = (anchor, key), []
                if not negative:
                    opened.append([own, score, 0])  # a negative's score is never above its positive's, so it comes later
                    continue
                window = opened[place]
                if window[2] < k:
                    window[2] += 1
                    out.append((anchor, window[0], window[2], own, window[1], score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
    return sorted_rows.mapInArrow(
        run, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def mined(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """Hard negatives of the anchors among ``usable`` rows, ten for each of an anchor's five positives."""
    none = F.lit(None).cast("array<bigint>")
    candidates = staged(blocks(rows.select("*", F.lit(0).cast("long").alias("key"), none.alias("lows")), 1), "candidate-blocks")
    asked = rows.where(is_anchor).withColumn("key", F.xxhash64("label", "w")).distinct()
    asked = staged(asked, "anchors")
    best = staged(positives(sorted_by_anchor(met(blocks(asked.withColumn("lows", none), 0), candidates, False))), "positives")
    # the few positives of an anchor, from the sorted rows
    scores = best.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list("score"), asc=False).alias("lows"))
    again = asked.join(scores, (asked["vec_id"] == scores["anchor_id"]) & (asked["key"] == scores["anchor_key"])).select(
        "vec_id", "label", "key", "w", "lows")
    negatives = met(blocks(again, 0), candidates, True)
    return windows(sorted_by_anchor(negatives.unionByName(best.withColumns({"negative": F.lit(0), "w": F.lit(0)}))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings")).withColumn("label", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH taking_part AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, i, CAST(floor(CAST(embedding[i] AS DOUBLE) * 256) AS BIGINT) AS w
  FROM taking_part, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)),
products AS (SELECT a.vec_id AS anchor_id, b.vec_id, CAST(sum(a.w * b.w) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, coalesce(p.score, 0) AS score
  FROM taking_part a JOIN taking_part b ON a.vec_id <> b.vec_id
  LEFT JOIN products p ON p.anchor_id = a.vec_id AND p.vec_id = b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
    n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""
