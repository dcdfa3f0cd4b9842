"""MinHash near-dedup: improved consistent weighted sampling, banded, verified by weighted Jaccard.

A document's shingles are its runs of five words (all its words, if fewer), weighted by their
count times log((N + 1) / (df + 1)) + 1. Document frequencies are counted over all documents in
``CELLS`` hashed cells, as feature hashing does: a vector of fixed size, whose collisions add the
same small share to every shingle at any corpus size. ``BANDS`` bands of ``ROWS`` samples each
(a shingle and the step of its weight) bring together texts of similarity 0.8 with a probability
of 1 - (1 - 0.8**3)**10 = 0.9992, more alike texts with a higher one.

Equal texts are one node. Within a bucket every text is verified against the one that meets most
others over all bands, so a group of thousands of near copies costs one comparison for each.
Texts of a bucket that are then not in one component go through an exact similarity join by
prefixes: shingles are ordered from the rarest, and only texts that share a shingle of the first
fifth of their weight are verified. That loses no link between texts of a bucket, except between
members of one component, where it changes nothing.

Defined results: null texts and texts without words have no shingles; they are alike only if
equal. Rows that repeat are in one class. The class id is the least document id of the class
(null if it has none). Texts are shingled whole; ASCII letters are folded to lower case. Columns
other than the id and the text are ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, blob_sum, by_size, components, mixed, set_aside, staged, table, windows

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
CELLS = 2 ** 18
BATCH = 4_000_000
CHUNK = 1 << 15
#: Low bits of a shingle's identity; the row within the batch takes those above.
BITS = 44
MASK = np.uint64((1 << BITS) - 1)


class Shingles:
    """Distinct shingles of each text of a batch: ids, counts, and where each text's begin."""

    def __init__(self, column: pa.Array):
        words = Words(column, lower=True)
        h, first = words.hashes, words.first
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        long = windows(h, SHINGLE, seed=21)
        at = np.flatnonzero(row[:len(long)] == row[SHINGLE - 1:]) if len(long) else np.zeros(0, np.int64)
        ids, rows = long[at], row[at]
        short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
        if len(short):
            more = np.array([mixed(np.array([sum(
                int(x) * 31 ** i for i, x in enumerate(h[first[r]:first[r + 1]])) & (2 ** 64 - 1)], np.uint64), 22)[0]
                for r in short], np.uint64)
            ids, rows = np.concatenate([ids, more]), np.concatenate([rows, short])
        key = np.sort((rows.astype(np.uint64) << np.uint64(BITS)) | (ids & MASK))
        new = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(new, len(key)))
        self.row = (key[new] >> np.uint64(BITS)).astype(np.int64)
        self.ids = key[new] & MASK
        self.first = np.searchsorted(self.row, np.arange(len(first)))

    def weights(self, idf: np.ndarray) -> np.ndarray:
        return (self.count * idf[(self.ids & np.uint64(CELLS - 1)).astype(np.int64)]).astype(np.float32)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((N + 1) / (df + 1)) + 1 for each cell, over all rows of ``texts`` (_text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS + 1)
        for batch in batches:
            for part in by_size(BATCH)([batch]):
                found = Shingles(part.column("_text"))
                total[:-1] += np.bincount((found.ids & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                total[-1] += part.num_rows
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])
    total = blob_sum(texts.select("_text").mapInArrow(run, "v binary"))
    if total is None:
        return np.ones(CELLS, np.float32)
    return (np.log((total[-1] + 1) / (total[:-1] + 1)) + 1).astype(np.float32)


def samples(ids: np.ndarray, weights: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each set that isn't empty, as hashes of (shingle, step).

    ``first``: starts of the sets; none is empty. Each sample is the shingle of least
    log c - r (t - beta + 1), t = floor(log w / r + beta), with r and c from Gamma(2, 1) and beta
    uniform, all drawn from the shingle's hash.
    """
    log_w = np.log(weights)
    out = np.empty((len(first), n), np.uint64)
    unit = np.float32(2 ** -24)
    half = np.float32(2 ** -25)

    def drawn(part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = mixed(part, 100 + k)
        m2 = (m ^ (m >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        m2 ^= m2 >> np.uint64(32)
        u = [((x >> np.uint64(s)) & np.uint64(0xFFFFFF)).astype(np.float32) * unit + half for x in (m, m2) for s in (40, 16)]
        beta = ((m ^ (m2 >> np.uint64(7))) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2 ** -16)
        return -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), beta

    for k in range(n):
        score = np.empty(len(ids), np.uint64)
        for a in range(0, len(ids), CHUNK):
            b = min(a + CHUNK, len(ids))
            r, c, beta = drawn(ids[a:b], k)
            step = np.floor(log_w[a:b] / r + beta)
            value = np.log(c) - r * (step - beta + 1)
            bits = value.view(np.uint32)
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))
            score[a:b] = (bits.astype(np.uint64) << np.uint64(32)) | np.arange(a, b, dtype=np.uint64)
        won = (np.minimum.reduceat(score, first) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        r, _, beta = drawn(ids[won], k)
        step = np.floor(log_w[won] / r + beta)
        out[:, k] = mixed(ids[won] * np.uint64(0x9E3779B97F4A7C15) + step.astype(np.int64).view(np.uint64), k)
    return out


def signatures(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(_t1, _t2, bands): band hashes of every text that has words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(BATCH)(batches):
            found = Shingles(batch.column("_text"))
            full = np.flatnonzero(np.diff(found.first) > 0)
            if not len(full):
                continue
            drawn = samples(found.ids, found.weights(idf), found.first[:-1][full], BANDS * ROWS)
            bands = np.zeros((len(full), BANDS), np.uint64)
            for i in range(ROWS):
                bands = mixed(bands ^ drawn[:, i::ROWS], 40 + i)
            keep = pa.array(full)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_t1").take(keep), batch.column("_t2").take(keep), pa.ListArray.from_arrays(
                    pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))],
                ["_t1", "_t2", "bands"])
    return texts.select("_t1", "_t2", "_text").mapInArrow(run, "_t1 bigint, _t2 bigint, bands array<bigint>")


def similarities(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(a, b, s): weighted Jaccard similarity of each pair of nodes."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("_text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("_text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(BATCH)(batches):
            sides = [Shingles(batch.column(c)) for c in ("ta", "tb")]
            weights = [x.weights(idf).astype(np.float64) for x in sides]
            out = []
            for i in range(batch.num_rows):
                (a, wa), (b, wb) = ((x.ids[s], w[s]) for x, w in zip(sides, weights, strict=True)
                                    for s in [slice(x.first[i], x.first[i + 1])])
                _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                low = np.minimum(wa[ia], wb[ib]).sum()
                all_ = wa.sum() + wb.sum() - low
                out.append(low / all_ if all_ else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())],
                                             ["a", "b", "s"])
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a string, b string, s double")


def prefixes(texts: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """(node, class, aside, id, rest, all): shingles of which two texts share one if they are similar enough.

    In one order of all shingles, rarest among these texts first, a text's prefix ends where what
    follows weighs less than ``similar`` of the whole; the first shingle two similar texts share
    is in both prefixes, and from there on both weigh as much as they must share.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(BATCH)(batches):
            found = Shingles(batch.column("_text"))
            row = pa.array(found.row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(row), batch.column("class").take(row), batch.column("aside").take(row),
                 pa.array(found.ids.view(np.int64)), pa.array(found.weights(idf).astype(np.float64))],
                ["node", "class", "aside", "id", "w"])
    rows = staged(texts.mapInArrow(run, "node string, class string, aside boolean, id bigint, w double"), "shingles")
    rare = rows.groupBy("id").agg(F.count("*").alias("n"))
    order = W.partitionBy("node").orderBy(F.desc("n"), F.desc("id")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("node")
    return rows.join(rare, "id").withColumns({"rest": F.sum("w").over(order), "all": F.sum("w").over(whole)}).where(
        F.col("rest") >= similar * F.col("all") - 1e-6).select("node", "class", "aside", "id", "rest", "all")


def linked(members: DataFrame, texts: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """Verified links (a, b, s) among the members (band, key, node) of buckets."""
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("n"))
    company = members.join(sizes, ["band", "key"]).groupBy("node").agg(F.sum("n").alias("n"))
    central = members.join(company, "node").groupBy("band", "key").agg(F.max(F.struct("n", "node")).alias("c")).select(
        "band", "key", F.col("c.node").alias("leader"))
    led = staged(members.join(central, ["band", "key"]), "led")
    tested = staged(similarities(led.where("node <> leader").select(
        F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct(), texts, idf), "first-pairs")
    links = tested.where(F.col("s") >= similar)
    groups = components(links)
    own = led.join(groups, led.node == groups.id, "left").select(
        "band", "key", "node", "leader", F.coalesce("class", "node").alias("class"))
    main = own.where("node = leader").select("band", "key", F.col("class").alias("main"))
    split = own.join(main, ["band", "key"]).groupBy("band", "key").agg(
        F.max((F.col("class") != F.col("main")).cast("int")).alias("apart")).where("apart = 1")
    rest = own.join(main, ["band", "key"]).join(split, ["band", "key"], "left_semi").groupBy("node").agg(
        F.first("class").alias("class"), F.max(F.col("class") != F.col("main")).alias("aside"))
    short = staged(prefixes(texts.join(rest, "node"), idf, similar), "prefixes")
    x, y = short.where("aside").alias("x"), short.alias("y")
    shared = similar / (1 + similar) * (F.col("x.all") + F.col("y.all")) - 1e-6
    pairs = x.join(y, "id").where((F.col("x.class") != F.col("y.class")) & (F.least("x.rest", "y.rest") >= shared)).select(
        F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    more = staged(similarities(pairs.join(tested, ["a", "b"], "left_anti"), texts, idf), "last-pairs")
    return links.union(more.where(F.col("s") >= similar))


def node(t1: str = "_t1", t2: str = "_t2") -> Column:
    return F.concat(F.lpad(F.hex(t1), 16, "0"), F.lpad(F.hex(t2), 16, "0"))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.withColumns({"_text": body, "_t1": F.xxhash64(body), "_t2": F.xxhash64(F.lit(1), body)})


def text_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, class) of the texts of ``keyed`` documents that are linked to another text."""
    idf = inverse_frequencies(docs)
    drawn = staged(signatures(docs, idf).groupBy("_t1", "_t2").agg(F.first("bands").alias("bands")).select(
        node().alias("node"), "_t1", "_t2", "bands"), "signatures")
    rows = drawn.select("node", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    members = staged(rows.join(shared, ["band", "key"]), "members")
    asked = members.select("node").distinct().join(drawn.select("node", "_t1", "_t2"), "node")
    texts = staged(docs.select("_t1", "_t2", "_text").join(asked, ["_t1", "_t2"]).groupBy("_t1", "_t2").agg(
        F.first("node").alias("node"), F.first("_text").alias("_text")).select("node", "_text"), "texts")
    return components(linked(members, texts, idf, similar)).select(F.col("id").alias("node"), "class")


def classes(docs: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, _t1, _t2, _class) for each row of ``docs``."""
    rows = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    groups = text_classes(rows, similar)
    own = rows.select("doc_id", "_t1", "_t2", node().alias("node")).join(groups, "node", "left").select(
        "doc_id", "_t1", "_t2", F.coalesce("class", "node").alias("_class"))
    named = own.groupBy("_class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return own.join(named, "_class")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one of least id, of these the one of least text hash."""
    found = classes(docs)
    kept = found.groupBy("_class").agg(F.min(F.struct("doc_id", "_t1", "_t2")).alias("k")).select("k.*")
    docs, given_back = set_aside(docs, "_text", "_t1", "_t2")
    rows = keyed(docs)
    same = (rows["_t1"] == kept["_t1"]) & (rows["_t2"] == kept["_t2"]) & rows["doc_id"].eqNullSafe(kept["doc_id"])
    return given_back(rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_t1", "_t2"]).select(docs.columns))
