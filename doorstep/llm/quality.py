"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text becomes a fixed vector of statistics, computed from the whole text in one pass and
written once. They are standardised by their means and deviations over all documents and mapped
to cosines whose inner products approximate a Gaussian kernel. Every task sums its own normal
equations; only these sums, of a size the parameters fix, reach the driver, which solves them.
Two folds score each other's rows; these scores, counted in ``BINS`` bins, give a monotone map
to probabilities by pooling adjacent violators.

Defined results: a null text counts as empty; an empty text gets the score of its (zero)
statistics. Labels that repeat for an id are averaged, null labels and null ids teach nothing.
Without labelled rows every score is 0.5. Rows that repeat are scored alike. Language, source and
id are no input of a score. Further columns are kept by ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blob_sum, by_size, set_aside, staged, table, text_of, windows

#: Random features, kernel width in deviations, ridge weight, bins of the calibration, seed.
FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 4.0, 1e-3, 1000, 7
LOW, HIGH = -0.5, 1.5

#: Byte classes whose shares are statistics.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r", b".", b",", b"!?",
           b"|", b"*$%&#@^~", b"\"'()[]", b"<>{}=/\\_", b"-:;+", bytes(range(128, 256)))
N_STATS = len(CLASSES) + 11


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``N_STATS`` numbers for each text."""
    words = Words(column)
    data, rows, first = words.data, words.rows, words.first
    n_rows = len(rows) - 1
    size, count = np.diff(rows), np.diff(first)
    table_ = np.full(256, len(CLASSES), np.int64)
    for k, members in enumerate(CLASSES):
        table_[list(members)] = k
    width = len(CLASSES) + 1
    row_of_byte = np.repeat(np.arange(n_rows), size)
    shares = np.bincount(row_of_byte * width + table_[data], minlength=n_rows * width).reshape(n_rows, width)
    row_of_word = np.repeat(np.arange(n_rows), count)
    some, plenty = np.maximum(count, 1), np.maximum(size, 1)

    def per_row(x: np.ndarray) -> np.ndarray:
        return np.bincount(row_of_word, weights=x, minlength=n_rows)

    def distinct(h: np.ndarray, row: np.ndarray) -> np.ndarray:
        key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        new = np.flatnonzero(np.diff(key, prepend=~key[:1] if len(key) else key) != 0)
        return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n_rows)
    lengths = (words.ends - words.starts).astype(np.float64)
    two = windows(words.hashes, 2)
    inside = row_of_word[1:] == row_of_word[:-1] if len(row_of_word) > 1 else np.zeros(0, bool)
    last = data[words.ends - 1] if len(words.ends) else data[:0]
    head = data[words.starts] if len(words.starts) else data[:0]
    upper = (head >= 65) & (head <= 90)
    letter = ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | (last >= 128)
    mean = per_row(lengths) / some
    lines = shares[:, 4] + 1
    return np.column_stack([
        shares[:, :len(CLASSES)] / plenty[:, None], np.log1p(size), np.log1p(count), mean,
        np.sqrt(np.maximum(per_row(lengths ** 2) / some - mean ** 2, 0)), distinct(words.hashes, row_of_word) / some,
        distinct(two[inside], row_of_word[:-1][inside]) / np.maximum(count - 1, 1), per_row(~letter) / some,
        per_row(upper) / some, per_row(lengths == 1) / some, np.log1p(count / lines), per_row(lengths > 20) / some])


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``_x``: its statistics."""
    source = docs.withColumn("_text", text_of(docs, text)).drop(text)
    kept = [c for c in source.columns if c != "_text"]
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept), "_x array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(4_000_000)(batches):
            x = statistics(batch.column("_text")).astype(np.float32)
            ends = pa.array(np.arange(0, x.size + 1, N_STATS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(
                ends, pa.array(x.ravel()))], [*kept, "_x"])
    return source.mapInArrow(run, schema)


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 0, deviation, 1.0)
        self.turn = draw.normal(0, 1 / WIDTH, (N_STATS, FEATURES - 1))
        self.shift = draw.uniform(0, 2 * np.pi, FEATURES - 1)
        self.weights: np.ndarray | None = None
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.column_stack([np.ones(len(z)), np.sqrt(2) * np.cos(z @ self.turn + self.shift)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.steps is None:
            return np.full(len(x), 0.5)
        return np.interp(self.features(x) @ self.weights, *self.steps)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(np.float64)


def _solved(sums: np.ndarray) -> np.ndarray:
    a, b = sums[:FEATURES ** 2].reshape(FEATURES, FEATURES), sums[FEATURES ** 2:-1]
    return np.linalg.solve(a + RIDGE * max(sums[-1], 1) * np.eye(FEATURES), b)


def pooled(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Non-decreasing means of adjacent bins: least squares with the counts as weights."""
    blocks: list[list[float]] = []
    for t, c in zip(total, count, strict=True):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / c) for t, c, n in blocks])


def fitted(stats: DataFrame, taught: DataFrame) -> Model:
    """``stats``: _x of all documents; ``taught``: _x, y and fold (0 or 1) of labelled ones."""
    moments = stats.select(*[e for i in range(N_STATS) for e in (
        F.avg(F.get("_x", F.lit(i)).cast("double")), F.stddev_pop(F.get("_x", F.lit(i)).cast("double")))]).first()
    flat = np.array([0.0 if v is None else v for v in moments])
    model = Model(flat[0::2], flat[1::2])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = FEATURES ** 2 + FEATURES + 1
        total = np.zeros(2 * part)
        for batch in batches:
            z, y = model.features(_matrix(batch.column("_x"))), batch.column("y").to_numpy()
            fold = batch.column("fold").to_numpy()
            for k in (0, 1):
                f, t = z[fold == k], y[fold == k]
                total[k * part:(k + 1) * part] += np.concatenate([(f.T @ f).ravel(), f.T @ t, [len(t)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])
    both = blob_sum(taught.mapInArrow(sums, "v binary"))
    if both is None or not both.any():
        return model
    folds = np.split(both, 2)
    model.weights = _solved(folds[0] + folds[1])
    other = [_solved(folds[1]), _solved(folds[0])]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = model.features(_matrix(batch.column("_x"))), batch.column("fold").to_numpy()
            raw = np.where(fold == 0, z @ other[0], z @ other[1])
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["bin", "y"])
    bins = taught.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(
        F.sum("y").alias("t"), F.count("*").alias("n")).orderBy("bin").collect()  # BINS rows at most
    at = np.array([r["bin"] for r in bins])
    model.steps = (LOW + (at + 0.5) / BINS * (HIGH - LOW), pooled(
        np.array([r["t"] for r in bins], float), np.array([r["n"] for r in bins], float)))
    return model


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with held_out, score and predicted; ``labels``: doc_id, quality."""
    source, given_back = set_aside(docs.drop("held_out", "score", "predicted"), "y", "_l", "_x", "_text")
    stats = staged(document_statistics(source, text), "statistics")
    code = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.avg(F.col("quality").cast("double")).alias("y")).select(F.col("doc_id").alias("_l"), "y")
    taught = stats.where(code % 3 != 1).join(truth, F.col(doc_id) == F.col("_l")).select(
        "_x", "y", (F.floor(code / 3) % 2).cast("int").alias("fold"))
    model = fitted(stats, staged(taught, "taught"))
    kept = [c for c in stats.columns if c != "_x"]
    schema = ", ".join([*(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in kept), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(
                model.scores(_matrix(batch.column("_x"))))], [*kept, "score"])
    return given_back(stats.mapInArrow(run, schema).withColumns({
        "held_out": F.coalesce(code % 3 == 1, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")}))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    docs, given_back = set_aside(docs, "_k1", "_k2")
    rows = docs.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit(1), "doc_id", "text")})
    judged = scored(rows.select("doc_id", "text", "_k1", "_k2"), table(spark, sf_dir, "labels"))
    bad = judged.where("predicted = 0").select("_k1", "_k2").distinct()
    return given_back(rows.join(bad, ["_k1", "_k2"], "left_anti").select(docs.columns))
