"""Helpers the operators share: tables, staging, null-safe keys, components, word bytes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut

#: Bytes between words: blank and the six control characters of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shipped(spark: SparkSession) -> None:
    """Gives the package to Python workers that can't import it, once for each Spark context."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    name = f"{Path(__file__).parents[1].name}.zip"
    if any(f.endswith(name) for f in sc.listFiles):
        return
    path = Path(tempfile.mkdtemp()) / name  # of the driver, whose file server hands it out
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(Path(__file__).parents[1].rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB, where the session left the default of 64: a task may hold several copies of one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "8000000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text as a string; null stands for the empty text."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def row_key(*columns: Column | str) -> list[Column]:
    """128 bits that name a row by its values, nulls included: ``_k1`` and ``_k2``."""
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(1), *columns).alias("_k2")]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *internal: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns of these names, in any case, under names of their own, and what gives them back."""
    inside = {c.lower() for c in internal}
    old = [c for c in df.columns if c.lower() in inside]
    if not old:
        return df, lambda out: out
    new = fresh(df, *(f"kept_{c}" for c in old))
    return df.withColumnsRenamed(dict(zip(old, new))), lambda out: out.withColumnsRenamed(dict(zip(new, old)))


def components(edges: DataFrame) -> DataFrame:
    """(id, class) for every end of the edges (a, b): class is the least id that it reaches.

    Large-star and small-star steps in turn, each a grouped minimum and a join on the node, so
    a hub is pre-aggregated before the shuffle and its rows are split by adaptive execution.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct())
        now = cut(small)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            return now.groupBy("a").agg(F.min("b").alias("class")).select(F.col("a").alias("id"), "class").union(
                now.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct())
        before = sums


def by_size(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts Arrow batches so that each holds about ``size`` bytes, one row at least."""
    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)
    return cuts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each row starts and ends."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 well-mixed bits of each number (the finaliser of splitmix64)."""
    x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Word bounds of a batch of texts and a 64-bit hash of each word."""

    def __init__(self, column: pa.Array, hashed: bool = True, seed: int = 0, lower: bool = False):
        self.data, self.rows = text_bytes(column)
        data = self.data
        word = np.ones(len(data) + 2, bool)
        word[0] = word[-1] = False
        np.logical_and(data != 32, (data < 9) | (data > 13), out=word[1:-1])
        starts_at = word[1:-1] & ~word[:-2]
        ends_at = word[1:-1] & ~word[2:]
        edges = self.rows[1:-1][(self.rows[1:-1] > 0) & (self.rows[1:-1] < len(data))]
        starts_at[edges] = word[1:-1][edges]  # a row's end ends a word
        ends_at[edges - 1] = word[1:-1][edges - 1]
        self.starts = np.flatnonzero(starts_at)
        self.ends = np.flatnonzero(ends_at) + 1
        #: the words of row r are those from first[r] to first[r + 1]
        self.first = np.searchsorted(self.starts, self.rows)
        if hashed:
            self.hashes = self._hash(seed, lower)

    def _hash(self, seed: int, lower: bool) -> np.ndarray:
        """Polynomials over the bytes of each word, modulo 2**64, then mixed with its length."""
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        lengths = self.ends - self.starts
        if not len(lengths):
            return np.zeros(0, np.uint64)
        table = mixed(np.arange(256, dtype=np.uint64), seed + 11)
        base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
        # powers restart in blocks, so that no array is longer than the batch
        up = powers(base, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up, out=sums[1:])
        total = sums[self.ends] - sums[self.starts]
        down = powers(inverse, len(data))
        return mixed(total * down[self.starts] + lengths.astype(np.uint64) * _ODD, seed)


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive words; the last width - 1 starts are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (0xD1342543DE82EF95 + 2 * seed) & (2**64 - 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes, seed + 3) * powers(base, len(hashes)), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(pow(base, -1, 2**64), n), seed)


def blob_sum(parts: DataFrame, fan: int = 64) -> np.ndarray | None:
    """Sum of float64 vectors in the binary column ``v``, in two streamed steps of one vector a task.

    The driver gets one vector, whose length the caller's parameters fix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("v"):
                v = np.frombuffer(x.as_buffer(), np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])
    row = parts.repartition(fan).mapInArrow(run, "v binary").repartition(1).mapInArrow(run, "v binary").first()
    return None if row is None else np.frombuffer(row["v"], np.float64)
