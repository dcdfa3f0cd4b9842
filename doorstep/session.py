"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "doorstep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Runtime settings the wide expressions need, where the session left the default.

    Above 8,000 bytes the JVM does not compile a generated method and interprets it, which
    costs more than leaving whole-stage generation for that operator.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, "8000")


@contextmanager
def session_settings(spark: SparkSession, settings: Mapping[str, object]) -> Iterator[None]:
    """``settings`` inside the block, the former ones afterwards; a stream keeps those it started with.

    A keyed stream opens a store for each of its partitions in every batch, and their number stays for
    good, so it follows the cores rather than the number that suits a shuffle.
    """
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, str(value).lower())
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an input that arrives in fewer splits than there are cores.

    Large inputs already have more splits than that and pass through untouched; filters and
    column pruning still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temp folder only in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    folder = tempfile.mkdtemp(prefix="doorstep-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


#: An execution under this setting drops its shuffle files when it ends. Otherwise they stay until
#: the driver happens to collect garbage, and a query of many steps holds those of all of them.
DROPPED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": True}


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``.

    Used where a result depends on *where* a row landed (range partition ids), so a
    lost executor must not recompute it differently.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    with session_settings(spark, DROPPED):
        # planned anew, as the setting is read when a plan is made
        return df.select("*").checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once, as columns, below the checkpoint folder and read back.

    For wide tables that several scans read: each scan decodes only the columns it needs, and
    the plan behind ``df`` runs once for all of them.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    with session_settings(df.sparkSession, DROPPED):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what :func:`keep` wrote for ``df``, once nothing that reads it is still to run."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
