"""Published check results that carry the fingerprint of the data they describe."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_hash(df: DataFrame) -> Column:
    """Hash of a row's values in the order of the column names."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)])


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash: row count, xor and sum of row hashes, schema hash."""
    names = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    one = df.select(row_hash(df).alias("h")).agg(
        F.count("h").alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    digest = F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("x").cast("string"),
                                F.col("s").cast("string")), 256)
    return one.select("rows", digest.alias("content_hash"),
                      F.lit(hashlib.sha256(names.encode()).hexdigest()).alias("schema_hash"))


def manifest(tables: dict[str, DataFrame], config: str = "") -> DataFrame:
    """Fingerprint per table, with the hash of the configuration that produced it."""
    out = None
    for name, df in tables.items():
        row = fingerprint(df).select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("config_hash", F.lit(hashlib.sha256(config.encode()).hexdigest()))


def compare_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per table: identical, the data moved, or the configuration moved."""
    a, b = old.alias("a"), new.alias("b")
    same = F.col("a.content_hash").eqNullSafe(F.col("b.content_hash")) & \
        F.col("a.schema_hash").eqNullSafe(F.col("b.schema_hash"))
    verdict = (F.when(F.col("a.table").isNull(), "NEW").when(F.col("b.table").isNull(), "MISSING")
               .when(same, "IDENTICAL")
               .when(F.col("a.config_hash") != F.col("b.config_hash"), "CONFIG MOVED")
               .otherwise("DATA MOVED"))
    return a.join(b, F.col("a.table") == F.col("b.table"), "full_outer").select(
        F.coalesce("a.table", "b.table").alias("table"), verdict.alias("verdict"))


def publish_checks(checks: DataFrame, data: DataFrame, path: str) -> None:
    """Write check rows as JSON next to the fingerprint of ``data``."""
    stamp = fingerprint(data).select(F.struct("content_hash", "schema_hash").alias("f")).scalar()
    checks.withColumn("_f", stamp).select(
        *checks.columns, F.col("_f.content_hash").alias("content_hash"),
        F.col("_f.schema_hash").alias("schema_hash")).write.mode("overwrite").json(path)


def read_checks(spark: SparkSession, path: str, data: DataFrame, schema: str) -> DataFrame:
    """Published rows with ``stale``: true when they describe other data."""
    rows = spark.read.schema(schema + ", content_hash string, schema_hash string").json(path)
    stamp = fingerprint(data).select(F.struct("content_hash", "schema_hash").alias("f")).scalar()
    return rows.withColumn("_f", stamp).withColumn(
        "stale", ~(F.col("content_hash").eqNullSafe(F.col("_f.content_hash"))
                   & F.col("schema_hash").eqNullSafe(F.col("_f.schema_hash")))).drop("_f")
