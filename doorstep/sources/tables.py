"""Readers, writers and the checks between a frame and its declared contract."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas

KNOWN_EMPTY: dict[tuple[str, str], str] = {}

# (table, column) -> (flag column, must be present wherever the flag is true)
PARTIAL_BY_DESIGN = {
    ("truth_order_probability", "logit_cod_components"): ("components_populated", True),
    ("truth_order_probability", "logit_rto_components"): ("components_populated", False),
}


class ContractError(ValueError):
    """A frame breaks its declared contract."""


# ---- reading -----------------------------------------------------------------------------
def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One declared table; columns come back in their declared types."""
    return conform(spark.read.parquet(f"{folder}/{table}"), schemas.schema(table))


def load_all(spark: SparkSession, folder: str,
             tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    return {t: load(spark, folder, t) for t in (tables or schemas.COLUMNS)}


def load_external(spark: SparkSession, url: str, query: str, *, partition_column: str,
                  lower: str, upper: str, partitions: int, **options: str) -> DataFrame:
    """Partitioned JDBC read of a view, for an external warehouse."""
    return (spark.read.format("jdbc").options(
        url=url, dbtable=f"({query}) AS src", partitionColumn=partition_column,
        lowerBound=lower, upperBound=upper, numPartitions=str(partitions), **options).load())


def register_views(tables: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> None:
    for name in names or tables:
        tables[name].createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None
            ) -> DataFrame:
    """Run one SQL text; ``tables`` become its views first."""
    if tables:
        register_views(tables)
    return spark.sql(text)


# ---- conforming ----------------------------------------------------------------------------
def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Declared columns only, in declared order and type; an absent column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ContractError(f"declared columns absent: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def conform_report(df: DataFrame, schema: StructType) -> DataFrame:
    """Values per column that a tolerant cast would lose (non-null before, NULL after)."""
    lost = [F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
            .alias(f.name) for f in schema if f.name in df.columns]
    return _long(df.agg(*lost), [f.name for f in schema if f.name in df.columns],
                 "column", "rejected")


def _long(one_row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias(key), F.col(f"`{n}`").alias(value)) for n in names])).alias("e")
    ).select("e.*")


def preflight(df: DataFrame, table: str) -> DataFrame:
    """One row per declared column: absent, entirely NULL, or fine; extra columns listed."""
    declared, present = schemas.columns(table), df.columns
    common = [c for c in declared if c in present]
    counted = _long(df.agg(*[F.count(c).alias(c) for c in common]), common, "column", "non_null")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    status = (F.when(total == 0, "EMPTY TABLE").when(F.col("non_null") > 0, "OK")
              .when(F.concat(F.lit(f"{table}."), F.col("column")).isin(
                  [f"{t}.{c}" for t, c in KNOWN_EMPTY] or [""]), "KNOWN EMPTY")
              .otherwise("ALL NULL"))
    out = counted.select(F.lit(table).alias("table"), "column", "non_null",
                         status.alias("status"))
    odd = [(table, c, None, "ABSENT") for c in declared if c not in present]
    odd += [(table, c, None, "UNDECLARED") for c in present if c not in declared]
    if odd:
        out = out.unionByName(df.sparkSession.createDataFrame(
            odd, "`table` string, `column` string, non_null long, status string"))
    return out


def partial_columns(df: DataFrame, table: str) -> DataFrame:
    """Columns filled only for a flagged subset, against the flag that explains them."""
    rules = {c: rule for (t, c), rule in PARTIAL_BY_DESIGN.items() if t == table}
    if not rules:
        raise ContractError(f"{table} declares no partial column")
    parts = []
    for column, (flag_col, exact) in rules.items():
        has, flagged = F.col(column).isNotNull(), F.coalesce(F.col(flag_col), F.lit(False))
        parts.append(F.struct(
            F.lit(column).alias("column"), F.count_if(has).alias("populated"),
            F.count_if(has & ~flagged).alias("outside_flag"),
            (F.count_if(flagged & ~has) if exact else F.lit(0).cast("long"))
            .alias("missing_inside_flag")))
    rows = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("e")).select("e.*")
    return rows.withColumn("ok", (F.col("populated") > 0) & (F.col("outside_flag") == 0)
                           & (F.col("missing_inside_flag") == 0))


# ---- writing -------------------------------------------------------------------------------
def write_table(df: DataFrame, folder: str, table: str,
                partition_by: Iterable[str] = ()) -> int:
    """Replace one table and return its row count; a short landing leaves the old one in place."""
    path, sent = land(df, folder, table, partition_by)
    replace(df.sparkSession, {table: path}, folder)
    return sent


def land(df: DataFrame, folder: str, table: str,
         partition_by: Iterable[str] = ()) -> tuple[str, int]:
    """Write ``df`` beside its table and return the path and the rows sent.

    The rows are counted where they pass into the write, so the plan runs once; what landed
    is counted from the files. A difference deletes them and raises :class:`ContractError`.
    """
    path = f"{folder}/incoming-{table}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("sent")).write.partitionBy(*partition_by).parquet(path)
    sent, landed = seen.get["sent"], rows_in(df.sparkSession, path, df.schema)
    if sent != landed:
        remove(df.sparkSession, path)
        raise ContractError(f"{table}: {sent} rows sent, {landed} landed; the old table stays")
    return path, sent


def rows_in(spark: SparkSession, path: str, schema: StructType) -> int:
    return spark.read.schema(schema).parquet(path).count()


def remove(spark: SparkSession, path: str) -> bool:
    """Delete ``path`` where the session's file systems have it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def replace(spark: SparkSession, landed: Mapping[str, str], folder: str) -> None:
    """Put each landed folder in the place of its table."""
    for table, path in landed.items():
        source, target = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{folder}/{table}"))
        remove(spark, f"{folder}/{table}")
        if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
            raise ContractError(f"{table}: {path} was checked but could not be moved")


def write_all(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Overwrite every table in reference order, then compare sent with landed row counts.

    All tables land and are counted before the first is replaced."""
    spark = next(iter(tables.values())).sparkSession
    names = [t for t in load_order() if t in tables] + [t for t in tables
                                                        if t not in schemas.COLUMNS]
    landed, sent = {}, []
    try:
        for name in names:
            landed[name], rows = land(tables[name], folder, name)
            sent.append((name, rows))
    except Exception:
        for path in landed.values():
            remove(spark, path)
        raise
    replace(spark, landed, folder)
    drop_stale(spark, folder, names)
    return landed_counts(spark, folder, spark.createDataFrame(sent, "`table` string, sent bigint"))


def landed_counts(spark: SparkSession, folder: str, sent: DataFrame) -> DataFrame:
    """``(table, sent, landed, ok)``; use :func:`require_equal` to stop on a mismatch."""
    names = [r["table"] for r in sent.select("table").toLocalIterator()]
    landed = None
    for name in names:
        row = spark.read.parquet(f"{folder}/{name}").agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("landed"))
        landed = row if landed is None else landed.unionByName(row)
    return sent.join(landed, "table", "full_outer").withColumn(
        "ok", F.col("sent").eqNullSafe(F.col("landed")))


def require_equal(counts: DataFrame) -> None:
    bad = counts.where(~F.col("ok")).limit(20).collect()
    if bad:
        raise ContractError(f"row counts differ: {[r.asDict() for r in bad]}")


def drop_stale(spark: SparkSession, folder: str, keep: Iterable[str]) -> list[str]:
    """Delete declared-table outputs under ``folder`` that this run did not write."""
    keep, gone = set(keep), []
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in schemas.COLUMNS:
        path = jvm.org.apache.hadoop.fs.Path(root, name)
        if name not in keep and fs.exists(path):
            fs.delete(path, True)
            gone.append(name)
    return gone


def load_order() -> list[str]:
    """Tables so that every parent precedes its children (the circular pair excepted)."""
    parents = {t: {p for c, _, p, _ in schemas.FOREIGN_KEYS if c == t and p != t}
               for t in schemas.COLUMNS}
    parents["fct_checkout_session"].discard("fct_order")
    order: list[str] = []
    while len(order) < len(parents):
        ready = [t for t in parents if t not in order and parents[t] <= set(order)]
        order += ready
    return order


def write_scores(scores: DataFrame, folder: str, model: str) -> None:
    """Score sink: session keys, score, tier and the per-volume restriction flags."""
    keep = [c for c in scores.columns if c in ("session_id", "customer_id", "score", "tier")
            or c.startswith("restricted_")]
    write_table(scores.select(*keep), folder, f"{model}_scores")
