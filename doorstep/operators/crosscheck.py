"""The same metric computed through the DataFrame API and through Spark SQL, compared."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# tolerance by kind of metric: counts are exact
RATE_TOLERANCE, MONEY_TOLERANCE = 1e-4, 0.01
_MONEY = ("cost", "cm", "loss", "value", "exposure", "drag", "factor", "difference")


def metric_rows(df: DataFrame, query: str) -> DataFrame:
    """Unpivot a result to ``(metric, value)``; text columns name the row."""
    keys = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    values = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    label = F.concat_ws("/", F.lit(query), *[F.coalesce(F.col(k).cast("string"), F.lit("-"))
                                            for k in keys])
    cells = F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("value"))
                      for v in values])
    return df.select(label.alias("row"), F.explode(cells).alias("c")).select(
        F.concat_ws(".", "row", "c.column").alias("metric"), F.col("c.value").alias("value"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full join on the metric name: ``(metric, a, b, ok)``. A one-sided metric is not ok."""
    j = a.select("metric", F.col("value").alias("a"), F.lit(1).alias("ina")).join(
        b.select("metric", F.col("value").alias("b"), F.lit(1).alias("inb")), "metric",
        "full_outer")
    name = F.substring_index("metric", ".", -1)
    money = F.lit(False)
    for word in _MONEY:
        money = money | name.contains(word)
    rate = name.rlike("rate|share|pct|conversion|gap|weighted")
    tol = F.when(rate, RATE_TOLERANCE).when(money, MONEY_TOLERANCE).otherwise(0.0)
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    return j.select("metric", "a", "b",
                    (both & (F.col("a").eqNullSafe(F.col("b"))
                             | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tol, F.lit(False))))
                    .alias("ok"))


def compare_all(t: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> DataFrame:
    """Every metric of the library, DataFrame API against its Spark SQL twin."""
    from ..plans.sql_twins import TWINS
    from ..sources.tables import register_views
    from .funnel import QUERIES
    from ..session import cut
    spark = t["fct_order"].sparkSession
    # read by some thirty metric plans, so each shared table is built once
    t = {name: cut(t[name]) for name in ("fct_order", "fct_order_economics", "fct_checkout_session",
                       "dim_geography", "fct_customer_state_at_session", "fct_delivery_event",
                                         "dim_product")}
    register_views(t)
    out = None
    for name in names or QUERIES:
        pair = compare(metric_rows(QUERIES[name](t), name),
                       metric_rows(spark.sql(TWINS[name]), name))
        out = pair if out is None else out.unionByName(pair)
    return out
