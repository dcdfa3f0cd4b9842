"""Every registered query: its Spark job and, where SQL can say it, the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.driver_model import DriverModel
from .oracle import with_ctes

Build = Callable[[DriverModel], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    oracle: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(self.build(DriverModel(spark, sf_dir)))

    def oracle_text(self) -> str | None:
        return None if self.oracle is None else with_ctes(self.oracle)


# three-valued columns travel as 1 / 0 / NULL
OUTCOME_FLAGS = ("rto_flag", "is_delivered")
REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = Query(build, oracle)
        return build
    return add


def portable(df: DataFrame) -> DataFrame:
    """Plain result types: long, double, boolean and text."""
    out = []
    for field in df.schema:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if field.name in OUTCOME_FLAGS or isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("long")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), ",")
        elif isinstance(kind, (T.StructType, T.MapType)):
            col = F.to_json(col)
        out.append(col.alias(field.name))
    return df.select(*out)


def load_all() -> dict[str, Query]:
    """Import every query module once and return the registry."""
    from . import base_queries, causal_queries, model_queries, policy_queries  # noqa: F401
    from . import quality_queries, raw_queries, stream_queries  # noqa: F401
    return REGISTRY
