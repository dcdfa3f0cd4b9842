"""Terms and types of semi-structured payloads, found from the data.

Payloads are parsed once to VARIANT; text that is no JSON is counted and never stops the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAD, NONE, OTHER = "BAD JSON", "NO PAYLOAD", "NOT AN OBJECT"


def parsed(rows: DataFrame, payload: str, by: str) -> DataFrame:
    """(grp, p, v): the payload's text and its VARIANT, null where it can't be parsed."""
    return rows.select(F.col(by).alias("grp"), F.col(payload).alias("p"), F.try_parse_json(F.col(payload)).alias("v"))


def terms(rows: DataFrame, payload: str = "props", by: str = "event_type") -> DataFrame:
    """(by, term, type, events, total): one row for each term of an object and each of its types.

    ``total`` sums the values that are numbers, null if none is. Payloads without terms are rows with a null
    term: text that is no JSON, no payload, JSON that is no object (an empty object too)."""
    spark = rows.sparkSession
    return spark.sql(f"""
        SELECT grp AS `{by}`, key AS term,
               CASE WHEN key IS NOT NULL THEN schema_of_variant(value) WHEN p IS NULL THEN '{NONE}'
                    WHEN v IS NULL THEN '{BAD}' ELSE '{OTHER}' END AS type,
               count(*) AS events, sum(try_variant_get(value, '$', 'double')) AS total
        FROM {{rows}}, LATERAL variant_explode_outer(v) GROUP BY ALL""", rows=parsed(rows, payload, by))


def shapes(rows: DataFrame, payload: str = "props", by: str = "event_type") -> DataFrame:
    """(by, payloads, bad, shape): the schema that holds every payload of a group."""
    return parsed(rows, payload, by).groupBy(F.col("grp").alias(by)).agg(
        F.count("p").alias("payloads"), F.count_if(F.col("p").isNotNull() & F.col("v").isNull()).alias("bad"),
        F.schema_of_variant_agg("v").alias("shape"))
