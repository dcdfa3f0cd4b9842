"""The rate and tier rules as SQL functions of a session, for queries that are written as SQL text.

They are single expressions, so Spark inlines them into the plan; the guards fire as in
:mod:`doorstep.functions.scalar`, whose columns they equal.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import params as P

_GUARD = "raise_error('shrunk_rate needs 0 <= successes <= trials')"

FUNCTIONS = {
    "ratio(num DOUBLE, den DOUBLE) RETURNS DOUBLE": "try_divide(num, den)",
    "raw_rate(successes BIGINT, trials BIGINT) RETURNS DOUBLE":
        "bround(try_divide(cast(successes AS double), cast(trials AS double)), 4)",
    "shrunk_rate(successes BIGINT, trials BIGINT) RETURNS DOUBLE":
        f"CASE WHEN successes < 0 OR trials < 0 OR successes > trials THEN cast({_GUARD} AS double) "
        f"ELSE (successes + {float(P.SHRINKAGE_K * P.RTO_PRIOR)!r}D) / (trials + {float(P.SHRINKAGE_K)!r}D) END",
    "logistic(x DOUBLE) RETURNS DOUBLE":
        "CASE WHEN x >= 0 THEN 1 / (1 + exp(-abs(x))) ELSE exp(-abs(x)) / (1 + exp(-abs(x))) END",
    "rule_tier_m1(shrunk DOUBLE, is_new BOOLEAN) RETURNS STRING":
        f"CASE WHEN shrunk >= {float(P.HIGH_RTO_SHRUNK)!r}D THEN 'HIGH' "
        f"WHEN shrunk >= {float(P.MED_RTO_SHRUNK)!r}D OR is_new THEN 'MED' ELSE 'LOW' END",
}


def install(spark: SparkSession) -> None:
    """Declare the functions for this session; a second call replaces them."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
