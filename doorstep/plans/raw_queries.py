"""Stored sketches, funnels and payload terms of raw events, and what changed between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import shared_sql
from ..operators import payloads, raw_funnel, sketches
from ..sources import merkle
from ..sources.artefacts import compare_manifests, manifest
from .oracle import half_even
from .registry import register

# ---- sketches --------------------------------------------------------------------------------
register("sketch_customers_by_month", """
SELECT cast(date_trunc('month', order_date) AS date)::varchar AS period, count(*) AS rows,
  count(DISTINCT customer_id) AS exact_ids, true AS ids_within, true AS ranks_within,
  true AS merge_is_whole
FROM fct_order GROUP BY 1""")(
    lambda m: sketches.report(m["fct_order"], "order_date", "month", "customer_id", "order_value"))

register("sketch_users_by_week", """
SELECT cast(date_trunc('week', ts) AS date)::varchar AS period, count(*) AS rows,
  count(DISTINCT user_id) AS exact_ids, true AS ids_within, true AS ranks_within,
  true AS merge_is_whole
FROM events GROUP BY 1""")(lambda m: sketches.report(
    m["events"].withColumn("day", F.to_date("ts")), "day", "week", "user_id", "value"))

# ---- raw events --------------------------------------------------------------------------------
# every path of types is written out as one text per session, which a pattern then reads
_SESSIONS = f"""
WITH gaps AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER u) < {raw_funnel.GAP * 1_000_000}
      THEN 0 ELSE 1 END AS opens
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
    WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM gaps),
paths AS (SELECT user_id, s, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events,
    string_agg(event_type, ',' ORDER BY ts, event_id) AS path FROM numbered GROUP BY user_id, s),
stepped AS (SELECT *, CASE WHEN regexp_matches(path, 'view.*click.*purchase') THEN 3
    WHEN regexp_matches(path, 'view.*click') THEN 2 WHEN regexp_matches(path, 'view') THEN 1 ELSE 0 END
    AS reached FROM paths)"""

register("event_sessions", _SESSIONS + """
SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(session_end, '%Y-%m-%d %H:%M:%S') AS session_end, events, cast(reached AS bigint) AS reached
FROM stepped""")(lambda m: raw_funnel.sessions(m["events"]).select(
    "user_id", "session_start", "session_end", "events", "reached"))

register("event_funnel", _SESSIONS + """,
steps(step, event_type) AS (VALUES (0, 'any'), (1, 'view'), (2, 'click'), (3, 'purchase')),
counts AS (SELECT step, event_type, (SELECT count(*) FROM stepped WHERE reached >= step) AS n FROM steps)
SELECT c.step, c.event_type, c.n AS sessions, c.n / nullif((SELECT count(*) FROM stepped), 0) AS share,
  c.n / nullif(b.n, 0) AS step_share
FROM counts c JOIN counts b ON b.step = greatest(0, c.step - 1)""")(
    lambda m: raw_funnel.funnel(raw_funnel.sessions(m["events"])))

# ---- payloads ----------------------------------------------------------------------------------
register("payload_terms", """
WITH terms AS (SELECT event_type, props, unnest(json_keys(props)) AS term FROM events
  WHERE json_valid(props) AND json_type(props) = 'OBJECT'),
typed AS (SELECT event_type, term, json_type(props, '$."' || term || '"') AS t,
    json_extract_string(props, '$."' || term || '"') AS x FROM terms)
SELECT event_type, term, CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN t = 'VARCHAR' THEN 'STRING'
    ELSE t END AS type, count(*) AS events, sum(try_cast(x AS double)) AS total
FROM typed GROUP BY ALL
UNION ALL
SELECT event_type, NULL, CASE WHEN props IS NULL THEN 'NO PAYLOAD' WHEN NOT json_valid(props) THEN 'BAD JSON'
    ELSE 'NOT AN OBJECT' END, count(*), NULL
FROM events WHERE props IS NULL OR NOT json_valid(props) OR coalesce(len(json_keys(props)), 0) = 0
GROUP BY ALL""")(lambda m: payloads.terms(m["events"]))

register("payload_shapes", """
SELECT event_type, count(props) AS payloads, count(*) FILTER (WHERE NOT json_valid(props)) AS bad,
  'OBJECT<' || string_agg(DISTINCT json_keys(props)[1] || ': ' || replace(json_type(props, '$.k'), 'UBIGINT', 'BIGINT'), ', ')
  || '>' AS shape
FROM events GROUP BY event_type""")(lambda m: payloads.shapes(m["events"]))

# ---- versions ----------------------------------------------------------------------------------
#: Days between the two versions of the orders.
APART = 45
OUTCOME = ("order_status", "actual_delivery_days", "delivery_delay_days", "delivery_attempts", "is_delivered",
           "rto_flag", "rto_reason", "rto_reason_class", "outcome_resolved_date")


def as_known(orders: DataFrame, day) -> DataFrame:
    """Orders placed by ``day``, without outcomes that came later."""
    known = F.coalesce(F.col("outcome_resolved_date") <= day, F.lit(False))
    return orders.where(F.col("order_date") <= day).withColumns(
        {c: F.when(known, F.col(c)) for c in OUTCOME})


def versions(m) -> tuple[DataFrame, DataFrame]:
    end = m["window_bounds"].select("w_end").scalar()
    return as_known(m["fct_order"], F.date_sub(end, APART)), as_known(m["fct_order"], end)


_CHANGED = f"""
SELECT order_id, CASE WHEN order_date > (SELECT w_end - {APART} FROM window_bounds) THEN 'added' ELSE 'changed' END AS change
FROM fct_order CROSS JOIN window_bounds
WHERE order_date <= w_end AND (order_date > w_end - {APART}
  OR (outcome_resolved_date > w_end - {APART} AND outcome_resolved_date <= w_end))"""
register("order_changes", _CHANGED)(lambda m: merkle.changed_keys(*versions(m), ["order_id"]))


@register("manifest_changes", f"""
SELECT 'fct_order' AS "table", CASE WHEN EXISTS ({_CHANGED}) THEN 'DATA MOVED' ELSE 'IDENTICAL' END AS verdict
UNION ALL SELECT 'dim_seller', 'IDENTICAL'""")
def manifest_changes(m):
    old, new = versions(m)
    return compare_manifests(*(manifest({"fct_order": v, "dim_seller": m["dim_seller"]}) for v in (old, new)))


# ---- shared SQL functions ------------------------------------------------------------------------
_COUNTS = """
SELECT seller_id, cast(sum(CASE WHEN rto_flag THEN 1 ELSE 0 END) AS bigint) AS returned, count(rto_flag) AS resolved
FROM {source} GROUP BY seller_id"""


@register("seller_rates_by_sql", f"""
SELECT seller_id, returned, resolved, {half_even('returned', 'resolved', 4)} AS observed,
  (returned + {P.SHRINKAGE_K * P.RTO_PRIOR}) / (resolved + {P.SHRINKAGE_K}) AS shrunk,
  CASE WHEN (returned + {P.SHRINKAGE_K * P.RTO_PRIOR}) / (resolved + {P.SHRINKAGE_K}) >= {P.HIGH_RTO_SHRUNK} THEN 'HIGH'
       WHEN (returned + {P.SHRINKAGE_K * P.RTO_PRIOR}) / (resolved + {P.SHRINKAGE_K}) >= {P.MED_RTO_SHRUNK}
         OR resolved = 0 THEN 'MED' ELSE 'LOW' END AS tier
FROM ({_COUNTS.format(source='fct_order')})""")
def seller_rates_by_sql(m):
    shared_sql.install(m.spark)
    return m.spark.sql(f"""
        SELECT seller_id, returned, resolved, raw_rate(returned, resolved) AS observed,
               shrunk_rate(returned, resolved) AS shrunk,
               rule_tier_m1(shrunk_rate(returned, resolved), resolved = 0) AS tier
        FROM ({_COUNTS})""", source=m["fct_order"])
