"""The canonical tables derived from the driver's parquet tables.

Each derivation is one SELECT in SQL text that both Spark and DuckDB read, so a query's
DuckDB oracle starts from the same canonical rows while the operators stay independent.
The texts use whole tables; nothing is filtered by id or sampled.

Every user-day of ``events`` is one session. A day with a purchase converts under an order id of
its own. ``events`` has no lines, courier or outcome, so these orders have no row in the order
table; the foreign key scan counts them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from .. import params as P
from ..schemas import schema
from ..session import forget, keep, session_settings, spread, tune

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _case(expr: str, values, default: str | None = None) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms}{f' ELSE {default}' if default else ''} END"


def _lookup(expr: str, mapping: Mapping) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {expr} {arms} END"


def _padded(expr: str, width: int) -> str:
    """``expr`` as text of at least ``width`` digits; longer keys keep all of theirs."""
    text = f"cast({expr} AS string)"
    return f"lpad({text}, cast(greatest({width}, length({text})) AS int), '0')"


def _id(prefix: str, expr: str) -> str:
    return f"'{prefix}_' || {_padded(expr, 10)}"


_SHRUNK_PRE = (f"(floor((ck % 12) * 0.25) + {P.SHRINKAGE_K} * {P.RTO_PRIOR}) / "
               f"((ck % 12) - (CASE WHEN ck % 12 >= 8 THEN 1 ELSE 0 END) + {P.SHRINKAGE_K})")

SQL: dict[str, str] = {
    "window_bounds": """
      SELECT min(cast(o_orderdate AS date)) AS w_start, max(cast(o_orderdate AS date)) AS w_end
      FROM orders""",
    "dim_geography": f"""
      SELECT 'GEO_' || {_padded('n_nationkey', 4)} AS geography_id,
             {_padded('100 + n_nationkey', 3)} AS pincode_prefix,
             n_name AS city_name, r_name AS state_name,
             {_case('r_regionkey % 4', P.GEO_TIERS)} AS geo_tier,
             cast((90 - 10 * (r_regionkey % 4) - n_nationkey % 7) * 0.01 AS decimal(4,3))
               AS serviceability_score,
             cast((88 - 8 * (r_regionkey % 4) - (n_nationkey * 3) % 5) * 0.01 AS decimal(4,3))
               AS courier_reliability_score,
             cast(2 + r_regionkey % 4 + (n_nationkey % 3) * 0.5 AS decimal(3,1))
               AS base_delivery_days,
             cast((45 + 8 * (r_regionkey % 4) + (n_nationkey * 5) % 9) * 0.01 AS decimal(4,3))
               AS cod_cultural_index,
             cast(CASE r_regionkey % 4 WHEN 0 THEN 62 WHEN 1 THEN 72 WHEN 2 THEN 86 ELSE 99 END
                  + n_nationkey % 4 AS decimal(6,2)) AS forward_freight_base
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "seller_base": f"""
      SELECT {_id('SEL', 's_suppkey')} AS seller_id, s_name AS seller_name,
             cast(100 + (s_suppkey * 53) % 3000 AS int) AS seller_tenure_days,
             cast((30 + (s_suppkey * 7) % 21) * 0.1 AS decimal(3,2)) AS seller_rating,
             cast((s_suppkey * 37) % 5000 AS int) AS seller_rating_count,
             cast(((s_suppkey * 11) % 20) * 0.01 AS decimal(4,3)) AS seller_sla_breach_rate,
             cast(((s_suppkey * 3) % 10) * 0.01 AS decimal(4,3)) AS seller_cancellation_rate,
             CASE WHEN s_suppkey % 3 = 0 THEN 'SELLER_SHIP' ELSE 'PLATFORM' END
               AS fulfilment_model
      FROM supplier""",
    "dim_seller": """
      SELECT *, CASE WHEN seller_rating >= 4.5 AND seller_sla_breach_rate <= 0.06 THEN 'GOLD'
                     WHEN seller_rating >= 4.0 AND seller_sla_breach_rate <= 0.12 THEN 'SILVER'
                     ELSE 'BRONZE' END AS seller_tier
      FROM seller_base""",
    "dim_product": f"""
      SELECT product_id, seller_id, category, sub_category, list_price, product_rating,
             review_count, base_discount_pct, cogs_ratio, weight_band,
             cast({_lookup('category', P.SHRINK_BY_CATEGORY)} AS decimal(4,3)) AS shrink_rate,
             is_returnable
      FROM (SELECT {_id('PRD', 'p_partkey')} AS product_id,
                   {_id('SEL', 'p_partkey % (SELECT count(*) FROM supplier)')} AS seller_id,
                   {_case('p_partkey % 6', P.CATEGORIES)} AS category, p_type AS sub_category,
                   cast(p_retailprice AS decimal(10,2)) AS list_price,
                   cast((20 + (p_partkey * 7) % 31) * 0.1 AS decimal(3,2)) AS product_rating,
                   cast((p_partkey * 101) % 5000 AS int) AS review_count,
                   cast((p_partkey % 20) * 0.01 AS decimal(4,3)) AS base_discount_pct,
                   cast((70 + p_partkey % 12) * 0.01 AS decimal(4,3)) AS cogs_ratio,
                   {_case('p_size % 3', ('LIGHT', 'MEDIUM', 'HEAVY'))} AS weight_band,
                   p_partkey % 10 <> 0 AS is_returnable
            FROM part) AS p""",
    "customer_base": f"""
      SELECT {_id('CUS', 'c_custkey')} AS customer_id,
             (SELECT w_start FROM window_bounds) - cast(1 + (c_custkey * 31) % 900 AS int)
               AS signup_date,
             cast(1 + (c_custkey * 31) % 900 AS int) AS tenure_days_at_window_start,
             'GEO_' || {_padded('c_nationkey', 4)} AS home_geography_id,
             {_case('c_custkey % 5', ('18-24', '25-34', '35-44', '45-54', '55+'))} AS age_bucket,
             {_case('c_custkey % 4', ('ORGANIC', 'PAID_SOCIAL', 'PAID_SEARCH', 'REFERRAL'))}
               AS acquisition_channel,
             (c_custkey * 7) % 3 = 0 AS has_saved_prepaid_instrument,
             cast(c_custkey % 12 AS int) AS pre_window_orders,
             cast(c_custkey % 12 - floor((c_custkey % 12) * 0.25)
                  - CASE WHEN c_custkey % 12 >= 8 THEN 1 ELSE 0 END AS int)
               AS pre_window_delivered,
             cast(floor((c_custkey % 12) * 0.25) AS int) AS pre_window_rto_count,
             cast(floor((c_custkey % 12) * 0.6) AS int) AS pre_window_cod_orders,
             cast(c_custkey % 12 - floor((c_custkey % 12) * 0.6) AS int)
               AS pre_window_prepaid_success,
             cast(least(c_custkey % 12 - floor((c_custkey % 12) * 0.6), c_custkey % 3) AS int)
               AS pre_window_payment_failures
      FROM customer""",
    "order_lines": """
      SELECT l_orderkey, min_by(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS lpk,
             min_by(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS lsk, count(*) AS n_lines
      FROM lineitem GROUP BY l_orderkey""",
    "order_base": f"""
      SELECT k, ck, n_nationkey, ti, order_date, order_ts, pk, sk, n_lines, gmv, discount_pct,
             method, is_cancelled, resolve_date,
             NOT is_cancelled AND resolve_date > (SELECT w_end FROM window_bounds) AS is_censored,
             (o_orderstatus = 'F' AND method = 'COD') OR k % 11 = 0 AS would_return,
             method = 'COD' AND k % 16 = 3 AS switched,
             cast(2 + ti + k % 4 AS int) AS promise_days,
             {_SHRUNK_PRE} AS shrunk_pre
      FROM (SELECT o_orderkey AS k, o_custkey AS ck, c_nationkey AS n_nationkey,
                   n_regionkey % 4 AS ti, cast(o_orderdate AS date) AS order_date,
                   cast(o_orderdate AS date)
                     + cast(4 + (o_orderkey * 7) % 22 AS int) AS resolve_date,
                   o_orderdate + ((o_orderkey * 37) % 86400) * INTERVAL '1' SECOND AS order_ts,
                   coalesce(lpk, o_orderkey % (SELECT count(*) FROM part)) AS pk,
                   coalesce(lsk, o_orderkey % (SELECT count(*) FROM supplier)) AS sk,
                   coalesce(n_lines, 1) AS n_lines,
                   cast(cast(o_totalprice AS decimal(12,2)) * 0.01 AS decimal(10,2)) AS gmv,
                   cast((o_orderkey % 20) * 0.01 AS decimal(5,4)) AS discount_pct,
                   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED')
                        THEN 'COD' ELSE 'PREPAID' END AS method,
                   o_orderstatus, o_orderkey % 25 = 0 AS is_cancelled
            FROM orders
            JOIN customer ON c_custkey = o_custkey
            JOIN nation ON n_nationkey = c_nationkey
            LEFT JOIN order_lines ON l_orderkey = o_orderkey) AS b""",
    "user_days": """
      SELECT user_id, cast(ts AS date) AS day, date_trunc('second', min(ts)) AS ts,
             count(*) AS n, sum(cast(value AS decimal(12,2))) AS amount,
             sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks,
             sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS signups,
             sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases,
             sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors,
             min_by(try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS bigint), (ts, event_id))
               AS looked_at
      FROM events GROUP BY user_id, cast(ts AS date)""",
    "fct_checkout_session": f"""
      SELECT 'SES_O' || {_padded('k', 12)} AS session_id,
             {_id('CUS', 'ck')} AS customer_id, order_ts AS session_start_ts,
             order_date AS date_id, {_case('k % 3', ('ANDROID', 'IOS', 'WEB'))} AS device_type,
             {_id('PRD', 'pk')} AS candidate_product_id,
             cast(least(5, n_lines) AS smallint) AS cart_size, gmv AS cart_value,
             'GEO_' || {_padded('n_nationkey', 4)} AS delivery_geography_id,
             cast(promise_days AS smallint) AS estimated_delivery_days,
             cast((40 + (k * 17) % 61) * 0.01 AS decimal(4,3)) AS address_completeness_score,
             true AS checkout_started, true AS address_completed, true AS payment_page_reached,
             CASE WHEN switched THEN 'PREPAID' ELSE method END AS intended_payment_method,
             method AS final_payment_method, switched AS switched_to_cod_after_failure,
             cast(CASE WHEN switched THEN 1 + k % 2
                       WHEN method = 'PREPAID' AND k % 9 = 0 THEN 2
                       WHEN method = 'PREPAID' THEN 1 ELSE 0 END AS smallint)
               AS payment_attempt_count,
             false AS checkout_abandoned, cast(NULL AS string) AS abandon_step,
             {_id('ORD', 'k')} AS order_id
      FROM order_base
      UNION ALL
      SELECT 'SES_E' || {_padded('user_id', 10)} || '_' || cast(day AS string),
             {_id('CUS', 'user_id')}, ts, day,
             {_case('user_id % 3', ('ANDROID', 'IOS', 'WEB'))},
             {_id('PRD', 'coalesce(looked_at, 0)')}, cast(least(5, n) AS smallint),
             cast(amount AS decimal(10,2)),
             'GEO_' || {_padded('c_nationkey', 4)},
             cast(2 + n_regionkey % 4 + n % 4 AS smallint),
             cast((40 + (user_id * 17 + n * 7) % 61) * 0.01 AS decimal(4,3)), true,
             clicks + signups + errors + purchases > 0, errors + purchases > 0,
             CASE WHEN errors + purchases > 0 THEN 'PREPAID' END,
             CASE WHEN purchases > 0 THEN 'PREPAID' END, false,
             cast(CASE WHEN errors > 1 OR (errors = 1 AND purchases > 0) THEN 2
                       WHEN errors + purchases > 0 THEN 1 ELSE 0 END AS smallint),
             purchases = 0,
             CASE WHEN purchases > 0 THEN NULL WHEN errors > 0 THEN 'PAYMENT_FAILURE'
                  WHEN clicks > 0 OR signups > 0 THEN 'PAYMENT_PAGE' ELSE 'ADDRESS' END,
             CASE WHEN purchases > 0
                  THEN 'ORD_E' || {_padded('user_id', 10)} || '_' || cast(day AS string) END
      FROM user_days
      JOIN customer ON c_custkey = user_id
      JOIN nation ON n_nationkey = c_nationkey""",
    "order_outcome": f"""
      SELECT *, NOT is_cancelled AS is_shipped, NOT is_cancelled AND NOT is_censored AS observable,
             NOT is_cancelled AND NOT is_censored AND would_return AS returned,
             cast(gmv * discount_pct AS decimal(10,2)) AS discount_amount,
             CASE WHEN k % 10 = 3 AND method <> 'COD' THEN 'OTHER_UNCLASSIFIED'
                  ELSE {_case('k % 10', P.REASONS)} END AS reason,
             CASE WHEN shrunk_pre >= {P.HIGH_RTO_SHRUNK} THEN 2
                  WHEN shrunk_pre >= {P.MED_RTO_SHRUNK} OR ck % 12 = 0 THEN 1 ELSE 0 END AS m1_rank
      FROM order_base""",
    "fct_order": f"""
      SELECT {_id('ORD', 'k')} AS order_id,
             'SES_O' || {_padded('k', 12)} AS session_id,
             {_id('CUS', 'ck')} AS customer_id, {_id('PRD', 'pk')} AS product_id,
             {_id('SEL', 'sk')} AS seller_id,
             'GEO_' || {_padded('n_nationkey', 4)} AS delivery_geography_id,
             order_ts, order_date, cast(least(3, n_lines) AS smallint) AS quantity, gmv,
             discount_amount, discount_pct, cast(gmv - discount_amount AS decimal(10,2))
               AS order_value,
             cast({P.SHIPPING_FEE} AS decimal(6,2)) AS shipping_fee_charged,
             cast({P.COD_FEE} AS decimal(6,2)) AS cod_fee_charged, method AS payment_method,
             CASE WHEN method = 'PREPAID' THEN {_case('k % 5', P.PAYMENT_RAILS)} END
               AS payment_rail,
             switched AS paid_via_switch, cast(promise_days AS smallint)
               AS estimated_delivery_days,
             order_date + promise_days AS promised_delivery_date,
             {_case("least(2, m1_rank + CASE WHEN method = 'COD' THEN 1 ELSE 0 END)",
                    P.RISK_TIERS)} AS order_risk_tier_rule_based,
             CASE WHEN is_cancelled THEN 'CANCELLED_PRESHIP' WHEN is_censored THEN 'SHIPPED'
                  WHEN returned THEN 'RTO' ELSE 'DELIVERED' END AS order_status,
             is_cancelled AS is_cancelled_preship,
             CASE WHEN is_cancelled
                  THEN {_case('(k * 7) % 3', ('CUSTOMER', 'SELLER', 'SYSTEM'))} END
               AS cancel_actor,
             is_shipped, is_censored,
             cast(CASE WHEN observable THEN 4 + (k * 7) % 22 END AS smallint)
               AS actual_delivery_days,
             cast(CASE WHEN observable AND NOT returned
                       THEN 4 + (k * 7) % 22 - promise_days END AS smallint)
               AS delivery_delay_days,
             cast(CASE WHEN returned THEN 3 WHEN observable THEN 1 END AS smallint)
               AS delivery_attempts,
             CASE WHEN observable THEN NOT returned END AS is_delivered,
             CASE WHEN observable THEN returned END AS rto_flag,
             CASE WHEN returned THEN reason END AS rto_reason,
             CASE WHEN returned
                  THEN {_lookup('reason', {k: repr(v[1]) for k, v in P.REASONS.items()})} END
               AS rto_reason_class,
             CASE WHEN observable THEN resolve_date END AS outcome_resolved_date
      FROM order_outcome""",
    "order_fulfilment": f"""
      SELECT {_id('ORD', 'k')} AS order_id, cast(1 + k % 3 AS int) AS dispatch_lag_days,
             cast((k * 11) % 7 - 2 + CASE WHEN returned THEN 2 ELSE 0 END AS int)
               AS attempt_delay_days,
             CASE WHEN returned
                  THEN {_lookup('reason', {k: repr(v[2]) for k, v in P.REASONS.items()})} END
               AS ndr_code,
             {_case('n_nationkey % 5', P.COURIERS)} AS courier_partner
      FROM order_outcome""",
    "truth_customer_latent": f"""
      SELECT {_id('CUS', 'c_custkey')} AS customer_id,
             cast(((c_custkey * 13) % 401 - 200) * 0.01 AS decimal(6,4)) AS latent_trust,
             cast(((c_custkey * 29) % 401 - 200) * 0.01 AS decimal(6,4)) AS latent_liquidity,
             cast(((c_custkey * 47) % 401 - 200) * 0.01 AS decimal(6,4)) AS latent_intent,
             cast(((c_custkey * 59) % 401 - 200) * 0.01 AS decimal(6,4))
               AS latent_price_sensitivity,
             cast((20 + 5 * (c_custkey % 12) + (c_custkey * 3) % 20) * 0.01 AS decimal(5,4))
               AS true_cod_propensity
      FROM customer""",
    "calendar_bounds": """
      SELECT least(w_start, e_start) AS c_start, greatest(w_end, e_end) AS c_end
      FROM window_bounds
      JOIN (SELECT min(cast(ts AS date)) AS e_start, max(cast(ts AS date)) AS e_end
            FROM events) AS e ON true""",
}


class DriverModel(Mapping):
    """Lazy mapping from canonical table name to DataFrame over ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        tune(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}
        self._kept: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        from ..schemas import COLUMNS
        return iter(COLUMNS)

    def __len__(self) -> int:
        from ..schemas import COLUMNS
        return len(COLUMNS)

    def _materialise(self, name: str) -> None:
        """Write ``name`` once for this model; tables derived from it are rebuilt on it.

        The state needs orders and sessions several times over, and the join and the sums
        behind them should run once. Operators that read the state ask for it before any
        other table, so that those are built on the written ones too.
        """
        if name not in self._kept:
            self._built = {t: df for t, df in self._built.items() if t in RAW or t in self._kept}
            self._built[name] = keep(self[name])
            self._kept.add(name)

    def release(self) -> None:
        """Delete the written tables, once all that reads them has run; one asked for again is made again."""
        for name in self._kept:
            forget(self._built[name])
        self._built = {t: df for t, df in self._built.items() if t in RAW}
        self._kept = set()

    def _build(self, name: str) -> DataFrame:
        from ..operators import calendar, economics, events, pit, rollup, traces
        if name in RAW:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(df) if name in ("orders", "lineitem", "events") else df
        if name in SQL:
            text = SQL[name]
            used = {t: self[t] for t in (*RAW, *SQL) if t != name and _mentions(text, t)}
            if name == "order_lines":
                # dealt by the key first, the lines are sorted for their struct once, not on both sides
                used["lineitem"] = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet").select(
                    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
            for table in used:
                text = _brace(text, table)
            df = self.spark.sql(text, **used)
        elif name == "dim_date":
            df = calendar.calendar(self["calendar_bounds"])
        elif name == "dim_customer":
            df = rollup.customer_rollup(self["customer_base"], self["fct_order"],
                                        self["fct_order_economics"])
        elif name == "fct_customer_state_at_session":
            self._materialise("order_base")
            self._materialise("user_days")
            df = pit.state_at_session(self["fct_checkout_session"], self["customer_base"],
                                      self["fct_order"])
            # sums of a second are dealt by customer-day, and sessions may meet them there
            with session_settings(self.spark, {"spark.sql.requireAllClusterKeysForCoPartition": False}):
                df = self._built[name] = keep(df)
            self._kept.add(name)
        elif name == "fct_order_economics":
            df = economics.order_economics(self["fct_order"], self["dim_product"],
                                           self["dim_geography"])
        elif name == "fct_checkout_event":
            df = events.checkout_events(self["session_activity"])
        elif name == "session_activity":
            df = events.session_activity(self["fct_checkout_session"])
        elif name == "fct_payment_attempt":
            df = events.payment_attempts(self["session_activity"])
        elif name == "fct_delivery_event":
            df = events.delivery_events(self["fct_order"], self["order_fulfilment"])
        elif name == "truth_order_probability":
            df = traces.session_probabilities(self)
        else:
            raise KeyError(name)
        return df


def _pattern(table: str):
    import re
    return re.compile(rf"(?<=FROM |JOIN ){table}\b")


def _mentions(text: str, table: str) -> bool:
    return _pattern(table).search(" ".join(text.split())) is not None


def _brace(text: str, table: str) -> str:
    return _pattern(table).sub("{" + table + "}", " ".join(text.split()))


def canonical_ctes() -> dict[str, str]:
    """The SQL texts, for use as DuckDB common table expressions."""
    return dict(SQL)


def conformed(model: Mapping, name: str) -> DataFrame:
    """``name`` cast to its declared schema."""
    from .tables import conform
    return conform(model[name], schema(name))
