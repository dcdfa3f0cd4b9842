"""Customer state as it was known at the start of each checkout session.

Two clocks apply. A placement (and a payment result) counts once its timestamp is
strictly earlier than the session, at second precision; an outcome counts once its
resolution *day* is strictly earlier than the session's day.

A customer may own a large share of all rows, so no window ever spans a customer's raw
rows. Events are dealt by customer-day and summed per (customer, second) there, and the
seconds once more per (customer, day); running sums then go over a customer's days
(bounded by the calendar) and over the seconds of one customer-day (at most 86,400).
Seeds join the days of a customer, so they travel with the opening sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import flag, half_even_mean, raw_rate, rule_tier_m1, shrunk_rate
INSTANT = ("placed", "cod", "value_cents", "success", "failure")
RESOLUTION = ("resolved", "rto", "delivered")


def _zeros(*names: str) -> list[Column]:
    return [F.lit(0).cast("long").alias(n) for n in names]


def _second(col: str) -> Column:
    return F.date_trunc("second", F.col(col).cast("timestamp")).cast("timestamp_ntz").alias("ts")


def failed_first_attempt() -> Column:
    """Session flag: the first prepaid attempt failed."""
    return ((F.col("payment_attempt_count") > 0)
            & ((F.col("payment_attempt_count") > 1) | F.col("switched_to_cod_after_failure")
               | F.coalesce(F.col("abandon_step") == "PAYMENT_FAILURE", F.lit(False))))


def session_keys(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "customer_id", _second("session_start_ts"),
                           F.col("date_id").alias("day"))


def moment_rows(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Placements and payment results, one row each; values in cents, exact in a long."""
    paid = F.coalesce(F.col("final_payment_method") == "PREPAID", F.lit(False))
    per_session = sessions.select(
        "customer_id", F.col("date_id").alias("day"), _second("session_start_ts"),
        *_zeros("placed", "cod", "value_cents"), paid.cast("long").alias("success"),
        failed_first_attempt().cast("long").alias("failure"))
    placements = orders.select(
        "customer_id", F.col("order_ts").cast("date").alias("day"), _second("order_ts"),
        F.lit(1).cast("long").alias("placed"),
        (F.col("payment_method") == "COD").cast("long").alias("cod"),
        (F.col("order_value").cast("decimal(18,2)") * 100).cast("long").alias("value_cents"),
        *_zeros("success", "failure"))
    return per_session.unionByName(placements)


def instants(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Placements and payment results summed per customer and second."""
    return _sum_instants(moment_rows(sessions, orders))


def _sum_instants(df: DataFrame) -> DataFrame:
    return df.groupBy("customer_id", "day", "ts").agg(*[F.sum(c).alias(c) for c in INSTANT])


def resolutions(orders: DataFrame) -> DataFrame:
    """Outcomes summed per customer and the first day on which they may be known."""
    return (orders.where(F.col("outcome_resolved_date").isNotNull())
            .select("customer_id", F.date_add("outcome_resolved_date", 1).alias("day"),
                    flag("rto_flag").cast("long").alias("rto"),
                    flag("is_delivered").cast("long").alias("delivered"))
            .groupBy("customer_id", "day")
            .agg(F.count(F.lit(1)).alias("resolved"), F.sum("rto").alias("rto"),
                 F.sum("delivered").alias("delivered")))


def counters(keys: DataFrame, moments: DataFrame, outcomes: DataFrame,
             carried: DataFrame | None = None) -> DataFrame:
    """Running counters at each key of :func:`session_keys`.

    ``moments`` must hold a row (zeros will do) for every key's customer and second. Columns of
    ``carried`` (one row a customer) come along; keys of customers without a row in it are left out.
    """
    placed_day = F.when(F.col("placed") > 0, F.col("day"))
    days = moments.groupBy("customer_id", "day").agg(
        *[F.sum(c).alias(c) for c in INSTANT], F.max(placed_day).alias("order_day"))
    days = days.select("customer_id", "day", *INSTANT, *_zeros(*RESOLUTION), "order_day",
                       F.lit(True).alias("asked"))
    days = days.unionByName(outcomes.select(
        "customer_id", "day", *_zeros(*INSTANT), *RESOLUTION,
        F.lit(None).cast("date").alias("order_day"), F.lit(False).alias("asked")))
    # dealt by customer at once, for the sums of a day and the windows alike
    days = days.repartition("customer_id").groupBy("customer_id", "day").agg(
        *[F.sum(c).alias(c) for c in (*INSTANT, *RESOLUTION)],
        F.max("order_day").alias("order_day"), F.bool_or("asked").alias("asked"))

    over_days = Window.partitionBy("customer_id").orderBy("day")
    before = over_days.rowsBetween(Window.unboundedPreceding, -1)
    upto = over_days.rowsBetween(Window.unboundedPreceding, 0)
    opening = days.select(
        "customer_id", "day", "asked",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"open_{c}") for c in INSTANT],
        *[F.sum(c).over(upto).alias(f"in_{c}") for c in RESOLUTION],
        F.max("order_day").over(before).alias("open_order_day"))
    # days of outcomes alone have been summed and need not travel on
    opening = opening.where("asked").drop("asked")
    extra = []
    if carried is not None:
        extra = [c for c in carried.columns if c != "customer_id"]
        opening = opening.join(carried, "customer_id")

    within = (Window.partitionBy("customer_id", "day").orderBy("ts")
              .rowsBetween(Window.unboundedPreceding, -1))
    same_day = moments.select(
        "customer_id", "day", "ts",
        *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"day_{c}") for c in INSTANT])
    total = {c: F.col(f"open_{c}") + F.col(f"day_{c}") for c in INSTANT}
    cents = total.pop("value_cents").cast("decimal(20,0)")
    state = same_day.join(opening, ["customer_id", "day"]).select(
        "customer_id", "day", "ts", *[v.alias(f"in_{c}") for c, v in total.items()],
        (cents * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(38,2)").alias("in_value_sum"),
        *[f"in_{c}" for c in RESOLUTION],
        F.when(F.col("day_placed") > 0, F.col("day")).otherwise(F.col("open_order_day"))
        .alias("last_order_day"), *extra)
    return keys.join(state, ["customer_id", "day", "ts"])


def counters_at_session(sessions: DataFrame, orders: DataFrame,
                        carried: DataFrame | None = None) -> DataFrame:
    """In-window running counters per session id (pre-window seeds not added)."""
    # read by the day totals and by the seconds of each day, which share this one shuffle as long as
    # the joins to come have no nulls to filter; a row without a second stays first of its day
    first = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    rows = moment_rows(sessions, orders).where("customer_id IS NOT NULL AND day IS NOT NULL")
    moments = _sum_instants(rows.withColumn("ts", F.coalesce("ts", first)).repartition("customer_id", "day"))
    return counters(session_keys(sessions), moments, resolutions(orders), carried)


def state_at_session(sessions: DataFrame, customers: DataFrame, orders: DataFrame) -> DataFrame:
    """The ``pit_*`` columns, one row per session."""
    seeds = customers.select("customer_id", "signup_date",
                             *[c for c in customers.columns if c.startswith("pre_window_")])
    s = counters_at_session(sessions, orders, seeds)
    count = lambda pre, inner: (F.col(pre) + F.col(inner)).cast("int")
    s = s.select(
        "session_id", "customer_id", "day", "signup_date", "last_order_day", "in_placed",
        "in_value_sum",
        count("pre_window_orders", "in_placed").alias("pit_orders_placed"),
        count("pre_window_delivered", "in_delivered").alias("pit_orders_delivered"),
        (F.col("pre_window_delivered") + F.col("pre_window_rto_count") + F.col("in_resolved"))
        .cast("int").alias("pit_orders_resolved"),
        count("pre_window_rto_count", "in_rto").alias("pit_rto_count"),
        count("pre_window_cod_orders", "in_cod").alias("pit_cod_orders"),
        count("pre_window_prepaid_success", "in_success").alias("pit_prepaid_success_count"),
        count("pre_window_payment_failures", "in_failure").alias("pit_payment_failure_count"))
    placed, resolved = F.col("pit_orders_placed"), F.col("pit_orders_resolved")
    attempts = F.col("pit_prepaid_success_count") + F.col("pit_payment_failure_count")
    s = s.withColumns({
        "pit_rto_rate_shrunk": F.bround(shrunk_rate("pit_rto_count", resolved), 4),
        "pit_is_new_customer": F.col("pit_orders_delivered") == 0})
    dec4 = "decimal(5,4)"
    return s.select(
        "session_id", "customer_id", F.date_diff("day", "signup_date").alias("pit_tenure_days"),
        "pit_orders_placed", "pit_orders_delivered", "pit_orders_resolved", "pit_rto_count",
        raw_rate("pit_rto_count", resolved).cast(dec4).alias("pit_rto_rate_raw"),
        F.col("pit_rto_rate_shrunk").cast(dec4).alias("pit_rto_rate_shrunk"), "pit_cod_orders",
        raw_rate("pit_cod_orders", placed).cast(dec4).alias("pit_cod_share"),
        "pit_prepaid_success_count", "pit_payment_failure_count",
        raw_rate("pit_payment_failure_count", attempts).cast(dec4)
        .alias("pit_payment_failure_rate"),
        F.date_diff("day", "last_order_day").alias("pit_days_since_last_order"),
        half_even_mean("in_value_sum", "in_placed").alias("pit_avg_order_value"),
        (placed > 0).alias("pit_has_history"), "pit_is_new_customer",
        ((F.col("pit_orders_delivered") >= 3) & (F.col("pit_rto_count") == 0))
        .alias("pit_has_clean_record"),
        rule_tier_m1("pit_rto_rate_shrunk", "pit_is_new_customer")
        .alias("pit_risk_tier_rule_based"))


def same_day_occurrence(sessions: DataFrame) -> DataFrame:
    """Rank of each session among the customer's sessions of the same day."""
    w = Window.partitionBy("date_id", "customer_id").orderBy("session_start_ts", "session_id")
    return sessions.select("session_id", "customer_id", "date_id",
                           F.row_number().over(w).alias("occurrence"))
