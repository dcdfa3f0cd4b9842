"""State-to-log projections and funnel-state resolution.

Every projection builds the entity's short event list inside its own row (an array that
is filtered, ordered and numbered in place) and explodes it once, so no shuffle or window
is needed to number events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag
from .pit import failed_first_attempt

# ---- fixed values: seconds after session start per step -----------------------------
STEP_OFFSETS = {"CHECKOUT_STARTED": 0, "ADDRESS_COMPLETED": 30, "PAYMENT_PAGE_REACHED": 60,
                "FEE_DISPLAYED": 65, "METHOD_SELECTED": 75, "PAYMENT_ATTEMPTED": 105,
                "METHOD_SWITCHED": 150, "ORDER_PLACED": 180, "ABANDONED": 200}
ATTEMPT_OFFSETS = {1: 45, 2: 120}
ATTEMPT_GAP_DAYS, RTO_INITIATION_DAYS, MAX_ATTEMPTS = 2, 2, 3


def _seconds(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def _numbered(events: Column) -> Column:
    """Keep the wanted steps and number them from 1 in array order."""
    kept = F.filter(events, lambda e: e["keep"])
    return F.transform(kept, lambda e, i: e.withField("seq", (i + 1).cast("short")))


def session_activity(sessions: DataFrame) -> DataFrame:
    """Sessions plus payment detail: outcome masks, rail and the drawn failure reason.

    The reference draws rail and reason at random; here they are inputs, taken from the
    session itself when the source does not carry them.
    """
    pick = lambda values, salt: F.element_at(
        F.array(*[F.lit(v) for v in values]),
        (F.pmod(F.crc32(F.concat("session_id", F.lit(salt)).cast("binary")),
                F.lit(len(values))) + 1).cast("int"))
    attempts = F.col("payment_attempt_count")
    failed = failed_first_attempt()
    paid = F.coalesce(F.col("final_payment_method") == "PREPAID", F.lit(False))
    return sessions.withColumns({
        "attempted_rail": F.when(attempts > 0, pick(P.PAYMENT_RAILS, "rail")),
        "payment_rail": F.when(paid, pick(P.PAYMENT_RAILS, "rail")),
        "failure_reason": F.when(failed, pick(P.FAILURE_REASONS, "why")),
        "failed_first": failed, "retried": failed & (attempts >= 2),
        "succeeded_second": failed & (attempts >= 2) & paid,
        "switched_rail": F.lit(False),
        "pay_abandoned": F.coalesce(F.col("abandon_step") == "PAYMENT_FAILURE", F.lit(False))})


def checkout_events(activity: DataFrame) -> DataFrame:
    """Up to nine checkout steps per session at fixed offsets, with JSON detail."""
    page, gone = F.col("payment_page_reached"), F.col("checkout_abandoned")
    keep = {"CHECKOUT_STARTED": F.lit(True), "ADDRESS_COMPLETED": F.col("address_completed"),
            "PAYMENT_PAGE_REACHED": page, "FEE_DISPLAYED": page, "METHOD_SELECTED": page,
            "PAYMENT_ATTEMPTED": F.col("payment_attempt_count") > 0,
            "METHOD_SWITCHED": F.col("switched_to_cod_after_failure"),
            "ORDER_PLACED": ~gone, "ABANDONED": gone}
    json = lambda key, col: F.to_json(F.struct(F.col(col).alias(key)),
                                      {"ignoreNullFields": "false"})
    detail = {"METHOD_SELECTED": json("method", "final_payment_method"),
              "PAYMENT_ATTEMPTED": json("rail", "payment_rail")}
    steps = F.array(*[
        F.struct(keep[name].alias("keep"), F.lit(name).alias("name"), F.lit(at).alias("at"),
                 detail.get(name, F.lit(None).cast("string")).alias("detail"))
        for name, at in STEP_OFFSETS.items()])
    rows = activity.select("session_id", "session_start_ts", F.explode(_numbered(steps)).alias("e"))
    return rows.select(
        F.xxhash64("session_id", "e.seq").alias("event_id"), "session_id",
        F.col("e.seq").alias("event_seq"),
        (F.col("session_start_ts") + _seconds(F.col("e.at"))).alias("event_ts"),
        F.col("e.name").alias("event_name"), F.col("e.detail").alias("event_detail"),
        F.col("e.at").alias("seconds_since_session_start"))


def payment_attempts(activity: DataFrame) -> DataFrame:
    """Attempt rows (first try, optional retry) with what the customer did after a failure.

    A rail switch raises the session's attempt counter but has no row of its own.
    """
    failed, retried = F.col("failed_first"), F.col("retried")
    ok2 = F.col("succeeded_second")
    end = (F.when(F.col("switched_rail"), "SWITCH_RAIL")
           .when(F.col("switched_to_cod_after_failure"), "SWITCH_TO_COD").otherwise("ABANDON"))
    tries = F.array(
        F.struct((F.col("payment_attempt_count") > 0).alias("keep"), (~failed).alias("ok"),
                 F.lit(ATTEMPT_OFFSETS[1]).alias("at"),
                 F.when(failed, F.when(retried, "RETRY_SAME").otherwise(end)).alias("then")),
        F.struct(retried.alias("keep"), ok2.alias("ok"), F.lit(ATTEMPT_OFFSETS[2]).alias("at"),
                 F.when(retried & ~ok2, end).alias("then")))
    rows = activity.select("session_id", "session_start_ts", "attempted_rail", "cart_value",
                           "failure_reason", F.explode(_numbered(tries)).alias("a"))
    return rows.select(
        F.xxhash64("session_id", "a.seq").alias("payment_attempt_id"), "session_id",
        F.col("a.seq").alias("attempt_seq"), F.col("attempted_rail").alias("payment_rail"),
        (F.col("session_start_ts") + _seconds(F.col("a.at"))).alias("attempt_ts"),
        F.col("cart_value").alias("attempt_amount"), F.col("a.ok").alias("payment_success"),
        F.when(~F.col("a.ok"), F.col("failure_reason")).alias("failure_reason"),
        (F.col("a.seq") > 1).alias("is_retry"), F.col("a.then").alias("post_failure_action"))


def delivery_events(orders: DataFrame, fulfilment: DataFrame) -> DataFrame:
    """The four delivery paths: cancelled, in transit, delivered, returned.

    Steps are ordered by their day offset; the listed order breaks ties.
    """
    o = orders.join(fulfilment, "order_id")
    observable = F.col("is_shipped") & ~F.col("is_censored")
    delivered, rto = observable & flag("is_delivered"), observable & flag("rto_flag")
    first = (F.col("estimated_delivery_days") + F.col("attempt_delay_days")).cast("double")
    end = F.col("actual_delivery_days").cast("double")
    lag = F.col("dispatch_lag_days").cast("double")
    delay = F.col("attempt_delay_days").cast("short")
    none = F.lit(None).cast("short")

    def step(rank, name, keep, day, attempt=None, with_delay=False, with_ndr=False):
        return F.struct(
            day.alias("day"), F.lit(rank).alias("rank"), keep.alias("keep"),
            F.lit(name).alias("name"),
            (none if attempt is None else F.lit(attempt).cast("short")).alias("attempt"),
            (delay if with_delay else none).alias("delay"),
            (F.col("ndr_code") if with_ndr else F.lit(None).cast("string")).alias("ndr"))

    steps = [step(0, "ORDER_PLACED", F.lit(True), F.lit(0.0)),
             step(1, "CANCELLED_PRESHIP", F.col("is_cancelled_preship"), F.least(lag, F.lit(1.0))),
             step(2, "DISPATCHED", F.col("is_shipped"), lag),
             step(3, "DELIVERED", delivered, end, 1, True)]
    for n in range(1, MAX_ATTEMPTS + 1):
        steps.append(step(3 + n, "DELIVERY_ATTEMPT_FAILED", rto,
                          first + ATTEMPT_GAP_DAYS * (n - 1), n, True, True))
    steps.append(step(7, "RTO_INITIATED", rto,
                      first + ATTEMPT_GAP_DAYS * (MAX_ATTEMPTS - 1) + RTO_INITIATION_DAYS))
    steps.append(step(8, "RTO_RECEIVED", rto, end))
    ordered = F.array_sort(F.filter(F.array(*steps), lambda e: e["keep"]))
    numbered = F.transform(ordered, lambda e, i: e.withField("seq", (i + 1).cast("short")))
    rows = o.select("order_id", "order_ts", "courier_partner", F.explode(numbered).alias("e"))
    return rows.select(
        F.xxhash64("order_id", "e.seq").alias("delivery_event_id"), "order_id",
        F.col("e.seq").alias("event_seq"),
        (F.col("order_ts") + _seconds(F.col("e.day") * 86400)).alias("event_ts"),
        F.col("e.name").alias("event_name"), F.col("e.attempt").alias("attempt_number"),
        F.col("e.delay").alias("attempt_delay_days"), F.col("e.ndr").alias("ndr_code"),
        "courier_partner")


def fee_is_dominant(contributions: dict[str, Column], fee_term: str,
                    fee: float | Column) -> Column:
    """Is the fee term the most negative additive contribution?"""
    fee = F.lit(fee) if not isinstance(fee, Column) else fee
    if fee_term not in contributions:
        return F.lit(False)
    mine = contributions[fee_term]
    others = [F.least(c, F.lit(0.0)) for t, c in contributions.items() if t != fee_term]
    floor = F.least(*others) if len(others) > 1 else (others[0] if others else F.lit(0.0))
    return (fee > 0) & (mine < 0) & (mine <= floor)


def resolve_funnel(hurdles: DataFrame, fee_dominant: Column | None = None) -> DataFrame:
    """Final session state from hurdle outcomes.

    Input columns: ``session_id, cleared_address, reached_payment, cod_intent,
    pay_succeeded, pay_switched, pay_abandoned, attempt_count, rail``. A payment failure
    outranks every inferred step; the fee step outranks the payment page.
    """
    fee = F.lit(False) if fee_dominant is None else fee_dominant
    reached, cod = F.col("reached_payment"), F.col("cod_intent")
    method = (F.when(F.col("pay_switched"), "COD").when(F.col("pay_succeeded"), "PREPAID")
              .when(reached & cod, "COD"))
    step = (F.when(F.col("pay_abandoned"), "PAYMENT_FAILURE")
            .when(~F.col("cleared_address"), "ADDRESS")
            .when(~reached, F.when(fee, "FEE_REVEAL").otherwise("PAYMENT_PAGE")))
    return hurdles.select(
        "session_id", F.col("cleared_address").alias("address_completed"),
        reached.alias("payment_page_reached"),
        F.when(reached, F.when(cod, "COD").otherwise("PREPAID")).alias("intended_payment_method"),
        method.alias("final_payment_method"),
        F.when(F.col("pay_succeeded"), F.col("rail")).alias("payment_rail"),
        F.col("pay_switched").alias("switched_to_cod_after_failure"),
        F.col("attempt_count").cast("short").alias("payment_attempt_count"),
        method.isNull().alias("checkout_abandoned"), step.alias("abandon_step"))


def funnel_from_events(events: DataFrame) -> DataFrame:
    """Session funnel flags recovered from the checkout event log alone."""
    seen = lambda name: F.bool_or(F.col("event_name") == name)
    method = F.get_json_object("event_detail", "$.method")
    return events.groupBy("session_id").agg(
        seen("ADDRESS_COMPLETED").alias("address_completed"),
        seen("PAYMENT_PAGE_REACHED").alias("payment_page_reached"),
        seen("PAYMENT_ATTEMPTED").alias("payment_attempted"),
        seen("METHOD_SWITCHED").alias("switched_to_cod_after_failure"),
        seen("ABANDONED").alias("checkout_abandoned"),
        F.max(F.when(F.col("event_name") == "METHOD_SELECTED", method))
        .alias("final_payment_method"), F.count(F.lit(1)).alias("events")).withColumn(
        "abandon_step",
        F.when(~F.col("checkout_abandoned"), None)
        .when(F.col("payment_attempted"), "PAYMENT_FAILURE")
        .when(~F.col("address_completed"), "ADDRESS")
        .when(~F.col("payment_page_reached"), "PAYMENT_PAGE").otherwise("PAYMENT_FAILURE"))


def order_status(outcomes: DataFrame) -> DataFrame:
    """Status and dates from fulfilment outcomes.

    Input columns: ``order_id, order_date, estimated_delivery_days, is_shipped, is_censored,
    is_cancelled, returned, days_to_resolve``.
    """
    observable = F.col("is_shipped") & ~F.col("is_censored")
    back, days = F.col("returned"), F.col("days_to_resolve")
    return outcomes.select(
        "order_id",
        F.date_add("order_date", F.col("estimated_delivery_days").cast("int"))
        .alias("promised_delivery_date"),
        F.when(F.col("is_cancelled"), "CANCELLED_PRESHIP").when(~observable, "SHIPPED")
        .when(back, "RTO").otherwise("DELIVERED").alias("order_status"),
        F.when(observable, back).alias("rto_flag"),
        F.when(observable, ~back).alias("is_delivered"),
        F.when(observable, days).cast("short").alias("actual_delivery_days"),
        F.when(observable & ~back, days - F.col("estimated_delivery_days")).cast("short")
        .alias("delivery_delay_days"),
        F.when(observable, F.date_add("order_date", days.cast("int")))
        .alias("outcome_resolved_date"))


def probability_table(scores: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Session probability table with optional sampled traces.

    ``scores`` holds ``session_id, p_convert, p_cod_intent, p_rto_precheckout, p_rto_final,
    post_dispatch_shock``; ``traces`` holds ``session_id, logit_cod_components,
    logit_rto_components``. A trace of an unknown session fails the job.
    """
    rounded = scores.select(
        "session_id", *[F.bround(c, 5).cast("decimal(6,5)").alias(c)
                        for c in ("p_convert", "p_cod_intent", "p_rto_precheckout",
                                  "p_rto_final")],
        F.bround("post_dispatch_shock", 4).cast("decimal(6,4)").alias("post_dispatch_shock"))
    if traces is None:
        out = rounded.withColumns({"logit_cod_components": F.lit(None).cast("string"),
                                   "logit_rto_components": F.lit(None).cast("string"),
                                   "components_populated": F.lit(False)})
    else:
        side = traces.select("session_id", "logit_cod_components", "logit_rto_components",
                             F.lit(True).alias("_traced"))
        known = rounded.withColumn("_known", F.lit(True))
        joined = known.join(side, "session_id", "full_outer")
        guard = F.when(F.col("_known").isNull(),
                       F.raise_error(F.concat(F.lit("trace of unknown session "),
                                              F.col("session_id")))).otherwise(
            F.coalesce(F.col("_traced"), F.lit(False)))
        out = joined.withColumn("components_populated", guard)
    from ..schemas import columns
    return out.select(*columns("truth_order_probability"))
