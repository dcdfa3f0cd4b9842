"""Sessions and an ordered-step funnel from raw events.

A session of a user ends where no event follows for ``gap`` seconds. Its funnel state is the number of
steps reached: step k counts once an event of its type comes after the event that reached step k - 1
(by time, then event id).

Events meet by (user, time cell), never by user alone. Cells are as long as the gap, so all events of a
cell belong to one session and only a cell's first and last moment are ordered within a user: a user
with a third of all events costs one row a cell there. Each step is a minimum per cell, then per session.

Events without a user or a time belong to no session. Repeated rows change counts of events, not the
steps. A table without events gives no sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS = ("view", "click", "purchase")
GAP = 12 * 3600


def celled(events: DataFrame, gap: int) -> DataFrame:
    """Events with their cell and ``at``, the order of events."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.where("user_id IS NOT NULL AND ts IS NOT NULL").select(
        "user_id", "event_type", F.struct(at.alias("us"), F.col("event_id")).alias("at"),
        F.floor(at / F.lit(gap * 1_000_000)).alias("cell"))


def session_cells(rows: DataFrame, gap: int) -> DataFrame:
    """(user_id, cell, session, first, last, n): each cell and the first moment of its session."""
    cells = rows.groupBy("user_id", "cell").agg(
        F.min("at.us").alias("first"), F.max("at.us").alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy("cell")
    quiet = F.col("first") - F.lag("last").over(w) >= gap * 1_000_000
    opened = cells.withColumn("opens", F.when(F.coalesce(quiet, F.lit(True)), F.col("first")))
    return opened.withColumn("session", F.last("opens", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def step_times(rows: DataFrame, cells: DataFrame, steps: Sequence[str]) -> list[DataFrame]:
    """For each step (user_id, session, at): the event that reached it."""
    out: list[DataFrame] = []
    for step in steps:
        left = cells.select("user_id", "cell", "session")
        if out:
            left = left.join(out[-1].withColumnRenamed("at", "before"), ["user_id", "session"])
        met = rows.where(F.col("event_type") == step).join(left, ["user_id", "cell"])
        if out:
            met = met.where(F.col("at") > F.col("before"))
        out.append(met.groupBy("user_id", "cell", "session").agg(F.min("at").alias("at"))
                   .groupBy("user_id", "session").agg(F.min("at").alias("at")))
    return out


def sessions(events: DataFrame, steps: Sequence[str] = STEPS, gap: int = GAP) -> DataFrame:
    """(user_id, session_start, session_end, events, reached) and ``t1`` ... , when each step was reached."""
    rows = celled(events, gap)
    cells = session_cells(rows, gap)
    out = cells.groupBy("user_id", "session").agg(F.max("last").alias("last"), F.sum("n").alias("events"))
    for k, times in enumerate(step_times(rows, cells, steps), 1):
        out = out.join(times.select("user_id", "session", F.col("at.us").alias(f"t{k}")), ["user_id", "session"], "left")
    ts = [F.timestamp_micros(f"t{k}").alias(f"t{k}") for k in range(1, len(steps) + 1)]
    reached = sum((F.col(f"t{k}").isNotNull().cast("long") for k in range(1, len(steps) + 1)), F.lit(0))
    return out.select("user_id", F.timestamp_micros("session").alias("session_start"),
                      F.timestamp_micros("last").alias("session_end"), "events", reached.cast("long").alias("reached"), *ts)


def funnel(found: DataFrame, steps: Sequence[str] = STEPS) -> DataFrame:
    """(step, event_type, sessions, share, step_share) over sessions; step 0 is all of them."""
    names = ("any", *steps)
    counts = found.agg(*[F.count_if(F.col("reached") >= k).alias(f"n{k}") for k in range(len(names))])
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(k).alias("step"), F.lit(name).alias("event_type"), F.col(f"n{k}").alias("sessions"),
        F.try_divide(f"n{k}", "n0").alias("share"), F.try_divide(f"n{k}", f"n{max(0, k - 1)}").alias("step_share"))
        for k, name in enumerate(names)])))
