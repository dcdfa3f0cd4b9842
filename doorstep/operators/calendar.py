"""Calendar dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar(bounds: DataFrame) -> DataFrame:
    """One row per day between ``c_start`` and ``c_end`` (a one-row frame)."""
    days = bounds.select("c_start", F.explode(F.sequence("c_start", "c_end")).alias("date_id"))
    dow, dom = F.weekday("date_id") + 1, F.dayofmonth("date_id")
    demand = (F.when(dow >= 6, 1.075).otherwise(0.99) * F.when(dom >= 26, 1.08).otherwise(1.0)
              * F.when(dom <= 7, 1.06).otherwise(1.0))
    return days.select(
        "date_id", F.date_diff("date_id", "c_start").alias("day_index"),
        dow.cast("short").alias("day_of_week"), (dow >= 6).alias("is_weekend"),
        dom.cast("short").alias("day_of_month"), (dom >= 26).alias("is_month_end_window"),
        (dom <= 7).alias("is_salary_week"), demand.cast("decimal(6,4)").alias("demand_index"))
