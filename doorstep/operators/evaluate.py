"""Score evaluation: discrimination, calibration, lift. All exact, none sorts in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clipped_logit, flag, ratio
from .models import fit_logit
from .ranks import auc_ks, equal_count_bins, score_table


def _y(df: DataFrame, label: str) -> Column:
    return flag(label).cast("double") if dict(df.dtypes)[label] == "boolean" \
        else F.col(label).cast("double")


def auc(df: DataFrame, score: str, label: str) -> float | None:
    return auc_ks(score_table(df, score, label)).first().auc


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    e = F.col(score).cast("double") - _y(df, label)
    return df.agg(F.avg(e * e).alias("brier"))


def reliability(df: DataFrame, score: str, label: str, key: str, bins: int = 10) -> DataFrame:
    """Equal-count bins, lowest scores first."""
    y = _y(df, label)
    b = equal_count_bins(df.select(F.col(score).alias("p"), F.col(key).alias("k"),
                                   y.alias("y")), ["p", "k"], bins)
    g = b.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"),
        F.min("p").alias("p_low"), F.max("p").alias("p_high"), F.sum("y").alias("events"))
    return g.withColumn("gap_pp", (F.col("observed") - F.col("predicted")) * 100)


def ece_of(table: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability table."""
    gap = F.abs(F.col("observed") - F.col("predicted"))
    return table.agg(ratio(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"))


def decile_lift(table: DataFrame) -> DataFrame:
    """Risk deciles, highest first, with lift and cumulative share captured."""
    # ten rows
    top = Window.orderBy(F.desc("bin"))
    all_rows = Window.partitionBy()
    base = ratio(F.sum("events").over(all_rows), F.sum("n").over(all_rows))
    return table.select(
        F.row_number().over(top).alias("decile"), "n", "predicted", "observed", "p_low", "p_high",
        "gap_pp", (F.col("observed") / base).alias("lift"),
        (ratio(F.sum("events").over(top.rowsBetween(Window.unboundedPreceding, 0)),
               F.sum("events").over(all_rows)) * 100).alias("captured_pct"))


def calibration_line(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and intercept of the outcome on the score's own log-odds."""
    data = df.select(_y(df, label).alias("y"), clipped_logit(score).alias("l"))
    fit = fit_logit(data, "y", ["l"])
    return fit.coef["l"], fit.intercept


def summarise(df: DataFrame, score: str, label: str, key: str, name: str) -> DataFrame:
    """The scoreboard row of one model on one sample."""
    df = df.select(F.col(score).alias("p"), F.col(key).alias("k"), _y(df, label).alias("y"))
    df = df.persist()
    e = F.col("p") - F.col("y")
    basic = df.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("base"), F.avg("p").alias("mp"),
                   F.avg(e * e).alias("brier")).first()
    disc = auc_ks(score_table(df, "p", "y")).first()
    cal = ece_of(reliability(df, "p", "y", "k")).first()
    slope, intercept = calibration_line(df, "p", "y")
    df.unpersist()
    row = [(name, basic.n, round(basic.base, 4), disc.auc, disc.ks, basic.brier, cal.ece, slope,
            intercept, basic.mp)]
    return df.sparkSession.createDataFrame(
        row, "model string, n long, base_rate double, auc double, ks double, brier double, "
        "ece double, cal_slope double, cal_intercept double, mean_predicted double")
