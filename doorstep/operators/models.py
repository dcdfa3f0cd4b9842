"""Unregularised logit fits, scorecards, rule baselines, the boosted challenger, gates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag, ratio
from ..session import forget, keep
from .features import DesignMatrix, correlation, moments, pivots, tick
from .views import with_m2_tier


@dataclass
class LogitFit:
    """Coefficients by name with the fitted Spark model behind them."""

    names: list[str]
    coef: dict[str, float]
    se: dict[str, float]
    p_value: dict[str, float]
    intercept: float
    deviance: float
    null_deviance: float
    rows: int
    model: object
    vector: object

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.deviance / self.null_deviance if self.null_deviance else float("nan")

    def score(self, df: DataFrame) -> DataFrame:
        """Append ``lp`` (log-odds) and ``p``."""
        return self.model.transform(self.vector(df)).drop("_features")


def _assembler(names: Sequence[str]):
    """A function that adds the ``_features`` vector; names may hold any character."""
    def add(df: DataFrame) -> DataFrame:
        safe = {f"_x{i}": tick(n).cast("double") for i, n in enumerate(names)}
        wide = df.withColumns(safe) if safe else df
        return VectorAssembler(inputCols=list(safe), outputCol="_features").transform(
            wide).drop(*safe)
    return add


def fit_logit(df: DataFrame, label: str | Column, names: Sequence[str], *,
              cached: bool = False) -> LogitFit:
    """Binomial GLM by iteratively reweighted least squares on the named double columns."""
    names = list(names)
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    if not names:
        row = df.agg(F.avg(y).alias("m"), F.count(y).alias("n")).first()
        m, n = row.m, row.n
        dev = -2 * n * sum(x * math.log(x) for x in (m, 1 - m) if x > 0)
        return LogitFit([], {}, {}, {}, math.log(m / (1 - m)), dev, dev, n, None, None)
    vector = _assembler(names)
    data = vector(df.withColumn("_label", y)).select("_label", "_features")
    # read once per iteration of the fit
    data = data if cached else data.persist()
    glr = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="_label", featuresCol="_features",
        predictionCol="p", linkPredictionCol="lp", maxIter=200, tol=1e-10, regParam=0.0)
    model = glr.fit(data)
    s = model.summary
    ses, ps = list(s.coefficientStandardErrors), list(s.pValues)
    coef = [float(c) for c in model.coefficients]
    fit = LogitFit(names, dict(zip(names, coef)), dict(zip(names, ses)), dict(zip(names, ps)),
                   float(model.intercept), float(s.deviance), float(s.nullDeviance),
                   int(s.numInstances), model, vector)
    fit.se["(intercept)"], fit.p_value["(intercept)"] = ses[-1], ps[-1]
    if not cached:
        data.unpersist()
    return fit


def with_columns(df: DataFrame, features: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[e.alias(n) for n, e in features.items()])


def linear_r2(df: DataFrame, label: str, names: Sequence[str]) -> float:
    """R² of an unregularised least-squares fit."""
    data = _assembler(names)(df.withColumn("_label", F.col(label).cast("double")))
    data = data.select("_label", "_features").persist()
    model = LinearRegression(labelCol="_label", featuresCol="_features", solver="normal",
                             regParam=0.0).fit(data)
    r2 = float(model.summary.r2)
    data.unpersist()
    return r2


def linear_r2s(df: DataFrame, labels: Sequence[str], names: Sequence[str]) -> tuple[list[str], list[float]]:
    """A maximal full-rank subset of ``names`` and, for each label, R² of its least-squares fit on them.

    One correlation matrix of columns and labels holds all of it, however many labels there are.
    """
    spread = moments(df, names, sample=False)
    live = [n for n in names if spread[n][1] > 0]
    both = correlation(df, [*live, *labels])
    chosen = pivots(both[:len(live), :len(live)], live)
    at = [live.index(n) for n in chosen]
    own, with_labels = both[np.ix_(at, at)], both[at, len(live):]
    return chosen, [float(x) for x in (with_labels * np.linalg.solve(own, with_labels)).sum(axis=0)]


# ---- scorecard ----------------------------------------------------------------------------
def coefficient_table(df: DataFrame, fit: LogitFit) -> DataFrame:
    """Intercept first, then features by absolute coefficient."""
    body = sorted(fit.names, key=lambda n: -abs(fit.coef[n]))
    rows = []
    for i, n in enumerate(["(intercept)", *body]):
        c = fit.intercept if n == "(intercept)" else fit.coef[n]
        se = fit.se[n]
        rows.append((i, n, c, se, c / se if se else None, fit.p_value[n], math.exp(min(c, 700))))
    return df.sparkSession.createDataFrame(
        rows, "place int, feature string, coef_per_sd double, std_err double, z double, "
        "p_value double, odds_ratio_per_sd double")


def points_table(coefficients: DataFrame, pdo: float = 20.0, base_points: float = 600.0,
                 base_odds: float = 20.0) -> DataFrame:
    """Points per one-deviation move; more points mean less risk."""
    header = coefficients.where("feature = '(intercept)'").select(
        "place", F.lit(f"(base score at odds {base_odds:.0f}:1)").alias("feature"),
        F.lit(base_points).alias("points_per_sd"), F.lit(None).cast("double")
        .alias("coef_per_sd"))
    body = coefficients.where("feature <> '(intercept)'").select(
        "place", "feature", (-F.col("coef_per_sd") * pdo / math.log(2.0)).alias("points_per_sd"),
        "coef_per_sd")
    return header.unionByName(body)


def fit_regularised(df: DataFrame, label: str | Column, names: Sequence[str], alpha: float):
    """Ridge-penalised option of the scorecard (``alpha`` > 0)."""
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    data = _assembler(names)(df.withColumn("_label", y)).select("_label", "_features").persist()
    model = LogisticRegression(labelCol="_label", featuresCol="_features", regParam=alpha,
                               elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)
    data.unpersist()
    return dict(zip(names, [float(c) for c in model.coefficients])), float(model.intercept)


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    cut: object
    horizon: object


def censoring_horizon(orders: DataFrame):
    """First order day that holds a censored order, over everything shipped; None if none."""
    row = orders.where(F.col("is_shipped") & F.col("is_censored")).agg(
        F.min("order_date").alias("d")).first()
    return row.d


def clean_window(frame: DataFrame, orders: DataFrame) -> tuple[DataFrame, object]:
    """Rows before the first censored day: later ones over-represent quick outcomes."""
    day = censoring_horizon(orders)
    if day is None:
        return frame, None
    return frame.where(F.col("session_start_ts") < F.lit(day).cast("timestamp_ntz")), day


def time_split(frame: DataFrame, fraction: float = P.TRAIN_FRACTION, *, horizon=None) -> Split:
    """Chronological split: the cut is the start of the day of row ``int(n·fraction)``.

    The row is located by counting sessions per day, so nothing is sorted globally.
    """
    days = frame.groupBy(F.col("session_start_ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    counted = sorted((r.day, r.n) for r in days.toLocalIterator())  # one row per calendar day
    target, seen, cut_day = int(sum(n for _, n in counted) * fraction), 0, None
    for day, n in counted:
        if seen <= target < seen + n:
            cut_day = day
            break
        seen += n
    edge = F.lit(cut_day).cast("timestamp_ntz")
    return Split(frame.where(F.col("session_start_ts") < edge),
                 frame.where(F.col("session_start_ts") >= edge), cut_day, horizon)


def describe_split(split: Split) -> DataFrame:
    """Rows, date span, return rate, COD share and customers per side."""
    both = split.train.withColumn("split", F.lit("train")).unionByName(
        split.test.withColumn("split", F.lit("test")))
    day = F.col("session_start_ts").cast("date")
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min(day).alias("from_day"), F.max(day).alias("to_day"),
        ratio(F.count_if(flag("rto_flag")), F.count(F.lit(1))).alias("rto_rate"),
        ratio(F.count_if(F.col("payment_method") == "COD"), F.count(F.lit(1)))
        .alias("cod_share"), F.count_distinct("customer_id").alias("customers"))


@dataclass
class Scorecard:
    design: DesignMatrix
    fit: LogitFit

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        scored = self.fit.score(self.design.transform(df, keep))
        return scored.select("row.*", F.col("p").alias("score"))


def fit_scorecard(train: DataFrame, model: str) -> Scorecard:
    design = DesignMatrix(model).fit(train)
    # as columns of a file, an indicator takes a bit a row; in cached vectors, eight bytes
    data = keep(design.transform(train, ["rto_flag"]))
    fit = fit_logit(data, flag("row.rto_flag"), design.columns, cached=True)
    forget(data)
    return Scorecard(design, fit)


# ---- rule baselines ---------------------------------------------------------------------------
def rules_scores(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Score test rows by their tier's train return rate, unseen tiers by the base rate."""
    rate = ratio(F.count_if(flag("rto_flag")), F.count(F.lit(1)))
    rates = train.groupBy(column).agg(rate.alias("_rate"))
    base = train.agg(rate.alias("_b")).scalar()
    return test.join(rates, column, "left").withColumn(
        "score", F.coalesce(F.col("_rate"), base)).drop("_rate")


def rules_table(train: DataFrame, column: str) -> DataFrame:
    """Tier sizes, observed rates, shares and lifts."""
    from pyspark.sql import Window
    everyone = Window.partitionBy()
    g = train.groupBy(column).agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if(flag("rto_flag")).alias("x"))
    rate = ratio("x", "n")
    return g.select(column, "n", rate.alias("observed"),
                    (ratio("n", F.sum("n").over(everyone)) * 100).alias("share_pct"),
                    rate.alias("assigned_p"),
                    (rate / ratio(F.sum("x").over(everyone), F.sum("n").over(everyone)))
                    .alias("lift"))


def tier_agreement(frame: DataFrame, stored: DataFrame,
                   column: str = "order_risk_tier_rule_based") -> DataFrame:
    """How often the rebuilt three-rule tier equals the stored one."""
    rebuilt = with_m2_tier(frame).select("session_id", F.col(column).alias("rebuilt"))
    j = rebuilt.join(stored.select("session_id", F.col(column).alias("stored")), "session_id")
    same = F.col("rebuilt").eqNullSafe(F.col("stored"))
    return j.agg(F.count(F.lit(1)).alias("rows_compared"),
                 ratio(F.count_if(same), F.count(F.lit(1))).alias("agreement"),
                 F.bool_and(same).alias("exact"))


# ---- challenger -----------------------------------------------------------------------------------
def fit_challenger(data: DataFrame, label: str | Column, names: Sequence[str], *,
                   key: str = "session_id", seed: int = 20260115, rounds: int = 400):
    """Gradient-boosted trees with a 15 % early-stopping share drawn by key hash."""
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    hold = F.pmod(F.xxhash64(F.lit(seed), F.col(f"row.{key}")), F.lit(100)) < 15
    # not cached: the boosting keeps binned points of its own and reads these rows a few times only
    rows = _assembler(names)(data.withColumns({"_label": y, "_hold": hold})).select(
        "_label", "_features", "_hold")
    gbt = GBTClassifier(labelCol="_label", featuresCol="_features", maxDepth=4, maxIter=rounds,
                        stepSize=0.05, minInstancesPerNode=100, seed=seed,
                        validationIndicatorCol="_hold")
    model = gbt.fit(rows)

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(_assembler(names)(df))
        return out.select("row.*", vector_to_array("probability")[1].alias("score"))
    return model, score


def ship_rule(challenger_auc: float, scorecard_auc: float) -> tuple[float, bool]:
    """Margin in percentage points, and whether it clears the pre-committed bar."""
    margin = challenger_auc - scorecard_auc
    return margin * 100, margin >= P.CHALLENGER_MARGIN


def model_gates(df: DataFrame, auc: float, ceiling: float) -> DataFrame:
    """The four bars a model's test AUC is held against."""
    bars = [("achievable ceiling", ceiling, auc < ceiling, "below", "AT OR ABOVE"),
            ("leak limit", P.AUC_LEAK_LIMIT, auc < P.AUC_LEAK_LIMIT, "PASS", "FAIL"),
            ("diagnostic stop", P.AUC_DIAGNOSTIC_STOP, auc < P.AUC_DIAGNOSTIC_STOP, "PASS",
             "STOP"),
            ("feasibility gate", P.AUC_FEASIBILITY, auc >= P.AUC_FEASIBILITY,
             "risk-based pricing", "coarse tiers only")]
    rows = [(name, float(value), float(auc), bool(ok), yes if ok else no)
            for name, value, ok, yes, no in bars]
    return df.sparkSession.createDataFrame(
        rows, "bar string, value double, auc double, ok boolean, status string")
