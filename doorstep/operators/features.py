"""Design matrices: train-only learned transforms, dummies, redundancy removal, scaling.

A fitted design is a short list of column expressions, so transforming data is one
projection. What is learned (medians, levels, moments, redundant columns) is a few numbers
per feature, read back by aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from .ranks import many_quantiles

REDUNDANT = 1e-8


def tick(name: str) -> Column:
    return F.col(f"`{name}`")


def correlation(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Pearson matrix of the named columns (features × features on the driver)."""
    vec = df.select(*[tick(n).alias(f"c{i}") for i, n in enumerate(names)])
    vec = VectorAssembler(inputCols=vec.columns, outputCol="v").transform(vec).select("v")
    return Correlation.corr(vec, "v").head()[0].toArray()


def moments(df: DataFrame, names: Sequence[str], sample: bool = True
            ) -> dict[str, tuple[float, float]]:
    """``{name: (mean, standard deviation)}`` in one aggregate."""
    sd = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*[f(tick(n)).alias(f"{t}{i}") for i, n in enumerate(names)
                   for t, f in (("m", F.avg), ("s", sd))]).first()
    return {n: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, n in enumerate(names)}


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long-form correlation matrix ``(a, b, r)``."""
    m = correlation(df, names)
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def weighted_correlation(df: DataFrame, names: Sequence[str], weight: str) -> tuple[list[str], np.ndarray]:
    """The columns that vary and their Pearson matrix, a row counted ``weight`` times; nulls are refused."""
    x, w = [tick(n).cast("double") for n in names], F.col(weight)
    row = df.agg(F.sum(w).alias("n"), *[F.sum(c * w).alias(f"s{i}") for i, c in enumerate(x)],
                 *[F.min(c).alias(f"l{i}") for i, c in enumerate(x)], *[F.max(c).alias(f"h{i}") for i, c in enumerate(x)],
                 F.bool_or(F.greatest(F.lit(False), *[c.isNull() for c in x])).alias("gap")).first()
    if row.gap:
        raise ValueError(f"a null in one of {list(names)}")
    live = [i for i in range(len(names)) if row.n and row[f"l{i}"] < row[f"h{i}"]]
    if not live:
        return [], np.zeros((0, 0))
    # around the means, so that nothing cancels
    off = [x[i] - F.lit(row[f"s{i}"] / row.n) for i in live]
    sums = df.agg(*[F.sum(off[a] * off[b] * w).alias(f"g{a}_{b}") for a in range(len(off)) for b in range(a + 1)]).first()
    gram = np.array([[sums[f"g{max(a, b)}_{min(a, b)}"] for b in range(len(off))] for a in range(len(off))])
    sd = np.sqrt(np.diag(gram))
    out = gram / np.outer(sd, sd)
    np.fill_diagonal(out, 1.0)
    return [names[i] for i in live], out


def independent_columns(df: DataFrame, names: Sequence[str], tol: float = 1e-9) -> list[str]:
    """A maximal full-rank subset, best-conditioned columns first (pivoted Cholesky).

    Spark reduces the rows to the correlation matrix; the pivoting runs on that matrix.
    """
    spread = moments(df, names, sample=False)
    live = [n for n in names if spread[n][1] > 0]
    return pivots(correlation(df, live), live, tol)


def pivots(matrix: np.ndarray, live: Sequence[str], tol: float = 1e-9) -> list[str]:
    """The columns that pivoting chooses from their correlation matrix, in the given order."""
    rest = matrix.copy()
    diag, chosen, rows = np.diag(rest).copy(), [], []
    for _ in live:
        j = int(np.argmax(diag))
        if diag[j] <= tol:
            break
        row = rest[j] - sum((r[j] * r for r in rows), np.zeros(len(live)))
        row = row / np.sqrt(diag[j])
        rows.append(row)
        diag = diag - row ** 2
        diag[j] = -np.inf
        chosen.append(j)
    return [live[i] for i in sorted(chosen)]


# ---- risk-model design -----------------------------------------------------------------
@dataclass
class DesignMatrix:
    """Learns its transforms on train rows and applies them unchanged elsewhere."""

    model: str
    medians: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)
    redundant: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        if self.model not in ("M1", "M2"):
            raise ValueError("model must be 'M1' or 'M2'")

    def sources(self, df: DataFrame) -> list[str]:
        out = {*P.MODEL_KEYS, P.MODEL_TARGET, *P.FEATURE_EXCLUSIONS}
        if self.model == "M1":
            out |= set(P.STAGE3_M2_ONLY)
        names = [c for c in P.SAFE_COLUMNS if c in df.columns and c not in out]
        bad = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)
               and c not in P.REFERENCE_LEVELS]
        if bad:
            raise ValueError(f"text columns without a declared encoding: {bad}")
        return names

    def _numeric(self, df: DataFrame) -> list[str]:
        return [c for c in self.sources(df) if c not in P.REFERENCE_LEVELS]

    def _features(self, df: DataFrame) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in self.medians:
            out[f"{c}_is_missing"] = F.col(c).isNull().cast("double")
        for c in self._numeric(df):
            x = F.col(c).cast("double")
            if c in self.medians:
                x = F.coalesce(x, F.lit(self.medians[c]))
            else:
                x = F.when(x.isNull(), F.raise_error(
                    F.lit(f"{c} is missing here but never was in training"))).otherwise(x)
            if c in P.LOG_FEATURES:
                out[f"log1p_{c}"] = F.log1p(F.greatest(x, F.lit(0.0)))
            else:
                out[c] = x
        for c, levels in self.levels.items():
            for level in levels:
                out[f"{c}[{level}]"] = F.coalesce(F.col(c) == level, F.lit(False)).cast("double")
        return out

    def fit(self, train: DataFrame) -> DesignMatrix:
        numeric = self._numeric(train)
        cats = [c for c in P.REFERENCE_LEVELS if c in self.sources(train)]
        row = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first()
        holes = [c for c in numeric if row[c]]
        if holes:
            med = many_quantiles(train, holes, [0.5])
            self.medians = {r["column"]: r["q0"] for r in med.collect()}
            self.medians = {c: self.medians.get(c, 0.0) for c in holes}
        for c in cats:
            # levels are a declared enumeration, one column of the design each
            seen = sorted(r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().collect())
            if P.REFERENCE_LEVELS[c] not in seen:
                raise ValueError(f"{c}: reference level {P.REFERENCE_LEVELS[c]!r} not in {seen}")
            self.levels[c] = [v for v in seen if v != P.REFERENCE_LEVELS[c]]
        built = train.select(*[e.alias(n) for n, e in self._features(train).items()])
        stats = moments(built, built.columns)
        self.redundant = [(n, "constant") for n in built.columns if stats[n][1] == 0]
        live = [n for n in built.columns if stats[n][1] > 0]
        order = sorted(live, key=lambda n: n.endswith("_is_missing"))
        r, dropped = correlation(built, order), set()
        for i, a in enumerate(order):
            for j in range(i + 1, len(order)):
                if a not in dropped and order[j] not in dropped \
                        and abs(abs(r[i, j]) - 1) < REDUNDANT:
                    dropped.add(order[j])
                    self.redundant.append((order[j], f"collinear with {a}"))
        self.columns = [n for n in live if n not in dropped]
        self.scale = {n: stats[n] for n in self.columns}
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns packed in the struct ``row`` plus one scaled double per feature."""
        feats = self._features(df)
        return df.select(F.struct(*keep).alias("row"), *[((feats[n] - m) / s).alias(n)
                                                         for n, (m, s) in self.scale.items()])


# ---- causal design ---------------------------------------------------------------------
def causal_features(df: DataFrame) -> dict[str, Column]:
    """Confounders of the causal work: logs, missing flags, first-level-dropped dummies."""
    out: dict[str, Column] = {}
    for c in P.CAUSAL_CONTINUOUS:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        if c == "order_value":
            x = F.log(F.greatest(F.col(c).cast("double"), F.lit(1.0)))
        elif c == "review_count":
            x = F.log1p(x)
        out[c] = x
    for c in P.CAUSAL_BINARY:
        out[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out.update(dummies(df, P.CAUSAL_CATEGORICAL))
    for c in P.CAUSAL_MISSING:
        out[f"{c}_missing"] = F.col(c).isNull().cast("double")
    return out


def dummies(df: DataFrame, columns: Iterable[str], prefix: dict[str, str] | None = None
            ) -> dict[str, Column]:
    """One indicator per level except the first in sort order."""
    out: dict[str, Column] = {}
    for c in columns:
        seen = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
        for level in seen[1:]:
            out[f"{(prefix or {}).get(c, c)}_{level}"] = (F.col(c) == level).cast("double")
    return out


def maximal_safe_features(df: DataFrame) -> dict[str, Column]:
    """The causal set plus every other numeric safe column (median-filled) and rule tiers."""
    out = causal_features(df)
    barred = {"rto_flag", "is_shipped", "is_censored", "is_cod", *P.MODEL_KEYS,
              "payment_method", "delivery_geography_id", "pit_risk_tier_rule_based"}
    wide = [f.name for f in df.schema if f.name not in barred and f.name not in out
            and isinstance(f.dataType, (T.NumericType, T.BooleanType))
            and f.name in P.SAFE_COLUMNS]
    med = {r["column"]: r["q0"] for r in many_quantiles(df, wide, [0.5]).collect()}
    for c in wide:
        out[c] = F.coalesce(F.col(c).cast("double"), F.lit(med.get(c, 0.0)))
    out.update(dummies(df, ("pit_risk_tier_rule_based",)))
    return out


def blocks(columns: Iterable[str]) -> dict[str, list[str]]:
    """Columns grouped by confounder: dummies together, a missing flag with its rate."""
    out: dict[str, list[str]] = {}
    for c in columns:
        owner = next((k for k in P.CAUSAL_CATEGORICAL if c.startswith(f"{k}_")), None)
        out.setdefault(owner or c.removesuffix("_missing"), []).append(c)
    return out


def recovery_features(df: DataFrame) -> tuple[dict[str, Column], DataFrame]:
    """Observable return terms in the planted model's own forms, and the frame they read."""
    d = lambda c: F.col(c).cast("double")
    cen = P.CENTERING
    one = df.agg(F.struct(F.avg(d("serviceability_score")).alias("m"),
                          F.stddev_pop(d("serviceability_score")).alias("s"),
                          F.avg(F.log1p(d("review_count"))).alias("r")).alias("z"))
    frame = df.withColumn("_z", one.scalar())
    out = {
        "is_cod": d("is_cod"),
        "serviceability_z": F.when(F.col("_z.s") > 0, (d("serviceability_score") - F.col("_z.m"))
                                   / F.col("_z.s")).otherwise(F.lit(0.0)),
        "address_completeness": d("address_completeness_score"),
        "seller_sla_breach_rate": d("seller_sla_breach_rate"),
        "seller_rating_centered": d("seller_rating") - cen["seller_rating_center"],
        "product_rating_centered": d("product_rating") - cen["product_rating_center"],
        "log1p_review_count_centered": F.log1p(d("review_count")) - F.col("_z.r"),
        "log_order_value": F.log(F.greatest(d("order_value"), F.lit(1.0))
                                 / cen["order_value_scale"]),
        "discount_pct_centered": (d("discount_pct") - cen["discount_pct_center"])
        / cen["discount_pct_unit"],
        "cart_size_ge3": (F.col("cart_size") >= 3).cast("double"),
        "est_delivery_days_centered": d("estimated_delivery_days")
        - cen["est_delivery_days_center"],
        "pit_rto_rate_shrunk": F.coalesce(d("pit_rto_rate_shrunk"), F.lit(0.0)),
        "is_new_customer": d("pit_is_new_customer"),
        "log1p_orders_delivered": F.log1p(F.coalesce(d("pit_orders_delivered"), F.lit(0.0))),
        "pit_cod_share": F.coalesce(d("pit_cod_share"), F.lit(0.0)),
        "paid_via_switch": d("paid_via_switch"),
        "month_end_x_cod": d("is_month_end_window") * d("is_cod"),
    }
    for c in ("geo_tier", "category"):
        for level in planted_levels(c):
            if level != P.REFERENCE_LEVELS[c]:
                out[f"{c}[{level}]"] = (F.col(c) == level).cast("double")
    return out, frame


def planted_levels(column: str) -> list[str]:
    return list(P.RTO_COEFFICIENTS[column])


def planted_contrasts(coefficients: dict) -> dict[str, float]:
    """Planted values a regression can estimate: levels become contrasts, latents go."""
    out: dict[str, float] = {}
    for term, value in coefficients.items():
        if term.startswith(("latent_", "shock.")):
            continue
        if isinstance(value, dict):
            base = P.REFERENCE_LEVELS[term]
            if base not in value:
                raise ValueError(f"{term}: no planted value for reference level {base!r}")
            out.update({f"{term}[{level}]": v - value[base]
                        for level, v in value.items() if level != base})
        else:
            out[term] = value
    return out
