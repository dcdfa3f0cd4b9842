"""Many logistic models of one frame, fitted together.

Each pass over the rows adds up, for every model that has not converged, the weighted Gram matrix,
the score vector and the deviance at its present coefficients; tasks send one packed vector each and
the driver solves the small systems. The number of passes is that of the slowest model, however many
there are, so ablations cost about as much as one fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks of the first step of adding up; the second is one task with a vector from each.
FAN = 32


def tick(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class ManyFit:
    """One of the fitted models; ``names`` without the intercept."""
    names: list[str]
    coef: dict[str, float]
    intercept: float
    deviance: float
    null_deviance: float
    rows: int
    converged: bool
    se: dict[str, float]

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.deviance / self.null_deviance if self.null_deviance else float("nan")

    def log_odds(self) -> Column:
        out = F.lit(self.intercept)
        for n in self.names:
            out = out + F.lit(self.coef[n]) * tick(n).cast("double")
        return out

    def score(self, df: DataFrame) -> DataFrame:
        """Append ``lp`` (log-odds) and ``p``."""
        lp = df.withColumn("lp", self.log_odds())
        return lp.withColumn("p", 1 / (1 + F.exp(-F.col("lp"))))


def summed(parts: DataFrame) -> np.ndarray | None:
    """Sum of the packed float64 vectors ``v``, in two steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("v"):
                v = np.frombuffer(x.as_buffer(), np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])
    row = parts.repartition(FAN).mapInArrow(run, "v binary").coalesce(1).mapInArrow(run, "v binary").first()
    return None if row is None else np.frombuffer(row["v"], np.float64)


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """Columns of the rows that have all values; the last is the label."""
    x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
    x = x[~np.isnan(x).any(axis=1)]
    return np.column_stack([np.ones(len(x)), x])


def _probabilities(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))


def _packed(df: DataFrame, label: Column, names: Sequence[str], weight: str | None = None) -> DataFrame:
    times = F.lit(1) if weight is None else tick(weight)
    return df.select(*[tick(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)], times.cast("double").alias("w"),
                     label.cast("double").alias("y"))


def sums_at(data: DataFrame, places: Sequence[np.ndarray], betas: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float, float]]:
    """Gram matrix, score, deviance, rows and sum of labels of each model, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(b) ** 2 + len(b) + 3) for b in betas]
        for batch in batches:
            x = _whole(batch)
            y = x[:, -1]
            w = x[:, -2]
            for out, at, b in zip(total, places, betas, strict=True):
                own = x[:, at]
                eta = own @ b
                p = _probabilities(eta)
                gram = own.T @ (own * (w * p * (1 - p))[:, None])
                loss = 2 * (w * (np.logaddexp(0, eta) - y * eta)).sum()
                out += np.concatenate([gram.ravel(), own.T @ (w * (y - p)), [loss, w.sum(), (w * y).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total).tobytes()], pa.binary())], ["v"])
    found = summed(data.mapInArrow(run, "v binary"))
    out, start = [], 0
    for b in betas:
        k = len(b)
        part = np.zeros(k * k + k + 3) if found is None else found[start:start + k * k + k + 3]
        out.append((part[:k * k].reshape(k, k), part[k * k:k * k + k], *part[-3:]))
        start += k * k + k + 3
    return out


def fit_many(df: DataFrame, label: str | Column, models: Mapping[str, Sequence[str]], *, tol: float = 1e-11,
             passes: int = 60, weight: str | None = None) -> tuple[dict[str, ManyFit], int]:
    """Unregularised logistic fits of ``label`` on each list of columns, and the passes they took.

    Rows with a null or NaN in any of the columns, or without a label, take no part in any model, so
    all models see the same rows. A step that raises the deviance is halved. Of columns that others
    determine, the least-squares step shares the weight out. A model without rows has no coefficients
    (NaN); one whose classes are separable stops unconverged. ``weight`` names a column that says how
    many rows each row stands for; its label is then their share of ones.
    """
    label = F.col(label) if isinstance(label, str) else label
    names = list(dict.fromkeys(n for cols in models.values() for n in cols))
    data = _packed(df, label, names, weight).persist()
    try:
        return _fitted(data, names, models, tol, passes)
    finally:
        data.unpersist()


def _fitted(data: DataFrame, names: list[str], models: Mapping[str, Sequence[str]], tol: float, passes: int
            ) -> tuple[dict[str, ManyFit], int]:
    place = {n: i + 1 for i, n in enumerate(names)}
    at = {m: np.array([0, *(place[c] for c in cols)]) for m, cols in models.items()}
    beta = {m: np.zeros(len(x)) for m, x in at.items()}
    best: dict[str, tuple[np.ndarray, float]] = {}
    done: dict[str, ManyFit] = {}
    used = 0

    def close(m: str, b: np.ndarray, dev: float, n: float, ones: float, converged: bool, gram: np.ndarray) -> None:
        null = 0.0 if not 0 < ones < n else -2 * (ones * np.log(ones / n) + (n - ones) * np.log(1 - ones / n))
        cols = list(models[m])
        done[m] = ManyFit(cols, dict(zip(cols, map(float, b[1:]), strict=True)), float(b[0]), float(dev), float(null), int(n), converged,
                          dict(zip(cols, map(float, np.sqrt(np.maximum(np.diag(np.linalg.pinv(gram)), 0))[1:]), strict=True)))

    while len(done) < len(models):
        open_ = [m for m in models if m not in done]
        found = sums_at(data, [at[m] for m in open_], [beta[m] for m in open_])
        used += 1
        for m, (gram, score, dev, n, ones) in zip(open_, found, strict=True):
            b = beta[m]
            if not n:
                close(m, np.full(len(b), np.nan), np.nan, 0, 0, False, gram)
            elif m in best and dev > best[m][1] * (1 + 1e-13) + 1e-12:
                old = best[m][0]
                beta[m] = (b + old) / 2
                if np.abs(beta[m] - old).max() <= tol * (1 + np.abs(old).max()):
                    close(m, old, best[m][1], n, ones, True, gram)
            else:
                best[m] = b, dev
                step = np.linalg.lstsq(gram, score, rcond=None)[0]
                beta[m] = b + step
                if np.abs(step).max() <= tol * (1 + np.abs(b).max()):
                    close(m, beta[m], dev, n, ones, True, gram)
            if m not in done and used >= passes:
                close(m, *best[m], n, ones, False, gram)
    return {m: done[m] for m in models}, used


def average_gains(df: DataFrame, treated: str, fits: Mapping[str, ManyFit]) -> dict[str, tuple[float, float]]:
    """For each model, 100 times the mean change of the probability when ``treated`` goes from 0 to 1,
    over all rows and over the treated ones, in one pass."""
    names = list(dict.fromkeys([treated, *(n for f in fits.values() for n in f.names)]))
    place = {n: i + 1 for i, n in enumerate(names)}
    plan = [(np.array([0, *(place[n] for n in f.names if n != treated)]),
             np.array([f.intercept, *(f.coef[n] for n in f.names if n != treated)]), f.coef.get(treated, 0.0)) for f in fits.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * len(plan))
        for batch in batches:
            x = _whole(batch)
            on = x[:, place[treated]] == 1
            total[:2] += len(x), on.sum()
            for i, (at, b, t) in enumerate(plan):
                off = x[:, at] @ b
                gain = _probabilities(off + t) - _probabilities(off)
                total[2 + 2 * i:4 + 2 * i] += gain.sum(), gain[on].sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])
    found = summed(_packed(df, F.lit(0), names).mapInArrow(run, "v binary"))
    found = np.zeros(2 + 2 * len(plan)) if found is None else found
    share = lambda a, n: float(100 * a / n) if n else float("nan")
    return {m: (share(found[2 + 2 * i], found[0]), share(found[3 + 2 * i], found[1])) for i, m in enumerate(fits)}
