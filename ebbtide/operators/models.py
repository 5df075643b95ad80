"""Classifiers with the settings the analyses use: logistic by Newton's method, Spark ML's boosted trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import expit
from ..session import checkpoint_folder, cut
from .order import running

NEWTON_STEPS = 50
#: Bins of a feature of a boosted tree, and counted values among which their borders are chosen.
BINS, CLASSES = 32, 10_000

_X = "_features"


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=_X).transform(df)


def assembled(df: DataFrame, features: Sequence[str], *others: str) -> DataFrame:
    """The features as the array `_z`, null and NaN refused, beside `others`."""
    return _assemble(df, features).select(vector_to_array(_X).alias("_z"), *others)


@dataclass
class Logistic:
    """Intercept and coefficients on the scale (x - mean) / spread; a spread of 0 has coefficient 0."""

    theta: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def plain(self) -> tuple[float, np.ndarray]:
        """Intercept and coefficients of the features as they are."""
        w = np.where(self.spread > 0, self.theta[1:] / np.where(self.spread > 0, self.spread, 1.0), 0.0)
        return float(self.theta[0] - w @ self.mean), w


class Classifier:
    """A fitted probability model over named columns; `fallback` when one class was seen.

    Boosted trees are fitted on bins, whose `borders` turn features into bins again.
    """

    def __init__(self, features, model=None, borders=None, fallback: float | None = None):
        self.features, self.model, self.borders, self.fallback = features, model, borders, fallback

    def score(self, df: DataFrame, name: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(name, F.lit(self.fallback))
        if isinstance(self.model, Logistic):
            b, w = self.model.plain()
            x = assembled(df, self.features, *df.columns)
            eta = sum((F.col("_z")[i] * float(v) for i, v in enumerate(w)), F.lit(b))
            return x.select(*df.columns, expit(eta).alias(name))
        bins = [_bin(F.col(f), at).alias(f"_b{i}") for i, (f, at) in enumerate(
            zip(self.features, self.borders, strict=True))]
        x = _assemble(df.select("*", *bins), [f"_b{i}" for i in range(len(bins))])
        return self.model.transform(x).select(*df.columns, vector_to_array("_prob")[1].alias(name))


def _one_class(df: DataFrame, label: str) -> tuple[int, float | None]:
    """Row count, and the constant label if there is only one."""
    r = df.agg(F.count(F.lit(1)), F.min(label), F.max(label)).first()
    if r[0] == 0:
        raise ValueError("no rows to fit")
    return r[0], float(r[1]) if r[1] == r[2] else None


Sums = Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def newton(sums: Sums, size: int, c: float) -> np.ndarray:
    """The least of the summed loss plus ||w||^2 / (2 c); theta is the intercept, then w.

    `sums` gives log-likelihood, gradient and curvature at a theta, in one pass over the rows. A
    step that loses is pulled half way back.
    """
    precision = np.concatenate([[0.0], np.full(size - 1, 1.0 / c)])
    best, trial, value, step = np.zeros(size), np.zeros(size), -np.inf, np.zeros(size)
    for _ in range(NEWTON_STEPS):
        ll, g, h = sums(trial)
        now = ll - 0.5 * float(precision @ (trial * trial))
        if now + 1e-12 * (1 + abs(now)) < value:
            trial = 0.5 * (trial + best)
            continue
        best, value = trial, now
        step = np.linalg.solve(h + np.diag(precision), g - precision * best)
        trial = best + step
        if np.abs(step).max() < 1e-8:
            return trial
    return best


def summed(rows: DataFrame, size: int, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of `add` over all batches: each task sends one list of `size` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += add(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def loss(eta: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of 0/1 outcomes, residuals and weights at linear predictors."""
    if not np.isin(y, (0.0, 1.0)).all():
        raise ValueError("outcomes must be 0 or 1")
    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
    return float(np.sum(y * eta - np.logaddexp(0.0, eta))), y - p, p * (1.0 - p)


def logistic(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0) -> Classifier:
    """Standardised logistic regression; penalty ||w||^2 / 2 against c times the summed loss.

    Every Newton step is one pass over the rows; no copy of them is kept.
    """
    n, constant = _one_class(df, label)
    if constant is not None:
        return Classifier(features, fallback=constant)
    k = len(features)
    rows = assembled(df.select(*features, F.col(label).cast("double").alias("_y")), features, "_y")
    m = rows.agg(*[F.avg(F.col("_z")[i]) for i in range(k)],
                 *[F.stddev_samp(F.col("_z")[i]) for i in range(k)]).first()
    mean, spread = np.array(m[:k], float), np.array(m[k:], float)
    unit = np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 0.0)
    tri = np.triu_indices(k + 1)

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def add(batch: pa.RecordBatch) -> np.ndarray:
            z = np.ones((batch.num_rows, k + 1))
            z[:, 1:] = (batch.column("_z").flatten().to_numpy().reshape(-1, k) - mean) * unit
            ll, r, v = loss(z @ theta, batch.column("_y").to_numpy(zero_copy_only=False))
            return np.concatenate([[ll], z.T @ r, ((z * v[:, None]).T @ z)[tri]])

        got = summed(rows, 1 + k + 1 + len(tri[0]), add)
        h = np.zeros((k + 1, k + 1))
        h[tri] = got[k + 2:]
        return got[0], got[1:k + 2], h + np.triu(h, 1).T
    return Classifier(features, Logistic(newton(sums, k + 1, c), mean, spread))


def borders(df: DataFrame, features: Sequence[str], rows: int) -> list[list[float]]:
    """Where each feature is split into bins, by Spark ML's rule on the counts of all rows.

    A feature of more than CLASSES values is first counted in CLASSES runs of about equal weight.
    """
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x"))
                                for i, c in enumerate(features)]))
    cells = df.select(names.alias("r")).select("r.*").filter("x IS NOT NULL AND NOT isnan(x)").groupBy(
        "f", "x").agg(F.count(F.lit(1)).alias("n"))
    cells = cut(cells)
    many = {r["f"] for r in cells.groupBy("f").agg(F.count(F.lit(1)).alias("k")).filter(
        F.col("k") > CLASSES).collect()}
    run = F.col("_cum") if not many else F.when(F.col("f").isin(*many), F.floor(
        (F.col("_cum") - 1) * CLASSES / rows)).otherwise(F.col("_cum"))
    got = running(cells, [F.col("x")], {"_cum": F.col("n")}, ["f"]).groupBy("f", run.alias("run")).agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("n")).toPandas()
    return [_splits(*[part[k].to_numpy() for k in ("low", "high", "n")], min(BINS, rows) - 1)
            for part in (got[got["f"] == i].sort_values("low") for i in range(len(features)))]


def _splits(low: np.ndarray, high: np.ndarray, n: np.ndarray, most: int) -> list[float]:
    """At most `most` borders between counted values, near equal shares of the rows."""
    between = (high[:-1] + low[1:]) / 2.0
    if len(between) <= most:
        return [float(v) for v in between]
    stride = float(n.sum()) / (most + 1)
    out, seen, target = [], float(n[0]), stride
    for i in range(1, len(n)):
        before, seen = seen, seen + float(n[i])
        if abs(before - target) < abs(seen - target):
            out.append(float(between[i - 1]))
            target += stride
    return out


def _bin(x: Column, at: Sequence[float]) -> Column:
    """How many borders lie below `x`; NaN stays, so that it is refused as it is elsewhere."""
    x = x.cast("double")
    below = sum(((x > v).cast("double") for v in at), F.lit(0.0))
    return F.when(x.isNotNull(), F.when(F.isnan(x), x).otherwise(below))


def boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 150,
            step: float = 0.06, depth: int = 3, seed: int = 0) -> Classifier:
    """Gradient-boosted trees with a fixed number of rounds, whose lineage is cut every ten.

    Trees see bins alone, so the rows are counted by their bins and outcome first, and the rounds
    run over these counts as weights.
    """
    checkpoint_folder(df.sparkSession)
    n, constant = _one_class(df, label)
    if constant is not None:
        return Classifier(features, fallback=constant)
    at = borders(df, features, n)
    names = [f"_b{i}" for i in range(len(features))]
    cells = cut(df.select(*[_bin(F.col(f), t).alias(b) for f, t, b in zip(features, at, names, strict=True)],
                          F.col(label).cast("double").alias("_y")).groupBy(*names, "_y").agg(
        F.count(F.lit(1)).cast("double").alias("_w")))
    model = GBTClassifier(featuresCol=_X, labelCol="_y", weightCol="_w", maxIter=rounds, stepSize=step,
                          maxDepth=depth, seed=seed, cacheNodeIds=True,
                          checkpointInterval=10).fit(_assemble(cells, names))
    model.setProbabilityCol("_prob").setPredictionCol("_pred").setRawPredictionCol("_raw")
    return Classifier(features, model, at)
