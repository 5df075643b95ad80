"""Ways to rank customers for treatment, all with the same fit and score interface."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..session import cut
from . import correlate, evaluate, models, shaping


class Targeter(Protocol):
    """Anything that learns from a trial and scores customers, higher first."""

    name: str

    def fit(self, df: DataFrame, features: Sequence[str]) -> Targeter: ...

    def score(self, df: DataFrame, name: str) -> DataFrame: ...


class _Base:
    name = ""

    def __init__(self, learner: str = "boosted", seed: int = 0, **options):
        self.learner, self.seed, self.options = learner, seed, options

    def _learn(self, df: DataFrame, features: Sequence[str], label: str, shift: int = 0):
        if self.learner == "logistic":
            return models.logistic(df, features, label)
        return models.boosted(df, features, label, seed=self.seed + shift, **self.options)


class OutcomePropensity(_Base):
    """Who is likeliest to have the outcome, treatment ignored."""

    name = "outcome_propensity"

    def fit(self, df, features):
        self.model = self._learn(df, features, "y")
        return self

    def score(self, df, name="score"):
        return self.model.score(df, name)


class ResponseModel(_Base):
    """Who responds among the treated."""

    name = "response_model"

    def fit(self, df, features):
        self.model = self._learn(df.filter("t = 1"), features, "y")
        return self

    def score(self, df, name="score"):
        return self.model.score(df, name)


class TLearner(_Base):
    """One model per arm, score is the difference."""

    name = "t_learner"

    def fit(self, df, features):
        self.treated = self._learn(df.filter("t = 1"), features, "y")
        self.control = self._learn(df.filter("t = 0"), features, "y", 1)
        return self

    def arms(self, df, p1="p1", p0="p0"):
        return self.control.score(self.treated.score(df, p1), p0)

    def score(self, df, name="score"):
        return self.arms(df, "_p1", "_p0").withColumn(
            name, F.col("_p1") - F.col("_p0")).drop("_p1", "_p0")


class SLearner(_Base):
    """One model with the treatment as a feature, scored at both settings."""

    name = "s_learner"

    def fit(self, df, features):
        self.model = self._learn(df.withColumn("_t", F.col("t").cast("double")),
                                 [*features, "_t"], "y")
        return self

    def score(self, df, name="score"):
        on = self.model.score(df.withColumn("_t", F.lit(1.0)), "_p1")
        both = self.model.score(on.withColumn("_t", F.lit(0.0)), "_p0")
        return both.withColumn(name, F.col("_p1") - F.col("_p0")).drop("_p1", "_p0", "_t")


class ClassTransform(_Base):
    """Predict whether arm and outcome agree, corrected for the share treated."""

    name = "class_transform"

    def fit(self, df, features):
        self.share = float(df.agg(F.avg("t")).first()[0])
        agree = F.when(F.col("t") == 1, F.col("y")).otherwise(1 - F.col("y"))
        self.model = self._learn(df.withColumn("_z", agree), features, "_z")
        return self

    def score(self, df, name="score"):
        return self.model.score(df, "_p").withColumn(
            name, F.col("_p") / self.share - (1 - F.col("_p")) / (1 - self.share)).drop("_p")


ALL = (OutcomePropensity, ResponseModel, TLearner, SLearner, ClassTransform)
UPLIFT, OUTCOME = (TLearner, SLearner, ClassTransform), (OutcomePropensity, ResponseModel)


def stacked_scores(train: DataFrame, test: DataFrame, features: Sequence[str],
                   classes=ALL, **options) -> DataFrame:
    """T13 input: (model, unit, t, y, score) rows of every targeter on the test half."""
    wide = test.select("unit", "t", "y", *features)
    for cls in classes:
        wide = cls(**options).fit(train, features).score(wide, f"_{cls.name}")
    return wide.select("unit", "t", "y", F.explode(F.array(*[
        F.struct(F.lit(c.name).alias("model"), F.col(f"_{c.name}").alias("score"))
        for c in classes])).alias("r")).select("unit", "t", "y", "r.*")


def _best(scores: DataFrame, names: Sequence[str], budget: float, sign: int) -> float:
    table = evaluate.evaluate_policy(
        scores.filter(F.col("model").isin(*names)), budget, by=["model"])
    return float(table.agg(F.max(sign * F.col("incremental_outcome"))).first()[0] or 0.0)


def one_split(df: DataFrame, features: Sequence[str], seed: int = 0, sign: int = 1,
              budget: float = 0.30, **options) -> DataFrame:
    """Risk and lift correlated under five definitions of risk, on one split.

    `pooled` and `control_same` share rows with the effect model; `pooled_half` halves the
    data; `control_indep` and `pooled_indep` take the risk from the other half of the
    training rows.
    """
    halves = cut(shaping.arm_split(df, "unit", 0.5, seed))
    train, test = halves.filter("NOT is_test"), halves.filter("is_test")
    part_a = uniform(f"half-{seed}-", "unit") < 0.5
    a, b = train.filter(part_a), train.filter(~part_a)

    def risk(rows: DataFrame, name: str, into: DataFrame) -> DataFrame:
        return OutcomePropensity(seed=seed, **options).fit(rows, features).score(into, name)

    full, half = TLearner(seed=seed, **options), TLearner(seed=seed, **options)
    w = full.fit(train, features).arms(test, "p1", "p0")
    w = half.fit(a, features).arms(w, "h1", "h0")
    w = risk(train, "r_pooled", w)
    w = risk(a, "r_half", w)
    w = risk(b, "r_indep", w)
    w = cut(risk(b.filter("t = 0"), "r_control", w))
    definitions = {"pooled": ("p1", "p0", "r_pooled"), "control_same": ("p1", "p0", "p0"),
                   "control_indep": ("h1", "h0", "r_control"),
                   "pooled_half": ("h1", "h0", "r_half"), "pooled_indep": ("h1", "h0", "r_indep")}
    cols = []
    for name, (p1, p0, r) in definitions.items():
        row = correlate.all_correlations(w, p1, p0, r, sign)
        keep = [c for c in row.columns if c != "n"]
        cols.append(row.select(F.struct(*[F.col(c).alias(f"{name}_{c}") for c in keep])).scalar())
    scores = cut(stacked_scores(train, test, features, seed=seed, **options))
    up = _best(scores.withColumn("score", sign * F.col("score")), [c.name for c in UPLIFT],
               budget, sign)
    out = _best(scores, [c.name for c in OUTCOME], budget, sign)
    base = w.agg(F.count(F.lit(1)).alias("n_test"), F.avg(
        (sign * (F.col("p1") - F.col("p0")) < 0).cast("double")).alias("predicted_negative"))
    base = base.select(F.lit(seed).alias("seed"), "*", F.lit(up).alias("best_uplift"),
                       F.lit(out).alias("best_outcome"),
                       F.lit(100.0 * (up - out) / max(abs(out), 1e-9)).alias("advantage_pct"),
                       (1000.0 * F.lit(up - out) / F.col("n_test")).alias("gain_per_1000"),
                       *[c.alias(f"_c{i}") for i, c in enumerate(cols)])
    return base.select(*[c for c in base.columns if not c.startswith("_c")],
                       *[f"_c{i}.*" for i in range(len(cols))])


def simple_split(df: DataFrame, features: Sequence[str], seed: int = 0, budget: float = 0.30,
                 **options) -> DataFrame:
    """Correlation of effect and risk, advantage and negative share on one split."""
    halves = cut(shaping.arm_split(df, "unit", 0.5, seed))
    train, test = halves.filter("NOT is_test"), halves.filter("is_test")
    scores = cut(stacked_scores(train, test, features, seed=seed, **options))
    up = _best(scores, [c.name for c in UPLIFT], budget, 1)
    out = _best(scores, [c.name for c in OUTCOME], budget, 1)
    wide = scores.groupBy("unit").pivot("model", ["t_learner", "outcome_propensity"]).agg(
        F.first("score"))
    corr = correlate.pearson(wide, "t_learner", "outcome_propensity")
    neg = wide.agg(F.avg((F.col("t_learner") < 0).cast("double"))).scalar()
    return corr.select(F.col("pearson").alias("correlation"),
                       F.lit(100.0 * (up - out) / max(abs(out), 1e-9)).alias("advantage_pct"),
                       neg.alias("predicted_negative"))


def small_n_sweep(df: DataFrame, features: Sequence[str], sizes: Sequence[int],
                  seeds: Sequence[int], budget: float = 0.30, classes=ALL, **options
                  ) -> DataFrame:
    """Fixed test half, shrinking stratified training sets, every method on each.

    Training rows of a cell number a few thousand; scores are stacked over cells and methods,
    so that the evaluation of a seed is one grouped job.
    """
    out = None
    for seed in seeds:
        halves = cut(shaping.arm_split(df, "unit", 0.5, seed))
        train, test = halves.filter("NOT is_test"), halves.filter("is_test")
        base = evaluate.random_baseline(test, budget, 50, 1000 + seed).select(
            F.lit(None).cast("int").alias("train_size"), F.lit("random").alias("method"),
            F.lit(seed).alias("seed"), "uplift_per_contact",
            F.col("incremental_outcome").alias("incremental"))
        parts = [base]
        rows = train.count()
        for n in sizes:
            if rows < n:
                continue  # a smaller sample must not pass as the larger
            sample = cut(shaping.arm_sample(train, "unit", n, seed))
            ok = sample.agg(F.count_distinct("t"), F.count_distinct("y")).first()
            if ok[0] < 2 or ok[1] < 2:
                continue  # an arm or an outcome is gone: no method can be fitted
            scores = stacked_scores(sample, test, features, classes, seed=seed, **options)
            parts.append(evaluate.evaluate_policy(scores, budget, by=["model"]).select(
                F.lit(n).alias("train_size"), F.col("model").alias("method"),
                F.lit(seed).alias("seed"), "uplift_per_contact",
                F.col("incremental_outcome").alias("incremental")))
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def temporal_churn(panel: DataFrame, features: Sequence[str], month: int, **options
                   ) -> tuple[DataFrame, DataFrame]:
    """Train on months before the decision month, score it, AUC on that month."""
    from .leakage import auc
    train = panel.filter(F.col("month") < month)
    now = panel.filter(F.col("month") == month)
    model = models.boosted(train, features, "churn_voluntary", **options)
    scored = model.score(now, "risk")
    return scored, auc(scored, "risk", "churn_voluntary")
