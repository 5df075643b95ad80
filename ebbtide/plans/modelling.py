"""Queries that fit models: targeters, the effect model, offers. Rows and properties only,
apart from the parts that are exact given coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, effect, evaluate, reasons, shaping, targeters
from ..session import cut
from ..sources import canonical as src
from .churn import rounded
from .registry import query

X = ["x1", "x2", "x3"]


@query("standardised_design", "B1 B2", """
WITH m AS (SELECT avg(x1) AS a1, stddev_pop(x1) AS s1, avg(x2) AS a2, stddev_pop(x2) AS s2 FROM c_trial)
SELECT unit, 1.0::DOUBLE AS z0, round((x1 - a1) / s1, 6) AS z1, round((x2 - a2) / s2, 6) AS z2, t::DOUBLE AS z3,
  round(t * (x1 - a1) / s1, 6) + 0.0 AS z4, round(t * (x2 - a2) / s2, 6) + 0.0 AS z5 FROM c_trial, m""")
def _design(spark, d):
    t = src.trial(spark, d)
    z = effect.design(effect.standardised(effect.moments(t, X[:2]), X[:2]), "t")
    return t.select("unit", *[(F.round(z[i], 6) + 0.0).alias(f"z{i}") for i in range(6)])


@query("effect_contributions", "B8", """
WITH m AS (SELECT avg(x1) AS a1, stddev_pop(x1) AS s1, avg(x2) AS a2, stddev_pop(x2) AS s2 FROM c_trial)
SELECT unit, round(0.4 * (x1 - a1) / s1, 6) AS c1, round(-0.2 * (x2 - a2) / s2, 6) AS c2 FROM c_trial, m""")
def _contributions(spark, d):
    t = src.trial(spark, d)
    xs = effect.standardised(effect.moments(t, X[:2]), X[:2])
    c = reasons.contributions(xs, [0.4, -0.2])
    return t.select("unit", F.round(c[0], 6).alias("c1"), F.round(c[1], 6).alias("c2"))


@query("pooled_prior", "B10", """
WITH f AS (SELECT c_nationkey, avg(tau) AS tau0, var_pop(tau) / count(*) AS tau0_var FROM c_scored GROUP BY 1)
SELECT round(avg(tau0), 6) AS prior_mean, round(sqrt(greatest(var_samp(tau0) + avg(tau0_var), 1e-6)) * 0.5, 6) AS prior_sd FROM f""")
def _pool(spark, d):
    f = src.scored(spark, d).groupBy("c_nationkey").agg(
        F.avg("tau").alias("tau0"), (F.var_pop("tau") / F.count(F.lit(1))).alias("tau0_var"))
    return rounded(effect.pooled_prior(f, 0.5))


@query("effect_posterior", "B3 B4 B5 B6 B7")
def _posterior(spark, d):
    t = src.trial(spark, d)
    return effect.EffectModel.fit(t, X).posterior(t).drop("c_mktsegment")


@query("effect_money_posterior", "B9 M2 M3 M4")
def _money(spark, d):
    s = src.scored(spark, d)
    decide.check_money(s, "value", ["cost"])
    m = effect.EffectModel.fit(s, X).money(s, "value", "cost")
    return m.select("unit", "mean", "sd", "prob_positive", "low", "delta_p",
                    decide.abstain_rule(F.col("prob_positive"), 0.3).alias("treat"))


@query("gaussian_abstention", "M5", """
WITH s AS (SELECT unit, -tau * value - cost AS money, (0.05 + x3 / 10) * value AS sd FROM c_scored),
z AS (SELECT *, CASE WHEN sd <= 1e-12 THEN NULL ELSE least(greatest(money / sd, -9.0), 9.0) END AS z FROM s),
c AS (SELECT *, CASE WHEN z IS NULL THEN CAST(money > 0 AS DOUBLE) WHEN z = 0 THEN 0.5 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi())
  * list_sum(list_transform(range(0, 140), lambda k: exp((2 * k + 1) * ln(abs(z)) - lgamma(2 * k + 2) + k * ln(2.0::DOUBLE) + lgamma(k + 1)))) END AS c FROM z)
SELECT unit, round(money, 6) AS expected_value, round(c, 6) AS confidence, c > 0.7 AS treat FROM c""")
def _gaussian(spark, d):
    s = src.scored(spark, d).withColumn("sd", 0.05 + F.col("x3") / 10)
    return rounded(effect.gaussian_rule(s, "tau", "sd", "value", "cost", 0.3).select(
        "unit", "expected_value", "confidence", "treat"))


@query("tenant_effects", "B11 B10")
def _tenants(spark, d):
    return effect.fit_groups(src.trial(spark, d), "c_mktsegment", X)


@query("offer_ladder", "M8 M9")
def _ladder(spark, d):
    s = src.scored(spark, d).withColumn("arm", (F.col("unit") % 3).cast("int"))
    s = s.withColumn("cost_0", F.col("cost") / 10).withColumn("cost_1", F.col("cost") / 5)
    ladder = effect.OfferLadder.fit(s, X, 2)
    v = ladder.value_offers(s, "value", ["cost_0", "cost_1"], 0.1)
    return decide.recommend(v, "values", "conf", 0.3).select(
        "unit", "rung", "expected_value", "confidence_chosen", "budget_trimmed")


@query("fitted_targeters", "T8 T9 T10 T11 T12 T13")
def _targeters(spark, d):
    halves = cut(shaping.arm_split(src.trial(spark, d), "unit"))
    scores = cut(targeters.stacked_scores(halves.filter("NOT is_test"), halves.filter("is_test"),
                                          X))
    base = evaluate.random_baseline(halves.filter("is_test"), 0.3).select(
        "incremental_outcome").first()[0]
    return evaluate.verdict(evaluate.benchmark_table(scores, 0.3), base or 0.0)


@query("risk_definitions", "T16")
def _risk(spark, d):
    return targeters.one_split(src.trial(spark, d), X, seed=1, learner="logistic")


@query("risk_lift_simple", "T17")
def _simple(spark, d):
    return targeters.simple_split(src.trial(spark, d), X, seed=1, learner="logistic")


@query("small_sample_sweep", "T19")
def _small(spark, d):
    return targeters.small_n_sweep(src.trial(spark, d), X, [200, 400], [0, 1], learner="logistic",
                                   classes=(targeters.OutcomePropensity, targeters.TLearner))


@query("temporal_churn_model", "T23")
def _temporal(spark, d):
    p = src.panel(spark, d)
    _, auc = targeters.temporal_churn(p, ["mrr", "annual", "sessions", "failures_ltd"], 6)
    return auc
