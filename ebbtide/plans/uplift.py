"""Queries that evaluate rankings on the randomised trial."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate, evaluate
from ..operators.churn import union_all
from ..sources import canonical as src
from .churn import rounded
from .registry import query

RANK = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, unit) AS rk,
  count(*) OVER (PARTITION BY model) AS n FROM m),
"""
STACK = """
m AS (SELECT 'planted' AS model, unit, t, y, score FROM c_scored
  UNION ALL SELECT 'spend', unit, t, y, x2 FROM c_scored
  UNION ALL SELECT 'orders', unit, t, y, x1 FROM c_scored)"""
CURVE = f"""
WITH {STACK.strip()},
{RANK.strip()[5:]}
f AS (SELECT model, n, j * 0.05::DOUBLE AS frac FROM (SELECT DISTINCT model, n FROM r), range(0, 21) g(j)),
k AS (SELECT model, frac, CAST(round_even(frac * n, 0) AS BIGINT) AS k FROM f),
c AS (SELECT k.model, frac, k, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS u
  FROM k LEFT JOIN r ON r.model = k.model AND r.rk <= k.k GROUP BY 1, 2, 3)"""


def stacked(spark, d):
    s = src.scored(spark, d)
    return s.select("unit", "t", "y", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score"))
        for m, c in (("planted", "score"), ("spend", "x2"), ("orders", "x1"))])).alias("r")
    ).select("unit", "t", "y", "r.*")


@query("subgroup_effect", "T1", """
SELECT c_mktsegment AS segment, count(*) FILTER (x1 >= 5) AS n_selected,
  round(avg(y) FILTER (t = 1 AND x1 >= 5) - avg(y) FILTER (t = 0 AND x1 >= 5), 6) AS uplift
FROM c_trial GROUP BY 1
UNION ALL SELECT 'one arm only', count(*) FILTER (t = 1), NULL FROM c_trial""")
def _subgroup(spark, d):
    t = src.trial(spark, d).withColumnRenamed("c_mktsegment", "segment")
    a = evaluate.uplift_of_set(t, F.col("x1") >= 5, ["segment"])
    b = evaluate.uplift_of_set(t, F.col("t") == 1).select(
        F.lit("one arm only").alias("segment"), "n_selected", "uplift")
    return rounded(a.unionByName(b))


@query("top_k_selection", "T2", """
SELECT unit, rk <= round_even(0.3 * n, 0) AS selected FROM (SELECT unit,
  row_number() OVER (ORDER BY score DESC, unit) AS rk, count(*) OVER () AS n FROM c_scored)""")
def _top(spark, d):
    return evaluate.select_top(src.scored(spark, d), 0.3).select("unit", "selected")


@query("policy_evaluation", "T3", f"""
WITH {STACK.strip()},
{RANK.strip()[5:]}
s AS (SELECT model, count(*) AS k, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS u
  FROM r WHERE rk <= round_even(0.3 * n, 0) GROUP BY 1)
SELECT model, k AS n_targeted, round(u, 6) AS uplift_per_contact, round(u * k, 6) AS incremental_outcome FROM s""")
def _evaluate(spark, d):
    return rounded(evaluate.evaluate_policy(stacked(spark, d), 0.3, by=["model"]))


@query("policy_bootstrap", "T3")
def _bootstrap(spark, d):
    return evaluate.bootstrap(stacked(spark, d), 0.3, by=["model"])


@query("qini_curve", "T4", CURVE + """
SELECT model, round(frac, 6) AS budget_fraction, k AS n_targeted, round(u, 6) AS uplift_per_contact,
  round(u * k, 6) AS incremental_outcome FROM c""")
def _qini(spark, d):
    return rounded(evaluate.qini_curve(stacked(spark, d), by=["model"]))


QINI = CURVE + """,
p AS (SELECT model, frac, u * k AS v FROM c WHERE u IS NOT NULL),
o AS (SELECT model, frac, v - frac * last_value(v) OVER (PARTITION BY model ORDER BY frac
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g FROM p),
l AS (SELECT model, (g + lag(g) OVER w) / 2 * (frac - lag(frac) OVER w) AS a FROM o
  WINDOW w AS (PARTITION BY model ORDER BY frac)),
q AS (SELECT model, sum(a) AS qini FROM l GROUP BY 1)"""


@query("qini_coefficient", "T5", QINI + " SELECT model, round(qini, 6) AS qini FROM q")
def _coefficient(spark, d):
    return rounded(evaluate.qini_coefficient(
        evaluate.qini_curve(stacked(spark, d), by=["model"]), ["model"]))


@query("abstention_sweep", "T6", """
SELECT round(thr, 6) AS threshold, count(*) FILTER (score > thr) AS n_targeted,
  round(count(*) FILTER (score > thr) / count(*), 6) AS share_targeted,
  round(avg(y) FILTER (t = 1 AND score > thr) - avg(y) FILTER (t = 0 AND score > thr), 6) AS uplift_per_contact,
  round((avg(y) FILTER (t = 1 AND score > thr) - avg(y) FILTER (t = 0 AND score > thr))
    * count(*) FILTER (score > thr), 6) AS incremental_outcome
FROM (SELECT score + unit * 1e-7 AS score, t, y FROM c_scored), (SELECT unnest(quantile_cont(score + unit * 1e-7, ["""
       + ", ".join(f"0.95 * {j} / 19" for j in range(20)) + """])) AS thr FROM c_scored) GROUP BY thr""")
def _sweep(spark, d):
    s = src.scored(spark, d).withColumn("score", F.col("score") + F.col("unit") * 1e-7)
    return rounded(evaluate.abstention_sweep(s))


@query("random_targeting", "T7")
def _random(spark, d):
    return evaluate.random_baseline(src.trial(spark, d), 0.3)


@query("targeter_benchmark", "T13", QINI + """,
s AS (SELECT model, count(*) AS k, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS u
  FROM r WHERE rk <= round_even(0.3 * n, 0) GROUP BY 1),
z AS (SELECT (avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0)) * 0.3 * count(*) AS base FROM c_trial)
SELECT s.model, k AS n_targeted, round(u, 6) AS uplift_per_contact, round(u * k, 6) AS incremental_outcome,
  round(qini, 6) AS qini, CASE WHEN u * k < base THEN 'worse than random' ELSE 'better than random' END AS verdict
FROM s JOIN q USING (model), z""")
def _benchmark(spark, d):
    """The baseline here is the expectation of random targeting: the average effect times k."""
    from ..operators.shaping import trial_summary
    t = trial_summary(src.trial(spark, d)).select(F.col("ate") * 0.3 * F.col("n")).scalar()
    table = evaluate.benchmark_table(stacked(spark, d), 0.3)
    return rounded(evaluate.verdict(table, t))


@query("benefit_scales", "T14", """
WITH p AS (SELECT unit, p0, p0 + tau / 3 AS p1 FROM c_scored),
l AS (SELECT *, least(greatest(p0, 1e-4), 1 - 1e-4) AS a, least(greatest(p1, 1e-4), 1 - 1e-4) AS b FROM p)
SELECT unit, round(-(p1 - p0), 6) AS prob, round(-(ln(b / (1 - b)) - ln(a / (1 - a))), 6) AS logodds FROM l""")
def _benefits(spark, d):
    b = correlate.benefits(F.col("p0") + F.col("tau") / 3, F.col("p0"), -1)
    return src.scored(spark, d).select("unit", *[F.round(e, 6).alias(k) for k, e in b.items()])


@query("risk_lift_correlation", "T14 T15", """
WITH x AS (SELECT *, -tau AS a, rank() OVER (ORDER BY -tau) + (count(*) OVER (PARTITION BY tau) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY p0) + (count(*) OVER (PARTITION BY p0) - 1) / 2.0 AS rb FROM c_scored)
SELECT c_mktsegment AS segment, round(corr(a, p0), 6) AS pearson FROM x GROUP BY 1
UNION ALL SELECT 'flat', NULL
UNION ALL SELECT 'spearman', round(corr(ra, rb), 6) FROM x""")
def _correlation(spark, d):
    s = src.scored(spark, d).select(F.col("c_mktsegment").alias("segment"), (-F.col("tau"))
                                    .alias("a"), "p0", F.lit(0.25).alias("flat"))
    return rounded(union_all([
        correlate.pearson(s, "a", "p0", ["segment"]).select("segment", "pearson"),
        correlate.pearson(s, "a", "flat").select(F.lit("flat").alias("segment"), "pearson"),
        correlate.spearman(s, "a", "p0").select(F.lit("spearman").alias("segment"),
                                                F.col("spearman").alias("pearson"))]))


@query("split_summary", "T18", """
WITH w AS (SELECT n_customers, seed, max(value) FILTER (policy = 'treat_all') AS a,
  max(value) FILTER (policy = 'random_30pct') AS b FROM c_draws GROUP BY 1, 2),
l AS (SELECT n_customers AS setting, 'treat_all' AS measure, a AS v FROM w
  UNION ALL SELECT n_customers, 'step', a - b FROM w)
SELECT setting, measure, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low,
  round(quantile_cont(v, 0.975), 6) AS high, count(v) AS splits, round(stddev_samp(v), 6) AS sd
FROM l GROUP BY 1, 2""")
def _splits(spark, d):
    w = (src.draws(spark, d).groupBy(F.col("n_customers").alias("setting"), "seed")
         .pivot("policy", ["treat_all", "random_30pct"]).agg(F.first("value"))
         .withColumnRenamed("treat_all", "treat_all_v")
         .withColumnRenamed("random_30pct", "random_v"))
    w = correlate.with_steps(w, {"step": ("treat_all", "random")}, "v")
    return rounded(correlate.summarise(w.withColumnRenamed("treat_all_v", "treat_all"),
                                       ["treat_all", "step"]))


@query("paired_win_rates", "T20", """
WITH r AS (SELECT n_customers, seed, value AS base FROM c_draws WHERE policy = 'random_30pct')
SELECT n_customers, policy AS method, count(*) FILTER (value > base) AS wins, count(*) AS draws,
  round(count(*) FILTER (value > base) / count(*), 6) AS win_rate
FROM c_draws JOIN r USING (n_customers, seed) WHERE policy <> 'random_30pct' GROUP BY 1, 2""")
def _wins(spark, d):
    return rounded(correlate.win_rates(
        src.draws(spark, d), ["do_nothing", "treat_all", "top_k_money", "abstention_money"],
        base="random_30pct"))


def _tail(k, p):
    """P(X >= k) of a binomial of `draws` and `p`, as SQL text."""
    return (f"list_sum(list_transform(range({k}, draws + 1), lambda i: exp(lgamma(draws + 1) - lgamma(i + 1) "
            f"- lgamma(draws - i + 1) + i * ln({p}) + (draws - i) * ln(1 - {p}))))")


@query("win_rate_intervals", "T20 T21", f"""
WITH RECURSIVE p AS (SELECT n_customers, seed, max(value) FILTER (policy = 'random_30pct') AS base,
  max(value) FILTER (policy = 'treat_all') AS a, max(value) FILTER (policy = 'top_k_money') AS b,
  max(value) FILTER (policy = 'abstention_money') AS c FROM c_draws GROUP BY 1, 2),
l AS (SELECT n_customers, 'treat_all' AS method, a AS v, base FROM p UNION ALL SELECT n_customers, 'top_k_money', b, base FROM p
  UNION ALL SELECT n_customers, 'abstention_money', c, base FROM p),
w AS (SELECT n_customers, method, count(*) FILTER (v > base) AS wins, count(*) AS draws FROM l WHERE base IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, 0 AS step, 0.0::DOUBLE AS a0, 1.0::DOUBLE AS a1, 0.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM w
  UNION ALL SELECT n_customers, method, wins, draws, step + 1,
    CASE WHEN {_tail('wins', '((a0 + a1) / 2)')} < 0.025 THEN (a0 + a1) / 2 ELSE a0 END,
    CASE WHEN {_tail('wins', '((a0 + a1) / 2)')} < 0.025 THEN a1 ELSE (a0 + a1) / 2 END,
    CASE WHEN wins < draws AND 1 - {_tail('wins + 1', '((b0 + b1) / 2)')} > 0.025 THEN (b0 + b1) / 2 ELSE b0 END,
    CASE WHEN wins < draws AND 1 - {_tail('wins + 1', '((b0 + b1) / 2)')} > 0.025 THEN b1 ELSE (b0 + b1) / 2 END
  FROM s WHERE step < 45)
SELECT n_customers, method, wins, draws, round(wins / draws, 6) AS win_rate,
  CASE WHEN wins = 0 THEN 0.0 ELSE round(a0, 6) END AS low, CASE WHEN wins = draws THEN 1.0 ELSE round(b0, 6) END AS high
FROM s WHERE step = 45""")
def _intervals(spark, d):
    w = correlate.win_rates(src.draws(spark, d), ["treat_all", "top_k_money",
                                                  "abstention_money"], base="random_30pct")
    return rounded(correlate.with_interval(w, "wins", "draws"))


@query("spread_by_size", "T22", """
SELECT n_customers, policy, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
  round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(stddev_samp(value) / greatest(abs(avg(value)), 1e-9), 6) AS cv FROM c_draws GROUP BY 1, 2""")
def _spread(spark, d):
    return rounded(correlate.spread(src.draws(spark, d)))


@query("uplift_outcome_crossover", "T22", """
WITH m AS (SELECT n_customers, policy, avg(value) AS v FROM c_draws GROUP BY 1, 2),
b AS (SELECT n_customers, max(v) FILTER (policy IN ('abstention_money', 'do_nothing')) AS u,
  max(v) FILTER (policy IN ('treat_all', 'top_k_money')) AS o FROM m GROUP BY 1)
SELECT max(n_customers) FILTER (u < o) AS crossover FROM b""")
def _crossover(spark, d):
    return correlate.crossover(correlate.spread(src.draws(spark, d)),
                               ["abstention_money", "do_nothing"], ["treat_all", "top_k_money"])
