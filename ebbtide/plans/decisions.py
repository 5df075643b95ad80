"""Queries for decisions, campaign sizes, holdouts and comparisons of policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.tails import z
from ..operators import campaign, decide, evaluate, holdout, reasons
from ..operators.churn import union_all
from ..sources import canonical as src
from .churn import rounded
from .registry import query
from .sqltext import u

MONEY = "(-tau * value - cost)"
ARMS = 3


def money():
    return -F.col("tau") * F.col("value") - F.col("cost")


def draws_array(n=8):
    """Eight effect draws around tau, as a stand-in posterior with exact values."""
    return F.array(*[F.col("tau") + (j - 3.5) / 40.0 + (F.col("unit") % 5) / 100.0
                     for j in range(n)])


DRAWS = ("list_transform([" + ", ".join(f"tau + {j - 3.5} / 40.0 + (unit % 5) / 100.0" for j in range(8))
         + "], lambda d: -d * value - cost)")


@query("log_odds_to_probability", "M1", """
SELECT unit, round(1 / (1 + exp(-(ln(p0 / (1 - p0)) + tau * 8))) - p0, 6) AS delta_p FROM c_scored""")
def _expit(spark, d):
    p = F.col("p0")
    return src.scored(spark, d).select("unit", F.round(decide.probability_effect(
        F.ln(p / (1 - p)), F.col("tau") * 8), 6).alias("delta_p"))


@query("money_posterior_summary", "M2 M3 M4", f"""
WITH s AS (SELECT unit, {DRAWS} AS a FROM c_scored)
SELECT unit, round(list_avg(a), 6) AS mean, round(list_stddev_samp(a), 6) AS sd,
  round(len(list_filter(a, lambda x: x > 0)) / 8, 6) AS prob_positive,
  round(list_aggregate(a, 'quantile_cont', 0.05), 6) AS low,
  len(list_filter(a, lambda x: x > 0)) / 8 > 0.7 AS treat FROM s""")
def _posterior(spark, d):
    s = src.scored(spark, d).withColumn("a", decide.benefit_draws(
        draws_array(), F.col("value"), F.col("cost")))
    out = decide.summarise_draws(s, "a", ["unit"])
    return rounded(out).withColumn("treat", decide.abstain_rule(F.col("prob_positive"), 0.3))


@query("budgeted_abstention", "M6", f"""
WITH s AS (SELECT unit, round({MONEY}, 9) AS m, count(*) OVER () AS n FROM c_scored),
r AS (SELECT *, row_number() OVER (ORDER BY m > 0 DESC, m DESC, unit) AS rk FROM s)
SELECT unit, m > 0 AS cleared, m > 0 AND rk <= round_even(0.1 * n, 0) AS treat FROM r""")
def _budget(spark, d):
    s = src.scored(spark, d).select("unit", F.round(money(), 9).alias("m"))
    return decide.apply_budget(s.withColumn("cleared", F.col("m") > 0), "cleared", "m", 0.1
                               ).select("unit", "cleared", "treat")


@query("top_by_expected_money", "M7", f"""
SELECT unit, row_number() OVER (ORDER BY round({MONEY}, 9) DESC, unit)
  <= round_even(0.3 * count(*) OVER (), 0) AS treat FROM c_scored""")
def _top_money(spark, d):
    return decide.top_by_money(src.scored(spark, d), F.round(money(), 9), 0.3).select(
        "unit", "treat")


def multi_arm(spark, d):
    """Three offers per customer; offer 1 cannot be estimated for customers in segment 4."""
    s = src.scored(spark, d)
    uu = ((F.col("unit") * 15485863) % 1009) / 1009.0
    for k in range(ARMS):
        tau = F.col("tau") + ((F.col("unit") * (k + 3)) % 41 - 20) / 200.0
        s = (s.withColumn(f"tau_{k}", tau).withColumn(f"cost_{k}", F.col("cost") * (k + 1) / 2.0)
             .withColumn(f"y1_{k}", (uu < F.col("p0") + tau).cast("int")))
    v = [F.round(-F.col(f"tau_{k}") * F.col("value") - F.col(f"cost_{k}"), 9) for k in range(ARMS)]
    v[1] = F.when(F.col("c_nationkey") % 5 != 4, v[1])
    conf = [F.round(0.9 - F.abs(F.col(f"tau_{k}")), 6) for k in range(ARMS)]
    return s.withColumn("values", F.array(*v)).withColumn("conf", F.array(*conf)).withColumn(
        "costs", F.array(*[F.col(f"cost_{k}") for k in range(ARMS)]))


_T = [f"(tau + ((unit * {k + 3}) % 41 - 20) / 200.0::DOUBLE)" for k in range(ARMS)]
_C = [f"(cost * {k + 1} / 2.0::DOUBLE)" for k in range(ARMS)]
_V = [f"round(-{t} * value - {c}, 9)" for t, c in zip(_T, _C)]
ARM_SQL = f"""
a AS (SELECT *, count(*) OVER () AS n, {_T[0]} AS t0, {_T[1]} AS t1, {_T[2]} AS t2,
  {_C[0]} AS c0, {_C[1]} AS c1, {_C[2]} AS c2, {_V[0]} AS v0,
  CASE WHEN c_nationkey % 5 <> 4 THEN {_V[1]} END AS v1, {_V[2]} AS v2 FROM c_scored),
b AS (SELECT *, greatest(v0, v1, v2) AS best,
  CASE WHEN v0 = greatest(v0, v1, v2) THEN 0 WHEN v1 = greatest(v0, v1, v2) THEN 1 ELSE 2 END AS pos FROM a),
k AS (SELECT *, best > 0 AND row_number() OVER (ORDER BY best > 0 DESC, best DESC, unit) <= round_even(0.05 * n, 0) AS keep FROM b),
rec AS (SELECT *, CASE WHEN keep THEN pos ELSE -1 END AS rung, CASE WHEN keep THEN best ELSE 0 END AS expected_value,
  CASE WHEN keep THEN round(0.9 - abs(CASE pos WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END), 6) ELSE 0 END AS confidence_chosen,
  best > 0 AND NOT keep AS budget_trimmed FROM k)"""


def recommended(spark, d):
    return decide.recommend(multi_arm(spark, d), "values", "conf", 0.05)


@query("offer_recommendation", "M9", f"""
WITH {ARM_SQL.strip()} SELECT unit, CAST(rung AS INTEGER) AS rung, round(expected_value, 6) AS expected_value,
  confidence_chosen, budget_trimmed FROM rec""")
def _recommend(spark, d):
    return rounded(recommended(spark, d).select("unit", "rung", "expected_value",
                                                "confidence_chosen", "budget_trimmed"))


@query("offer_counts", "M10", f"""
WITH {ARM_SQL.strip()} SELECT o.offer, count(r.unit) AS n FROM (VALUES ('no offer', -1), ('nudge', 0),
  ('pause', 1), ('discount', 2), ('upgrade', 3)) o(offer, k) LEFT JOIN rec r ON r.rung = o.k GROUP BY 1""")
def _counts(spark, d):
    return decide.offer_counts(recommended(spark, d), ["nudge", "pause", "discount", "upgrade"])


@query("recommendation_summary", "M12", f"""
WITH {ARM_SQL.strip()} SELECT count(*) FILTER (rung >= 0) AS acted, count(*) FILTER (budget_trimmed) AS trimmed,
  count(*) FILTER (rung < 0 AND NOT budget_trimmed) AS unprofitable,
  count(*) FILTER (rung >= 0 AND confidence_chosen < 0.6) AS thin,
  round(sum(expected_value), 4) AS total_gain FROM rec""")
def _summary(spark, d):
    return rounded(decide.recommendation_summary(recommended(spark, d)), 4)


GAMMA = (0.02, -0.05, 0.004)


@query("recommendation_reasons", "M11 B1 B8", f"""
WITH {ARM_SQL.strip()},
m AS (SELECT avg(x1) AS a1, greatest(stddev_pop(x1), 1e-9) AS s1, avg(x2) AS a2, greatest(stddev_pop(x2), 1e-9) AS s2,
  avg(x3) AS a3, greatest(stddev_pop(x3), 1e-9) AS s3 FROM c_scored),
g AS (SELECT r.*, 0.02 * (x1 - a1) / s1 AS g1, -0.05 * (x2 - a2) / s2 AS g2, 0.004 * (x3 - a3) / s3 AS g3 FROM rec r, m)
SELECT unit, CASE rung WHEN 0 THEN 'nudge' WHEN 1 THEN 'pause' WHEN 2 THEN 'discount' END AS action,
  CASE WHEN rung < 0 THEN CASE WHEN budget_trimmed THEN 'over_budget' ELSE 'no_gain' END END AS why_not,
  CASE WHEN rung >= 0 THEN CASE WHEN abs(g1) + abs(g2) + abs(g3) < 0.1 * 0.3 THEN 'average' WHEN g1 + g2 + g3 > 0 THEN 'against' ELSE 'for' END END AS profile,
  CASE WHEN rung >= 0 AND abs(g1) + abs(g2) + abs(g3) >= 0.1 * 0.3 THEN 3 END AS n_drivers,
  CASE WHEN rung >= 0 AND abs(g1) + abs(g2) + abs(g3) >= 0.1 * 0.3 THEN round(greatest(abs(g1), abs(g2), abs(g3)) / (abs(g1) + abs(g2) + abs(g3)), 6) END AS top_share,
  CASE WHEN rung >= 0 THEN CASE WHEN confidence_chosen < 0.6 THEN 'thin' WHEN expected_value < 1 THEN 'small' END END AS caveat,
  CASE WHEN rung >= 0 THEN round(best - greatest(CASE WHEN pos <> 0 THEN v0 END, CASE WHEN pos <> 1 THEN v1 END, CASE WHEN pos <> 2 THEN v2 END), 6) END AS gap FROM g""")
def _reasons(spark, d):
    from ..operators.effect import moments, standardised
    r = recommended(spark, d)
    xs = standardised(moments(r, ["x1", "x2", "x3"]), ["x1", "x2", "x3"])
    r = (r.withColumn("xs", xs).withColumn("parts", reasons.contributions(F.col("xs"), GAMMA))
         .withColumn("risk", F.col("p0")).withColumn("delta_p", F.col("tau")))
    e = reasons.explain(r, ["orders_before", "mrr", "share_lost"], ["nudge", "pause", "discount"],
                        0.3)
    return e.select(
        "unit", "action", "why_not", "profile",
        F.when(F.col("drivers").isNotNull(), F.size("drivers")).alias("n_drivers"),
        F.round(F.col("drivers")[0]["share"], 6).alias("top_share"), "caveat",
        F.round("runner_up.gap", 6).alias("gap"))


PROFIT = """
WITH s AS (SELECT *, (1 - y) * value AS kept FROM c_scored),
w AS (SELECT unit, row_number() OVER o AS size, sum(t) OVER o AS n_t, sum(1 - t) OVER o AS n_c,
  sum(t * kept) OVER o AS k_t, sum((1 - t) * kept) OVER o AS k_c, sum(cost) OVER o AS c FROM s
  WINDOW o AS (ORDER BY score DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT unit, size, CAST(n_t AS BIGINT) AS n_treated, CAST(n_c AS BIGINT) AS n_control,
  CASE WHEN n_t >= 10 AND n_c >= 10 THEN size * (k_t / n_t - k_c / n_c - c / size) END AS profit FROM w)"""


@query("profit_curve", "M13", PROFIT + """
SELECT unit, size, n_treated, n_control, round(profit, 4) AS profit FROM p""")
def _profit(spark, d):
    return rounded(campaign.profit_curve(src.scored(spark, d)), 4)


@query("campaign_size", "M14", PROFIT + """,
b AS (SELECT (SELECT count(*) FROM p) AS n, size, profit FROM p
  WHERE profit IS NOT NULL AND size <= round_even(0.3 * (SELECT count(*) FROM p), 0)
  ORDER BY profit DESC, size LIMIT 1)
SELECT round(CASE WHEN profit > 0 THEN least(size / n, 0.3) ELSE 0 END, 6) AS fraction,
  round(CASE WHEN profit > 0 THEN profit ELSE 0 END, 4) AS profit FROM b""")
def _size(spark, d):
    c = campaign.choose_fraction(campaign.profit_curve(src.scored(spark, d)), 0.3)
    return c.select(F.round("fraction", 6).alias("fraction"), F.round("profit", 4).alias("profit"))


@query("campaign_can_act", "M17", """
WITH p AS (SELECT c_nationkey AS nation, count(*) AS n_pilot FROM customer GROUP BY 1)
SELECT nation, n_pilot, n_pilot - CAST(round_even(0.5 * n_pilot, 0) AS BIGINT) AS validation_size,
  round_even(0.3 * (n_pilot - round_even(0.5 * n_pilot, 0)), 0) >= 20 AS can_act FROM p""")
def _can_act(spark, d):
    p = src.raw(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("n_pilot"))
    return campaign.can_act(p, "n_pilot")


@query("two_stage_profit_targeting", "M15 M16")
def _two_stage(spark, d):
    """First stage per arm, then the profit loss."""
    from ..session import cut
    s, x = src.scored(spark, d), ["x1", "x2", "x3"]
    lifted = cut(campaign.FirstStage.fit(s, x).profit_lift(s, "value", "cost"))
    model = campaign.ProfitBoosting().fit(lifted, x, "profit_lift", "unit")
    return model.score(lifted.select("unit", *x), "profit_score").select("unit", "profit_score")


@query("decision_scores", "M18", f"""
WITH s AS (SELECT *, {MONEY} AS e, (y0 - y1) * value - cost AS r FROM c_scored),
p AS (SELECT 'do_nothing' AS policy, * FROM s WHERE false UNION ALL SELECT 'treat_all', * FROM s
  UNION ALL SELECT 'high_risk', * FROM s WHERE p0 > 0.7 UNION ALL SELECT 'oracle', * FROM s WHERE e > 0)
SELECT n.policy, count(p.unit) AS n_treated, round(coalesce(sum(e), 0), 4) AS expected_value,
  round(coalesce(sum(r), 0), 4) AS realised_value, round(coalesce(sum(cost), 0), 4) AS offer_spend,
  count(*) FILTER (y0 = 1 AND y1 = 0) AS saved, count(*) FILTER (y0 = 0 AND y1 = 1) AS harmed,
  round(coalesce(sum(e) / sum(cost), 0), 4) AS roi
FROM (VALUES ('do_nothing'), ('treat_all'), ('high_risk'), ('oracle')) n(policy) LEFT JOIN p ON p.policy = n.policy GROUP BY 1""")
def _scores(spark, d):
    return rounded(decide.score_decisions(src.scored(spark, d), {
        "do_nothing": F.lit(False), "treat_all": F.lit(True), "high_risk": F.col("p0") > 0.7,
        "oracle": money() > 0}), 4)


def rankings(spark, d):
    s = src.scored(spark, d).withColumn("gain", money())
    return s.select("unit", "c_nationkey", "gain", F.explode(F.array(*[
        F.struct(F.lit(n).alias("ranking"), c.alias("score")) for n, c in (
            ("churn_score", F.col("p0")), ("oracle_uplift", F.round("gain", 9)),
            ("random", uniform("rank-", "unit")))])).alias("r")).select(
        "unit", "c_nationkey", "gain", "r.*")


RANKINGS = f"""
s AS (SELECT *, {MONEY} AS gain FROM c_scored),
m AS (SELECT 'churn_score' AS ranking, unit, c_nationkey, gain, p0 AS score FROM s
  UNION ALL SELECT 'oracle_uplift', unit, c_nationkey, gain, round(gain, 9) FROM s
  UNION ALL SELECT 'random', unit, c_nationkey, gain, {u('rank-', 'unit')} FROM s)"""


@query("budget_curve", "M19", f"""
WITH {RANKINGS.strip()},
r AS (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, unit) AS rk,
  count(*) OVER (PARTITION BY ranking) AS n FROM m),
k AS (SELECT DISTINCT ranking, n, j * 0.05::DOUBLE AS frac FROM r, range(0, 21) g(j))
SELECT k.ranking, round(frac, 6) AS budget_fraction, CAST(round_even(frac * k.n, 0) AS BIGINT) AS n_targeted,
  round(coalesce(sum(gain), 0), 4) AS value FROM k LEFT JOIN r ON r.ranking = k.ranking
  AND r.rk <= round_even(frac * k.n, 0) GROUP BY 1, 2, 3""")
def _budget_curve(spark, d):
    c = campaign.budget_curve(rankings(spark, d), "gain")
    return c.select("ranking", F.round("budget_fraction", 6).alias("budget_fraction"),
                    "n_targeted", F.round("value", 4).alias("value"))


@query("mean_budget_curve", "M19", f"""
WITH {RANKINGS.strip()},
r AS (SELECT *, row_number() OVER (PARTITION BY ranking, c_nationkey ORDER BY score DESC, unit) AS rk,
  count(*) OVER (PARTITION BY ranking, c_nationkey) AS n FROM m),
k AS (SELECT DISTINCT ranking, c_nationkey, n, j * 0.05::DOUBLE AS frac FROM r, range(0, 21) g(j)),
v AS (SELECT k.ranking, k.c_nationkey, frac, coalesce(sum(gain), 0) AS value FROM k LEFT JOIN r
  ON r.ranking = k.ranking AND r.c_nationkey = k.c_nationkey AND r.rk <= round_even(frac * k.n, 0) GROUP BY 1, 2, 3)
SELECT ranking, round(frac, 6) AS budget_fraction, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd
FROM v GROUP BY 1, 2""")
def _mean_curve(spark, d):
    """Nations stand for seeds: one curve each, then the mean curve."""
    c = campaign.budget_curve(rankings(spark, d), "gain", ["ranking", "c_nationkey"])
    m = campaign.mean_curve(c)
    return m.select("ranking", F.round("budget_fraction", 6).alias("budget_fraction"),
                    F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


QUAD = """CASE WHEN tau <= -0.01 THEN 'persuadable' WHEN tau >= 0.01 THEN 'sleeping_dog'
  WHEN p0 > 0.5 THEN 'lost_cause' ELSE 'sure_thing' END"""


@query("quadrant_labels", "M20", f"""
SELECT unit, {QUAD} AS quadrant, CASE WHEN y0 = 0 AND y1 = 0 THEN 'sure_thing' WHEN y0 = 1 AND y1 = 0 THEN 'persuadable'
  WHEN y0 = 0 THEN 'sleeping_dog' ELSE 'lost_cause' END AS realised FROM c_scored""")
def _quadrants(spark, d):
    return src.scored(spark, d).select(
        "unit", decide.quadrant(F.col("tau"), F.col("p0")).alias("quadrant"),
        decide.realised_quadrant(F.col("y0"), F.col("y1")).alias("realised"))


@query("quadrant_shares", "M21", f"""
SELECT {QUAD} AS quadrant, round(count(*) / (SELECT count(*) FROM c_scored), 6) AS share,
  round(avg(tau), 6) AS mean_tau FROM c_scored GROUP BY 1""")
def _shares(spark, d):
    return rounded(decide.quadrant_shares(src.scored(spark, d)))


@query("risk_decile_mix", "M22", f"""
WITH r AS (SELECT {QUAD} AS q, row_number() OVER (ORDER BY p0 DESC, unit) AS rk, count(*) OVER () AS n FROM c_scored),
g AS (SELECT CAST(greatest(1, ceil((rk - 1) * 10 / (n - 1)::DOUBLE)) AS INTEGER) AS decile, q FROM r)
SELECT decile, round(avg(CAST(q = 'persuadable' AS DOUBLE)), 6) AS persuadable, round(avg(CAST(q = 'sure_thing' AS DOUBLE)), 6) AS sure_thing,
  round(avg(CAST(q = 'lost_cause' AS DOUBLE)), 6) AS lost_cause, round(avg(CAST(q = 'sleeping_dog' AS DOUBLE)), 6) AS sleeping_dog FROM g GROUP BY 1""")
def _deciles(spark, d):
    s = src.scored(spark, d).withColumn("q", decide.quadrant(F.col("tau"), F.col("p0")))
    return rounded(campaign.decile_mix(s, "p0", "q", ["persuadable", "sure_thing", "lost_cause",
                                                      "sleeping_dog"]))


@query("offer_economics", "M23", f"""
SELECT round(avg(tau), 6) AS mean_tau, round(quantile_cont(tau, 0.1), 6) AS p10_tau,
  round(quantile_cont(cost / nullif(value, 0), 0.5), 6) AS break_even, round(avg(CAST({MONEY} > 0 AS DOUBLE)), 6) AS pays_for,
  round(avg(CAST(tau > 0 AS DOUBLE)), 6) AS sleeping_dog, round(avg({MONEY}), 6) AS mean_value,
  round(sum({MONEY}) FILTER ({MONEY} > 0), 4) AS oracle_value, round(quantile_cont(cost, 0.5), 6) AS median_cost,
  avg(tau) BETWEEN -0.05 AND 0 AS in_band FROM c_scored""")
def _economics(spark, d):
    e = decide.economics(src.scored(spark, d))
    return rounded(rounded(e, 4, ["oracle_value"]))


@query("regret_matrix", "M24", """
WITH w AS (SELECT n_customers, avg(value) FILTER (policy = 'do_nothing') AS do_nothing,
  avg(value) FILTER (policy = 'treat_all') AS treat_all, avg(value) FILTER (policy = 'abstention_money') AS abstention_money
  FROM c_draws GROUP BY 1), b AS (SELECT *, greatest(do_nothing, treat_all, abstention_money) AS hi, least(do_nothing, treat_all, abstention_money) AS lo FROM w)
SELECT n_customers, round(do_nothing, 6) AS do_nothing, round(treat_all, 6) AS treat_all, round(abstention_money, 6) AS abstention_money,
  round((hi - do_nothing) / greatest(hi - lo, 1e-9), 6) AS regret_do_nothing, round((hi - treat_all) / greatest(hi - lo, 1e-9), 6) AS regret_treat_all,
  round((hi - abstention_money) / greatest(hi - lo, 1e-9), 6) AS regret_abstention_money FROM b""")
def _regret(spark, d):
    return rounded(decide.regret_matrix(src.draws(spark, d),
                                        ["do_nothing", "treat_all", "abstention_money"]))


@query("best_alpha_by_offer", "M25", f"""
WITH s AS (SELECT unit % 6 AS rung, {MONEY} AS m, len(list_filter({DRAWS}, lambda x: x > 0)) / 8 AS conf FROM c_scored),
v AS (SELECT rung, a AS alpha, coalesce(sum(m) FILTER (conf > 1.0::DOUBLE - a), 0) AS v FROM s, (VALUES (0.05::DOUBLE), (0.3::DOUBLE), (0.49::DOUBLE)) t(a) GROUP BY 1, 2),
g AS (SELECT rung, max(v) AS hi, min(v) AS lo, arg_max(alpha, (v, -alpha)) AS a FROM v GROUP BY 1)
SELECT rung, round(hi, 4) AS best_value, hi - lo > 1e-9 AS determinate, CASE WHEN hi - lo > 1e-9 THEN a END AS best_alpha FROM g""")
def _alpha(spark, d):
    s = src.scored(spark, d).withColumn("conf", decide.prob_positive(decide.benefit_draws(
        draws_array(), F.col("value"), F.col("cost"))))
    per = s.groupBy((F.col("unit") % 6).alias("rung")).agg(*[
        F.coalesce(F.sum(F.when(decide.abstain_rule(F.col("conf"), a), money())), F.lit(0.0))
        .alias(f"a{i}") for i, a in enumerate((0.05, 0.30, 0.49))])
    runs = per.selectExpr("rung", "stack(3, 0.05D, a0, 0.3D, a1, 0.49D, a2) AS (alpha, value)")
    out = decide.best_alpha(runs, "rung")
    return out.withColumn("best_value", F.round("best_value", 4))


@query("decision_rule_summary", "M26", """
WITH w AS (SELECT n_customers, seed, max(value) FILTER (policy = 'abstention_money') AS o, max(value) FILTER (policy = 'top_k_money') AS c,
  max(value) FILTER (policy = 'random_30pct') AS r, max(value) FILTER (policy = 'treat_all') AS a,
  max(n_treated) FILTER (policy = 'abstention_money') AS ok, max(n_treated) FILTER (policy = 'top_k_money') AS ck FROM c_draws GROUP BY 1, 2)
SELECT n_customers, count(*) AS seeds, round(avg(o), 6) AS abstain_mean, round(avg(c), 6) AS topk_mean, round(avg(r), 6) AS random_mean,
  round(avg(CAST(o > c AS INT)), 6) AS beats_topk, round(avg(CAST(o > r AS INT)), 6) AS beats_random, round(avg(CAST(o > 0 AS INT)), 6) AS abstain_positive,
  round(avg(CAST(o = 0 AS INT)), 6) AS abstain_ties, round(avg(CAST(o >= 0 AS INT)), 6) AS abstain_not_worse, round(avg(CAST(c > 0 AS INT)), 6) AS topk_positive,
  round(avg(a), 6) AS treat_all_mean, round(avg(CAST(a > 0 AS INT)), 6) AS treat_all_positive, round(avg(ok), 6) AS abstain_treated, round(avg(ck), 6) AS topk_treated
FROM w GROUP BY 1""")
def _rule(spark, d):
    return rounded(decide.rule_summary(src.draws(spark, d)))


@query("paired_comparison", "M27", """
WITH w AS (SELECT max(value) FILTER (policy = 'abstention_money') - max(value) FILTER (policy = 'do_nothing') AS g FROM c_draws GROUP BY n_customers, seed)
SELECT count(*) FILTER (g > 0) AS wins, count(*) FILTER (g = 0) AS ties, count(*) FILTER (g < 0) AS losses, round(avg(g), 6) AS mean_gap,
  count(*) FILTER (g <> 0) AS decided, round(count(*) FILTER (g > 0) / nullif(count(*) FILTER (g <> 0), 0), 6) AS rate FROM w""")
def _compare(spark, d):
    return rounded(decide.compare(src.draws(spark, d), "abstention_money", "do_nothing"))


@query("policy_table", "M28", """
SELECT n_customers, policy, count(*) AS draws, round(avg(value), 6) AS mean_value, round(avg(n_treated), 6) AS mean_treated,
  round(avg(CAST(n_treated = 0 AS INT)), 6) AS treats_nobody, count(*) FILTER (value > 0) AS beats,
  round(count(*) FILTER (value > 0) / count(*), 6) AS beats_nothing FROM c_draws GROUP BY 1, 2""")
def _policies(spark, d):
    return rounded(decide.by_policy(src.draws(spark, d)))


@query("policy_table_intervals", "M27 M28 T21")
def _policies_exact(spark, d):
    from ..operators.correlate import with_interval
    return with_interval(decide.by_policy(src.draws(spark, d)), "beats", "draws",
                         "beats_low", "beats_high")


@query("best_pilot_offer", "M29", """
WITH p AS (SELECT *, CAST(unit % 4 AS INTEGER) AS arm FROM c_scored),
z AS (SELECT avg(y) FILTER (arm = 0) AS y0, avg(value) AS v, avg(y) FILTER (arm = 1) AS a, avg(y) FILTER (arm = 2) AS b, avg(y) FILTER (arm = 3) AS c, avg(cost) AS k FROM p),
r AS (SELECT 0 AS rung, (y0 - a) * v - k / 20 AS m FROM z UNION ALL SELECT 1, (y0 - b) * v - k * 2 / 20 FROM z UNION ALL SELECT 2, (y0 - c) * v - k * 3 / 20 FROM z)
SELECT rung AS pilot_choice, round(m, 6) AS money, CASE WHEN m > 0 THEN rung ELSE -1 END AS choice_or_nothing FROM r ORDER BY m DESC, rung LIMIT 1""")
def _pilot(spark, d):
    p = src.scored(spark, d).withColumn("arm", (F.col("unit") % 4).cast("int"))
    for k in range(3):
        p = p.withColumn(f"k{k}", F.col("cost") * (k + 1) / 20)
    return rounded(decide.best_pilot_arm(p, 3, costs=["k0", "k1", "k2"]))


@query("assignment_values", "M30", f"""
WITH {ARM_SQL.strip()}, w AS (SELECT *, ((unit * 15485863) % 1009) / 1009.0::DOUBLE AS u1 FROM rec),
m AS (SELECT *, (y0 - CAST(u1 < p0 + t0 AS INT)) * value - c0 AS m0, (y0 - CAST(u1 < p0 + t1 AS INT)) * value - c1 AS m1,
  (y0 - CAST(u1 < p0 + t2 AS INT)) * value - c2 AS m2, -t0 * value - c0 AS e0, -t1 * value - c1 AS e1, -t2 * value - c2 AS e2 FROM w),
s AS (SELECT sum(CASE rung WHEN 0 THEN m0 WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE 0 END) AS assigned,
  sum(CASE WHEN greatest(e0, e1, e2) > 0 THEN CASE greatest(e0, e1, e2) WHEN e0 THEN m0 WHEN e1 THEN m1 ELSE m2 END ELSE 0 END) AS oracle_matched,
  sum(m0) AS s0, sum(m1) AS s1, sum(m2) AS s2 FROM m)
SELECT round(assigned, 4) AS assigned, round(oracle_matched, 4) AS oracle_matched, round(greatest(s0, s1, s2), 4) AS best_uniform,
  CAST(CASE greatest(s0, s1, s2) WHEN s0 THEN 0 WHEN s1 THEN 1 ELSE 2 END AS INTEGER) AS best_rung, round(least(s0, s1, s2), 4) AS worst_uniform FROM s""")
def _assignment(spark, d):
    return rounded(decide.assignment_values(recommended(spark, d), ARMS), 4)


@query("channel_economics", "M31", f"""
SELECT c_mktsegment AS channel, round(avg(tau), 6) AS mean_tau, round(avg(CAST(tau > 0 AS INT)), 6) AS harmed_share, round(sum({MONEY}), 4) AS treat_all_value,
  round(avg({MONEY}), 6) AS treat_all_per_customer, round(avg(CAST({MONEY} > 0 AS INT)), 6) AS oracle_share,
  round(coalesce(sum({MONEY}) FILTER ({MONEY} > 0), 0), 4) AS oracle_value, round(quantile_cont(cost, 0.5), 6) AS cost FROM c_scored GROUP BY 1""")
def _channels(spark, d):
    s = src.scored(spark, d).withColumnRenamed("c_mktsegment", "channel")
    e = decide.channel_economics(s, "channel")
    return rounded(rounded(e, 4, ["treat_all_value", "oracle_value"]))


@query("pending_sweep_cells", "M32", """
SELECT DISTINCT n_customers, seed FROM c_draws WHERE NOT (seed % 3 = 0 AND n_customers >= 1000)""")
def _pending(spark, d):
    runs = src.draws(spark, d)
    return decide.pending_cells(runs.select("n_customers", "seed").distinct(),
                                runs.filter("seed % 3 = 0 AND n_customers >= 1000"))


# --- holdouts ----------------------------------------------------------------------

@query("holdout_assignment", "H1", f"""
SELECT 'winter' AS experiment_id, CAST(c_custkey AS VARCHAR) AS customer_id,
  CASE WHEN {u('holdout-v1', 'c_custkey')} < 0.1 THEN 'holdout' ELSE 'treated' END AS arm FROM customer""")
def _holdout(spark, d):
    c = holdout.require_unique(src.customers(spark, d).select("customer_id"))
    return holdout.assign(c, "winter", F.lit("2024-01-01")).drop("assigned_at")


def ledger(spark, d):
    c = src.raw(spark, d, "customer").select(F.col("c_custkey").cast("string")
                                             .alias("customer_id"), "c_custkey")
    at = F.lit("2024-01-01")
    first = c.filter("c_custkey % 3 <> 0").drop("c_custkey")
    return holdout.assign(first, "winter", at), holdout.assign(c.drop("c_custkey"), "winter", at)


@query("ledger_additions", "H2 H3", f"""
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CASE WHEN {u('holdout-v1', 'c_custkey')} < 0.1 THEN 'holdout' ELSE 'treated' END AS arm
FROM customer WHERE c_custkey % 3 = 0""")
def _additions(spark, d):
    return holdout.arm_of(holdout.additions(*ledger(spark, d)), "winter")


@query("ledger_conflicts", "H2", f"""
SELECT CAST(c_custkey AS VARCHAR) AS customer_id FROM customer WHERE c_custkey % 3 <> 0
  AND ({u('holdout-v1', 'c_custkey')} < 0.1) <> ({u('other-salt', 'c_custkey')} < 0.1)""")
def _conflicts(spark, d):
    old, _ = ledger(spark, d)
    new = holdout.assign(src.customers(spark, d), "winter", F.lit("2024-01-02"), salt="other-salt")
    return holdout.conflicts(old, new).select("customer_id")


@query("ledger_summary", "H4", f"""
SELECT 'empty_arm' AS experiment_id, count(*) AS treated, CAST(0 AS BIGINT) AS holdout FROM customer WHERE {u('holdout-v1', 'c_custkey')} >= 0.1
UNION ALL SELECT 'winter', count(*) FILTER (NOT h), count(*) FILTER (h) FROM (SELECT {u('holdout-v1', 'c_custkey')} < 0.1 AS h FROM customer)""")
def _ledger_summary(spark, d):
    _, full = ledger(spark, d)
    other = full.filter("arm = 'treated'").withColumn("experiment_id", F.lit("empty_arm"))
    return holdout.ledger_summary(full.unionByName(other))


def outcomes(spark, d):
    return src.scored(spark, d).select(
        "unit", "value", (F.col("y") == 0).alias("retained"), "c_mktsegment", "c_nationkey",
        holdout.held_out("unit", 0.3).alias("held_out"), "tau", "y0", "y1")


Z = z(0.975)
H5 = """
WITH o AS (SELECT *, {h} AS h, {r} AS r FROM c_scored),
a AS (SELECT {by} count(*) FILTER (NOT h) AS nt, count(*) FILTER (h) AS nh, avg(r) FILTER (NOT h) AS p, avg(r) FILTER (h) AS q, avg(value) AS v FROM o {group}),
s AS (SELECT *, p - q AS lift, sqrt(p * (1 - p) / nt + q * (1 - q) / nh) AS se FROM a)"""


@query("incrementality", "H5 H6", H5.format(h=u("holdout-v1", "unit") + " < 0.3", r="1 - y", by="", group="") + f"""
SELECT nt AS n_treated, nh AS n_holdout, round(p, 6) AS retention_treated, round(q, 6) AS retention_holdout, round(lift, 6) AS lift,
  round(lift - {Z!r} * se, 6) AS lift_low, round(lift + {Z!r} * se, 6) AS lift_high, round(lift * v * nt - 0.5 * nt, 4) AS incremental_value,
  round((lift - {Z!r} * se) * v * nt - 0.5 * nt, 4) AS value_low, round((lift + {Z!r} * se) * v * nt - 0.5 * nt, 4) AS value_high,
  round(0.5::DOUBLE * nt, 4) AS cost, round(abs(lift / se), 6) AS z, CASE WHEN nh < 30 OR nt < 30 THEN 'TOO SMALL' WHEN abs(lift / se) <= {Z!r}
  THEN 'NOT DISTINGUISHABLE FROM ZERO' WHEN lift > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS verdict FROM s""")
def _incrementality(spark, d):
    m = holdout.incrementality(outcomes(spark, d), cost=0.5)
    m = m.withColumn("verdict", holdout.verdict(F.col("z") > Z))
    money_cols = ["incremental_value", "value_low", "value_high", "cost"]
    return rounded(rounded(m, 4, money_cols))


@query("incrementality_p_values", "H5 H6")
def _p_values(spark, d):
    m = holdout.with_p_value(holdout.incrementality(outcomes(spark, d), by=["c_mktsegment"]))
    return m.withColumn("verdict", holdout.verdict(F.col("p_value") < 0.05))


@query("detectable_effects", "H7 H8", f"""
WITH n AS (SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1),
m AS (SELECT nation, n, CASE WHEN n * 0.1 < 1 OR n - n * 0.1 < 1 THEN CAST('inf' AS DOUBLE) ELSE {z(0.975) + z(0.8)!r} * sqrt(0.8 * (1 - 0.8) * (1 / (n - n * 0.1) + 1 / (n * 0.1))) END AS mde FROM n)
SELECT nation, n, round(mde, 6) AS mde, CAST(ceil(0.8 * (1 - 0.8::DOUBLE) * (1 / (1 - 0.1::DOUBLE) + 1 / 0.1::DOUBLE) * pow({z(0.975) + z(0.8)!r} / (n / 10000), 2)) AS BIGINT) AS needed FROM m""")
def _mde(spark, d):
    n = src.raw(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    return n.select("nation", "n", F.round(holdout.detectable_effect(F.col("n")), 6).alias("mde"),
                    holdout.required_size(F.col("n") / 10000).alias("needed"))


def runs(spark, d):
    """One holdout run per (segment, nation): measured on the trial, true lift from the effects."""
    s = outcomes(spark, d).withColumn("retained", F.when(F.col("held_out"), F.col("y0") == 0)
                                      .otherwise(F.col("y1") == 0))
    key = ["c_mktsegment", "c_nationkey"]
    true = s.groupBy(*key).agg(F.avg(F.col("y0") - F.col("y1")).alias("true_lift"))
    size = F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 250 WHEN 'BUILDING' THEN 500 "
                  "WHEN 'FURNITURE' THEN 1000 WHEN 'HOUSEHOLD' THEN 2000 ELSE 4000 END")
    return (holdout.incrementality(s, by=key).join(true, key)
            .filter("n_holdout > 0 AND n_treated > 0").withColumn("n_customers", size))


@query("holdout_validation", "H9", H5.format(h=u("holdout-v1", "unit") + " < 0.3", r="CASE WHEN " + u("holdout-v1", "unit") + " < 0.3 THEN 1 - y0 ELSE 1 - y1 END",
       by="c_mktsegment, c_nationkey, avg(y0 - y1) AS tl,", group="GROUP BY c_mktsegment, c_nationkey") + f""",
r AS (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 250 WHEN 'BUILDING' THEN 500 WHEN 'FURNITURE' THEN 1000 WHEN 'HOUSEHOLD' THEN 2000 ELSE 4000 END AS k,
  CASE WHEN se > 0 THEN abs(lift / se) ELSE 0 END AS zz FROM s WHERE nt > 0 AND nh > 0)
SELECT k AS n_customers, count(*) AS runs, round(avg(nh), 6) AS mean_holdout, round(avg(tl), 6) AS true_lift, round(avg(lift), 6) AS measured_lift,
  round(avg(lift - tl), 6) AS bias, round(stddev_samp(lift - tl), 6) AS sd_error,
  round(avg(CAST(tl BETWEEN lift - {Z!r} * se AND lift + {Z!r} * se AS INT)), 6) AS coverage, round(avg(CAST(zz > {Z!r} AS INT)), 6) AS significant,
  round(avg(2 * {Z!r} * se), 6) AS ci_width FROM r GROUP BY 1""")
def _validation(spark, d):
    return rounded(holdout.validation_summary(runs(spark, d)))


@query("power_by_size", "H10", f"""
WITH n AS (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1)
SELECT n AS n_customers, CAST(floor(n * 0.1) AS BIGINT) AS holdout, round({z(0.975) + z(0.8)!r} * sqrt(0.8 * (1 - 0.8) * (1 / (n - n * 0.1) + 1 / (n * 0.1))), 6) AS mde FROM n""")
def _power(spark, d):
    n = src.raw(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_customers"))
    return rounded(holdout.power_table(n))
