"""Queries for survival, its metrics and customer value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import expit
from ..functions.curves import at_time, survival_from_hazard
from ..operators import metrics, order, shaping, survival, value
from ..session import cut
from ..sources import canonical as src
from .churn import rounded
from .registry import query

H = 24


def eta1(p):
    return -3.4 + 0.002 * F.col("mrr") + 0.3 * F.col("annual") - 0.02 * p


def eta2(p):
    return -4.0 + 0.2 * F.col("annual") + 0.01 * p


def hazards(df, horizon=H):
    """Cause hazards from fixed coefficients, so that curves have an exact reference."""
    periods = F.sequence(F.lit(1), F.lit(horizon))
    return df.withColumn("hazard_1", F.transform(periods, lambda p: expit(eta1(p)))).withColumn(
        "hazard_2", F.transform(periods, lambda p: expit(eta2(p))))


def curves(spark, d):
    s = survival.competing_curves(hazards(src.survival(spark, d)),
                                  {1: "hazard_1", 2: "hazard_2"})
    return s.withColumn("risk", F.round(F.col("mrr") / 50, 0) + F.col("annual"))


GRID = """
g AS (SELECT unit, mrr, annual, duration, event, p, 1 / (1 + exp(-(-3.4 + 0.002 * mrr + 0.3 * annual - 0.02 * p))) AS h1,
  1 / (1 + exp(-(-4.0 + 0.2 * annual + 0.01 * p))) AS h2 FROM c_surv, (SELECT unnest(range(1, 25)) AS p)),
s AS (SELECT *, product(1 - least(greatest(h1 + h2, 0), 1)) OVER (PARTITION BY unit ORDER BY p) AS s FROM g),
f AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY unit ORDER BY p), 1.0) AS sb FROM s),
k AS (SELECT *, sum(h1 * sb) OVER (PARTITION BY unit ORDER BY p) AS f1, sum(h2 * sb) OVER (PARTITION BY unit ORDER BY p) AS f2 FROM f)"""


def long(df, *arrays):
    """Arrays as (unit, period, ...) rows, rounded."""
    rows = df.select("unit", F.posexplode(F.arrays_zip(*arrays)).alias("i", "r"))
    return rows.select("unit", (F.col("i") + 1).alias("period"), *[
        round6(F.col(f"r.{a}")).alias(a) for a in arrays])


def round6(x):
    """As F.round(x, 6), which takes the decimal digits of every value, but by arithmetic away from ties."""
    up = x * 1e6 + 0.5
    near = (F.abs(x) < 1e6) & (F.abs(up - F.rint(up)) > 1e-3)
    return F.when(near, F.floor(up) / F.lit(1e6)).otherwise(F.round(x, 6))


@query("survival_data_check", "U1", """
SELECT count(*) AS n, count(*) FILTER (duration < 1) AS bad_duration, CAST(0 AS BIGINT) AS missing_covariates,
  count(*) FILTER (event NOT IN (0, 1)) AS unknown_cause, count(*) FILTER (event = 0) AS n_censored, max(duration) AS max_duration,
  round(avg(duration), 6) AS mean_duration, count(*) FILTER (event = 1) AS n_cause_1 FROM c_surv""")
def _check(spark, d):
    return rounded(survival.check_survival(src.survival(spark, d), ["mrr", "annual"], [1]))


@query("person_period", "U2", """
SELECT unit, p AS period, CAST(p = duration AND event = 1 AS INTEGER) AS event FROM (SELECT unit, duration, event, CAST(unnest(range(1, duration + 1)) AS INTEGER) AS p FROM c_surv)""")
def _pp(spark, d):
    return survival.person_period(src.survival(spark, d), cause=1).select(
        "unit", "period", "event")


@query("period_basis", "U3", """
SELECT unit, CAST(duration = 1 AS INT)::DOUBLE AS t_1, CAST(duration = 2 AS INT)::DOUBLE AS t_2, CAST(duration = 3 AS INT)::DOUBLE AS t_3,
  CAST(duration > 3 AS INT)::DOUBLE AS t_tail, round(CASE WHEN duration > 3 THEN ln(duration) - ln(3) ELSE 0 END, 6) AS t_tail_log,
  duration::DOUBLE AS period_raw, round(ln(duration), 6) AS log_period FROM c_surv""")
def _basis(spark, d):
    p = F.col("duration")
    b = {**survival.period_basis(p, "dummies", 3), **survival.period_basis(p, "raw")}
    return src.survival(spark, d).select("unit", *[F.round(e, 6).alias(n) for n, e in b.items()])


@query("spline_basis", "U4", """
WITH x AS (SELECT unit, ln(duration) AS x FROM c_surv)
SELECT unit, round(x, 6) AS s0,
  round((pow(greatest(x - 0.5, 0), 3) - pow(greatest(x - 2, 0), 3) * (3 - 0.5) / (3 - 2) + pow(greatest(x - 3, 0), 3) * (2 - 0.5) / (3 - 2)) / pow(3 - 0.5, 2), 6) AS s1,
  round((pow(greatest(x - 1, 0), 3) - pow(greatest(x - 2, 0), 3) * (3 - 1) / (3 - 2) + pow(greatest(x - 3, 0), 3) * (2 - 1) / (3 - 2)) / pow(3 - 0.5, 2), 6) AS s2 FROM x""")
def _spline(spark, d):
    b = survival.spline_basis(F.ln("duration"), [0.5, 1.0, 2.0, 3.0])
    return src.survival(spark, d).select("unit", *[F.round(e, 6).alias(f"s{i}")
                                                   for i, e in enumerate(b)])


@query("hazard_grid", "U9", f"""
WITH {GRID.strip()} SELECT unit, CAST(p AS INTEGER) AS period, round(h1, 6) AS hazard_1, round(h2, 6) AS hazard_2 FROM g""")
def _grid(spark, d):
    return long(hazards(src.survival(spark, d)), "hazard_1", "hazard_2")


@query("survival_curves", "U10", """
WITH g AS (SELECT unit, p, product(1 - 1 / (1 + exp(-(-3.4 + 0.002 * mrr + 0.3 * annual - 0.02 * p)))) OVER (PARTITION BY unit ORDER BY p) AS s
  FROM c_surv, (SELECT unnest(range(1, 25)) AS p))
SELECT unit, CAST(p AS INTEGER) AS period, round(s, 6) AS survival FROM g""")
def _curves(spark, d):
    h = hazards(src.survival(spark, d))
    return long(h.withColumn("survival", survival_from_hazard(F.col("hazard_1"))), "survival")


@query("survival_along_path", "U11", """
SELECT unit, month + 1 AS period, round(product(1 - least(0.01 + sessions / 100.0, 1)) OVER (PARTITION BY unit ORDER BY month), 6) AS survival FROM c_panel""")
def _path(spark, d):
    p = src.panel(spark, d).select("unit", (F.col("month") + 1).alias("period"),
                                   (0.01 + F.col("sessions") / 100.0).alias("hazard"))
    return rounded(survival.survival_along(p).select("unit", "period", "survival"))


@query("survival_at_times", "U12", f"""
WITH {GRID.strip()} SELECT unit, 1.0::DOUBLE AS s_0_5, round(max(s) FILTER (p = 3), 6) AS s_3_7, round(1 - max(s) FILTER (p = 12), 6) AS risk_12 FROM s GROUP BY 1""")
def _at(spark, d):
    c = curves(spark, d)
    return c.select("unit", at_time(F.col("survival"), F.lit(0.5)).alias("s_0_5"),
                    F.round(at_time(F.col("survival"), F.lit(3.7)), 6).alias("s_3_7"),
                    F.round(1 - at_time(F.col("survival"), F.lit(12.0)), 6).alias("risk_12"))


@query("competing_risk_curves", "U14 U15", f"""
WITH {GRID.strip()} SELECT unit, CAST(p AS INTEGER) AS period, round(s, 6) AS survival, round(f1, 6) AS cif_1, round(f2, 6) AS cif_2 FROM k""")
def _competing(spark, d):
    return long(curves(spark, d), "survival", "cif_1", "cif_2")


@query("life_table", "U2 U16", """
WITH p AS (SELECT plan, duration, event, CAST(unnest(range(1, duration + 1)) AS INTEGER) AS period FROM c_surv),
t AS (SELECT plan, period, count(*) AS at_risk, count(*) FILTER (period = duration AND event = 1) AS events_1,
  count(*) FILTER (period = duration AND event = 2) AS events_2 FROM p GROUP BY 1, 2),
s AS (SELECT *, product(1 - (events_1 + events_2) / at_risk) OVER (PARTITION BY plan ORDER BY period) AS s FROM t),
b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY plan ORDER BY period), 1.0) AS sb FROM s)
SELECT plan, period, at_risk, events_1, events_2, round(events_1 / at_risk, 6) AS hazard_1, round(events_2 / at_risk, 6) AS hazard_2,
  round(s, 6) AS survival, round(sum(events_1 / at_risk * sb) OVER (PARTITION BY plan ORDER BY period), 6) AS cif_1,
  round(sum(events_2 / at_risk * sb) OVER (PARTITION BY plan ORDER BY period), 6) AS cif_2 FROM b""")
def _life(spark, d):
    return rounded(survival.life_table(src.survival(spark, d), [1, 2], ["plan"]))


@query("landmark_slice", "U17", """
SELECT p.unit, p.mrr, p.sessions, CAST(least(greatest(s.duration - 6, 1), 6) AS INTEGER) AS duration,
  CAST(s.event = 1 AND s.duration - 6 <= 6 AS INTEGER) AS event
FROM c_panel p JOIN c_surv s USING (unit) WHERE p.month + 1 = 6 AND s.duration > 6""")
def _landmark(spark, d):
    p = src.panel(spark, d).withColumn("period", F.col("month") + 1)
    return survival.landmark_slice(p, src.survival(spark, d), 6, 6, ["mrr", "sessions"])


@query("conditional_survival", "U18", f"""
WITH {GRID.strip()} SELECT unit, {', '.join(f"round(max(s) FILTER (p = {6 + k}) / greatest(max(s) FILTER (p = 6), 1e-12), 6) AS c{k}" for k in range(1, 7))} FROM s GROUP BY 1""")
def _conditional(spark, d):
    c = survival.conditional_survival(F.col("survival"), 6, 6)
    return curves(spark, d).select("unit", *[F.round(c[k], 6).alias(f"c{k + 1}")
                                             for k in range(6)])


@query("breslow_baseline", "U19", """
WITH r AS (SELECT duration, event, exp(mrr / 1000 + annual / 10) AS r FROM c_surv),
t AS (SELECT duration AS time, count(*) FILTER (event > 0) AS d, sum(r) AS r FROM r GROUP BY 1),
a AS (SELECT time, d, sum(r) OVER (ORDER BY time DESC) AS at_risk FROM t)
SELECT time, d, round(at_risk, 4) AS at_risk, round(sum(d / greatest(at_risk, 1e-12)) OVER (ORDER BY time), 6) AS cumulative_hazard FROM a WHERE d > 0""")
def _breslow(spark, d):
    s = src.survival(spark, d).withColumn("risk", F.col("mrr") / 1000 + F.col("annual") / 10)
    b = survival.breslow(s)
    return b.select("time", "d", F.round("at_risk", 4).alias("at_risk"),
                    F.round("cumulative_hazard", 6).alias("cumulative_hazard"))


@query("breslow_survival", "U19", """
WITH r AS (SELECT unit, duration, event, mrr / 1000 AS k FROM c_surv),
t AS (SELECT duration AS time, count(*) FILTER (event > 0) AS d, sum(exp(k)) AS r FROM r GROUP BY 1),
a AS (SELECT time, d, sum(r) OVER (ORDER BY time DESC) AS n FROM t)
SELECT unit, round(exp(-exp(k) * (SELECT sum(d / n) FROM a WHERE time <= 3)), 6) AS s_3,
  round(exp(-exp(k) * (SELECT sum(d / n) FROM a WHERE time <= 12)), 6) AS s_12 FROM r""")
def _breslow_survival(spark, d):
    s = src.survival(spark, d).select("unit", "duration", "event",
                                      (F.col("mrr") / 1000).alias("risk"))
    out = survival.breslow_survival(s, survival.breslow(s), [3, 12])
    return rounded(out.select("unit", "s_3", "s_12"))


# --- fitted hazards: rows and properties only ------------------------------------------

@query("fitted_hazard_curves", "U5 U8 U9 U10")
def _fitted(spark, d):
    s = src.survival(spark, d)
    m = survival.DiscreteHazard(["mrr", "annual"], pool_after=12).fit(s)
    return long(m.survival(s, H), "survival")


@query("boosted_calibrated_hazard", "U3 U6 U7")
def _boosted(spark, d):
    s = src.survival(spark, d)
    m = survival.DiscreteHazard(["mrr", "annual"], "boosted", calibrate=True).fit(s)
    g = m.hazard_grid(s.select("unit", "mrr", "annual"), H)
    return g.groupBy("period").agg(F.avg("hazard").alias("mean_hazard"),
                                   F.min("hazard").alias("low"), F.max("hazard").alias("high"))


@query("fitted_competing_risks", "U13 U14 U15")
def _fitted_competing(spark, d):
    s = src.survival(spark, d)
    m = survival.CompetingHazards(["mrr", "annual"], [1, 2], basis="spline").fit(s)
    return long(m.curves(s, H), "survival", "cif_1", "cif_2")


# --- metrics ------------------------------------------------------------------------------

KM = """
t AS (SELECT duration AS time, count(*) AS n, count(*) FILTER (event > 0) AS d, count(*) FILTER (event = 0) AS c FROM c_surv GROUP BY 1),
a AS (SELECT *, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM t),
km AS (SELECT *, product(1 - d / at_risk) OVER (ORDER BY time) AS s,
  product(CASE WHEN at_risk - d > 0 THEN 1 - c / (at_risk - d) ELSE 1 END) OVER (ORDER BY time) AS g FROM a)"""


@query("kaplan_meier", "K1", f"""
WITH {KM.strip()} SELECT time, n, d, CAST(at_risk AS BIGINT) AS at_risk, round(s, 6) AS survival FROM km""")
def _km(spark, d):
    return rounded(metrics.kaplan_meier(src.survival(spark, d))).drop("c")


@query("kaplan_meier_exact_days", "K1", """
WITH x AS (SELECT customer_id, CAST(epoch_us(coalesce(ended_at, started_at + INTERVAL 400 DAY)) // 86400000000 - epoch_us(started_at) // 86400000000 AS BIGINT) AS duration,
  CAST(ended_at IS NOT NULL AS INT) AS e FROM c_subs),
t AS (SELECT duration AS time, count(*) AS n, sum(e) AS d FROM x GROUP BY 1),
a AS (SELECT *, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM t)
SELECT time, round(product(1 - d / at_risk) OVER (ORDER BY time), 6) AS survival FROM a""")
def _km_days(spark, d):
    from ..functions.columns import whole_days
    s = src.subscriptions(spark, d).select(
        whole_days("started_at", F.coalesce("ended_at", F.expr("started_at + INTERVAL '400' DAY")))
        .cast("long").alias("duration"), F.col("ended_at").isNotNull().cast("int").alias("event"))
    return rounded(metrics.kaplan_meier(s)).select("time", "survival")


@query("step_lookup", "K2", f"""
WITH {KM.strip()} SELECT q AS t, round(coalesce((SELECT s FROM km WHERE time <= q ORDER BY time DESC LIMIT 1), 1.0), 6) AS value
FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (7.9::DOUBLE), (100.0::DOUBLE)) v(q)""")
def _lookup(spark, d):
    return rounded(metrics.step_lookup(metrics.kaplan_meier(src.survival(spark, d)), "survival",
                                       [0.5, 1.0, 7.9, 100.0]))


@query("as_of_lookup", "K2 K1 K3", f"""
WITH {KM.strip()}, q AS (SELECT unit, unnest([duration / 2.0, duration - 0.25, duration, 0.5]) AS t FROM c_surv)
SELECT unit, CAST(t AS DOUBLE) AS t, round(coalesce(km.s, 1.0), 6) AS survival, round(coalesce(km.g, 1.0), 6) AS g
FROM q ASOF LEFT JOIN km ON q.t >= km.time""")
def _as_of(spark, d):
    """Both curves at four times of every subject: half its own, just before it, at it, and too early."""
    surv = src.survival(spark, d)
    curve = metrics.kaplan_meier(surv).select(F.col("time").alias("t"), "survival").join(
        metrics.censoring_survival(surv).select(F.col("time").alias("t"), "g"), "t")
    t = F.col("duration").cast("double")
    asks = surv.select("unit", F.explode(F.array(t / 2, t - 0.25, t, F.lit(0.5))).alias("t"))
    return rounded(order.as_of(asks, curve, "t", {"survival": F.col("survival"), "g": F.col("g")}, F.lit(1.0)))


@query("censoring_survival", "K3", f"WITH {KM.strip()} SELECT time, round(g, 6) AS g FROM km")
def _censoring(spark, d):
    return rounded(metrics.censoring_survival(src.survival(spark, d)).select("time", "g"))


@query("estimable_horizon", "K4", f"""
WITH {KM.strip()} SELECT CAST(coalesce(max(time) FILTER (g > 0.05), min(time)) AS DOUBLE) AS horizon FROM km""")
def _horizon(spark, d):
    return metrics.estimable_horizon(metrics.censoring_survival(src.survival(spark, d)))


CINDEX = """
b AS (SELECT duration AS t, event > 0 AS e, {risk} AS r, count(*) AS w FROM c_surv GROUP BY 1, 2, 3),
p AS (SELECT sum(i.w * j.w) FILTER (i.r > j.r) AS c, sum(i.w * j.w) FILTER (i.r = j.r) AS x, sum(i.w * j.w) AS n
  FROM b i JOIN b j ON i.e AND (j.t > i.t OR (j.t = i.t AND NOT j.e)))
SELECT c::DOUBLE AS concordant, x::DOUBLE AS tied, n::DOUBLE AS comparable, round((c + 0.5 * x) / n, 6) AS c_index FROM p"""


@query("concordance_index", "K5", "WITH " + CINDEX.strip().format(risk="round(mrr / 50, 0) + annual"))
def _concordance(spark, d):
    s = src.survival(spark, d).withColumn("risk", F.round(F.col("mrr") / 50, 0) + F.col("annual"))
    return rounded(metrics.concordance(s))


@query("concordance_fine_risk", "K5", "WITH " + CINDEX.strip().format(risk="floor(mrr * 4) + annual"))
def _concordance_fine(spark, d):
    s = src.survival(spark, d).withColumn("risk", F.floor(F.col("mrr") * 4) + F.col("annual"))
    return rounded(metrics.concordance(s))


BRIER = f"""
{KM.strip()},
{GRID.strip()},
q AS (SELECT s.unit, s.duration, s.event, s.p AS t, s.s, ge.g AS ge, gt.g AS gt FROM s JOIN km ge ON ge.time = s.duration
  JOIN km gt ON gt.time = s.p WHERE s.p IN (3, 6, 12, 20)),
br AS (SELECT t, bool_or((event > 0 AND duration <= t AND ge <= 0) OR (duration > t AND gt <= 0)) AS bad,
  avg(CASE WHEN event > 0 AND duration <= t THEN s * s / nullif(ge, 0) WHEN duration > t THEN (1 - s) * (1 - s) / nullif(gt, 0) ELSE 0 END) AS b FROM q GROUP BY 1)"""


@query("brier_scores", "K6 K2", f"""
WITH {BRIER.strip()} SELECT t::DOUBLE AS horizon, CASE WHEN NOT bad THEN round(b, 6) END AS brier FROM br""")
def _brier(spark, d):
    return rounded(metrics.brier(curves(spark, d), "survival", [3, 6, 12, 20]))


@query("integrated_brier_score", "K7", f"""
WITH {BRIER.strip()}, l AS (SELECT (b + lag(b) OVER (ORDER BY t)) / 2 * (t - lag(t) OVER (ORDER BY t)) AS a FROM br)
SELECT round(sum(a) / 17, 6) AS ibs FROM l""")
def _ibs(spark, d):
    return rounded(metrics.integrated(metrics.brier(curves(spark, d), "survival",
                                                    [3, 6, 12, 20])))


@query("d_calibration", "K8 K11", f"""
WITH {GRID.strip()},
o AS (SELECT unit, event, 0.5 * (max(s) FILTER (p = least(duration, 20)) + greatest(coalesce(max(s) FILTER (p = least(duration, 20) - 1), 1.0),
  max(s) FILTER (p = least(duration, 20)))) AS s FROM s GROUP BY unit, event, duration),
m AS (SELECT b, CASE WHEN event > 0 THEN CAST(least(floor(s * 10), 9) = b AS INT)::DOUBLE WHEN s <= 1e-12 THEN CAST(b = 0 AS INT)
  ELSE greatest(least((b + 1) / 10.0::DOUBLE, s) - b / 10.0::DOUBLE, 0) / s END AS v FROM o, (SELECT unnest(range(0, 10)) AS b)),
t AS (SELECT b, sum(v) AS mass FROM m GROUP BY 1), n AS (SELECT count(*) AS n FROM o)
SELECT CAST(b AS INTEGER) AS bin, round(mass, 4) AS mass, round((SELECT sum((mass - n / 10) * (mass - n / 10) / (n / 10)) FROM t, n), 3) AS chi2 FROM t""")
def _dcal(spark, d):
    c = curves(spark, d)
    now, before = metrics.own_time(F.col("survival"), F.col("duration"), 20)
    m = metrics.d_calibration(c, now, before)
    return m.select(F.posexplode("mass").alias("bin", "mass"), F.round("chi2", 3).alias("chi2")
                    ).withColumn("mass", F.round("mass", 4))


@query("d_calibration_p_value", "K8")
def _dcal_p(spark, d):
    c = curves(spark, d)
    now, before = metrics.own_time(F.col("survival"), F.col("duration"), 20)
    return metrics.with_chi2_p(metrics.d_calibration(c, now, before), 9).select(
        "n", "chi2", "p_value")


CAL = f"""
{GRID.strip()},
r AS (SELECT unit, duration, event, s, ntile(10) OVER (ORDER BY round(s, 9), unit) AS bin FROM s WHERE p = 12),
t2 AS (SELECT bin, duration AS time, count(*) AS n, count(*) FILTER (event > 0) AS d FROM r GROUP BY 1, 2),
a2 AS (SELECT *, sum(n) OVER (PARTITION BY bin ORDER BY time DESC) AS at_risk FROM t2),
k2 AS (SELECT bin, product(1 - d / at_risk) AS observed FROM a2 WHERE time <= 12 GROUP BY 1),
c AS (SELECT CAST(bin AS INTEGER) AS bin, avg(s) AS predicted, count(*) AS n, observed FROM r JOIN k2 USING (bin) GROUP BY bin, observed)"""


def _cal(spark, d):
    p = F.round(at_time(F.col("survival"), F.lit(12.0)), 9)
    return metrics.calibration_bins(curves(spark, d), p, 12.0)


@query("calibration_bins", "K9", f"""
WITH {CAL.strip()} SELECT bin, round(predicted, 6) AS predicted, n, round(observed, 6) AS observed FROM c""")
def _cal_bins(spark, d):
    return rounded(_cal(spark, d))


@query("calibration_summary", "K9", f"""
WITH {CAL.strip()}, w AS (SELECT sum(n * predicted) / sum(n) AS mx, sum(n * observed) / sum(n) AS my FROM c)
SELECT round(sum(n * abs(predicted - observed)) / sum(n), 5) AS mean_abs_error,
  round(sum(n * (predicted - mx) * (observed - my)) / sum(n * (predicted - mx) * (predicted - mx)), 5) AS slope FROM c, w""")
def _cal_summary(spark, d):
    return rounded(metrics.calibration_summary(_cal(spark, d)), 5)


@query("evaluation_grid", "K10", f"""
WITH {KM.strip()}, q AS (SELECT greatest(quantile_cont(duration, 0.1), 1) AS lo, least(quantile_cont(duration, 0.9), (SELECT max(time) FILTER (g > 0.05) FROM km)) AS hi FROM c_surv),
b AS (SELECT lo, greatest(hi, lo + 1) AS hi FROM q)
SELECT round(lo + (hi - lo) * i / 19, 6) AS t FROM b, range(0, 20) r(i)""")
def _eval_grid(spark, d):
    g = metrics.horizon_grid(src.survival(spark, d))
    return spark.createDataFrame([(round(t, 6),) for t in g], "t double")


@query("survival_at_own_time", "K11", f"""
WITH {GRID.strip()} SELECT unit, round(max(s) FILTER (p = least(duration, 20)), 6) AS now,
  round(coalesce(max(s) FILTER (p = least(duration, 20) - 1), 1.0), 6) AS before FROM s GROUP BY unit""")
def _own(spark, d):
    now, before = metrics.own_time(F.col("survival"), F.col("duration"), 20)
    return curves(spark, d).select("unit", F.round(now, 6).alias("now"),
                                   F.round(before, 6).alias("before"))


@query("model_scorecard", "K12")
def _scorecard(spark, d):
    return metrics.score_model(cut(curves(spark, d).select(
        "unit", "duration", "event", "survival", "risk")), "survival", "risk", 12.0, 24)


def _resplits(spark, d):
    """Score of three simple predictors on each plan, which stands for a resplit."""
    s = src.survival(spark, d).select("plan", "duration", "event", "mrr")
    y = (F.col("duration") > 12).cast("double")
    return s.groupBy(F.col("plan").alias("seed")).agg(
        F.avg(F.pow(y - 0.5, 2)).alias("flat"), F.avg(F.pow(y - F.col("mrr") / 1000, 2))
        .alias("price"), F.avg(F.pow(y - 0.55, 2)).alias("level")).selectExpr(
        "seed", "stack(3, 'flat', flat, 'price', price, 'level', level) AS (model, ibs)")


SPLIT = """
v AS (SELECT plan AS seed, avg(pow(CAST(duration > 12 AS INT) - 0.5, 2)) AS flat, avg(pow(CAST(duration > 12 AS INT) - mrr / 1000, 2)) AS price,
  avg(pow(CAST(duration > 12 AS INT) - 0.55, 2)) AS level FROM c_surv GROUP BY 1)"""


@query("resplit_means", "K13", f"""
WITH {SPLIT.strip()} SELECT 'flat' AS model, count(*) AS splits, round(avg(flat), 6) AS ibs FROM v
UNION ALL SELECT 'price', count(*), round(avg(price), 6) FROM v UNION ALL SELECT 'level', count(*), round(avg(level), 6) FROM v""")
def _resplit(spark, d):
    return rounded(metrics.resplit_summary(_resplits(spark, d), ["ibs"]))


@query("paired_score_wins", "K13", f"""
WITH {SPLIT.strip()} SELECT 'price' AS against, round(avg(CAST(flat < price AS INT)), 6) AS win_rate FROM v
UNION ALL SELECT 'level', round(avg(CAST(flat < level AS INT)), 6) FROM v""")
def _paired(spark, d):
    return rounded(metrics.paired_wins(_resplits(spark, d), "flat", ["price", "level"]))


@query("landmark_comparison", "K14 U17 U18")
def _landmarks(spark, d):
    """At months 3 and 6: conditional survival of the curves scored on who was still there."""
    s, c = src.survival(spark, d), curves(spark, d)
    panel = src.panel(spark, d).withColumn("period", F.col("month") + 1)
    parts = []
    for mark in (3, 6):
        sl = survival.landmark_slice(panel, s, mark, 6, ["mrr"])
        j = sl.drop("mrr").join(c.select("unit", survival.conditional_survival(
            F.col("survival"), mark, 6).alias("later")), "unit")
        j = cut(j)
        ibs = metrics.integrated(metrics.brier(j, "later", [1, 2, 3, 4, 5])).scalar()
        now, before = metrics.own_time(F.col("later"), F.col("duration"), 6)
        parts.append(metrics.with_chi2_p(metrics.d_calibration(j, now, before), 9).select(
            F.lit(mark).alias("landmark"), "n", ibs.alias("ibs"), F.col("p_value").alias("d_cal_p")))
    return parts[0].unionByName(parts[1])


# --- value ----------------------------------------------------------------------------------

CLV = f"""
{GRID.strip()},
v AS (SELECT unit, mrr, sum(s / pow(pow(1.12::DOUBLE, 1 / 12.0::DOUBLE), p)) * mrr * 0.75 AS clv, sum(s) AS remaining,
  1 - max(s) FILTER (p = 1) AS hazard_next, sum(f1 / pow(pow(1.12::DOUBLE, 1 / 12.0::DOUBLE), p)) * mrr * 0.75 AS sf1,
  sum(f2 / pow(pow(1.12::DOUBLE, 1 / 12.0::DOUBLE), p)) * mrr * 0.75 AS sf2 FROM k GROUP BY 1, 2)"""


def book(spark, d):
    return value.value_book(curves(spark, d), H, [1, 2], F.col("mrr") * 0.75, 0.12, H)


@query("monthly_discount", "C1", """
SELECT o_orderkey, CASE WHEN r > -1 THEN round(pow(1 + r, 1 / 12.0::DOUBLE) - 1, 8) END AS monthly FROM (SELECT o_orderkey, (o_orderkey % 400 - 120) / 100.0::DOUBLE AS r FROM orders)""")
def _discount(spark, d):
    r = (F.col("o_orderkey") % 400 - 120) / 100.0
    return src.raw(spark, d, "orders").select(
        "o_orderkey", F.round(value.monthly_discount_column(r), 8).alias("monthly"))


@query("customer_value", "C2 C3 C4 C5 C6", f"""
WITH {CLV.strip()} SELECT unit, round(clv, 4) AS clv, round(remaining, 5) AS remaining_months, round(clv * hazard_next, 4) AS value_at_risk,
  round(sf1, 4) AS shortfall_1, round(sf2, 4) AS shortfall_2 FROM v""")
def _clv(spark, d):
    b = book(spark, d).select("unit", "clv", "remaining_months", "value_at_risk", "shortfall_1",
                              "shortfall_2")
    return rounded(b, 4, ["clv", "value_at_risk", "shortfall_1", "shortfall_2"]).withColumn(
        "remaining_months", F.round("remaining_months", 5))


@query("shortfall_identity", "C6", """
SELECT count(*) AS n, CAST(0 AS BIGINT) AS broken FROM c_surv""")
def _identity(spark, d):
    """Causes add up to what perfect retention would have been worth beyond the expectation."""
    b = book(spark, d)
    whole = value.lifetime_value(F.array_repeat(F.lit(1.0), H), F.col("mrr") * 0.75, H)
    gap = whole - F.col("clv") - F.col("shortfall_1") - F.col("shortfall_2")
    return b.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(gap) > 1e-6, 1))
                 .alias("broken"))


@query("treatment_value", "C7", """
SELECT unit, round(-tau * value - cost, 6) AS treatment_value FROM c_scored""")
def _treatment(spark, d):
    return src.scored(spark, d).select("unit", F.round(value.treatment_value(
        F.col("tau"), F.col("value"), F.col("cost")), 6).alias("treatment_value"))


@query("value_book_summary", "C8", f"""
WITH {CLV.strip()} SELECT count(*) AS n, round(avg(clv), 4) AS mean_clv, round(sum(clv), 2) AS total_clv, round(avg(remaining), 5) AS mean_remaining_months,
  round(sum(sf1), 2) AS shortfall_1, round(sum(sf2), 2) AS shortfall_2, round(sum(sf1) + sum(sf2), 2) AS shortfall_total,
  round(quantile_cont(clv, 0.5), 4) AS median_clv, round(quantile_cont(clv, 0.9), 4) AS p90_clv,
  round(sum(sf1) / (sum(sf1) + sum(sf2)), 6) AS share_1, round(sum(sf2) / (sum(sf1) + sum(sf2)), 6) AS share_2 FROM v""")
def _book_summary(spark, d):
    s = value.book_summary(book(spark, d), [1, 2])
    s = rounded(s, 2, ["total_clv", "shortfall_1", "shortfall_2", "shortfall_total"])
    s = rounded(s, 4, ["mean_clv", "median_clv", "p90_clv"])
    return s.withColumn("mean_remaining_months", F.round("mean_remaining_months", 5)).withColumn(
        "share_1", F.round("share_1", 6)).withColumn("share_2", F.round("share_2", 6))


@query("top_decile_overlap", "C9", f"""
WITH {CLV.strip()}, r AS (SELECT unit, row_number() OVER (ORDER BY round(clv * hazard_next, 9) DESC, unit) AS ra,
  row_number() OVER (ORDER BY round(hazard_next, 9) DESC, unit) AS rb, greatest(1, count(*) OVER () // 10) AS k FROM v)
SELECT CAST(max(k) AS BIGINT) AS k, count(*) FILTER (ra <= k AND rb <= k) AS both, round(count(*) FILTER (ra <= k AND rb <= k) / max(k), 6) AS overlap FROM r""")
def _overlap(spark, d):
    b = book(spark, d).select("unit", F.round("value_at_risk", 9).alias("a"),
                              F.round("hazard_next", 9).alias("b"))
    return rounded(value.top_overlap(b, "a", "b"))


@query("isotonic_fit", "U7", """
WITH c AS (SELECT floor(mrr) AS x, count(*) AS n, sum(CAST(event > 0 AS INTEGER) + duration % 5) AS s FROM c_surv GROUP BY 1),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS k, sum(n) OVER (ORDER BY x) AS n1, sum(s) OVER (ORDER BY x) AS s1, n, s FROM c),
p AS (SELECT a.k AS a, b.k AS b, (b.s1 - a.s1 + a.s) / (b.n1 - a.n1 + a.n)::DOUBLE AS m FROM r a JOIN r b ON b.k >= a.k),
l AS (SELECT a, b AS k, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM p),
v AS (SELECT r.x, max(l.m) AS value FROM r JOIN l ON l.k = r.k AND l.a <= r.k GROUP BY 1)
SELECT CAST(x AS DOUBLE) AS x, round(value, 6) AS value FROM v""")
def _isotonic(spark, d):
    """The rising fit of a noisy outcome on the price, against the formula of largest least means."""
    from ..operators import isotonic

    s = src.survival(spark, d).select(F.floor("mrr").cast("double").alias("x"), (
        (F.col("event") > 0).cast("int") + F.col("duration") % 5).cast("double").alias("y"))
    return rounded(isotonic.predict(s.select("x").distinct(), isotonic.fit(s, "x", "y"), "x"))
