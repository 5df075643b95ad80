"""Queries for point-in-time features and leakage audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import leakage
from ..operators.churn import union_all
from ..session import cut, written
from ..sources import canonical as src
from .churn import rounded
from .registry import query
from .sqltext import u

AS_OFS = [dt.datetime(1998, 6, 30), dt.datetime(1999, 6, 30), dt.datetime(2000, 6, 30),
          dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 31)]
_VALUES = ", ".join(f"(TIMESTAMP '{a:%Y-%m-%d}')" for a in AS_OFS)
SPINE = f"""
SELECT DISTINCT customer_id, as_of FROM c_subs, (VALUES {_VALUES}) a(as_of)
WHERE started_at <= as_of AND (ended_at IS NULL OR ended_at > as_of)"""


def days(x):
    return f"(epoch_us(as_of) - epoch_us({x})) / 86400000000.0::DOUBLE"


def _agg(table, on, aggs):
    return (f"SELECT s.customer_id, s.as_of, {aggs} FROM ({SPINE}) s JOIN {table} f "
            f"ON f.customer_id = s.customer_id AND {on} GROUP BY 1, 2")


SES = "f.name = 'session_start'"
STANDARD = f"""
WITH s AS ({SPINE}),
sub AS ({_agg('c_subs', 'f.available_at <= s.as_of', f"{days('min(f.started_at)')} AS tenure_days, max(f.mrr) AS mrr")}),
ev AS ({_agg('c_events', 'f.available_at <= s.as_of', f'''
  count(*) FILTER ({SES} AND f.occurred_at > s.as_of - INTERVAL 30 DAY) AS sessions_30d,
  count(*) FILTER ({SES} AND f.occurred_at > s.as_of - INTERVAL 60 DAY) AS sessions_prev_30d,
  {days(f"max(f.occurred_at) FILTER ({SES} AND f.occurred_at > s.as_of - INTERVAL 365 DAY)")} AS days_since_last_session,
  count(DISTINCT f.name) FILTER (f.occurred_at > s.as_of - INTERVAL 30 DAY) AS distinct_features_30d''')}),
inv AS ({_agg('c_inv', 'f.available_at <= s.as_of', f'''
  count(*) FILTER (f.status = 'failed' AND f.attempted_at > s.as_of - INTERVAL 90 DAY) AS payment_failures_90d,
  count(*) FILTER (f.status = 'failed') AS payment_failures_ltd,
  {days("max(f.attempted_at) FILTER (f.status = 'failed')")} AS days_since_last_failure,
  sum(f.amount) FILTER (f.status = 'paid' AND f.attempted_at > s.as_of - INTERVAL 180 DAY) AS amount_paid_180d''')}),
tk AS ({_agg('c_tickets', 'f.available_at <= s.as_of', f'''
  count(*) FILTER (f.opened_at > s.as_of - INTERVAL 90 DAY) AS tickets_90d,
  {days("max(f.opened_at)")} AS days_since_last_ticket''')}),
tc AS ({_agg('c_touch', 'f.available_at <= s.as_of', f'''
  count(*) FILTER (f.arm = 'treatment') AS interventions_ltd,
  {days("max(f.sent_at) FILTER (f.arm = 'treatment')")} AS days_since_last_intervention''')}),
p AS (SELECT s.customer_id, s.as_of, coalesce(tenure_days, 0.0) AS tenure_days, coalesce(mrr, 0.0) AS mrr,
  coalesce(sessions_30d, 0)::DOUBLE AS sessions_30d, coalesce(sessions_prev_30d, 0)::DOUBLE AS sessions_prev_30d,
  round(coalesce(days_since_last_session, 365.0), 6) AS days_since_last_session,
  coalesce(distinct_features_30d, 0)::DOUBLE AS distinct_features_30d,
  coalesce(payment_failures_90d, 0)::DOUBLE AS payment_failures_90d,
  coalesce(payment_failures_ltd, 0)::DOUBLE AS payment_failures_ltd,
  coalesce(days_since_last_failure, 999.0) AS days_since_last_failure,
  round(coalesce(amount_paid_180d, 0.0), 6) AS amount_paid_180d,
  coalesce(tickets_90d, 0)::DOUBLE AS tickets_90d,
  round(coalesce(days_since_last_ticket, 999.0), 6) AS days_since_last_ticket,
  coalesce(interventions_ltd, 0)::DOUBLE AS interventions_ltd,
  coalesce(days_since_last_intervention, 999.0) AS days_since_last_intervention
  FROM s LEFT JOIN sub USING (customer_id, as_of) LEFT JOIN ev USING (customer_id, as_of)
  LEFT JOIN inv USING (customer_id, as_of) LEFT JOIN tk USING (customer_id, as_of)
  LEFT JOIN tc USING (customer_id, as_of))
SELECT *, round(CASE WHEN sessions_prev_30d - sessions_30d > 0
  THEN sessions_30d / (sessions_prev_30d - sessions_30d) ELSE 1.0 END, 6) AS engagement_trend FROM p"""


@query("standard_feature_panel", "F1 F4 F5 F7 F8 F9 F10 F12 F13 F14 F16 F17 F18", STANDARD)
def _standard(spark, d):
    ds = src.dataset(spark, d)
    spine = ft.at_risk_spine(ds.subscriptions, AS_OFS)
    return rounded(ft.standard_panel(ds, spine, AS_OFS))


OTHER = [
    ft.FeatureSpec("mean_value_20d", "events", "mean", "value", window_days=20, fill=-1.0),
    ft.FeatureSpec("last_value", "events", "constant", "value", fill=-1.0),
    ft.FeatureSpec("error_sum", "events", "sum", "value", where={"name": "error"}),
    ft.FeatureSpec("max_paid", "invoices", "max", "amount", where={"status": "paid"}),
    ft.FeatureSpec("codes", "invoices", "nunique", "failure_code"),
    ft.FeatureSpec("customer_age", "customers", "age_days", "created_at", fill=-1.0),
]


@query("single_as_of_features", "F1 F5 F6 F7 F8 F10 F11 F13 F14 F15", """
WITH s AS (SELECT customer_id, TIMESTAMP '2024-01-20' AS as_of FROM c_customers),
ev AS (SELECT s.customer_id, avg(f.value) FILTER (f.occurred_at > s.as_of - INTERVAL 20 DAY) AS mean_value_20d,
  arg_max(f.value, (f.occurred_at, f.event_id)) AS last_value, sum(f.value) FILTER (f.name = 'error') AS error_sum
  FROM s JOIN c_events f ON f.customer_id = s.customer_id AND f.available_at <= s.as_of GROUP BY 1),
inv AS (SELECT s.customer_id, max(f.amount) FILTER (f.status = 'paid') AS max_paid, count(DISTINCT f.failure_code) AS codes
  FROM s JOIN c_inv f ON f.customer_id = s.customer_id AND f.available_at <= s.as_of GROUP BY 1)
SELECT s.customer_id, s.as_of, round(coalesce(mean_value_20d, -1.0), 6) AS mean_value_20d,
  coalesce(last_value, -1.0) AS last_value, round(coalesce(error_sum, 0.0), 6) AS error_sum,
  coalesce(max_paid, 0.0) AS max_paid, coalesce(codes, 0)::DOUBLE AS codes,
  (epoch_us(s.as_of) - epoch_us(c.created_at)) / 86400000000.0::DOUBLE AS customer_age
FROM s LEFT JOIN ev USING (customer_id) LEFT JOIN inv USING (customer_id) JOIN c_customers c USING (customer_id)""")
def _single(spark, d):
    ds = src.dataset(spark, d)
    a = dt.datetime(2024, 1, 20)
    spine = ds.customers.select("customer_id", F.lit(a).cast("timestamp_ntz").alias("as_of"))
    return rounded(ft.panel(ds, spine, [a], OTHER))


@query("unsafe_visibility_modes", "F2 F3", f"""
WITH a AS (SELECT * FROM (VALUES {_VALUES}) a(as_of)), e AS (SELECT * FROM c_events, a)
SELECT mode, as_of, count(*) FILTER (ok) AS n_visible, count(*) FILTER (ok AND available_at > as_of) AS n_late,
  count(*) FILTER (ok AND occurred_at > as_of) AS n_future FROM (
  SELECT 'available_at' AS mode, *, available_at <= as_of AS ok FROM e
  UNION ALL SELECT 'occurred_at', *, occurred_at <= as_of FROM e UNION ALL SELECT 'none', *, true FROM e)
GROUP BY 1, 2 HAVING count(*) FILTER (ok) > 0""")
def _modes(spark, d):
    from ..schema import EVENTS
    ds = src.dataset(spark, d)
    return union_all([ft.future_rows(ds, EVENTS, AS_OFS, m).drop("table")
                      .withColumn("mode", F.lit(m))
                      for m in (ft.SAFE, ft.OCCURRED_ONLY, ft.NO_FILTER)])


@query("availability_audit", "L1", """
WITH a AS (SELECT TIMESTAMP '2024-01-20' AS as_of)
SELECT 'events' AS "table", as_of, count(*) AS n_visible, count(*) FILTER (available_at > as_of) AS n_late,
  count(*) FILTER (occurred_at > as_of) AS n_future FROM c_events, a WHERE occurred_at <= as_of GROUP BY 2
UNION ALL SELECT 'invoices', as_of, count(*), count(*) FILTER (available_at > as_of),
  count(*) FILTER (attempted_at > as_of) FROM c_inv, a WHERE attempted_at <= as_of GROUP BY 2
UNION ALL SELECT 'subscriptions', as_of, count(*), 0, 0 FROM c_subs, a WHERE started_at <= as_of GROUP BY 2
UNION ALL SELECT 'tickets', as_of, count(*), count(*) FILTER (available_at > as_of),
  count(*) FILTER (opened_at > as_of) FROM c_tickets, a WHERE opened_at <= as_of GROUP BY 2
UNION ALL SELECT 'interventions', as_of, count(*), 0, 0 FROM c_touch, a GROUP BY 2""")
def _availability(spark, d):
    return leakage.audit_availability(src.dataset(spark, d), ft.standard_specs(),
                                      [dt.datetime(2024, 1, 20)], ft.OCCURRED_ONLY)


def _travel(spark, d, mode):
    """The same as-of moment, seen from data known on 2024-01-20 and from all data."""
    ds, early = src.dataset(spark, d), src.dataset(spark, d)
    early.events = early.events.filter("available_at <= timestamp_ntz'2024-01-20'")
    a = dt.datetime(2024, 1, 20)
    spine = ds.customers.select("customer_id", F.lit(a).cast("timestamp_ntz").alias("as_of"))
    specs = [s for s in ft.standard_specs() if s.table == "events"]
    return leakage.audit_time_travel(ft.panel(early, spine, [a], specs, mode),
                                     ft.panel(ds, spine, [a], specs, mode),
                                     [s.name for s in specs])


def _moved(mode, cond):
    w = "f.occurred_at > TIMESTAMP '2024-01-20' - INTERVAL {} DAY"
    f = [("sessions_30d", f"count(*) FILTER ({SES} AND {w.format(30)} AND {{}})"),
         ("sessions_prev_30d", f"count(*) FILTER ({SES} AND {w.format(60)} AND {{}})"),
         ("days_since_last_session", f"max(f.occurred_at) FILTER ({SES} AND {w.format(365)} AND {{}})"),
         ("distinct_features_30d", f"count(DISTINCT f.name) FILTER ({w.format(30)} AND {{}})")]
    known = "f.available_at <= TIMESTAMP '2024-01-20'"
    return "\nUNION ALL ".join(
        f"SELECT '{mode}' AS mode, '{n}' AS feature, count(*) FILTER (a IS DISTINCT FROM b) AS changed FROM "
        f"(SELECT {e.format(known + ' AND ' + cond)} AS a, {e.format(cond)} AS b FROM c_events f GROUP BY customer_id)"
        for n, e in f)


@query("time_travel_audit", "L2 F2", _moved("available_at", "f.available_at <= TIMESTAMP '2024-01-20'")
       + "\nUNION ALL " + _moved("occurred_at", "f.occurred_at <= TIMESTAMP '2024-01-20'"))
def _time_travel(spark, d):
    return union_all([_travel(spark, d, m).withColumn("mode", F.lit(m))
                      for m in (ft.SAFE, ft.OCCURRED_ONLY)])


AUC_SQL = """
WITH r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY x)
    + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM f),
a AS (SELECT feature, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
    / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY 1)"""


@query("single_feature_auc", "L3", """
WITH f AS (SELECT 'x1' AS feature, x1 AS x, y FROM c_trial UNION ALL SELECT 'x2', x2, y FROM c_trial
  UNION ALL SELECT 'x3', x3, y FROM c_trial UNION ALL SELECT 'leak', y * 3 + unit % 2, y FROM c_trial),
""" + AUC_SQL.strip()[5:] + """
SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc, greatest(auc, 1 - auc) >= 0.85 AS suspicious FROM a""")
def _auc(spark, d):
    t = src.trial(spark, d).withColumn("leak", F.col("y") * 3 + F.col("unit") % 2).withColumn(
        "flat", F.lit(1.0))
    a = leakage.single_feature_auc(t, ["x1", "x2", "x3", "leak", "flat"], "y")
    return a.filter("auc IS NOT NULL").select(
        "feature", F.round("auc", 6).alias("auc"),
        (F.col("auc") >= leakage.SUSPICIOUS).alias("suspicious"))


@query("canary_detection", "L3 L4", f"""
WITH f AS (SELECT 'x1' AS feature, x1 AS x, y FROM c_trial UNION ALL SELECT 'x2', x2, y FROM c_trial
  UNION ALL SELECT 'x3', x3, y FROM c_trial UNION ALL SELECT 'canary_leaked_outcome',
    CASE WHEN {u('flip-0-', 'unit')} > 0.9 THEN 1.0 - y ELSE y END::DOUBLE + ({u('noise-0-', 'unit')} - 0.5) * 0.03::DOUBLE, y FROM c_trial),
""" + AUC_SQL.strip()[5:] + """
SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc FROM a WHERE greatest(auc, 1 - auc) >= 0.85""")
def _canary(spark, d):
    t = leakage.inject_canary(src.trial(spark, d), "y", F.col("unit"))
    return rounded(leakage.suspicious(t, ["x1", "x2", "x3", "canary_leaked_outcome"], "y"))


@query("logistic_model_auc", "L5")
def _model_auc(spark, d):
    return leakage.model_auc(src.trial(spark, d), ["x1", "x2", "x3"], "y")


@query("leakage_penalty", "L6 F2")
def _penalty(spark, d):
    """The same panel under the safe gate and the two broken ones, scored by one model;
    `inflation` is how much a broken gate adds to the honest AUC."""
    ds = src.dataset(spark, d)
    spine = ft.at_risk_spine(ds.subscriptions, AS_OFS)
    exits = ds.subscriptions.filter("cancel_reason = 'voluntary'").select(
        "customer_id", "ended_at")
    label = (spine.join(exits, "customer_id", "left")
             .groupBy("customer_id", "as_of")
             .agg(F.max(((F.col("ended_at") > F.col("as_of"))
                         & (F.col("ended_at") <= F.col("as_of") + F.expr("INTERVAL '90' DAY")))
                        .cast("int")).alias("y")).fillna(0, ["y"]))
    label = written(label, "label")
    # The written labels are estimated by their compressed size, far below what a broadcast of them takes.
    panels = written(ft.standard_panel(ds, label, AS_OFS, ft.MODES).join(
        label.hint("merge"), ["customer_id", "as_of"]), "panels", "mode")
    parts = [leakage.model_auc(panels.filter(F.col("mode") == m), ft.feature_names(), "y").select(
        F.lit(m).alias("mode"), "n", "n_pos", "auc") for m in ft.MODES]
    honest = cut(parts[0])
    return union_all([honest, *parts[1:]]).withColumn(
        "inflation", F.col("auc") - honest.select("auc").scalar())


_AHEAD = " + ".join(
    f"(SELECT count(*) FROM {t}, a WHERE {t}.available_at <= a.as_of AND {t}.{at} > a.as_of)"
    for t, at in (("c_events", "occurred_at"), ("c_inv", "attempted_at"), ("c_subs", "started_at"),
                  ("c_tickets", "opened_at"), ("c_touch", "sent_at")))


@query("leakage_report", "L7", """
WITH f AS (SELECT 'x1' AS feature, x1 AS x, y FROM c_trial UNION ALL SELECT 'x2', x2, y FROM c_trial
  UNION ALL SELECT 'x3', x3, y FROM c_trial),
""" + AUC_SQL.strip()[5:] + f""",
m AS ({_moved("available_at", "f.available_at <= TIMESTAMP '2024-01-20'")}),
a0 AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS k FROM (VALUES {_VALUES}) v(as_of)),
l AS (SELECT 3 AS checks_run, (WITH a AS (SELECT as_of FROM a0 WHERE k > 3) SELECT {_AHEAD}) AS rows_ahead,
  (SELECT CAST(sum(changed) AS BIGINT) FROM m) AS values_moved,
  (SELECT count(*) FROM a WHERE greatest(auc, 1 - auc) >= 0.85) AS suspicious)
SELECT *, rows_ahead = 0 AND values_moved = 0 AND suspicious = 0 AS passed FROM l""")
def _report(spark, d):
    ds = src.dataset(spark, d)
    t = src.trial(spark, d)
    return leakage.report(
        leakage.audit_availability(ds, ft.standard_specs(), AS_OFS[3:]),
        _travel(spark, d, ft.SAFE), leakage.suspicious(t, ["x1", "x2", "x3"], "y"), 3)
