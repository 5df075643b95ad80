"""Queries over billing facts: validation, preflight, churn diagnostic, worklists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.money import label
from ..operators import churn, preflight, validation, worklists
from ..sources import canonical as src
from .registry import query

NOW = dt.datetime(2024, 6, 1)


def rounded(df, places=6, only=None):
    """Round every double column, so that summation order does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" and (not only or c in only)
                       else F.col(c) for c, t in df.dtypes])


FAILED = """
SELECT f.*, EXISTS (SELECT 1 FROM c_inv p WHERE p.status = 'paid'
    AND p.customer_id = f.customer_id AND p.attempted_at > f.attempted_at
    AND p.attempted_at <= f.attempted_at + INTERVAL 30 DAY) AS recovered
FROM c_inv f WHERE f.status = 'failed'"""


@query("decline_mix", "A5 A7", f"""
SELECT coalesce(failure_code, 'unknown') AS code, count(*) AS n, round(sum(amount), 2) AS amount,
       round(avg(CAST(recovered AS DOUBLE)), 6) AS recovery_rate
FROM ({FAILED}) GROUP BY 1""")
def _decline_mix(spark, d):
    mix = churn.decline_mix(churn.failures(src.invoices(spark, d)))
    return (mix.withColumn("amount", F.round("amount", 2))
            .withColumn("recovery_rate", F.round("recovery_rate", 6))
            .orderBy(F.desc("amount")))


@query("failed_invoice_recovery", "A5", f"""
SELECT customer_id, attempted_at, amount, recovered FROM ({FAILED})""")
def _recovery(spark, d):
    return churn.failures(src.invoices(spark, d)).select(
        "customer_id", "attempted_at", "amount", "recovered")


@query("payment_recovery", "A6", f"""
SELECT count(*) AS n_failures, round(sum(amount), 2) AS failed_amount,
       round(sum(amount) FILTER (recovered), 2) AS recovered_amount,
       round(sum(amount) FILTER (recovered) / sum(amount), 6) AS recovery_rate FROM ({FAILED})""")
def _payments(spark, d):
    p = churn.payments(churn.failures(src.invoices(spark, d)))
    return p.select("n_failures", F.round("failed_amount", 2).alias("failed_amount"),
                    F.round("recovered_amount", 2).alias("recovered_amount"),
                    F.round("recovery_rate", 6).alias("recovery_rate"))


BOOK = """
SELECT count(*) AS n_subscriptions, count(*) FILTER (ended_at IS NULL) AS n_active,
       count(ended_at) AS n_churned,
       round(sum(mrr) FILTER (ended_at IS NULL), 2) AS mrr_active,
       round(sum(mrr) FILTER (ended_at IS NOT NULL), 2) AS mrr_lost,
       round(sum(mrr), 2) AS mrr_total,
       CAST(date_diff('day', min(started_at), greatest(max(started_at), max(ended_at))) AS DOUBLE)
         AS window_days
FROM c_subs"""


@query("subscription_book", "A1 A2 A3 A4", f"""
SELECT *, round(n_churned / n_subscriptions / (window_days / 30.44), 8) AS monthly_logo_churn,
       round(mrr_lost / mrr_total / (window_days / 30.44), 8) AS monthly_revenue_churn,
       round(mrr_active * 12, 2) AS arr_active FROM ({BOOK})""")
def _book(spark, d):
    b = churn.book(src.subscriptions(spark, d))
    money = ["mrr_active", "mrr_lost", "mrr_total", "arr_active"]
    return rounded(rounded(b, 2, money), 8, ["monthly_logo_churn", "monthly_revenue_churn"])


INVOLUNTARY = f"""
SELECT s.*, EXISTS (SELECT 1 FROM ({FAILED}) f WHERE NOT f.recovered
    AND f.customer_id = s.customer_id AND f.attempted_at >= s.ended_at - INTERVAL 45 DAY
    AND f.attempted_at <= s.ended_at + INTERVAL 1 DAY) AS after_failure
FROM c_subs s WHERE s.ended_at IS NOT NULL"""


@query("involuntary_departures", "A8", f"""
SELECT count(*) AS n_departures, count(DISTINCT customer_id) FILTER (after_failure)
         AS n_involuntary FROM ({INVOLUNTARY})""")
def _involuntary(spark, d):
    inv = churn.failures(src.invoices(spark, d))
    return churn.involuntary(src.subscriptions(spark, d), inv).agg(
        F.count(F.lit(1)).alias("n_departures"),
        F.countDistinct(F.when(F.col("after_failure"), F.col("customer_id")))
        .alias("n_involuntary"))


@query("retention_curve", "A9", """
WITH e AS (SELECT greatest(max(started_at), max(ended_at)) AS seen FROM c_subs),
t AS (SELECT (epoch_us(coalesce(ended_at, seen)) - epoch_us(started_at))
             / 86400000000.0::DOUBLE / 30.44::DOUBLE AS tenure, ended_at IS NOT NULL AS gone
      FROM c_subs, e),
m AS (SELECT CAST(i AS INTEGER) AS month, (SELECT count(*) FROM t WHERE tenure >= i) AS at_risk,
             (SELECT count(*) FROM t WHERE gone AND tenure >= i AND tenure < i + 1) AS churned
      FROM range(0, 25) r(i))
SELECT month, at_risk, churned, round(product(CASE WHEN month = 0 THEN 1.0::DOUBLE
         ELSE 1 - churned / at_risk END) OVER (ORDER BY month), 6) AS retention
FROM m WHERE at_risk > 0""")
def _retention(spark, d):
    return rounded(churn.retention_curve(src.subscriptions(spark, d)))


METRICS = f"""
SELECT b.*, p.*, i.n_involuntary, c.n_customers FROM ({BOOK}) b,
 (SELECT count(*) AS n_failures, sum(amount) AS failed_amount,
         sum(amount) FILTER (recovered) AS recovered_amount FROM ({FAILED})) p,
 (SELECT count(DISTINCT customer_id) FILTER (after_failure) AS n_involuntary
  FROM ({INVOLUNTARY})) i,
 (SELECT count(*) AS n_customers FROM c_customers) c"""


@query("churn_diagnostic", "A1 A2 A3 A4 A6 A8 A10 A11 S11", f"""
SELECT n_customers, n_active, n_churned, n_failures, n_involuntary,
       round(recovered_amount / failed_amount, 6) AS recovery_rate,
       round(n_involuntary / n_churned, 6) AS involuntary_share,
       round(mrr_active * (mrr_lost / mrr_total / (window_days / 30.44)) * 12, 2)
         AS annual_churn_cost, 'USD' AS currency FROM ({METRICS})""")
def _diagnostic(spark, d):
    m = churn.metrics(src.dataset(spark, d))
    return m.select("n_customers", "n_active", "n_churned", "n_failures", "n_involuntary",
                    F.round("recovery_rate", 6).alias("recovery_rate"),
                    F.round("involuntary_share", 6).alias("involuntary_share"),
                    F.round("annual_churn_cost", 2).alias("annual_churn_cost"), "currency")


@query("ranked_findings", "A12 A13", f"""
WITH m AS ({METRICS}), top AS (
  SELECT coalesce(failure_code, 'unknown') AS code, sum(amount) AS amount,
         avg(CAST(recovered AS DOUBLE)) AS rate FROM ({FAILED}) GROUP BY 1
  ORDER BY amount DESC LIMIT 1),
cost AS (SELECT mrr_active * (mrr_lost / mrr_total / (window_days / 30.44)) * 12 AS c FROM m)
SELECT 'recovery_gap' AS finding, NULL AS subject, false AS measured,
       round(failed_amount * 365 / window_days * (0.55 - recovered_amount / failed_amount), 2)
         AS annual_value FROM m WHERE recovered_amount / failed_amount < 0.55
UNION ALL SELECT 'recovery_strong', NULL, true,
       round(failed_amount * 365 / window_days * (1 - recovered_amount / failed_amount), 2)
       FROM m WHERE recovered_amount / failed_amount >= 0.55
UNION ALL SELECT 'involuntary_share', NULL, true, round(c * n_involuntary / n_churned, 2)
       FROM m, cost WHERE n_involuntary / n_churned > 0.15
UNION ALL SELECT 'top_decline_code', code, true,
       round(amount * 365 / window_days * (1 - rate), 2) FROM m, top
UNION ALL SELECT 'annual_churn_cost', NULL, true, round(c, 2) FROM cost""")
def _findings(spark, d):
    ds = src.dataset(spark, d)
    failed = churn.written_failures(ds.invoices)
    return churn.findings(churn.metrics(ds, failed), churn.decline_mix(failed)).select(
        "finding", "subject", F.round("annual_value", 2).alias("annual_value"), "measured")


@query("report_tiles", "A14 A18", f"""
SELECT CAST(CAST(round_even(100 * recovered_amount / failed_amount, 0) AS INTEGER) AS VARCHAR)
         || '%' AS recovery,
       CAST(CAST(round_even(100.0 * n_involuntary / n_churned, 0) AS INTEGER) AS VARCHAR) || '%'
         AS involuntary,
       CASE WHEN n_involuntary / n_churned > 0.15 THEN 'fix_billing' ELSE 'causal_retention' END
         AS start_with FROM ({METRICS})""")
def _tiles(spark, d):
    return churn.tiles(churn.metrics(src.dataset(spark, d)))


@query("money_labels", "A15", """
WITH v AS (SELECT o_orderkey, (o_orderkey % 5 - 1) * o_totalprice * (o_orderkey % 97) AS x,
  (['USD', 'INR', NULL, 'CHF', 'EUR'])[(o_orderkey % 5) + 1] AS cur FROM orders),
w AS (SELECT o_orderkey, cur, CASE WHEN x < 0 THEN '-' ELSE '' END AS sg, abs(x) AS v FROM v)
SELECT o_orderkey, sg || CASE cur WHEN 'USD' THEN '$' WHEN 'INR' THEN '₹' WHEN 'CHF' THEN 'CHF '
         WHEN 'EUR' THEN '€' ELSE '' END ||
   CASE WHEN cur = 'INR' AND v >= 1e7 THEN printf('%.2f crore', v / 1e7)
        WHEN cur = 'INR' AND v >= 1e5 THEN printf('%.1f lakh', v / 1e5)
        WHEN coalesce(cur, '') <> 'INR' AND v >= 1e6 THEN printf('%.2f million', v / 1e6)
        ELSE format('{:,}', CAST(round_even(v, 0) AS BIGINT)) END AS label
FROM w""")
def _labels(spark, d):
    o = src.raw(spark, d, "orders")
    x = (F.col("o_orderkey") % 5 - 1) * F.col("o_totalprice") * (F.col("o_orderkey") % 97)
    cur = F.element_at(F.array(*[F.lit(v) for v in ("USD", "INR", None, "CHF", "EUR")]),
                       (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", label(x, cur).alias("label"))


def step_sql(code: str) -> str:
    return f"""CASE {code} WHEN 'insufficient_funds' THEN 'retry_on_payday'
  WHEN 'expired_card' THEN 'request_new_card' WHEN 'lost_or_stolen_card' THEN 'request_new_card'
  WHEN 'do_not_honor' THEN 'retry_spaced_3' WHEN 'generic_decline' THEN 'retry_spaced_3'
  WHEN 'processing_error' THEN 'retry_at_once' ELSE 'inspect_reason' END"""


@query("decline_code_advice", "A16", f"""
SELECT code, n, {step_sql('code')} AS action, CASE code WHEN 'insufficient_funds' THEN 0.72::DOUBLE
  WHEN 'expired_card' THEN 0.13 WHEN 'do_not_honor' THEN 0.38 WHEN 'generic_decline' THEN 0.30
  WHEN 'processing_error' THEN 0.88 WHEN 'lost_or_stolen_card' THEN 0.02 END AS best_recovery
FROM (SELECT coalesce(failure_code, 'unknown') AS code, count(*) AS n
      FROM ({FAILED}) GROUP BY 1)""")
def _advice(spark, d):
    mix = churn.decline_mix(churn.failures(src.invoices(spark, d)))
    return churn.code_notes(mix).select("code", "n", "action", "best_recovery")


@query("report_caveats", "A17", """
SELECT 'no_decline_codes' AS caveat FROM (SELECT count(*) AS n FROM c_inv
  WHERE status = 'failed' AND attempt_number = 9) WHERE n = 0
UNION ALL SELECT 'several_currencies' FROM (SELECT count(DISTINCT attempt_number) AS n FROM c_inv)
  WHERE n > 1""")
def _caveats(spark, d):
    ds = src.dataset(spark, d)
    ds.invoices = (ds.invoices.withColumn("failure_code", F.lit(None).cast("string"))
                   .withColumn("currency", F.concat(F.lit("c"), "attempt_number")))
    return churn.caveats(ds)


# --- worklists -------------------------------------------------------------------

SAME = """
SELECT f.*, EXISTS (SELECT 1 FROM c_inv p WHERE p.paid_at IS NOT NULL
    AND p.customer_id = f.customer_id AND abs(p.amount - f.amount) <= 0.01
    AND p.paid_at >= f.attempted_at) AS recovered
FROM c_inv f WHERE lower(f.status) IN ('failed', 'uncollectible')"""


@query("same_amount_recovery", "W1", f"""
SELECT recovered, count(*) AS n, round(sum(amount), 2) AS amount FROM ({SAME}) GROUP BY 1""")
def _same(spark, d):
    return worklists.same_amount_failures(src.invoices(spark, d)).groupBy("recovered").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("unrecovered_worklist", "W2", f"""
SELECT customer_id, amount, strftime(attempted_at, '%Y-%m-%d') AS failed_on,
  failure_code AS decline_reason, attempt_number, still AS still_subscribed,
  CASE WHEN still THEN 'collect:' ELSE 'win_back:' END || {step_sql('failure_code')}
    AS suggested_action
FROM (SELECT *, customer_id IN (SELECT customer_id FROM c_subs WHERE ended_at IS NULL) AS still
      FROM ({SAME}) WHERE NOT recovered)""")
def _unrecovered(spark, d):
    return worklists.unrecovered(src.invoices(spark, d), src.subscriptions(spark, d))


@query("departures_worklist", "W3", f"""
WITH s AS (SELECT * FROM c_subs WHERE ended_at IS NOT NULL),
flagged AS (SELECT DISTINCT s.customer_id FROM s JOIN ({SAME}) f
  ON f.customer_id = s.customer_id AND NOT f.recovered
  AND f.attempted_at >= s.ended_at - INTERVAL 45 DAY
  AND f.attempted_at <= s.ended_at + INTERVAL 1 DAY)
SELECT customer_id, plan, mrr, strftime(started_at, '%Y-%m-%d') AS started_at,
  strftime(ended_at, '%Y-%m-%d') AS ended_at,
  round_even((epoch_us(ended_at) - epoch_us(started_at)) / 86400000000.0 / 30.44, 1)
    AS months_subscribed, round_even(mrr * 12, 2) AS annual_value_lost,
  customer_id IN (SELECT customer_id FROM flagged) AS preceded_by_failed_payment FROM s""")
def _departures(spark, d):
    return worklists.departures(src.invoices(spark, d), src.subscriptions(spark, d))


KPI = """
SELECT round(avg(churn_voluntary), 8) AS monthly_voluntary_churn,
  round(avg(churn_involuntary), 8) AS monthly_involuntary_churn,
  round(sum(churn_involuntary) / greatest(sum(churn_voluntary) + sum(churn_involuntary), 1), 8)
    AS involuntary_share_of_churn,
  round(1 - (sum(churn_voluntary) + sum(churn_involuntary)) / count(*) FILTER (month = 0), 8)
    AS month_24_retention,
  round(avg(churn_voluntary) FILTER (month < 6) / avg(churn_voluntary) FILTER (month >= 12), 8)
    AS early_late_hazard_ratio FROM c_panel"""


@query("panel_indicators", "W4", KPI)
def _kpis(spark, d):
    return rounded(churn.indicators(src.panel(spark, d)), 8)


@query("indicator_bands", "W5", f"""
WITH k AS ({KPI}), r AS (
SELECT 'monthly_voluntary_churn' AS name, monthly_voluntary_churn AS value,
       0.03::DOUBLE AS low, 0.07::DOUBLE AS high FROM k
UNION ALL SELECT 'involuntary_share_of_churn', involuntary_share_of_churn, 0.2, 0.4 FROM k
UNION ALL SELECT 'month_24_retention', month_24_retention, 0.22, 0.5 FROM k
UNION ALL SELECT 'early_late_hazard_ratio', early_late_hazard_ratio, 1.15, 3.0 FROM k)
SELECT *, value BETWEEN low AND high AS within FROM r""")
def _bands(spark, d):
    return rounded(churn.band_check(churn.indicators(src.panel(spark, d))), 8)


# --- validation ------------------------------------------------------------------

@query("schema_violations", "V2 V3 V4 V5 V6", """
WITH dup AS (
  SELECT 'customers' AS "table", 'customer_id' AS k, count(*) - count(DISTINCT customer_id) AS n FROM c_customers
  UNION ALL SELECT 'subscriptions', 'subscription_id', count(*) - count(DISTINCT subscription_id) FROM c_subs
  UNION ALL SELECT 'invoices', 'invoice_id', count(*) - count(DISTINCT invoice_id) FROM c_inv
  UNION ALL SELECT 'events', 'event_id', count(*) - count(DISTINCT event_id) FROM c_events
  UNION ALL SELECT 'tickets', 'ticket_id', count(*) - count(DISTINCT ticket_id) FROM c_tickets
  UNION ALL SELECT 'interventions', 'intervention_id', count(*) - count(DISTINCT intervention_id) FROM c_touch),
orphan AS (
  SELECT 'subscriptions' AS "table", count(*) AS n FROM c_subs WHERE customer_id NOT IN (SELECT customer_id FROM c_customers)
  UNION ALL SELECT 'invoices', count(*) FROM c_inv WHERE customer_id NOT IN (SELECT customer_id FROM c_customers)
  UNION ALL SELECT 'events', count(*) FROM c_events WHERE customer_id NOT IN (SELECT customer_id FROM c_customers)
  UNION ALL SELECT 'tickets', count(*) FROM c_tickets WHERE customer_id NOT IN (SELECT customer_id FROM c_customers)
  UNION ALL SELECT 'interventions', count(*) FROM c_touch WHERE customer_id NOT IN (SELECT customer_id FROM c_customers)),
late AS (
  SELECT 'subscriptions' AS "table", count(*) AS n FROM c_subs WHERE available_at < started_at
  UNION ALL SELECT 'invoices', count(*) FROM c_inv WHERE available_at < attempted_at
  UNION ALL SELECT 'events', count(*) FROM c_events WHERE available_at < occurred_at
  UNION ALL SELECT 'tickets', count(*) FROM c_tickets WHERE available_at < opened_at
  UNION ALL SELECT 'interventions', count(*) FROM c_touch WHERE available_at < sent_at)
SELECT "table", 'duplicate_key' AS rule, k AS "column", CAST(n AS BIGINT) AS n FROM dup
UNION ALL SELECT "table", 'unknown_customer', 'customer_id', n FROM orphan
UNION ALL SELECT "table", 'available_before_occurred', 'available_at', n FROM late
UNION ALL SELECT 'all', 'null', 'all', (SELECT count(*) FROM c_inv WHERE amount IS NULL)""")
def _violations(spark, d):
    v = validation.violations(src.dataset(spark, d))
    nulls = v.filter("rule = 'null'").agg(F.sum("n").alias("n")).select(
        F.lit("all").alias("table"), F.lit("null").alias("rule"), F.lit("all").alias("column"),
        "n")
    return v.filter("rule <> 'null'").unionByName(nulls)


@query("repeated_line_keys", "V2", """
SELECT CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM lineitem
  GROUP BY l_orderkey, l_linenumber) WHERE c > 1""")
def _dups(spark, d):
    from ..schema import INVOICES
    inv = src.raw(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("invoice_id"))
    return validation.duplicate_keys(inv, INVOICES).select("n")


@query("early_availability", "V4", """
SELECT count(*) AS n FROM c_events WHERE available_at - INTERVAL 3 HOUR < occurred_at""")
def _early(spark, d):
    from ..schema import EVENTS
    ev = src.events(spark, d).withColumn(
        "available_at", F.col("available_at") - F.expr("INTERVAL '3' HOUR"))
    return (validation.row_rules(ev, EVENTS).filter("rule = 'available_before_occurred'")
            .select("n"))


@query("orphan_events", "V5", """
SELECT count(*) AS n FROM c_events WHERE customer_id NOT IN
  (SELECT customer_id FROM c_customers WHERE segment <> 'BUILDING')""")
def _orphans(spark, d):
    from ..schema import EVENTS
    return validation.orphans(src.events(spark, d),
                              src.customers(spark, d).filter("segment <> 'BUILDING'"),
                              EVENTS).select("n")


# --- preflight -------------------------------------------------------------------

@query("preflight_checks", "P1 P2 P3 P4 P5 P6 P7 P8 P9 P10", """
WITH s AS (SELECT count(*) AS n, quantile_cont(mrr, 0.5) FILTER (mrr > 0) AS med,
    bool_and(mrr % 1 = 0) FILTER (mrr > 0) AS whole,
    count(*) FILTER (ended_at < started_at) AS rev, count(ended_at) / count(*) AS ended,
    date_diff('day', min(started_at), max(started_at)) / 30.44 AS span FROM c_subs),
c AS (SELECT count(*) AS n, count(*) FILTER (customer_id NOT IN (SELECT customer_id FROM c_subs))
      AS never FROM c_customers)
SELECT 'money_units' AS "check", CASE WHEN med > 2000 AND whole THEN 'block'
   WHEN med > 2000 THEN 'warn' ELSE 'ok' END AS level, round(med, 6) AS value FROM s
UNION ALL SELECT 'currency', 'ok', 1.0
UNION ALL SELECT 'date_order', 'block', rev FROM s WHERE rev > 0
UNION ALL SELECT 'history', CASE WHEN span < 6 THEN 'block' ELSE 'warn' END, span FROM s WHERE span < 12
UNION ALL SELECT 'churn_signal', CASE WHEN ended = 0 THEN 'block' WHEN ended > 0.9 THEN 'warn'
   ELSE 'ok' END, round(ended, 6) FROM s
UNION ALL SELECT 'coverage', 'warn', never FROM c WHERE never > 0.5 * n
UNION ALL SELECT 'sample_size', 'warn', n FROM c WHERE n < 250""")
def _preflight(spark, d):
    return rounded(preflight.checks(src.dataset(spark, d), NOW))


@query("preflight_broken_export", "P1 P2 P3 P4 P5 P6 P7 P8 P9 P10 P11", """
SELECT 'BLOCKED' AS verdict, CAST(CASE WHEN count(*) < 250 THEN 9 ELSE 8 END AS BIGINT) AS n_checks, CAST(count(DISTINCT customer_id) AS BIGINT)
  AS n_customers, (SELECT count(*) FROM c_subs) AS n_subscriptions,
  (SELECT round(date_diff('day', min(started_at), max(started_at)) / 30.44, 6) FROM c_subs)
    AS window_months FROM c_customers""")
def _preflight_broken(spark, d):
    """Minor units, reversed and ancient dates, a clock in the past, no coverage, no invoices."""
    ds = src.dataset(spark, d)
    ds.subscriptions = (ds.subscriptions.withColumn("mrr", F.floor(F.col("mrr") * 1000.0)
                                                    .cast("double"))
                        .withColumn("ended_at", F.expr("ended_at - INTERVAL '20000' DAY"))
                        .withColumn("customer_id", F.concat(F.lit("x"), "customer_id")))
    ds.invoices = ds.invoices.filter("false")
    ds.stated = src.raw(spark, d, "nation").select(
        F.element_at(F.array(F.lit(" usd"), F.lit("EUR"), F.lit("unknown")),
                     F.col("n_nationkey") % 3 + 1).alias("currency"))
    return rounded(preflight.summary(ds, dt.datetime(1990, 1, 1)))


@query("stated_currencies", "S10", """
SELECT DISTINCT upper(trim(x)) AS currency FROM (SELECT (['usd', ' EUR ', 'unknown', 'nan', '',
  'None', NULL])[(o_orderkey % 7) + 1] AS x FROM orders)
WHERE upper(trim(x)) NOT IN ('', 'UNKNOWN', 'NAN', 'NONE')""")
def _currencies(spark, d):
    from ..sources.csv_export import stated_currencies
    words = F.array(*[F.lit(w) for w in ("usd", " EUR ", "unknown", "nan", "", "None", None)])
    raw = src.raw(spark, d, "orders").select(
        F.element_at(words, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("Plan Currency"))
    return stated_currencies(raw)
