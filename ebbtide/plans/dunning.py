"""Queries for retry policies over the failed invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dunning as dn
from ..sources import canonical as src
from .churn import rounded
from .registry import query

# Hours and minutes vary by line, so that timing matters.
FAIL = """
fl AS (SELECT l_orderkey, l_linenumber, l_partkey, (['insufficient_funds', 'expired_card', 'do_not_honor', 'generic_decline', 'processing_error', 'lost_or_stolen_card'])[(l_partkey % 6) + 1] AS code,
  l_shipdate + to_minutes(CAST((l_partkey * 37) % 1440 AS INTEGER)) AS failed_at, floor(l_extendedprice * (1 - l_discount)) / 100.0::DOUBLE AS amount
  FROM lineitem WHERE l_returnflag = 'R'),
cd AS (SELECT * FROM (VALUES ('insufficient_funds', 0.72::DOUBLE, 0.80::DOUBLE, true), ('expired_card', 0.13, 0.30, false), ('do_not_honor', 0.38, 0.70, false),
  ('generic_decline', 0.30, 0.70, false), ('processing_error', 0.88, 0.55, false), ('lost_or_stolen_card', 0.02, 0.25, false)) c(code, ceiling, decay, pay))"""


def failures(spark, d):
    return src.raw(spark, d, "lineitem").filter("l_returnflag = 'R'").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "element_at(array('insufficient_funds', 'expired_card', 'do_not_honor', "
        "'generic_decline', 'processing_error', 'lost_or_stolen_card'), "
        "cast(l_partkey % 6 AS int) + 1) AS code",
        "l_shipdate + make_dt_interval(0, 0, cast((l_partkey * 37) % 1440 AS int)) AS failed_at",
        "floor(l_extendedprice * (1 - l_discount)) / 100.0D AS amount")


def payday(base):
    m = f"date_trunc('month', {base})"
    days = "[" + ", ".join(f"{m} + INTERVAL {d - 1} DAY + INTERVAL 10 HOUR" for d in (1, 2, 3, 15, 16, 17)) + "]"
    return (f"coalesce(list_min(list_filter({days}, lambda x: x >= {base})), "
            f"{m} + INTERVAL 1 MONTH + INTERVAL 10 HOUR)")


def timing(ts, pay):
    gap = "least(" + ", ".join(f"least(abs(day({ts}) - {d}), 31 - abs(day({ts}) - {d}))" for d in (1, 2, 3, 15, 16, 17)) + ")"
    return (f"(CASE WHEN {pay} THEN 0.62 + (1.45 - 0.62) * exp(-({gap}) / 2.5) ELSE 1.0 END * "
            f"CASE WHEN isodow({ts}) < 6 AND hour({ts}) BETWEEN 9 AND 17 THEN 1.12 ELSE 0.88 END)")


# The schedules as literal rows of the reference text.
POLICY = """
pl AS (SELECT policy, code, unnest(offs) AS off, unnest(range(1, len(offs) + 1)) AS step FROM (
  SELECT p AS policy, code, o AS offs FROM cd, (VALUES ('processor_default', [1.0, 3.0, 5.0, 7.0]::DOUBLE[]), ('fixed_smart', [0.02, 2.0, 6.0, 12.0, 20.0]),
    ('aggressive', [0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 10.0])) f(p, o)
  UNION ALL SELECT p, code, CASE code WHEN 'processing_error' THEN [0.01, 0.5, 2.0]::DOUBLE[] WHEN 'insufficient_funds' THEN [1.0, 2.0, 3.0, 4.0]
    WHEN 'expired_card' THEN [2.0, 9.0] WHEN 'lost_or_stolen_card' THEN [1.0] WHEN 'do_not_honor' THEN [2.0, 7.0, 14.0] ELSE [1.0, 4.0, 10.0] END
    FROM cd, (VALUES ('code_aware'), ('code_aware_quiet')) q(p))),
em AS (SELECT *, CAST(CASE policy WHEN 'code_aware_quiet' THEN step IN (1, 3) WHEN 'aggressive' THEN true ELSE step <= 3 END AS INT) AS mail FROM pl)"""
ATTEMPTS = f"""
{FAIL.strip()},
{POLICY.strip()},
at1 AS (SELECT f.*, policy, step, mail, ceiling, decay, pay, CASE WHEN policy LIKE 'code_aware%' AND f.code = 'insufficient_funds'
  THEN {payday("(f.failed_at + to_microseconds(CAST(round(off * 86400000000.0) AS BIGINT)))")}
  ELSE f.failed_at + to_microseconds(CAST(round(off * 86400000000.0) AS BIGINT)) END AS retry_at FROM fl f JOIN em USING (code) JOIN cd USING (code)),
at2 AS (SELECT *, least(greatest(ceiling * pow(decay, step - 1) * {timing('retry_at', 'pay')} * 0.4764, 0), 0.98) AS p FROM at1),
at3 AS (SELECT *, coalesce(product(1 - p) OVER w, 1.0) AS reach, sum(mail) OVER (PARTITION BY policy, rid ORDER BY step) AS sent FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || failed_at || '-' || amount AS rid FROM at2)
  WINDOW w AS (PARTITION BY policy, rid ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("decline_code_profile", "D1", f"""
WITH {FAIL.strip()} SELECT code, ceiling, decay, pay AS follows_payday, count(*) AS n, round(sum(amount), 2) AS amount FROM fl JOIN cd USING (code) GROUP BY 1, 2, 3, 4""")
def _codes(spark, d):
    codes = F.broadcast(dn.code_table(spark))  # six rows
    return (failures(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"),
                                                   F.round(F.sum("amount"), 2).alias("amount"))
            .join(codes, "code").select("code", "ceiling", "decay", "follows_payday", "n", "amount"))


@query("scheduled_attempts", "D2", f"""
WITH {FAIL.strip()},
{POLICY.strip()} SELECT policy, CAST(step AS INTEGER) AS step, count(*) AS n, count(*) FILTER (mail = 1) AS n_emails FROM fl JOIN em USING (code) GROUP BY 1, 2""")
def _scheduled(spark, d):
    """Policy rows meet decline-code counts, not failures."""
    per = failures(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("k"))
    table = F.broadcast(dn.policy_table(spark))  # a fixed table of about 120 rows
    return per.join(table, "code").groupBy("policy", "step").agg(
        F.sum("k").alias("n"), F.sum(F.when(F.col("emails"), F.col("k")).otherwise(0)).alias("n_emails"))


@query("next_payday", "D3", f"""
WITH {FAIL.strip()} SELECT l_orderkey, l_linenumber, failed_at, {payday("(failed_at + INTERVAL 1 DAY)")} AS payday,
  {payday("(failed_at + INTERVAL 13 DAY)")} AS payday_after_13 FROM fl""")
def _payday(spark, d):
    return failures(spark, d).select(
        "l_orderkey", "l_linenumber", "failed_at", dn.next_payday(F.col("failed_at")).alias("payday"),
        dn.next_payday(F.col("failed_at"), min_days=13.0).alias("payday_after_13"))


@query("retry_timing", "D4", f"""
WITH {FAIL.strip()} SELECT l_orderkey, l_linenumber, failed_at, round({timing('failed_at', 'true')}, 6) AS payday_timing, {timing('failed_at', 'false')} AS other_timing FROM fl""")
def _timing(spark, d):
    t = F.col("failed_at")
    return failures(spark, d).select(
        "l_orderkey", "l_linenumber", "failed_at",
        F.round(dn.timing(t, F.lit(True)), 6).alias("payday_timing"),
        dn.timing(t, F.lit(False)).alias("other_timing"))


@query("retry_success_probability", "D5", f"""
WITH {FAIL.strip()} SELECT l_orderkey, l_linenumber, failed_at, code, round(least(ceiling * {timing('failed_at', 'pay')} * 0.4764, 0.98), 6) AS first,
  round(least(ceiling * decay * decay * {timing('failed_at', 'pay')} * 0.4764, 0.98), 6) AS third,
  round(least(CASE WHEN code IN ('expired_card', 'lost_or_stolen_card') THEN 0.55 ELSE ceiling END * {timing('failed_at', 'pay')} * 0.4764, 0.98), 6) AS with_updater
FROM fl JOIN cd USING (code)""")
def _probability(spark, d):
    c, t = F.col("code"), F.col("failed_at")
    return failures(spark, d).select(
        "l_orderkey", "l_linenumber", "failed_at", "code",
        F.round(dn.success_probability(c, 1, t), 6).alias("first"),
        F.round(dn.success_probability(c, 3, t), 6).alias("third"),
        F.round(dn.success_probability(c, 1, t, dn.Config(card_updater=True)), 6)
        .alias("with_updater"))


@query("retry_schedule", "D6 D3", f"""
WITH {ATTEMPTS.strip()} SELECT l_orderkey, l_linenumber, l_partkey, failed_at, amount, policy, CAST(step AS INTEGER) AS step, retry_at, round(p, 6) AS p, round(reach, 6) AS reach
FROM at3 WHERE policy = 'code_aware'""")
def _schedule(spark, d):
    return rounded(dn.schedule(failures(spark, d), dn.CODE_AWARE,
                               ["l_orderkey", "l_linenumber", "l_partkey", "failed_at", "amount"]))


@query("expected_recovery", "D6", f"""
WITH {ATTEMPTS.strip()} SELECT code, count(DISTINCT rid) AS n, round(sum(p * reach), 4) AS recovery, round(sum(reach), 4) AS attempts,
  round(sum(mail * reach), 4) AS emails FROM at3 WHERE policy = 'fixed_smart' GROUP BY 1""")
def _expected(spark, d):
    e = dn.expectations(failures(spark, d), dn.FIXED)
    return e.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("recovery"), 4).alias("recovery"),
        F.round(F.sum("attempts"), 4).alias("attempts"), F.round(F.sum("emails"), 4).alias("emails"))


@query("realised_recovery", "D6b")
def _realised(spark, d):
    f = failures(spark, d).withColumn("key", F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "failed_at"))
    r = dn.realise(f, dn.CODE_AWARE, "key")
    return r.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("recovered").cast("double")).alias("recovered"),
        F.avg("attempts").alias("attempts"), F.avg("emails").alias("emails"),
        F.avg("days_to_recovery").alias("days_to_recovery"))


@query("capped_lifetime", "D7", """
SELECT unit, round((1 - pow(1 - h, 36)) / h, 6) AS months FROM (SELECT unit, least(greatest(p0 / 5, 1e-6), 0.999) AS h FROM c_scored)""")
def _lifetime(spark, d):
    return src.scored(spark, d).select("unit", F.round(dn.lifetime_months(
        F.col("p0") / 5, 36), 6).alias("months"))


def lifetime(h):
    return f"((1 - pow(1 - {h}, 36)) / {h})"


def value_sql(fatigue="0.055"):
    base = lifetime("0.045::DOUBLE")
    after = lifetime(f"(1 / (1 + exp(-(ln(0.045 / (1 - 0.045)) + sent * {fatigue}))))")
    return f"""
v AS (SELECT policy, sum(p * reach) / n AS recovery_rate, sum(reach) / n AS attempts_per_failure, sum(mail * reach) / n AS emails_per_failure,
  sum(p * reach * amount * 0.8 * {base}) AS clv_retained, sum(p * reach * amount * 0.8 * ({base} - {after})) AS clv_lost_to_fatigue,
  sum(reach) * 0.1 + sum(mail * reach) * 0.02 AS operational_cost FROM at3, (SELECT count(*) AS n FROM fl) GROUP BY policy, n
  UNION ALL SELECT 'no_retry', 0, 0, 0, 0, 0, 0),
w AS (SELECT *, clv_retained - clv_lost_to_fatigue - operational_cost AS net_value FROM v)"""


@query("retry_policy_comparison", "D8 D9", f"""
WITH {ATTEMPTS.strip()}, {value_sql().strip()}, r AS (SELECT recovery_rate AS rr, net_value AS nv FROM w WHERE policy = 'processor_default')
SELECT policy, round(recovery_rate, 6) AS recovery_rate, round(attempts_per_failure, 6) AS attempts_per_failure, round(emails_per_failure, 6) AS emails_per_failure,
  round(clv_retained, 2) AS clv_retained, round(clv_lost_to_fatigue, 2) AS clv_lost_to_fatigue, round(operational_cost, 2) AS operational_cost, round(net_value, 2) AS net_value,
  round(recovery_rate - rr, 6) AS recovery_gain, round(net_value - nv, 2) AS net_gain FROM w, r""")
def _compare(spark, d):
    c = dn.compare(failures(spark, d))
    c = rounded(c, 2, ["clv_retained", "clv_lost_to_fatigue", "operational_cost", "net_value",
                       "net_gain"])
    return rounded(c)


@query("email_fatigue_sweep", "D10", f"""
WITH {ATTEMPTS.strip()}, fa AS (SELECT unnest([0.0, 0.1, 0.3]::DOUBLE[]) AS f)
SELECT f AS fatigue, policy, round(sum(p * reach * amount * 0.8 * {lifetime("(1 / (1 + exp(-(ln(0.045 / (1 - 0.045)) + sent * f))))")}) - sum(reach) * 0.1 - sum(mail * reach) * 0.02, 2) AS net_value
FROM at3, fa WHERE policy IN ('code_aware_quiet', 'aggressive') GROUP BY 1, 2""")
def _fatigue(spark, d):
    return rounded(dn.fatigue_sweep(failures(spark, d), [0.0, 0.1, 0.3]), 2)
