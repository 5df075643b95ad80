"""Queries for trial, survival and panel shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shaping
from ..sources import canonical as src
from .churn import rounded
from ..sources.trials import TrialSpec, load_trial
from .registry import query
from .sqltext import u


@query("two_arm_trial", "N1", """
SELECT c_custkey AS unit, CAST(c_custkey % 3 = 1 AS INTEGER) AS t, c_acctbal AS history,
  round(ln(1 + greatest(c_acctbal, 0)), 6) AS log_history,
  CAST(c_mktsegment = 'BUILDING' AS INTEGER)::DOUBLE AS c_mktsegment_building,
  CAST(c_mktsegment = 'FURNITURE' AS INTEGER)::DOUBLE AS c_mktsegment_furniture
FROM customer WHERE c_custkey % 3 IN (0, 1)""")
def _two_arm(spark, d):
    arm = F.element_at(F.array(F.lit("none"), F.lit("mail"), F.lit("post")),
                       (F.col("c_custkey") % 3 + 1).cast("int"))
    df = src.raw(spark, d, "customer").withColumn("arm", arm)
    return shaping.two_arms(df, "arm", "mail", "none").select(
        F.col("c_custkey").alias("unit"), "t", F.col("c_acctbal").alias("history"),
        F.round(F.log1p(F.greatest("c_acctbal", F.lit(0.0))), 6).alias("log_history"),
        *shaping.indicators(df, {"c_mktsegment": ["BUILDING", "FURNITURE"]}))


@query("pruned_trial_scan", "N2 N4", """
SELECT 'discount' AS rate, round(avg(l_discount), 6) AS observed, 0.05::DOUBLE AS published,
  abs(avg(l_discount) - 0.05) <= 0.2 * 0.05 AS passed FROM lineitem
UNION ALL SELECT 't', round(avg(CAST(l_returnflag = 'R' AS DOUBLE)), 6), 0.85::DOUBLE,
  abs(avg(CAST(l_returnflag = 'R' AS DOUBLE)) - 0.85) <= 0.2 * 0.85 FROM lineitem
UNION ALL SELECT 'tax', round(avg(l_tax), 6), 0.04::DOUBLE,
  abs(avg(l_tax) - 0.04) <= 0.2 * 0.04 FROM lineitem""")
def _scan(spark, d):
    """Three columns reach the scan; everything else is pruned."""
    df = src.raw(spark, d, "lineitem").select(
        F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").cast("tinyint").alias("t"), F.col("l_tax").alias("tax"))
    return rounded(shaping.representative(df, {"discount": 0.05, "t": 0.85, "tax": 0.04}))


# The rates of line items by which the given tables are made.
RATES = {"t": 0.333, "l_tax": 0.04}


@query("loaded_trial", "N2 N4 N19", """
SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INT) AS t, l_tax AS y, l_quantity FROM lineitem""")
def _loaded(spark, d):
    """Line items as a trial that must have its known rates; the shipping mode comes later."""
    lines = src.raw(spark, d, "lineitem").withColumn("t", (F.col("l_returnflag") == "R").cast("int"))
    spec = TrialSpec("t", ["l_tax", "l_discount"], ["l_linenumber", "l_quantity"],
                     frozenset({"l_shipmode"}), RATES, "l_orderkey")
    return load_trial(lines, spec, "l_tax")


@query("trial_rate_gate", "N4", """
WITH l AS (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS t, l_tax FROM lineitem),
c AS (SELECT 'whole' AS frame, * FROM l UNION ALL SELECT 'one arm', * FROM l WHERE t = 1
  UNION ALL SELECT 'half of the rest', * FROM l WHERE t = 1 OR l_tax < 0.04),
o AS (SELECT frame, avg(t) AS t, avg(l_tax) AS l_tax FROM c GROUP BY 1),
r AS (SELECT frame, 't' AS rate, t AS observed, 0.333::DOUBLE AS published FROM o UNION ALL SELECT frame, 'l_tax', l_tax, 0.04 FROM o)
SELECT frame, rate, round(observed, 6) AS observed, published,
  abs(observed - published) <= 0.2 * published AND NOT (rate = 't' AND observed IN (0, 1)) AS passed FROM r""")
def _gate(spark, d):
    """The same known rates against the whole file, one arm, and a file that lost rows of one arm."""
    lines = src.raw(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("t"), "l_tax")
    frames = {"whole": lines, "one arm": lines.filter("t = 1"),
              "half of the rest": lines.filter("t = 1 OR l_tax < 0.04")}
    parts = [shaping.representative(f, RATES).select(F.lit(name).alias("frame"), "*")
             for name, f in frames.items()]
    return rounded(reduce(DataFrame.unionByName, parts))


@query("adaptive_encoder", "N3", """
SELECT o_orderkey, o_totalprice,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority,
  CASE WHEN o_orderkey % 4 = 0 THEN -1.0::DOUBLE ELSE CASE o_orderstatus WHEN 'F' THEN 0.0::DOUBLE WHEN 'O' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END END AS o_orderstatus,
  CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(o_custkey AS DOUBLE) END AS o_custkey
FROM orders""")
def _encode(spark, d):
    df = src.raw(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority",
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.concat(F.lit("text "), "o_orderkey").alias("note"))
    return shaping.encode(df, ["o_orderkey"], df.columns[1:])


@query("top_variance_features", "N3", """
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(l_partkey AS DOUBLE) AS l_partkey FROM lineitem""")
def _variance(spark, d):
    df = src.raw(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_quantity", "l_tax")
    return shaping.encode(df, ["l_orderkey", "l_linenumber"], df.columns[2:], max_features=2)


@query("random_row_sample", "N5", f"""
SELECT unit, t, y FROM c_trial ORDER BY {u('rows-7-', 'unit')}, unit LIMIT 500""")
def _sample(spark, d):
    return shaping.sample_rows(src.trial(spark, d), "unit", 500, seed=7).select("unit", "t", "y")


@query("arm_stratified_sample", "N6", f"""
SELECT unit, t FROM (SELECT unit, t, row_number() OVER (PARTITION BY t ORDER BY {u('subsample-3-', 'unit')}, unit) AS r,
  count(*) OVER (PARTITION BY t) AS n_arm, count(*) OVER () AS n FROM c_trial)
WHERE r <= round_even(400.0 * n_arm / n, 0)""")
def _arm_sample(spark, d):
    return shaping.arm_sample(src.trial(spark, d), "unit", 400, seed=3).select("unit", "t")


@query("arm_stratified_split", "N7", f"""
SELECT unit, t, r <= round_even(0.5 * n_arm, 0) AS is_test FROM (SELECT unit, t,
  row_number() OVER (PARTITION BY t ORDER BY {u('split-0-', 'unit')}, unit) AS r,
  count(*) OVER (PARTITION BY t) AS n_arm FROM c_trial)""")
def _arm_split(spark, d):
    return shaping.arm_split(src.trial(spark, d), "unit").select("unit", "t", "is_test")


@query("subject_split", "N8", f"""
SELECT is_test, count(*) AS n_rows, count(DISTINCT unit) AS n_units
FROM (SELECT unit, {u('unit-0-', 'unit')} < 0.3 AS is_test FROM c_panel) GROUP BY 1""")
def _unit_split(spark, d):
    p = shaping.unit_split(src.panel(spark, d), "unit")
    return p.groupBy("is_test").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.countDistinct("unit").alias("n_units"))


@query("tenure_table", "N9", """
SELECT o_orderkey AS unit, CAST(o_orderkey % 13 AS INTEGER) AS duration,
  CAST(o_orderstatus = 'F' AS INTEGER) AS event, o_totalprice AS price,
  CAST(o_orderpriority = '2-HIGH' AS INTEGER)::DOUBLE AS "o_orderpriority_2-high",
  CAST(o_orderpriority = '5-LOW' AS INTEGER)::DOUBLE AS "o_orderpriority_5-low"
FROM orders WHERE o_orderkey % 13 >= 1""")
def _tenure(spark, d):
    o = src.raw(spark, d, "orders").withColumnRenamed("o_orderkey", "unit").withColumn(
        "tenure", F.col("unit") % 13)
    x = shaping.indicators(o, {"o_orderpriority": ["2-HIGH", "5-LOW"]})
    return shaping.tenure_table(o, "tenure", F.col("o_orderstatus") == "F",
                                [F.col("o_totalprice").alias("price"), *x], "unit")


@query("discretised_time", "N10", """
SELECT period, count(*) AS n FROM (SELECT CAST(greatest(1, ceil(
  (epoch_us(ended_at) - epoch_us(started_at)) / 86400000000.0::DOUBLE / 30.44::DOUBLE)) AS INTEGER) AS period
  FROM c_subs WHERE ended_at IS NOT NULL) GROUP BY 1""")
def _discretise(spark, d):
    from ..functions.columns import days_between
    s = src.subscriptions(spark, d).filter("ended_at IS NOT NULL")
    return s.groupBy(shaping.discretise(days_between("started_at", "ended_at")).alias("period")
                     ).agg(F.count(F.lit(1)).alias("n"))


@query("panel_to_survival", "N11", """
SELECT unit, CAST(count(*) AS INTEGER) AS duration,
  CAST(CASE WHEN max(churn_voluntary) = 1 THEN 1 WHEN max(churn_involuntary) = 1 THEN 2 ELSE 0 END AS INTEGER) AS event,
  arg_min(mrr, month) AS mrr, arg_min(sessions, month) AS sessions FROM c_panel GROUP BY unit""")
def _panel_survival(spark, d):
    return shaping.panel_survival(src.panel(spark, d), ["mrr", "sessions"])


@query("moving_person_period", "N12", """
SELECT unit, month + 1 AS period, mrr, sessions, churn_involuntary AS event FROM c_panel""")
def _moving(spark, d):
    return shaping.moving_person_period(src.panel(spark, d), ["mrr", "sessions"], cause=2)


@query("counter_increments", "N13", """
SELECT unit, month, failures_ltd - coalesce(lag(failures_ltd) OVER (PARTITION BY unit ORDER BY month), 0) > 0
  AS failed FROM c_panel""")
def _increments(spark, d):
    return shaping.increments(src.panel(spark, d), "failures_ltd").select(
        "unit", "month", "failed")


@query("count_expansion", "N14 N16", f"""
WITH e AS (SELECT unit, month, unnest(range(1, CAST(sessions AS BIGINT) + 1)) AS i FROM c_panel
  WHERE sessions > 0),
k AS (SELECT *, 'ev_' || unit || '_' || month || '_' || i AS event_id,
  TIMESTAMP '2024-01-01' + to_seconds(CAST(round(month * (30.44::DOUBLE * 86400)) AS BIGINT)) AS s FROM e),
o AS (SELECT *, s + to_seconds(CAST(floor({u('at-', 'event_id')} * (30.44::DOUBLE * 86400)) AS BIGINT)) AS occurred_at FROM k)
SELECT unit AS customer_id, count(*) AS n, min(event_id) AS first_id, min(occurred_at) AS first_at, max(occurred_at) AS last_at,
  max(occurred_at + to_seconds(CAST(floor(864 + {u('up-', 'event_id')} * 20736) AS BIGINT))) AS last_known FROM o GROUP BY 1""")
def _expand(spark, d):
    """The least of strings is found by sorting, so months are reduced before units are grouped."""
    months = shaping.expand_counts(src.panel(spark, d), "sessions", shaping.month_start(
        F.col("month"), "2024-01-01 00:00:00"), "ev_", nested=True).select(
        "customer_id", F.size("events").alias("n"), F.array_min("events.event_id").alias("first_id"),
        F.array_min("events.occurred_at").alias("first_at"), F.array_max("events.occurred_at").alias("last_at"),
        F.array_max("events.available_at").alias("last_known"))
    return months.groupBy("customer_id").agg(
        F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"), F.max("last_known").alias("last_known"))


@query("recovered_retries", "N15", """
SELECT status, attempt_number, count(*) AS n, min(attempted_at) AS first, max(attempted_at) AS last FROM (
  SELECT status, 1 AS attempt_number, attempted_at FROM c_inv
  UNION ALL SELECT 'paid', 2, attempted_at + to_days(CAST(attempt_number AS INTEGER)) FROM c_inv
  WHERE status = 'failed' AND attempt_number < 3) GROUP BY 1, 2""")
def _retries(spark, d):
    inv = src.invoices(spark, d)
    # the original attempt number doubles as the delay, so keep a copy of it
    inv = inv.withColumn("delay", F.col("attempt_number"))
    out = shaping.with_retries(inv, (F.col("status") == "failed") & (F.col("delay") < 3),
                               F.col("delay"))
    return out.groupBy("status", "attempt_number").agg(
        F.count(F.lit(1)).alias("n"), F.min("attempted_at").alias("first"),
        F.max("attempted_at").alias("last"))


@query("horizon_labels", "N16 N17 N18", """
SELECT p.unit, p.month, CAST(coalesce(s.event = 1 AND s.duration - 1 > p.month
    AND s.duration - 1 <= p.month + 3, false) AS INTEGER) AS label
FROM c_panel p JOIN c_surv s USING (unit) WHERE p.month = 6""")
def _labels(spark, d):
    spine = shaping.at_risk(src.panel(spark, d), 6).select("unit", "month")
    exits = src.survival(spark, d).select("unit", (F.col("duration") - 1).alias("exit_month"),
                                          "event")
    return shaping.horizon_label(spine, exits, 3)


@query("trial_summary", "N19", """
SELECT count(*) AS n, CAST(sum(t) AS BIGINT) AS n_treated, round(avg(t), 6) AS treated_share,
  round(avg(y) FILTER (t = 1), 6) AS treated_mean, round(avg(y) FILTER (t = 0), 6) AS control_mean,
  round(avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0), 6) AS ate,
  round(avg(y) FILTER (t = 1) / avg(y) FILTER (t = 0) - 1, 6) AS lift FROM c_trial""")
def _summary(spark, d):
    return rounded(shaping.trial_summary(src.trial(spark, d)))


@query("price_rescale", "N20", """
WITH k AS (SELECT 49.0 / quantile_cont(mrr, 0.5) AS k FROM c_subs)
SELECT round((SELECT sum(mrr) FROM c_subs) * k, 3) AS mrr, round((SELECT sum(amount) FROM c_inv) * k, 3) AS amount FROM k""")
def _price(spark, d):
    s, i = shaping.rescale_to_median(src.subscriptions(spark, d), src.invoices(spark, d), 49.0)
    return s.agg(F.round(F.sum("mrr"), 3).alias("mrr")).select(
        "mrr", i.agg(F.round(F.sum("amount"), 3)).scalar().alias("amount"))
