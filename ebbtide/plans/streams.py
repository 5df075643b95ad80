"""Streaming queries, run over everything available and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import holdout
from ..schema import EVENTS
from ..session import work_folder
from ..sources import canonical as src
from ..streaming import facts as st
from .registry import query
from .sqltext import u


def stream(spark, d, name):
    """A given table as a file stream with its own schema."""
    return st.read_parquet(spark, d, src.raw(spark, d, name).schema, f"{name}.parquet")


def event_stream(spark, d):
    return stream(spark, d, "events").selectExpr(
        "cast(event_id AS string) AS event_id", "cast(user_id AS string) AS customer_id",
        "CASE event_type WHEN 'click' THEN 'session_start' ELSE event_type END AS name",
        "ts AS occurred_at",
        "CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL '1' HOUR END AS available_at", "value")


@query("stream_canonical_facts", "ST1 S7", """
SELECT event_id, customer_id, name, occurred_at,
  CASE WHEN CAST(event_id AS BIGINT) % 2 = 0 THEN occurred_at ELSE occurred_at + INTERVAL 6 HOUR END AS available_at, value FROM c_events""")
def _facts(spark, d):
    s = st.fact_stream(event_stream(spark, d), EVENTS)
    out = st.run_to_files(s, work_folder(spark, "facts"))
    return spark.read.parquet(out).withColumn("occurred_at", F.col("occurred_at")
                                              .cast("timestamp_ntz"))


@query("stream_usage_windows", "ST2", """
WITH e AS (SELECT customer_id, epoch_us(occurred_at) AS us FROM c_events WHERE name = 'session_start'),
w AS (SELECT customer_id, make_timestamp((us // 432000000000 - k) * 432000000000) AS window_start FROM e, (SELECT unnest(range(0, 6)) AS k))
SELECT customer_id, window_start, count(*) AS n FROM w GROUP BY 1, 2""")
def _usage(spark, d):
    s = st.fact_stream(event_stream(spark, d), EVENTS).filter("name = 'session_start'")
    out = st.run_to_files(st.usage_counts(s, "30 days", "5 days"), work_folder(spark, "usage"),
                          "update")
    return st.latest(spark.read.parquet(out), ["customer_id", "window_start"], "n")


@query("stream_usage_panes", "ST2", """
WITH p AS (SELECT customer_id, CAST(epoch_us(occurred_at) // 86400000000 AS BIGINT) AS day, count(*) AS n FROM c_events WHERE name = 'session_start' GROUP BY 1, 2),
w AS (SELECT customer_id, 30 AS width_days, day - k AS start, n FROM p, (SELECT unnest(range(0, 30)) AS k)
  UNION ALL SELECT customer_id, 60, day - k, n FROM p, (SELECT unnest(range(0, 60)) AS k))
SELECT customer_id, width_days, make_timestamp(start * 86400000000) AS window_start, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1, 2, 3""")
def _panes(spark, d):
    """Both widths by one day, from daily panes in the state."""
    s = st.fact_stream(event_stream(spark, d), EVENTS).filter("name = 'session_start'")
    out = st.run_to_files(st.daily_panes(s), work_folder(spark, "panes"), "update")
    return st.merge_panes(st.latest(spark.read.parquet(out), ["customer_id", "day"], "n"), [30, 60])


@query("stream_failure_recovery", "ST3", """
SELECT f.customer_id, f.attempted_at AS failed_at, f.amount FROM c_inv f WHERE f.status = 'failed' AND EXISTS (SELECT 1 FROM c_inv p
  WHERE p.status = 'paid' AND p.customer_id = f.customer_id AND p.attempted_at > f.attempted_at AND p.attempted_at <= f.attempted_at + INTERVAL 30 DAY)""")
def _recovery(spark, d):
    return _settled(spark, d, st.recovered)


def _settled(spark, d, join):
    """Failed and paid line items of the stream, joined by one of the two recovery joins."""
    owner = src.raw(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string")
                                               .alias("customer_id"))
    inv = stream(spark, d, "lineitem").join(
        owner, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "customer_id", "floor(l_extendedprice * (1 - l_discount)) / 100.0D AS amount",
        "l_shipdate AS attempted_at", "l_returnflag")
    m = join(inv.filter("l_returnflag = 'R'").drop("l_returnflag"), inv.filter("l_returnflag <> 'R'"))
    out = st.run_to_files(m, work_folder(spark, "recovery"))
    return spark.read.parquet(out).select(
        "customer_id", F.col("failed_at").cast("timestamp_ntz").alias("failed_at"), "amount")


@query("stream_unrecovered_failures", "ST3", """
WITH w AS (SELECT least(max(attempted_at) FILTER (status = 'failed'), max(attempted_at) FILTER (status = 'paid')) - INTERVAL 2 DAY AS seen FROM c_inv)
SELECT f.customer_id, f.attempted_at AS failed_at, f.amount FROM c_inv f, w
WHERE f.status = 'failed' AND f.attempted_at + INTERVAL 30 DAY < w.seen AND NOT EXISTS (SELECT 1 FROM c_inv p
  WHERE p.status = 'paid' AND p.customer_id = f.customer_id AND p.attempted_at > f.attempted_at AND p.attempted_at <= f.attempted_at + INTERVAL 30 DAY)""")
def _unrecovered(spark, d):
    """Failures whose window lies behind the watermark, two days before the end of the shorter side."""
    return _settled(spark, d, st.never_recovered)


@query("stream_holdout_ledger", "ST4 H1 H2", f"""
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CASE WHEN {u('holdout-v1', 'c_custkey')} < 0.1 THEN 'holdout' ELSE 'treated' END AS arm FROM customer""")
def _ledger(spark, d):
    folder = work_folder(spark, "ledger")
    c = stream(spark, d, "customer").select(F.col("c_custkey").cast("string")
                                            .alias("customer_id"))
    st.assign_on_arrival(c, f"{folder}/data", f"{folder}/state", "winter", F.lit("2024-01-01"))
    return holdout.arm_of(holdout.read_ledger(spark, f"{folder}/data"), "winter")


@query("stream_last_seen", "ST5", """
SELECT customer_id, max(occurred_at) AS last_seen FROM c_events GROUP BY 1""")
def _last_seen(spark, d):
    out = st.run_to_files(st.last_seen(event_stream(spark, d)), work_folder(spark, "seen"),
                          "update")
    return st.latest(spark.read.parquet(out), ["customer_id"], "last_seen")
