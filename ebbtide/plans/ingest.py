"""Queries that push the given rows through the CSV and JSON ingest paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import INVOICES, SUBSCRIPTIONS
from ..session import spread
from ..sources import canonical as src
from ..sources import csv_export as csv
from ..sources import processor_json as pj
from .registry import query


def _export(spark, d):
    """Subscriptions as a dashboard writes them: odd headers, epochs, blanks, minor units."""
    return src.raw(spark, d, "orders").selectExpr(
        "concat('sub_', o_orderkey) AS id", "cast(o_custkey AS string) AS `Customer ID`",
        "o_orderstatus AS Status",
        "cast(unix_seconds(cast(o_orderdate AS timestamp)) AS string) AS `Created (UTC)`",
        "CASE WHEN o_orderstatus = 'F' THEN cast(unix_millis(cast(o_orderdate AS timestamp)) "
        "+ 864000000 AS string) ELSE ' ' END AS `Canceled At (UTC)`",
        "CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE cast(cast(floor(o_totalprice) AS bigint) "
        "AS string) END AS `Plan Amount`",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'usd' ELSE 'USD ' END AS `Plan Currency`")


@query("csv_subscriptions_export", "S2 S3 S4 S5 S6 S7 S8", """
SELECT 'sub_' || o_orderkey AS subscription_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  'unknown' AS plan, CASE WHEN o_orderkey % 50 <> 0 THEN floor(o_totalprice) END AS mrr,
  'month' AS "interval", o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 10 DAY END AS ended_at,
  CAST(NULL AS VARCHAR) AS cancel_reason, o_orderstatus AS status, o_orderdate AS available_at
FROM orders""")
def _subs(spark, d):
    return csv.load_table(_export(spark, d), SUBSCRIPTIONS)


@query("csv_minor_unit_rescale", "S19", """
SELECT count(*) AS n, round(sum(floor(o_totalprice) / 100) FILTER (o_orderkey % 50 <> 0), 2) AS mrr
FROM orders""")
def _rescale(spark, d):
    ds = src.dataset(spark, d)
    ds.subscriptions = csv.load_table(_export(spark, d), SUBSCRIPTIONS)
    return csv.rescale(ds, 100.0).subscriptions.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("mrr"), 2).alias("mrr"))


@query("csv_invoices_export", "S3 S4 S5 S6 S7", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS invoice_id,
  CAST(l_suppkey AS VARCHAR) AS customer_id, CAST(NULL AS VARCHAR) AS subscription_id,
  l_extendedprice AS amount, 'EUR' AS currency,
  CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'paid' END AS status,
  l_shipdate AS attempted_at, CAST(NULL AS TIMESTAMP) AS paid_at,
  CAST(NULL AS VARCHAR) AS failure_code,
  CAST(CASE WHEN l_linenumber = 2 THEN 0 ELSE l_linenumber END AS BIGINT) AS attempt_number,
  l_shipdate + CASE WHEN l_linenumber = 3 THEN INTERVAL 0 DAY ELSE INTERVAL 2 DAY END
    AS available_at FROM lineitem""")
def _invoices(spark, d):
    raw = src.raw(spark, d, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id",
        "cast(l_suppkey AS string) AS `account-id`",
        "cast(l_extendedprice AS string) AS `AMOUNT PAID`",
        "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'paid' END AS payment_status",
        "date_format(l_shipdate, 'M/d/yyyy') AS `Invoice Date`",
        "CASE WHEN l_linenumber = 2 THEN 'second' ELSE cast(l_linenumber AS string) END AS attempt",
        # an availability earlier than the attempt is moved to the attempt
        "CASE WHEN l_linenumber = 3 THEN date_format(l_shipdate - INTERVAL '1' DAY, "
        "'yyyy-MM-dd') END AS available_at")
    return csv.load_table(raw, INVOICES, defaults={"currency": "EUR"})


@query("csv_epoch_detection", "S4", """
SELECT 'seconds' AS kind, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders
UNION ALL SELECT 'millis', count(*), min(o_orderdate), max(o_orderdate) FROM orders
UNION ALL SELECT 'iso', count(*), min(o_orderdate), max(o_orderdate) FROM orders
UNION ALL SELECT 'mixed', count(*) FILTER (o_orderkey % 2 = 0),
  min(o_orderdate) FILTER (o_orderkey % 2 = 0), max(o_orderdate) FILTER (o_orderkey % 2 = 0) FROM orders
UNION ALL SELECT 'outside', count(*), TIMESTAMP '1970-01-01', TIMESTAMP '1970-01-01 00:00:00.000001'
  FROM orders""")
def _epochs(spark, d):
    o = src.raw(spark, d, "orders").selectExpr(
        "cast(unix_seconds(cast(o_orderdate AS timestamp)) AS string) AS seconds",
        "cast(unix_millis(cast(o_orderdate AS timestamp)) AS string) AS millis",
        "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS iso",
        "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "ELSE 'unknown' END AS mixed",
        "cast(o_orderkey % 2 * 1000 AS string) AS outside")
    units = csv.epoch_units(o, o.columns)
    a = o.select(*[csv.parse_time(c, units[c]).alias(c) for c in o.columns]).agg(*[
        F.struct(F.lit(c).alias("kind"), F.count(c).alias("n"), F.min(c).alias("first"),
                 F.max(c).alias("last")).alias(c) for c in o.columns])
    return a.select(F.explode(F.array(*a.columns)).alias("r")).select("r.*")


@query("ingest_assumptions", "S6", """
SELECT 'subscriptions' AS "table", c AS "column", v AS value, 'assumed' AS why,
  (SELECT count(*) FROM orders) AS n_rows FROM (VALUES ('plan', 'unknown'), ('interval', 'month')) t(c, v)""")
def _assumptions(spark, d):
    raw, notes = _export(spark, d), []
    subs = csv.load_table(raw, SUBSCRIPTIONS, notes=notes)
    n = subs.agg(F.count(F.lit(1))).scalar()
    return csv.assumptions(spark, notes).withColumn("n_rows", n)


@query("missing_keys", "S8", """
SELECT count(*) AS n FROM events WHERE event_type = 'error'""")
def _missing(spark, d):
    from ..schema import EVENTS
    ev = src.raw(spark, d, "events").selectExpr(
        "CASE WHEN event_type <> 'error' THEN cast(event_id AS string) END AS event_id")
    return csv.null_keys(ev, EVENTS)


@query("tenant_load_currency", "S9 S10 S11", """
SELECT CAST(1 AS BIGINT) AS n_stated, 'USD' AS currency, (SELECT count(*) FROM customer) AS n_customers,
  (SELECT count(*) FROM orders) AS n_subscriptions, CAST(0 AS BIGINT) AS n_events""")
def _tenant(spark, d):
    from ..operators.preflight import resolve_currency
    cust = src.raw(spark, d, "customer").selectExpr(
        "cast(c_custkey AS string) AS id", "'2001-02-03' AS `Created (UTC)`", "c_name AS Email")
    ds = csv.load(spark, cust, _export(spark, d))
    def count(df):
        return df.agg(F.count(F.lit(1))).scalar()
    return resolve_currency(ds.stated_currencies(), ds.declared).select(
        "n_stated", "currency", count(ds.customers).alias("n_customers"),
        count(ds.subscriptions).alias("n_subscriptions"), count(ds.events).alias("n_events"))


# --- processor objects -------------------------------------------------------------

def _objects(spark, d):
    """The order rows as processor objects in JSON text, parsed back with the fixed schema."""
    o = spread(src.raw(spark, d, "orders"))  # text is made and parsed
    cust = src.raw(spark, d, "customer").selectExpr("to_json(struct(concat('cus_', c_custkey) AS id, 883612800 + c_custkey * 3600 AS created, "
                        "struct(cast(c_nationkey AS string) AS country) AS address, "
                        "CASE WHEN c_custkey % 4 <> 0 THEN struct(c_mktsegment AS segment) END "
                        "AS metadata)) AS j")
    price = ("struct(concat('price_', {k}) AS id, cast(floor(o_totalprice / {div}) * {mul} AS bigint) AS unit_amount, "
             "{cur} AS currency, struct({iv} AS `interval`, {n} AS interval_count) AS recurring)")
    first = price.format(k="o_orderkey % 9", div=1, mul=36, cur="CASE WHEN o_orderkey % 10 = 0 THEN 'jpy' "
                         "ELSE 'usd' END", iv="element_at(array('month','year','week','day'), "
                         "cast(o_orderkey % 4 AS int) + 1)", n="1 + o_orderkey % 3")
    second = price.format(k="'addon'", div=10, mul=1, cur="'usd'", iv="'month'", n="1")
    subs = o.selectExpr(
        "to_json(struct(concat('sub_', o_orderkey) AS id, concat('cus_', o_custkey) AS customer, "
        "CASE o_orderstatus WHEN 'F' THEN 'canceled' ELSE 'active' END AS status, "
        "unix_seconds(cast(o_orderdate AS timestamp)) AS created, "
        "CASE WHEN o_orderkey % 2 = 0 THEN unix_seconds(cast(o_orderdate AS timestamp)) + 86400 END AS start_date, "
        "CASE WHEN o_orderkey % 11 = 0 THEN unix_seconds(cast(o_orderdate AS timestamp)) + 8640000 END AS ended_at, "
        "unix_seconds(cast(o_orderdate AS timestamp)) + 864000 AS canceled_at, "
        "struct(CASE WHEN o_orderkey % 2 = 1 THEN 'cancellation_requested' END AS reason) AS cancellation_details, "
        f"struct(CASE WHEN o_orderkey % 6 = 0 THEN array(struct(o_orderkey % 3 AS quantity, {first} AS price)) "
        f"WHEN o_orderkey % 17 = 0 THEN array() ELSE array(struct(o_orderkey % 3 AS quantity, {first} AS price), "
        f"struct(cast(NULL AS bigint) AS quantity, {second} AS price)) END AS data) AS items)) AS j")
    inv = o.selectExpr(
        "to_json(struct(concat('in_', o_orderkey) AS id, concat('cus_', o_custkey) AS customer, "
        "CASE WHEN o_orderkey % 2 = 0 THEN concat('sub_', o_orderkey) END AS subscription, "
        "cast(floor(o_totalprice) AS bigint) AS amount_due, "
        "CASE WHEN o_orderkey % 10 = 0 THEN 'JPY' WHEN o_orderkey % 10 < 8 THEN 'usd' END AS currency, "
        "element_at(array('paid', 'open', 'uncollectible', 'void', 'draft'), cast(o_orderkey % 5 AS int) + 1) AS status, "
        "unix_seconds(cast(o_orderdate AS timestamp)) AS created, o_orderkey % 4 AS attempt_count, "
        "struct(CASE WHEN o_orderkey % 5 = 0 THEN unix_seconds(cast(o_orderdate AS timestamp)) + 60 END AS paid_at, "
        "CASE WHEN o_orderkey % 3 = 0 THEN unix_seconds(cast(o_orderdate AS timestamp)) - 100 + o_orderkey % 200 END AS finalized_at) AS status_transitions, "
        "CASE WHEN o_orderkey % 7 = 0 THEN struct(struct(CASE WHEN o_orderkey % 2 = 0 THEN 'expired_card' END AS decline_code, "
        "'card_declined' AS code) AS last_payment_error) END AS payment_intent)) AS j")
    return (pj.parse_objects(cust, "j", pj.CUSTOMER),
            pj.parse_objects(subs, "j", pj.SUBSCRIPTION), pj.parse_objects(inv, "j", pj.INVOICE))


J_SUBS = """
SELECT 'sub_' || o_orderkey AS subscription_id, 'cus_' || o_custkey AS customer_id,
  CASE WHEN n = 0 THEN 'unknown' ELSE 'price_' || (o_orderkey % 9) END AS plan,
  round_even(CASE WHEN n = 0 THEN 0 ELSE (CASE WHEN o_orderkey % 10 = 0 THEN floor(o_totalprice) * 36
      ELSE floor(o_totalprice) * 36 / 100 END) * (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 3 END)
    / ((CASE o_orderkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 12.0::DOUBLE WHEN 2 THEN 1 / 4.345::DOUBLE
        ELSE 1 / 30.44::DOUBLE END) * (1 + o_orderkey % 3)) END
    + CASE WHEN n = 2 THEN floor(o_totalprice / 10) / 100 ELSE 0 END, 4) AS mrr,
  CASE WHEN n = 1 THEN (['month', 'year', 'week', 'day'])[(o_orderkey % 4) + 1] ELSE 'month' END AS "interval",
  o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS started_at,
  CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 100 DAY
       WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 10 DAY END AS ended_at,
  CASE WHEN o_orderkey % 2 = 1 THEN 'cancellation_requested' END AS cancel_reason,
  CASE o_orderstatus WHEN 'F' THEN 'canceled' ELSE 'active' END AS status,
  o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS available_at
FROM (SELECT *, CASE WHEN o_orderkey % 6 = 0 THEN 1 WHEN o_orderkey % 17 = 0 THEN 0 ELSE 2 END AS n
      FROM orders)"""


@query("processor_customers", "S14 S15", """
SELECT 'cus_' || c_custkey AS customer_id,
  TIMESTAMP '1998-01-01' + to_hours(CAST(c_custkey AS INTEGER)) AS created_at,
  CAST(c_nationkey AS VARCHAR) AS country, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment
FROM customer""")
def _pj_customers(spark, d):
    return pj.map_customers(_objects(spark, d)[0])


@query("processor_subscriptions", "S12 S13 S14 S16", J_SUBS)
def _pj_subs(spark, d):
    return pj.map_subscriptions(_objects(spark, d)[1])


@query("processor_invoices", "S12 S14 S17", """
SELECT 'in_' || o_orderkey AS invoice_id, 'cus_' || o_custkey AS customer_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'sub_' || o_orderkey END AS subscription_id,
  CASE WHEN o_orderkey % 10 = 0 THEN floor(o_totalprice) ELSE floor(o_totalprice) / 100 END AS amount,
  CASE WHEN o_orderkey % 10 = 0 THEN 'JPY' ELSE 'usd' END AS currency,
  CASE WHEN o_orderkey % 5 = 0 THEN 'paid'
       WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 2
         OR (o_orderkey % 4 > 0 AND o_orderkey % 5 <> 1) THEN 'failed'
       ELSE (['paid', 'open', 'uncollectible', 'void', 'draft'])[(o_orderkey % 5) + 1] END AS status,
  o_orderdate AS attempted_at,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 60 SECOND END AS paid_at,
  CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'expired_card' ELSE 'card_declined' END END AS failure_code,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 4 END AS attempt_number,
  CASE WHEN o_orderkey % 3 = 0 THEN greatest(o_orderdate, o_orderdate + to_seconds(o_orderkey % 200 - 100))
       ELSE o_orderdate END AS available_at FROM orders""")
def _pj_invoices(spark, d):
    return pj.map_invoices(_objects(spark, d)[2])


@query("processor_tenant", "S18", """
SELECT currency, (SELECT count(*) FROM orders) AS n_subscriptions,
  (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS n_paid
FROM (VALUES ('JPY'), ('USD')) t(currency)""")
def _pj_tenant(spark, d):
    ds = pj.to_canonical(*_objects(spark, d))
    return ds.stated.select(
        "currency", ds.subscriptions.agg(F.count(F.lit(1))).scalar().alias("n_subscriptions"),
        ds.invoices.filter("status = 'paid'").agg(F.count(F.lit(1))).scalar().alias("n_paid"))


@query("csv_roundtrip", "S1 S20", """
SELECT CAST(c_custkey AS VARCHAR) AS id, 'a "big" ' || c_mktsegment || ', x' || chr(10) || 'line ' || c_custkey AS note,
  CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def _roundtrip(spark, d):
    """An export with quotes, commas and line breaks inside fields, written and read again."""
    from ..session import work_folder
    from ..sources import sinks

    note = F.concat(F.lit('a "big" '), "c_mktsegment", F.lit(", x\nline "), "c_custkey")
    out = src.raw(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), note.alias("note"), F.col("c_nationkey").alias("nation"))
    return csv.read_csv(spark, sinks.write_csv(out, work_folder(spark, "export")))
