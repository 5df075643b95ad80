import gzip

import pytest
from pyspark.sql import functions as F

from ebbtide.operators.validation import missing_columns, validate
from ebbtide.schema import (CUSTOMERS, EVENTS, INVOICES, SUBSCRIPTIONS, TABLES, SchemaError, empty)
from ebbtide.sources import canonical as src
from ebbtide.sources import csv_export as csv
from ebbtide.sources import processor_json as pj
from ebbtide.sources import sinks

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,key", [
    ("Created (UTC)", "created"), ("Customer ID", "customer_id"), ("customer-id", "customer_id"),
    ("  Canceled At (UTC) ", "canceled_at"), ("Plan__Amount", "plan_amount")])
def test_column_key(name, key):
    assert csv.column_key(name) == key


def test_bare_id_is_the_tables_own_key():
    assert csv.resolve(["id", "Email", "Created (UTC)"], CUSTOMERS) == {
        "customer_id": "id", "created_at": "Created (UTC)"}
    got = csv.resolve(["id", "Customer ID", "Status"], SUBSCRIPTIONS)
    assert got["subscription_id"] == "id" and got["customer_id"] == "Customer ID"


def test_precise_alias_wins_and_sources_are_used_once():
    got = csv.resolve(["plan_amount", "amount", "created"], SUBSCRIPTIONS)
    assert got["mrr"] == "plan_amount" and got["started_at"] == "created"
    assert len(set(got.values())) == len(got)


def test_missing_required_column_names_what_is_there(spark):
    df = spark.createDataFrame([("s1",)], "id string")
    with pytest.raises(csv.IngestError, match="customer_id"):
        csv.load_table(df, SUBSCRIPTIONS)


def test_null_key_is_refused(spark):
    df = spark.createDataFrame([(None, "2024-01-01")], "id string, created string")
    with pytest.raises(csv.IngestError, match="have no key"):
        csv.load_table(df, CUSTOMERS)


def test_csv_files_plain_and_gzip(spark, tmp_path):
    text = "id,Created (UTC)\nc1,1704067200\nc2,\n"
    (tmp_path / "a.csv").write_text(text)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(text)
    for name in ("a.csv", "b.csv.gz"):
        rows = csv.load_table(csv.read_csv(spark, str(tmp_path / name)), CUSTOMERS).orderBy(
            "customer_id").collect()
        assert str(rows[0]["created_at"]) == "2024-01-01 00:00:00"
        assert rows[1]["created_at"] is None and rows[0]["country"] is None


def test_dates_in_words_and_bad_dates(spark):
    df = spark.createDataFrame([("1/31/2024",), ("2024-02-03T04:05:06",), ("never",), ("",)],
                               "x string")
    assert csv.epoch_units(df, ["x"]) == {"x": "text"}
    got = [str(r[0]) for r in df.select(csv.parse_time("x", "text")).collect()]
    assert got == ["2024-01-31 00:00:00", "2024-02-03 04:05:06", "None", "None"]


def test_defaults_are_recorded_and_caller_wins(spark):
    df = spark.createDataFrame([("e1", "c1", "2024-01-01")], "id string, user_id string, time string")
    notes = []
    row = csv.load_table(df, EVENTS, defaults={"name": "login"}, notes=notes).first()
    assert row["name"] == "login" and notes == [("events", "name", "login", "supplied")]
    assert str(row["available_at"]) == "2024-01-01 06:00:00"


def test_tenant_without_invoices(spark):
    c = spark.createDataFrame([("c1", "2024-01-01")], "id string, created string")
    s = spark.createDataFrame([("s1", "c1", "2024-01-01", "active", "29.5", "EUR")],
                              "id string, customer string, start string, status string, "
                              "price string, `Plan Currency` string")
    ds = csv.load(spark, c, s)
    assert "invoices" not in ds.supplied and ds.invoices.count() == 0
    assert [r[0] for r in ds.stated_currencies().collect()] == ["EUR"]
    validate(ds)
    assert csv.rescale(ds, 100.0).subscriptions.first()["mrr"] == pytest.approx(0.295)
    with pytest.raises(csv.IngestError):
        csv.rescale(ds, 0)


def test_worklist_files(spark, tmp_path):
    paths = sinks.write_worklists(src.dataset(spark, FOLDER), str(tmp_path), "acme_")
    back = spark.read.option("header", True).csv(paths[0])
    assert "suggested_action" in back.columns
    assert back.filter(~F.col("failed_on").rlike(r"^\d{4}-\d{2}-\d{2}$")).count() == 0
    out = sinks.write_parquet(spark.range(4).withColumn("k", F.col("id") % 2),
                              str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(out).count() == 4


def test_json_objects(spark, tmp_path):
    p = tmp_path / "inv.json"
    p.write_text(
        '{"id":"in_1","customer":"c1","amount_due":2900,"currency":"usd","status":"open",'
        '"created":1704067200,"attempt_count":2,"payment_intent":{"last_payment_error":'
        '{"decline_code":"expired_card"}}}\n'
        '{"id":"in_2","customer":"c1","amount_due":500,"currency":"jpy","status":"paid",'
        '"created":1704067200,"status_transitions":{"paid_at":1704067260},'
        '"payment_intent":"pi_123"}\n')
    a, b = pj.map_invoices(pj.read_objects(spark, str(p), pj.INVOICE)).orderBy(
        "invoice_id").collect()
    assert (a["status"], a["amount"], a["failure_code"], a["attempt_number"]) == (
        "failed", 29.0, "expired_card", 2)
    assert (b["status"], b["amount"], b["attempt_number"]) == ("paid", 500.0, 1)
    assert b["available_at"] == b["attempted_at"] and a["paid_at"] is None


def dataset(spark):
    return src.dataset(spark, FOLDER)


@pytest.mark.parametrize("table,change,rule", [
    ("subscriptions", lambda d: d.unionByName(d.limit(1)), "duplicate_key"),
    ("invoices", lambda d: d.withColumn("amount", F.lit(None).cast("double")), "null"),
    ("events", lambda d: d.withColumn("available_at", F.expr("occurred_at - INTERVAL '1' DAY")),
     "available_before_occurred"),
    ("tickets", lambda d: d.withColumn("customer_id", F.lit("nobody")), "unknown_customer")])
def test_validate_refuses(spark, table, change, rule):
    ds = dataset(spark)
    setattr(ds, table, change(ds.table(table)))
    with pytest.raises(SchemaError, match=rule):
        validate(ds)


def test_missing_column(spark):
    assert missing_columns(spark.createDataFrame([("x",)], "invoice_id string"),
                           INVOICES)[0] == "customer_id"
    ds = dataset(spark)
    ds.invoices = ds.invoices.drop("amount")
    with pytest.raises(SchemaError, match="amount"):
        validate(ds)


def test_empty_tables_are_typed(spark):
    for t in TABLES.values():
        assert empty(spark, t).schema == t.struct


def test_quotes_commas_and_line_breaks_inside_fields(spark, tmp_path):
    import csv as plain

    rows = [["c1", 'a ""big"" co, x', "2024-01-01T10:00:00+05:30"], ["c2", "two\nlines", "NA"],
            ["c3", "", "31/31/2023"]]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        plain.writer(f).writerows([["id", "plan", "created"], *rows])
    df = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert [r[1] or "" for r in df.orderBy("id").collect()] == [r[1] for r in rows]
    got = csv.load_table(df, CUSTOMERS).orderBy("customer_id").collect()
    assert str(got[0]["created_at"]) == "2024-01-01 04:30:00" and got[1]["created_at"] is None
    lost = {r["column"]: r["n"] for r in csv.unparsed_dates(df, CUSTOMERS).collect()}
    assert lost["created_at"] == 1


@pytest.mark.parametrize("line", ["c1,a,b,c", "c1"])
def test_records_of_another_width_are_refused(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text(f"id,plan\nc0,x\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED"):
        csv.read_csv(spark, str(tmp_path / "a.csv")).select("id").collect()


def test_contract_rules_read_every_table_once(spark):
    """The rules together against each on its own, and the scans of the plan."""
    import re

    from ebbtide.operators import validation
    from ebbtide.schema import FACTS, Dataset
    from ebbtide.sources import canonical as src

    ds = src.dataset(spark, "/root/testdata/sf0.001")
    got = {(r["table"], r["rule"], r["column"]): r["n"] for r in validation.violations(ds).collect()}
    want = {}
    for table, df in ds:
        for part in (validation.duplicate_keys(df, table), validation.row_rules(df, table)):
            want |= {(r["table"], r["rule"], r["column"]): r["n"] for r in part.collect()}
    for t in FACTS:
        r = validation.orphans(ds.table(t.name), ds.customers, t).first()
        want[r["table"], r["rule"], r["column"]] = r["n"]
    assert got == want
    each = sum(len(re.findall("FileScan parquet", df._jdf.queryExecution().executedPlan().toString())) for _, df in ds)
    plan = validation.violations(ds)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) <= each
