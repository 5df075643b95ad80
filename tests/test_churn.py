import pytest
from pyspark.sql import functions as F

from ebbtide.operators import churn, worklists
from ebbtide.schema import (CUSTOMERS, EVENTS, INVOICES, SUBSCRIPTIONS, TICKETS, Dataset, empty)
from ebbtide.functions.money import label


def invoice(i, cust, amount, status, at, code=None, paid=None):
    return (i, cust, None, amount, "usd", status, at, paid, code, 1, at)


def make(spark, subs, invoices=()):
    d = "1970-01-01"
    custs = sorted({s[1] for s in subs})
    c = spark.createDataFrame([(k, None, None, None) for k in custs],
                              "customer_id string, created_at timestamp_ntz, country string, segment string")
    c = c.withColumn("created_at", F.lit(d).cast("timestamp_ntz"))
    s = spark.createDataFrame(
        [(i, k, "p", float(m), "month", a, e, None, "x", a) for i, k, m, a, e in subs],
        SUBSCRIPTIONS.struct)
    inv = spark.createDataFrame(list(invoices), INVOICES.struct) if invoices else empty(spark, INVOICES)
    return Dataset(c, s, inv, empty(spark, EVENTS), empty(spark, TICKETS))


@pytest.mark.parametrize("gap,hit", [(0, False), (1, True), (30, True), (31, False), (-1, False)])
def test_recovery_window_edges(spark, day, gap, hit):
    inv = spark.createDataFrame([invoice("a", "c", 10.0, "failed", day(100), "expired_card"),
                                 invoice("b", "c", 10.0, "paid", day(100 + gap))], INVOICES.struct)
    assert churn.failures(inv).first()["recovered"] is hit


@pytest.mark.parametrize("gap,hit", [(-2, False), (-1, True), (45, True), (46, False)])
def test_involuntary_window_edges(spark, day, gap, hit):
    ds = make(spark, [("s", "c", 10, day(0), day(100 + gap)), ("t", "d", 10, day(0), None)],
              [invoice("a", "c", 10.0, "failed", day(100))])
    m = churn.metrics(ds).first()
    assert m["n_involuntary"] == int(hit)


def test_not_measured_is_null_and_never_zero(spark, day):
    ds = make(spark, [("s", "c", 10, day(0), day(50)), ("t", "d", 20, day(0), None)])
    m = churn.metrics(ds)
    row = m.first()
    assert row["n_involuntary"] is None and row["involuntary_share"] is None
    assert row["recovery_rate"] is None and not row["invoices_supplied"]
    t = churn.tiles(m).first()
    assert (t["recovery"], t["involuntary"], t["start_with"]) == (
        "not measured", "not measured", "send_invoices")
    assert {r[0] for r in churn.caveats(ds).collect()} == {"no_invoices", "no_currency"}
    assert [r["finding"] for r in churn.findings(m, churn.decline_mix(churn.failures(
        ds.invoices))).collect()] == ["annual_churn_cost"]


def test_no_departures(spark, day):
    ds = make(spark, [("s", "c", 10, day(0), None)], [invoice("a", "c", 1.0, "paid", day(1))])
    m = churn.metrics(ds)
    assert m.first()["involuntary_share"] is None and m.first()["recovery_rate"] is None
    assert churn.tiles(m).first()["start_with"] == "no_departures"


def test_mix_is_empty_without_codes(spark, day):
    inv = spark.createDataFrame([invoice("a", "c", 10.0, "failed", day(0))], INVOICES.struct)
    assert churn.decline_mix(churn.failures(inv)).count() == 0


def test_everyone_leaves_retention_reaches_zero(spark, day):
    ds = make(spark, [("s", "c", 1, day(0), day(40)), ("t", "d", 1, day(0), day(45))])
    curve = churn.retention_curve(ds.subscriptions).orderBy("month").collect()
    assert [r["retention"] for r in curve] == [1.0, 0.0]


@pytest.mark.parametrize("paid,later,hit", [(10.0, 5, True), (10.01, 5, True), (10.02, 5, False),
                                            (9.99, 5, True), (10.0, -1, False), (10.0, 900, True)])
def test_same_amount_rule(spark, day, paid, later, hit):
    inv = spark.createDataFrame([invoice("a", "c", 10.0, "FAILED", day(10)),
                                 invoice("b", "c", paid, "paid", day(10 + later), None,
                                         day(10 + later))], INVOICES.struct)
    # the same floating-point comparison as the definition
    want = hit and abs(paid - 10.0) <= 0.01
    got = worklists.same_amount_failures(inv).collect()
    assert len(got) == 1 and got[0]["recovered"] is want


def test_worklist_order(spark, day):
    ds = make(spark, [("s", "c", 10, day(0), None), ("t", "d", 10, day(0), day(9))],
              [invoice("a", "d", 99.0, "failed", day(5), "expired_card"),
               invoice("b", "c", 5.0, "failed", day(5)), invoice("e", "c", 7.0, "failed", day(6))])
    rows = worklists.unrecovered(ds.invoices, ds.subscriptions).collect()
    assert [(r["still_subscribed"], r["amount"]) for r in rows] == [(True, 7.0), (True, 5.0), (False, 99.0)]
    assert rows[2]["suggested_action"] == "win_back:request_new_card"


@pytest.mark.parametrize("x,cur,text", [
    (1234.0, "USD", "$1,234"), (-2500000.0, "EUR", "-€2.50 million"), (25000000.0, "INR", "₹2.50 crore"),
    (250000.0, "INR", "₹2.5 lakh"), (999.5, None, "1,000"), (12.0, "CHF", "CHF 12")])
def test_money_labels(spark, x, cur, text):
    df = spark.createDataFrame([(x, cur)], "x double, c string")
    assert df.select(label(F.col("x"), F.col("c"))).first()[0] == text


def test_band_check(spark):
    k = spark.createDataFrame([(0.05, 0.9)], "monthly_voluntary_churn double, involuntary_share_of_churn double")
    got = {r["name"]: r["within"] for r in churn.band_check(k, {
        "monthly_voluntary_churn": (0.03, 0.07), "involuntary_share_of_churn": (0.2, 0.4)}).collect()}
    assert got == {"monthly_voluntary_churn": True, "involuntary_share_of_churn": False}
    assert CUSTOMERS.key == "customer_id"
