import pytest
from pyspark.sql import functions as F

from ebbtide.operators import features as ft
from ebbtide.operators import leakage
from ebbtide.schema import CUSTOMERS, EVENTS, INVOICES, SUBSCRIPTIONS, TICKETS, Dataset, empty


def tenant(spark, events):
    c = spark.createDataFrame([("a", None, None, None), ("b", None, None, None)],
                              "customer_id string, created_at timestamp_ntz, country string, segment string")
    e = spark.createDataFrame([(str(i), k, n, o, a, v) for i, (k, n, o, a, v) in enumerate(events)],
                              EVENTS.struct)
    return Dataset(c, empty(spark, SUBSCRIPTIONS), empty(spark, INVOICES), e, empty(spark, TICKETS))


def one(spark, ds, spec, at, mode=ft.SAFE, who="a"):
    spine = spark.createDataFrame([(who, at)], "customer_id string, as_of timestamp_ntz")
    return ft.panel(ds, spine, [at], [spec], mode).first()[spec.name]


def test_visibility_is_inclusive_and_lookback_is_strict(spark, day):
    ds = tenant(spark, [("a", "x", day(0), day(10), 1.0), ("a", "x", day(0), day(10, 1), 1.0),
                        ("a", "x", day(5), day(5), 1.0)])
    n = ft.FeatureSpec("n", "events", "count")
    assert one(spark, ds, n, day(10)) == 2.0
    assert one(spark, ds, n, day(10), ft.OCCURRED_ONLY) == 3.0
    assert one(spark, ds, n, day(1), ft.NO_FILTER) == 3.0
    w = ft.FeatureSpec("n", "events", "count", window_days=5)
    assert one(spark, ds, w, day(10)) == 0.0  # day 5 is exactly on the edge
    assert one(spark, ds, w, day(9)) == 1.0


@pytest.mark.parametrize("kind,column,want", [
    ("count", None, 3.0), ("sum", "value", 6.0), ("mean", "value", 3.0), ("max", "value", 5.0),
    ("nunique", "name", 2.0), ("recency_days", None, 7.0), ("age_days", "occurred_at", 10.0),
    ("constant", "value", 5.0)])
def test_kinds(spark, day, kind, column, want):
    ds = tenant(spark, [("a", "x", day(0), day(0), 1.0), ("a", "y", day(2), day(2), 5.0),
                        ("a", "y", day(3), day(3), None)])
    spec = ft.FeatureSpec("f", "events", kind, column, fill=-1.0)
    assert one(spark, ds, spec, day(10)) == want
    assert one(spark, ds, spec, day(10), who="b") == -1.0


def test_count_takes_the_fill_when_nothing_matches(spark, day):
    ds = tenant(spark, [("a", "x", day(0), day(0), 1.0)])
    spec = ft.FeatureSpec("n", "events", "count", where={"name": "y"}, fill=-5.0)
    assert one(spark, ds, spec, day(10)) == -5.0


def test_unknown_kind_and_mode():
    with pytest.raises(ValueError):
        ft.FeatureSpec("f", "events", "median")


def test_strict_mode_refuses_facts_known_before_they_happen(spark, day):
    ds = tenant(spark, [("a", "x", day(20), day(1), 1.0)])
    spine = spark.createDataFrame([("a", day(10))], "customer_id string, as_of timestamp_ntz")
    with pytest.raises(ft.LeakageError):
        ft.panel(ds, spine, [day(10)], [ft.FeatureSpec("n", "events", "count")], strict=True)


def test_one_shuffle_per_source_table(spark, day):
    ds = tenant(spark, [("a", "session_start", day(0), day(0), 1.0)])
    specs = [s for s in ft.standard_specs() if s.table == "events" and s.kind != "nunique"]
    t = ft.table_features(ds.events, EVENTS, specs, [day(1), day(2)])
    plan = t._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_ratio_uses_the_fill_without_a_denominator(spark):
    df = spark.createDataFrame([(3.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r["q"] for r in ft.ratio(df, "q", "a", "b").collect()] == [1.0, 1.5]
    assert CUSTOMERS.is_fact is False


def test_canary_is_found_and_honest_features_are_not(spark):
    df = spark.range(400).select(F.col("id").alias("unit"), (F.col("id") * 7919 % 101).cast("double")
                                 .alias("noise"), (F.col("id") * 31 % 2).cast("int").alias("y"))
    df = leakage.inject_canary(df, "y", F.col("unit"))
    got = [r["feature"] for r in leakage.suspicious(df, ["noise", "canary_leaked_outcome"], "y").collect()]
    assert got == ["canary_leaked_outcome"]


def test_auc_with_one_class_is_null(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int")
    assert leakage.auc(df, "x", "y").first()["auc"] is None


def test_rows_are_shuffled_once_for_all_moments_and_gates(spark, day):
    rows = [(str(k), "abc"[k % 3], "session_start", day(k % 9), day(k % 9 + k % 4), float(k)) for k in range(400)]
    events = spark.createDataFrame(rows, EVENTS.struct)
    specs = [s for s in ft.standard_specs() if s.table == "events"]
    at = [day(3), day(6), day(30)]
    got = ft.table_features(events, EVENTS, specs, at, ft.MODES)
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1
    assert plan.index("Generate explode") < plan.index("Exchange")  # printed from the last step down
    want = [(r.customer_id, r.as_of, m, *r[2:]) for m in ft.MODES
            for r in ft.table_features(events, EVENTS, specs, at, m).collect()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_panels_of_several_gates_are_those_of_each(spark, day):
    ds = tenant(spark, [("a", "session_start", day(1), day(4), 1.0), ("b", "session_start", day(3), day(3), 1.0)])
    specs = [ft.FeatureSpec("n", "events", "count", fill=-1.0)]
    spine = ds.customers.select("customer_id", F.explode(ft.moments([day(0), day(2), day(5)])).alias("as_of"))
    at = [day(0), day(2), day(5)]
    both = ft.panel(ds, spine, at, specs, [ft.SAFE, ft.OCCURRED_ONLY])
    for m in (ft.SAFE, ft.OCCURRED_ONLY):
        alone = ft.panel(ds, spine, at, specs, m).collect()
        assert sorted(map(str, alone)) == sorted(map(str, both.filter(F.col("mode") == m).drop("mode").collect()))
