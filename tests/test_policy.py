import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import decide, dunning, holdout
from ebbtide.schema import EVENTS
from ebbtide.session import work_folder
from ebbtide.streaming import facts


def ids(spark, n, salt=""):
    return spark.range(n).select(F.concat(F.lit(salt), F.col("id")).alias("customer_id"))


def test_holdout_is_the_hash_and_nothing_else(spark):
    got = {r["customer_id"]: r["arm"] for r in holdout.assign(
        ids(spark, 300), "e", F.lit("2024-01-01"), 0.2, "s").collect()}
    for k, arm in got.items():
        u = int.from_bytes(hashlib.sha256(("s" + k).encode()).digest()[:8], "big") / 2**64
        assert arm == ("holdout" if u < 0.2 else "treated")
    more = {r["customer_id"]: r["arm"] for r in holdout.assign(
        ids(spark, 900).repartition(7), "e", F.lit("2024-01-01"), 0.2, "s").collect()}
    assert all(more[k] == v for k, v in got.items())


@pytest.mark.parametrize("fraction", [0.0, 1.0, -0.1, 2.0])
def test_bad_fractions(fraction):
    with pytest.raises(ValueError):
        holdout.held_out("customer_id", fraction)


def test_duplicates_are_refused(spark):
    with pytest.raises(ValueError, match="1 duplicate"):
        holdout.require_unique(ids(spark, 3).unionByName(ids(spark, 1)))


def test_ledger_only_grows(spark, tmp_path):
    path, at = str(tmp_path / "ledger"), F.lit("2024-01-01")
    assert holdout.read_ledger(spark, path).count() == 0
    holdout.record(spark, path, holdout.assign(ids(spark, 50), "e", at))
    holdout.record(spark, path, holdout.assign(ids(spark, 80), "e", at))
    holdout.record(spark, path, holdout.assign(ids(spark, 80), "e", at))
    holdout.record(spark, path, holdout.assign(ids(spark, 10), "other", at, 0.9))
    ledger = holdout.read_ledger(spark, path)
    assert ledger.count() == 90
    with pytest.raises(holdout.LedgerError):
        holdout.record(spark, path, holdout.assign(ids(spark, 80), "e", at, salt="reshuffled"))
    assert holdout.read_ledger(spark, path).count() == 90
    s = {r["experiment_id"]: (r["treated"], r["holdout"]) for r in holdout.ledger_summary(ledger).collect()}
    assert sum(s["e"]) == 80 and sum(s["other"]) == 10
    assert holdout.arm_of(ledger, "e").count() == 80


@pytest.mark.parametrize("n,mde", [(250, 0.2363), (1000, 0.1181), (4000, 0.0591), (10000, 0.0374)])
def test_detectable_effect(spark, n, mde):
    df = spark.createDataFrame([(float(n),)], "n double")
    assert df.select(holdout.detectable_effect(F.col("n"))).first()[0] == pytest.approx(mde, abs=1e-4)


def test_required_size_inverts_it(spark):
    df = spark.createDataFrame([(0.0108,), (-1.0,)], "e double")
    a, b = [r[0] for r in df.select(holdout.required_size(F.col("e"))).collect()]
    assert a == pytest.approx(119_500, rel=0.01) and b is None


def test_incrementality_needs_both_sides(spark):
    d = spark.range(40_000).select((F.col("id") % 10 == 0).alias("held_out"),
                                   F.when(F.col("id") % 10 == 0, F.col("id") % 50 < 40)
                                   .otherwise(F.col("id") % 9 > 0).alias("retained"),
                                   F.lit(100.0).alias("value"))
    m = holdout.with_p_value(holdout.incrementality(d)).withColumn(
        "v", holdout.verdict(F.col("p_value") < 0.05)).first()
    assert m["lift"] > 0.05 and m["lift_low"] < m["lift"] < m["lift_high"] and m["v"] == "POSITIVE"
    small = holdout.incrementality(d.limit(40)).select(holdout.verdict(F.lit(True))).first()[0]
    assert small == "TOO SMALL"


def test_unmeasurable_campaigns_are_refused(spark):
    d = spark.createDataFrame([(True, 1.0), (False, 1.0)], "held_out boolean, value double")
    assert holdout.require_measurable(d) is d
    with pytest.raises(ValueError, match="both arms"):
        holdout.require_measurable(d.filter("held_out"))
    with pytest.raises(ValueError, match="negative"):
        holdout.require_measurable(d.withColumn("value", F.lit(-1.0)))


def test_budget_rounds_half_to_even_and_keeps_the_gate(spark):
    d = spark.createDataFrame([(i, i % 2 == 0, float(i)) for i in range(5)],
                              "unit int, ok boolean, money double")
    got = {r["unit"] for r in decide.apply_budget(d, "ok", "money", 0.5).filter("treat").collect()}
    assert got == {4, 2}  # 2.5 rounds to 2, and 3 never passed the gate
    assert decide.apply_budget(d, "ok", "money", 1.0).filter("treat").count() == 3


def test_recommendation_ties_gaps_and_abstention(spark):
    d = spark.createDataFrame([(1, [2.0, 2.0], [0.9, 0.8]), (2, [-1.0, -2.0], [0.1, 0.1]),
                               (3, [None, 5.0], [0.0, 0.7])],
                              "unit int, v array<double>, c array<double>")
    got = {r["unit"]: (r["rung"], r["confidence_chosen"]) for r in decide.recommend(d, "v", "c").collect()}
    assert got == {1: (0, 0.9), 2: (-1, 0.0), 3: (1, 0.7)}
    cut = {r["unit"]: (r["rung"], r["budget_trimmed"]) for r in decide.recommend(d, "v", "c", 1 / 3).collect()}
    assert cut == {1: (-1, True), 2: (-1, False), 3: (1, False)}


@pytest.mark.parametrize("value,cost,message", [(-1.0, 0.0, "values"), (1.0, -1.0, "cost"),
                                                (float("inf"), 0.0, "values")])
def test_money_inputs_are_checked(spark, value, cost, message):
    df = spark.createDataFrame([(value, cost)], "value double, cost double")
    with pytest.raises(ValueError, match=message):
        decide.check_money(df, "value", ["cost"])


# --- dunning ---------------------------------------------------------------------------

@pytest.mark.parametrize("at,want", [
    ("2024-01-01 08:00", "2024-01-02 10:00"), ("2024-01-02 09:00", "2024-01-03 10:00"),
    ("2024-01-02 11:00", "2024-01-15 10:00"), ("2024-01-16 12:00", "2024-02-01 10:00"),
    ("2024-02-28 12:00", "2024-03-01 10:00"), ("2024-12-31 23:00", "2025-01-02 10:00")])
def test_next_payday(spark, at, want):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(at),)], "t timestamp_ntz")
    assert str(df.select(dunning.next_payday(F.col("t"))).first()[0])[:16] == want


def failing(spark, n=3000):
    return spark.range(n).select(
        F.col("id"), F.element_at(F.array(*map(F.lit, dunning.CODES)), (F.col("id") % 6 + 1).cast("int")).alias("code"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id * 7 % 8000 as int))").alias("failed_at"),
        (F.col("id") % 90 + 10).cast("double").alias("amount"))


def test_expectation_matches_realisation(spark):
    f = failing(spark)
    for policy in (dunning.DEFAULT, dunning.CODE_AWARE):
        e = dunning.expectations(f, policy).agg(F.avg("recovery"), F.avg("attempts"), F.avg("emails")).first()
        r = dunning.realise(f, policy, "id").agg(F.avg(F.col("recovered").cast("double")), F.avg("attempts"),
                                                 F.avg("emails")).first()
        assert list(r) == pytest.approx(list(e), abs=0.05)


def test_policies_in_money(spark):
    rows = {r["policy"]: r for r in dunning.compare(failing(spark, 600)).collect()}
    assert set(rows) == {p.name for p in dunning.POLICIES}
    assert rows["no_retry"]["net_value"] == 0.0 and rows["processor_default"]["net_gain"] == 0.0
    assert rows["code_aware_quiet"]["clv_lost_to_fatigue"] < rows["code_aware"]["clv_lost_to_fatigue"]
    assert rows["aggressive"]["attempts_per_failure"] > rows["code_aware"]["attempts_per_failure"]


def test_unknown_code_is_never_retried(spark):
    f = failing(spark, 6).withColumn("code", F.lit("mystery"))
    e = dunning.expectations(f, dunning.DEFAULT).agg(F.sum("recovery"), F.sum("attempts")).first()
    assert list(e) == [0.0, 0.0]


def test_tables(spark):
    assert dunning.code_table(spark).count() == 6
    assert dunning.policy_table(spark).filter("policy = 'no_retry'").count() == 0
    assert dunning.policy_table(spark).filter("policy = 'aggressive' AND emails").count() == 48


# --- streams ---------------------------------------------------------------------------

def write_events(spark, path, rows):
    ddl = ("event_id string, customer_id string, name string, occurred_at timestamp_ntz, "
           "available_at timestamp_ntz, value double")
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


def test_fact_stream_restarts_without_repeating(spark, tmp_path, day):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_events(spark, path, [("1", "a", "x", day(0), None, 1.0)])
    def run():
        s = facts.fact_stream(facts.read_parquet(spark, path, EVENTS.struct, "part-*"), EVENTS)
        return spark.read.parquet(facts.run_to_files(s, out))
    assert run().count() == 1
    write_events(spark, path, [("2", "a", "x", day(1), day(0), 1.0)])
    rows = run().orderBy("event_id").collect()
    assert len(rows) == 2
    assert rows[0]["available_at"] == day(0, 6) and rows[1]["available_at"] == day(1)


def test_last_seen_over_several_batches(spark, tmp_path, day):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (3, 9, 5):
        write_events(spark, path, [(str(n), "a", "x", day(n), day(n), 1.0)])
    s = facts.last_seen(facts.read_parquet(spark, path, EVENTS.struct, "part-*", 1))
    got = facts.latest(spark.read.parquet(facts.run_to_files(s, out, "update")), ["customer_id"], "last_seen")
    assert [tuple(r) for r in got.collect()] == [("a", day(9))]


def test_recovery_stream_and_its_complement(spark, tmp_path, day):
    path = str(tmp_path / "inv")
    rows = [("f1", "c", "failed", day(10)), ("p1", "c", "paid", day(20)), ("p2", "c", "paid", day(21)),
            ("f2", "d", "failed", day(10)), ("p3", "d", "paid", day(60))]
    schema = "invoice_id string, customer_id string, status string, attempted_at timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    inv = facts.read_parquet(spark, path, schema, "part-*")
    m = facts.recovered(inv.filter("status = 'failed'"), inv.filter("status = 'paid'"))
    hit = spark.read.parquet(facts.run_to_files(m, work_folder(spark, "t")))
    assert [r["invoice_id"] for r in hit.collect()] == ["f1"]
    rest = facts.unrecovered(spark.read.parquet(path).filter("status = 'failed'"), hit, "invoice_id",
                             F.col("attempted_at") < F.lit(day(70)).cast("timestamp_ntz"))
    assert [r["invoice_id"] for r in rest.collect()] == ["f2"]


def test_arrivals_enter_the_ledger_once(spark, tmp_path):
    path, ledger, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))
    for lo in (0, 5):
        ids(spark, 10).filter(f"cast(customer_id as int) >= {lo}").unionByName(
            ids(spark, 2)).coalesce(1).write.mode("append").parquet(path)
    s = facts.read_parquet(spark, path, "customer_id string", "part-*", 1)
    facts.assign_on_arrival(s, ledger, state, "e", F.lit("2024-01-01"))
    got = holdout.read_ledger(spark, ledger)
    assert got.count() == 10 and got.select("customer_id").distinct().count() == 10


INVOICES = "invoice_id string, customer_id string, status string, attempted_at timestamp_ntz"


def test_unrecovered_failures_leave_the_stream_once_over_several_batches(spark, tmp_path, day):
    """A file per batch, payments up to two days late, the same failure day for several customers."""
    import random
    rng = random.Random(3)
    rows = [(f"i{k}", f"c{rng.randrange(12)}", rng.choice(["failed", "paid", "failed"]),
             day(rng.randrange(150), rng.randrange(24))) for k in range(260)]
    rows += [("x1", "c0", "failed", day(150)), ("x2", "c0", "paid", day(150))]
    late = lambda r: r[3] + (dt.timedelta(hours=30) if r[2] == "paid" and int(r[0][1:]) % 3 == 0 else dt.timedelta())
    rows.sort(key=late)
    path = str(tmp_path / "inv")
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k:k + 40], INVOICES).coalesce(1).write.mode("append").parquet(path)
    inv = facts.read_parquet(spark, path, INVOICES, "part-*", 1)
    out = facts.run_to_files(facts.never_recovered(
        inv.filter("status = 'failed'"), inv.filter("status = 'paid'")), work_folder(spark, "t"))
    got = [r["invoice_id"] for r in spark.read.parquet(out).collect()]
    days = dt.timedelta(days=30)
    open_ = lambda f: not any(p[2] == "paid" and p[1] == f[1] and f[3] < p[3] <= f[3] + days for p in rows)
    seen = min(max(r[3] for r in rows if r[2] == s) for s in ("failed", "paid")) - dt.timedelta(days=2)
    assert len(got) == len(set(got)) and set(got) == {
        r[0] for r in rows if r[2] == "failed" and open_(r) and r[3] + days < seen}
    assert 20 < len(got) < 150


def test_panes_give_the_windows_of_a_slide_by_a_day(spark, tmp_path, day):
    import random
    rng = random.Random(5)
    rows = [(str(k), f"c{rng.choice([0, 0, 0, 1, 2, 3])}", "x", day(rng.randrange(100), rng.randrange(24)), None, 1.0)
            for k in range(120)]
    rows.sort(key=lambda r: r[3])
    path = str(tmp_path / "in")
    for k in range(0, 120, 30):
        write_events(spark, path, rows[k:k + 30])
    def run(make, key):
        s = facts.fact_stream(facts.read_parquet(spark, path, EVENTS.struct, "part-*", 1), EVENTS)
        out = spark.read.parquet(facts.run_to_files(make(s), work_folder(spark, "t"), "update"))
        return facts.latest(out, ["customer_id", key], "n")
    panes = run(facts.daily_panes, "day")
    assert panes.count() == len({(r[1], r[3].date()) for r in rows})
    got = facts.merge_panes(panes, [7, 30])
    for width in (7, 30):
        want = run(lambda s: facts.usage_counts(s, f"{width} days", "1 day"), "window_start")
        mine = got.filter(F.col("width_days") == width).drop("width_days")
        assert sorted(map(tuple, mine.select("customer_id", "window_start", "n").collect())) == sorted(
            map(tuple, want.select("customer_id", "window_start", "n").collect()))
