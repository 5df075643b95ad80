"""Steps whose cost must not follow one key, one file or one batch."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide.functions.columns import expit, uniform
from ebbtide.operators import effect, models, order, shaping, survival
from ebbtide.plans import catalogue, features
from ebbtide.session import spread, written


def test_months_hold_the_events_that_rows_are(spark):
    panel = spark.createDataFrame([("a", 0, 12), ("a", 1, 0), ("b", 2, 3), (None, 1, 2)],
                                  "unit string, month int, sessions int")
    start = shaping.month_start(F.col("month"), "2024-01-01 00:00:00")
    rows = shaping.expand_counts(panel, "sessions", start, "ev_")
    months = shaping.expand_counts(panel, "sessions", start, "ev_", nested=True)
    assert months.count() == 3 and rows.count() == 17
    again = months.select(F.explode("events").alias("e")).select("e.*")
    assert again.columns == rows.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_tasks_follow_the_size_of_files(spark, tmp_path):
    big = spark.range(10_000_000)  # 80 MB by the planner's estimate
    assert spread(big).rdd.getNumPartitions() >= 70
    assert spread(spark.range(10)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rows_of_one_time_are_dealt_to_many_slices(spark, monkeypatch):
    held = []
    monkeypatch.setattr(order, "cut", lambda df: held.append(df.cache()) or held[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        asks = spark.range(4000).select("id", F.when(F.col("id") < 3900, 5.0).otherwise(1.0).alias("t"))
        facts = spark.createDataFrame([(2.0, "x"), (5.0, "y"), (9.0, "z")], "t double, v string")
        got = order.as_of(asks, facts, "t", {"v": F.col("v")}, F.lit("none")).groupBy("t", "v").count().collect()
        assert {tuple(r) for r in got} == {(5.0, "y", 3900), (1.0, "none", 100)}
        largest = max(r["count"] for r in held[0].groupBy("_slice").count().collect())
        assert largest < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        held[0].unpersist()


def test_draws_of_a_batch_are_not_held_at_once():
    rng = np.random.default_rng(0)
    xs = pd.Series(list(rng.normal(size=(4000, 2))))
    v, c, theta = rng.normal(size=4000), rng.normal(size=4000), rng.normal(size=(500, 6))
    names = ["mean", "sd", "prob_positive", "low", "delta_p"]
    tracemalloc.start()
    got = effect.money_rows(xs, v, c, theta, 2, names)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # the draws of all rows are 16 MB in each of several arrays
    z = np.concatenate([[1.0], xs[3999]])
    eta, tau = theta[:, :3] @ z, theta[:, 3:] @ z
    m = -(1 / (1 + np.exp(-(eta + tau))) - 1 / (1 + np.exp(-eta))) * v[3999] - c[3999]
    assert got.loc[3999, "mean"] == pytest.approx(m.mean()) and got.loc[3999, "low"] == pytest.approx(
        np.quantile(m, 0.05))


@pytest.fixture(scope="module")
def labelled(spark):
    d = spark.range(1500).select(F.col("id").alias("unit"), F.floor(uniform("a", "id") * 20).alias("a"),
                                 F.floor(uniform("b", "id") * 3).alias("b"))
    return d.withColumn("y", (uniform("y", "unit") < expit(F.col("a") / 5 - F.col("b"))).cast("int")).cache()


def test_trees_on_counts_are_the_trees_on_rows(spark, labelled, monkeypatch):
    held = []
    monkeypatch.setattr(models, "cut", lambda df: held.append(df) or df)
    got = models.boosted(labelled, ["a", "b"], "y", rounds=6).score(labelled, "p")
    assert held[-1].count() <= 20 * 3 * 2 and held[-1].agg(F.sum("_w")).first()[0] == 1500
    x = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(labelled)
    plain = GBTClassifier(featuresCol="x", labelCol="y", maxIter=6, stepSize=0.06, maxDepth=3, seed=0).fit(x)
    want = plain.transform(x).select("unit", vector_to_array("probability")[1].alias("q"))
    gap = got.join(want, "unit").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert gap < 1e-9


def test_borders_share_the_rows_out(spark):
    d = spark.range(30_000).select((F.col("id") * 1.0).alias("fine"), (F.col("id") % 3).alias("few"))
    fine, few = models.borders(d, ["fine", "few"], 30_000)
    assert few == [0.5, 1.5] and len(fine) == 31
    assert np.allclose(np.diff([0, *fine, 30_000]), 30_000 / 32, atol=10)


def test_logistic_fit_is_the_least_loss(labelled):
    m = models.logistic(labelled, ["a", "b"], "y").model
    pdf = labelled.toPandas()
    z = (pdf[["a", "b"]].to_numpy() - m.mean) / m.spread
    r = pdf["y"] - 1 / (1 + np.exp(-(m.theta[0] + z @ m.theta[1:])))
    assert abs(r.sum()) < 1e-6 and np.abs(z.T @ r - m.theta[1:]).max() < 1e-6


@pytest.mark.parametrize("basis", ["spline", "dummies", "raw"])
def test_units_and_their_periods_give_one_fit(spark, basis):
    d = spark.range(400).select(F.col("id").alias("unit"), uniform("x", "id").alias("x"), (uniform("z", "id") < 0.5)
                                .cast("int").alias("z"), (1 + F.col("id") % 9).cast("int").alias("duration"),
                                (F.col("id") % 4).cast("int").alias("event"))
    new = lambda: survival.DiscreteHazard(["x", "z"], basis=basis, pool_after=5, cause=1)
    units, periods = new().fit(d).model.model, new().fit_periods(survival.person_period(d, 1)).model.model
    assert np.allclose(units.theta, periods.theta, atol=1e-6)
    assert np.allclose(units.mean, periods.mean) and np.allclose(units.spread, periods.spread)


def test_panels_and_their_labels_are_not_broadcast(spark, monkeypatch):
    """Both take far more memory than the planner's estimate of what is written or not yet repeated."""
    held = {}

    class Enough(Exception):
        pass

    def kept(df, name, *by):
        if name == "panels":
            held[name] = df
            raise Enough
        return written(df, name, *by)

    monkeypatch.setattr(features, "written", kept)
    with pytest.raises(Enough):
        catalogue()["leakage_penalty"].run(spark, "/root/testdata/sf0.001")
    joins = [line for line in held["panels"]._jdf.queryExecution().executedPlan().toString().splitlines()
             if "Join" in line and "as_of" in line]
    assert len(joins) == 6 and all("SortMergeJoin" in line for line in joins)


def test_months_are_expanded_in_bounded_parts_and_not_by_a_lambda(spark, monkeypatch):
    panel = spark.createDataFrame([("a", 0, 70), ("a", None, 3), ("b", 2, 9), (None, 1, 2), ("é", 5, 1)],
                                  "unit string, month int, sessions bigint").repartition(1)
    start = shaping.month_start(F.col("month"), "2024-01-01 00:00:00")
    rows = shaping.expand_counts(panel, "sessions", start, "ev_")
    months = shaping.expand_counts(panel, "sessions", start, "ev_", nested=True)
    assert "lambda" not in months._jdf.queryExecution().executedPlan().toString()
    again = months.select(F.explode("events").alias("e")).select("e.*")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    monkeypatch.setattr(shaping, "EVENTS", 8)
    batch = spark.createDataFrame(
        [("a", 0, 10, 3, "k"), ("b", 0, 10, 4, "l"), ("c", 0, 10, 9, "m")],
        "customer_id string, month int, _start long, _n long, _key string").toArrow().combine_chunks().to_batches()
    assert [b.num_rows for b in shaping._month_events(iter(batch))] == [2, 1]


def test_curves_of_a_batch_are_those_of_each_row(spark, monkeypatch):
    nan = float("nan")
    rows = [(1, [0.1, 0.2, 0.3], [0.05, 0.9, 0.1]), (2, [0.1, None], [0.2, 0.3]), (3, None, [0.1]), (4, [], []),
            (5, [0.1, 0.2], [0.3]), (6, [0.5], [0.25]), (7, [nan, 0.1], [0.1, 0.2]), (8, [0.7, -0.1, 0.0], [0.6, 0.2, 1.0])]
    d = spark.createDataFrame(rows, "unit long, h array<double>, g array<double>").repartition(2)
    got = survival.competing_curves(d, {1: "h", 2: "g"})
    none = F.lit(None).cast("struct<survival: array<double>, cif_0: array<double>, cif_1: array<double>>")
    assert got.filter("unit IN (1, 4, 6, 8)").select(survival._batch_curves("h", "g").alias("c")).filter(
        "c IS NOT NULL").count() == 4
    monkeypatch.setattr(survival, "_batch_curves", lambda *names: none)
    want = survival.competing_curves(d, {1: "h", 2: "g"})
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rounding_by_arithmetic_is_rounding_by_digits(spark):
    from ebbtide.plans.survival import round6
    odd = [None, float("nan"), float("inf"), -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -0.5e-6, 0.1234565, 1e7 + 0.1234567, 1e300]
    d = spark.createDataFrame([(x,) for x in odd], "x double").union(
        spark.range(20_000).select((uniform("r", "id") - 0.5) * 4)).union(
        spark.range(2_000).select((F.col("id") * 10 + 5) / 1e7))
    r = d.select(round6(F.col("x")).alias("a"), F.round("x", 6).alias("b"))
    assert r.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_fits_of_several_causes_read_the_units_once(spark, monkeypatch):
    d = spark.range(300).select(F.col("id").alias("unit"), uniform("x", "id").alias("x"),
                                (1 + F.col("id") % 9).cast("int").alias("duration"), (F.col("id") % 3).cast("int").alias("event"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = d.mapInArrow(count, d.schema)
    m = survival.CompetingHazards(["x"], [1, 2], basis="spline").fit(counted)
    assert seen.value == 300
    for cause, model in m.models.items():
        alone = survival.DiscreteHazard(["x"], basis="spline", cause=cause).fit(d)
        assert np.allclose(model.model.model.theta, alone.model.model.theta)
