import numpy as np
import pytest
from pyspark.sql import functions as F

import ebbtide.session as session
from ebbtide.functions.columns import DAY_US
from ebbtide.operators import metrics, order
from ebbtide.operators.interval import exists_within


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one value and one key."""
    rng = np.random.default_rng(0)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.integers(9)}",
             1.0 if i % 3 == 0 else float(rng.integers(50))) for i in range(600)]
    return spark.createDataFrame(rows, "id int, k string, v double").cache()


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_running_sum_does_not_depend_on_partitions(spark, hot, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = order.running(hot.repartition(parts), [F.col("v").desc(), F.col("id").asc()],
                            {"r": F.lit(1).cast("long"), "s": F.col("v")}).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = hot.toPandas().sort_values(["v", "id"], ascending=[False, True])
    got = got.set_index("id").loc[want["id"]]
    assert got["r"].tolist() == list(range(1, 601))
    assert np.allclose(got["s"], want["v"].cumsum())


def test_running_sum_restarts_per_group(hot):
    got = order.ranked(hot, [F.col("v").asc(), F.col("id").asc()], ["k"]).toPandas()
    want = hot.toPandas().sort_values(["k", "v", "id"])
    want["rank"] = want.groupby("k").cumcount() + 1
    m = got.merge(want, on=["id"])
    assert (m["rank_x"] == m["rank_y"]).all()


def test_offsets_fall_back_to_a_shuffle_when_many(hot, monkeypatch):
    monkeypatch.setattr(session.lookup, "__defaults__", (1,))
    got = order.ranked(hot, [F.col("v").asc(), F.col("id").asc()], ["k"])
    assert got.agg(F.sum("rank")).first()[0] == sum(
        n * (n + 1) // 2 for n in hot.groupBy("k").count().toPandas()["count"])


def test_quantiles_are_exact(hot):
    v = hot.toPandas()["v"]
    got = order.quantiles(hot, "v", {"a": 0.1, "b": 0.5, "c": 0.975, "d": 1.0}).first()
    assert np.allclose(list(got), np.quantile(v, [0.1, 0.5, 0.975, 1.0]))
    by = order.quantiles(hot, "v", {"m": 0.5}, ["k"]).toPandas().set_index("k")["m"]
    assert np.allclose(by, hot.toPandas().groupby("k")["v"].median().loc[by.index])


def test_average_ranks(hot):
    got = order.average_ranks(hot, "v").toPandas().set_index("v")["avg_rank"]
    want = hot.toPandas()["v"].rank()
    want.index = hot.toPandas()["v"]
    assert np.allclose(got.loc[want.index], want)


@pytest.mark.parametrize("low,high", [(1, 30 * DAY_US), (-45 * DAY_US, DAY_US)])
def test_exists_within_equals_brute_force(spark, day, low, high):
    rng = np.random.default_rng(1)
    def side(n):
        return [(i, "hot" if i % 3 == 0 else f"k{rng.integers(5)}",
                 day(int(rng.integers(-400, 400)), int(rng.integers(24)))) for i in range(n)]
    p, b = side(150), side(120)
    # exact edges of the window
    p += [(900, "edge", day(0)), (901, "edge2", day(0)), (902, "none", day(0))]
    b += [(900, "edge", day(30)), (901, "edge2", day(0))]
    schema = "id int, k string, t timestamp_ntz"
    got = exists_within(spark.createDataFrame(p, schema), spark.createDataFrame(b, schema), "k",
                        "t", "t", low, high, "hit").collect()
    def us(x):
        return int(round(x.total_seconds() * 1e6))
    want = {i: any(k == kk and low <= us(tt - t) <= high for _, kk, tt in b) for i, k, t in p}
    assert {r["id"]: r["hit"] for r in got} == want
    assert len(got) == len(p)


def brute_c(t, e, r):
    c = x = n = 0.0
    for i in range(len(t)):
        if not e[i]:
            continue
        for j in range(len(t)):
            if j != i and (t[j] > t[i] or (t[j] == t[i] and not e[j])):
                n += 1
                c += r[i] > r[j]
                x += r[i] == r[j]
    return (c + 0.5 * x) / n


@pytest.mark.parametrize("scale", ["int", "double"])
def test_concordance_equals_all_pairs(spark, scale):
    rng = np.random.default_rng(2)
    t = rng.integers(1, 30, 200)
    e, r = rng.integers(0, 2, 200), rng.integers(0, 12, 200)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(t, e, r)],
                               "duration int, event int, risk double")
    df = df.withColumn("duration", F.col("duration").cast(scale))
    assert metrics.concordance(df).first()["c_index"] == pytest.approx(brute_c(t, e > 0, r))


def test_constant_risk_is_one_half(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.5), (3, 1, 0.5)],
                               "duration int, event int, risk double")
    assert metrics.concordance(df).first()["c_index"] == 0.5


def test_curves_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(1, 40, 300), rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "duration int, event int")
    s, want = 1.0, {}
    for t in sorted({a for a, _ in rows}):
        s *= 1 - sum(a == t and b == 1 for a, b in rows) / sum(a >= t for a, _ in rows)
        want[t] = s
    got = {r["time"]: r["survival"] for r in metrics.kaplan_meier(df).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("parts", [1, 5])
def test_as_of_is_the_last_fact_before(spark, parts):
    """Groups and times may be NULL, a group may hold most rows, and no time has to match."""
    rng = np.random.default_rng(7)
    groups = [None, "a", "hot", "hot", "hot", "none"]
    facts = {(groups[rng.integers(5)], int(rng.integers(200))): float(k) for k in range(300)}
    facts[(None, None)] = -1.0
    asks = [(k, groups[rng.integers(6)], None if k % 17 == 0 else float(rng.integers(-5, 405)) / 2) for k in range(500)]
    f = spark.createDataFrame([(g, t, v, None if v % 5 == 0 else v) for (g, t), v in facts.items()],
                              "g string, t int, v double, w double")
    a = spark.createDataFrame(asks, "id int, g string, t double").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["id"]: (r["v"], r["w"]) for r in order.as_of(
            a, f, "t", {"v": F.col("v"), "w": F.col("w")}, F.lit(9.5), ["g"]).collect()}
        alone = {r["id"]: r["v"] for r in order.as_of(a, f.filter("g = 'hot'"), "t", {"v": F.col("v")}, F.lit(None)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    def last(g, t):
        early = [(x, v) for (h, x), v in facts.items() if h == g and x is not None and t is not None and x <= t]
        return max(early)[1] if early else None
    for k, g, t in asks:
        v = last(g, t)
        assert got[k] == ((9.5, 9.5) if v is None else (v, None if v % 5 == 0 else v))
        assert alone[k] == last("hot", t)
    assert len(got) == len(asks)


def test_as_of_broadcasts_nothing_and_forms_no_pairs(spark, hot):
    curve = hot.groupBy(F.col("v").alias("t")).agg(F.count("*").alias("n"))
    plan = order.as_of(hot.select("id", F.col("v").alias("t")), curve, "t", {"n": F.col("n")}, F.lit(0)
                       )._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
