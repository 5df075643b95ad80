import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.functions.columns import expit, uniform
from ebbtide.functions.tails import chi2_sf, exact_interval
from ebbtide.operators import campaign, correlate, effect, evaluate, survival, value
from ebbtide.operators.targeters import TLearner


@pytest.fixture(scope="module")
def planted(spark):
    """Trial with a known effect on the log-odds: tau = -0.8 + 0.9 x."""
    d = spark.range(4000).select(F.col("id").alias("unit"), (uniform("x", "id") * 4 - 2).alias("x"),
                                 (uniform("t", "id") < 0.5).cast("int").alias("t"))
    p = expit(-0.3 + 0.5 * F.col("x") + F.col("t") * (-0.8 + 0.9 * F.col("x")))
    return d.withColumn("y", (uniform("y", "unit") < p).cast("int")).cache()


def test_effect_model_recovers_the_planted_effect(planted):
    m = effect.EffectModel.fit(planted, ["x"])
    post = m.posterior(planted).toPandas()
    truth = -0.8 + 0.9 * post["x"]
    assert np.corrcoef(post["tau_mean"], truth)[0, 1] > 0.99
    inside = ((post["tau_low"] <= truth) & (truth <= post["tau_high"])).mean()
    assert inside > 0.7 and (post["tau_sd"] > 0).all()
    assert ((post["tau_mean"] < 0) == (post["prob_beneficial"] > 0.5)).mean() > 0.97


def test_distributed_and_local_solvers_agree(planted):
    m = effect.EffectModel.fit(planted, ["x"])
    pdf = planted.toPandas()
    xs = (pdf["x"] - pdf["x"].mean()) / pdf["x"].std(ddof=0)
    t = pdf["t"].to_numpy(float)
    z = np.column_stack([np.ones(len(xs)), xs, t, t * xs])
    local = effect.solve(effect._local(z, pdf["y"].to_numpy(float)), 1, effect.GRID)
    assert np.allclose(local.theta, m.post.theta, atol=1e-6)
    assert local.weights.sum() == pytest.approx(1.0)
    k = int(np.argmax(local.weights))
    prec, mu = effect._prior(1, local.grid[k], None)
    _, g, _ = effect._row_sums(z, pdf["y"].to_numpy(float), local.thetas[k])
    assert np.abs(g - prec * (local.thetas[k] - mu)).max() < 1e-4  # stationary point


def test_tenants_are_fitted_alike_whatever_their_size(planted):
    d = planted.withColumn("firm", F.when(F.col("unit") % 3 == 0, "big").when(
        F.col("unit") % 4 > 0, F.concat(F.lit("s"), F.col("unit") % 4)))
    d = d.union(planted.limit(30).withColumn("y", F.lit(0)).withColumn("firm", F.lit("flat")))
    got = {r["firm"]: r for r in effect.fit_groups(d, "firm", ["x"]).collect()}
    assert set(got) == {"big", "s1", "s2", "s3", None, "flat"}
    assert got["flat"]["n"] == 30 and got["flat"]["tau0"] is None
    for firm in ("big", "s1", None):
        one = effect.EffectModel.fit(d.filter(F.col("firm").eqNullSafe(firm)), ["x"]).post
        assert got[firm]["tau0"] == pytest.approx(one.tau0, abs=1e-5)
        assert got[firm]["tau0_var"] == pytest.approx(one.tau0_var, abs=1e-5)


def test_a_fit_that_does_not_converge_is_refused(planted, monkeypatch):
    monkeypatch.setattr(effect, "NEWTON_STEPS", 2)
    with pytest.raises(effect.EffectError, match="converged"):
        effect.EffectModel.fit(planted, ["x"])


def test_unidentifiable_trials_are_refused(planted):
    with pytest.raises(effect.EffectError, match="constant"):
        effect.EffectModel.fit(planted.withColumn("y", F.lit(1)), ["x"])
    with pytest.raises(effect.EffectError, match="both arms"):
        effect.EffectModel.fit(planted.withColumn("t", F.lit(1)), ["x"])
    with pytest.raises(effect.EffectError, match="control"):
        effect.OfferLadder.fit(planted.withColumn("arm", F.lit(1)), ["x"], 1)


def test_inestimable_offer_is_never_valued(planted):
    p = planted.withColumn("arm", F.col("t")).withColumn("value", F.lit(10.0)).withColumn(
        "c", F.lit(1.0))
    ladder = effect.OfferLadder.fit(p, ["x"], 2)  # nobody received offer 2
    assert ladder.models[1] is None
    row = ladder.value_offers(p.limit(3), "value", ["c", "c"], n=50).first()
    assert row["values"][0] is not None and row["values"][1] is None


def test_mixture_quantile_inverts_the_distribution():
    mu, sd, w = np.array([[0.0, 1.0]]), np.array([[1.0, 2.0]]), np.array([0.3, 0.7])
    q = effect.mixture_quantile(mu, sd, w, 0.05)
    assert effect.mixture_below(mu, sd, w, q)[0] == pytest.approx(0.05, abs=1e-6)


def test_t_learner_ranks_the_helped_first(planted):
    s = TLearner(learner="logistic").fit(planted, ["x"]).score(planted, "score")
    assert s.agg(F.corr("score", "x")).first()[0] > 0.9


def test_random_baseline_is_the_average_effect(planted):
    ate = planted.agg(F.avg(F.when(F.col("t") == 1, F.col("y"))) - F.avg(
        F.when(F.col("t") == 0, F.col("y")))).first()[0]
    r = evaluate.random_baseline(planted, 0.3, 400).first()
    assert r["uplift_per_contact"] == pytest.approx(ate, abs=0.01) and r["n_targeted"] == 1200
    assert r["ci_low"] < r["incremental_outcome"] < r["ci_high"]


def test_bootstrap_brackets_the_point(planted):
    d = planted.withColumn("score", F.col("x"))
    p = evaluate.evaluate_policy(d, 0.3).first()["incremental_outcome"]
    b = evaluate.bootstrap(d, 0.3, 200).first()
    assert b["ci_low"] < p < b["ci_high"]


@pytest.mark.parametrize("wins,draws,low,high", [(15, 20, 0.509, 0.913), (145, 200, 0.658, 0.786),
                                                 (0, 5, 0.0, 0.522), (5, 5, 0.478, 1.0)])
def test_exact_interval(wins, draws, low, high):
    got = exact_interval(wins, draws)
    assert got == pytest.approx((low, high), abs=1e-3)


def test_chi_square_tail():
    assert chi2_sf(16.919, 9) == pytest.approx(0.05, abs=1e-4)
    assert chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4) and chi2_sf(0, 9) == 1.0


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "a double, b double")
    assert correlate.pearson(df, "a", "b").first()["pearson"] is None
    assert correlate.spearman(df, "a", "b").first()["spearman"] is None
    assert correlate.pearson(df.limit(2), "b", "b").first()["pearson"] is None


def six(spark):
    rows = [(i, 6.0 - i, t, y, 100.0, 10.0) for i, (t, y) in enumerate(
        [(1, 0), (0, 1), (1, 0), (0, 0), (1, 1), (0, 1)])]
    return spark.createDataFrame(rows, "unit int, score double, t int, y int, value double, cost double")


def test_profit_curve_by_hand(spark):
    c = campaign.profit_curve(six(spark), min_arm=1)
    got = {r["size"]: r["profit"] for r in c.collect()}
    assert got[1] is None  # no control yet
    # size 2: 100 - 0 - 10; size 4: 100 - 50 - 10; size 6: 200/3 - 100/3 - 10
    assert got[2] == pytest.approx(180.0) and got[4] == pytest.approx(160.0)
    assert got[6] == pytest.approx(6 * (200 / 3 - 100 / 3 - 10))
    f = campaign.choose_fraction(c).first()
    assert f["profit"] == pytest.approx(max(v for v in got.values() if v is not None))
    assert all(r["profit"] is None for r in campaign.profit_curve(six(spark)).collect())
    assert campaign.choose_fraction(campaign.profit_curve(six(spark))).first()["fraction"] == 0.0


def test_unrankable_customers_are_refused(spark):
    with pytest.raises(ValueError, match="finite"):
        campaign.profit_curve(six(spark).withColumn("score", F.lit(None).cast("double")))


def test_profit_boosting_follows_the_profit(spark):
    d = spark.range(600).select(F.col("id").alias("unit"), (uniform("b", "id") * 2 - 1).alias("x"))
    d = d.withColumn("profit", F.col("x") * 10)
    for newton in (False, True):
        m = campaign.ProfitBoosting(rounds=4, rate=0.3, newton=newton).fit(d, ["x"], "profit", "unit")
        s = m.score(d, "s").agg(F.corr("s", (F.col("x") > 0).cast("double"))).first()[0]
        assert s > 0.8
    flat = campaign.ProfitBoosting(rounds=2).fit(d.withColumn("profit", F.lit(1.0)), ["x"], "profit", "unit")
    assert flat.score(d, "s").agg(F.max("s")).first()[0] == 0.0


# --- survival ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def lives(spark):
    """Hazard logit -3 + 0.8 x; 24 periods; cause 1 only."""
    d = spark.range(3000).select(F.col("id").alias("unit"), (uniform("s", "id") * 2 - 1).alias("x1"))
    h = expit(-3 + 0.8 * F.col("x1"))
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(24)), lambda p: uniform(
        "d", F.concat_ws("-", "unit", p)) < h))
    return d.withColumn("_f", first).select("unit", "x1", F.coalesce("_f", F.lit(24)).alias("duration"),
                                            F.col("_f").isNotNull().cast("int").alias("event")).cache()


@pytest.mark.parametrize("basis", ["spline", "dummies", "raw"])
def test_hazard_recovers_the_truth_and_arrays_equal_the_grid(lives, basis):
    m = survival.DiscreteHazard(["x1"], basis=basis, pool_after=6).fit(lives)
    few = lives.filter("unit < 40")
    a = m.hazards(few, 6).select("unit", F.posexplode("hazards").alias("i", "h")).toPandas()
    g = m.hazard_grid(few, 6).toPandas()
    g["i"] = g["period"] - 1
    j = a.merge(g, on=["unit", "i"])
    assert np.allclose(j["h"], j["hazard"], atol=1e-9)
    truth = 1 / (1 + np.exp(3 - 0.8 * j["x1"]))
    assert np.abs(j["h"] - truth).mean() < 0.015


def test_support_is_enforced(lives):
    m = survival.DiscreteHazard(["x1"], basis="raw").fit(lives)
    with pytest.raises(survival.SupportError):
        m.survival(lives, 25)
    with pytest.raises(value.ExtrapolationError):
        value.check_horizon(25, 24)
    value.check_horizon(25, 24, allow=True)


def test_causes_and_survival_add_up(lives):
    d = lives.withColumn("event", F.when(F.col("event") == 1, 1 + F.col("unit") % 2).otherwise(0).cast("int"))
    m = survival.CompetingHazards(["x1"], [1, 2], basis="raw").fit(d)
    c = m.curves(d.limit(50), 12)
    gap = F.abs(F.element_at("survival", -1) + F.element_at("cif_1", -1) + F.element_at("cif_2", -1) - 1)
    assert c.agg(F.max(gap)).first()[0] < 1e-9


def test_survival_data_contract(lives):
    with pytest.raises(ValueError, match="bad_duration"):
        survival.validate(lives.withColumn("duration", F.lit(0)), ["x1"], [1])
    with pytest.raises(ValueError, match="unknown_cause"):
        survival.validate(lives.withColumn("event", F.lit(7)), ["x1"], [1])
    with pytest.raises(ValueError, match="missing_covariates"):
        survival.validate(lives.withColumn("x1", F.lit(None).cast("double")), ["x1"], [1])
    assert survival.validate(lives, ["x1"], [1]) is lives


def test_value_by_hand(spark):
    df = spark.createDataFrame([([0.9, 0.8],)], "s array<double>")
    got = df.select(value.lifetime_value(F.col("s"), F.lit(10.0), 2, 0.0)).first()[0]
    assert got == pytest.approx(17.0)
    assert value.monthly_discount(0.12) == pytest.approx(1.12 ** (1 / 12) - 1)
    with pytest.raises(ValueError):
        value.monthly_discount(-1.0)
    assert math.isfinite(value.monthly_discount(-0.5))


def test_impossible_win_counts_are_refused():
    for wins, draws in ((5, 3), (-1, 3), (0, 0)):
        with pytest.raises(ValueError, match="no win count"):
            exact_interval(wins, draws)


def test_missing_profit_lift_is_refused(planted):
    lifted = planted.withColumn("gain", F.when(F.col("unit") > 5, F.col("x")))
    with pytest.raises(ValueError, match="6 rows lack gain"):
        campaign.ProfitBoosting(rounds=1).fit(lifted, ["x"], "gain", "unit")


def test_trials_are_refused_unless_whole(spark, planted):
    from ebbtide.sources.trials import TrialError, TrialSpec, load_trial

    share, rate = planted.agg(F.avg("t"), F.avg("y")).first()
    good = {"t": share, "y": rate}
    spec = TrialSpec("t", ["y"], ["x"], frozenset({"seen"}), good, "unit")
    assert load_trial(planted, spec, "y").columns == ["unit", "t", "y", "x"]
    for frame, s, outcome, text in (
            (planted, spec, "z", "no outcome"),
            (planted.filter("t = 1"), spec, "y", "not a fair part"),
            (planted.withColumn("seen", F.lit(1)),
             TrialSpec("t", ["y"], ["x", "seen"], frozenset({"seen"})), "y", "after assignment"),
            (planted.drop("x"), spec, "y", "absent")):
        with pytest.raises(TrialError, match=text):
            load_trial(frame, s, outcome)


def test_samples_take_what_is_there(planted):
    from ebbtide.operators import shaping

    few = planted.limit(150)
    assert sorted(r.unit for r in shaping.arm_sample(few, "unit", 400).collect()) == sorted(
        r.unit for r in few.collect())
    assert shaping.arm_sample(planted, "unit", 400).count() == 400


def test_null_groups_are_groups(spark):
    from ebbtide.operators import order

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "x int, g string")
    got = {(r["x"], r["g"], r["rank"]) for r in order.ranked(df, [F.col("x")], ["g"]).collect()}
    assert got == {(1, "a", 1), (2, "a", 2), (3, None, 1), (4, None, 2)}
    s = spark.createDataFrame([(1, 1, None), (2, 0, None), (2, 1, "p")],
                              "duration int, event int, plan string")
    assert {r["plan"] for r in survival.life_table(s, [1], ["plan"]).collect()} == {None, "p"}
