"""From an effect to an action: money, abstention, budgets, offers, and how they did."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import expit, half_even
from .correlate import with_interval
from .order import match, quantiles, running, with_size


def probability_effect(eta0: Column, tau: Column) -> Column:
    """M1: change in probability of a log-odds effect; negative helps."""
    return expit(eta0 + tau) - expit(eta0)


# --- posterior draws held as arrays ------------------------------------------------

def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def sd(a: Column) -> Column:
    """Sample spread; 0 for a single draw."""
    m = mean(a)
    ss = F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0),
                     lambda s, x: s + x)
    return F.when(F.size(a) > 1, F.sqrt(ss / F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(0.0)


def prob_positive(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x > 0)) / F.size(a)


def quantile(a: Column, q: float) -> Column:
    """Linear interpolation between the order statistics of one row's draws."""
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"{q} is no share of the draws")
    s = F.array_sort(a)
    pos = F.lit(q) * (F.size(a) - 1)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    low = F.element_at(s, lo + 1)
    return low + (F.element_at(s, hi + 1) - low) * (pos - F.floor(pos))


def benefit_draws(delta_p: Column, value: Column, cost: Column) -> Column:
    """M2: money per draw, -delta_p * V - c."""
    return F.transform(delta_p, lambda d: -d * value - cost)


def check_money(df: DataFrame, value: str, costs: Sequence[str]) -> None:
    """M2: refuse negative or non-finite values and negative costs (one aggregate)."""
    v = F.col(value)
    bad_v = v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    row = df.agg(F.count(F.when(bad_v, 1)),
                 *[F.count(F.when(F.col(c) < 0, 1)) for c in costs]).first()
    if row[0]:
        raise ValueError(f"{row[0]} customer values are negative or not finite")
    if any(row[1:]):
        raise ValueError(f"{sum(row[1:])} offers cost less than nothing")


def summarise_draws(df: DataFrame, draws: str, keep: Sequence[str], q: float = 0.05
                    ) -> DataFrame:
    """M3."""
    a = F.col(draws)
    return df.select(*keep, mean(a).alias("mean"), sd(a).alias("sd"),
                     prob_positive(a).alias("prob_positive"), quantile(a, q).alias("low"))


def abstain_rule(confidence: Column, alpha: float) -> Column:
    """M4: act only when P(benefit > 0) exceeds 1 - alpha."""
    return confidence > 1.0 - alpha


def apply_budget(df: DataFrame, cleared: str, money: str, budget: float, key: str = "unit",
                 flag: str = "treat") -> DataFrame:
    """M6: of the rows that cleared the gate keep the round(budget * n) worth most."""
    r = running(df, [F.col(cleared).desc(), F.col(money).desc(), F.col(key).asc()],
                {"_rank": F.lit(1).cast("long")})
    keep = F.col(cleared) & (F.col("_rank") <= half_even(budget * F.col("_n")))
    return with_size(r, df).withColumn(flag, keep).drop("_rank", "_n")


def top_by_money(df: DataFrame, money: Column, budget: float, key: str = "unit",
                 flag: str = "treat") -> DataFrame:
    """M7: fill the budget in order of expected money, whatever its sign."""
    d = df.withColumn("_money", money)
    r = running(d, [F.col("_money").desc(), F.col(key).asc()],
                {"_rank": F.lit(1).cast("long")})
    return (with_size(r, d).withColumn(flag, F.col("_rank") <= half_even(budget * F.col("_n")))
            .drop("_rank", "_n", "_money"))


# --- choosing among several offers -------------------------------------------------

def recommend(df: DataFrame, values: str, confidence: str, budget: float | None = None,
              key: str = "unit") -> DataFrame:
    """M9: best offer per customer, none when it does not pay, then the budget.

    `values` is the risk-adjusted money of each offer; NULL marks an offer the pilot cannot
    estimate. `rung` is 0-based, -1 means no offer.
    """
    v = F.transform(F.col(values), lambda x: F.coalesce(x, F.lit(float("-inf"))))
    d = df.withColumn("_best", F.array_max(v)).withColumn(
        "_at", F.array_position(v, F.array_max(v)).cast("int"))
    d = d.withColumn("_pays", F.col("_best") > 0)
    if budget is None:
        d = d.withColumn("_keep", F.col("_pays"))
    else:
        d = apply_budget(d, "_pays", "_best", budget, key, "_keep")
    return d.select(
        *df.columns, F.when(F.col("_keep"), F.col("_at") - 1).otherwise(-1).alias("rung"),
        F.when(F.col("_keep"), F.col("_best")).otherwise(0.0).alias("expected_value"),
        F.when(F.col("_keep"), F.element_at(F.col(confidence), F.col("_at"))).otherwise(0.0)
        .alias("confidence_chosen"), (F.col("_pays") & ~F.col("_keep")).alias("budget_trimmed"))


def offer_counts(rec: DataFrame, offers: Sequence[str]) -> DataFrame:
    """Customers per offer, including the ones given to nobody and the abstentions."""
    names = {-1: "no offer", **dict(enumerate(offers))}
    a = rec.agg(*[F.count(F.when(F.col("rung") == k, 1)).alias(n) for k, n in names.items()])
    return a.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("offer"), F.col(f"`{n}`").alias("n")) for n in names.values()]))
        .alias("r")).select("r.*")


def recommendation_summary(rec: DataFrame, thin: float = 0.6) -> DataFrame:
    """Acted, trimmed by budget, unprofitable, thin evidence, total gain."""
    act = F.col("rung") >= 0
    return rec.agg(
        F.count(F.when(act, 1)).alias("acted"),
        F.count(F.when(F.col("budget_trimmed"), 1)).alias("trimmed"),
        F.count(F.when(~act & ~F.col("budget_trimmed"), 1)).alias("unprofitable"),
        F.count(F.when(act & (F.col("confidence_chosen") < thin), 1)).alias("thin"),
        F.coalesce(F.sum(F.when(act, F.col("expected_value"))), F.lit(0.0)).alias("total_gain"))


def best_pilot_arm(pilot: DataFrame, arms: int, arm: str = "arm", y: str = "y",
                   value: str = "value", costs: Sequence[str] = ()) -> DataFrame:
    """Lift of each arm over the shared control, priced; the best one, or nothing."""
    a = pilot.agg(F.avg(F.when(F.col(arm) == 0, F.col(y).cast("double"))).alias("y0"),
                  F.avg(value).alias("v"),
                  *[F.avg(F.when(F.col(arm) == k + 1, F.col(y).cast("double"))).alias(f"y{k+1}")
                    for k in range(arms)],
                  *[F.avg(c).alias(f"c{k+1}") for k, c in enumerate(costs)])
    rows = a.select(F.explode(F.array(*[F.struct(
        F.lit(k).alias("rung"),
        ((F.col("y0") - F.col(f"y{k+1}")) * F.col("v") - F.col(f"c{k+1}")).alias("money"))
        for k in range(arms)])).alias("r")).select("r.*")
    best = rows.agg(F.max_by(F.struct("rung", "money"),
                             F.struct(F.coalesce("money", F.lit(float("-inf"))),
                                      -F.col("rung"))).alias("b"))
    return best.select(F.col("b.rung").alias("pilot_choice"), F.col("b.money").alias("money"),
                       F.when(F.col("b.money") > 0, F.col("b.rung")).otherwise(-1)
                       .alias("choice_or_nothing"))


def assignment_values(df: DataFrame, arms: int, chosen: str = "rung", value: str = "value"
                      ) -> DataFrame:
    """Realised money of the assignment, of each uniform arm, and of the best arm each.

    Needs columns y0, y1_k, tau_k and cost_k for every arm k.
    """
    def money(k):
        return (F.col("y0") - F.col(f"y1_{k}")) * F.col(value) - F.col(f"cost_{k}")
    own = F.lit(0.0)
    for k in range(arms):
        own = F.when(F.col(chosen) == k, money(k)).otherwise(own)
    expected = F.array(*[-F.col(f"tau_{k}") * F.col(value) - F.col(f"cost_{k}")
                         for k in range(arms)])
    at = F.array_position(expected, F.array_max(expected))
    matched = F.when(F.array_max(expected) > 0, F.element_at(
        F.array(*[money(k) for k in range(arms)]), at.cast("int"))).otherwise(0.0)
    a = df.agg(F.sum(own).alias("assigned"), F.sum(matched).alias("oracle_matched"),
               *[F.sum(money(k)).alias(f"u{k}") for k in range(arms)])
    u = F.array(*[F.col(f"u{k}") for k in range(arms)])
    return a.select("assigned", "oracle_matched", F.array_max(u).alias("best_uniform"),
                    (F.array_position(u, F.array_max(u)) - 1).cast("int").alias("best_rung"),
                    F.array_min(u).alias("worst_uniform"))


# --- scoring decisions against the truth ---------------------------------------------

def score_decisions(df: DataFrame, policies: Mapping[str, Column], value: str = "value",
                    cost: str = "cost", tau: str = "tau") -> DataFrame:
    """Expected and realised money, spend, return, saved and harmed; one scan for all."""
    expected = -F.col(tau) * F.col(value) - F.col(cost)
    realised = (F.col("y0") - F.col("y1")) * F.col(value) - F.col(cost)
    zero = F.lit(0.0)
    parts = {"n_treated": (F.lit(1), "count"), "expected_value": (expected, "sum"),
             "realised_value": (realised, "sum"), "offer_spend": (F.col(cost), "sum"),
             "saved": (F.when((F.col("y0") == 1) & (F.col("y1") == 0), 1), "count"),
             "harmed": (F.when((F.col("y0") == 0) & (F.col("y1") == 1), 1), "count")}
    aggs = []
    for i, cond in enumerate(policies.values()):
        for name, (x, how) in parts.items():
            e = F.when(cond, x)
            aggs.append((F.count(e) if how == "count" else F.coalesce(F.sum(e), zero))
                        .alias(f"{name}_{i}"))
    a = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p).alias("policy"), *[
        F.col(f"{n}_{i}").alias(n) for n in parts]) for i, p in enumerate(policies)])
    return a.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "roi", F.when(F.col("offer_spend") > 0, F.try_divide("expected_value", "offer_spend"))
        .otherwise(0.0))


def quadrant(tau: Column, p0: Column, eps: float = 0.01) -> Column:
    """Customer type from the effect and the baseline risk."""
    return (F.when(tau <= -eps, "persuadable").when(tau >= eps, "sleeping_dog")
            .when(p0 > 0.5, "lost_cause").otherwise("sure_thing"))


def realised_quadrant(y0: Column, y1: Column) -> Column:
    """Customer type from the pair of outcomes."""
    return (F.when((y0 == 0) & (y1 == 0), "sure_thing")
            .when((y0 == 1) & (y1 == 0), "persuadable")
            .when((y0 == 0) & (y1 == 1), "sleeping_dog").otherwise("lost_cause"))


def quadrant_shares(df: DataFrame, tau: str = "tau", p0: str = "p0") -> DataFrame:
    """Share and mean effect per type."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(quadrant(F.col(tau), F.col(p0)).alias("quadrant")).agg(
        (F.count(F.lit(1))).alias("n"), F.avg(tau).alias("mean_tau")).select(
        "quadrant", (F.col("n") / total).alias("share"), "mean_tau")


TAU_BAND = (-0.05, 0.0)


def economics(df: DataFrame, value: str = "value", cost: str = "cost", tau: str = "tau",
              band: tuple[float, float] = TAU_BAND) -> DataFrame:
    """Can any policy profit here? Exact quantiles, one aggregate for the rest."""
    d = df.select("*", (-F.col(tau) * F.col(value) - F.col(cost)).alias("_m"),
                  F.try_divide(F.col(cost), F.col(value)).alias("_be"))
    p10 = quantiles(d, tau, {"q": 0.10}).scalar()
    be = quantiles(d, "_be", {"q": 0.5}).scalar()
    mc = quantiles(d, cost, {"q": 0.5}).scalar()
    pays = F.col("_m") > 0
    a = d.agg(F.avg(tau).alias("mean_tau"), F.avg(pays.cast("double")).alias("pays_for"),
              F.avg((F.col(tau) > 0).cast("double")).alias("sleeping_dog"),
              F.avg("_m").alias("mean_value"),
              F.coalesce(F.sum(F.when(pays, F.col("_m"))), F.lit(0.0)).alias("oracle_value"))
    return a.select("*", p10.alias("p10_tau"), be.alias("break_even"), mc.alias("median_cost"),
                    F.col("mean_tau").between(*band).alias("in_band"))


def channel_economics(df: DataFrame, channel: str, value: str = "value", cost: str = "cost",
                      tau: str = "tau") -> DataFrame:
    """What contacting everyone earns per channel, and what an oracle would earn."""
    m = -F.col(tau) * F.col(value) - F.col(cost)
    med = quantiles(df, cost, {"cost": 0.5}, [channel])
    a = df.groupBy(channel).agg(
        F.avg(tau).alias("mean_tau"), F.avg((F.col(tau) > 0).cast("double"))
        .alias("harmed_share"), F.sum(m).alias("treat_all_value"),
        F.avg(m).alias("treat_all_per_customer"),
        F.avg((m > 0).cast("double")).alias("oracle_share"),
        F.coalesce(F.sum(F.when(m > 0, m)), F.lit(0.0)).alias("oracle_value"))
    return match(a, med, [channel])


# --- comparing policies over many draws -----------------------------------------------

def regret_matrix(runs: DataFrame, policies: Sequence[str], setting: str = "n_customers"
                  ) -> DataFrame:
    """Mean value per policy and setting, and regret scaled to that setting's range."""
    w = runs.groupBy(setting).pivot("policy", list(policies)).agg(F.avg("value"))
    best, worst = F.greatest(*policies), F.least(*policies)
    return w.select(setting, *policies, *[
        ((best - F.col(p)) / F.greatest(best - worst, F.lit(1e-9))).alias(f"regret_{p}")
        for p in policies])


def best_alpha(runs: DataFrame, offer: str, alpha: str = "alpha", value: str = "value"
               ) -> DataFrame:
    """Which confidence threshold earns most per offer; NULL when they all tie."""
    per = runs.groupBy(offer, alpha).agg(F.avg(value).alias("v"))
    g = per.groupBy(offer).agg(F.max("v").alias("hi"), F.min("v").alias("lo"),
                               F.max_by(alpha, F.struct(F.col("v"), -F.col(alpha))).alias("a"))
    ok = F.col("hi") - F.col("lo") > 1e-9
    return g.select(offer, F.col("hi").alias("best_value"), ok.alias("determinate"),
                    F.when(ok, F.col("a")).alias("best_alpha"))


def rule_summary(runs: DataFrame, ours: str = "abstention_money",
                 comparator: str = "top_k_money", random: Sequence[str] = ("random_30pct",)
                 ) -> DataFrame:
    """Paired rates per size; wins, ties and non-losses are counted apart."""
    policies = [ours, comparator, *random, "treat_all"]
    w = runs.groupBy("n_customers", "seed").pivot("policy", policies).agg(
        F.first("value").alias("v"), F.first("n_treated").alias("k"))
    o, c, a = F.col(f"{ours}_v"), F.col(f"{comparator}_v"), F.col("treat_all_v")
    r = sum((F.col(f"{p}_v") for p in random), F.lit(0.0)) / len(random)

    def rate(cond):
        return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    return w.groupBy("n_customers").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg(o).alias("abstain_mean"),
        F.avg(c).alias("topk_mean"), F.avg(r).alias("random_mean"),
        rate(o > c).alias("beats_topk"), rate(o > r).alias("beats_random"),
        rate(o > 0).alias("abstain_positive"), rate(o == 0).alias("abstain_ties"),
        rate(o >= 0).alias("abstain_not_worse"), rate(c > 0).alias("topk_positive"),
        F.avg(a).alias("treat_all_mean"), rate(a > 0).alias("treat_all_positive"),
        F.avg(f"{ours}_k").alias("abstain_treated"), F.avg(f"{comparator}_k")
        .alias("topk_treated"))


def compare(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Wins, ties and losses of `a` against `b`; the rate leaves ties out."""
    w = runs.groupBy("n_customers", "seed").pivot("policy", [a, b]).agg(F.first("value"))
    gap = F.col(a) - F.col(b)
    t = w.agg(F.count(F.when(gap > 0, 1)).alias("wins"), F.count(F.when(gap == 0, 1))
              .alias("ties"), F.count(F.when(gap < 0, 1)).alias("losses"),
              F.avg(gap).alias("mean_gap"))
    decided = F.col("wins") + F.col("losses")
    return t.select("*", decided.alias("decided"), F.try_divide(
        F.col("wins").cast("double"), decided.cast("double")).alias("rate"))


def compare_with_interval(runs: DataFrame, a: str, b: str) -> DataFrame:
    return with_interval(compare(runs, a, b), "wins", "decided")


def by_policy(runs: DataFrame) -> DataFrame:
    """Mean money, how often nobody is treated, how often it beats doing nothing."""
    return runs.groupBy("n_customers", "policy").agg(
        F.count(F.lit(1)).alias("draws"), F.avg("value").alias("mean_value"),
        F.avg("n_treated").alias("mean_treated"),
        F.avg((F.col("n_treated") == 0).cast("double")).alias("treats_nobody"),
        F.count(F.when(F.col("value") > 0, 1)).alias("beats")).withColumn(
        "beats_nothing", F.col("beats") / F.col("draws"))


def pending_cells(wanted: DataFrame, done: DataFrame, keys: Sequence[str] = ("n_customers", "seed")
                  ) -> DataFrame:
    """Cells of a sweep that have not been written yet."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")
