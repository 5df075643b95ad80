"""The churn diagnostic: recovery, rates in money, retention, ranked findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DAY_US, MONTH_DAYS, days_between, whole_days
from ..functions.curves import from_here, running_product, up_to
from ..functions.money import label
from ..schema import Dataset
from ..session import cut
from .dunning import CODES, next_step_of
from .interval import exists_within
from .preflight import resolve_currency

RECOVERY_DAYS = 30
INVOLUNTARY_DAYS = (-1, 45)
MATERIAL_SHARE = 0.15
BENCHMARK = (0.55, 0.70)


def failures(invoices: DataFrame, days: int = RECOVERY_DAYS) -> DataFrame:
    """A5: failed invoices with `recovered` = the customer paid within (0, days] after."""
    failed = invoices.filter(F.col("status") == "failed")
    paid = invoices.filter(F.col("status") == "paid").select("customer_id", "attempted_at")
    return exists_within(failed, paid, "customer_id", "attempted_at", "attempted_at",
                         1, days * DAY_US, "recovered")


def written_failures(invoices: DataFrame) -> DataFrame:
    """A5 written once, for analyses that read it several times."""
    return cut(failures(invoices).select("customer_id", "attempted_at", "amount",
                                         "failure_code", "recovered"))


def decline_mix(failed: DataFrame) -> DataFrame:
    """Failures by reason; empty when no failure carries a code."""
    mix = failed.groupBy(F.coalesce("failure_code", F.lit("unknown")).alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"),
        F.avg(F.col("recovered").cast("double")).alias("recovery_rate"),
        F.count("failure_code").alias("_coded"))
    # One row per reason from here on, so looking at all of them costs nothing.
    every = F.sum("_coded").over(Window.partitionBy(F.lit(0)))
    return mix.withColumn("_any", every).filter("_any > 0").drop("_coded", "_any")


def payments(failed: DataFrame) -> DataFrame:
    """Amounts failed and recovered; the rate is NULL when nothing failed."""
    return failed.agg(
        F.count(F.lit(1)).alias("n_failures"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("failed_amount"),
        F.coalesce(F.sum(F.when(F.col("recovered"), F.col("amount"))), F.lit(0.0))
        .alias("recovered_amount")).withColumn(
        "recovery_rate", F.try_divide("recovered_amount", F.nullif("failed_amount", F.lit(0.0))))


def involuntary(subs: DataFrame, failed: DataFrame) -> DataFrame:
    """Ended subscriptions flagged when the end lies -1..45 days after an open failure."""
    low, high = INVOLUNTARY_DAYS
    return exists_within(
        subs.filter(F.col("ended_at").isNotNull()),
        failed.filter(~F.col("recovered")).select("customer_id", "attempted_at"),
        "customer_id", "ended_at", "attempted_at", -high * DAY_US, -low * DAY_US,
        "after_failure")


def book(subs: DataFrame) -> DataFrame:
    """A1-A4: window, active book, logo and revenue churn, in one aggregate."""
    gone = F.col("ended_at").isNotNull()
    base = subs.agg(
        F.count(F.lit(1)).alias("n_subscriptions"), F.count(F.when(~gone, 1)).alias("n_active"),
        F.count(F.when(gone, 1)).alias("n_churned"),
        F.coalesce(F.sum(F.when(~gone, F.col("mrr"))), F.lit(0.0)).alias("mrr_active"),
        F.coalesce(F.sum(F.when(gone, F.col("mrr"))), F.lit(0.0)).alias("mrr_lost"),
        F.sum("mrr").alias("mrr_total"),
        F.min("started_at").alias("_first"),
        F.greatest(F.max("started_at"), F.max("ended_at")).alias("_last"))
    days = whole_days("_first", "_last").cast("double")
    months = F.greatest(F.col("window_days") / MONTH_DAYS, F.lit(1.0))
    return (base.withColumn("window_days", F.when(days == 0, 1.0).otherwise(days))
            .withColumn("monthly_logo_churn",
                        F.col("n_churned") / F.col("n_subscriptions") / months)
            .withColumn("monthly_revenue_churn", F.coalesce(
                F.try_divide("mrr_lost", "mrr_total") / months, F.lit(0.0)))
            .withColumn("arr_active", F.col("mrr_active") * 12)
            .drop("_first", "_last"))


def retention_curve(subs: DataFrame, max_months: int = 24) -> DataFrame:
    """Pooled-tenure retention by month; the data shrinks to a histogram first."""
    seen = subs.agg(F.greatest(F.max("started_at"), F.max("ended_at"))).scalar()
    month = F.floor(days_between("started_at", F.coalesce("ended_at", seen)) / MONTH_DAYS)
    hist = (subs.select(F.least(month, F.lit(max_months + 1)).cast("int").alias("month"),
                        F.col("ended_at").isNotNull().cast("int").alias("gone"))
            .filter("month >= 0").groupBy("month")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("gone").alias("churned")))
    # At most max_months + 2 rows from here on.
    grid = hist.sparkSession.range(max_months + 2).select(F.col("id").cast("int").alias("month"))
    c = grid.join(hist, "month", "left").fillna(0, ["n", "churned"])
    c = c.withColumn("at_risk", F.sum("n").over(from_here([], "month")))
    factor = F.when(F.col("month") == 0, 1.0).otherwise(
        1.0 - F.col("churned") / F.greatest(F.col("at_risk"), F.lit(1)))
    return (c.withColumn("retention", running_product(factor, up_to([], "month")))
            .filter((F.col("month") <= max_months) & (F.col("at_risk") > 0))
            .select("month", "at_risk", "churned", "retention"))


def annualise(amount: Column, days: Column) -> Column:
    """A12."""
    return F.when(days <= 0, amount).otherwise(amount * 365.0 / days)


def metrics(ds: Dataset, failed: DataFrame | None = None) -> DataFrame:
    """A1-A12 as one row. What was not measured is NULL, never 0."""
    failed = written_failures(ds.invoices) if failed is None else failed
    gone = involuntary(ds.subscriptions, failed)
    supplied = ds.invoices.select("invoice_id").limit(1).agg(F.count(F.lit(1))).scalar()
    pay = payments(failed).select(F.struct("*")).scalar()
    inv = gone.filter("after_failure").agg(F.countDistinct("customer_id")).scalar()
    cur = resolve_currency(ds.stated_currencies(), ds.declared).select("currency").scalar()
    n_cust = ds.customers.agg(F.count(F.lit(1))).scalar()
    m = book(ds.subscriptions).select(
        "*", n_cust.alias("n_customers"), (supplied > 0).alias("invoices_supplied"),
        pay.alias("_p"), inv.alias("_i"), cur.alias("currency"))
    m = m.select("*", "_p.*", F.when(F.col("invoices_supplied"), F.col("_i"))
                 .alias("n_involuntary")).drop("_p", "_i")
    return (m.withColumn("involuntary_share", F.try_divide(
                F.col("n_involuntary"), F.nullif("n_churned", F.lit(0))))
            .withColumn("annual_churn_cost",
                        F.col("mrr_active") * F.col("monthly_revenue_churn") * 12))


def findings(m: DataFrame, mix: DataFrame) -> DataFrame:
    """Up to four conclusions with money attached, largest first."""
    top = mix.select(F.max_by(F.struct("code", "amount", "recovery_rate"),
                              F.struct("amount", "code"))).scalar()
    m = m.withColumn("_top", top)
    days, low = F.col("window_days"), BENCHMARK[0]
    failed = annualise(F.col("failed_amount"), days)
    rate = F.col("recovery_rate")

    def one(code, subject, money, measured, when):
        return F.when(when, F.struct(F.lit(code).alias("finding"), subject.alias("subject"),
                                     money.alias("annual_value"),
                                     F.lit(measured).alias("measured")))

    none = F.lit(None).cast("string")
    has = (F.col("n_failures") > 0) & rate.isNotNull()
    rows = [
        one("recovery_gap", none, failed * (low - rate), False, has & (rate < low)),
        one("recovery_strong", none, failed * (1 - rate), True, has & (rate >= low)),
        one("involuntary_share", none, F.col("annual_churn_cost") * F.col("involuntary_share"),
            True, F.col("involuntary_share") > MATERIAL_SHARE),
        one("top_decline_code", F.col("_top.code"),
            annualise(F.col("_top.amount"), days) * (1 - F.col("_top.recovery_rate")),
            True, F.col("_top.code").isNotNull()),
        one("annual_churn_cost", none, F.col("annual_churn_cost"), True, F.lit(True)),
    ]
    return (m.select("currency", F.explode(F.array_compact(F.array(*rows))).alias("f"))
            .select("f.*", label(F.col("f.annual_value"), F.col("currency")).alias("label"))
            .orderBy(F.desc("annual_value")))


def where_to_start() -> Column:
    """Which kind of first step the measured state supports."""
    share = F.col("involuntary_share")
    return (F.when(~F.col("invoices_supplied"), "send_invoices")
            .when(share.isNull(), "no_departures")
            .when(share > MATERIAL_SHARE, "fix_billing").otherwise("causal_retention"))


def tiles(m: DataFrame) -> DataFrame:
    """Percentages only where something was measured."""
    def pct(x):
        return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))
    return m.select(
        F.when(~F.col("invoices_supplied"), "not measured")
        .when(F.col("recovery_rate").isNull(), "none failed")
        .otherwise(pct(F.col("recovery_rate"))).alias("recovery"),
        F.when(~F.col("invoices_supplied"), "not measured")
        .when(F.col("involuntary_share").isNull(), "no departures")
        .otherwise(pct(F.col("involuntary_share"))).alias("involuntary"),
        where_to_start().alias("start_with"))


def code_notes(mix: DataFrame) -> DataFrame:
    """Beside each decline reason what to do, and how far retrying can get."""
    best = F.lit(None).cast("double")
    for code, (_, ceiling, *_) in CODES.items():
        best = F.when(F.col("code") == code, ceiling).otherwise(best)
    return mix.select("*", next_step_of(F.col("code")).alias("action"),
                      best.alias("best_recovery"))


def caveats(ds: Dataset) -> DataFrame:
    """What could not be computed, one row each."""
    inv = ds.invoices.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "failed", 1)).alias("nf"),
        F.count(F.when(F.col("status") == "failed", F.col("failure_code"))).alias("nc"))
    cur = resolve_currency(ds.stated_currencies(), ds.declared).select(
        F.struct("n_stated", "currency")).scalar()
    d = inv.select("*", cur.alias("cur"))
    several = (F.col("cur.n_stated") > 1) & F.lit(ds.declared is None)
    rows = [
        F.when(F.col("n") == 0, F.lit("no_invoices")),
        F.when((F.col("n") > 0) & (F.col("nf") == 0), F.lit("no_failures")),
        F.when((F.col("nf") > 0) & (F.col("nc") == 0), F.lit("no_decline_codes")),
        F.when(several, F.lit("several_currencies"))
        .when(F.col("cur.currency").isNull(), F.lit("no_currency")),
    ]
    return d.select(F.explode(F.array_compact(F.array(*rows))).alias("caveat"))


# --- person-month indicators -----------------------------------------------------

# Published ranges the indicators are compared with.
TARGETS = {"monthly_voluntary_churn": (0.030, 0.070), "involuntary_share_of_churn": (0.20, 0.40),
           "month_24_retention": (0.22, 0.50), "early_late_hazard_ratio": (1.15, 3.00)}


def indicators(panel: DataFrame) -> DataFrame:
    """Monthly churn by cause, end retention, early over late hazard; one pass."""
    v, i, m = F.col("churn_voluntary"), F.col("churn_involuntary"), F.col("month")
    a = panel.agg(
        F.avg(v.cast("double")).alias("monthly_voluntary_churn"),
        F.avg(i.cast("double")).alias("monthly_involuntary_churn"),
        F.sum(v).alias("_v"), F.sum(i).alias("_i"), F.count(F.when(m == 0, 1)).alias("_n"),
        F.avg(F.when(m < 6, v.cast("double"))).alias("_e"),
        F.avg(F.when(m >= 12, v.cast("double"))).alias("_l"))
    return a.select(
        "monthly_voluntary_churn", "monthly_involuntary_churn",
        (F.col("_i") / F.greatest(F.col("_v") + F.col("_i"), F.lit(1)))
        .alias("involuntary_share_of_churn"),
        (1.0 - (F.col("_v") + F.col("_i")) / F.col("_n")).alias("month_24_retention"),
        F.try_divide("_e", F.nullif("_l", F.lit(0.0))).alias("early_late_hazard_ratio"))


def band_check(kpis: DataFrame, targets: dict[str, tuple[float, float]] = TARGETS) -> DataFrame:
    """Each indicator against its range."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value"),
                              F.lit(lo).alias("low"), F.lit(hi).alias("high"))
                     for k, (lo, hi) in targets.items()])
    return kpis.select(F.explode(rows).alias("r")).select(
        "r.*", F.coalesce(F.col("r.value").between(F.col("r.low"), F.col("r.high")),
                          F.lit(False)).alias("within"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
