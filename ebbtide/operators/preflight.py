"""Is this export fit to report on? Each check is a row: (check, level, value)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MONTH_DAYS, whole_days
from ..functions.money import currency_code
from ..schema import Dataset
from .order import quantiles

HIGH_PRICE = 2_000.0
MIN_FOR_MODELLING = 250
LEVELS = ("ok", "warn", "block")


def _row(name: str, level: Column, value: Column) -> Column:
    return F.when(level.isNotNull(), F.struct(
        F.lit(name).alias("check"), level.alias("level"), value.cast("double").alias("value")))


def statistics(ds: Dataset) -> DataFrame:
    """P1-P10 inputs as one row. Two passes over subscriptions: aggregates, exact median."""
    s = ds.subscriptions
    old = F.expr("timestamp_ntz'1990-01-01'")
    median = quantiles(s.filter("mrr > 0"), "mrr", {"m": 0.5}).scalar()
    used = s.select("customer_id").distinct()
    coverage = (ds.customers.select("customer_id").distinct()
                .join(used.withColumn("_u", F.lit(1)), "customer_id", "left")
                .agg(F.struct(F.count(F.lit(1)).alias("n"),
                              F.count(F.when(F.col("_u").isNull(), 1)).alias("never"))).scalar())
    codes = ds.stated_currencies().agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.min("currency").alias("first"))).scalar()
    has_inv = ds.invoices.select("invoice_id").limit(1).agg(F.count(F.lit(1))).scalar()
    return s.agg(
        F.count(F.lit(1)).alias("n_subscriptions"),
        F.count(F.when(F.col("mrr") > 0, 1)).alias("n_priced"),
        F.bool_and(F.when(F.col("mrr") > 0, F.col("mrr") % 1 == 0)).alias("all_whole"),
        F.count(F.when(F.col("ended_at") < F.col("started_at"), 1)).alias("reversed"),
        (F.count(F.when(F.col("started_at") < old, 1))
         + F.count(F.when(F.col("ended_at") < old, 1))).alias("ancient"),
        F.max("started_at").alias("last_start"), F.min("started_at").alias("first_start"),
        F.count("ended_at").alias("n_ended"),
    ).select("*", median.alias("median_mrr"), coverage.alias("cover"), codes.alias("codes"),
             (has_inv > 0).alias("has_invoices"))


def checks(ds: Dataset, now: dt.datetime) -> DataFrame:
    """All checks, with `now` passed in so that a run can be repeated."""
    st = statistics(ds)
    tomorrow = F.lit(now + dt.timedelta(days=1)).cast("timestamp_ntz")
    future = ds.subscriptions.agg(
        F.count(F.when(F.col("started_at") > tomorrow, 1))).scalar()
    st = st.withColumn("future", future)
    span = whole_days("first_start", "last_start") / MONTH_DAYS
    ended = F.col("n_ended") / F.col("n_subscriptions")
    dated = F.col("first_start").isNotNull()
    high = F.col("median_mrr") > HIGH_PRICE
    declared = currency_code(F.lit(ds.declared))
    found = [
        _row("money_units", F.when(F.col("n_priced") == 0, "block")
             .when(high & F.col("all_whole"), "block").when(high, "warn").otherwise("ok"),
             F.col("median_mrr")),
        _row("currency", F.when(F.col("codes.n") > 1, "block")
             .when((F.col("codes.n") == 1) & (declared != F.col("codes.first")), "warn")
             .otherwise("ok"), F.col("codes.n")),
        _row("invoices_absent", F.when(~F.col("has_invoices"), "ok"), F.lit(0.0)),
        _row("date_order", F.when(F.col("reversed") > 0, "block"), F.col("reversed")),
        _row("date_parsing", F.when(dated & (F.col("ancient") > 0), "block"), F.col("ancient")),
        _row("future_dates", F.when(dated & (F.col("future") > 0), "warn"), F.col("future")),
        _row("history", F.when(dated & (span < 6), "block").when(dated & (span < 12), "warn"),
             span),
        _row("churn_signal", F.when(F.col("n_ended") == 0, "block")
             .when(ended > 0.9, "warn").otherwise("ok"), ended),
        _row("coverage", F.when(F.col("cover.never")
                                > 0.5 * F.greatest(F.col("cover.n"), F.lit(1)), "warn"),
             F.col("cover.never")),
        _row("sample_size", F.when(F.col("cover.n") < MIN_FOR_MODELLING, "warn"),
             F.col("cover.n")),
    ]
    return st.select(F.explode(F.array_compact(F.array(*found))).alias("r")).select("r.*")


def verdict(rows: DataFrame) -> DataFrame:
    """BLOCKED if anything blocks, CHECK if anything warns, else READY."""
    rank = F.max(F.when(F.col("level") == "block", 2).when(F.col("level") == "warn", 1)
                 .otherwise(0))
    return rows.agg(rank.alias("r"), F.count(F.lit(1)).alias("n_checks")).select(
        F.when(F.col("r") == 2, "BLOCKED").when(F.col("r") == 1, "CHECK")
        .otherwise("READY").alias("verdict"), "n_checks")


def summary(ds: Dataset, now: dt.datetime) -> DataFrame:
    """Counts and window beside the verdict."""
    v = verdict(checks(ds, now)).select(F.struct("verdict", "n_checks")).scalar()
    return statistics(ds).select(
        F.col("cover.n").alias("n_customers"), "n_subscriptions",
        F.coalesce(whole_days("first_start", "last_start") / MONTH_DAYS, F.lit(0.0))
        .alias("window_months"), v.alias("v")).select("*", "v.verdict", "v.n_checks").drop("v")


def resolve_currency(stated: DataFrame, declared: str | None = None) -> DataFrame:
    """The declared code, else the single stated one, else NULL."""
    only = F.when(F.min("currency") == F.max("currency"), F.min("currency"))
    out = stated.agg(F.countDistinct("currency").alias("n_stated"), only.alias("one"))
    code = F.coalesce(currency_code(F.lit(declared)), F.col("one")) if declared else F.col("one")
    return out.select("n_stated", code.alias("currency"))
