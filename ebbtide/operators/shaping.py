"""Trials, tenure tables and panels brought into the shapes the models read."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import MONTH_DAYS, half_even, uniform
from . import order

EVENTS = 1 << 16  # events that a task holds at once


# --- trials ----------------------------------------------------------------------

def two_arms(df: DataFrame, arm: str, treated: str, control: str) -> DataFrame:
    """Keep one offer and the untouched arm, with a 0/1 treatment flag."""
    return (df.filter(F.col(arm).isin(treated, control))
            .withColumn("t", (F.col(arm) == treated).cast("int")))


def indicators(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> list[Column]:
    """0/1 columns for the given levels of the given columns."""
    return [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}".lower())
            for c, values in levels.items() for v in values]


def encode(df: DataFrame, keep: Sequence[str], columns: Sequence[str],
           max_levels: int = 12, max_features: int = 60) -> DataFrame:
    """Numeric columns pass, small categoricals become ordinals, wide text is dropped.

    One aggregate decides which columns are small; the levels of those (at most
    `max_levels` each) become literals, so no join and no second shuffle follows.
    """
    kinds = dict(df.dtypes)
    text = [c for c in columns if kinds[c] == "string"]
    levels: dict[str, list[str]] = {}
    if text:
        width = df.agg(*[F.count_distinct(c).alias(c) for c in text]).first()
        small = [c for c in text if width[c] <= max_levels]
        if small:
            row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in small]).first()
            levels = {c: list(row[c]) for c in small}
    out = []
    for c in columns:
        if c in levels:
            code = F.array_position(F.array(*[F.lit(v) for v in levels[c]]), F.col(c)) - 1
            out.append(F.coalesce(code, F.lit(-1)).cast("double").alias(c))
        elif kinds[c] != "string":
            x = F.col(c).cast("double")
            out.append(F.coalesce(F.nanvl(x, F.lit(None)), F.lit(0.0)).alias(c))
    x = df.select(*keep, *out)
    names = [c for c in x.columns if c not in keep]
    if len(names) > max_features:
        spread = x.agg(*[F.var_samp(c).alias(c) for c in names]).first()
        names = sorted(names, key=lambda c: (-(spread[c] or 0.0), c))[:max_features]
    return x.select(*keep, *names)


def representative(df: DataFrame, published: Mapping[str, float], tol: float = 0.20,
                   treatment: str = "t") -> DataFrame:
    """Observed rates against published ones; a one-armed sample always fails."""
    a = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in published])
    rows = [F.struct(F.lit(c).alias("rate"), F.col(c).alias("observed"),
                     F.lit(v).alias("published"),
                     ((F.abs(F.col(c) - v) <= tol * v)
                      & ~(F.lit(c == treatment) & F.col(c).isin(0.0, 1.0))).alias("passed"))
            for c, v in published.items()]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly `n` rows in the order of a seeded hash of their key; never a prefix."""
    return order.top_k(df.withColumn("_h", uniform(f"rows-{seed}-", key)), [F.col("_h"), F.col(key)], n).filter(
        "selected").drop("_h", "selected")


def arm_sample(df: DataFrame, key: str, n: int, seed: int = 0, arm: str = "t") -> DataFrame:
    """`n` rows with the treated share kept: each arm gives round(n * its share), or what it has.

    A table of fewer than `n` rows comes back whole; who must not take it for `n` counts it first.
    """
    r = order.ranked(df.withColumn("_u", uniform(f"subsample-{seed}-", key)),
                     [F.col("_u"), F.col(key)], [arm], "_r")
    total = df.agg(F.count(F.lit(1))).scalar()
    return (order.with_size(r, df, [arm])
            .filter(F.col("_r") <= half_even(n * F.col("_n") / total))
            .select(*df.columns))


def arm_split(df: DataFrame, key: str, test: float = 0.5, seed: int = 0, arm: str = "t",
              flag: str = "is_test") -> DataFrame:
    """Both halves keep each arm's exact share."""
    r = order.ranked(df.withColumn("_u", uniform(f"split-{seed}-", key)),
                     [F.col("_u"), F.col(key)], [arm], "_r")
    return (order.with_size(r, df, [arm])
            .withColumn(flag, F.col("_r") <= half_even(test * F.col("_n")))
            .select(*df.columns, flag))


def unit_split(df: DataFrame, unit: str, test: float = 0.3, seed: int = 0,
               flag: str = "is_test") -> DataFrame:
    """All rows of a subject land on the same side. Needs no shuffle."""
    return df.withColumn(flag, uniform(f"unit-{seed}-", unit) < test)


def trial_summary(df: DataFrame, t: str = "t", y: str = "y") -> DataFrame:
    """N19."""
    yt = F.avg(F.when(F.col(t) == 1, F.col(y).cast("double")))
    yc = F.avg(F.when(F.col(t) == 0, F.col(y).cast("double")))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("n_treated"),
                  F.avg(F.col(t).cast("double")).alias("treated_share"),
                  yt.alias("treated_mean"), yc.alias("control_mean")).select(
        "*", (F.col("treated_mean") - F.col("control_mean")).alias("ate"),
        (F.try_divide("treated_mean", "control_mean") - 1).alias("lift"))


# --- survival data and panels ------------------------------------------------------

def tenure_table(df: DataFrame, tenure: str, churned: Column, covariates: Sequence[Column],
                 unit: str) -> DataFrame:
    """Whole months of tenure as duration; customers without a full period are dropped."""
    return df.filter(F.col(tenure) >= 1).select(
        unit, F.col(tenure).cast("int").alias("duration"), churned.cast("int").alias("event"),
        *covariates)


def discretise(days: Column, days_per_period: float = MONTH_DAYS) -> Column:
    """N10."""
    return F.greatest(F.lit(1), F.ceil(days / days_per_period)).cast("int")


def panel_survival(panel: DataFrame, covariates: Sequence[str], unit: str = "unit") -> DataFrame:
    """Months at risk, cause in the last month, covariates of the first month."""
    month = F.col("month")
    last = F.max_by(F.when(F.col("churn_voluntary") == 1, 1)
                    .when(F.col("churn_involuntary") == 1, 2).otherwise(0), month)
    return panel.groupBy(unit).agg(
        F.count(F.lit(1)).cast("int").alias("duration"), last.alias("event"),
        F.min_by(F.struct(*covariates), month).alias("_x")).select(
        unit, "duration", "event", *[F.col(f"_x.{c}") for c in covariates])


def moving_person_period(panel: DataFrame, covariates: Sequence[str], cause: int = 1,
                         unit: str = "unit") -> DataFrame:
    """One row per month at risk with that month's covariates."""
    flag = "churn_voluntary" if cause == 1 else "churn_involuntary"
    return panel.select(unit, (F.col("month") + 1).alias("period"), *covariates,
                        F.col(flag).cast("int").alias("event"))


def increments(panel: DataFrame, counter: str, unit: str = "unit",
               flag: str = "failed") -> DataFrame:
    """A rise of a cumulative counter; the first month counts from zero."""
    w = Window.partitionBy(unit).orderBy("month")
    return panel.withColumn(flag, F.col(counter) - F.lag(counter, 1, 0).over(w) > 0)


def expand_counts(panel: DataFrame, count: str, start: Column, prefix: str,
                  unit: str = "unit", nested: bool = False) -> DataFrame:
    """N in a month becomes n timestamped rows with a short upload delay.

    With `nested` the rows of a month stay together, as the array `events` of one row per unit and
    month: what is asked per unit can then be reduced within the month before anything is ordered.
    """
    def moments(key: Column) -> Column:
        second = F.floor(uniform("at-", key) * (MONTH_DAYS * 86400)).cast("bigint")
        delay = F.floor(F.lit(864) + uniform("up-", key) * 20736).cast("bigint")
        return F.struct(key.alias("event_id"), (F.col("_start") + second).alias("at"), delay.alias("delay"))

    def row(e: Column) -> Column:
        return F.struct(
            e["event_id"].alias("event_id"), F.col(unit).alias("customer_id"), F.lit("session_start").alias("name"),
            F.timestamp_seconds(e["at"]).cast("timestamp_ntz").alias("occurred_at"),
            F.timestamp_seconds(e["at"] + e["delay"]).cast("timestamp_ntz").alias("available_at"))

    some = panel.filter(F.col(count) > 0).withColumn("_start", F.unix_seconds(start.cast("timestamp")))
    if not nested:
        key = F.concat(F.lit(prefix), F.col(unit), F.lit("_"), "month", F.lit("_"), "i")
        return (some.select(unit, "month", "_start", F.explode(F.sequence(F.lit(1), F.col(count))).alias("i"))
                .select(unit, moments(key).alias("_e")).select(row(F.col("_e")).alias("_r")).select("_r.*"))
    months = some.select(
        F.col(unit).alias("customer_id"), "month", "_start", F.col(count).cast("long").alias("_n"),
        F.concat(F.lit(prefix), F.col(unit), F.lit("_"), "month", F.lit("_")).alias("_key"))
    event = (f"struct<event_id: string, customer_id: {months.schema['customer_id'].dataType.simpleString()}, "
             "name: string, occurred_at: timestamp_ntz, available_at: timestamp_ntz>")
    return months.mapInArrow(_month_events, (
        f"customer_id {months.schema['customer_id'].dataType.simpleString()}, "
        f"month {months.schema['month'].dataType.simpleString()}, events array<{event}>"))


def _month_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of each month as one array, by the rule of `expand_counts`; a lambda of Spark is
    interpreted for every event, at three times the price."""
    def share(salt: bytes, keys: list[bytes]) -> np.ndarray:
        high = b"".join([sha256(salt + k).digest()[:8] for k in keys])
        return np.frombuffer(high, ">u8").astype(np.float64) / 2.0 ** 64

    for whole in batches:
        upto = np.cumsum(whole.column("_n").to_numpy())
        lo = 0
        while lo < whole.num_rows:
            before = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + EVENTS, "right")))
            batch, lo = whole.slice(lo, hi - lo), hi
            many = batch.column("_n").to_numpy()
            to = np.cumsum(np.append(0, many)).astype(np.int32)
            known = np.repeat(batch.column("_key").is_valid().to_numpy(zero_copy_only=False), many)
            numbers = [b"%d" % i for i in range(1, int(many.max()) + 1)]
            keys = [k + i for k, n in zip(batch.column("_key").cast(pa.binary()).to_pylist(), many.tolist(), strict=True)
                    for i in (numbers[:n] if k is not None else ())]
            at = np.repeat(batch.column("_start").fill_null(0).to_numpy(), many)
            delay = np.zeros(len(at), np.int64)
            at[known] += np.floor(share(b"at-", keys) * (MONTH_DAYS * 86400)).astype(np.int64)
            delay[known] = np.floor(864 + share(b"up-", keys) * 20736).astype(np.int64)
            ids = np.full(len(at), -1, np.int64)
            ids[known] = np.arange(len(keys))
            untimed = ~known | np.repeat(batch.column("_start").is_null().to_numpy(zero_copy_only=False), many)
            moment = lambda x: pa.array(x * 1_000_000, pa.timestamp("us"), mask=untimed)  # noqa: B023, E731
            events = pa.StructArray.from_arrays([
                pa.array(keys, pa.binary()).cast(pa.string()).take(pa.array(ids, mask=~known)),
                batch.column("customer_id").take(pa.array(np.repeat(np.arange(len(many)), many))),
                pa.repeat("session_start", len(at)), moment(at), moment(at + delay)],
                ["event_id", "customer_id", "name", "occurred_at", "available_at"])
            yield pa.RecordBatch.from_arrays([
                batch.column("customer_id"), batch.column("month"), pa.ListArray.from_arrays(pa.array(to), events)],
                ["customer_id", "month", "events"])


def with_retries(attempts: DataFrame, recovered: Column, delay_days: Column) -> DataFrame:
    """A recovered failure also has the paid retry that recovered it."""
    at = F.timestamp_seconds(F.unix_seconds(F.col("attempted_at").cast("timestamp"))
                             + (delay_days * 86400).cast("bigint")).cast("timestamp_ntz")
    retry = (attempts.filter(recovered)
             .withColumn("invoice_id", F.concat(F.lit("rty_"), "invoice_id"))
             .withColumn("attempted_at", at).withColumn("status", F.lit("paid"))
             .withColumn("attempt_number", F.lit(2)))
    return attempts.withColumn("attempt_number", F.lit(1)).unionByName(retry)


def at_risk(panel: DataFrame, month: int) -> DataFrame:
    """The rows of one month, that is the population still at risk then."""
    return panel.filter(F.col("month") == month)


def month_start(month: Column, anchor: str) -> Column:
    """Calendar position of a month index."""
    base = F.unix_seconds(F.lit(anchor).cast("timestamp"))
    return F.timestamp_seconds(
        base + F.round(month * (MONTH_DAYS * 86400)).cast("bigint")).cast("timestamp_ntz")


def horizon_label(spine: DataFrame, exits: DataFrame, horizon: int, cause: int = 1,
                  unit: str = "unit") -> DataFrame:
    """Did the unit leave for `cause` in (month, month + horizon]? One exit per unit."""
    e = exits.select(unit, F.col("exit_month").alias("_m"), F.col("event").alias("_e"))
    hit = ((F.col("_e") == cause) & (F.col("_m") > F.col("month"))
           & (F.col("_m") <= F.col("month") + horizon))
    return spine.join(e, unit, "left").select(
        *spine.columns, F.coalesce(hit, F.lit(False)).cast("int").alias("label"))


def rescale_to_median(subs: DataFrame, invoices: DataFrame, target: float
                      ) -> tuple[DataFrame, DataFrame]:
    """Multiply every amount so that the median price equals `target`."""
    median = order.quantiles(subs, "mrr", {"m": 0.5}).first()["m"]
    if not median or median <= 0:
        return subs, invoices
    k = target / median
    return (subs.withColumn("mrr", F.col("mrr") * k),
            invoices.withColumn("amount", F.col("amount") * k))
