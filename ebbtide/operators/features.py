"""Point-in-time features: declarative specs compiled to one aggregate per source table.

A fact row is repeated only for the as-of moments at which it was already knowable. Where there is
more than one moment, rows travel to their customer before they are repeated, so each is shuffled
once; for a single moment they collapse in the map-side half of the aggregate. There is one shuffle
per source table whatever the number of specs, moments and gates, and no fact is ever joined row by row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_US, micros
from ..schema import TABLES, Dataset, TableDef

SAFE, OCCURRED_ONLY, NO_FILTER = MODES = "available_at", "occurred_at", "none"
Modes = str | Sequence[str]
KINDS = ("count", "sum", "mean", "max", "nunique", "recency_days", "age_days", "constant")


class LeakageError(RuntimeError):
    """A feature would have used a fact nobody could know yet."""


@dataclass(frozen=True)
class FeatureSpec:
    """What a feature counts, over which rows, and what it is when there are none."""

    name: str
    table: str
    kind: str
    column: str | None = None
    window_days: int | None = None
    where: dict[str, object] = field(default_factory=dict)
    fill: float = 0.0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown feature kind {self.kind!r}")

    def sources(self, table: TableDef) -> set[str]:
        used = {self.column, *self.where} - {None}
        return used | ({table.key} if self.kind == "constant" else set())

    def compile(self, table: TableDef) -> Column:
        """The aggregate over rows that carry `as_of` and have passed the visibility gate."""
        cond = F.lit(True)
        for col, value in self.where.items():
            cond = cond & (F.col(col) == F.lit(value))
        if self.window_days is not None and table.is_fact:
            cond = cond & (micros(table.occurred_at)
                           > micros("as_of") - self.window_days * DAY_US)
        clock = table.occurred_at
        if self.kind == "count":
            n = F.count(F.when(cond, 1))
            return F.when(n > 0, n.cast("double"))  # no matching row: the fill applies
        if self.kind in ("recency_days", "age_days"):
            seen = F.col(clock if self.kind == "recency_days" else self.column or clock)
            pick = F.max if self.kind == "recency_days" else F.min
            return (F.first("_as_of_us") - pick(F.when(cond, micros(seen)))) / float(DAY_US)
        x = F.when(cond, F.col(self.column))
        if self.kind == "nunique":
            # no matching row at all is NULL, so that the fill applies
            return F.when(F.count(F.when(cond, 1)) > 0, F.count_distinct(x).cast("double"))
        if self.kind == "sum":
            return F.when(F.count(F.when(cond, 1)) > 0,
                          F.coalesce(F.sum(x.cast("double")), F.lit(0.0)))
        if self.kind == "constant":
            when = F.struct(*[F.col(c) for c in (clock, table.key) if c])
            return F.max_by(x, F.when(x.isNotNull(), when)).cast("double")
        return {"mean": F.avg, "max": F.max}[self.kind](x.cast("double"))


def moments(as_ofs: Sequence[dt.datetime]) -> Column:
    return F.array(*[F.lit(a).cast("timestamp_ntz") for a in as_ofs])


def visible(df: DataFrame, table: TableDef, as_ofs: Sequence[dt.datetime], mode: Modes = SAFE,
            window_days: int | None = None, by: str | None = None) -> DataFrame:
    """F1-F2: each row once per as-of moment at which it may be seen. The only gate there is.

    Several modes give each row once per moment of each, named by the column `mode`. With `by`,
    rows that are seen at all meet by that column before they are repeated, in as many tasks as a
    shuffle has: fewer would fit the rows, but not what they become.
    """
    modes = (mode,) if isinstance(mode, str) else tuple(mode)
    for m in modes:
        if m not in MODES:
            raise ValueError(f"unknown mode {m!r}")

    def gate(m: str, a: Column) -> Column:
        if not table.is_fact:
            return F.col("created_at") <= a if "created_at" in df.columns else F.lit(True)
        ok = {SAFE: lambda: F.col(table.available_at) <= a,
              OCCURRED_ONLY: lambda: F.col(table.occurred_at) <= a,
              NO_FILTER: lambda: F.lit(True)}[m]()
        if window_days is not None:  # rows no spec looks back to are not repeated
            ok = ok & (micros(table.occurred_at) > micros(a) - window_days * DAY_US)
        return ok

    def seen(m: str) -> Column:
        return F.filter(moments(as_ofs), lambda a: gate(m, a))

    if by is not None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.filter(reduce(or_, [F.size(seen(m)) > 0 for m in modes])).repartition(tasks, by)
    if isinstance(mode, str):
        return df.withColumn("as_of", F.explode(seen(mode)))
    each = F.concat(*[F.transform(seen(m), _named(m)) for m in modes])
    return df.select("*", F.explode(each).alias("_seen")).select(*df.columns, "_seen.*")


def _named(mode: str) -> Callable[[Column], Column]:
    return lambda a: F.struct(F.lit(mode).alias("mode"), a.alias("as_of"))


def future_rows(ds: Dataset, table: TableDef, as_ofs: Sequence[dt.datetime],
                mode: str = SAFE) -> DataFrame:
    """Per moment, visible rows that were late and visible rows that lie ahead."""
    v = visible(ds.table(table.name), table, as_ofs, mode)
    return v.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n_visible"),
        F.count(F.when(F.col(table.available_at) > F.col("as_of"), 1)).alias("n_late"),
        F.count(F.when(F.col(table.occurred_at) > F.col("as_of"), 1)).alias("n_future")
    ).select(F.lit(table.name).alias("table"), "*")


def assert_no_future(ds: Dataset, tables: Sequence[str], as_ofs: Sequence[dt.datetime]) -> None:
    """refuse to build on rows that are marked knowable before they happen."""
    for name in tables:
        t = TABLES[name]
        if t.is_fact:
            n = future_rows(ds, t, as_ofs).agg(F.sum("n_future")).first()[0]
            if n:
                raise LeakageError(f"{name}: {n} visible rows occur after the as-of moment")


def table_features(df: DataFrame, table: TableDef, specs: Sequence[FeatureSpec],
                   as_ofs: Sequence[dt.datetime], mode: Modes = SAFE) -> DataFrame:
    """All features of one source table: one scan of the needed columns, one shuffle."""
    need = {"customer_id"}.union(*[s.sources(table) for s in specs])
    need |= {c for c in (table.occurred_at, table.available_at) if c}
    if not table.is_fact and "created_at" in df.columns:
        need.add("created_at")
    windows = [s.window_days for s in specs]
    widest = max(windows) if table.is_fact and all(w is not None for w in windows) else None
    once = isinstance(mode, str) and len(as_ofs) < 2
    rows = visible(df.select(*[c for c in df.columns if c in need]), table, as_ofs, mode, widest,
                   None if once else "customer_id")
    rows = rows.withColumn("_as_of_us", micros("as_of"))
    return rows.groupBy(*_keys(mode)).agg(
        *[s.compile(table).alias(s.name) for s in specs])


def _keys(mode: Modes) -> list[str]:
    return ["customer_id", "as_of"] if isinstance(mode, str) else ["customer_id", "as_of", "mode"]


def panel(ds: Dataset, spine: DataFrame, as_ofs: Sequence[dt.datetime],
          specs: Sequence[FeatureSpec], mode: Modes = SAFE, strict: bool = False) -> DataFrame:
    """One row per (customer_id, as_of) of `spine`, fills where nothing was seen.

    Several modes give one such panel each, told apart by the column `mode`.
    """
    if strict and mode == SAFE:
        assert_no_future(ds, sorted({s.table for s in specs}), as_ofs)
    by = _keys(mode)
    out = spine.select("customer_id", "as_of")
    if not isinstance(mode, str):
        out = out.select("*", F.explode(F.array(*[F.lit(m) for m in mode])).alias("mode"))
    for name in dict.fromkeys(s.table for s in specs):
        mine = [s for s in specs if s.table == name]
        # Estimates do not see rows repeated by moment and mode, and so would broadcast large sides.
        out = out.join(table_features(ds.table(name), TABLES[name], mine, as_ofs, mode).hint("merge"),
                       by, "left")
    return out.select(*by, *[
        F.coalesce(F.col(s.name), F.lit(float(s.fill))).alias(s.name) for s in specs])


def at_risk_spine(subs: DataFrame, as_ofs: Sequence[dt.datetime]) -> DataFrame:
    """Customers with a running subscription at each moment."""
    def running(a: Column) -> Column:
        return (F.col("started_at") <= a) & (F.col("ended_at").isNull()
                                             | (F.col("ended_at") > a))
    return subs.select("customer_id", F.explode(F.filter(moments(as_ofs), running))
                       .alias("as_of")).distinct()


def ratio(df: DataFrame, name: str, num: str, den: str, fill: float = 1.0) -> DataFrame:
    """F17."""
    return df.withColumn(name, F.when(F.col(den) > 0, F.col(num)
                                      / F.greatest(F.col(den), F.lit(1e-9))).otherwise(fill))


def standard_specs(session: str = "session_start") -> list[FeatureSpec]:
    """tenure, price, engagement, billing health, support and contact history."""
    # Names, windows, filters and fills of the standard features.
    return [
        FeatureSpec("tenure_days", "subscriptions", "age_days", "started_at"),
        FeatureSpec("mrr", "subscriptions", "max", "mrr"),
        FeatureSpec("sessions_30d", "events", "count", window_days=30, where={"name": session}),
        FeatureSpec("sessions_prev_30d", "events", "count", window_days=60, where={"name": session}),
        FeatureSpec("days_since_last_session", "events", "recency_days", window_days=365,
                    where={"name": session}, fill=365.0),
        FeatureSpec("distinct_features_30d", "events", "nunique", "name", window_days=30),
        FeatureSpec("payment_failures_90d", "invoices", "count", window_days=90,
                    where={"status": "failed"}),
        FeatureSpec("payment_failures_ltd", "invoices", "count", where={"status": "failed"}),
        FeatureSpec("days_since_last_failure", "invoices", "recency_days", where={"status": "failed"},
                    fill=999.0),
        FeatureSpec("amount_paid_180d", "invoices", "sum", "amount", window_days=180,
                    where={"status": "paid"}),
        FeatureSpec("tickets_90d", "tickets", "count", window_days=90),
        FeatureSpec("days_since_last_ticket", "tickets", "recency_days", fill=999.0),
        FeatureSpec("interventions_ltd", "interventions", "count", where={"arm": "treatment"}),
        FeatureSpec("days_since_last_intervention", "interventions", "recency_days", where={"arm": "treatment"},
                    fill=999.0),
    ]


def feature_names() -> list[str]:
    return [s.name for s in standard_specs()] + ["engagement_trend"]


def standard_panel(ds: Dataset, spine: DataFrame, as_ofs: Sequence[dt.datetime],
                   mode: Modes = SAFE) -> DataFrame:
    """the standard features and the recent-to-prior engagement trend."""
    p = panel(ds, spine, as_ofs, standard_specs(), mode)
    prior = F.greatest(F.col("sessions_prev_30d") - F.col("sessions_30d"), F.lit(0.0))
    return ratio(p.withColumn("_prior", prior), "engagement_trend", "sessions_30d",
                 "_prior").drop("_prior")
