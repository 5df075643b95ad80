"""Global order without a single-task window: ranks, running sums, exact quantiles, top-k.

A bare `Window.orderBy` sends every row to one task. Here the rows are range-partitioned on
(group, order, tie-break), written once so that the slices cannot move, and numbered inside each
slice; the totals of earlier slices - one row per slice and group - are added afterwards. A
value shared by a third of the rows is split as well, because the tie-break is part of the
range key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, lookup

_SLICE = "_slice"


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
          ) -> DataFrame:
    """Join on `keys` with NULL equal to NULL; the columns of `left`, then the others of `right`."""
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[F.col(c) for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [
        F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column],
            by: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running sums of `sums` in `order`, restarting for each `by` group.

    `order` must end in a unique tie-break for the result to be determined.
    """
    tmp = {name: f"_in_{i}" for i, name in enumerate(sums)}
    d = df.select("*", *[expr.alias(tmp[name]) for name, expr in sums.items()])
    ranged = cut(d.repartitionByRange(*[F.col(b) for b in by], *order)
                 .withColumn(_SLICE, F.spark_partition_id()))
    totals = ranged.groupBy(*by, _SLICE).agg(
        *[F.sum(tmp[n]).alias(f"_tot_{i}") for i, n in enumerate(sums)])
    # One row per slice and group, so this window is small whatever the data.
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy(_SLICE).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*by, _SLICE, *[
        F.coalesce(F.sum(f"_tot_{i}").over(before), F.lit(0)).alias(f"_off_{i}")
        for i in range(len(sums))])
    here = Window.partitionBy(*by, _SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    joined = match(ranged, lookup(offsets), [*by, _SLICE])
    return joined.select(*df.columns, *[
        (F.sum(tmp[n]).over(here) + F.col(f"_off_{i}")).alias(n)
        for i, n in enumerate(sums)])


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (),
           name: str = "rank") -> DataFrame:
    """1-based position of each row in `order`, as a long."""
    return running(df, order, {name: F.lit(1).cast("long")}, by)


def as_of(asks: DataFrame, facts: DataFrame, at: str, values: Mapping[str, Column], before: Column,
          by: Sequence[str] = ()) -> DataFrame:
    """Rows of `asks` with the `values` of the last row of `facts` at or before their `at`.

    Groups `by` are matched with NULL equal to NULL; `before` is the value where no fact is early
    enough or the time is NULL. `facts` has one row per group and time. Both sides are ordered as one
    by range and written once; a slice carries its last fact on, and what earlier slices of the group
    have seen last is added to the rows before a slice's own first fact. Neither side is broadcast, and
    no time or group has to fit into a task: rows of one time are dealt by a hash of their columns.
    """
    kind = {r.name: r.dataType for r in asks.schema}
    tie = F.xxhash64(*[c for c in asks.columns if "map<" not in kind[c].simpleString()])
    left = asks.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), tie.alias("_tie"),
                       F.struct(*asks.columns).alias("_row"), F.lit(None).alias("_fact"))
    right = facts.filter(F.col(at).isNotNull()).select(
        *by, F.col(at).cast(kind[at]).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"),
        F.lit(None).alias("_row"), F.struct(*[v.alias(k) for k, v in values.items()]).alias("_fact"))
    keys = [*[F.col(b) for b in by], F.col("_at"), F.col("_kind"), F.col("_tie")]  # NULL comes first
    rows = cut(left.unionByName(right).repartitionByRange(*keys).withColumn(_SLICE, F.spark_partition_id()))
    # One row per slice and group.
    last = rows.groupBy(*by, _SLICE).agg(F.max_by("_fact", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, _SLICE, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    here = Window.partitionBy(*by, _SLICE).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = match(rows.withColumn("_fact", F.last("_fact", ignorenulls=True).over(here)).filter("_kind = 1"),
                 carried, [*by, _SLICE], "left")
    fact = F.coalesce("_fact", F.when(F.col("_at").isNotNull(), F.col("_carried")))
    return seen.withColumn("_fact", fact).select(
        "_row.*", *[F.when(F.col("_fact").isNull(), before).otherwise(F.col(f"_fact.{k}")).alias(k) for k in values])


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (),
                  sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct (by, value): its count `n`, average rank and any extra sums.

    The rows are aggregated before they are ordered, so ties never reach a window.
    """
    sums = dict(sums or {})
    cells = df.groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])
    r = running(cells, [F.col(value)], {"_cum": F.col("n")}, by)
    return r.withColumn("avg_rank", F.col("_cum") - (F.col("n") - 1) / 2.0).drop("_cum")


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles; one row per `by` group."""
    return quantile_cells(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n")), value, probs, by)


def quantile_cells(cells: DataFrame, value: str, probs: Mapping[str, float],
                   by: Sequence[str] = ()) -> DataFrame:
    """As `quantiles`, from (by, value, n) cells that are already counted."""
    r = running(cells, [F.col(value)], {"_cum": F.col("n")}, by)
    group = [F.col(b) for b in by]
    size = cells.groupBy(*group).agg(F.sum("n").alias("_size"))
    r = match(r, lookup(size), list(by)) if by else r.withColumn("_size", size.scalar())
    picks = []
    for i, p in enumerate(probs.values()):
        pos = F.lit(p) * (F.col("_size") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("_cum") - F.col("n") <= at) & (at < F.col("_cum"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{tag}{i}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_f{i}"))
    got = r.groupBy(*group).agg(*picks)
    return got.select(*by, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name)
        for i, name in enumerate(probs)])


def group_sizes(df: DataFrame, by: Sequence[str], name: str = "_n") -> DataFrame:
    """Rows per group (one row in all without groups), ready to be joined."""
    if by:
        return lookup(df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)))
    return df.agg(F.count(F.lit(1)).alias(name))


def with_size(df: DataFrame, source: DataFrame, by: Sequence[str] = (),
              name: str = "_n") -> DataFrame:
    """Attach the number of `source` rows of each group."""
    size = group_sizes(source, by, name)
    return match(df, size, list(by)) if by else df.withColumn(name, size.scalar())


def top_k(df: DataFrame, order: Sequence[Column], k: Column | int,
          by: Sequence[str] = (), flag: str = "selected") -> DataFrame:
    """Flag the first `k` rows in `order`."""
    r = ranked(df, order, by, "_rank")
    limit = F.lit(k) if isinstance(k, int) else k
    return r.withColumn(flag, F.col("_rank") <= limit).drop("_rank")
