"""Schema contract checks, as data: one row per rule with the number of offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FACTS, Dataset, SchemaError, TableDef


def missing_columns(df: DataFrame, table: TableDef) -> list[str]:
    """V1: declared columns the frame does not have."""
    return [c for c in table.columns if c not in df.columns]


def row_checks(table: TableDef) -> list[tuple[str, str, Column]]:
    """Rule, column and what breaks it: NULLs in required columns, and facts known before they
    happened."""
    checks = [("null", c, F.col(c).isNull()) for c in table.required]
    if table.is_fact:
        checks.append(("available_before_occurred", table.available_at,
                       F.col(table.available_at) < F.col(table.occurred_at)))
    return checks


def duplicate_keys(df: DataFrame, table: TableDef) -> DataFrame:
    """V2: rows beyond the first for each key."""
    return (df.groupBy(table.key).count().filter("count > 1")
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n"))
            .select(F.lit(table.name).alias("table"), F.lit("duplicate_key").alias("rule"),
                    F.lit(table.key).alias("column"), "n"))


def row_rules(df: DataFrame, table: TableDef) -> DataFrame:
    """V3 and V4 in one pass: NULLs in required columns, and facts known before they happened."""
    checks = row_checks(table)
    counts = df.agg(*[F.count(F.when(cond, 1)).alias(f"n{i}")
                      for i, (_, _, cond) in enumerate(checks)])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(table.name).alias("table"), F.lit(rule).alias("rule"),
                 F.lit(col).alias("column"), F.col(f"n{i}").alias("n"))
        for i, (rule, col, _) in enumerate(checks)])).alias("r")).select("r.*")


def orphans(df: DataFrame, customers: DataFrame, table: TableDef) -> DataFrame:
    """V5: fact rows of unknown customers. Facts shrink to one row per customer first."""
    per = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("c"))
    return (per.join(customers.select("customer_id"), "customer_id", "left_anti")
            .agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"))
            .select(F.lit(table.name).alias("table"), F.lit("unknown_customer").alias("rule"),
                    F.lit("customer_id").alias("column"), "n"))


def _claims(df: DataFrame, table: TableDef, first: int) -> DataFrame:
    """What each row says: (about, k, fact). `about` is a table's key, a customer, or a broken rule, of
    which the first has the number `first`; broken rules have no k and fall together at once."""
    fact = F.lit(table.name if table.is_fact else None).cast("string")
    says = lambda about, k, f=F.lit(None).cast("string"): F.struct(
        F.lit(about).alias("about"), k.cast("string").alias("k"), f.alias("fact"))
    always = [says(f"key {table.name}", F.col(table.key))]
    if table.is_fact:
        always.append(says("customer", F.col("customer_id"), fact))
    elif table.name == "customers":
        always.append(says("customer", F.col("customer_id")))
    broken = F.array(*[F.when(cond, says(f"rule {first + i}", F.lit(None)))
                       for i, (_, _, cond) in enumerate(row_checks(table))])
    return df.select(F.explode(F.concat(F.array(*always), F.filter(broken, lambda x: x.isNotNull()))).alias("s")
                     ).select("s.*")


def violations(ds: Dataset) -> DataFrame:
    """V2 to V5: all rules over all tables, one row each.

    Every table is read once. Its rows become claims about a key, a customer or a broken rule; claims
    are counted by what they are about, which one shuffle does for all tables, and the counts of these
    groups are summed by rule: a key beyond its first row, a customer that facts name and no customer
    row does, a broken rule.
    """
    claims, rules = [], []  # rules: table, rule, column, how its groups add up
    of = lambda about: F.col("about") == about
    for table, df in ds:
        gone = missing_columns(df, table)
        if gone:
            raise SchemaError(f"{table.name}: missing columns {gone}")
        claims.append(_claims(df, table, len(rules)))
        rules += [(table.name, rule, col, F.when(of(f"rule {len(rules) + i}"), F.col("n")))
                  for i, (rule, col, _) in enumerate(row_checks(table))]
        rules.append((table.name, "duplicate_key", table.key, F.when(of(f"key {table.name}"), F.col("n") - 1)))
    facts = [t.name for t in FACTS]
    groups = reduce(DataFrame.unionByName, claims).groupBy("about", "k").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("fact").isNull() & F.col("k").isNotNull()).alias("known"),
        *[F.count(F.when(F.col("fact") == f, 1)).alias(f"in_{f}") for f in facts])
    rules += [(f, "unknown_customer", "customer_id", F.when(of("customer") & ~F.col("known"), F.col(f"in_{f}")))
              for f in facts]
    sums = groups.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"n{i}")
                        for i, (*_, n) in enumerate(rules)])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.lit(col).alias("column"),
                 F.col(f"n{i}").alias("n"))
        for i, (table, rule, col, _) in enumerate(rules)])).alias("r")).select("r.*")


def validate(ds: Dataset) -> Dataset:
    """V6: raise on the first broken rule; collects only broken rules."""
    bad = violations(ds).filter("n > 0").orderBy("table", "rule").limit(1).collect()
    if bad:
        r = bad[0]
        raise SchemaError(f"{r['table']}: {r['n']} rows break {r['rule']} on '{r['column']}'")
    return ds
