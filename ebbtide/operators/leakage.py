"""Does a feature know something it could not have known? Audits over panels and labels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..schema import TABLES, Dataset
from . import features as ft
from .churn import union_all
from .models import logistic
from .order import average_ranks

SUSPICIOUS = 0.85


def audit_availability(ds: Dataset, specs: Sequence[ft.FeatureSpec],
                       as_ofs: Sequence[dt.datetime], mode: str = ft.SAFE) -> DataFrame:
    """L1: for each fact table the specs read, visible rows that were late or in the future."""
    return union_all([ft.future_rows(ds, TABLES[n], as_ofs, mode)
                      for n in sorted({s.table for s in specs}) if TABLES[n].is_fact])


def audit_time_travel(before: DataFrame, after: DataFrame, names: Sequence[str]) -> DataFrame:
    """L2: values of the same (customer, as_of) that changed when later data was added."""
    b = after.select("customer_id", "as_of", *[F.col(n).alias(f"_{n}") for n in names])
    j = before.join(b, ["customer_id", "as_of"])

    def moved(n: str) -> Column:
        x, y = F.col(n), F.col(f"_{n}")
        near = F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)
        return ~((x.isNull() & y.isNull()) | F.coalesce(near, F.lit(False)))

    counts = j.agg(*[F.count(F.when(moved(n), 1)).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("changed")) for n in names]))
        .alias("r")).select("r.*")


def long_form(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Features as (feature, x) rows."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x"))
        for n in names])).alias("r")).select(*keep, "r.*")


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve from average ranks; NULL with a single class."""
    cells = average_ranks(df, score, by, {"_pos": F.col(label).cast("long")})
    a = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("_pos").alias("n_pos"), F.count(F.lit(1)).alias("n_values"),
        F.sum(F.col("avg_rank") * F.col("_pos")).alias("_r"))
    pos, neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    value = F.try_divide(F.col("_r") - pos * (pos + 1) / 2.0, (pos * neg).cast("double"))
    return a.select(*by, "n", "n_pos", "n_values", value.alias("auc"))


def single_feature_auc(panel: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """AUC of every feature on its own, in one job; NULL when it never varies or has gaps."""
    rows = long_form(panel, names, [label])
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))
    gaps = rows.groupBy("feature").agg(F.count(F.when(bad, 1)).alias("_bad"))
    a = auc(rows.filter(~bad), "x", label, ["feature"]).join(gaps, "feature")
    usable = (F.col("_bad") == 0) & (F.col("n_values") > 1)
    return a.select("feature", F.when(usable, F.greatest("auc", 1 - F.col("auc"))).alias("auc"))


def suspicious(panel: DataFrame, names: Sequence[str], label: str,
               threshold: float = SUSPICIOUS) -> DataFrame:
    """L3: features that predict the outcome implausibly well alone, in either direction."""
    return single_feature_auc(panel, names, label).filter(F.col("auc") >= threshold)


def inject_canary(panel: DataFrame, label: str, key: Column, strength: float = 0.9,
                  seed: int = 0, name: str = "canary_leaked_outcome") -> DataFrame:
    """L4: plant the outcome with a share of flips and a little noise, to test the detector."""
    flip = uniform(f"flip-{seed}-", key) > strength
    y = F.col(label).cast("double")
    noise = (uniform(f"noise-{seed}-", key) - 0.5) * 0.03
    return panel.withColumn(name, F.when(flip, 1.0 - y).otherwise(y) + noise)


def model_auc(panel: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """AUC of a standardised logistic model on the given features."""
    clean = panel.select(label, *[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)),
                                             F.lit(0.0)).alias(n) for n in names])
    return auc(logistic(clean, names, label).score(clean, "_p"), "_p", label)


def report(availability: DataFrame, travel: DataFrame, screen: DataFrame,
           checks: int) -> DataFrame:
    """One row - did every audit pass, and how many findings of each kind."""
    late = availability.agg(F.coalesce(F.sum(F.col("n_late") + F.col("n_future")), F.lit(0))
                            ).scalar()
    moved = travel.agg(F.coalesce(F.sum("changed"), F.lit(0))).scalar()
    row = screen.agg(F.count(F.lit(1)).alias("suspicious")).select(
        F.lit(checks).alias("checks_run"), late.alias("rows_ahead"), moved.alias("values_moved"),
        "suspicious")
    return row.withColumn("passed", (F.col("rows_ahead") == 0) & (F.col("values_moved") == 0)
                          & (F.col("suspicious") == 0))
