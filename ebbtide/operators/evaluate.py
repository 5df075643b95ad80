"""What a ranking would have achieved, read off a randomised trial.

Rows are (key, score, t, y) with t in {0, 1}; `by` separates models that are evaluated together.
Every curve comes from one set of running sums in score order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import half_even
from ..session import lookup
from .order import match, quantile_cells, running, with_size

GRID = 20  # budgets 0, 5%, ... 100%


def effect(n_t: Column, y_t: Column, n_c: Column, y_c: Column) -> Column:
    """Difference in means; NULL when an arm is empty."""
    return (F.try_divide(y_t.cast("double"), n_t.cast("double"))
            - F.try_divide(y_c.cast("double"), n_c.cast("double")))


def arm_sums(y: str = "y", t: str = "t", when: Column | None = None) -> dict[str, Column]:
    on = F.lit(True) if when is None else when
    treated, control = on & (F.col(t) == 1), on & (F.col(t) == 0)
    zero = F.lit(0.0)
    return {"n_t": F.when(treated, 1).otherwise(0).cast("long"),
            "n_c": F.when(control, 1).otherwise(0).cast("long"),
            "y_t": F.when(treated, F.col(y).cast("double")).otherwise(zero),
            "y_c": F.when(control, F.col(y).cast("double")).otherwise(zero)}


def uplift_of_set(df: DataFrame, selected: Column, by: Sequence[str] = (),
                  y: str = "y", t: str = "t") -> DataFrame:
    """Treated mean minus control mean inside the selected rows."""
    s = arm_sums(y, t, selected)
    a = df.groupBy(*by).agg(F.count(F.when(selected, 1)).alias("n_selected"),
                            *[F.sum(e).alias(k) for k, e in s.items()])
    return a.select(*by, "n_selected", effect(*[F.col(k) for k in ("n_t", "y_t", "n_c", "y_c")])
                    .alias("uplift"))


def in_score_order(df: DataFrame, score: str, key: str, by: Sequence[str] = (),
                   extra: dict[str, Column] | None = None, **cols: str) -> DataFrame:
    """Running arm sums from the highest score down; ties in key order."""
    sums = {"rank": F.lit(1).cast("long"), **arm_sums(**cols), **(extra or {})}
    return running(df, [F.col(score).desc(), F.col(key).asc()], sums, by)


def budget_cuts(df: DataFrame, by: Sequence[str], points: int = GRID) -> DataFrame:
    """(by, budget_fraction, n_targeted): one row per budget, sizes rounded half to even."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    step = F.col("_j") * F.lit(1.0 / points)
    return size.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("_j")
                       ).select(*by, step.alias("budget_fraction"),
                                half_even(step * F.col("_n")).alias("n_targeted"))


def at_cuts(ordered: DataFrame, cuts: DataFrame, by: Sequence[str], values: Sequence[str]
            ) -> DataFrame:
    """Running sums at the cut ranks; a budget of nobody has none."""
    small = lookup(cuts)
    hit = match(ordered.select(*by, F.col("rank").alias("n_targeted"), *values),
                small.select(*by, "n_targeted").distinct(), [*by, "n_targeted"])
    return match(small, lookup(hit), [*by, "n_targeted"], "left")


def qini_curve(df: DataFrame, score: str = "score", key: str = "unit",
               by: Sequence[str] = (), points: int = GRID) -> DataFrame:
    """T4: incremental outcome as the budget grows."""
    cols = ["n_t", "y_t", "n_c", "y_c"]
    r = in_score_order(df, score, key, by)
    c = at_cuts(r, budget_cuts(df, by, points), by, cols)
    u = effect(*[F.col(k) for k in cols])
    return c.select(*by, "budget_fraction", "n_targeted", u.alias("uplift_per_contact"),
                    (u * F.col("n_targeted")).alias("incremental_outcome"))


def qini_coefficient(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """T5: area between the curve and the straight line to its last point."""
    c = curve.filter(F.col("incremental_outcome").isNotNull())
    group = Window.partitionBy(*by or [F.lit(0)])
    last = F.max_by("incremental_outcome", "budget_fraction").over(group)
    over = F.col("incremental_outcome") - F.col("budget_fraction") * last
    c = c.withColumn("_g", over)
    w = group.orderBy("budget_fraction")
    area = ((F.col("_g") + F.lag("_g").over(w)) / 2.0
            * (F.col("budget_fraction") - F.lag("budget_fraction").over(w)))
    return c.withColumn("_a", area).groupBy(*by).agg(
        F.coalesce(F.sum("_a"), F.lit(0.0)).alias("qini"))


def select_top(df: DataFrame, budget: float, score: str = "score", key: str = "unit",
               by: Sequence[str] = ()) -> DataFrame:
    """Flag the top round(budget * n) rows of each group."""
    r = running(df, [F.col(score).desc(), F.col(key).asc()],
                {"_rank": F.lit(1).cast("long")}, by)
    return (with_size(r, df, by)
            .withColumn("selected", F.col("_rank") <= half_even(budget * F.col("_n")))
            .drop("_rank", "_n"))


def evaluate_policy(df: DataFrame, budget: float, score: str = "score", key: str = "unit",
                    by: Sequence[str] = ()) -> DataFrame:
    """T3 point estimate: effect inside the selected set and the total it adds up to."""
    u = uplift_of_set(select_top(df, budget, score, key, by), F.col("selected"), by)
    return u.select(*by, F.col("n_selected").alias("n_targeted"),
                    F.col("uplift").alias("uplift_per_contact"),
                    (F.col("uplift") * F.col("n_selected")).alias("incremental_outcome"))


def bootstrap(df: DataFrame, budget: float, n_boot: int = 400, seed: int = 0,
              score: str = "score", key: str = "unit", by: Sequence[str] = ()) -> DataFrame:
    """T3 interval: the selection is fixed, so only the (t, y) counts inside it are resampled.

    The data is scanned once; each cell count is redrawn as a Poisson variable.
    """
    cells = (select_top(df, budget, score, key, by).filter("selected")
             .groupBy(*by, "t", F.col("y").cast("double").alias("y"))
             .agg(F.count(F.lit(1)).alias("n")))

    @F.pandas_udf("double")
    def redraw(n: pd.Series, b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(i), int(k) & 0x7FFFFFFF]).poisson(v)
                          for v, i, k in zip(n, b, h)], dtype="float64")

    draws = cells.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    w = redraw("n", "b", F.hash(*by, "t", "y"))
    per = draws.withColumn("w", w).groupBy(*by, "b").agg(
        F.sum(F.when(F.col("t") == 1, F.col("w"))).alias("n_t"),
        F.sum(F.when(F.col("t") == 1, F.col("w") * F.col("y"))).alias("y_t"),
        F.sum(F.when(F.col("t") == 0, F.col("w"))).alias("n_c"),
        F.sum(F.when(F.col("t") == 0, F.col("w") * F.col("y"))).alias("y_c"))
    u = effect(F.col("n_t"), F.col("y_t"), F.col("n_c"), F.col("y_c"))
    size = cells.groupBy(*by).agg(F.sum("n").alias("n_targeted"))
    # n_boot rows per group: a plain percentile is small here.
    out = per.withColumn("u", u).groupBy(*by).agg(
        F.percentile("u", F.lit(0.025)).alias("lo"), F.percentile("u", F.lit(0.975)).alias("hi"))
    out = match(out, size, list(by)) if by else out.withColumn("n_targeted", size.scalar())
    return out.select(*by, "n_targeted", (F.col("lo") * F.col("n_targeted")).alias("ci_low"),
                      (F.col("hi") * F.col("n_targeted")).alias("ci_high"))


def abstention_sweep(df: DataFrame, score: str = "score", points: int = 20,
                     top: float = 0.95) -> DataFrame:
    """Treat only above a threshold, for thresholds at even quantiles of the score."""
    cells = df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in arm_sums().items()])
    probs = {f"q{j}": top * j / (points - 1) for j in range(points)}
    cut = quantile_cells(cells, "score", probs).first()
    cuts = [float(cut[q]) for q in probs]
    total = df.agg(F.count(F.lit(1))).scalar()
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda j: F.struct(
        j.alias("j"), F.element_at(F.array(*map(F.lit, cuts)), j + 1).alias("threshold"))))
    rows = cells.withColumn("c", above)
    keep = F.col("score") > F.col("c.threshold")

    def part(k):
        return F.coalesce(F.sum(F.when(keep, F.col(k))), F.lit(0))
    a = rows.groupBy("c.j", "c.threshold").agg(*[part(k).alias(k) for k in
                                                 ("n", "n_t", "n_c", "y_t", "y_c")])
    u = effect(*[F.col(k) for k in ("n_t", "y_t", "n_c", "y_c")])
    return a.select("threshold", F.col("n").cast("long").alias("n_targeted"),
                    (F.col("n") / total).alias("share_targeted"), u.alias("uplift_per_contact"),
                    (u * F.col("n")).alias("incremental_outcome"))


def random_baseline(df: DataFrame, budget: float, repeats: int = 200, seed: int = 0
                    ) -> DataFrame:
    """Random targeting averaged over repeats.

    A random set of fixed size ignores the data, so how many of each (t, y) kind it contains is
    multivariate hypergeometric. Drawing those counts is exact and never sorts the rows.
    """
    kinds = df.agg(*[F.count(F.when((F.col("t") == t) & (F.col("y") == y), 1)).alias(f"c{t}{y}")
                     for t in (0, 1) for y in (0, 1)], F.count(F.lit(1)).alias("n"))
    grid = kinds.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                colors = [r.c00, r.c01, r.c10, r.c11]
                if sum(colors) != r.n:
                    raise ValueError("outcomes must be 0 or 1")
                k = int(np.rint(budget * r.n))
                g = np.random.default_rng([seed, r.b]).multivariate_hypergeometric(colors, k)
                ok = g[0] + g[1] > 0 and g[2] + g[3] > 0
                out.append((r.b, k, g[3] / (g[2] + g[3]) - g[1] / (g[0] + g[1]) if ok else None))
            yield pd.DataFrame(out, columns=["b", "k", "u"])

    u = grid.mapInPandas(draw, "b int, k long, u double")
    return u.agg(F.max("k").alias("n_targeted"), F.avg("u").alias("uplift_per_contact"),
                 F.percentile("u", F.lit(0.025)).alias("_lo"),
                 F.percentile("u", F.lit(0.975)).alias("_hi")).select(
        "n_targeted", "uplift_per_contact",
        (F.col("uplift_per_contact") * F.col("n_targeted")).alias("incremental_outcome"),
        (F.col("_lo") * F.col("n_targeted")).alias("ci_low"),
        (F.col("_hi") * F.col("n_targeted")).alias("ci_high"))


def benchmark_table(scores: DataFrame, budget: float, model: str = "model") -> DataFrame:
    """Stacked (model, unit, score, t, y) rows to one line per model, best first."""
    points = evaluate_policy(scores, budget, by=[model])
    q = qini_coefficient(qini_curve(scores, by=[model]), [model])
    return points.join(q, model).orderBy(F.desc("incremental_outcome"))


def verdict(table: DataFrame, random_incremental: float) -> DataFrame:
    """How each model compares with random targeting."""
    return table.select("*", F.when(F.col("incremental_outcome") < random_incremental,
                                    "worse than random").otherwise("better than random")
                        .alias("verdict"))
