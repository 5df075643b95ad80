"""Is a survival model right? Curves, discrimination, proper scores and calibration.

Inputs are one row per unit: duration, event (> 0 is a failure), a predicted curve array or a
predicted survival, and a risk. Anything over time is aggregated to distinct times first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clip
from ..functions.curves import at_time
from ..functions.tails import chi2_sf
from ..session import cut, lookup
from .order import match, quantile_cells, quantiles, running, with_size

MIN_CENSORING = 0.05


# --- non-parametric curves -------------------------------------------------------------

def time_cells(df: DataFrame, by: Sequence[str] = (), time: str = "duration") -> DataFrame:
    """Distinct times with their counts of rows, failures and censorings, plus those at risk.

    Exact timestamps may give as many times as rows, so the running sum is distributed.
    """
    cells = cut(df.groupBy(*by, F.col(time).alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event") > 0, 1)).alias("d")))
    cells = cells.withColumn("c", F.col("n") - F.col("d"))
    r = running(cells, [F.col("time").desc()], {"at_risk": F.col("n")}, by)
    return r


def _product(cells: DataFrame, factor: Column, by: Sequence[str], name: str) -> DataFrame:
    d = cells.withColumn("_f", factor)
    r = running(d, [F.col("time")], {
        "_ln": F.coalesce(F.ln(F.when(F.col("_f") > 0, F.col("_f"))), F.lit(0.0)),
        "_zero": F.when(F.col("_f") <= 0, 1).otherwise(0)}, by)
    return r.withColumn(name, F.when(F.col("_zero") > 0, 0.0).otherwise(F.exp("_ln"))).drop(
        "_f", "_ln", "_zero")


def kaplan_meier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K1."""
    c = time_cells(df, by)
    return _product(c, 1.0 - F.col("d") / F.col("at_risk"), by, "survival")


def censoring_survival(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K3: events come before censorings at the same time."""
    c = time_cells(df, by)
    left = F.col("at_risk") - F.col("d")
    return _product(c, F.when(left > 0, 1.0 - F.try_divide(F.col("c"), left)).otherwise(1.0),
                    by, "g")


def step_lookup(curve: DataFrame, value: str, times: Sequence[float], by: Sequence[str] = ()
                ) -> DataFrame:
    """K2: value at the largest time <= each query, 1 before the first."""
    at = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.coalesce(F.max_by(
        value, F.when(F.col("time") <= t, F.col("time"))), F.lit(1.0)).alias("value"))
        for t in times])
    return curve.groupBy(*by).agg(at.alias("_a")).select(*by, F.explode("_a").alias("r")).select(
        *by, "r.*")


def estimable_horizon(g: DataFrame, low: float = MIN_CENSORING, by: Sequence[str] = ()
                      ) -> DataFrame:
    """K4: last time at which the censoring curve is still above `low`."""
    return g.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("g") > low, F.col("time"))),
                                         F.min("time")).cast("double").alias("horizon"))


# --- discrimination ----------------------------------------------------------------------

def concordance(df: DataFrame, risk: str = "risk", by: Sequence[str] = (),
                time: str = "duration") -> DataFrame:
    """K5: Harrell's C without forming pairs.

    Write the time as a binary number. Two different times agree down to one bit at which the
    earlier has 0 and the later 1, so every comparable pair meets in exactly one (level,
    prefix) group; equal times meet in a group of their own, failures on one side and
    censorings on the other. Inside a group only how many later risks lie below each earlier
    one is needed, which is a running sum over distinct risks.
    """
    d = df.select(*by, F.col(time).alias("_t"), (F.col("event") > 0).alias("_e"),
                  F.col(risk).cast("double").alias("_r"))
    if dict(d.dtypes)["_t"] not in ("int", "bigint", "smallint", "tinyint"):
        ranks = running(d.select("_t").distinct(), [F.col("_t")], {"_k": F.lit(1).cast("long")})
        d = d.join(lookup(ranks), "_t").withColumn("_t", F.col("_k")).drop("_k")
    top = d.agg(F.max("_t")).first()[0] or 0
    levels = max(1, int(top).bit_length())
    bit = F.expr("shiftright(_t, _l) & 1")
    rows = d.withColumn("_l", F.explode(F.sequence(F.lit(-1), F.lit(levels - 1))))
    rows = rows.withColumn("_g", F.when(F.col("_l") < 0, F.col("_t")).otherwise(
        F.expr("shiftright(_t, greatest(_l, 0) + 1)")))
    tie = F.col("_l") < 0
    early = F.when(tie, F.col("_e")).otherwise(F.col("_e") & (bit == 0))
    late = F.when(tie, ~F.col("_e")).otherwise(bit == 1)
    rows = rows.select(*by, "_l", "_g", "_r", early.cast("long").alias("_a"),
                       late.cast("long").alias("_b")).filter("_a = 1 OR _b = 1")
    key = [*by, "_l", "_g"]
    cells = rows.groupBy(*key, "_r").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    r = running(cells, [F.col("_r")], {"_cum": F.col("_b")}, key)
    a, b = F.col("_a").cast("double"), F.col("_b").cast("double")
    per = r.groupBy(*key).agg(
        F.sum(a * (F.col("_cum") - b)).alias("conc"), F.sum(a * b).alias("tied"),
        (F.sum(a) * F.sum(b)).alias("pairs"))
    out = per.groupBy(*by).agg(F.sum("conc").alias("concordant"), F.sum("tied").alias("tied"),
                               F.sum("pairs").alias("comparable"))
    return out.withColumn("c_index", F.try_divide(
        F.col("concordant") + 0.5 * F.col("tied"), F.nullif("comparable", F.lit(0.0))))


# --- proper scores -------------------------------------------------------------------------

def brier(df: DataFrame, curve: str, horizons: Sequence[float], by: Sequence[str] = ()
          ) -> DataFrame:
    """K6: reweighted Brier score at each horizon; NULL where a weight is undefined.

    Squared errors are summed per (duration, failed) cell before any weight is attached.
    """
    g = censoring_survival(df, by)
    at = F.array(*[F.struct(F.lit(float(t)).alias("t"),
                            clip(at_time(F.col(curve), F.lit(float(t))), 0.0, 1.0).alias("s"))
                   for t in horizons])
    failed = (F.col("event") > 0)
    cells = (df.select(*by, F.col("duration").alias("time"), failed.alias("_e"),
                       F.explode(at).alias("q"))
             .groupBy(*by, "time", "_e", F.col("q.t").alias("horizon"))
             .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("q.s") * F.col("q.s")).alias("_s2"),
                  F.sum((1 - F.col("q.s")) * (1 - F.col("q.s"))).alias("_a2")))
    gt = step_lookup(g, "g", horizons, by).select(*by, F.col("t").alias("horizon"),
                                                  F.col("value").alias("_gt"))
    c = match(match(cells, lookup(g.select(*by, "time", F.col("g").alias("_g"))),
                    [*by, "time"]), lookup(gt), [*by, "horizon"])
    out, alive = F.col("_e") & (F.col("time") <= F.col("horizon")), F.col("time") > F.col("horizon")
    bad = (out & (F.col("_g") <= 0)) | (alive & (F.col("_gt") <= 0))
    term = F.when(out, F.try_divide("_s2", "_g")).when(alive, F.try_divide("_a2", "_gt")
                                                       ).otherwise(0.0)
    return c.groupBy(*by, "horizon").agg(
        F.bool_or(bad).alias("_bad"), (F.sum(term) / F.sum("_n")).alias("_b")).select(
        *by, "horizon", F.when(~F.col("_bad"), F.col("_b")).alias("brier"))


def integrated(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K7: trapezoid over the horizons divided by their span; NULL if any score is."""
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy("horizon")
    width = F.col("horizon") - F.lag("horizon").over(w)
    s = scores.withColumn("_a", (F.col("brier") + F.lag("brier").over(w)) / 2.0 * width)
    span = F.max("horizon") - F.min("horizon")
    return s.groupBy(*by).agg(
        F.when(F.count("brier") < F.count(F.lit(1)), F.lit(None).cast("double"))
        .when(span > 0, F.try_divide(F.sum("_a"), span)).otherwise(F.avg("brier")).alias("ibs"))


def own_time(curve: Column, duration: Column, support: int | None = None) -> tuple[Column, Column]:
    """Survival at each unit's own time and just before it, inside the support."""
    t = F.least(duration, F.lit(support)) if support is not None else duration
    return at_time(curve, t), at_time(curve, t - 1)


def d_calibration(df: DataFrame, at: Column, before: Column | None = None, bins: int = 10,
                  by: Sequence[str] = ()) -> DataFrame:
    """K8: probability mass per bin of S(T) and the chi-square against a uniform."""
    s = clip(at, 0.0, 1.0)
    if before is not None:
        s = 0.5 * (s + F.greatest(clip(before, 0.0, 1.0), s))
    d = df.select(*by, s.alias("_s"), (F.col("event") > 0).alias("_e"))
    x, e = F.col("_s"), F.col("_e")

    def mass(b: int) -> Column:
        low, high = b / bins, (b + 1) / bins
        hit = F.least(F.floor(x * bins), F.lit(bins - 1)) == b
        spread = F.try_divide(F.greatest(F.least(F.lit(high), x) - low, F.lit(0.0)), x)
        censored = F.when(x <= 1e-12, F.lit(1.0 if b == 0 else 0.0)).otherwise(spread)
        return F.sum(F.when(e, hit.cast("double")).otherwise(censored))

    a = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                           F.array(*[mass(b) for b in range(bins)]).alias("mass"))
    want = F.col("n") / bins
    return a.withColumn("chi2", F.aggregate(
        F.col("mass"), F.lit(0.0), lambda t, m: t + (m - want) * (m - want) / want))


def with_chi2_p(df: DataFrame, df_count: int, stat: str = "chi2", name: str = "p_value"
                ) -> DataFrame:
    """Upper tail beside a few aggregated rows."""
    @F.pandas_udf("double")
    def p(s: pd.Series) -> pd.Series:
        return s.map(lambda v: chi2_sf(float(v), df_count) if v is not None else math.nan
                     ).astype("float64")

    return df.withColumn(name, p(stat))


def calibration_bins(df: DataFrame, predicted: Column, t: float, bins: int = 10,
                     key: str = "unit") -> DataFrame:
    """K9: equal slices of predicted survival with the observed survival of each at `t`."""
    d = df.select(key, "duration", "event", clip(predicted, 0.0, 1.0).alias("_p"))
    r = with_size(running(d, [F.col("_p").asc(), F.col(key).asc()],
                          {"_r": F.lit(1).cast("long")}), d)
    small, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
    head = extra * (small + 1)
    b = F.when(F.col("_r") <= head, F.ceil(F.col("_r") / (small + 1))).otherwise(
        extra + F.ceil((F.col("_r") - head) / F.greatest(small, F.lit(1))))
    r = cut(r.withColumn("bin", b.cast("int")))
    km = kaplan_meier(r, ["bin"])
    observed = step_lookup(km, "survival", [t], ["bin"]).select(
        "bin", F.col("value").alias("observed"))
    sizes = r.groupBy("bin").agg(F.avg("_p").alias("predicted"), F.count(F.lit(1)).alias("n"))
    return sizes.join(observed, "bin")


def calibration_summary(bins: DataFrame) -> DataFrame:
    """K9: size-weighted absolute gap and the slope of observed on predicted."""
    n = F.col("n").cast("double")
    a = bins.agg(F.sum(n).alias("w"), F.sum(n * F.col("predicted")).alias("sx"),
                 F.sum(n * F.col("observed")).alias("sy"),
                 F.sum(n * F.abs(F.col("predicted") - F.col("observed"))).alias("gap"),
                 F.sum(n * F.col("predicted") * F.col("predicted")).alias("sxx"),
                 F.sum(n * F.col("predicted") * F.col("observed")).alias("sxy"))
    mx, my = F.col("sx") / F.col("w"), F.col("sy") / F.col("w")
    var = F.col("sxx") / F.col("w") - mx * mx
    return a.select((F.col("gap") / F.col("w")).alias("mean_abs_error"), F.when(
        var >= 1e-12, F.try_divide(F.col("sxy") / F.col("w") - mx * my, var)).alias("slope"))


def horizon_grid(df: DataFrame, points: int = 20) -> list[float]:
    """Where to evaluate - the 10th percentile of durations up to the estimable end."""
    q = quantiles(df, "duration", {"lo": 0.10, "hi": 0.90}).first()
    end = estimable_horizon(censoring_survival(df)).first()["horizon"]
    lo = max(float(q["lo"]), 1.0)
    hi = max(min(float(q["hi"]), end), lo + 1.0)
    return sorted({lo + (hi - lo) * i / (points - 1) for i in range(points)})


def score_model(df: DataFrame, curve: str, risk: str, reference: float, support: int,
                marginal: bool = False, key: str = "unit") -> DataFrame:
    """C, integrated Brier, calibration and D-calibration of one model, as one row."""
    grid = [t for t in horizon_grid(df) if t <= support]
    ibs = integrated(brier(df, curve, grid)).scalar()
    cal = calibration_summary(calibration_bins(
        df, at_time(F.col(curve), F.lit(reference)), reference, key=key)).select(
        F.struct("*")).scalar()
    now, before = own_time(F.col(curve), F.col("duration"), support)
    dcal = with_chi2_p(d_calibration(df, now, before), 9)
    c = F.lit(None).cast("double") if marginal else \
        concordance(df, risk).select("c_index").scalar()
    return dcal.select("n", "chi2", "p_value", ibs.alias("ibs"), c.alias("c_index"),
                       cal.alias("_c")).select(
        "n", "c_index", "ibs", F.col("_c.mean_abs_error").alias("cal_mae"),
        F.col("_c.slope").alias("cal_slope"), F.col("p_value").alias("d_cal_p"))


def resplit_summary(scores: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Mean of each measure per model over resplits."""
    return scores.groupBy("model").agg(F.count(F.lit(1)).alias("splits"),
                                       *[F.avg(m).alias(m) for m in measures])


def paired_wins(scores: DataFrame, ours: str, models: Sequence[str], measure: str = "ibs"
                ) -> DataFrame:
    """How often `ours` has the lower score on the same split."""
    w = scores.groupBy("seed").pivot("model", [ours, *models]).agg(F.first(measure))
    return w.agg(*[F.avg((F.col(ours) < F.col(m)).cast("double")).alias(m) for m in models]
                 ).select(F.explode(F.array(*[F.struct(F.lit(m).alias("against"), F.col(m)
                                                       .alias("win_rate")) for m in models]))
                          .alias("r")).select("r.*")


def duration_quantiles(df: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of the durations from their counts."""
    return quantile_cells(df.groupBy("duration").agg(F.count(F.lit(1)).alias("n")),
                          "duration", probs)
