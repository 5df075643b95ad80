"""Merged blocks against the formula of largest least means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import isotonic


def plain(x, y):
    at = np.unique(x)
    n = np.array([np.sum(x == v) for v in at])
    s = np.array([y[x == v].sum() for v in at])
    n1, s1 = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(s)])
    k = len(at)
    return dict(zip(at.tolist(), [max(min((s1[b + 1] - s1[a]) / (n1[b + 1] - n1[a]) for b in range(i, k))
                                      for a in range(i + 1)) for i in range(k)], strict=True))


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "one", "steps"])
@pytest.mark.parametrize("per_slice", [7, 1000])
def test_fit_is_that_of_all_rows(spark, shape, per_slice):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 60, 400).astype(float) if shape != "one" else np.full(5, 3.0)
    y = {"noise": rng.normal(size=len(x)) + x / 40, "rising": x, "falling": -x, "one": np.arange(len(x)) * 1.0,
         "steps": np.floor(x / 9) + (rng.random(len(x)) < 0.3)}[shape]
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, 1.0), (1.0, None)], "x double, y double")
    blocks = isotonic.fit(df, "x", "y", per_slice)
    rows = blocks.orderBy("low").collect()
    assert sum(r.n for r in rows) == len(x)
    assert all(a.high < b.low and a.value < b.value for a, b in zip(rows, rows[1:], strict=False))
    want = plain(x, y)
    got = {r.x: r.value for r in isotonic.predict(df.filter("x IS NOT NULL AND y IS NOT NULL").select("x").distinct(), blocks, "x").collect()}
    assert got == pytest.approx(want)


def test_values_outside_and_between_blocks(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (4.0, 5.0)], "x double, y double")
    asks = spark.createDataFrame([(v,) for v in (0.0, 1.5, 3.9, 9.0)], "x double")
    got = isotonic.predict(asks, isotonic.fit(df, "x", "y"), "x").orderBy("x").collect()
    assert [r.value for r in got] == [0.0, 0.0, 1.0, 5.0]
    assert isotonic.fit(df.filter(F.lit(False)), "x", "y").count() == 0
