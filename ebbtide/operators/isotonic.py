"""Isotonic regression from pooled blocks that can be merged.

The fit of ordered rows is a row of blocks of rising value, each the mean of its rows, and the fit of
two successive stretches follows from their blocks alone. So each slice of the ordered x pools its own
rows, and slices are merged in pairs, then in pairs of pairs. A merge moves only blocks that it can
change: those on the left that reach the lowest value on the right, and those on the right that do not
exceed the highest on the left. All others stay where they were written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import order

#: Distinct x that one task pools.
SLICE = 100_000
_BLOCK = "low double, high double, n double, total double"


def pooled(low: np.ndarray, high: np.ndarray, n: np.ndarray, total: np.ndarray
           ) -> tuple[list[float], list[float], list[float], list[float]]:
    """Blocks of strictly rising means from ordered ones."""
    out: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), n.tolist(), total.tolist(), strict=True):
        a, b, w, s = block
        while out and out[-1][3] * w >= s * out[-1][2]:
            a, _, v, t = out.pop()
            w, s = w + v, s + t
        out.append([a, b, w, s])
    return tuple(zip(*out, strict=True)) if out else ([], [], [], [])


def fit(df: DataFrame, x: str, y: str, per_slice: int = SLICE) -> DataFrame:
    """(low, high, n, value) of every block, for x from `low` to `high`; rows without x or y are left out.

    Rows of one x are one cell, so ties never part.
    """
    cells = cut(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                .filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x)").groupBy("x").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("total")))
    slices = max(1, -(-cells.count() // per_slice))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is not None:
            at = table.column("x").to_numpy()
            blocks = pooled(at, at, table.column("n").to_numpy(), table.column("total").to_numpy())
            where = pa.array(np.full(len(blocks[0]), TaskContext.get().partitionId(), np.int64))
            yield pa.RecordBatch.from_arrays([where, *map(pa.array, blocks)], ["slice", "low", "high", "n", "total"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        blocks = pooled(*(table.column(c).to_numpy() for c in ("low", "high", "n", "total")))
        return pa.table({"slice": [key[0].as_py()] * len(blocks[0])} | {
            c: pa.array(b, pa.float64()) for c, b in zip(("low", "high", "n", "total"), blocks, strict=True)})

    blocks = cut(cells.repartitionByRange(slices, "x").sortWithinPartitions("x").mapInArrow(
        pool, f"slice long, {_BLOCK}"))
    wide = 1
    while wide < slices:
        wide *= 2
        mean = F.col("total") / F.col("n")
        named = blocks.withColumn("_right", F.expr(f"slice % {wide} >= {wide // 2}")).withColumn(
            "slice", F.expr(f"slice div {wide} * {wide}"))
        # One row per pair of slices.
        edge = named.groupBy(F.col("slice").alias("_pair")).agg(
            F.max(F.when(~F.col("_right"), mean)).alias("_top"), F.min(F.when(F.col("_right"), mean)).alias("_bottom"))
        joined = named.join(edge, F.col("slice") == F.col("_pair"))
        moves = F.coalesce(F.when(F.col("_right"), mean <= F.col("_top")).otherwise(mean >= F.col("_bottom")), F.lit(False))
        marked = cut(joined.select("slice", "low", "high", "n", "total", moves.alias("_moves")))
        blocks = cut(marked.filter(~F.col("_moves")).drop("_moves").union(marked.filter("_moves").drop(
            "_moves").groupBy("slice").applyInArrow(merge, f"slice long, {_BLOCK}")))
    return blocks.select("low", "high", F.col("n").cast("long").alias("n"), (F.col("total") / F.col("n")).alias("value"))


def predict(rows: DataFrame, blocks: DataFrame, x: str, name: str = "value") -> DataFrame:
    """`rows` with the value of the block that their x lies in; below the first block its value holds, and
    between two blocks that of the lower one."""
    first = blocks.agg(F.min_by("value", "low")).scalar()
    return order.as_of(rows, blocks.select(F.col("low").alias(x), "value"), x, {name: F.col("value")}, first)
