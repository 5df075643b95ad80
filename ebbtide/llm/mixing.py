"""Mixing sources to target weights by the cube method.

A source's share of the words divided by its size is the expected number of copies of each of its
documents: the whole part is taken for certain, the fraction is an inclusion probability. The
flight phase moves the probabilities of a group along the null space of its two constraints - the
expected number of documents and of words - until at most two are neither 0 nor 1; those meet in
ever fewer groups, and the last ones of a source land on the outcome nearest to its word total.

A source is split into groups of `group` documents by hash, so a source may hold any share of the
rows: a group is flown in one task, and its few open documents go to the next level.

Defined results: null text has no words; sources are ordered by code point with null last; rows of
one doc_id are drawn each by itself (`mixed` treats them as one document); empty tables and
tables without words take nothing; other columns are ignored. The draw depends on doc_id, size
and `seed` alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import ranked
from .common import parts, stored, unused, words

WEIGHTS = (3, 1, 2)
TOTAL, MOST = 1.5, 2.0
GROUP = 4000
SEED = 11


def flight(p: np.ndarray, size: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """Move `p` until two entries at most are fractional, keeping sum(p) and sum(p * size)."""
    p = p.copy()
    rng = np.random.default_rng(seed)
    waiting = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))][::-1]
    held: list[int] = []
    while len(held) < 3 and waiting:
        held.append(waiting.pop())
    while len(held) == 3:
        a, b, c = (float(size[i]) for i in held)
        v = (b - c, c - a, a - b)
        if v == (0.0, 0.0, 0.0):  # equal sizes: any exchange of two keeps both sums
            v = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, i in zip(v, held, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
        step = up if rng.random() * (up + down) < down else -down
        for x, i in zip(v, held, strict=True):
            q = p[i] + step * x
            p[i] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
        held = [i for i in held if 0 < p[i] < 1]
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
    return p


def landing(p: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Settle the last few fractional entries, nearest to the words of the probabilities `before`.

    All outcomes of the open entries are tried, each alone and with one settled entry of the same
    flight turned round; the error left is that of the best one.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    free = np.flatnonzero((before > 0) & (before < 1) & ((p == 0) | (p == 1)))
    change = np.where(p[free] == 0, size[free], -size[free])
    want = float((before * size).sum())
    best, least = p, float("inf")
    for k in range(1 << len(open_)):
        out = p.copy()
        out[open_] = [k >> n & 1 for n in range(len(open_))]
        error = float((out * size).sum()) - want
        if abs(error) < least:
            best, least = out, abs(error)
        if len(free) and abs(error) > 0:
            turn = int(np.argmin(np.abs(error + change)))
            if abs(error + change[turn]) < least:
                best, least = out.copy(), abs(error + change[turn])
                best[free[turn]] = 1 - best[free[turn]]
    return best


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL,
            most: float = MOST) -> DataFrame:
    """(source, source_size) to which target words are added.

    The weight follows the source's place by code point. Words above `most` times a source are
    shared again among the others: the common rate rises until no further source is full.
    """
    place = ranked(sizes, [F.col("source").asc_nulls_last()], name="_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    rows = stored(place.withColumn("_w", w).withColumn("_cap", most * F.col("source_size")), "sources")
    whole, every = rows.agg(F.sum("source_size"), F.sum("_w")).first()
    rate = total * whole / every if whole else 0.0
    while whole:
        full = F.col("_cap") < rate * F.col("_w")
        fixed, rest = rows.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)),
                               F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        higher = (total * whole - fixed) / rest if rest else rate
        if higher <= rate * (1 + 1e-12):
            break
        rate = higher
    return rows.select("source", "source_size", F.col("_rank").alias("source_rank"), F.least(
        F.col("_cap"), rate * F.col("_w")).alias("target"))


def _fly(seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_u", "doc_id", "size"], kind="stable", na_position="last")
        p = rows["_p"].to_numpy(float)
        size = rows["size"].to_numpy(np.int64)
        flown = flight(p, size, [seed, int(key[0]), int(key[1])])
        return rows.assign(_p=landing(flown, size, p) if rows["_last"].iloc[0] else flown)
    return run


def draw(docs: DataFrame, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target and copies (0, 1 or 2) of every row."""
    sized = stored(docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sized")
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    aims = targets(totals.drop("_docs")).join(
        totals.select(F.col("source").alias("_s"), "_docs"),
        F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = sized.join(aims.withColumnRenamed("source", "_source"),
                      F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    pi = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_base", F.floor(pi + 1e-12)).withColumn(
        "_p", F.greatest(pi - F.col("_base"), F.lit(0.0))).withColumn(
        "_u", F.xxhash64("doc_id", F.lit(seed)))
    most = totals.agg(F.max("_docs")).first()[0] or 0
    groups = F.ceil(F.col("_docs") / group)
    done, level = [], 0
    while True:
        # A source lands in the level where its rows fit one group, whatever the others hold.
        rows = rows.withColumn("_last", groups == 1)
        flown = stored(rows.groupBy("source_rank", F.pmod("_u", groups).alias("_group")).applyInPandas(
            _fly(seed + level), rows.schema), "flown")
        if most <= group:
            done.append(flown)
            break
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        done.append(flown.filter(~open_))
        level += 1
        # Two open documents per group: a source of n rows leaves 2 * ceil(n / group).
        rows = flown.filter(open_).withColumn("_u", F.xxhash64("doc_id", F.lit(seed + level)))
        most = 2 * parts(most, group)
        groups = F.ceil(2 * groups / group)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("doc_id", "size", "source", "source_size", "target",
                      (F.col("_base") + F.round("_p")).cast("int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """`docs` with every row repeated as often as it was drawn; rows of one doc_id alike."""
    key, copies, copy = unused(docs, "_id", "_copies", "_copy")
    drawn = draw(docs, **options).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies))
    return docs.join(drawn.filter(F.col(copies) > 0), F.col("doc_id").eqNullSafe(F.col(key))).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
