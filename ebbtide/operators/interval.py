"""Existence of a related fact inside a time window, without pairing the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, micros


def exists_within(probe: DataFrame, build: DataFrame, key: str, at: Column | str,
                  other: Column | str, low: int, high: int, flag: str) -> DataFrame:
    """Flag probe rows for which some build row of the same key lies in [at+low, at+high] us.

    Time is cut into buckets exactly as wide as the window. A window of that width always
    starts in one bucket and ends in the next, so a row exists iff the first bucket's maximum
    reaches the start or the second one's minimum is not past the end. The build side shrinks
    to one row per (key, bucket) before it is shuffled, the join never multiplies probe rows,
    and a key with very many rows is spread over its buckets.
    """
    width = high - low
    if width <= 0:
        raise ValueError("the window must have a positive width")
    bucket = F.floor(micros(other) / F.lit(width)).cast("long")
    edges = (build.filter(c(other).isNotNull() & c(key).isNotNull())
             .groupBy(c(key).alias("_k"), bucket.alias("_b"))
             .agg(F.min(micros(other)).alias("_min"), F.max(micros(other)).alias("_max")))
    # Each edge row serves as "this bucket" and, one bucket earlier, as "the next bucket".
    served = (edges.select("_k", F.explode(F.array(
        F.struct(F.col("_b").alias("b"), F.col("_max").alias("mx"),
                 F.lit(None).cast("long").alias("mn")),
        F.struct((F.col("_b") - 1).alias("b"), F.lit(None).cast("long").alias("mx"),
                 F.col("_min").alias("mn")))).alias("e"))
        .groupBy("_k", F.col("e.b").alias("_b"))
        .agg(F.max("e.mx").alias("_max"), F.min("e.mn").alias("_min")))
    start = micros(at) + F.lit(low)
    p = probe.withColumn("_pb", F.floor(start / F.lit(width)).cast("long"))
    j = p.join(served, (p[key] == served["_k"]) & (p["_pb"] == served["_b"]), "left")
    hit = (F.coalesce(F.col("_max") >= start, F.lit(False))
           | F.coalesce(F.col("_min") <= micros(at) + F.lit(high), F.lit(False)))
    return j.select(*probe.columns, hit.alias(flag))
