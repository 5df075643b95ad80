"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of `edges` (a, b): the least id that can be reached.

    Every round gives an id the least label of its neighbours and then the label of that label, so
    stars settle in one round and chains in logarithmically many. A centre of very many links is a
    skewed join key, which adaptive execution splits, and its labels are combined before the
    shuffle.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(),
                  "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(
        F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(
            F.min("component").alias("_near"))
        lower = labels.join(seen, labels["id"] == seen["a"]).select(
            "id", "component", F.least("component", "_near").alias("_new"))
        jump = labels.select(F.col("id").alias("_new"), F.col("component").alias("_jump"))
        after = stored(lower.join(jump, "_new", "left").select(
            "id", F.least("_new", F.coalesce("_jump", F.col("_new"))).alias("component"),
            F.col("component").alias("_old")), "labels")
        changed = after.filter("component <> _old").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels
