"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones, a flow problem over shards
finds the bytes that every pair exchanges so that the fewest bytes move. The flow is then laid over
blocks (hash ranges of a shard): whole blocks move, and only blocks on a border are split between
documents. Documents that stay keep their shard, and only files of shards that gain or lose rows
are written again.

The flow problem has one node per shard, and the driver sees sizes of `blocks` blocks per shard,
a bounded table. Rows are numbered per block, never per shard, so that a shard of any size is
spread over many tasks.

Defined results: null text has no bytes; rows of one doc_id are placed each by itself; empty
tables give empty shards; other input columns are ignored by the plan and kept by `rewrite`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored, unused

OVERHEAD = 8
BLOCKS = 1024


def transfers(sizes: Sequence[int], capacities: Sequence[int]) -> dict[tuple[int, int], int]:
    """Bytes sent from old to new shard, with the fewest bytes moved. Capacities cover the sizes.

    Successive cheapest paths on the network source - old - new - sink; keeping a byte in the
    shard of the same number costs nothing, moving it costs one.
    """
    if sum(capacities) < sum(sizes):
        raise ValueError("the new shards hold less than the old ones")
    old, new = len(sizes), len(capacities)
    source, sink = old + new, old + new + 1
    head: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []

    def arc(a: int, b: int, most: int, cost: int) -> None:
        for x, y, r, c in ((a, b, most, cost), (b, a, 0, -cost)):
            head[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(c)

    for i, s in enumerate(sizes):
        arc(source, i, s, 0)
        for j in range(new):
            arc(i, old + j, s, int(i != j))
    for j, c in enumerate(capacities):
        arc(old + j, sink, c, 0)
    left = sum(sizes)
    while left:
        best, via = [1 << 60] * (sink + 1), [-1] * (sink + 1)
        best[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in head[x]:
                if room[e] and best[x] + price[e] < best[to[e]]:
                    best[to[e]], via[to[e]] = best[x] + price[e], e
                    queue.append(to[e])
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        step = min(left, *[room[e] for e in path])
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
        left -= step
    return {(i, to[e] - old): room[e ^ 1] for i in range(old) for e in head[i]
            if old <= to[e] < source and not e & 1 and room[e ^ 1]}


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def measured(docs: DataFrame, shards: int, key: Column, blocks: int = BLOCKS,
             extra: Sequence[Column] = ()) -> DataFrame:
    """doc_id, size, text_crc32, the old shard that `key` gives and the block inside it; and `extra`."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("old_shard"),
        F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(blocks)).cast("int").alias("block"), *extra)


def place(rows: DataFrame, shards: int) -> DataFrame:
    """Add `shard` and the gapless `slot` to the stored rows of `measured`."""
    spark = rows.sparkSession
    stats = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).collect()
    by_old: dict[int, list[tuple[int, int]]] = {i: [] for i in range(shards)}
    for r in stats:
        by_old[r["old_shard"]].append((r["block"], r["bytes"]))
    sizes = [sum(b for _, b in by_old[i]) for i in range(shards)]
    flow = transfers(sizes, even(sum(sizes), shards))
    layout = []
    for i in range(shards):
        # What stays comes first, then what leaves, each as a range of the shard's bytes.
        ends, at = [], 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            at += flow[i, j]
            ends.append((at, j))
        at = 0
        for block, size in sorted(by_old[i]):
            inside = [(e, j) for e, j in ends if e > at]
            need = [x for n, x in enumerate(inside) if n == 0 or inside[n - 1][0] < at + size]
            layout.append((i, block, at, [e for e, _ in need], [j for _, j in need]))
            at += size
    schema = T.StructType([
        T.StructField("old_shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("_from", T.LongType()), T.StructField("_ends", T.ArrayType(T.LongType())),
        T.StructField("_to", T.ArrayType(T.IntegerType()))])
    # One row per block: the number of blocks is a parameter, whatever the data.
    plan = F.broadcast(spark.createDataFrame(layout, schema))
    order = Window.partitionBy("old_shard", "block").orderBy(
        F.desc("size"), "doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_from") + F.sum("size").over(order) - F.col("size") / 2
    placed = rows.join(plan, ["old_shard", "block"]).withColumn("_at", middle)
    target = F.get(F.col("_to"), F.least(F.size(F.filter("_ends", lambda e: e <= F.col("_at"))),
                                         F.size("_to") - 1))
    placed = stored(placed.withColumn("shard", target).withColumn("_here", F.row_number().over(
        Window.partitionBy("old_shard", "block", "shard").orderBy(
            F.desc("size"), "doc_id", "text_crc32"))).drop("_from", "_ends", "_to", "_at"),
        "placed")
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "old_shard", "block", F.coalesce(
        F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, ["shard", "old_shard", "block"]).withColumn(
        "slot", F.col("_before") + F.col("_here") - 1).drop("_before", "_here")


def reshard(docs: DataFrame, shards: int, key: Column, blocks: int = BLOCKS) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, old_shard, block, shard, slot."""
    return place(stored(measured(docs, shards, key, blocks), "measured"), shards)


def rewrite(docs: DataFrame, shards: int, key: Column, path: str, blocks: int = BLOCKS) -> DataFrame:
    """Place all rows, write the shards that gain or lose rows under `path`, and return the placed rows.

    Rows are told apart by a number that they get in a written copy, so rows without a doc_id, with the
    same one, or equal in all columns are each written once. The folders are called `shard=0` and so on,
    with underscores behind the name where `docs` has a column of that name; its columns are unchanged.
    """
    row, folder, order = unused(docs, "_row", "shard", "slot")
    copy = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    placed = stored(place(stored(measured(copy, shards, key, blocks, [F.col(row)]), "measured"), shards),
                    "replaced")
    touched = touched_shards(placed)
    here = placed.filter(F.col("shard").isin(touched)).select(
        row, F.col("shard").alias(folder), F.col("slot").alias(order))
    copy.join(here, row).drop(row).repartition(folder, F.pmod(order, F.lit(16))).write.partitionBy(
        folder).parquet(path)
    return placed.drop(row)


def touched_shards(placed: DataFrame) -> list[int]:
    """The numbers of the shards that gain or lose rows."""
    moved = placed.filter("shard <> old_shard")
    return sorted(r[0] for r in moved.select(F.explode(F.array("shard", "old_shard"))).distinct().collect())
