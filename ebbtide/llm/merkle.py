"""Merkle manifest of a dataset by time-forward processing.

A node of the tree is labelled by its level and its place in it, so children have smaller labels than
their parents. A node's digest is a message to its parent: the shuffle brings messages to the block of
successive places that their label falls in, and inside a block a priority queue ordered by label gives
them out again, all children of one parent in a row. Each round climbs as many levels as a block can
hold, so the rows shrink by the size of a block and a tree of any size takes few rounds. The reversed
sweep goes down the same blocks: a parent delivers its proof suffix - the siblings from its own level
to the root - to its children, which put their own siblings before it.

Places come from a range shuffle into slices of bounded size, numbered inside the slice and shifted by
the rows of earlier slices, so a language with most of the rows is spread over many tasks.

Defined results: every row is a leaf, repeated rows too; leaves of a tree ascend by doc_id (null
first), then by digest; a null language is a tree of its own before all others, an empty string comes
next; a null value is digested as `-`, an empty text as `0:`; an empty table has no rows; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one slice of the global order, and most nodes that meet in one block.
SLICE, BLOCK = 20_000, 1024
_HEX = 64
#: What the nodes of one tree take down with a proof.
_CROWN = ("subroot", "root", "rank", "trees")


def joined(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: every value with its length in bytes before it, null as `-`."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t),
                                        F.lit("-")) for t in texts]).cast("binary"), 256)


def tree_key(lang: Column) -> Column:
    """A name that is never null and keeps the order: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with their place in their `tree` (from 0, ascending, null first) and its `total`."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    slices = parts(rows.count(), SLICE)
    ranged = stored(rows.repartitionByRange(slices, *keys).sortWithinPartitions(*keys).withColumn(
        "_at", F.monotonically_increasing_id()).withColumn("_slice", F.shiftright("_at", 33)), "ranged")
    # One row per slice and tree.
    here = ranged.groupBy("tree", "_slice").agg(F.count("*").alias("_rows"), F.min("_at").alias("_from"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = stored(here.select(
        F.col("tree").alias("_tree"), F.col("_slice").alias("_of"), F.sum("_rows").over(tree).alias("total"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_from")).alias("_shift")), "shifts")
    return ranged.join(shift, (F.col("tree") == F.col("_tree")) & (F.col("_slice") == F.col("_of"))).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("position"), "total")


def _levels(total: int, fanout: int, block: int) -> tuple[int, int]:
    """How many levels a block climbs in a tree of `total` nodes, and how many nodes there are then."""
    levels, span = 0, 1
    while total > 1 and span * fanout <= max(block, fanout):
        total, span, levels = -(-total // fanout), span * fanout, levels + 1
    return levels, total


def span(fanout: int, block: int) -> int:
    """The largest power of `fanout` that a block holds; at least one run."""
    out = fanout
    while out * fanout <= block:
        out *= fanout
    return out


def sweep(first: int, digests: Sequence[str], levels: int, fanout: int
          ) -> tuple[list[str], list[tuple[int, int, list[str]]]]:
    """Nodes `first`, `first + 1`, ... climb `levels` levels: what is left, and every run of children
    as (level, place of the first child, digests), by ascending label."""
    queue = [(0, first + i, d) for i, d in enumerate(digests)]  # ascending, so a heap
    runs = []
    while queue and queue[0][0] < levels:
        level, start, _ = queue[0]
        parent = start // fanout
        children = []
        while queue and queue[0][:2] < (level, (parent + 1) * fanout):
            children.append(heapq.heappop(queue)[2])
        runs.append((level, start, children))
        heapq.heappush(queue, (level + 1, parent, joined(children)))
    return [heapq.heappop(queue)[2] for _ in range(len(queue))], runs


def proofs(runs: list[tuple[int, int, list[str]]], levels: int, fanout: int, suffix: str,
           ) -> dict[int, str]:
    """The proof of every node at level 0 of one block, whose highest node has the proof `suffix`."""
    at = {(levels, runs[-1][1] // fanout): suffix}
    for level, start, children in reversed(runs):
        above = at.pop((level + 1, start // fanout))
        for i in range(len(children)):
            at[level, start + i] = "".join(children[:i] + children[i + 1:]) + above
    return {place: proof for (_, place), proof in at.items()}


def climb(nodes: DataFrame, fanout: int, block: int) -> list[DataFrame]:
    """The nodes (tree, position, total, digest) of every round, the last with one per tree."""
    wide = span(fanout, block)

    def up(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        levels, total = _levels(table.column("total")[0].as_py(), fanout, block)
        left, _ = sweep(table.column("position")[0].as_py(), table.column("digest").to_pylist(),
                        levels, fanout)
        return pa.table({"tree": [key[0].as_py()], "position": [key[1].as_py()], "total": [total],
                         "digest": left})

    rounds = [nodes]
    while rounds[-1].filter("total > 1").limit(1).count():
        dealt = rounds[-1].select("tree", "position", "total", "digest",
                                  F.expr(f"position div {wide}").alias("block"))
        rounds.append(stored(dealt.groupBy("tree", "block").applyInArrow(
            up, "tree string, position long, total long, digest string"), "climbed"))
    return rounds


def descend(rounds: list[DataFrame], crown: DataFrame, fanout: int, block: int) -> DataFrame:
    """The nodes of the first round with the `proof` and the other columns that `crown` has for each
    tree (tree, position 0, proof, *_CROWN)."""
    wide = span(fanout, block)
    for lower in reversed(rounds[:-1]):
        schema = lower.withColumns({"proof": F.lit("")}).schema
        for c in _CROWN:
            schema = schema.add(crown.schema[c])

        def down(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
            table = table.sort_by("position")
            place = table.column("position").to_pylist()
            levels, _ = _levels(table.column("total")[0].as_py(), fanout, block)
            if levels:
                _, runs = sweep(place[0], table.column("digest").to_pylist(), levels, fanout)
                found = proofs(runs, levels, fanout, above.column("proof")[0].as_py())
                proof = [found[p] for p in place]
            else:
                proof = above.column("proof").to_pylist()
            table = table.drop(["block"]).append_column("proof", pa.array(proof, pa.string()))
            for c in _CROWN:
                kind = above.schema.field(c).type
                table = table.append_column(c, pa.array([above.column(c)[0].as_py()] * len(place), kind))
            return table

        blocks = lower.withColumn("block", F.expr(f"position div {wide}")).groupBy("tree", "block")
        named = crown.select("tree", F.col("position").alias("block"), "proof", *_CROWN)
        crown = blocks.cogroup(named.groupBy("tree", "block")).applyInArrow(down, schema)
    return crown


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "lang", order: str = "doc_id",
             fanout: int = 2, block: int = BLOCK, extra: Sequence[Column] = ()) -> DataFrame:
    """A row for every row of `docs`: its leaf, the roots of its tree and of all trees, and its proof.

    `tree` names the value of `key` (null is empty, others begin with `=`), `position` and `total`
    place the leaf in it, `rank` and `trees` place the tree among all; `proof` holds the hex digests of
    its siblings one after another. `extra` columns of `docs` are kept.
    """
    leaves = stored(docs.select(tree_key(F.col(key).cast("string")).alias("tree"), F.col(order).alias("doc_id"),
                                leaf([F.col(f) for f in fields]).alias("digest"), *extra), "leaves")
    low = climb(numbered(leaves, ("doc_id", "digest")), fanout, block)
    tops = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    high = climb(stored(numbered(tops, ("name",)), "subroots"), fanout, block)
    peak = high[-1].select("tree", "position", F.lit("").alias("proof"), F.lit("").alias("subroot"),
                           F.col("digest").alias("root"), F.lit(0).cast("long").alias("rank"),
                           F.lit(0).cast("long").alias("trees"))
    if len(high) > 1:
        named = descend(high, peak, fanout, block).select(
            F.col("name").alias("tree"), F.lit(0).cast("long").alias("position"), "proof",
            F.col("digest").alias("subroot"), "root", F.col("position").alias("rank"),
            F.col("total").alias("trees"))
    else:  # at most one tree: its root is the root of all
        named = tops.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("position"),
                            F.lit("").alias("proof"), F.col("digest").alias("subroot"),
                            F.col("digest").alias("root"), F.lit(0).cast("long").alias("rank"),
                            F.lit(1).cast("long").alias("trees"))
    if len(low) > 1:
        return descend(low, stored(named, "crown"), fanout, block)
    return low[0].join(named.drop("position"), "tree")  # no tree has a second leaf


def fold(digest: str, path: Sequence[tuple[int, int]], proof: str, fanout: int = 2) -> str:
    """The root that `digest` leads to: `path` has its (place, nodes) in its tree and in the next."""
    at = 0
    for place, total in path:
        while total > 1:
            start = place // fanout * fanout
            others = min(fanout, total - start) - 1
            run = [proof[at + _HEX * i:at + _HEX * (i + 1)] for i in range(others)]
            run.insert(place - start, digest)
            digest, at = joined(run), at + _HEX * others
            place, total = place // fanout, -(-total // fanout)
    return digest


def verified(rows: DataFrame, digest: str = "digest", fanout: int = 2) -> DataFrame:
    """`rows` of a manifest with `folded_root`, from column `digest` and the proof, and whether it is
    the root."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (digest, "position", "total", "rank", "trees", "proof")
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in names]
            roots = [fold(d, ((p, n), (r, t)), proof, fanout)
                     for d, p, n, r, t, proof in zip(*values, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())],
                                             [*columns, "folded_root"])

    return rows.mapInArrow(run, rows.withColumn("folded_root", F.lit("")).schema).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of `docs`, folded again after every seventh n_chars (by crc32) was raised by one."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col(f) + F.when(hit, 1).otherwise(0) if f == "n_chars" else F.col(f) for f in FIELDS]
    rows = manifest(docs, extra=[F.when(hit, leaf(changed)).alias("tampered")])
    seen = rows.withColumn("seen", F.coalesce("tampered", "digest"))
    return verified(seen, "seen").select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


#: The same rows in DuckDB, level by level.
SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, n_chars, text, source,
    list_reduce(list_prepend(4294967295::BIGINT, range(8 * len(doc_id::VARCHAR))), lambda c, i:
      CASE WHEN (xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT
                        ELSE 0::BIGINT END)) & 1 = 1
      THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT
                      ELSE 0::BIGINT END) >> 1, 3988292384::BIGINT)
      ELSE xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT
                  ELSE 0::BIGINT END) >> 1 END) AS crc
  FROM documents),
h AS (
  SELECT rid, doc_id, lang, xor(crc, 4294967295::BIGINT) % 7 = 0 AS hit,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head, n_chars,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM d),
l AS (
  SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail)
    END AS tampered FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS total FROM l),
n AS (SELECT lang, 0 AS level, pos, leaf AS d, total FROM p
      UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (max(total) + 1) // 2
      FROM n WHERE total > 1 GROUP BY lang, level, pos // 2),
s AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS total
      FROM n WHERE total = 1),
r AS (SELECT 0 AS level, rank AS pos, subroot AS d, total FROM s
      UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (max(total) + 1) // 2
      FROM r WHERE total > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT p.rid, own.level AS step, own.pos % 2 = 1 AS odd, o.d AS sibling FROM p
  JOIN n own ON own.lang IS NOT DISTINCT FROM p.lang AND own.pos = p.pos >> own.level AND own.total > 1
  LEFT JOIN n o ON o.lang IS NOT DISTINCT FROM p.lang AND o.level = own.level AND o.pos = xor(own.pos, 1)
  UNION ALL
  SELECT p.rid, 1000 + own.level, own.pos % 2 = 1, o.d FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang
  JOIN r own ON own.pos = s.rank >> own.level AND own.total > 1
  LEFT JOIN r o ON o.level = own.level AND o.pos = xor(own.pos, 1)),
q AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY step) AS k FROM steps),
proof AS (SELECT rid, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof, max(k) AS k FROM q GROUP BY rid),
f AS (SELECT rid, 0 AS k, coalesce(tampered, leaf) AS d FROM p
      UNION ALL SELECT f.rid, f.k + 1, sha256(CASE WHEN odd THEN coalesce(sibling, '') || d ELSE d || coalesce(sibling, '') END)
      FROM f JOIN q ON q.rid = f.rid AND q.k = f.k + 1)
SELECT p.doc_id, p.leaf, s.subroot, (SELECT max(d) FROM r WHERE total = 1) AS root,
  coalesce(proof.proof, sha256('')) AS proof_sha256, f.d AS folded_root,
  f.d = (SELECT max(d) FROM r WHERE total = 1) AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN proof ON proof.rid = p.rid
JOIN f ON f.rid = p.rid AND f.k = coalesce(proof.k, 0)"""
