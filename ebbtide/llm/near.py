"""MinHash near-dedup by a chosen-path set similarity join.

Documents with equal shingle sets are one class; one representative goes on. Each of `TREES`
independent trees puts the representatives into nodes by one min-wise coordinate. The members of a
small node are compared with each other. In a larger one all members are first compared with a
leader, the member that shares most min-wise values with the others, which joins a group of copies
without forming its pairs. The nodes of one leader form a cluster, and where a cluster is not
connected by then, its members outside the main group are compared with all others: up to
`BRANCH_ABOVE` members exhaustively in blocks, beyond by branching the cluster again, `BRANCHES`
coordinates sending every member into as many child nodes, `LEVELS` times at most before the
blocks. A pair of similarity 0.75 meets in a node with probability 0.75 a tree or branch, so it is
missed by all trees with a probability below 1e-7, and by a branching with one of 2e-5.

Pairs of small nodes and leaders are first read from the signatures; those that agree in `LEAST`
of `COORDINATES` or more are confirmed on the full sets (a pair of similarity 0.75 agrees in fewer
with a probability of 3e-4). Blocks compare full sets by a matrix product and return components,
never pairs.

Hot nodes are counted and given their leader by sums combined before the shuffle, and their
members meet the leader in a join that adaptive execution splits. Texts are read once for
signatures, and those of candidates once more.

Defined results: null, empty and blank texts have an empty set and stay alone; fewer than five
words are one shingle; rows of one doc_id are one document, its set that of the row with the
least set hash; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused
from .links import components
from .tokens import U, Words, chunks, distinct, mix, shingles

SHINGLE, PERCENT = 5, 75
TREES, COORDINATES, LEAST = 12, 64, 36
SMALL, LEVELS, BRANCHES = 12, 3, 8
#: Clusters beyond this size branch on; parts of a block, and columns of its matrix at a time.
BRANCH_ABOVE, BLOCK, COLUMNS = 20_000, 700, 4096
_rng = np.random.default_rng(20_240_229)
_FACTOR = (_rng.integers(0, 1 << 32, COORDINATES, np.uint32) | np.uint32(1))
_SHIFT = _rng.integers(0, 1 << 32, COORDINATES, np.uint32)


def shingle_sets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of word shingles, sorted, and the borders between texts."""
    words = Words(raw, offs)
    return distinct(*shingles(words.hash, words.at, SHINGLE))


def signature(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The min-wise values of every set, one row per text; empty sets give zeros."""
    some = np.diff(at) > 0
    out = np.zeros((len(at) - 1, COORDINATES), np.uint32)
    if len(sets):
        short = (mix(sets) >> U(32)).astype(np.uint32)
        starts = at[:-1][some]
        for k in range(COORDINATES):
            out[some, k] = np.minimum.reduceat(short * _FACTOR[k] + _SHIFT[k], starts)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two order-free hashes of the set, and its signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column("text")):
                sets, at = shingle_sets(raw, offs)
                n = np.diff(at)
                sums = []
                for salt in (U(1), U(0x5851F42D4C957F2D)):
                    total = np.zeros(len(sets) + 1, U)
                    np.cumsum(mix(sets ^ salt), out=total[1:])
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                signs = signature(sets, at).view(np.int32).reshape(-1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(n), *map(pa.array, sums),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32)
                                                      * COORDINATES), pa.array(signs))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, signs array<int>")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have PERCENT per cent or more in common."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                coded = pa.chunked_array([part.column("_ta"), part.column("_tb")]
                                         ).combine_chunks().dictionary_encode()
                sets: list[np.ndarray] = []
                for _, _, raw, offs in chunks(coded.dictionary):
                    values, at = shingle_sets(raw, offs)
                    sets += np.split(values, at[1:-1])
                ia, ib = np.split(coded.indices.to_numpy(zero_copy_only=False), 2)
                keep = []
                for x, y in zip(ia, ib, strict=True):
                    same = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(same > 0 and 100 * same >= PERCENT * (
                        len(sets[x]) + len(sets[y]) - same))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb").mapInArrow(
        run, "a long, b long")


def _agree() -> Column:
    """Whether two signatures agree in LEAST coordinates or more."""
    same = F.zip_with("signs", "other_signs", lambda x, y: x == y)
    return F.size(F.filter(same, lambda equal: equal)) >= LEAST


def _popularity(members: DataFrame, reps: DataFrame) -> DataFrame:
    """How many members share a document's min-wise values, over all coordinates.

    The text that copies were made from has more in common with them than they among themselves.
    """
    values = reps.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", F.posexplode("signs").alias("_k", "_v"))
    often = values.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return values.join(often, ["_k", "_v"]).groupBy("doc_id").agg(F.sum("_n").alias("popularity"))


def _deal(clusters: DataFrame) -> DataFrame:
    """Deal the members (leader, doc_id, outside, n_out, n_main) of clusters into blocks (leader,
    i, j) so that a member outside the main group meets every other member in some block.

    Members of the main group, which are connected already, are only dealt to meet the others.
    """
    ceil = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    place = F.when(F.col("outside"), F.pmod(F.xxhash64("doc_id"), F.col("_out"))).otherwise(
        F.col("_out") + F.pmod(F.xxhash64("doc_id"), F.col("_main")))
    # Who stands outside meets all parts, the main group meets the parts outside; a part is
    # compared in itself whenever it meets another.
    meets = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("_out") + F.col("_main") - 1)
                   ).otherwise(F.sequence(F.lit(0), F.col("_out") - 1))
    return clusters.withColumn("_out", ceil(F.col("n_out"))).withColumn(
        "_main", F.when(F.col("n_main") > 0, ceil(F.col("n_main"))).otherwise(F.lit(0))).withColumn(
        "_at", place.cast("int")).select(
        "leader", "doc_id", "_at", F.explode(F.filter(meets, lambda k: (k != F.col("_at")) | (
            F.col("_out") + F.col("_main") == 1))).alias("_with")).select(
        "leader", "doc_id", F.least("_at", "_with").alias("i"), F.greatest("_at", "_with").alias("j"))


def _connected(block: pa.Table) -> pa.Table:
    """The confirmed components of one block, each as links to its first member.

    The sizes of all intersections are one product of the matrix of members and shingles, taken
    over a bounded number of the shingles that several members have at a time.
    """
    ids = block.column("doc_id").to_numpy()
    texts = block.column("text").combine_chunks()
    sets: list[np.ndarray] = []
    for _, _, raw, offs in chunks(texts if isinstance(texts, pa.Array) else texts.chunk(0)):
        values, at = shingle_sets(raw, offs)
        sets += np.split(values, at[1:-1])
    n = len(ids)
    size = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    owner = np.repeat(np.arange(n), size)[shared[column]]
    column = (np.cumsum(shared) - 1)[column[shared[column]]]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        inside = (column >= lo) & (column < lo + COLUMNS)
        member = np.zeros((n, COLUMNS), np.float32)
        member[owner[inside], column[inside] - lo] = 1
        both += member @ member.T
    linked = (100 * both >= PERCENT * (size[:, None] + size[None, :] - both)) & (both > 0)
    first = np.arange(n)
    while True:
        lower = np.minimum(first, np.where(linked, first[None, :], n).min(1, initial=n))
        if (lower == first).all():
            break
        first = lower
    other = np.flatnonzero(first != np.arange(n))
    a, b = ids[other], ids[first[other]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)},
                    schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def links(reps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Confirmed links (a, b) that connect all similar representatives (doc_id, signs).

    Two similar documents may be connected over others instead of by a link of their own. None
    stands for no link.
    """
    rows = reps.select("doc_id", F.posexplode(F.slice("signs", 1, TREES)).alias("_t", "_v")).select(
        "doc_id", F.xxhash64("_t", "_v").alias("node"), F.col("doc_id").alias("component"))
    edges: DataFrame | None = None
    texts: DataFrame | None = None
    popular: DataFrame | None = None
    for level in range(LEVELS + 1):
        # Nodes whose members are all connected are done.
        share = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("_n"))
        nodes = share.groupBy("node").agg(
            F.sum("_n").alias("_members"), F.count(F.lit(1)).alias("_groups")).filter(
            "_groups > 1").drop("_groups")
        open_ = stored(rows.join(nodes, "node").join(reps, "doc_id"), "nodes")
        large = open_.filter(F.col("_members") > SMALL)
        some = not large.isEmpty()
        small = open_.filter(F.col("_members") <= SMALL)
        other = small.select("node", F.col("doc_id").alias("other"), F.col("signs").alias(
            "other_signs"), F.col("component").alias("_other_group"))
        pairs = small.join(other, (small["node"] == other["node"]) & (
            F.col("doc_id") < F.col("other")) & (F.col("component") != F.col("_other_group"))
            & _agree()).select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
        if some:
            if popular is None:
                popular = stored(_popularity(large, reps), "popularity")
            leaders = large.join(popular, "doc_id", "left").groupBy("node").agg(F.max(F.struct(
                F.coalesce("popularity", F.lit(0)), F.xxhash64("doc_id"),
                F.col("doc_id").alias("leader")))["leader"].alias("leader"))
            led = leaders.join(reps.select(
                F.col("doc_id").alias("leader"), F.col("signs").alias("other_signs")), "leader")
            pairs = pairs.union(large.join(led, (large["node"] == led["node"]) & (
                F.col("doc_id") != F.col("leader")) & _agree()).select(
                F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")))
        alike = stored(pairs.distinct(), "alike")
        if texts is None:
            wanted = alike.select(F.explode(F.array("a", "b")).alias("doc_id")).union(
                large.select("doc_id")).distinct()
            texts = stored(docs.select("doc_id", "text").join(
                wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
        found = stored(confirmed(alike, texts), "found")
        if not found.isEmpty():
            edges = found if edges is None else edges.union(found)
        if not some:
            return edges
        # Nodes of one leader, mostly those of the same copies in several trees, are one cluster;
        # later the nodes of a cluster stay apart, as its branches are its trees.
        led_by = large.withColumnRenamed("node", "leader").select("leader", "doc_id") if level else (
            large.join(leaders, "node").select("leader", "doc_id").distinct())
        if edges is None:
            named = led_by.withColumn("component", F.col("doc_id"))
        else:
            named = led_by.join(components(edges).withColumnRenamed("id", "doc_id"), "doc_id",
                                "left").withColumn("component", F.coalesce("component", "doc_id"))
        named = stored(named, "clusters")
        groups = named.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("n")).groupBy(
            "leader").agg(F.count(F.lit(1)).alias("_groups"), F.sum("n").alias("_all"), F.max(
                F.struct("n", "component")).alias("_m")).filter("_groups > 1").select(
            "leader", "_all", F.col("_m.component").alias("_main_group"),
            F.col("_m.n").alias("n_main"), (F.col("_all") - F.col("_m.n")).alias("n_out"))
        open_clusters = named.join(groups, "leader").withColumn(
            "outside", F.col("component") != F.col("_main_group"))
        deep = open_clusters.filter(F.lit(level < LEVELS) & (F.col("_all") > BRANCH_ABOVE))
        dealt = _deal(open_clusters.filter(F.lit(level == LEVELS) | (F.col("_all") <= BRANCH_ABOVE)))
        exact = stored(dealt.join(texts, "doc_id").groupBy("leader", "i", "j").applyInArrow(
            _connected, "a long, b long"), "exact")
        if not exact.isEmpty():
            edges = exact if edges is None else edges.union(exact)
        if deep.isEmpty():
            return edges
        # Children: coordinates chosen for the node, so that all its members branch alike.
        picks = F.explode(F.array(*[F.lit(k) for k in range(BRANCHES)])).alias("_k")
        at = F.pmod(F.xxhash64("leader", "_k", F.lit(level)), F.lit(COORDINATES)).cast("int")
        rows = deep.join(reps, "doc_id").select(
            "leader", "doc_id", "component", "signs", picks).select("doc_id", F.xxhash64(
                "leader", "_k", F.get("signs", at)).alias("node"), "component")
    return edges


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (equal sets), component_id and kept of every document."""
    sk = stored(sketches(docs), "sketches")
    full = sk.filter("n_shingles > 0")
    key = ["set_a", "set_b", "n_shingles"]
    same = full.groupBy(*key).agg(F.min("doc_id").alias("class_id"))
    same = stored(same, "classes")
    reps = stored(full.join(same.select(F.col("class_id").alias("doc_id"), *key), ["doc_id", *key],
                            "left_semi").select("doc_id", "signs").dropDuplicates(["doc_id"]),
                  "representatives")
    joined = links(reps, docs)
    if joined is not None:
        labels = components(joined).withColumnRenamed("id", "class_id")
        same = same.join(labels, "class_id", "left")
    else:
        same = same.withColumn("component", F.lit(None).cast("long"))
    out = sk.select("doc_id", *key).join(same, key, "left").select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component, the one of the smallest doc_id.

    Rows without a doc_id cannot be named by a component and all stay as they are.
    """
    key, row = unused(docs, "_id", "_row")
    named = docs.filter(F.col("doc_id").isNotNull())
    kept = classes(named).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    # Of several rows of one doc_id the one that comes first by a hash of its values, in every run.
    whole = F.struct(*docs.columns)
    one = named.join(kept, F.col("doc_id") == F.col(key), "left_semi").groupBy("doc_id").agg(
        F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row)).select(f"{row}.*")
    return one.union(docs.filter(F.col("doc_id").isNull()))
