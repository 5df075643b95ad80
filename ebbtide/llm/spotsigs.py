"""Document fingerprints by SpotSigs.

A spot is a common word (an anchor) together with the next `CHAIN` content words after it, content
words being those outside a list of common words; its hash is one signature. One content word in
`LOCAL`, chosen by its hash, opens a spot too, so texts in which common words are few or of other
languages have local signatures as well. Words are taken without the punctuation around them, but a
text of nothing else keeps it. A fingerprint is the
set of a text's signatures, preceded by the partition of its size: partitions are so wide that
sets of similarity `tau` or more lie in the same or adjacent ones. Two fingerprints are compared
by the Jaccard similarity of their sets, which the ratio of sizes bounds from above.

`next_texts` pairs every document with the one of the next lower id: documents are dealt into
ranges of ids, and only the document on a border of two ranges is sent to both.

Defined results: null and empty texts have the empty set; a text without a spot has
its runs of five words as signatures, or all its words where they are fewer; two empty sets have similarity 1, an empty and another set 0; rows of
one doc_id follow each other in the order of their texts; a single document is its own successor;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import U, Words, chunks, mix, shingles, word_hash

#: Common words of four languages; the first of each line open a spot.
ANCHORS = ("a an the is was of that", "le la les un une est de", "der die das ein eine ist zu",
           "el la los un una es de")
COMMON = ("and to in for with by on as at be it this are from or",
          "et des du en que qui pour dans par sur pas plus au aux ou",
          "und den dem von mit sich auf nicht im auch es an als",
          "y en que del las por con para se no al su lo")
CHAIN = 2
LOCAL = 4
TAU = 0.75
RANGE_ROWS, MOST_RANGES = 2000, 8192


def _hashes(lines: tuple[str, ...]) -> np.ndarray:
    return np.unique(np.array([word_hash(w) for line in lines for w in line.split()], U))


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def bare(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bytes with spaces instead of the punctuation before and after words.

    Beyond ASCII, U+0080 to U+00BF, U+2000 to U+203F and U+3000 to U+303F count as punctuation. A text
    without any other character stays as it is.
    """
    if not len(raw):
        return raw
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    loose = space | _PUNCTUATION[raw]
    follows = (raw[1:] & 0xC0) == 0x80
    two = np.flatnonzero((raw[:-1] == 0xC2) & follows)
    loose[two] = loose[two + 1] = True
    three = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80)
                           | (raw[:-2] == 0xE3) & (raw[1:-1] == 0x80))
    for k in range(3):
        loose[three + k] = True
    # Runs of such bytes that hold a space or touch the border of a text lie outside words.
    new = np.ones(len(raw), bool)
    new[1:] = loose[1:] != loose[:-1]
    inner = offs[(offs > 0) & (offs < len(raw))]
    new[inner] = True
    start = np.flatnonzero(new)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    end = np.append(start[1:], len(raw))
    outside = loose[start] & (np.logical_or.reduceat(space, start) | edge[start] | edge[end])
    some = np.concatenate([[0], np.cumsum(~loose)])
    wordless = np.repeat(some[offs[1:]] == some[offs[:-1]], np.diff(offs))
    out = raw.copy()
    out[np.repeat(outside, end - start) & ~wordless] = 32
    return out


def signatures(words: Words, anchors: np.ndarray, common: np.ndarray, chain: int = CHAIN
               ) -> list[np.ndarray]:
    """The sorted set of 32-bit signatures of each text."""
    h, at = words.hash, words.at
    texts = len(at) - 1
    owner = np.repeat(np.arange(texts), np.diff(at))
    content = np.flatnonzero(~np.isin(h, common))
    chosen = content[mix(h[content]) % U(LOCAL) == 0]
    spots = np.union1d(np.flatnonzero(np.isin(h, anchors)), chosen)
    first = np.searchsorted(content, spots, "right")
    fits = first + chain <= len(content)
    spots, first = spots[fits], first[fits]
    value = h[spots].copy()
    inside = np.ones(len(spots), bool)
    for k in range(chain):
        c = content[first + k]
        value = mix(value ^ (h[c] + U(k + 1)))
        inside &= owner[c] == owner[spots]
    key = np.unique((owner[spots[inside]].astype(U) << U(32)) | (value[inside] >> U(32)))
    split = np.searchsorted(key, np.arange(texts + 1).astype(U) << U(32))
    low = (key & U(0xFFFFFFFF)).astype(np.uint32)
    out = []
    for i in range(texts):
        mine = low[split[i]:split[i + 1]]
        if not len(mine) and at[i + 1] > at[i]:
            whole, _ = shingles(h[at[i]:at[i + 1]], np.array([0, at[i + 1] - at[i]]),
                                max(1, min(5, int(at[i + 1] - at[i]))))
            mine = np.unique((mix(whole) >> U(32)).astype(np.uint32))
        out.append(mine)
    return out


def partition(size: int, tau: float = TAU) -> int:
    """Sets of similarity `tau` or more have sizes in the same or adjacent partitions."""
    return 0 if size == 0 else 1 + math.floor(math.log(size) / -math.log(tau) + 1e-9)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity, or 0 where the sizes alone show that it is below `least`."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small < least * large or small == 0:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (small + large - common)


def fingerprint(signs: np.ndarray) -> str:
    """Partition, and the sorted signatures in hexadecimal."""
    return f"{partition(len(signs))}:{signs.astype('>u4').tobytes().hex()}"


def next_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the next document by falling doc_id."""
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_at"), "doc_id",
                       F.coalesce("text", F.lit("")).alias("text"))
    count, top = rows.agg(F.count(F.lit(1)), F.max("_at")).first()
    ranges = min(MOST_RANGES, max(1, -(-count // RANGE_ROWS)))
    cuts: list[int] = []
    if ranges > 1:
        found = rows.agg(F.percentile_approx("_at", [i / ranges for i in range(1, ranges)],
                                             F.lit(max(10_000, 8 * ranges)))).first()[0]
        cuts = sorted({x for x in found if x < top})
    # Range b holds the ids above cut b - 1 up to cut b. The id on a cut is also the successor of
    # the range above it; the highest id is the successor of the lowest range.
    own = F.expr(_search(cuts))
    place = lambda at, guest: F.struct(at.alias("_range"), F.lit(guest).alias("_guest"))
    places = F.array(place(own, 0), F.when(F.col("_at").isin(cuts), place(own + 1, 1)),
                     F.when(F.col("_at") == F.lit(top), place(F.lit(0), 1)))
    dealt = rows.withColumn("_p", F.explode(places)).filter("_p is not null").select(
        "_at", "doc_id", "text", "_p.*")
    order = Window.partitionBy("_range").orderBy("_guest", F.desc("_at"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).filter("_guest = 0").select(
        "doc_id", "text", "next_text")


def _search(cuts: list[int]) -> str:
    """SQL for the number of cuts below `_at`, as nested comparisons of logarithmic depth."""
    def node(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(_at > {cuts[mid]}L, {node(mid + 1, hi)}, {node(lo, mid)})"

    return node(0, len(cuts))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, of its edited text, and their similarities.

    The edited text has its last third replaced by as much of the next document's beginning.
    """
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = next_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(
        "doc_id", "n_chars", "text", "next_text", F.concat(
            F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - third),
            F.col("next_text").substr(F.lit(1), third)).alias("edited")).withColumn(
        "edited_sha256", F.sha2(F.col("edited"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, common = _hashes(ANCHORS), _hashes(ANCHORS + COMMON)
        for batch in batches:
            # The next text of a row is mostly the text of the row after it: each is read once.
            coded = pa.chunked_array([batch.column(c) for c in ("text", "edited", "next_text")]
                                     ).combine_chunks()
            coded = coded.dictionary_encode()
            signs: list[np.ndarray] = []
            for _, _, raw, offs in chunks(coded.dictionary):
                signs += signatures(Words(bare(raw, offs), offs), anchors, common)
            text, edited, after = np.split(coded.indices.to_numpy(zero_copy_only=False), 3)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_chars"), batch.column("edited_sha256"),
                pa.array([fingerprint(signs[i]) for i in text], pa.string()),
                pa.array([fingerprint(signs[i]) for i in edited], pa.string()),
                pa.array([likeness(signs[i], signs[j]) for i, j in zip(text, edited, strict=True)],
                         pa.float64()),
                pa.array([likeness(signs[i], signs[j]) for i, j in zip(text, after, strict=True)],
                         pa.float64())], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, "
                                "fingerprint string, edited_fingerprint string, "
                                "near_edited double, near_next double")


def sets(docs: DataFrame) -> DataFrame:
    """doc_id and its set of signatures, as a sorted array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, common = _hashes(ANCHORS), _hashes(ANCHORS + COMMON)
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column("text")):
                signs = signatures(Words(bare(raw, offs), offs), anchors, common)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([s.astype(np.int64) for s in signs], pa.list_(pa.int64()))],
                    ["doc_id", "signs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, signs array<long>")


def near(docs: DataFrame, tau: float = TAU) -> DataFrame:
    """Classes of documents with equal fingerprints and the links between them.

    Rows are (doc_id, class_id, links): links counts the other classes of similarity `tau` or
    more. Within a partition and the next one, sets meet in a signature of their prefixes - the
    rarest ones, so many that similar sets share one - and are compared in full.
    """
    fp = sets(docs).filter(F.size("signs") > 0)
    classes = fp.groupBy("signs").agg(F.min("doc_id").alias("class_id"))
    common = classes.select(F.explode("signs").alias("s")).groupBy("s").agg(
        F.count(F.lit(1)).alias("n"))
    tagged = classes.select("class_id", F.size("signs").alias("size"), F.explode("signs").alias("s"))
    rank = Window.partitionBy("class_id").orderBy("n", "s")
    log = F.floor(F.log(F.col("size").cast("double")) / -math.log(tau) + 1e-9).cast("int")
    heads = tagged.join(common, "s").withColumn("r", F.row_number().over(rank)).filter(
        F.col("r") <= F.col("size") - F.ceil(tau * F.col("size") - 1e-9) + 1).select(
        "class_id", "size", "s", log.alias("part"))
    lower = heads.select(F.col("class_id").alias("a"), F.col("size").alias("na"), "s", "part")
    upper = heads.select(F.col("class_id").alias("b"), F.col("size").alias("nb"), "s",
                         F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    # Equal partitions meet once, from the smaller id; adjacent ones from the smaller partition.
    inner = (F.col("na") <= F.col("nb")) & (F.col("na") >= tau * F.col("nb")) & (
        F.col("a") != F.col("b")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = lower.join(upper, ["s", "part"]).filter(inner).select("a", "b").distinct()
    full = classes.select(F.col("class_id").alias("a"), F.col("signs").alias("sa"))
    other = classes.select(F.col("class_id").alias("b"), F.col("signs").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = pairs.join(full, "a").join(other, "b").filter(
        both >= tau * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    degree = linked.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy(
        "class_id").agg(F.count(F.lit(1)).alias("links"))
    return fp.join(classes, "signs").select("doc_id", "class_id").join(
        degree, "class_id", "left").select("doc_id", "class_id",
                                           F.coalesce("links", F.lit(0)).alias("links"))
