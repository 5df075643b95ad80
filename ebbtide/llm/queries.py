"""Named queries of the package, one per operator, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import (align, bpe, licenses, lm, merkle, mixing, near, passages, quality, reshard, spotsigs,
               urls, wfst)
from .common import table

SHARDS = 24


def op1_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    """SpotSigs fingerprints of all documents and of their edited texts."""
    return spotsigs.fingerprints(table(prepare(spark), folder, "documents"))


def op2_min_cost_flow_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents from shards by source to 24 shards of near equal bytes."""
    docs = table(prepare(spark), folder, "documents")
    return reshard.reshard(docs, SHARDS, F.col("source")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "old_shard")


def op3_path_template_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page by rule, or by the labelled purity of its path template."""
    pages, labels = (table(prepare(spark), folder, t) for t in ("pages", "labels"))
    return urls.judge(pages, urls.labels_by_number(pages, labels))


def op4_sentencepiece_transducer(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as piece ids by shortest path, decoded again."""
    return wfst.encoded(table(prepare(spark), folder, "documents"))


def op5_cube_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to source weights by balanced sampling."""
    return mixing.draw(table(prepare(spark), folder, "documents")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "source")


def op6_chosen_path_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near.classes(table(prepare(spark), folder, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept", "class_id")


def op7_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules and robust outliers by language and source."""
    return quality.judge(table(prepare(spark), folder, "documents"))


def op8_pitman_yor_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probabilities of all documents, learnt from four fifths of them."""
    return lm.score(table(prepare(spark), folder, "documents"))


def op9_compact_window_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that several documents share."""
    return passages.repeats(table(prepare(spark), folder, "documents"))


def op10_license_windows(spark: SparkSession, folder: str) -> DataFrame:
    """License templates in windows of all documents."""
    return licenses.scan(table(prepare(spark), folder, "documents"))


def op11_space_anchor_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Token groups and links between two vocabularies over all documents."""
    return align.report(table(prepare(spark), folder, "documents"))


def op12_time_forward_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle manifest of all documents with proofs, checked against tampered rows."""
    return merkle.audit(table(prepare(spark), folder, "documents"))


def op13_speculative_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as byte-level BPE ids and decoded again."""
    return bpe.digests(table(prepare(spark), folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_spotsigs, op2_min_cost_flow_resharding, op3_path_template_filter,
        op4_sentencepiece_transducer, op5_cube_mixing, op6_chosen_path_near_dedup,
        op7_robust_outliers, op8_pitman_yor_scores, op9_compact_window_passages,
        op10_license_windows, op11_space_anchor_alignment, op12_time_forward_merkle,
        op13_speculative_bpe)}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Independent texts for DuckDB, where SQL can express the result.
SQL: dict[str, str] = {
    "op12_time_forward_merkle": merkle.SQL,
    "op6_chosen_path_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_LETTERS}',
    '{_LETTERS.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents
          UNION SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON reach.id = both_ways.a),
k AS (SELECT s.a AS doc_id, min(s.b) AS class_id FROM (
  SELECT x.doc_id AS a, y.doc_id AS b FROM (SELECT doc_id, list(s ORDER BY s) AS z FROM s GROUP BY 1) x
  JOIN (SELECT doc_id, list(s ORDER BY s) AS z FROM s GROUP BY 1) y ON x.z = y.z) s GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept,
  coalesce(k.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) m ON m.id = d.doc_id""",
}
