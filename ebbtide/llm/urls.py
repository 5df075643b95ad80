"""URL filters: fixed rules first, then a tree of path templates with labelled purity.

Every host has a tree of path segments. A segment becomes a wildcard when it is a number or a long
identifier, or when its parent has many children that hold few pages each. Sibling templates
that differ in one segment are merged while their rates of bad pages do not differ significantly.
A template is blocked when its rate of bad pages, smoothed towards the rate of all labelled
pages, reaches `reject`.

Only DataFrame functions run. Pages are first counted by host and path, so the tree is grown over
distinct paths, and every level is a grouped count combined before the shuffle: one host may hold
any share of the pages.

Defined results: a null url, or one without `://`, has an empty host and path and the template of
both; pages that share an id are judged each by itself; without labels nothing is blocked by the
tree; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (host, path, verdict): a rule holds for its host and all hosts under it.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MANY, FEW = 20, 3.0
SIMILAR = 1.96
STRENGTH, REJECT = 10.0, 0.5
_VARIABLE = r"^(\d+|[0-9a-fA-F-]{8,}|[^/]{40,})(\.[A-Za-z0-9]{1,5})?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    pick = lambda n: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", n)
    return ascii_lower(pick(1)), pick(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES
            ) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def grow(paths: DataFrame, many: int = MANY, few: float = FEW) -> DataFrame:
    """Add `template` to (host, path, pages): its segments, variable ones as wildcards.

    Every level is written, and paths that end there leave, so the plan stays short in deep trees.
    """
    pieces = F.split(F.col("path"), "/", -1)
    rows = stored(paths.withColumn("_seg", pieces).withColumn(
        "template", F.element_at("_seg", 1)), "level")
    out, k = None, 1
    while True:
        ended = rows.filter(F.size("_seg") <= k).drop("_seg")
        out = ended if out is None else out.union(ended)
        rows = rows.filter(F.size("_seg") > k)
        if rows.isEmpty():
            return out
        seg = F.get("_seg", F.lit(k))
        kids = rows.groupBy("host", "template", seg.alias("_s")).agg(F.sum("pages").alias("_n"))
        parents = kids.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("_kids"), F.sum("_n").alias("_pages"))
        ending = F.regexp_extract(seg, r"(\.[A-Za-z0-9]{1,5})$", 1)
        busy = (F.col("_kids") > many) & (F.col("_pages") < few * F.col("_kids"))
        wild = seg.rlike(_VARIABLE) | (busy & (F.length(seg) > 0))
        rows = stored(rows.join(parents, ["host", "template"]).withColumn(
            "template", F.concat("template", F.lit("/"), F.when(
                wild, F.concat(F.lit("*"), ending)).otherwise(seg))).select(*rows.columns), "level")
        k += 1


def merge(templates: DataFrame, prior: float = 0.0, similar: float = SIMILAR, rounds: int = 2
          ) -> DataFrame:
    """(host, template, labelled, bad) with `merged`, the template after its siblings joined.

    Siblings share all but their first literal segment, and form bands by a quarter of the rate of
    bad pages. Those of a band that lie within `similar` standard errors of the whole band take
    the common template, marked with the band.
    """
    rows = templates.withColumn("merged", F.col("template"))
    for _ in range(rounds):
        family = F.regexp_replace("merged", r"^((?:/\*[^/]*)*)/[^/*]+", "$1/*")
        own = rows.groupBy("host", family.alias("_family"), "merged").agg(
            F.sum("labelled").alias("_l"), F.sum("bad").alias("_b")).withColumn(
            "_band", F.floor(4 * (F.col("_b") + 2 * prior) / (F.col("_l") + 2)))
        all_ = own.groupBy("host", "_family", "_band").agg(
            F.sum("_l").alias("_al"), F.sum("_b").alias("_ab"), F.count(F.lit(1)).alias("_many"))
        rate = (F.col("_ab") + 2 * prior) / (F.col("_al") + 2)
        error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.01))
                       / F.greatest(F.col("_l"), F.lit(1)))
        near = (F.col("_l") == 0) | (
            F.abs(F.col("_b") / F.greatest(F.col("_l"), F.lit(1)) - rate) <= similar * error)
        decided = own.join(all_, ["host", "_family", "_band"]).select(
            "host", "merged", F.when(near & (F.col("_many") > 1), F.concat(
                "_family", F.lit("@"), F.col("_band").cast("string")))
            .otherwise(F.col("merged")).alias("_to"))
        rows = rows.join(decided, ["host", "merged"]).withColumn("merged", F.col("_to")).drop("_to")
    return rows


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          strength: float = STRENGTH, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and its smoothed rate of bad pages.

    `labelled` has page_id and bad (boolean); ids without a page are ignored.
    """
    host, path = split_url(F.col("url"))
    urls = stored(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    marks = labelled.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("_bad"))
    known = urls.join(marks, "page_id", "left")
    counted = known.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count("_bad").alias("labelled"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    trees = stored(grow(counted), "paths")
    seen, wrong = trees.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = wrong / seen if seen else 0.0
    kinds = stored(merge(trees.groupBy("host", "template").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), prior), "templates")
    pure = kinds.groupBy("host", "merged").agg(
        ((F.sum("bad") + strength * prior) / (F.sum("labelled") + strength)).alias("bad_rate"))
    by_path = trees.select("host", "path", "template").join(
        kinds.select("host", "template", "merged"), ["host", "template"]).join(
        pure, ["host", "merged"])
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return urls.join(by_path, ["host", "path"]).select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(
            F.col("bad_rate") >= reject, "block").otherwise("allow")).alias("verdict"),
        F.col("merged").alias("template"), F.round("bad_rate", 6).alias("bad_rate"))


def labels_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages whose path ends in a document number: bad where quality is 0."""
    number = F.regexp_extract(split_url(F.col("url"))[1], r"/(\d{1,18})(?:\.[a-z]+)?/?$", 1)
    named = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    return named.join(labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(
        F.min("quality").alias("quality")), "doc_id").select(
        "page_id", (F.col("quality") == 0).alias("bad"))
