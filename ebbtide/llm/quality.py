"""Quality rules: robust outliers among text statistics, by language and source.

Every text gives five transformed statistics. For each cell - a language and source, or its
language, or all texts where a cell has too few rows - location and scatter come from the minimum
covariance determinant: start from medians and median deviations, then alternate between the
three quarters of the cell nearest by Mahalanobis distance and the mean and covariance of those.
A text is rejected when its distance from its cell exceeds the cutoff.

Only DataFrame functions run. A cell is never gathered: its moments are sums combined before the
shuffle, and its quantiles come from counts in fixed bins, so one cell may hold any share of rows
and equal input gives equal bins whatever the partitioning.

Defined results: null text is empty; empty texts have zero statistics; null languages and sources
are cells of their own; rows with one doc_id are judged each by itself; an empty table gives an
empty result; other input columns are ignored. Scatter never falls below `FLOOR` per statistic, so
a statistic that is constant in a cell does not reject small deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, stored, unused, words

#: Smallest standard deviation that is believed, by statistic.
FLOOR = {"word_length": 0.10, "symbols": 0.03, "dup_lines": 0.15, "repeats": 0.08, "capitals": 0.06}
#: Share of a cell that the scatter is taken from.
NEAREST = 0.75
STEPS = 3
#: Cells below this many rows use those of their language, then of all texts.
MIN_CELL = 200
#: Squared distance above which a text is rejected: the 1 - 1e-8 quantile of chi-square(5).
CUTOFF = 46.0
MIN_WORDS, MAX_REPEAT = 50, 50

_D = list(FLOOR)


def _within(x: float, k: int) -> float:
    """The probability that chi-square of an odd number `k` of degrees lies below `x`."""
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    out = math.erf(math.sqrt(x / 2))
    for j in range(1, (k + 1) // 2):
        out -= term
        term *= x / (2 * j + 1)
    return out


def consistency(share: float, k: int) -> float:
    """What the scatter of the nearest `share` of normal rows in `k` (odd) dimensions must be multiplied
    by to be that of all: the share over that of chi-square(k + 2) below the same distance."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _within(middle, k) < share else (low, middle)
    return share / _within(low, k + 2)


CONSISTENCY = consistency(NEAREST, len(_D))
_BINS = 128  # a unit, in binned quantiles


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    def covered(marked: Column) -> Column:
        gaps = F.transform(marked, lambda x, j: F.least(
            F.lit(3), F.coalesce(F.get(marked, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def marked(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        hits = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
            let(pairs, lambda s: let(marked(s), covered)))

    grams = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(grams, count)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and, as longs, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines (lines with a word) and n_capitals (A-Z)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measure(w: Column) -> Column:
        return let(F.array_join(w, ""), lambda joined: let(lines, lambda ln: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.length(joined) - F.length(F.regexp_replace(joined, r"[#*$%&|<>]+", "")))
            .cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            (F.length(joined) - F.length(F.regexp_replace(joined, "[A-Z]+", "")))
            .cast("long").alias("n_capitals"))))

    return docs.select("doc_id", "lang", "source", _row_key().alias("row_key"),
                       let(words(text), measure).alias("_m")).select(
        "doc_id", "lang", "source", "row_key", "_m.*")


def _row_key() -> Column:
    """What `judge` sees of a row, as one number: rows of one key have one verdict."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
                        for c in ("doc_id", "lang", "source", "text")])


def _vector() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"word_length": F.log1p(share("word_chars", "n_words")),
            "symbols": F.sqrt(share("n_symbols", "word_chars")),
            "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"),
            "capitals": share("n_capitals", "word_chars")}


def _cells(stats: DataFrame, min_cell: int) -> DataFrame:
    """Add `cell`, the smallest of (lang, source), lang and all that has `min_cell` rows."""
    exact = F.to_json(F.struct(F.lit(2).alias("l"), "lang", "source"))
    lang = F.to_json(F.struct(F.lit(1).alias("l"), "lang"))
    keyed = stats.withColumn("_exact", exact).withColumn("_lang", lang)
    by_exact = keyed.groupBy("_exact", "_lang").agg(F.count(F.lit(1)).alias("_n"))
    by_lang = by_exact.groupBy("_lang").agg(F.sum("_n").alias("_nl"))
    names = by_exact.join(by_lang, "_lang").select(
        "_exact", F.when(F.col("_n") >= min_cell, F.col("_exact"))
        .when(F.col("_nl") >= min_cell, F.col("_lang")).otherwise(F.lit("all")).alias("cell"))
    return keyed.drop("_lang").join(names, "_exact").drop("_exact")


def _quantiles(rows: DataFrame, values: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row per cell: for each name the upper edge of the bin that reaches the share."""
    long = rows.select("cell", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.floor(v * _BINS).alias("b"), F.lit(p).alias("p"))
        for k, (v, p) in values.items()])).alias("s")).select("cell", "s.*")
    bins = long.groupBy("cell", "k", "p", "b").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("cell", "k")
    upto = inside.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    reached = bins.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "all", F.sum("n").over(inside)).filter(F.col("upto") >= F.col("p") * F.col("all"))
    return reached.groupBy("cell").agg(*[
        (F.min(F.when(F.col("k") == k, F.col("b") + 1)) / _BINS).alias(k) for k in values])


def _distance(est: Callable[[str], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    z: list[Column] = []
    for i, name in enumerate(_D):
        rest = F.col(name) - est(f"m{i}")
        for j in range(i):
            rest = rest - est(f"l{i}{j}") * z[j]
        z.append(rest / est(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _factor(moments: DataFrame) -> DataFrame:
    """Mean m0.. and Cholesky factor l00.. of the scatter, from the sums of each cell."""
    out = moments
    for i in range(len(_D)):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i, name in enumerate(_D):
        for j in range(i + 1):
            cov = CONSISTENCY * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + FLOOR[name] ** 2
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(1e-9))) if i == j
                                 else cov / F.col(f"l{j}{j}"))
    return out.select("cell", *_names())


def _names() -> list[str]:
    return ([f"m{i}" for i in range(len(_D))]
            + [f"l{i}{j}" for i in range(len(_D)) for j in range(i + 1)])


def _sums(rows: DataFrame) -> DataFrame:
    """What `_factor` needs of each cell."""
    return rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(_D)],
        *[F.sum(F.col(_D[i]) * F.col(_D[j])).alias(f"s{i}{j}")
          for i in range(len(_D)) for j in range(i + 1)])


def _started(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every cell once for each start, named `cell`#start, as rows and as first estimates: medians and
    absolute deviations, the moments of all rows, and those of the half nearest to the medians."""
    middle = _quantiles(rows, {name: (F.col(name), 0.5) for name in _D})
    near = rows.join(middle.select("cell", *[F.col(n).alias(f"_c{n}") for n in _D]), "cell")
    spread = _quantiles(near, {n: (F.abs(F.col(n) - F.col(f"_c{n}")), 0.5) for n in _D})
    first = stored(middle.join(spread.select("cell", *[F.col(n).alias(f"_w{n}") for n in _D]), "cell").select(
        "cell", *[F.col(n).alias(f"m{i}") for i, n in enumerate(_D)],
        *[(F.greatest(1.4826 * F.col(f"_w{_D[i]}"), F.lit(FLOOR[_D[i]])) if i == j
           else F.lit(0.0)).alias(f"l{i}{j}") for i in range(len(_D)) for j in range(i + 1)]), "mcd")
    boxed = rows.join(first, "cell").withColumn("_d", F.log1p(F.greatest(*[
        F.abs(F.col(n) - F.col(f"m{i}")) / F.col(f"l{i}{i}") for i, n in enumerate(_D)])))
    inner = boxed.join(_quantiles(boxed, {"_edge": (F.col("_d"), 0.5)}), "cell").filter("_d <= _edge")
    starts = [first, _factor(_sums(rows)), _factor(_sums(inner))]
    named = lambda k: F.concat(F.col("cell"), F.lit(f"#{k}"))
    est = reduce(DataFrame.unionByName, [e.withColumn("cell", named(k)) for k, e in enumerate(starts)])
    many = rows.select(F.explode(F.array(*[named(k) for k in range(len(starts))])).alias("cell"), *_D)
    return many, stored(est, "mcd")


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant location and Cholesky factor of each `cell` of `rows`.

    All starts of all cells take their steps together; of each cell the one whose scatter has the least
    determinant is kept, of equal ones the first.
    """
    many, est = _started(rows)
    for _ in range(steps):
        scored = many.join(est, "cell").withColumn("_d", F.log1p(_distance(F.col)))
        edge = _quantiles(scored, {"_edge": (F.col("_d"), NEAREST)})
        est = stored(_factor(_sums(scored.join(edge, "cell").filter(F.col("_d") <= F.col("_edge")))), "mcd")
    volume = sum((F.ln(f"l{i}{i}") for i in range(1, len(_D))), F.ln("l00"))
    best = est.groupBy(F.expr("substring_index(cell, '#', greatest(1, size(split(cell, '#', -1)) - 1))").alias(
        "_cell")).agg(F.min_by(F.struct(*_names()), F.struct(F.round(volume, 9), "cell")).alias("_e"))
    return stored(best.select(F.col("_cell").alias("cell"), "_e.*"), "mcd")


def judge(docs: DataFrame, min_cell: int = MIN_CELL, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of `docs`: its statistics, base_failed, distance (squared) and kept."""
    vector = _vector()
    rows = stored(_cells(statistics(docs), min_cell).select(
        "*", *[v.alias(k) for k, v in vector.items()]), "statistics")
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    return rows.join(estimates(rows), "cell").select(
        "doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), _distance(F.col).alias("distance")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `judge` keeps, unchanged. Rows are told apart by all that is judged, so
    those without a doc_id or with the same one stay or go by their own text."""
    bad, = unused(docs, "_bad")
    gone = judge(docs, **options).filter(~F.col("kept")).select(F.col("row_key").alias(bad)).distinct()
    return docs.join(gone, _row_key() == F.col(bad), "left_anti")
