"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts and templates become words of [a-z0-9] and runs of five words. Templates are grouped by
length; the windows of a group are two adjacent blocks, each at least as long as the group's
longest template, so every occurrence lies inside some window. A window is retrieved for a group
when it agrees with a template in one band, a band being one min-hash: the least `hash xor seed`
of the runs in the window. The number of bands follows from the smallest similarity that a window
around a template can have, so that at least `RECALL` of the occurrences are retrieved. A
retrieved window is reported when it holds at least `CONTAINED` of a template's runs.

Only DataFrame functions run and nothing is shuffled. A window agrees with a template in a band
only if it holds the template's run of least value, so the text is first searched for these runs,
and min-hashes are taken of the windows around them.

Defined results: null and empty texts, and texts of fewer than five words, have no finding; each
window with a template is one row, in any number of copies; rows of one doc_id are scanned each by
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: Short forms and opening sentences of public licenses.
TEMPLATES = {
    "MIT-short": "Released under the MIT License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-short":
        "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
           "software and associated documentation files (the \"Software\"), to deal in the "
           "Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                  "use this file except in compliance with the License.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the "
           "terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are "
           "permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, "
               "v. 2.0.",
}
RECALL, CONTAINED, SIZE = 0.99, 0.75, 5


def runs(text: Column) -> Column:
    """64-bit hashes of the runs of five words, in order."""
    clean = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")

    def hashed(w: Column) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (SIZE - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SIZE)]))

    return let(F.array_remove(F.split(clean, " ", -1), ""), hashed)


def seeds(n: int) -> list[int]:
    """Fixed xor masks, one per band."""
    return [int.from_bytes(((i + 1) * 0x9E3779B97F4A7C15 * (2 * i + 3) % (1 << 64))
                           .to_bytes(8, "big"), "big", signed=True) for i in range(n)]


def bands(shortest: int, half: int) -> int:
    """Bands so that a window of two blocks of `half` runs agrees with probability RECALL."""
    found = math.ceil(CONTAINED * shortest)
    similar = found / (2 * half + shortest - found)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - similar)) if similar < 1 else 1


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, window (first run of the window) and containment of every finding."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    named = spark.createDataFrame(list(templates.items()), "license string, text string").select(
        "license", F.array_distinct(runs(F.col("text"))).alias("runs")).filter("size(runs) > 0")
    known = {r["license"]: r["runs"] for r in named.collect()}  # a fixed table
    levels: dict[int, list[str]] = {}
    for name in sorted(known):
        levels.setdefault((len(known[name]) - 1).bit_length(), []).append(name)
    need = {k: bands(min(len(known[n]) for n in names), 1 << k) for k, names in levels.items()}
    masks = seeds(max(need.values(), default=0))

    # The run that is a template's minimum under each mask, by level and band.
    best = {(k, j): sorted({min(known[n], key=lambda h: h ^ masks[j]) for n in names})
            for k, names in levels.items() for j in range(need[k])}
    every = sorted({h for keys in best.values() for h in keys})

    def agrees(sh: Column, level: Column, block: Column) -> Column:
        """Whether the window's minimum under some mask is a template's."""
        def band(k: int, j: int) -> Column:
            window = F.slice(sh, F.shiftleft(block, k) + 1, 2 << k)
            least = F.array_min(F.transform(window, lambda h: h.bitwiseXOR(F.lit(masks[j]))))
            return least.isin([h ^ masks[j] for h in best[k, j]])

        return reduce(lambda x, y: x | y, [
            (level == k) & reduce(lambda x, y: x | y, [band(k, j) for j in range(need[k])])
            for k in levels])

    def retrieve(sh: Column) -> Column:
        """The windows that agree with a template in some band.

        Such a window holds the template's minimum, so only windows around these runs are hashed.
        """
        marked = F.transform(sh, lambda h, i: F.when(h.isin(every), i))
        around = F.flatten(F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: F.array(*[
            F.struct(F.lit(k).alias("level"), (F.shiftright(i, k) - back).alias("block"))
            for k in levels for back in (0, 1)])))
        return F.filter(F.array_distinct(around), lambda w: (w["block"] >= 0) & agrees(
            sh, w["level"], w["block"]))

    def verify(sh: Column, level: Column, block: Column) -> Column:
        cases = []
        for k, names in levels.items():
            window = F.slice(sh, F.shiftleft(block, k) + 1, 2 << k)
            share = [F.struct(F.lit(n).alias("license"), (F.size(F.array_intersect(
                window, F.array(*[F.lit(h) for h in known[n]]))) / len(known[n]))
                .alias("containment")) for n in names]
            cases.append((k, F.filter(F.array(*share), lambda s: s["containment"] >= CONTAINED)))
        return reduce(lambda rest, c: F.when(level == c[0], c[1]).otherwise(rest), cases[1:],
                      cases[0][1])

    if not levels:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0).alias("window"),
                           F.lit(0.0).alias("containment")).limit(0)
    start = lambda w: w["block"] * F.pow(F.lit(2), w["level"])
    found = let(runs(F.col("text")), lambda sh: F.flatten(F.transform(
        retrieve(sh), lambda w: F.transform(verify(sh, w["level"], w["block"]), lambda s: F.struct(
            s["license"].alias("license"), start(w).cast("int").alias("window"),
            s["containment"].alias("containment"))))))
    return docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")
