"""Scans for license notices: MinHash bands over overlapping windows, verified by shingle containment.

A notice of n words is looked for in all windows of 2 n words, whatever word they begin with, so any passage of up
to 2 n words lies in one of them. The windows that begin at n/4 neighbouring words are retrieved together: the
MinHash values of the words of all of them, one for each of BANDS bands, are joined with those of the notices of
that length. What shares a value is a candidate, and its windows are compared one by one; one that holds at least
three quarters of the notice's shingles is a match.

A notice with s shingles in neighbours of w shares at least 3/4 s of at most w + 1/4 s shingles, which is 1/6 or
more for any notice, if its own shingles are distinct, and bands of one value miss with a probability of at most
(5/6)^BANDS, less than one in a hundred thousand.

Only windows with an anchor word of a notice of their length are looked at, which loses nothing: the anchors of a notice are words of it
such that more than a quarter of its shingles have one, so three quarters of them can't do without.

Only DataFrame functions are used. The notices are a parameter and small; the scan has no shuffle before its
few matches.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, BANDS = 5, 64
WORDS = r"[\p{L}\p{N}]+"

#: Common notices by SPDX identifier.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
]

#: Notices of fewer than SHINGLE words, for scans with `short`.
SHORT_NOTICES = [("LicenseRef-All-Rights-Reserved", "All rights reserved.")]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def runs_of(words: Column, size: Column) -> Column:
    """Hashes of the runs of `size` words, in order; of all words together, if they are fewer."""
    last = F.greatest(F.size(words) - size + 1, F.lit(1))
    run = lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " "))
    return F.transform(F.sequence(F.lit(1), last), run)


def shingles_of(words: Column, size: Column) -> Column:
    """The distinct ones of `runs_of`."""
    return F.array_distinct(runs_of(words, size))


def minima_of(shingles: Column) -> Column:
    """For each band the least of the shingles' hashes."""
    seeds = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(seeds, lambda seed: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, seed))))


def anchors_of(notice: str) -> list[str]:
    """The fewest of a notice's longest words of which more than a quarter of its shingles have one."""
    words = re.findall(r"[^\W_]+", notice.lower())
    runs = [set(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    chosen: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        chosen.append(word)
        if 4 * sum(not run.isdisjoint(chosen) for run in runs) > len(runs):
            break
    return chosen


def _notices(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("notice")) for name, text in notices))
    table = spark.range(1).select(F.explode(rows).alias("row")).select("row.*")
    words = words_of(F.col("notice"))
    table = table.select("license", F.size(words).alias("length"), shingles_of(words, F.lit(SHINGLE)).alias("wanted"))
    return table.select("license", "length", "wanted", F.posexplode(minima_of(F.col("wanted"))).alias("band", "minimum"))


def scan(
    docs: DataFrame,
    notices: list[tuple[str, str]] | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: float = 0.75,
    short: bool = False,
) -> DataFrame:
    """One row per document and license found: doc_id, license, containment, at.

    `containment` is the largest share of a notice's shingles that a window holds. `at` is the first word of the
    first window with at least the share `least` (0.75 or more, as the anchors assume). Words are runs of letters and
    digits, compared in lower case. A notice spread over more than 2 n words by insertions is not found.

    A notice of n words, fewer than SHINGLE, is looked for by its one run of n words if `short` is set; without
    it, it is only found where a whole window is the notice, and a warning says so. The notices are NOTICES if
    none are given, with `short` SHORT_NOTICES too.

    Null, empty and wordless texts have no license. Repeated ids are reported once per license, a null id
    like any other. Other columns are ignored; an empty table gives no rows.
    """
    if least < 0.75:
        raise ValueError("anchors and bands are made for a containment of 0.75 or more")
    if notices is None:
        notices = NOTICES + SHORT_NOTICES if short else NOTICES
    spark = docs.sparkSession
    table = _notices(spark, notices)
    lengths = sorted({len(re.findall(r"[^\W_]+", text)) for _, text in notices})
    if 0 in lengths:
        raise ValueError("a notice without words")
    if not short and min(lengths, default=SHINGLE) < SHINGLE:
        warnings.warn(f"notices of fewer than {SHINGLE} words are practically never found without short=True", stacklevel=2)

    anchors = {n: sorted({a for _, text in notices for a in anchors_of(text) if len(re.findall(r"[^\W_]+", text)) == n}) for n in lengths}

    text = F.lower(docs[text_column])
    some = F.lit(False)
    for anchor in sorted({a for known in anchors.values() for a in known}):
        some = some | text.contains(anchor)
    rows = docs.filter(some).select(docs[id_column].alias("doc_id"), words_of(docs[text_column]).alias("words"))
    kinds = [
        F.struct(
            F.lit(n).alias("length"),
            F.lit(max(1, n // 4)).alias("step"),
            F.lit(min(SHINGLE, n) if short else SHINGLE).alias("run"),
            F.array(*map(F.lit, known)).alias("known"),
        )
        for n, known in anchors.items()
    ]
    kind = F.array(*kinds) if kinds else F.array().cast("array<struct<length:int,step:int,run:int,known:array<string>>>")
    rows = rows.withColumn("kind", F.explode(kind)).select("doc_id", "words", "kind.*")
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("known", w), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("anchors", at).filter(F.size("anchors") > 0)
    turn = lambda i: F.floor(i / F.col("step")).cast("int")
    near = lambda i: F.sequence(turn(F.greatest(i - 2 * F.col("length") + 1, F.lit(0))), turn(i))
    turns = F.array_distinct(F.flatten(F.transform("anchors", near)))
    slices = F.transform(turns, lambda q: F.struct(
        (q * F.col("step")).alias("first"),
        F.slice("words", q * F.col("step") + 1, 2 * F.col("length") + F.col("step") - 1).alias("words"),
    ))
    rows = rows.select("doc_id", "length", "step", "run", F.explode(slices).alias("part"))
    windows = rows.select("doc_id", "length", "step", "run", "part.first", runs_of(F.col("part.words"), F.col("run")).alias("runs"))
    windows = windows.select("*", F.posexplode(minima_of(F.col("runs"))).alias("band", "minimum"))

    found = windows.join(F.broadcast(table), ["length", "band", "minimum"])  # up to BANDS rows for each notice
    # Windows that share several bands with a notice are one candidate.
    found = found.drop("band", "minimum").distinct()
    first, length = F.col("first"), F.col("length")

    def window(k: Column) -> Column:
        held = F.slice("runs", k + 1, 2 * length - F.col("run") + 1)
        share = F.size(F.array_intersect(held, "wanted")) / F.size("wanted")
        return F.struct((first + k).alias("at"), share.alias("containment"))

    shares = F.transform(F.sequence(F.lit(0), F.col("step") - 1), window)
    shares = F.filter(shares, lambda w: w["containment"] >= least)
    found = found.select("doc_id", "license", F.explode(shares).alias("window")).select("doc_id", "license", "window.*")
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").alias("at"))
