"""Operator 5, license scans with MinHash bands over overlapping text windows. Only built-in functions are used.

Templates are phrases and headers that state a license, and passages of whole license texts (``license_catalogue``). A text
is cut into windows of eight word shingles that overlap by half, templates into pieces of four. A piece that
occurs whole lies in some window, where its Jaccard similarity is one half or more; with one hash a band and ``BANDS``
bands, each of its own, it is retrieved with probability 1 - 2^-BANDS, 0.9998 for twelve. Templates of up to four shingles, all of which
must occur, are looked up by their first shingle, with certainty.
Two bands are equal when the shingles that give them are. So a text's shingles meet those that give a template's bands by an
equi-join, and only where one is found is it asked whether it is the least of its window in that band: words that no
template holds cost a lookup, not ``BANDS`` hashes, and no window is left out by it.
Each retrieved template is verified by exact containment: the share of its shingles in the stretch of text around the
window, which reaches a template's length beyond it on either side. A notice that names a version needs a shingle that
covers it, so one of version 2 is no near copy of that of version 3; "GNU General" is no near copy of "GNU Lesser General".

Templates are constants of the caller; their bands are broadcast while there are at most ``BROADCAST_BANDS`` rows.

Cases: null texts and texts of fewer words than a template's shortest shingle hold no license; equal texts are looked
up once each row and joined by MD5; a license found several times counts once, with its best containment; a family's name
without a version is left out beside one with it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.functions.text import bind
from lakekit.llm.columns import named
from lakekit.llm.license_catalogue import BREAK as _BREAK
from lakekit.llm.license_catalogue import FAMILIES, notices, passages, split

WORDS = 5
CONTAINMENT = 0.8
BANDS = 12
PIECE, WINDOW = 4, 8
#: Shingles of a stretch, whose windows are verified against it and what surrounds it.
STRETCH = 64
BROADCAST_BANDS = 400_000
#: Short notices as licenses print them; the catalogue's notices and passages are added to them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation",
    ),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All rights reserved", "All rights reserved."),
]
def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def shingles(hashes: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` word hashes."""
    last = F.size(hashes) - k
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def bands_of(piece: Column, bands: int) -> list[Column]:
    """A piece's value in each band: its least shingle under a hash of the band's own."""
    return [F.array_min(F.transform(piece, _hash_of(band))) for band in range(bands)]


def _hash_of(band: int) -> Callable[[Column], Column]:
    return lambda x: F.xxhash64(x, F.lit(band))


def window_bands(own: Column, bands: int) -> Column:
    """The values of all windows of a stretch, band by band: what ``retrieved`` must agree with. A shingle is hashed once a
    band, and a window's least hash is that of the two pieces that make it up."""

    def of_band(band: int) -> Column:
        hashed = F.transform(own, _hash_of(band))
        starts = F.sequence(F.lit(1), F.lit(STRETCH + WINDOW - PIECE), F.lit(PIECE))
        leasts = bind(hashed, lambda h: F.transform(starts, lambda i: F.array_min(F.slice(h, i, PIECE))))
        windows = F.sequence(F.lit(0), F.lit(STRETCH // PIECE - 1))
        return bind(leasts, lambda m: F.transform(windows, lambda q: F.least(F.get(m, q), F.get(m, q + 1))))

    return F.flatten(F.array(*(of_band(band) for band in range(bands))))


def _must(name: str, words: list[str], k: int) -> list[list[int]]:
    """Places of the shingles that cover the version, the family, which tell a license from its siblings, and that state it."""
    digits = [i for i, w in enumerate(words) if re.fullmatch(r"v?\d+", w)] if re.search(r"\d", name) else []
    version = [(a, next(i for i in range(a, len(words) + 1) if i not in digits)) for a in digits if a - 1 not in digits]
    family = [(i, i + 2) for i in range(len(words)) if words[i : i + 2] == ["gnu", "general"]]
    covering = ([i for i in range(len(words) - k + 1) if any(i <= a and b <= i + k for a, b in runs)] for runs in (version, family))
    return [places for places in (*covering, [0] if words[0] in ("under", "license") else []) if places]


def template_bands(
    spark: SparkSession, stated: list[tuple[str, str]], cut: list[tuple[str, str]], words: int, bands: int
) -> tuple[DataFrame, DataFrame, list[int], int]:
    """(places by shingle, templates, shingle lengths below ``words`` that templates need, shingles of the longest template).

    The templates are notices and passages of texts; only notices name a version.
    """
    rows = []
    for name, text, notice in [*((*t, True) for t in stated), *((*t, False) for t in cut)]:
        if own := split(text):
            k = min(words, len(own))
            rows.append((len(rows), name, text, k, len(own) - k + 1, _must(name, own, k) if notice else []))
    short = sorted({r[3] for r in rows if r[3] < words})
    table = spark.createDataFrame(rows, "template int, license string, notice string, k int, n int, must array<array<int>>")
    hashes = F.transform(words_of(F.col("notice")), lambda w: F.xxhash64(w))
    own = F.coalesce(*(F.when(F.col("k") == k, shingles(hashes, k)) for k in [*short, words]))
    table = table.select("template", "license", "k", "n", "must", own.alias("run"))
    # Kinds: bands of windows come first, then single shingles.
    single = table.where(f"n <= {PIECE}").select("template", F.lit(bands).alias("kind"), F.col("run")[0].alias("value"))
    starts = F.transform(F.sequence(F.lit(0), F.ceil((F.col("n") - PIECE) / PIECE).cast("int")), lambda q: F.least(q * PIECE, F.col("n") - PIECE))
    pieces = table.where(f"n > {PIECE}").withColumn("start", F.explode(starts)).withColumn("piece", F.slice("run", F.col("start") + 1, PIECE))
    banded = pieces.select("template", "piece", F.posexplode(F.array(*bands_of(F.col("piece"), bands))).alias("kind", "least"))
    # Bands are equal when the shingles that give them are, so a band is met by its shingle, not by its value.
    own = F.filter("piece", lambda x: F.xxhash64(x, "kind") == F.col("least"))[0]
    met = single.union(banded.select("template", "kind", own)).distinct()
    places = met.groupBy("value").agg(F.collect_list(F.struct("kind", "template")).alias("places"))
    must = F.transform("must", lambda places: F.transform(places, lambda i: F.get("run", i)))
    full = table.select("template", "license", "k", F.array_distinct("run").alias("shingles"), must.alias("must"))
    return places, full, short, max((r[4] for r in rows), default=0)


def hits(texts: DataFrame, key: str, text: str, known: DataFrame, short: list[int], longest: int, words: int) -> DataFrame:
    """(key, around, at, from, value, places) for every place of a stretch whose shingle is one that ``known`` asks for.

    Only these can be the least of a window in a band that a template has, so only here bands are computed.
    """
    hashed = texts.select(named(key).alias("key"), F.transform(words_of(named(text)), lambda w: F.xxhash64(w)).alias("words"))
    runs = hashed.select("key", "words", shingles(F.col("words"), words).alias("s"), F.size("words").alias("n"))
    # Stretches of the text keep the shingles around their windows. A filter on what is exploded would be computed once
    # more below; outer explosions have none.
    stretch = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / STRETCH).cast("int")))
    cut_up = runs.select("key", "words", "s", "n", F.explode_outer(stretch).alias("q"))
    first = F.greatest(F.col("q") * STRETCH - longest, F.lit(0))
    cut_up = cut_up.select(
        "key",
        F.slice("words", F.col("q") * STRETCH + 1, STRETCH + words).alias("own"),
        F.slice("s", first + 1, 2 * longest + STRETCH + WINDOW).alias("around"),
        (F.col("q") * STRETCH - first).alias("from"),
        F.least(F.col("n") - F.col("q") * STRETCH, F.lit(STRETCH + WINDOW - PIECE)).alias("size"),
    )
    places = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1))
    spread = cut_up.select("key", "own", "around", "from", F.explode_outer(places).alias("at"))

    def begun(k: int) -> Column:
        own = [F.get("own", F.col("at") + j) for j in range(k)]
        return F.when((F.col("at") < STRETCH) & own[-1].isNotNull(), F.xxhash64(*own))

    # A short text still has shorter shingles.
    values = F.array(F.get("around", F.col("from") + F.col("at")), *(begun(k) for k in short))
    return spread.select("key", "around", "from", "at", F.explode_outer(values).alias("value")).join(known, "value")


def retrieved(found: DataFrame, bands: int) -> DataFrame:
    """(key, around, template) for the hits that begin a template or are the least shingle of a window in its band."""
    piece = F.col("from") + F.col("at") - F.pmod("at", F.lit(PIECE))
    # A place lies in the window that begins at its piece and in the one before, if both are the stretch's.
    windows = found.select(
        "key", "around", "value", "places", "at",
        F.when(F.col("at") < STRETCH, F.slice("around", piece + 1, WINDOW)).alias("here"),
        F.when(F.col("at") >= PIECE, F.slice("around", piece + 1 - PIECE, WINDOW)).alias("before"),
    )

    def least(window: str, kind: Column) -> Column:
        own = F.xxhash64("value", kind)
        return F.col(window).isNotNull() & F.forall(window, lambda x: F.xxhash64(x, kind) >= own)

    def meets(place: Column) -> Column:
        kind = place["kind"]
        return F.when(kind == bands, F.col("at") < STRETCH).otherwise(least("here", kind) | least("before", kind))

    met = windows.select("key", "around", F.explode_outer(F.filter("places", meets)).alias("place"))
    return met.where("place IS NOT NULL").select("key", "around", "place.template")


def matches(
    texts: DataFrame,
    key: str,
    text: str,
    templates: list[tuple[str, str]] | None = None,
    words: int = WORDS,
    containment: float = CONTAINMENT,
    bands: int = BANDS,
) -> DataFrame:
    """(key, license, containment) for every license that a text holds."""
    stated, cut = ([*TEMPLATES, *notices()], passages()) if templates is None else (templates, [])
    known, full, short, longest = template_bands(texts.sparkSession, stated, cut, words, bands)
    if sum(len(split(t)) // PIECE + 1 for _, t in [*stated, *cut]) * bands <= BROADCAST_BANDS:
        known, full = F.broadcast(known), F.broadcast(full)
    found = hits(texts, key, text, known, short, longest, words)
    met = retrieved(found, bands).join(full, "template")
    whole = F.col("k") < words
    share = F.when(whole, F.lit(1.0)).otherwise(F.size(F.array_intersect("shingles", "around")) / F.size("shingles"))
    right = whole | F.forall("must", lambda own: F.arrays_overlap(own, "around"))
    return (
        met.withColumn("containment", share)
        .where((F.col("containment") >= containment) & right)
        .groupBy("key", "license")
        .agg(F.max("containment").alias("containment"))
    )


def scan(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """``documents`` as struct ``row`` with licenses: sorted (license, containment) structs, empty if there are none."""
    rows = documents.select(
        F.struct(*(named(c) for c in documents.columns)).alias("row"), named(text).alias("text"), F.md5(named(text)).alias("key")
    )
    found = matches(rows.where("text IS NOT NULL"), "key", "text", **options)
    found = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("license", "containment"))).alias("licenses"))
    versions = lambda family: F.exists("licenses", lambda x: x["license"].startswith(F.concat(family, F.lit("-"))))
    kept = F.filter("licenses", lambda x: ~(x["license"].isin(FAMILIES) & versions(x["license"])))
    found = found.withColumn("licenses", kept)
    none = F.array().cast("array<struct<license:string,containment:double>>")
    return rows.select("row", "key").join(found, "key", "left").select("row", F.coalesce("licenses", none).alias("licenses"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document names."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Each column is used once here, so that only the id travels with the rows.
    found = scan(documents).select(F.col("row.doc_id").alias("doc_id"), "licenses")
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses.license", ",").alias("licenses"),
        F.array_max("licenses.containment").alias("best_containment"),
    )
