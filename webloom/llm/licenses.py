"""License scans by MinHash bands over overlapping text windows, in DataFrame expressions only.

Texts and templates become lower-case words. Windows of one and a half times a template's length, half a template apart,
hold every passage of that length whole. Bands of MinHash values retrieve templates for a window by an equi-join; a
window that holds four fifths of a template is retrieved with probability ``collision()``. Exact containment of
five-word shingles then verifies each retrieved pair.

A window without any shingle of a template cannot contain four fifths of one, so only windows around such a shingle are
cut; no match is lost by that. They are written once, as they are small beside the texts, and equal windows are compared
once. Templates are a list for the driver: their different shingles stand in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import stored, text_of

SHINGLE = 5
CONTAINED = 0.8
#: One value a band makes a band collide as often as the sets overlap.
BANDS, ROWS = 24, 1

# Short license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of "
     "the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def collision(overlap: float = CONTAINED / (1.5 + 1 - CONTAINED), bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that some band of a window and a template collides, at the Jaccard similarity that a window one and
    a half times as long has when it holds four fifths of the template."""
    return 1 - (1 - overlap ** rows) ** bands


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """Different shingles of five words; fewer words are one shingle, no words none."""
    n = F.size(words) - SHINGLE + 1
    many = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " "))
    return F.when(F.size(words) > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def bands_of(shingles: Column) -> Column:
    """Band keys: for each band the least hashes of its rows, and the band's number."""
    def least(row: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(row), s)))

    return F.array(*[
        F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def template_table(spark, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(templates, "license string, template string")


def find_licenses(df: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document id and license found in a text: ``containment`` (highest of its windows, at least 0.8)
    and ``windows`` (how many match).

    Null and empty texts match nothing, nor do templates without words; a null id is an id of its own. Rows with the
    same id are taken together. Windows lie at multiples of half a template's length, so a passage may lie in two.
    """
    words = words_of(text_of("template"))
    t = templates.select("license", words.alias("words")).where(F.size("words") > 0).select(
        "license", F.size("words").alias("length"), shingles_of(F.col("words")).alias("shingles"))
    lengths = sorted({r[0] for r in t.select("length").distinct().collect()})
    listed_shingles = sorted({r[0] for r in t.select(F.explode("shingles")).distinct().collect()})
    first_words = sorted({s.split(" ")[0] for s in listed_shingles})
    if not lengths:
        return df.select(doc_id, F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("containment"),
                         F.lit(0).cast("bigint").alias("windows")).limit(0)
    # One-element explodes: else later filters would take copies of these steps, and cut the words anew at each place.
    docs = df.select(F.col(doc_id).alias("id"), F.explode(F.array(words_of(text_of(text)))).alias("w"))
    w, n = F.col("w"), F.size("w")
    # Places of template shingles. A text of fewer words is one shingle.
    width = F.least(n, F.lit(SHINGLE))
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda p: F.get(w, p).isin(
        first_words) & F.array_join(F.slice(w, p + 1, F.lit(SHINGLE)), " ").isin(listed_shingles))
    docs = docs.where(n > 0).withColumn("hits", F.explode(F.array(places))).where(F.size("hits") > 0)

    def windows(length: int) -> Column:
        step, size = max(1, length // 2), length + max(1, length // 2)
        last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
        held = F.transform("hits", lambda p: F.sequence(
            F.greatest(F.ceil((p + width - size) / step), F.lit(0)).cast("int"),
            F.least(F.floor(p / step).cast("int"), last)))
        return F.transform(F.array_distinct(F.flatten(held)), lambda i: F.struct(
            F.lit(length).alias("length"), F.slice(w, i * step + 1, F.lit(size)).alias("words")))

    cut = docs.select("id", F.explode(F.concat(*[windows(k) for k in lengths])).alias("x")).select("id", "x.*")
    cut = stored(cut, "license_windows")
    # Equal windows are looked up once.
    kinds = cut.select("length", "words").distinct().withColumn("shingles", shingles_of(F.col("words")))
    found = kinds.select("length", "words", "shingles", F.explode(bands_of(F.col("shingles"))).alias("band"))
    listed = t.select("license", "length", F.col("shingles").alias("wanted"), F.explode(bands_of(F.col("shingles"))).alias(
        "band"))
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    matched = found.join(listed, ["length", "band"]).withColumn("containment", share).where(
        F.col("containment") >= CONTAINED).groupBy("length", "words", "license").agg(F.max("containment").alias("containment"))
    return cut.join(matched, ["length", "words"]).groupBy(F.col("id").alias(doc_id), "license").agg(
        F.max("containment").alias("containment"), F.count(F.lit(1)).alias("windows"))
