"""Licence scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Native operations only. Templates are grouped by length. For a group of at most
M words, windows of 2M words start every M words, so that each run of M words
lies whole in some window. A window that has the least number of shingles that
verifies a template has a Jaccard similarity J with it that follows from how
many shingles the template has; the group's least J, mostly that of its
shortest template, sets the number of bands of one row, such that
``(1 - J) ** bands`` is at most ``MISSED``. So a window that would verify meets
its template in a band with a probability of at least 1 - MISSED = 0.999999.

A window can only match if it has one of a template's anchor words: anchors are
chosen so that less than the least number of shingles that verifies is free of
them. Other windows are passed over before hashing; nothing is lost.
"""

from __future__ import annotations

import math

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, text_or_empty, written

SHINGLE, CONTAINMENT = 5, 0.8
#: What stands between words, in any script; one pattern for texts and templates.
SEPARATOR = r"[^\p{L}\p{N}]+"
#: Bound of the probability that a window that would verify meets its template in no band.
MISSED = 1e-6

# Grants and notices of public licences, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """The distinct shingles' hashes; fewer words than ``size`` are one shingle, none none."""
    n = F.size(words)
    hashed = lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, size)))
    return F.array_distinct(F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), hashed)))


def signature(shingles: Column, bands: Column) -> Column:
    """MinHash: for each band the least hash of the shingles under the band's own hash function."""
    return F.transform(F.sequence(F.lit(1), bands), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def _words(text: str) -> list[str]:
    """``words_of`` of a template, on the driver."""
    return [w for w in regex.split(SEPARATOR, text.lower()) if w]


def anchors(text: str, size: int = SHINGLE, containment: float = CONTAINMENT) -> set[str]:
    """Words, the longest first, of which any set of shingles that verifies must hold one."""
    words = _words(text)
    shingles = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    need = -(-len(shingles) * containment // 1)
    chosen: set[str] = set()
    free = len(shingles)
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if free < need:
            break
        chosen.add(w)
        free = sum(not chosen & set(s) for s in shingles)
    return chosen


def groups(templates=TEMPLATES) -> dict[int, list[tuple[int, str, str]]]:
    """Templates ``(number, name, text)`` by M, the power of two that holds their words (8 at least)."""
    out: dict[int, list] = {}
    for i, (name, text) in enumerate(templates):
        m = 8
        while m < len(_words(text)):
            m *= 2
        out.setdefault(m, []).append((i, name, text))
    return dict(sorted(out.items()))


def similarity(m: int, text: str, size: int = SHINGLE, containment: float = CONTAINMENT) -> float:
    """The least Jaccard similarity of a template and a window of 2 * ``m`` words that verifies it."""
    words = _words(text)
    n = len({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})
    need = next(k for k in range(n + 1) if k / n >= containment)
    return need / (max(2 * m - size + 1, n) + n - need)


def bands_of(templates=TEMPLATES) -> dict[int, int]:
    """The number of bands of each group, by M."""
    least = {m: min(similarity(m, text) for _, _, text in of) for m, of in groups(templates).items()}
    return {m: math.ceil(math.log(MISSED) / math.log(1 - j)) if j < 1 else 1 for m, j in least.items()}


def _bands(templates) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for item in bands_of(templates).items() for v in item]), F.col("m"))


def _templates(spark: SparkSession, templates) -> DataFrame:
    rows = [(m, i, name, text) for m, of in groups(templates).items() for i, name, text in of]
    t = spark.createDataFrame(rows, "m int, template int, name string, template_text string")
    t = t.withColumn("want", shingles_of(words_of(F.col("template_text")))).withColumn("bands", signature(F.col("want"), _bands(templates)))
    return t.select("m", "template", "name", "want", F.posexplode("bands").alias("band", "value"))


def license_matches(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, name, template, containment, start``: the best window for each document and template that it holds.

    start is the window's first word. The whole text is scanned. Templates are a
    parameter: a list that one collects and broadcasts by choice, a few rows.
    """
    spark = docs.sparkSession
    by = groups(templates)
    every = sorted({w for of in by.values() for _, _, text in of for w in anchors(text)})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # the texts that have an anchor at all; in them the windows that have one of their group's
    rows = rows.filter(F.lower("text").rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(every) + r")(?![\p{L}\p{N}])")).select("doc_id", words_of(F.col("text")).alias("words"))
    windows = []
    for m, of in by.items():
        own = F.array(*[F.lit(w) for w in sorted({w for _, _, text in of for w in anchors(text)})])
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1 - m, F.lit(0)), F.lit(m))
        cut = F.filter(F.transform(starts, lambda i: F.struct(F.lit(m).alias("m"), i.alias("start"), F.slice("words", i + 1, 2 * m).alias("w"))), lambda x: F.arrays_overlap(x.w, own))
        windows.append(cut)
    found = rows.select("doc_id", F.explode(F.concat(*windows)).alias("x"))
    found = found.select("doc_id", "x.m", "x.start", shingles_of(F.col("x.w")).alias("have"))
    found = found.select("doc_id", "m", "start", "have", F.posexplode(signature(F.col("have"), _bands(templates))).alias("band", "value"))
    met = found.join(F.broadcast(_templates(spark, templates)), ["m", "band", "value"])
    share = F.size(F.array_intersect("have", "want")) / F.size("want")
    met = met.select("doc_id", "name", "template", "start", share.alias("containment")).filter(F.col("containment") >= CONTAINMENT)
    best = F.max(F.struct("containment", (-F.col("start")).alias("at")))
    return met.groupBy("doc_id", "name", "template").agg(best.alias("b")).select("doc_id", "name", "template", F.col("b.containment").alias("containment"), (-F.col("b.at")).alias("start"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_licenses, licenses, containment`` for every row of ``docs(doc_id, text)``.

    licenses are the names found, sorted and comma-joined, containment the
    greatest share of a template's shingles that one window holds (0 without).
    Null and empty texts have none; rows that repeat a doc_id share what any of
    them holds; rows without a doc_id have none. An empty table gives no rows.
    Other columns are not read.
    """
    matches = written(license_matches(docs, templates).filter("doc_id is not null"), "licence-matches")
    each = matches.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("names"), F.max("containment").alias("best"))  # names: no more than templates
    out = join_checked(docs.select(F.col("doc_id").cast("long").alias("doc_id")), each, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("containment"))
