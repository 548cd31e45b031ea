"""License scans, in DataFrame expressions only.

Texts become word shingles.  Overlapping windows of shingles, of texts and templates alike, get MinHash bands by one
permutation: the hash space is cut into BINS, and each bin's smallest hash in the window is a band of one row.  A
template of more than SHARED shingles fills at least that many of the WINDOW of some window of the text, the same as
one of its own windows has; a shared shingle loses its band only to a smaller hash of one of the others in its bin.
So the chance that no band shows it is below ((WINDOW - SHARED) / (2 * BINS)) ** SHARED.  Templates of up to FEW
shingles have too few; each of their shingles is a band wherever it stands, so that none of them is missed.  Bands
retrieve templates; matches are then verified by the exact share of the template's shingles in the text around the
window.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 5
WINDOW, STEP = 16, 8
#: Shingles of a template that lie together in some window, wherever it stands.
SHARED = WINDOW - STEP + 1
BINS_LOG2 = 5
CONTAINMENT = 0.8
#: Templates of so many shingles or fewer are found by each of their shingles.
FEW = 16
#: Bands of all templates up to which they are broadcast.
BROADCAST_BANDS = 100_000
#: Bits of the table that tells bands of no template at once.
SIEVE_LOG2 = 18

#: Public notices by which works state their license.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of "
        "merchantability, fitness for a particular purpose and noninfringement.",
    ),
    (
        "BSD",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "BSD",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not "
        "limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *((f"CC-{x}-4.0", f"Licensed under CC {x} 4.0.") for x in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    # Tags of at least WIDTH words; those with -only or -or-later begin like these.
    *((x, f"SPDX-License-Identifier: {x}") for x in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0")),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0")),
]


def miss_chance(shingles: int) -> float:
    """Upper bound on the chance that no band of a window that holds a whole template of so many shingles shows it."""
    return 0.0 if shingles <= FEW else ((WINDOW - SHARED) / (2 * (1 << BINS_LOG2))) ** SHARED


def shingle_hashes(text: Column) -> Column:
    """The hash of each run of WIDTH words, in order; words are lower-cased runs of letters and digits."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH))))

    # The one-element array binds the words once for all shingles.
    return F.flatten(F.transform(F.filter(F.array(words), lambda w: F.size(w) >= WIDTH), hashes))


def bands(window: Column, always: Callable[[Column], Column]) -> Column:
    """The smallest hash of each bin, a bin being the hash's highest bits, and each hash for which ``always`` holds."""
    bin_of = lambda x: F.shiftright(x, 64 - BINS_LOG2)
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))) | always(x))
    return F.flatten(F.transform(F.array(F.sort_array(window)), firsts))


def sieve(hashes: Iterable[int]) -> Callable[[Column], Column]:
    """A test that all of ``hashes`` pass, and of others few."""
    words = [0] * (1 << (SIEVE_LOG2 - 6))
    for x in hashes:
        words[(x >> 6) & (len(words) - 1)] |= 1 << (x & 63)
    # One constant: parsed once when the plan is optimized, never a column.
    table = F.from_json(F.lit(json.dumps([v - (1 << 64) if v >> 63 else v for v in words])), "array<bigint>")

    def passes(x: Column) -> Column:
        word = F.get(table, F.shiftright(x, 6).bitwiseAND(F.lit(len(words) - 1)).cast("int"))
        return F.call_function("shiftrightunsigned", word, x.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return passes


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, license, shingles, bands) of templates with WIDTH words or more; the list's length bounds it.

    The bands of all windows that overlap the template, those that begin before it included; of short ones each shingle.
    """
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    known = rows.select("template", "license", shingle_hashes(F.col("text")).alias("h")).where("size(h) > 0")
    window = lambda j: F.slice("h", F.greatest(j, F.lit(0)) + 1, WINDOW + F.least(j, F.lit(0)))
    every = F.flatten(F.transform(F.sequence(F.lit(1 - WINDOW), F.size("h") - 1), lambda j: bands(window(j), lambda x: F.lit(False))))
    shingles = F.array_distinct("h")
    return known.select("template", "license", shingles.alias("shingles"), F.when(F.size(shingles) <= FEW, shingles).otherwise(F.array_distinct(every)).alias("bands"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, template, containment, word): each template found in each document, where it shows best.

    ``word`` is the first word of the window, counted from 0.  Null texts and texts under WIDTH words hold nothing.
    Rows that agree in id and text are reported once, others by themselves, those without an id included.  Without
    templates or rows the result is empty.  Other columns of the input are ignored.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    held = known.collect()  # the templates, a fixed list
    longest = max((len(r.shingles) for r in held), default=0)
    passes = sieve(x for r in held for x in r.bands)
    always = sieve(x for r in held if len(r.shingles) <= FEW for x in r.shingles)

    def hits(h: Column) -> Column:
        """(window, band, shingles around) for each band that the sieve lets pass."""

        def of_window(j: Column) -> Column:
            around = F.slice(h, F.greatest(j * STEP - longest, F.lit(0)) + 1, F.lit(WINDOW + 2 * longest))
            return F.transform(F.filter(bands(F.slice(h, j * STEP + 1, WINDOW), always), passes), lambda x: F.struct(j.alias("window"), x.alias("band"), around.alias("around")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / STEP).cast("int")), of_window))

    # One expression with its parts bound to lambda variables, and an outer explode: a filter on it would be pushed
    # below and compute it anew for each use.
    hashes = F.filter(F.array(shingle_hashes(F.coalesce("text", F.lit("")))), lambda h: F.size(h) > 0)
    near = docs.select("doc_id", F.xxhash64("text").alias("row"), F.explode_outer(F.flatten(F.transform(hashes, hits))).alias("hit")).select("doc_id", "row", "hit.*")
    by_band = known.select("template", "license", "shingles", F.explode("bands").alias("band"))
    if sum(len(r.bands) for r in held) <= BROADCAST_BANDS:
        by_band = F.broadcast(by_band)
    matched = near.join(by_band, "band").select(
        "doc_id", "row", "license", "template", "window", (F.size(F.array_intersect("shingles", "around")) / F.size("shingles")).alias("containment")
    )
    best = matched.where(F.col("containment") >= containment).groupBy("doc_id", "row", "license", "template").agg(F.min(F.struct(-F.col("containment"), F.col("window"))).alias("b"))
    return best.select("doc_id", "license", "template", (-F.col("b.col1")).alias("containment"), (F.col("b.window").cast("long") * STEP).alias("word"))
