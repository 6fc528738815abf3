"""License notices found by MinHash bands over overlapping text windows, with DataFrame operations only.

Texts and templates are words of [a-z0-9] (ASCII lower case, everything else separates); shingles are five words, and of a notice
with fewer words its whole sequence. A
template of t words is sought in windows of t + stride - 1 words that start at multiples of stride = max(1,
t // 4), so that an unbroken notice lies whole in one of them. A window and a template that it holds to 80 % have
a Jaccard similarity of at least `J_FLOOR`; with BANDS bands of one row they share a band with probability
1 - (1 - J_FLOOR)^BANDS, which is asserted to exceed 1 - 1e-5 when the templates are set up. What the bands retrieve is verified by
exact shingle containment: shingles of the template in the window / shingles of the template >= 0.8.

Only windows with an anchor word are built. That loses nothing: anchors are chosen so that any 80 % of a
template's shingles include one with an anchor (checked when the templates are set up). The template table is
broadcast; it is this module's list, a few hundred rows.

Cases: null and empty texts match nothing; rows that share a doc_id are one document; null ids are reported as
null; very long texts are scanned whole; repeated notices give one row a template, with the first place; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, PERCENT, BANDS = 5, 80, 20

#: (name, licence, notice): short notices and opening sentences of widely used licences.
TEMPLATES = [
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", "is hereby granted, free of charge, to any person obtaining a copy"),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl3-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-notice", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-terms", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
    ("rights-reserved", "Proprietary", "All rights reserved."),
    ("lgpl-header", "LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-header", "AGPL", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("epl-notice", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cc0-notice", "CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsl-notice", "BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    (
        "mit-text",
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd-2-text",
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
]
#: Words of which every window that may match holds one.
ANCHORS = ["license", "licensed", "permission", "permitted", "granted", "distribute", "mozilla", "unencumbered", "reserved", "redistribute", "eclipse", "dedicated", "distributed", "restriction", "copyright", "liability", "warranty", "warranties", "provided"]
J_FLOOR = 0.5


def words_of(notice: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in notice.lower()).split()


def shingles_of(words: list[str]) -> list[str]:
    width = min(WIDTH, len(words))
    return list(dict.fromkeys(" ".join(words[k : k + width]) for k in range(len(words) - width + 1)))


def prepared(templates=TEMPLATES) -> list[dict]:
    """Each template with its shingles, stride and window; refuses what the guarantees do not cover."""
    out = []
    for name, licence, notice in templates:
        words = words_of(notice)
        shingles = shingles_of(words)
        need = ceil(PERCENT * len(shingles) / 100)
        stride = max(1, len(words) // 4)
        window = len(words) + stride - 1
        width = min(WIDTH, len(words))
        floor = need / (window - width + 1 + len(shingles) - need)
        anchored = sum(any(w in ANCHORS for w in s.split()) for s in shingles)
        if anchored < len(shingles) - need + 1:
            raise ValueError(f"{name}: {PERCENT} % of its shingles may hold no anchor")
        if floor < J_FLOOR or (1 - floor) ** BANDS > 1e-5:
            raise ValueError(f"{name}: its windows are too long for the bands")
        out.append({"template": name, "license": licence, "shingles": shingles, "width": width, "stride": stride, "window": window, "need": need})
    return out


def _signature(shingles: Column) -> Column:
    """BANDS minima, each under its own hash."""

    def least(band: int) -> Column:  # a second lambda parameter would be the element's place
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(band), s)))

    return F.array(*map(least, range(BANDS)))


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, template, license, hits, n_shingles, first_word: a row for each notice that a document holds."""
    spark = docs.sparkSession
    known = prepared(templates)
    table = spark.createDataFrame([(t["template"], t["license"], t["shingles"], t["need"], t["window"]) for t in known], "template string, license string, wanted array<string>, need int, window int")
    table = table.withColumn("signature", _signature(F.col("wanted")))
    bands = table.select("template", "license", "wanted", "need", "window", F.posexplode("signature").alias("band", "key"))

    low = F.lower(F.col(text))
    may = low.contains(ANCHORS[0])
    for a in ANCHORS[1:]:
        may = may | low.contains(a)
    words = F.filter(F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    rows = docs.where(F.col(text).isNotNull() & may).select("doc_id", words.alias("words"))
    anchors = F.array(*map(F.lit, ANCHORS))
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull())
    sizes = sorted({(t["window"], t["stride"], t["width"]) for t in known})
    kinds = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(s).alias("stride"), F.lit(n).alias("width")) for w, s, n in sizes])

    def starts(k: Column) -> Column:
        """Of all windows of a kind that hold an anchor."""
        around = lambda p: F.transform(F.sequence(F.ceil(F.greatest(p - k["window"] + 1, F.lit(0)) / k["stride"]), F.floor(p / k["stride"])), lambda n: (n * k["stride"]).cast("int"))
        return F.array_distinct(F.flatten(F.transform("at", around)))

    # a window's words go with it, never the whole text
    cut = F.flatten(F.transform(kinds, lambda k: F.transform(starts(k), lambda s: F.struct(k["window"].alias("window"), k["width"].alias("width"), s.alias("start"), F.slice("words", s + 1, k["window"]).alias("part")))))
    windows = rows.withColumn("at", at).where(F.size("at") > 0).select("doc_id", F.explode(cut).alias("k")).select("doc_id", "k.*").where(F.size("part") >= F.col("width"))
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("part") - F.col("width") + 1), lambda i: F.array_join(F.slice("part", i, F.col("width")), " ")))
    windows = windows.select("doc_id", "window", "start", shingles.alias("held"))
    keyed = windows.select("doc_id", "window", "start", "held", F.posexplode(_signature(F.col("held"))).alias("band", "key"))
    met = keyed.join(F.broadcast(bands), ["window", "band", "key"])
    hits = F.size(F.array_intersect("held", "wanted"))
    good = met.select("doc_id", "template", "license", "start", hits.alias("hits"), "need", F.size("wanted").alias("n_shingles")).where("hits >= need")
    return good.groupBy("doc_id", "template", "license", "n_shingles").agg(F.max("hits").alias("hits"), F.min("start").alias("first_word")).select("doc_id", "template", "license", F.col("hits").cast("long").alias("hits"), F.col("n_shingles").cast("long").alias("n_shingles"), F.col("first_word").cast("long").alias("first_word"))
