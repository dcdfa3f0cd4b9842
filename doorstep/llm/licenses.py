"""License scan: MinHash bands over overlapping windows find templates, shingles verify them.

A template is cut into windows of at most ``LONGEST`` words; a document has, for each size of
template window, windows at every word. ``BANDS`` bands of ``ROWS`` minima bring a document's
window together with a template's at Jaccard similarity 0.6 with a probability of
1 - (1 - 0.6**2)**16 = 0.9992, at 0.8 with 0.99999992. A candidate is verified by exact
containment: the share of the template's shingles of five words in the stretch of the document
that the aligned template would take.

All steps are DataFrame operations. A window that shares no shingle with any template cannot
contain one; a bitmap of fixed size and the exact set of template shingles drop such windows
before their minima are taken, so nothing that could match is lost.

Defined results: null texts count as empty; texts of fewer than five words have no shingle. Rows
equal in id and text are one document. A template found twice in a document is one row, with the
best containment and the first place that has it. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, staged, table
from .shingles import bitmap, columns_of, hits, window_hashes, words_of

SHINGLE, CONTAINED = 5, 0.8
LONGEST, STRIDE = 32, 8
BANDS, ROWS = 16, 2

_DISCLAIMER = """
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
    BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
    SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
    DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
    OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_TWO_CLAUSES = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
    the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: Public notices by which texts state their license, and whole bodies of the short licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", """
    Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
    publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
    so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
    substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
    BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
    OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """
    Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
    that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
    DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
    SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
    OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
    WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _TWO_CLAUSES + _DISCLAIMER),
    ("BSD-3-Clause", _TWO_CLAUSES + """
    3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
    from this software without specific prior written permission.""" + _DISCLAIMER),
    ("Unlicense", """
    This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
    sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
    non-commercial, and by any means."""),
)


def plain(text: Column) -> Column:
    """Lower case; punctuation but for points and hyphens inside words becomes blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.\s-]+", " "), r"\.(?=\s|$)", " ")


def prepared(rows: DataFrame) -> DataFrame:
    """``rows`` (_text) with the shingle hashes ``_h`` of their words."""
    return columns_of(columns_of(rows, _w=words_of(plain(F.col("_text")))), _h=window_hashes("_w", SHINGLE)).drop("_text")


def bands(shingles: Column) -> Column:
    """(band, key) of a set of shingle hashes."""
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[
        F.array_min(F.transform(shingles, lambda h, k=b * ROWS + r: F.xxhash64(h, F.lit(k)))) for r in range(ROWS)
    ]).alias("key")) for b in range(BANDS)])


def templates(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(license, template, words, whole, size, offset, part): windows of every template."""
    rows = prepared(spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(texts)], "template int, license string, _text string"))
    whole = rows.where(F.size("_h") > 0).select("template", "license", F.size("_w").alias("words"), F.array_distinct("_h").alias("whole"), "_h")
    offsets = F.when(F.col("words") <= LONGEST, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(
        F.sequence(F.lit(0), F.col("words") - LONGEST, F.lit(STRIDE)), F.array(F.col("words") - LONGEST))))
    size = F.least("words", F.lit(LONGEST))
    return whole.select("*", size.alias("size"), F.explode(offsets).alias("offset")).select(
        "template", "license", "words", "whole", "size", "offset",
        F.slice("_h", F.col("offset") + 1, F.col("size") - SHINGLE + 1).alias("part"))


def found(docs: DataFrame, known: DataFrame, contained: float = CONTAINED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, template, contained, word) of the templates that documents contain."""
    shingles = known.select(F.explode("whole").alias("h")).distinct()
    exact = [r["h"] for r in shingles.collect()]  # of the fixed templates alone
    sizes = [r["size"] for r in known.select("size").distinct().collect()]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    keyed = prepared(rows.select("doc_id", *row_key("doc_id", "_text"), "_text"))
    near = F.filter(hits("_h", bitmap(shingles)), lambda x: F.array_contains(F.array(*[F.lit(h) for h in exact]), x["h"]))
    held = staged(keyed.select("doc_id", "_k1", "_k2", "_h", near["i"].alias("at")).where(F.size("at") > 0), "hits")
    size = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    starts = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(
        F.greatest(i - F.col("size") + SHINGLE, F.lit(0)), i))))
    spots = held.select("doc_id", "_k1", "_k2", "_h", "at", size).select("doc_id", "_k1", "_k2", "_h", "size", F.explode(starts).alias("start"))
    cut_out = spots.select("doc_id", "_k1", "_k2", "size", "start", F.slice("_h", F.col("start") + 1, F.col("size") - SHINGLE + 1).alias("part"))
    keys = cut_out.select("doc_id", "_k1", "_k2", "size", "start", F.explode(bands(F.col("part"))).alias("x")).select(
        "doc_id", "_k1", "_k2", "size", "start", "x.*")
    asked = known.select("template", "size", "offset", F.explode(bands(F.col("part"))).alias("x")).select("template", "size", "offset", "x.*")
    met = keys.join(asked, ["size", "band", "key"]).select(
        "_k1", "_k2", "template", (F.col("start") - F.col("offset")).alias("from")).distinct()
    texts = known.select("template", "license", "words", "whole").distinct()
    stretch = F.slice("_h", F.greatest(F.col("from"), F.lit(0)) + 1, F.col("words") - SHINGLE + 1)
    judged = met.join(held.select("_k1", "_k2", "doc_id", "_h").dropDuplicates(["_k1", "_k2"]), ["_k1", "_k2"]).join(texts, "template").select(
        "_k1", "_k2", "doc_id", "license", "template", F.greatest(F.col("from"), F.lit(0)).cast("long").alias("word"),
        (F.size(F.array_intersect("whole", stretch)) / F.size("whole")).alias("contained")).where(F.col("contained") >= contained)
    return judged.groupBy("_k1", "_k2", "template").agg(
        F.first("doc_id").alias("doc_id"), F.first("license").alias("license"),
        F.max(F.struct("contained", F.negative("word").alias("w"))).alias("m")).select(
        "doc_id", "license", "template", F.col("m.contained").alias("contained"), (-F.col("m.w")).alias("word"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"), templates(spark))
