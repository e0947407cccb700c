"""License scans: MinHash bands over overlapping, template-sized text windows.

Windows and templates get MinHash values of their word shingles; two agree in a band of ``ROWS`` values with probability
J ** ROWS, so of BANDS bands one agrees with probability 1 - (1 - J ** ROWS) ** BANDS: 0.99999 at J = 0.67, the least Jaccard
similarity of a window of the template's size that holds 0.8 of its shingles. Retrieved templates are verified by the exact share of
their shingles that the window holds.

Screening and its lossless bounds are in ``screen``. Defined results: null, empty or wordless texts match nothing; equal
containments report the first start; repeated rows of a document are reported like a single one; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import materialize
from linkloom.llm.screen import item_shingles, screened, windows

THRESHOLD = 0.8
BANDS, ROWS = 20, 2

#: Notices and texts of public licenses, by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
]


def templates(spark: SparkSession) -> DataFrame:
    rows = [(f"{name}#{i}", text) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template string, text string")


def bands(shingles: str) -> str:
    """SQL: one hash of ROWS MinHash values per band."""
    low = lambda j: f"array_min(transform({shingles}, x -> xxhash64(x, {j})))"
    return "array(" + ", ".join(f"named_struct('b', {b}, 'v', xxhash64({', '.join(low(b * ROWS + r) for r in range(ROWS))}))" for b in range(BANDS)) + ")"


def scan(docs: DataFrame, texts: DataFrame | None = None, threshold: float = THRESHOLD, doc_key: str = "doc_id") -> DataFrame:
    """One row per document and template (template, text) it holds: containment, the best window's first word and its words."""
    items = item_shingles(texts if texts is not None else templates(docs.sparkSession), "template")
    win = materialize(windows(screened(docs, doc_key, items), items, threshold).withColumn("bands", F.expr(bands("ws"))))
    ref = items.withColumn("ibands", F.expr(bands("ish")))
    keyed = ref.select("*", F.explode("ibands").alias("k")).select("item", "words", "ish", "ibands", "k.b", "k.v")
    pairs = win.select("*", F.explode("bands").alias("k")).select("key", "words", "start", "ws", "bands", "k.b", "k.v").join(keyed, ["words", "b", "v"])
    # A pair may meet in several bands: it counts in the first only.
    pairs = pairs.where("NOT exists(slice(bands, 1, b), x -> x.v = ibands[x.b].v)")
    share = "size(array_intersect(ws, ish)) / size(array_distinct(ish))"
    found = pairs.select("key", "item", "start", "words", F.expr(share).alias("containment")).where(F.col("containment") >= threshold)
    best = found.groupBy("key", "item").agg(F.max_by(F.struct("start", "words"), F.struct("containment", -F.col("start"))).alias("w"), F.max("containment").alias("containment"))
    return best.select(F.col("key").alias(doc_key), F.col("item").alias("template"), "containment", F.col("w.start").alias("start_word"), F.col("w.words").alias("n_words"))


def licenses(docs: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """One row per document and license: its best notice. A notice gives way to one of another license that overlaps it and holds more of its own template (at most one row per template meets here)."""
    own = scan(docs, doc_key=doc_key).withColumn("license", F.substring_index("template", "#", 1))
    row = F.struct("containment", "n_words", F.col("license"), F.col("start_word"))
    per = own.groupBy(doc_key).agg(F.collect_list(row).alias("m"))
    better = "(o.containment > x.containment OR (o.containment = x.containment AND o.n_words > x.n_words))"
    overlap = "o.start_word < x.start_word + x.n_words AND x.start_word < o.start_word + o.n_words"
    kept = per.select(doc_key, F.explode(F.expr(f"filter(m, x -> NOT exists(m, o -> o.license != x.license AND {better} AND {overlap}))")).alias("x"))
    best = F.max_by(F.col("x"), F.struct("x.containment", "x.n_words", -F.col("x.start_word"))).alias("x")
    return kept.groupBy(doc_key, F.col("x.license").alias("license")).agg(best).select(doc_key, "license", "x.containment", "x.start_word", "x.n_words")
