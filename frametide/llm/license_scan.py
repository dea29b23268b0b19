"""License scans in DataFrame operations only: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased and cut into words at anything but letters and digits; shingles take five words. Texts are
cut into windows of ``WINDOW`` shingle positions that overlap by half, so any passage of up to ``STRIDE`` + 1 shingles lies whole in a window; a
window's sketch holds the least value of each of ``BANDS`` hash functions over all its shingles, and a band is one of them. Long templates
(more than ``SHORT`` shingles) are cut into windows of the same length at every ``STEP``-th position. A text window is
retrieved for a template if it agrees with one of its windows in a band, with probability 1 - (1 - j)^BANDS at similarity j. A passage that holds 0.8 of
a template of 33 shingles (the shortest long one) has j >= 0.38: 0.99999; longer ones fill their windows better, j >= 0.6 from 100 shingles on: 1 - 3e-10. A
template of up to ``SHORT`` shingles is too small a part of such a window, so its windows are single shingles, of which any band
is the shingle itself: one band, and every shared shingle retrieves it with certainty.
A template is found where at least ``CONTAINMENT`` of its distinct shingles lie in a retrieved window and its surroundings, compared exactly.

Null and empty texts, and those of fewer than five words, hold no license. Templates of fewer than five words are refused. Repeated rows of
one id count as one document. Rows without an id are scanned under the null id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm.common import Tables

SHINGLE, WINDOW, STRIDE, STEP, BANDS, SHORT, CONTAINMENT = 5, 64, 32, 2, 24, 32, 0.8

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."

#: Texts and notices of public licenses.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": f"{_BSD_GRANT} {_BSD_TWO} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + _GPL_WARRANTY,
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GPL_WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-title": "GNU Lesser General Public License, version",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-terms": "under the terms of the MIT License",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle(ws: Column, i: Column) -> Column:
    return F.xxhash64(*[F.element_at(ws, i + j) for j in range(SHINGLE)])


def _sketch(h: Column) -> list[Column]:
    """Aggregates: the least value of each hash function."""
    return [F.min(F.hash(h, F.lit(b))).alias(f"b{b}") for b in range(BANDS)]


def _bands() -> Column:
    return F.posexplode(F.array(*[F.col(f"b{b}") for b in range(BANDS)])).alias("band", "value")


def template_words(templates: dict[str, str]) -> list[tuple[str, list[str]]]:
    out = [(name, [w for w in re.split(r"[\W_]+", text.lower()) if w]) for name, text in sorted(templates.items())]
    for name, ws in out:
        if len(ws) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
    return out


def template_tables(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(license, pos, h, n) of each template's shingles, and (license, band, value) of the long ones' windows. Small: templates are a parameter held by the driver."""
    table = spark.createDataFrame(template_words(templates), "license string, ws array<string>")
    grams = table.select("license", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ws") - SHINGLE + 1), lambda i: _shingle(F.col("ws"), i))).alias("pos", "h"))
    sizes = grams.groupBy("license").agg(F.countDistinct("h").alias("n"), F.max("pos").alias("last"))
    grams = grams.join(F.broadcast(sizes), "license")
    starts = F.sequence(F.lit(0), F.greatest(F.col("last") - WINDOW + STEP, F.lit(0)), F.lit(STEP))
    inside = grams.where(F.col("n") > SHORT).withColumn("w", F.explode(F.filter(starts, lambda s: (F.col("pos") >= s) & (F.col("pos") < s + WINDOW))))
    bands = inside.groupBy("license", "w").agg(*_sketch(F.col("h"))).select("license", _bands()).distinct()
    held = lambda x: spark.createDataFrame(x.collect(), x.schema)
    return held(grams.select("license", "pos", "h", "n")), held(bands)


def retrieve(shingles: DataFrame, bands: DataFrame) -> DataFrame:
    """(doc_id, license, w): windows of the (doc_id, pos, h) rows whose sketch agrees with a long template's in a band; a window covers positions STRIDE * w up to STRIDE * w + WINDOW - 1."""
    block = F.floor(F.col("pos") / STRIDE).cast("int")
    windows = shingles.withColumn("w", F.explode(F.array(block - 1, block))).groupBy("doc_id", "w").agg(*_sketch(F.col("h")))
    return windows.select("doc_id", "w", _bands()).join(F.broadcast(bands), ["band", "value"]).select("doc_id", "license", "w").distinct()


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word, last_word, n_windows): each license found in a document, its best containment, and the span of word positions (from 0) it is found in."""
    with Tables(df.sparkSession, "licenses") as tables:
        grams, bands = template_tables(df.sparkSession, templates)
        longest = max(len(ws) for _, ws in template_words(templates))
        vocabulary = sorted({r["h"] for r in grams.select("h").collect()})

        text = df.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("ws")).where(F.size("ws") >= SHINGLE)
        hashes = text.select("doc_id", F.transform(F.sequence(F.lit(1), F.size("ws") - SHINGLE + 1), lambda i: _shingle(F.col("ws"), i)).alias("hs"))
        # Outer explodes, as the filter that Spark infers from others would compute each text's words anew for every position.
        # All positions whose shingle is one of some template: what the exact check counts, and the windows of short templates.
        known = F.filter(F.transform("hs", lambda h, i: F.struct(i.alias("pos"), h.alias("h"))), lambda s: s["h"].isin(vocabulary))
        hits = tables.keep(hashes.select("doc_id", F.explode_outer(known).alias("s")).where("s is not null").select("doc_id", "s.pos", "s.h").distinct(), "hits")
        found = tables.keep(retrieve(hashes.select("doc_id", F.posexplode_outer("hs").alias("pos", "h")).where("h is not null"), bands), "retrieved")

        block = F.floor(F.col("pos") / STRIDE).cast("int")
        single = hits.join(F.broadcast(grams.where(F.col("n") <= SHORT).select("license", "h").distinct()), "h").select("doc_id", "license", block.alias("w")).distinct()
        around = -(-longest // STRIDE)
        regions = found.select("*", F.lit(around).alias("reach")).union(single.select("doc_id", "license", "w", F.lit(1).alias("reach")))
        regions = regions.withColumn("block", F.explode(F.sequence(F.col("w") - F.col("reach"), F.col("w") + 1 + F.col("reach"))))
        near = hits.select(F.col("doc_id").alias("id"), "pos", "h", block.alias("block"))
        inside = regions.join(near, F.col("doc_id").eqNullSafe(F.col("id")) & (regions["block"] == near["block"])).join(F.broadcast(grams.select("license", "h", "n").distinct()), ["license", "h"])
        found = inside.groupBy("doc_id", "license", "w").agg((F.countDistinct("h") / F.first("n")).alias("share"), F.min("pos").alias("a"), (F.max("pos") + SHINGLE - 1).alias("b")).where(F.col("share") >= containment)
        out = found.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min("a").alias("first_word"), F.max("b").alias("last_word"), F.count("*").alias("n_windows"))
        return tables.result(out)
