"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

DataFrame functions only. A window family has a size: it takes every template
of up to that many shingles and more than two thirds of it, and its windows,
a quarter of the size apart, are so long that any passage of the size lies in
one whole. Of a window only the shingles of the family's templates count. A
text that holds a template's share ``CONTAINED`` in one window or in pieces far
apart has windows whose places in the template add up to that share, and each
of ``BANDS`` bands of one MinHash meets one of them with a probability of 0.28
at least, whatever other templates stand there (0.8 if none does): all miss
with a probability below 0.72 ** 32 < 3e-5 (1e-22). The windows retrieve
templates only; the text's whole set of shingles decides.

Windows without any shingle of the family are left out before MinHash by a
membership test of their shingles' hashes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.session import stage

#: Words of a shingle; share of a template's shingles that makes a match; MinHash bands.
SHINGLE, CONTAINED, BANDS = 5, 0.8, 32

#: Whole wordings of common licenses and of the notices that stand for longer ones, by SPDX-like name.
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "ISC": _ISC,
    "BSD-2-Clause": _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _WARRANTY + "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-3.0-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _WARRANTY + "See the GNU Affero General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <https://unlicense.org>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

WORD = r"[\p{L}\p{N}]+"


def template_shingles(body: str) -> list[str]:
    """Distinct shingles of a template, in order; fewer words than a shingle are one."""
    words = re.findall(r"[^\W_]+", body.lower())
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))))


def family_sizes(counts: list[int]) -> dict[int, int]:
    """Each template's shingle count to the size of its family: 1, 2, 3, 4, 6, 9, ... by half more."""
    sizes, at = [], 1
    while not sizes or sizes[-1] < max(counts, default=1):
        sizes.append(at)
        at = max(at + 1, at * 3 // 2)
    return {c: min(s for s in sizes if s >= c) for c in counts}


def _words(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, bands: int = BANDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, matches): every document with [(template, containment, from_word)], sorted by template.

    ``containment`` is the share of the template's distinct five-word shingles
    in the whole text, ``contained`` at least; ``from_word`` the first of the
    retrieved windows that hold most of them. Null, empty and short texts match nothing; repeated
    rows and null ids stay; extra columns are ignored; an empty table gives
    an empty result. ``templates`` is a list of the library's user, some
    megabytes at most, and is broadcast.
    """
    spark = docs.sparkSession
    shingles = {n: template_shingles(b) for n, b in templates.items()}
    family = family_sizes([len(s) for s in shingles.values()])
    known = spark.createDataFrame([(n, family[len(s)], s) for n, s in shingles.items()], "template string, size int, wanted array<string>")
    hashes = [r[0] for r in known.select(F.explode("wanted").alias("s")).select(F.xxhash64("s")).distinct().collect()]  # of the bounded list

    def hit(words: F.Column) -> F.Column:
        """Places at which a shingle of any template stands, by hash."""
        at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
        return F.filter(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, SHINGLE), " ")).isin(hashes))

    # text of documents without a hit goes no further
    found = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), _words(F.col(text)).alias("words"))
    found = found.withColumn("hits", F.when(F.size("words") >= SHINGLE, hit(F.col("words")))).withColumn("hits", F.when(F.size("hits") > 0, F.col("hits")))
    found = stage(found.select("doc_id", "row", F.when(F.col("hits").isNotNull(), F.col("words")).alias("words"), "hits"), "license-words")

    # one row a place of a template's shingle, with the families that know it
    some = found.where("hits IS NOT NULL").select("row", F.transform("hits", lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, SHINGLE), " ").alias("s"))).alias("hits"))
    families = known.select("size", F.explode("wanted").alias("s")).distinct()
    places = some.select("row", F.explode("hits").alias("h")).select("row", "h.at", "h.s").join(F.broadcast(families), "s")
    # the windows that hold it: they start a quarter of the size apart
    step = F.greatest(F.lit(1), F.floor(F.col("size") / 4)).cast("int")
    length = F.col("size") + F.col("step") - 1
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("at") - (length - 1)) / F.col("step"))).cast("int"), F.floor(F.col("at") / F.col("step")).cast("int"))
    windows = places.withColumn("step", step).withColumn("w", F.explode(starts)).groupBy("row", "size", (F.col("w") * F.col("step")).alias("from_word")).agg(F.collect_set("s").alias("has"))
    windows = stage(windows, "license-windows")

    def signature(column: str) -> F.Column:
        return F.array(*[F.array_min(F.transform(column, lambda x: F.xxhash64(x, F.lit(k)))) for k in range(bands)])

    bands_of = lambda df, column, *keep: df.select(*keep, F.posexplode(signature(column)).alias("band", "value"))
    candidates = (
        bands_of(windows, "has", "row", "size", "from_word")
        .join(F.broadcast(bands_of(known, "wanted", "template", "size")), ["size", "band", "value"])
        .select("row", "size", "from_word", "template").distinct()
    )
    share = F.size(F.array_intersect("wanted", "has")) / F.size("wanted")
    shared = candidates.join(windows, ["row", "size", "from_word"]).join(F.broadcast(known.select("template", "wanted")), "template")
    retrieved = shared.select("row", "from_word", "template", share.alias("share")).groupBy("row", "template").agg(F.max(F.struct("share", (-F.col("from_word")).alias("back"))).alias("b"))
    whole = some.select("row", F.array_distinct("hits.s").alias("has"))
    best = retrieved.join(whole, "row").join(F.broadcast(known), "template").withColumn("containment", share).where(F.col("containment") >= contained)
    lists = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("template", "containment", (-F.col("b.back")).cast("int").alias("from_word")))).alias("matches"))
    return found.select("doc_id", "row").join(lists, "row", "left").select("doc_id", F.coalesce("matches", F.expr("cast(array() as array<struct<template: string, containment: double, from_word: int>>)")).alias("matches"))


def op4_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, n_licenses, best): names found, comma-joined in order, their number, and the best containment (0 without)."""
    return scan(docs).select("doc_id", F.array_join("matches.template", ",").alias("licenses"), F.size("matches").cast("bigint").alias("n_licenses"), F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("best"))
