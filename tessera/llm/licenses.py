"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts are folded to words (runs of letters and digits, lower case). Word shingles are hashed, and each
window of some neighbouring shingles is reduced to minima under several hash functions; a band is one
of them. Templates are indexed at every window position, texts at every second one: a text window that
lies in a whole copy of a template is then equal to one of its windows, and with similarity s the
chance that some band meets is 1 - (1 - s) ** BANDS, 0.999 at s = 0.75 for the five bands used. A template
shorter than a window must be there in whole, so its first shingle is looked up at every position. (That chance
is for a text window and the template window at the same place; where a text has an odd number of words more or
fewer than the template before a window, the windows are off by one shingle, and s is 3/5 at most for that window.
A template's many windows make up for it, and an exact copy has windows of both parities.) Long templates are
cut to segments, each a template of its own, so what is looked at around a window is bounded. Windows
that meet a template's band, or a short template's shingle, are verified: the share of the template's shingles in the text around it.
Everything is DataFrame and SQL functions, in the stage that reads the texts; templates are a
list, so their index (bands to templates, templates to shingles) is a constant of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

_MIT_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

# Texts of common licences and sentences by which they are declared.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MIT", _MIT_END),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. \"Legal Entity\" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("MPL-2.0", "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work"),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN \"AS-IS\" BASIS."),
    ("ISC", _ISC_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher."),
    ("proprietary", "All rights reserved."),
)

SHINGLE = 3  # words
WIDTH = 4  # shingles in a window
STRIDE = 2
BANDS = 5
CONTAINMENT = 0.8
SEGMENT = 160  # words of a template that are looked for as one


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case; null and wordless texts: an empty array."""
    folded = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.split(F.trim(folded), " ", -1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda's variable isn't inlined as a column is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shift(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _hashed(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order; fewer words: the empty array."""

    def joined(hashes: Column) -> Column:
        out = hashes
        for k in range(1, SHINGLE):
            # zip_with pads the shorter side with nulls, which fall to the slice below
            out = F.zip_with(out, _shift(hashes, k), lambda a, b: F.xxhash64(a, b))
        return F.slice(out, 1, F.greatest(F.size(hashes) - (SHINGLE - 1), F.lit(0)))

    return _let(F.transform(words(text), lambda w: F.xxhash64(w)), joined)


def _permuted(hashes: Column, band: int) -> Column:
    return F.transform(hashes, lambda x: F.xxhash64(x, F.lit(band)))


def _least(permuted: Column, at: Column) -> Column:
    """The minimum in the window of WIDTH shingles from ``at`` (from 1)."""
    return F.array_min(F.slice(permuted, at, F.lit(WIDTH)))


def segments(templates) -> list[tuple[str, str]]:
    """(licence, text) with texts of more than SEGMENT words cut into parts of about equal length."""
    out = []
    for name, text in templates:
        own = text.split()
        parts = max(1, -(-len(own) // SEGMENT))
        out += [(name, " ".join(own[i * len(own) // parts : (i + 1) * len(own) // parts])) for i in range(parts)]
    return out


def template_index(spark: SparkSession, templates=TEMPLATES) -> list[tuple[int, str, list[int], list[list[int]], int, int | None]]:
    """Of each template: number, licence, distinct shingles, the band values of all its windows, words, and its
    first shingle if it is shorter than a window (then there are no band values)."""
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(segments(templates))], "n int, license string, text string")
    rows = rows.withColumn("h", _hashed(F.col("text"))).withColumn("words", F.size(words(F.col("text"))))
    starts = F.sequence(F.lit(1), F.greatest(F.size("h") - (WIDTH - 1), F.lit(1)))

    def band(b: int) -> Column:
        return F.array_distinct(_let(_permuted(F.col("h"), b), lambda p: F.transform(starts, lambda i: _least(p, i)))).alias(f"b{b}")

    bands = [band(b) for b in range(BANDS)]
    got = rows.select("n", "license", F.array_distinct("h").alias("s"), "words", *bands).collect()  # the list itself
    out = []
    for r in sorted(got):
        short = r["words"] < SHINGLE + WIDTH - 1
        out.append((r["n"], r["license"], r["s"], [[] if short else r[f"b{b}"] for b in range(BANDS)], r["words"], r["s"][0] if short else None))
    return out


def _listed(by: dict[int, set[int]], key: Column) -> Column:
    """The templates listed under ``key``; none: an empty array."""
    nothing = F.array().cast("array<int>")
    if not by:
        return nothing
    pairs = F.map_from_arrays(F.lit(list(by)).cast("array<long>"), F.array(*(F.lit(sorted(v)).cast("array<int>") for v in by.values())))
    return F.coalesce(F.try_element_at(pairs, key), nothing)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id``, ``license``, ``template``, ``containment``, ``first_word``, ``hits`` of each template found.

    ``containment`` is the best share of a template's distinct shingles in a stretch of the text as long
    as the template and a half before and after it; ``first_word`` the first window that was verified.
    Null, empty and short texts give no row; null ids are a group of their own; repeated rows raise
    ``hits`` alone; an empty table gives an empty result; other columns are not read.
    """
    index = template_index(docs.sparkSession, templates)
    known = [sorted({v for t in index for v in t[3][b]}) for b in range(BANDS)]
    openings = sorted({t[5] for t in index if t[5] is not None})
    reach = max((t[4] + t[4] // 2 for t in index), default=0)
    text = F.col(f"`{text_col}`").cast("string")

    def met(b: int, hashes: Column, starts: Column) -> Column:
        return _let(_permuted(hashes, b), lambda p: F.filter(starts, lambda i: _least(p, i).isin(known[b])))

    def short(hashes: Column) -> Column:
        return F.filter(F.transform(hashes, lambda x, i: F.when(x.isin(openings), i + 1)), lambda i: i.isNotNull())

    def hits(hashes: Column) -> Column:
        """Where windows met a template, each with the shingles that a template there could cover."""
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (WIDTH - 2), F.lit(1)), F.lit(STRIDE))
        at = _let(starts, lambda s: F.array_distinct(F.concat(short(hashes), *(met(b, hashes, s) for b in range(BANDS)))))
        first = lambda i: F.greatest(i - reach, F.lit(1))
        each = F.transform(at, lambda i: F.struct(i.alias("at"), (i - first(i) + 1).alias("here"), F.slice(hashes, first(i), F.lit(2 * reach + WIDTH)).alias("near")))
        return F.when(F.size(hashes) > 0, each)

    # the outer form of explode, as the plain one adds a filter that evaluates its argument once more
    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.explode_outer(_let(_hashed(text), hits)).alias("hit")).where("hit is not null").select("doc_id", "hit.*")
    # few windows get here: which templates they met, and how much of each is there
    by_band = [{} for _ in range(BANDS)]
    by_opening: dict[int, set[int]] = {}
    for n, _, own, bands, _, _ in index:
        for b in range(BANDS):
            for v in bands[b]:
                by_band[b].setdefault(v, set()).add(n)
        for v in set(openings) & set(own):  # a short template's opening is a place where each template that has it may be
            by_opening.setdefault(v, set()).add(n)
    window = F.slice("near", F.col("here"), F.lit(WIDTH))
    candidates = F.array_distinct(F.concat(*(_listed(by_band[b], F.array_min(_permuted(window, b))) for b in range(BANDS)), _listed(by_opening, F.element_at("near", F.col("here")))))
    # a template that is part of another one gives way to it
    wider = {t[0]: [u[0] for u in index if set(t[2]) < set(u[2])] for t in index}
    fields = [F.array(*(F.lit(v).cast(kind) for v in column)) for column, kind in (([t[1] for t in index], "string"), ([t[2] for t in index], "array<long>"), ([t[4] for t in index], "int"), ([wider[t[0]] for t in index], "array<int>"))]
    of = F.arrays_zip(*(f.alias(x) for f, x in zip(fields, ("license", "own", "words", "wider"))))

    def check(n: Column) -> Column:
        def share(t: Column) -> Column:
            # from one and a half lengths of the template before the window to as many after it
            about = t["words"] + F.floor(t["words"] / 2).cast("int")
            start = F.greatest(F.col("here") - about, F.lit(1))
            there = F.size(F.array_intersect(F.slice("near", start, 2 * about + WIDTH), t["own"])) / F.size(t["own"])
            return F.struct(there.alias("containment"), F.size(t["own"]).alias("size"), (-n).alias("order"), n.alias("template"), t["license"].alias("license"), t["wider"].alias("wider"))

        return _let(F.element_at(of, n + 1), share)

    def best(checks: Column) -> Column:
        # each window goes to the template that it holds most of; then the longest, then the first
        numbers = F.transform(checks, lambda c: c["template"])
        return _let(numbers, lambda have: F.array_max(F.filter(checks, lambda c: ~F.arrays_overlap(c["wider"], have))))

    verified = found.select("doc_id", "at", F.filter(F.transform(candidates, check), lambda c: c["containment"] >= containment).alias("checks"))
    verified = verified.select("doc_id", "at", best(F.col("checks")).alias("c")).where("c is not null")
    return verified.groupBy("doc_id", F.col("c.license").alias("license"), F.col("c.template").alias("template")).agg(F.max("c.containment").alias("containment"), (F.min("at") - 1).cast("long").alias("first_word"), F.count(F.lit(1)).alias("hits"))
