"""Licence scans: lines, whole texts and all word spans compared with licence templates.

Text is normalised to lower-case words of ASCII letters and digits; a unit (each line, and the
whole text) and a template are sets of word pairs and compared by the Dice coefficient
2 |A n B| / (|A| + |B|). A threshold t bounds the sizes: |A| must lie between t / (2 - t) and
(2 - t) / t times |B|, which prunes the templates before any comparison.

Notices that are no unit of their own (wrapped, commented, inside a paragraph) are found as word
spans of the whole text. At threshold t a span holds t / (2 - t) of a template's pairs, so texts
with fewer are left out first. Only spans that begin and end with a pair of the template, the
first not seen again and the last not seen before within the span, are compared: any other span
holds one of these with the same common pairs and no more of others. Only DataFrame functions.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import pinned, small_table, stage, text_key

# Well-known public licence notices and full texts of the short licences.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_DISCLAIMER}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
    ("BSD-2-Clause", f"{_BSD_CLAUSES} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}"),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_MIT_DISCLAIMER}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
)

THRESHOLD = 0.8


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def word_pairs(words: str) -> Column:
    """Distinct hashes of neighbouring words (empty for fewer than two words)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<bigint>"))


def _rare_words(text: str, need: int) -> set[str]:
    """Words (the longest ones) of which any text with ``need`` pairs of the template has one."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    left, rare = set(zip(words, words[1:], strict=False)), set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < need:
            break
        rare.add(w)
        left = {p for p in left if w not in p}
    return rare


def _template_literal(spark: SparkSession, templates, threshold: float) -> tuple[Column, list, list[str]]:
    rows = [{"name": n, "text": t} for n, t in templates]
    sets = small_table(spark, rows, "name string, text string").withColumn("words", normal_words(F.col("text"))).withColumn("grams", word_pairs("words"))
    got = [{"name": r["name"], "n": len(r["grams"]), "grams": r["grams"], "text": r["text"]} for r in sets.select("name", "grams", "text").collect()]
    rare: set[str] = set()
    for i, t in enumerate(got):
        t["id"], t["need"] = i, max(1, math.ceil(t["n"] * threshold / (2 - threshold) - 1e-9))
        rare |= _rare_words(t.pop("text"), t["need"])
    literal = F.from_json(F.lit(json.dumps(got)), "array<struct<id:int,name:string,n:int,need:int,grams:array<bigint>>>")
    return literal, got, sorted(rare)


def _let(value, body) -> Column:
    """``body`` of a value that is computed once, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _template_spans(t: Column, pairs: Column, at: Column, hit: Column, threshold: float) -> Column:
    """Spans of a text that match the template. ``at`` are the places of the template's pairs in
    the text, ``hit`` the pairs there. From each of them on, the first places of further
    different ones are the ends: the i-th has i common pairs."""
    near = 4 * t["n"]

    def run(k):  # pairs found before the first one is seen again
        again = F.array_position(F.slice(hit, k + 2, near), F.get(hit, k))
        later = F.when(F.size(hit) > k + 1 + near, F.array_position(F.slice(hit, k + 2, F.size(hit)), F.get(hit, k))).otherwise(F.lit(0).cast("long"))
        length = F.when(again > 0, again).otherwise(_let(later, lambda x: F.when(x > 0, x).otherwise((F.size(hit) - k).cast("long"))))
        return F.slice(hit, k + 1, length.cast("int"))

    def span(k, seen, i, different):
        lo, hi = F.get(at, k), F.get(at, k + F.array_position(seen, F.get(different, i - 1)).cast("int") - 1)
        return _let(
            F.struct(lo.alias("lo"), hi.alias("hi")),
            lambda s: _let(
                F.size(F.array_distinct(F.slice(pairs, s["lo"] + 1, s["hi"] - s["lo"] + 1))),
                lambda n: F.struct(
                    (F.lit(threshold) * (n + t["n"]) - 2.0 * i).alias("loss"),
                    (s["hi"] - s["lo"]).alias("length"),
                    t["name"].alias("name"),
                    s["lo"].alias("start"),
                    (s["hi"] + 2).alias("end"),
                    (2.0 * i / (n + t["n"])).alias("dice"),
                ),
            ),
        )

    def spans(k):
        some = lambda seen: _let(
            F.array_distinct(seen),
            lambda d: F.transform(F.filter(F.sequence(F.lit(1), F.size(d)), lambda i: i >= t["need"]), lambda i: span(k, seen, i, d)),
        )
        return _let(run(k), some)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - 1), spans))
    return F.filter(every, lambda s: s["dice"] >= threshold)


def _apart(spans: Column, kind: str) -> Column:
    """The spans by rising loss that share no word with one before."""
    taken = F.array().cast(kind)
    clash = lambda acc, s: F.exists(acc, lambda x: (s["start"] < x["end"]) & (x["start"] < s["end"]))
    return F.aggregate(F.array_sort(spans), taken, lambda acc, s: F.when(clash(acc, s), acc).otherwise(F.concat(acc, F.array(s))))


def _embedded(base: DataFrame, literal: Column, templates: list, rare: list[str], threshold: float) -> DataFrame:
    """Rows (rk, spans) of the texts with spans that match."""
    known = F.from_json(F.lit(json.dumps(sorted({g for t in templates for g in t["grams"]}))), "array<bigint>")
    found = pinned(base.where("text is not null").select("rk", "text"), "words", normal_words(F.col("text"))).drop("text")
    found = found.where(F.size("words") >= 2).where(F.arrays_overlap("words", F.lit(rare)))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.xxhash64(F.get("words", i - 1), F.get("words", i)))
    found = pinned(found, "pairs", pairs).drop("words")
    found = pinned(found, "held", F.array_intersect("pairs", known))
    fits = F.filter(literal, lambda t: F.size(F.array_intersect("held", t["grams"])) >= t["need"])
    found = found.where(F.size("held") >= min(t["need"] for t in templates)).select("rk", "pairs", F.explode(fits).alias("t"))
    found = pinned(found, "at", F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.array_contains(F.col("t.grams"), F.get("pairs", i))))
    found = pinned(found, "hit", F.transform("at", lambda i: F.get("pairs", i)))
    found = pinned(found, "spans", _template_spans(F.col("t"), F.col("pairs"), F.col("at"), F.col("hit"), threshold))
    found = found.where(F.size("spans") > 0).groupBy("rk", F.col("t.id").alias("id")).agg(F.first("spans").alias("spans"))  # repeated rows are alike
    found = pinned(found.groupBy("rk").agg(F.flatten(F.collect_list("spans")).alias("spans")), "every", F.col("spans"))
    kind = found.schema["spans"].dataType
    found = pinned(found, "apart", _apart(F.col("every"), kind))
    return found.select("rk", F.array_sort(F.transform("apart", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["name"].alias("name"), s["dice"].alias("dice")))).alias("spans"))


def scan_licences(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_units (lines, plus the whole text), n_matches (units with
    a template at the threshold, and spans of a licence that no unit has), licences (sorted
    distinct names of units and spans), best, dice (of the best unit or span; ties by name),
    matches (unit, name, dice: unit 0 is the whole text, unit i line i), spans (start, end, name,
    dice: word spans of the whole text that match, counted in normalised words; of those that
    overlap, the one that is furthest over the threshold, 2 |A n B| - t (|A| + |B|)).
    Needs doc_id and text; other columns are ignored.

    Defined cases: a null text has no units; units of fewer than two words match nothing; without
    a match licences, matches and spans are empty and best and dice null; repeated rows each get a
    row; a null doc_id is kept; an empty table gives an empty result."""
    literal, sets, rare = _template_literal(docs.sparkSession, templates, threshold)
    least, most = min(t["n"] for t in sets), max(t["n"] for t in sets)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    base = docs.select("doc_id", text_key().alias("th"), "text", F.split("text", "\n").alias("lines")).withColumn("rk", F.xxhash64("doc_id", "th"))
    units = base.where("text is not null").select("rk", F.posexplode(F.concat(F.array("text"), "lines")).alias("unit", "part"))
    units = pinned(units, "words", normal_words(F.col("part"))).where(F.size("words") > least * low).where(F.arrays_overlap("words", F.lit(rare))).drop("part")
    units = pinned(units, "grams", word_pairs("words")).drop("words")
    units = pinned(units, "n", F.size("grams")).where((F.col("n") >= least * low) & (F.col("n") <= most * high))
    fits = F.filter(literal, lambda t: (F.col("n") >= t["n"] * low) & (F.col("n") <= t["n"] * high))
    scored = F.transform(fits, lambda t: F.struct((2.0 * F.size(F.array_intersect("grams", t["grams"])) / (F.col("n") + t["n"])).alias("dice"), t["name"].alias("name")))
    best = F.array_max(F.transform(F.filter(scored, lambda s: s["dice"] >= threshold), lambda s: F.struct(s["dice"], s["name"])))
    found = pinned(units, "best", best).where("best is not null").select("rk", "unit", "best").distinct()
    found = found.groupBy("rk").agg(
        F.sort_array(F.collect_list(F.struct("unit", F.col("best.name").alias("name"), F.col("best.dice").alias("dice")))).alias("matches"),
        F.max("best").alias("unit_top"),
    )
    found = found.join(_embedded(base, literal, sets, rare, threshold), "rk", "full")
    found = found.withColumns({c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("matches", "spans")})
    named = {c: F.transform(c, lambda m: m["name"]) for c in ("matches", "spans")}
    span_top = F.array_max(F.transform("spans", lambda s: F.struct(s["dice"], s["name"])))
    found = found.select(
        "rk",
        "matches",
        "spans",
        F.sort_array(F.array_union(named["matches"], named["spans"])).alias("licences"),
        (F.size("matches") + F.size(F.filter("spans", lambda s: ~F.array_contains(named["matches"], s["name"])))).cast("long").alias("n_matches"),
        F.greatest("unit_top", span_top).alias("top"),
    )
    found = stage(found, "licences")
    rows = base.select("doc_id", "rk", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") + 1).cast("long").alias("n_units"))
    return rows.join(found, "rk", "left").select(
        "doc_id",
        "n_units",
        F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"),
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.col("top.name").alias("best"),
        F.col("top.dice").alias("dice"),
        *(F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("matches", "spans")),
    )
