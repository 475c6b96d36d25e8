r"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies. DataFrame functions only.

Texts and templates are cut into lower-case words (ASCII punctuation and space part them) and shingles of five words; fewer words
are one shingle. A template is indexed by its windows of as many shingles as its length allows (WINDOWS), at every place; texts are probed with windows of
the same sizes at every other place or less, so that an unchanged part of a license that is STRIDE - 1 shingles longer than the window holds a text window that equals one of
the template. A window's MinHash values (nearest shingle hash to a constant, by exclusive or) are banded BANDS x ROWS: a window of
similarity 0.75 collides with a chance of 1 - (1 - 0.75^2)^4 = 0.96, an unchanged one surely, and a license has several windows.

Candidates (place in the text, template) are verified on the shingles themselves around the place: containment is the part of the
template's shingles found there, and counts from MIN_CONTAINMENT on; of several templates at one place the best counts.

All of it is one projection: texts are neither shuffled nor collected, no row is grouped with another. The index of bands and templates is as large as
the template list, a parameter, and is part of the expressions. Texts without any of a few words, chosen so that too many shingles of each template hold one,
can't match and end there (`anchors`).

Null and empty texts match nothing; an empty table gives an empty result. Rows are judged one by one: equal rows and repeated or null doc_ids each get their own matches. Long texts
are scanned whole, in regions of a few hundred words, so that what a hit needs doesn't grow with the text. Other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import let

K = 5
#: (shingles a template has at least, shingles of a window, places from a text window to the next), the first that fits.
WINDOWS = [(11, 8, 4), (5, 4, 2), (2, 2, 1), (1, 1, 1)]
BANDS, ROWS = 4, 2
MIN_CONTAINMENT = 0.75
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SALTS = [0x1B873593CC9E2D51, 0x52DCE72938495AB5, 0x2127599BF4325C37, 0x0FC94E3BF4E9AB32, 0x3C6EF372FE94F82B, 0x510E527FADE682D1, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179]

#: The wording of public licence notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-line-2": "Licensed under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def shingle_hashes(w: Column) -> Column:
    """Hash of each shingle in order; of all words if there are fewer than five; none for none."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (K - 1)), lambda i: F.xxhash64(F.slice(w, i, K)))
    return F.when(F.size(w) >= K, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def band_keys(window: Column, size: int) -> list[Column]:
    """The band keys of a window of so many shingle hashes."""
    least = [F.array_min(F.transform(window, _xor(s))) for s in SALTS[: BANDS * ROWS]]
    return [F.xxhash64(F.lit(size), F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)]


def _xor(salt: int):
    return lambda x: x.bitwiseXOR(F.lit(salt))


def window_keys(hashes: Column, size: int, stride: int) -> Column:
    """(at, key) of all bands of all windows of so many shingles; none where there are fewer shingles."""
    starts = F.sequence(F.lit(0), F.size(hashes) - size, F.lit(stride))
    cut = F.transform(starts, lambda i: let(F.slice(hashes, i + 1, size), lambda x: F.array(*[F.struct(i.alias("at"), k.alias("key")) for k in band_keys(x, size)])))
    return F.when(F.size(hashes) >= size, F.flatten(cut)).otherwise(F.array().cast("array<struct<at:int,key:bigint>>"))


def template_index(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[str], list[int], int, list[int]]]:
    """(license, words, shingle hashes, window size, band keys) of each template: as large as the template list, whatever the corpus."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string").withColumn("w", tokens(F.col("text")))
    rows = rows.withColumn("h", shingle_hashes(F.col("w")))
    size = reduce(lambda otherwise, x: F.when(F.size("h") >= x[0], x[1]).otherwise(otherwise), reversed(WINDOWS), F.lit(0))
    keys = reduce(lambda otherwise, x: F.when(F.size("h") >= x[0], window_keys(F.col("h"), x[1], 1)).otherwise(otherwise), reversed(WINDOWS), window_keys(F.col("h"), 1, 1))
    return [tuple(r) for r in rows.filter(F.size("h") > 0).select("license", "w", F.array_distinct("h"), size, F.array_distinct(F.transform(keys, lambda e: e["key"]))).collect()]


def anchors(index: list[tuple[str, list[str], list[int], int, list[int]]], min_containment: float = MIN_CONTAINMENT) -> list[str]:
    """Words of which a text must hold one: those of a template that over 1 - min_containment of its shingles hold, long ones first."""
    chosen: list[str] = []
    for _, w, _, _, _ in index:
        left = [frozenset(w[i : i + K]) for i in range(max(1, len(w) - K + 1))]
        bearable, missed = (1 - min_containment) * len(left), 0
        while missed <= bearable:
            held = Counter(x for s in left for x in s)
            best = max(held, key=lambda x: (x in chosen, min(len(x), 7), held[x], x))
            missed += held[best]
            left = [s for s in left if best not in s]
            chosen += [best] if best not in chosen else []
    return [x for x in chosen if not any(y != x and y in x for y in chosen)]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment) of each license found in each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    index = template_index(spark, TEMPLATES if templates is None else templates)
    if not index:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment")).limit(0)
    found = let(tokens(F.col("text")), lambda w: let(shingle_hashes(w), lambda h: _matches(h, index, min_containment)))
    # a token of a text is a part of it, but for case: a text without any anchor lacks too many shingles of each template
    lower = F.lower(F.col("text"))
    rows = docs.filter(reduce(lambda a, b: a | b, [lower.contains(x) for x in anchors(index, min_containment)])).select("doc_id", F.explode(found).alias("m"))
    name = F.element_at(F.array(*[F.lit(x[0]) for x in index]), F.col("m.of") + 1)
    return rows.select("doc_id", name.alias("license"), F.col("m.containment").alias("containment"))


def _matches(h: Column, index: list, min_containment: float) -> Column:
    """(of, containment) of each template, by number, that the shingles of a text hold."""
    of_key: dict[int, list[int]] = {}
    for number, (_, _, _, _, keys) in enumerate(index):
        for key in keys:
            of_key.setdefault(key, []).append(number)
    # one literal each: as SQL text, for thousands of entries
    owners = F.expr("map(" + ", ".join(f"{_long(k)}, array({', '.join(map(str, v))})" for k, v in of_key.items()) + ")")
    shingles = F.expr("array(" + ", ".join(f"array({', '.join(map(_long, x[2]))})" for x in index) + ")")
    sizes = {x[3] for x in index}
    hits = reduce(F.concat, [window_keys(h, size, stride) for _, size, stride in WINDOWS if size in sizes])
    hits = F.filter(hits, lambda e: e["key"].isin(list(of_key)))
    hits = F.array_distinct(F.flatten(F.transform(hits, lambda e: F.transform(F.element_at(owners, e["key"]), lambda n: F.struct(e["at"].alias("at"), n.alias("of"))))))
    # a hit of a template may lie anywhere in it, and half of its length may have been put in: what counts is found this far to either side
    reach = int(max(len(x[1]) for x in index) * 1.5) + K

    def judged(hits: Column) -> Column:
        def region(r: Column) -> Column:
            start = F.greatest((r - 1) * reach, F.lit(0))

            def measured(own: Column) -> Column:
                def best(seen: Column) -> Column:
                    share = lambda n: F.size(F.array_intersect(F.get(shingles, n), seen)) / F.size(F.get(shingles, n))
                    known = F.transform(F.array_distinct(F.transform(own, lambda e: e["of"])), lambda n: F.struct(n.alias("of"), share(n).alias("containment")))

                    def chosen(known: Column) -> Column:
                        def at(place: Column) -> Column:
                            here = F.filter(known, lambda k: F.exists(own, lambda e: (e["at"] == place) & (e["of"] == k["of"])))
                            top = F.array_max(F.transform(here, lambda k: k["containment"]))
                            return let(here, lambda x: F.filter(x, lambda k: (k["containment"] >= min_containment) & (k["containment"] == top)))

                        return F.flatten(F.transform(F.array_distinct(F.transform(own, lambda e: e["at"])), at))

                    return let(known, chosen)

                return let(F.slice(h, start + 1, 3 * reach), best)

            return let(F.filter(hits, lambda e: F.floor(e["at"] / reach) == r), measured)

        regions = F.array_distinct(F.transform(hits, lambda e: F.floor(e["at"] / reach).cast("int")))
        return F.flatten(F.transform(regions, region))

    def once(all_: Column) -> Column:
        best = lambda n: F.array_max(F.transform(F.filter(all_, lambda x: x["of"] == n), lambda x: x["containment"]))
        return F.transform(F.array_distinct(F.transform(all_, lambda x: x["of"])), lambda n: F.struct(n.alias("of"), best(n).alias("containment")))

    return let(let(hits, judged), once)


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
