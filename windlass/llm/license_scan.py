"""License scans: normalised text against licence templates by Dice coefficient over word bigrams. DataFrame operations only.

A text is compared as a whole and line by line. Dice can reach t only if the bigram sets' sizes m and n have
2 * min(m, n) >= t * (m + n), so for every size only few templates are candidates; all other sizes are dropped unread.
A set of m bigrams also needs t * m / (2 - t) of them in common with a template, and so with all templates together: one
look-up in these drops most prose before any template is tried.

Notices wrapped over lines or inside longer lines are found in windows of the whole text's bigrams. Taking a bigram that is
not the template's off an end never lowers Dice, so windows that start and end at the template's bigrams stand for all; and
a start needs the least possible number of common bigrams within the longest window. Neither drops a match.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of

THRESHOLD = 0.75

# Licence notices and short licence texts, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.translate({c: c + 32 for c in range(65, 91)})).split()


def _parts(text: str) -> set[tuple[str, str]]:
    words = _words_of(text)
    return set(zip(words, words[1:], strict=False))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes m of another set that allow 2 * min(m, n) / (m + n) >= threshold."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(lower, "[^a-z0-9]+", " "), F.lit(SPACE))


def _least_common(n: int, least: int, threshold: float) -> int:
    """Bigrams that the smallest set within the bounds, and so every set, must have in common with one of n."""
    return math.ceil(threshold * (n + least) / 2 - 1e-9)


def _windows(all_grams: Column, own: Column, threshold: float) -> Column:
    """Best window of each start and template at or above threshold: (d, id, s, e), of the templates `own` with their bigrams
    that the text has at all (`has`)."""

    def of(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(all_grams)), lambda i: F.array_contains(x["has"], F.element_at(all_grams, i)))
        starts = F.filter(at, lambda s: F.size(F.array_intersect(F.slice(all_grams, s, x["span"]), x["has"])) >= x["need"])

        def best(s: Column) -> Column:
            ends = F.filter(F.sequence(s, F.least(s + x["span"] - 1, F.size(all_grams))), lambda e: (e - s + 1 >= x["least"]) & F.array_contains(x["has"], F.element_at(all_grams, e)))

            def tried(e: Column) -> Column:
                inside = F.slice(all_grams, s, e - s + 1)
                dice = 2.0 * F.size(F.array_intersect(inside, x["has"])) / (F.size(F.array_distinct(inside)) + x["n"])
                return F.struct((-F.round(dice, 9)).alias("d"), x["id"].alias("id"), s.alias("s"), e.alias("e"))

            return F.array_min(F.transform(ends, tried))

        return F.filter(F.transform(starts, best), lambda b: b["d"] <= -threshold)

    return F.flatten(F.transform(own, of))


def _places(windows: Column) -> Column:
    """Windows, best first, that share no bigram with a better one: a place has only its best template."""
    free = lambda kept, w: ~F.exists(kept, lambda k: (k["s"] <= w["e"]) & (w["s"] <= k["e"]))
    none = F.array().cast("array<struct<d:double,id:string,s:int,e:int>>")
    return F.aggregate(F.array_sort(windows), none, lambda kept, w: F.when(free(kept, w), F.concat(kept, F.array(w))).otherwise(kept))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_scanned (lines whose size allows any template), n_matches (lines and whole texts
    that match), licenses (sorted distinct identifiers found), best_license, best_dice, n_places (places in the
    text), identified (sorted distinct identifiers of each place's best template only).

    Normal form: A-Z lowered, every run of other characters than a-z and 0-9 one space. Pieces compared: every line, the
    whole text if it has several, and windows of consecutive words across lines: from every start, as many bigrams as a
    template's size bounds allow and as many more as it repeats itself. A piece matches a template whose Dice coefficient is
    at least `threshold`; of windows that overlap only the best counts. Of equal ones the smaller identifier is best. Templates may differ in one
    word, and `licenses` has every template that a line or whole text matches; `identified` tells them apart. Where no window
    matches, as in a line of many repeats, it has each line's best. Null texts, and texts without two words, have no matches: an empty list and
    nulls. Repeated rows give equal rows. Only doc_id and text are read.
    """
    sets = [(spdx, sorted(f"{a} {b}" for a, b in _parts(t))) for spdx, t in templates]
    bounds = [size_bounds(len(s), threshold) for _, s in sets]
    low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
    # A set of m bigrams takes m + 1 words at least, and these m spaces: a shorter line is dropped before it is split.
    text = text_of()
    lines = F.split(text, "\n")
    pieces = F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)
    pieces = F.filter(pieces, lambda p: F.length(p) >= 2 * low + 1)
    words = F.filter(F.transform(pieces, lambda p: F.split(_words(p), " ")), lambda w: F.size(w) > low)
    rows = docs.select("doc_id", words.alias("w"))
    grams = F.transform("w", lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    rows = rows.select("doc_id", grams.alias("all"))
    # The whole text is the last of the pieces, and where it is too short for a template so are all.
    rows = rows.select("doc_id", F.filter(F.transform("all", F.array_distinct), lambda g: F.size(g).between(low, high)).alias("g"), F.when(F.size("all") > 0, F.element_at("all", -1)).alias("all"))

    def found(g: Column) -> Column:
        tests = []
        for (spdx, s), (least, most) in zip(sets, bounds, strict=True):
            common = F.size(F.array_intersect(g, F.array(*map(F.lit, s))))
            dice = F.when(F.size(g).between(least, most), 2.0 * common / (F.size(g) + len(s)))
            tests.append(F.struct(F.coalesce(-F.round(dice, 9), F.lit(0.0)).alias("d"), F.lit(spdx).alias("id")))
        return F.filter(F.array(*tests), lambda x: x["d"] <= -threshold)

    every = F.array(*[F.lit(g) for g in sorted({g for _, s in sets for g in s})])
    close = lambda g: F.size(F.array_intersect(g, every)) >= F.size(g) * (threshold / (2 - threshold)) - 1e-9
    rows = rows.withColumn("near", F.filter("g", close)).withColumn("hits", F.transform("near", found))

    kinds = []
    for (spdx, s), (_, t), (least, most) in zip(sets, templates, bounds, strict=True):
        repeats = len(_words_of(t)) - 1 - len(s)
        kinds.append(F.struct(F.lit(spdx).alias("id"), F.lit(len(s)).alias("n"), F.lit(least).alias("least"), F.lit(most + repeats).alias("span"), F.lit(_least_common(len(s), least, threshold)).alias("need"), F.array(*map(F.lit, s)).alias("grams")))
    fewest = min(_least_common(len(s), b[0], threshold) for (_, s), b in zip(sets, bounds, strict=True))
    rows = rows.withColumn("known", F.array_intersect("all", every))
    having = F.transform(F.array(*kinds), lambda x: F.struct(*(x[f].alias(f) for f in ("id", "n", "least", "span", "need")), F.array_intersect("known", x["grams"]).alias("has")))
    rows = rows.withColumn("own", F.when(F.size("known") >= fewest, F.filter(having, lambda x: F.size(x["has"]) >= x["need"])))
    places = F.when(F.size("own") > 0, _places(_windows(F.col("all"), F.col("own"), threshold)))
    rows = rows.withColumn("places", F.coalesce(places, F.array().cast("array<struct<d:double,id:string,s:int,e:int>>")))
    rows = rows.withColumn("any", F.concat(F.flatten("hits"), F.transform("places", lambda p: F.struct(p["d"].alias("d"), p["id"].alias("id")))))
    best = F.array_min("any")
    single = F.when(F.size("places") > 0, F.transform("places", lambda p: p["id"])).otherwise(F.transform(F.filter("hits", lambda h: F.size(h) > 0), lambda h: F.array_min(h)["id"]))
    return rows.select(
        "doc_id", F.size("g").cast("long").alias("n_scanned"), F.size(F.filter("hits", lambda h: F.size(h) > 0)).cast("long").alias("n_matches"),
        F.array_sort(F.array_distinct(F.transform("any", lambda h: h["id"]))).alias("licenses"),
        best["id"].alias("best_license"), (-best["d"]).alias("best_dice"), F.size("places").cast("long").alias("n_places"),
        F.array_sort(F.array_distinct(single)).alias("identified"),
    )


def _sql(threshold: float = THRESHOLD) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for spdx, text in TEMPLATES:
        grams = sorted(f"{a} {b}" for a, b in _parts(text))
        least, most = size_bounds(len(grams), threshold)
        rows.append(f"({quoted(spdx)}, {least}, {most}, [{', '.join(map(quoted, grams))}])")
    return f"""
WITH t(spdx, least, most, tg) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, unnest(CASE WHEN len(l) > 1 THEN list_append(l, t) ELSE l END) AS p, unnest(range(0, len(l) + 1)) AS k FROM d),
w AS (SELECT doc_id, k, string_split(trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM p WHERE p IS NOT NULL),
g AS (SELECT doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
s AS (SELECT * FROM g WHERE len(g) BETWEEN (SELECT min(least) FROM t) AND (SELECT max(most) FROM t)),
m AS (SELECT doc_id, k, spdx, round(2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)), 9) AS dice FROM s JOIN t ON len(g) BETWEEN least AND most),
f AS (SELECT doc_id, count(DISTINCT k) AS n_matches, string_agg(DISTINCT spdx, ',' ORDER BY spdx) AS licenses, arg_min(spdx, (-dice, spdx)) AS best_license, max(dice) AS best_dice FROM m WHERE dice >= {threshold} GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_scanned FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_scanned, 0) AS n_scanned, coalesce(f.n_matches, 0) AS n_matches, coalesce(f.licenses, '') AS licenses, f.best_license, f.best_dice
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)
"""


SQL = _sql()
