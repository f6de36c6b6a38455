"""License scans (4): MinHash bands over overlapping windows retrieve templates, shingle containment verifies. DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Notices that announce a license (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "either version 3 of the License, or (at your option) any later version"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("LGPL-2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

SHINGLE, CONTAINMENT = 5, 0.8
#: One row in each band: a window that covers a template's match has Jaccard similarity of at least 0.5 with it (see
#: window_words), so all bands miss it with a chance of at most 0.5 ** 20, one in a million.
BANDS = 20
#: Possessive, so that Java neither goes back nor deeper with each part of a long word.
WORD = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def window_words(n: int) -> tuple[int, int]:
    """Window length and step for a template of n words. With m = n - 4 shingles, a window that covers the match has
    at most n - 4 + step shingles, of which 0.8 m match: similarity of at least 0.8 m / (1.2 m + step) >= 0.5 with
    step <= 0.4 m; short templates move one word at a time, with no words to spare."""
    step = max(1, int(0.4 * (n - SHINGLE + 1)))
    return n + (step - 1), step


def anchors(templates: tuple[tuple[str, str], ...]) -> list[str]:
    """Words of which every sufficient match has at least one: for each template, words that lie in over a fifth of
    its shingles, so that without all of them containment stays under 0.8. Longer, rarer words are taken first."""
    chosen: set[str] = set()
    use = Counter(w for _, t in templates for w in set(template_words(t)))
    for _, t in templates:
        w = template_words(t)
        shingles = [set(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]
        got = {x for x in chosen if x in w}
        for x in sorted(set(w), key=lambda x: (-use[x] * (len(x) > 5), -len(x), x)):
            if sum(bool(s & got) for s in shingles) > (1 - CONTAINMENT) * len(shingles) + 1e-9:
                break
            got.add(x)
        chosen |= got
    return sorted(chosen)


def _shingles(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " ")))


def _bands(h: Column) -> Column:
    """(band, least hash) for each of the bands."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*(F.struct(F.lit(k).alias("band"), least(k).alias("least")) for k in range(BANDS)))


def rivals_of(templates: tuple[tuple[str, str], ...]) -> tuple[list[list[list[str]]], int]:
    """For each template the words of its near twins: those of other licenses whose whole text matches it. Also the most
    shingles that a twin has of its own, which may lie outside of a window that just reaches CONTAINMENT."""
    w = [template_words(t) for _, t in templates]
    shingles = [{tuple(x[i : i + SHINGLE]) for i in range(len(x) - SHINGLE + 1)} for x in w]
    twins = [[j for j, b in enumerate(shingles) if templates[j][0] != templates[i][0] and len(a & b) >= CONTAINMENT * len(a)] for i, a in enumerate(shingles)]
    return [[w[j] for j in js] for js in twins], max((len(shingles[j] - shingles[i]) for i, js in enumerate(twins) for j in js), default=0)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, best: bool = False) -> DataFrame:
    """Find the licenses whose notices a text holds.

    A text's words are lower-case runs of letters and digits (with inner dots and hyphens); a notice matches if a
    window of the text holds at least 0.8 of its distinct five-word shingles. Words near an anchor word are read only;
    a text without any can't match. Null and empty texts, and texts of fewer than five words, match nothing. Repeated
    rows with the same id give one row for each license; rows without an id each give their own. Returns (doc_id, license, n_windows, containment, first_word),
    where n_windows counts the verified windows and first_word the words before the first one.

    Near twins (GPL-2.0 and GPL-3.0 differ in one word) both match either text. With `best` a window counts only if no
    twin has a higher containment at its place, so the line of one license gives no row for the other; of a line
    that tells them in no way both stay.
    """
    spark = docs.sparkSession
    spec = []
    rivals, spare = rivals_of(templates)
    for k, (name, text) in enumerate(templates):
        w = template_words(text)
        spec.append((k, name, w, rivals[k] if best else [], *window_words(len(w))))
    t = spark.createDataFrame(spec, "template int, license string, words array<string>, rivals array<array<string>>, width int, step int")
    t = t.withColumn("need", F.array_distinct(_shingles(F.col("words")))).withColumn("rivals", F.transform("rivals", lambda x: F.array_distinct(_shingles(x))))
    told = ("template", "license", "need", "rivals", "width", "step")
    bands = F.broadcast(t.select(*told, F.explode(_bands(F.col("need"))).alias("b")).select(*told, "b.*"))

    any_anchor = anchors(templates)
    pattern = "|".join(re.escape(x) for x in any_anchor)
    key = "row"
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text")).where(F.col("text").rlike(pattern)).withColumn(key, F.monotonically_increasing_id())
    d = d.withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).where(F.size("w") >= SHINGLE).drop("text")
    marks = F.filter(F.transform("w", lambda x, i: F.when(x.isin(any_anchor), i)), lambda x: x.isNotNull())
    d = d.withColumn("marks", marks).where(F.size("marks") > 0).withColumn("h", _shingles(F.col("w")))
    shapes = sorted({(width, step) for *_, width, step in spec})
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("width"), F.lit(b).alias("step")) for a, b in shapes)))
    d = d.withColumn("shape", each).select("doc_id", key, "h", "marks", "shape.*")
    # the windows (number g starts at word g * step) that hold an anchor
    last = F.greatest(F.lit(0), F.ceil((F.size("h") + SHINGLE - 1 - F.col("width")) / F.col("step"))).cast("int")
    near = F.array_distinct(F.flatten(F.transform("marks", lambda i: F.sequence(F.greatest(F.lit(0), F.ceil((i - F.col("width") + 1) / F.col("step")).cast("int")), F.greatest(F.least(last, F.floor(i / F.col("step")).cast("int")), F.least(last, F.greatest(F.lit(0), F.ceil((i - F.col("width") + 1) / F.col("step")).cast("int"))))))))
    g = d.select("doc_id", key, "width", "step", F.explode(near).alias("g"), "h")
    start, size = F.col("g") * F.col("step") + 1, F.col("width") - SHINGLE + 1
    low = F.greatest(F.lit(1), start - spare)
    place = F.slice("h", low, start + size + spare - low) if best else F.lit(None).cast("array<bigint>")
    g = g.withColumn("place", place).withColumn("h", F.array_distinct(F.slice("h", start, size))).where(F.size("h") > 0)
    hit = g.withColumn("b", F.explode(_bands(F.col("h")))).select("doc_id", key, "g", "width", "step", "h", "place", "b.*")
    hit = hit.join(bands, ["width", "step", "band", "least"]).withColumn("containment", F.size(F.array_intersect("h", "need")) / F.size("need"))
    part = lambda x: F.size(F.array_intersect("place", x)) / F.size(x)
    hit = hit.where(F.col("containment") >= CONTAINMENT)
    if best:
        hit = hit.where(~F.exists("rivals", lambda x: part(x) > part(F.col("need"))))
    hit = hit.groupBy("doc_id", "license", key, "width", "g", "template").agg(F.max("containment").alias("containment"), F.max(F.col("g") * F.col("step")).alias("at"))
    # rows without an id are documents of their own
    own = F.when(F.col("doc_id").isNull(), F.col(key))
    return hit.groupBy("doc_id", own.alias("own"), "license").agg(F.count("*").alias("n_windows"), F.round(F.max("containment"), 6).alias("containment"), F.min("at").cast("long").alias("first_word")).drop("own")
