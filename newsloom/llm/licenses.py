"""License statements in documents: MinHash bands over overlapping windows, then exact containment.

Words: runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Shingles have WORDS words (all of a
template's, where it has fewer). Templates are in classes by shingle length and by a window size of two to four times
their shingles; windows start at every half window, so each place of a template is inside a window. A window
and a template are compared when one of BANDS independent minima agrees. A window holds at least
CONTAINMENT of the template then, so their Jaccard similarity is at least 0.8 / 4.2 and
the bands miss it with a chance under (1 - 0.19) ** 64 < 2e-6; a whole template is missed with
(3 / 4) ** 64 < 2e-8. A window's minimum agrees with a template's only if the window has that shingle, so windows without
any of the templates' least shingles are left out before their minima are found. What the bands retrieve is verified
on the words: the share of the template's shingles that the window has.

All of it is DataFrame functions. Templates are a parameter. Their least shingles (at most one a band) are part of the plan, MOST of them at once; more
templates are scanned in several groups. Their texts are a table that is joined to what the bands retrieve. Documents are read and cut into words once a group.

Defined cases: null and short texts have no matches; repeated rows of an id give one row per license; rows without an
id are as one with a null id; other columns are not carried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
BANDS = 64
CONTAINMENT = 0.8
MOST = 20_000
# Well-known public license statements.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_BREAK, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def plan(templates: dict[str, str], words: int) -> dict[int, dict[int, list[tuple[str, list[str]]]]]:
    """By shingle length and window size: names and their distinct shingles, written with spaces."""
    out: dict[int, dict[int, list]] = {}
    for name, text in sorted(templates.items()):
        ws = template_words(text)
        if not ws:
            continue
        k = min(words, len(ws))
        shingles = list(dict.fromkeys(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)))
        size = 2
        while size < 2 * (len(ws) - k + 1):
            size *= 2
        out.setdefault(k, {}).setdefault(size, []).append((name, shingles))
    return out


def minima(shingles: Column, bands: int) -> Column:
    """The least of each band's hash over an array of shingle hashes."""
    return F.transform(F.array(*[F.lit(i) for i in range(bands)]), lambda i: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, i))))


def _groups(templates: dict[str, str], words: int, bands: int) -> list[dict[str, str]]:
    """Templates in groups with at most about MOST least shingles each."""
    out, held = [{}], 0
    for name, text in sorted(templates.items()):
        n = min(bands, max(1, len(template_words(text)) - words + 1))
        if out[-1] and held + n > MOST:
            out.append({})
            held = 0
        out[-1][name] = text
        held += n
    return out


def _templates(spark, found: dict[int, dict[int, list[tuple[str, list[str]]]]], bands: int) -> DataFrame:
    """k, size, license, shingles (text), minima, least (the shingle hash that each band's minimum comes from)."""
    rows = [(k, size, name, shingles) for k, classes in found.items() for size, group in classes.items() for name, shingles in group]
    df = spark.createDataFrame(rows, "k int, size int, license string, shingles array<string>")
    df = df.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s)))
    least = F.transform(F.array(*[F.lit(i) for i in range(bands)]), lambda i: F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, i).alias("a"), h.alias("b")))).b)
    return df.withColumn("minima", minima(F.col("hashes"), bands)).withColumn("least", F.array_distinct(least))


def _once(df: DataFrame, column: str) -> DataFrame:
    """Computes a column here: else the plan would put its expression into each use, and into the bodies of functions over arrays."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.array(column)).alias(column))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, words: int = WORDS, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment (the best of its windows) and n_windows that verify."""
    lowered = F.translate(F.col(text), _UPPER, _LOWER)
    tokens = _once(docs.select(F.col(key).alias("doc_id"), F.filter(F.split(lowered, _BREAK), lambda w: w != "").alias("w")), "w")
    out = None
    for group in _groups(TEMPLATES if templates is None else templates, words, bands):
        found = plan(group, words)
        if found:
            part = _scan(tokens, found, bands, containment)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.select(F.col(key).alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows")).where("false")


def _scan(tokens: DataFrame, found: dict[int, dict[int, list[tuple[str, list[str]]]]], bands: int, containment: float) -> DataFrame:
    known = _templates(tokens.sparkSession, found, bands)
    wanted: dict[int, set[int]] = {}
    for r in known.select("k", "least").collect():
        wanted.setdefault(r["k"], set()).update(r["least"])
    spelt = lambda i, k: F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(k)])
    # for each length of shingles: their hashes, if one of them is among those wanted
    hashes = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(spelt(i, k))))
    by = []
    for k, classes in sorted(found.items()):
        by.append(F.struct(F.lit(k).alias("k"), hashes(k).alias("h"), F.array(*[F.lit(h).cast("long") for h in sorted(wanted[k])]).alias("those"), F.array(*[F.lit(s) for s in sorted(classes)]).alias("sizes")))
    each = tokens.withColumn("x", F.explode(F.array(*by))).where(F.arrays_overlap("x.h", "x.those"))
    sized = each.select("doc_id", "w", "x.k", "x.h", "x.those", F.explode("x.sizes").alias("size"))
    placed = sized.withColumn("start", F.explode(F.expr("sequence(0, greatest(0, size(h) - 1), size div 2)")))
    windows = _once(placed.select("doc_id", "k", "size", "start", "those", F.expr("slice(h, start + 1, size)").alias("h"), F.expr("slice(w, start + 1, size + k - 1)").alias("w")), "h").where(F.arrays_overlap("h", "those"))
    banded = windows.select("doc_id", "k", "size", "start", "w", F.posexplode(minima(F.col("h"), bands)).alias("band", "value"))
    offered = known.select("k", "size", "license", F.posexplode("minima").alias("band", "value"))
    met = banded.join(F.broadcast(offered), ["k", "size", "band", "value"])  # a group has at most MOST templates: MOST * bands narrow rows
    pairs = met.dropDuplicates(["doc_id", "license", "k", "size", "start", "w"]).select("doc_id", "license", "k", "start", "w")
    texts = pairs.join(known.select("license", "shingles"), "license")
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("k")), lambda i: F.array_join(F.slice("w", i + 1, F.col("k")), " "))
    share = F.size(F.array_intersect(grams, F.col("shingles"))) / F.size("shingles")
    verified = texts.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= containment)
    return verified.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.countDistinct("start").alias("n_windows"))


def oracle(templates: dict[str, str] | None = None, words: int = WORDS, containment: float = CONTAINMENT) -> str:
    """SQL that looks at every window of every document."""
    parts = []
    for k, classes in sorted(plan(TEMPLATES if templates is None else templates, words).items()):
        for size, found in sorted(classes.items()):
            for name, shingles in found:
                listed = ", ".join("'" + s.replace("'", "''") + "'" for s in shingles)
                parts.append(f"SELECT {k} AS k, {size} AS size, '{name}' AS license, [{listed}] AS shingles")
    return rf"""
WITH t AS ({' UNION ALL '.join(parts)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' ')) AS s FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k),
p AS (SELECT doc_id, license, size, shingles, s, unnest(range(0, len(s), size // 2)) AS start FROM g JOIN t USING (k) WHERE list_has_any(s, shingles)),
c AS (SELECT doc_id, license, start, len(list_intersect(list_distinct(list_slice(s, start + 1, start + size)), shingles)) / len(shingles) AS containment FROM p)
SELECT doc_id, license, max(containment) AS containment, count(DISTINCT start) AS n_windows FROM c WHERE containment >= {containment} GROUP BY doc_id, license
"""
