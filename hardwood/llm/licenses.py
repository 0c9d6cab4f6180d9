"""License scan with DataFrame functions only: MinHash bands of overlapping text windows retrieve templates, containment decides.

Windows have WINDOW words and start at every STRIDE-th word; a template is indexed by its windows at every word, or as a
whole where it is shorter. A band is one minimum of its own hash, and BANDS of them meet with probability 1 - (1 - J) ** BANDS. The best
window of an unchanged template has a Jaccard similarity of WORST at least (three-word shingles), see `collision`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, STRIDE, SHINGLE, BANDS = 8, 4, 3, 16
#: Shingles of a window, and the lowest similarity of the best window, which is that of a template of six words at an odd place.
INSIDE, WORST = WINDOW - SHINGLE + 1, 3 / 7
#: Share of a template's shingles that a match needs.
CONTAINMENT = 0.8

#: Notices as they stand in works.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def collision(similarity: float = WORST) -> float:
    """Probability that a window of that similarity meets its template in a band."""
    return 1 - (1 - similarity) ** BANDS


def _bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once, though `use` reads it inside other lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles(text: Column) -> Column:
    """Hashes of all three-word runs; a word is a run of a-z and 0-9 after lower-casing, anything else parts words."""
    def hashed(w: Column) -> Column:
        at = lambda i, j: F.get(w, i + j)
        return F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[at(i, j) for j in range(SHINGLE)]))

    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1)
    return _bind(words, lambda w: F.when(F.size(w) >= SHINGLE, hashed(w)).otherwise(F.expr("cast(array() as array<bigint>)")))


def _minima(sh: Column) -> Column:
    """For each band, the hash of every shingle."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.transform(sh, lambda x: F.xxhash64(x, j)))


def _keys(hashes: Column, start: Column, length: Column | int) -> Column:
    """The band keys of one window: the least hash of each band."""
    return F.transform(hashes, lambda band: F.array_min(F.slice(band, start, length)))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, license, template_shingles, words, window keys: a few rows for each template."""
    rows = spark.createDataFrame([(i, k, t.strip().rstrip(".")) for i, (k, t) in enumerate(templates)], "template int, license string, text string")
    rows = rows.withColumn("sh", shingles(F.col("text"))).withColumn("hashes", _minima(F.col("sh")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("sh") - INSIDE + 1, F.lit(1)))
    return rows.select(
        "template", "license", F.array_distinct("sh").alias("template_shingles"), F.size("sh").alias("span"),
        F.array_distinct(F.flatten(F.transform(starts, lambda s: _keys(F.col("hashes"), s, INSIDE)))).alias("keys"),
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs` and template found in it: doc_id, template, license, containment, first_word.

    containment: the largest share of the template's shingles around a retrieved window (at most the template's length to
    either side), CONTAINMENT at least; first_word: where the first such window starts. Null, empty and shorter texts have no
    match; repeated rows are reported each; no rows give no rows. Only matches shuffle. The templates are a parameter of
    a bounded size, so their keys go into the plan.
    """
    table = template_table(docs.sparkSession, templates or TEMPLATES)
    held = table.collect()
    known = [k for r in held for k in r["keys"]]
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).cast("long").alias("doc_id"), shingles(F.col(text)).alias("sh"))

    def hits(sh: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(sh), F.lit(STRIDE))
        return _bind(_minima(sh), lambda h: F.filter(
            F.transform(starts, lambda s: F.struct(s.alias("start"), F.filter(_keys(h, s, INSIDE), lambda v: v.isin(known)).alias("met"))),
            lambda x: F.size(x.met) > 0,
        ))

    found = F.transform(F.array(F.struct(F.col("sh").alias("sh"))), lambda s: F.struct(s.sh.alias("sh"), F.when(F.size(s.sh) > 0, hits(s.sh)).alias("hits")))
    rows = rows.select("row_no", "doc_id", F.get(found, 0).alias("f")).filter(F.size("f.hits") > 0)
    windows = rows.select("row_no", "doc_id", F.col("f.sh").alias("sh"), F.explode("f.hits").alias("hit"))
    windows = windows.select("row_no", "doc_id", "sh", F.col("hit.start").alias("start"), F.explode(F.array_distinct("hit.met")).alias("key"))
    keys = table.select("template", "license", "template_shingles", "span", F.explode("keys").alias("key"))
    pairs = windows.join(F.broadcast(keys), "key")  # a few hundred rows: the templates' own windows
    low = F.greatest(F.col("start") - F.col("span") + 1, F.lit(1))
    around = F.slice(F.col("sh"), low, F.col("start") - low + INSIDE + F.col("span") - 1)
    share = F.size(F.array_intersect("template_shingles", around)) / F.size("template_shingles")
    verified = pairs.select("row_no", "doc_id", "template", "license", share.alias("containment"), (F.col("start") - 1).alias("first_word"))
    return verified.filter(F.col("containment") >= CONTAINMENT).groupBy("row_no", "doc_id", "template", "license").agg(
        F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word")
    ).drop("row_no")
