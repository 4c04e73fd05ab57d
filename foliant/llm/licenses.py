"""License scans (6), in DataFrame operations only.

Words are runs of letters and digits, A-Z lower-cased; shingles have five words. A template of m shingles is sought in windows
of 2 g shingles that begin at every g-th, where g is the power of two from m on; so a run of m shingles lies whole in a
window. Windows and templates meet by MinHash with BANDS bands of one coordinate. A window that holds 0.8 of the template's
shingles has at least the similarity 0.8 m / (2 g + 0.2 m), over 0.19, so it meets with a probability of 1 - 0.81^BANDS, over
1 - 1e-11 for BANDS = 128. Exact containment on the shingles then decides.

A band can only agree in a window that holds the template's own least shingle. So the windows around those shingles are all
that is sketched, the other windows can't meet anything; and as the templates' least shingles are a bounded list, this step
needs neither a shuffle nor Python.

Defined results. Null, empty, or fewer than five words: no match. A document has a row for each template found in it, with
its best window; equal rows (doc_id and text) have theirs once. An empty table, of documents or templates, gives an empty
result; templates with a null license or text match nothing. A very long text is one row of hashes, 8 bytes a word, and each window around a mark a copy of at most 4 m of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az

SHINGLE, BANDS, PERCENT = 5, 128, 80
#: Shingles and band marks of templates that one block holds: what is broadcast of them has at most about 50 bytes each.
BLOCK = 400_000
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Notices to look for.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: The public names of the Creative Commons kinds, versions and how each version is called.
CC_KINDS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def all_templates() -> list[tuple[str, str]]:
    """The notices, and those of each Creative Commons kind and version in full and in short, but for the ones listed."""
    made = [(f"cc-{k}-{v}-notice", f"This work is licensed under a Creative Commons {name} {v} {called} License.") for k, name in CC_KINDS.items() for v, called in CC_VERSIONS.items()]
    made += [(f"cc-{k}-{v}-mention", f"Licensed under CC {k.upper()} {v}.") for k in CC_KINDS for v in CC_VERSIONS]
    listed = {text for _, text in TEMPLATES}
    return [*TEMPLATES, *[x for x in made if x[1] not in listed]]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(all_templates(), "license string, text string")


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_az(text), NOT_WORD), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of the shingles, in order; empty for fewer than five words."""
    def bound(w: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])
        return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), at)).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.array(words), bound))  # the words are made once, as a lambda's variable


def coordinate(shingle: Column, band: Column) -> Column:
    return F.xxhash64(shingle, band)


def template_table(templates: DataFrame) -> DataFrame:
    """license, m, g, shingles (distinct) of the templates (license, text) that have a shingle."""
    named = templates.select("license", F.array_distinct(shingles_of(words_of(F.coalesce("text", F.lit(""))))).alias("shingles")).distinct()
    m = F.size("shingles")
    return named.where(m > 0).select("license", m.alias("m"), F.pow(F.lit(2), F.ceil(F.log2(m.cast("double")))).cast("int").alias("g"), "shingles")


def matched_in(docs: DataFrame, table: DataFrame, bands: int, percent: int) -> DataFrame:
    """doc_id, text_hash, license, m, matched: the windows that hold enough of a template of the block `table`, whose size is checked."""
    # the templates' least shingle for each band: at most as many different ones as the templates have
    least = table.select("license", "g", "shingles", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    key = F.array_min(F.transform("shingles", lambda s: F.struct(coordinate(s, F.col("band")).alias("v"), s.alias("s"))))
    marks = least.select(key.alias("key"), "band", "license", "g", F.xxhash64("shingles").alias("form")).select("key.*", "band", "license", "g", "form").groupBy("s").agg(F.collect_list(F.struct("v", "band", "license", "g", "form")).alias("bands"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), shingles_of(words_of(F.coalesce("text", F.lit("")))).alias("h"))
    # h is made once: the filter above reads it behind the projection; the marks' keys are a subquery, run once
    some = hashed.where(F.arrays_overlap("h", marks.agg(F.collect_set("s")).scalar()))
    hits = some.select("*", F.posexplode("h").alias("at", "s")).join(F.broadcast(marks), "s").select("doc_id", "text_hash", "h", "at", F.explode("bands").alias("b"))
    k = F.floor(F.col("at") / F.col("b.g")).cast("int")
    windows = hits.select("*", F.explode(F.filter(F.array(k, k - 1), lambda x: x >= 0)).alias("k"))
    window = F.slice("h", F.col("k") * F.col("b.g") + 1, F.col("b.g") * 2)
    meets = windows.select("doc_id", "text_hash", "b.license", "b.form", "b.band", "b.v", window.alias("window")).where(F.array_min(F.transform("window", lambda s: coordinate(s, F.col("band")))) == F.col("v"))
    of = F.broadcast(table.select("license", F.xxhash64("shingles").alias("form"), "m", "shingles"))
    matched = meets.join(of, ["license", "form"]).select("doc_id", "text_hash", "license", "m", F.size(F.array_intersect("window", "shingles")).alias("matched"))
    return matched.where(100 * F.col("matched") >= percent * F.col("m"))


def scan(docs: DataFrame, templates: DataFrame | None = None, bands: int = BANDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, license, template_shingles, matched, containment of each template found in each document.

    templates: license, text; several texts of one license are one entry, with the most shingles and matches of them. Templates are
    taken in blocks of about `block` shingles, by their hash, and documents are read once for each block.
    """
    table = template_table(default_templates(docs.sparkSession) if templates is None else templates)
    total = table.agg(F.sum(F.col("m") + bands)).first()[0] or 0
    blocks = -(-total // block) or 1
    part = F.pmod(F.xxhash64("license"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [matched_in(docs, table.where(part == i) if blocks > 1 else table, bands, percent) for i in range(blocks)])
    best = found.groupBy("doc_id", "text_hash", "license").agg(F.max("m").alias("m"), F.max("matched").alias("matched"))
    return best.select("doc_id", "license", F.col("m").cast("long").alias("template_shingles"), F.col("matched").cast("long").alias("matched"), F.round(F.col("matched") / F.col("m"), 6).alias("containment"))


def license_query(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in all_templates())
_SHINGLES = f"CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) ELSE [] END"
SQL = f"""
WITH t0(license, text) AS (VALUES {_ROWS}),
t1 AS (SELECT license, {_WORDS} AS w FROM t0),
t2 AS (SELECT license, list_distinct({_SHINGLES}) AS s FROM t1),
t AS (SELECT license, len(s)::BIGINT AS m, pow(2, ceil(log2(len(s))))::BIGINT AS g, unnest(s) AS sh FROM t2),
d AS (SELECT DISTINCT doc_id, text FROM documents),
e AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM d),
f AS (SELECT r, doc_id, unnest(s) AS sh, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT r, doc_id, {_SHINGLES} AS s FROM e)),
h AS (SELECT r, doc_id, license, m, g, sh, ((pos - pos % g) / g)::BIGINT AS k FROM f JOIN t USING (sh)),
w AS (SELECT r, doc_id, license, m, sh, k - o AS k FROM h, (VALUES (0), (1)) v(o) WHERE k >= o),
c AS (SELECT r, doc_id, license, m, k, count(DISTINCT sh) AS matched FROM w GROUP BY ALL HAVING 100 * count(DISTINCT sh) >= {PERCENT} * m)
SELECT doc_id, license, max(m) AS template_shingles, max(matched) AS matched, round(max(matched) / max(m), 6) AS containment FROM c GROUP BY r, doc_id, license
"""
