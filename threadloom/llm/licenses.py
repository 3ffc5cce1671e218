"""License scans: texts against licence templates by Dice coefficient over word bigrams; DataFrame and SQL functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import documents

DICE = 0.8

# Public licence texts and notices, by paragraph.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "All rights reserved."),
]


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised template, in order."""
    found = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    return list(dict.fromkeys(" ".join(pair) for pair in zip(found, found[1:])))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """Rows (doc_id, unit, place, license, template, dice): units of a text that match a licence template.

    Units are lines, paragraphs of several lines (between blank lines) and texts of several paragraphs; place counts
    from 0 within a kind.  Texts are lower-cased, every run of other characters than a-z and 0-9 is one blank.  dice:
    2 |common bigrams| / (|a| + |b|) over distinct word bigrams, at least ``dice``.

    Pruning loses nothing: a unit of n distinct bigrams can only reach the threshold against a template of m if
    min(n, m) / max(n, m) >= dice / (2 - dice), and it must hold one of any m - need + 1 of the template's bigrams.

    Null or empty texts, units of one word and documents without a licence give no rows; each row of a repeated doc_id
    is scanned for itself; no templates or documents: no rows; other columns are ignored.
    """
    parts = [(i, name, template_bigrams(text)) for i, (name, text) in enumerate(templates)]
    parts = [p for p in parts if p[2]]
    ratio = dice / (2 - dice)
    least = min([len(p[2]) for p in parts], default=1) * ratio
    most = max([len(p[2]) for p in parts], default=0) / ratio
    # the rarest bigrams are not known here; later ones of a notice are the more telling ones
    keys = sorted({b for _, _, own in parts for b in own[max(0, int(len(own) * ratio + 0.999999) - 1):]})
    known = F.array(*[
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.array(*map(F.lit, own)).alias("own")) for i, name, own in parts
    ]) if parts else F.expr("cast(array() as array<struct<template:int,license:string,own:array<string>>>)")

    paragraphs = F.split("text", r"\n[ \t\r]*\n")
    several = F.filter(F.transform(paragraphs, lambda x, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("place"), x.alias("part"))), lambda s: s["part"].contains("\n"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("place"), x.alias("part")))
    whole = F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("place"), F.col("text").alias("part"))))
    units = docs.select("doc_id", F.explode(F.concat(lines, several, F.coalesce(whole, F.expr("cast(array() as array<struct<unit:string,place:int,part:string>>)")))).alias("u"))
    # one-element explodes: a filter above them cannot make Spark compute the words or bigrams again
    units = units.select("doc_id", "u.unit", "u.place", F.explode(F.array(F.split(_normal(F.col("u.part")), " "))).alias("w")).filter(F.size("w") - 1 >= least)
    bigrams = F.expr("array_distinct(transform(slice(w, 1, size(w) - 1), (x, i) -> concat(x, ' ', w[i + 1])))")
    units = units.select("doc_id", "unit", "place", F.explode(F.array(bigrams)).alias("grams"))
    units = units.filter((F.size("grams") >= least) & (F.size("grams") <= most) & F.arrays_overlap("grams", F.array(*map(F.lit, keys)) if keys else F.expr("cast(array() as array<string>)")))
    near = F.filter(known, lambda t: (F.least(F.size("grams"), F.size(t["own"])) >= F.lit(ratio) * F.greatest(F.size("grams"), F.size(t["own"])) - 1e-9))
    scored = F.transform(near, lambda t: F.struct(
        t["license"].alias("license"), t["template"].alias("template"),
        (2.0 * F.size(F.array_intersect("grams", t["own"])) / (F.size("grams") + F.size(t["own"]))).alias("dice"),
    ))
    return units.select("doc_id", "unit", "place", F.explode(scored).alias("m")).select("doc_id", "unit", "place", "m.*").filter(F.col("dice") >= dice)


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))
    words = lambda c: f"string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates AS (SELECT template, license, {grams} AS own FROM (SELECT template, license, {words('body')} AS w FROM (VALUES {rows}) AS v(template, license, body))),
lines AS (SELECT doc_id, 'line' AS unit, unnest(range(len(l))) AS place, unnest(l) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
cut AS (SELECT doc_id, text, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS p FROM documents),
paragraphs AS (SELECT * FROM (SELECT doc_id, 'paragraph' AS unit, unnest(range(len(p))) AS place, unnest(p) AS part FROM cut) WHERE contains(part, chr(10))),
units AS (SELECT * FROM lines UNION ALL SELECT * FROM paragraphs UNION ALL SELECT doc_id, 'text', 0, text FROM cut WHERE len(p) > 1),
grams AS (SELECT doc_id, unit, place, {grams} AS g FROM (SELECT doc_id, unit, place, {words('part')} AS w FROM units) WHERE len(w) > 1),
shared AS (SELECT doc_id, unit, place, g, unnest(g) AS b FROM grams),
counted AS (SELECT doc_id, unit, place, template, license, 2.0::DOUBLE * count(*) / (len(g) + len(own)) AS dice
  FROM shared JOIN (SELECT template, license, own, unnest(own) AS b FROM templates) USING (b) GROUP BY doc_id, unit, place, template, license, g, own)
SELECT doc_id, unit, place::INTEGER AS place, license, template::INTEGER AS template, dice FROM counted WHERE dice >= {DICE}"""


QUERIES = {"op6_licenses": op6_licenses}
SQL = {"op6_licenses": _sql()}
