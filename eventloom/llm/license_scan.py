"""Licence scans: Dice coefficient over word bigrams against licence templates, with DataFrame functions alone.

Units of a document are its lines and, as one more, its whole text (line -1). A unit's words are its runs of a-z and 0-9
after A-Z are lower-cased; its bigrams are distinct pairs of neighbours. Dice >= t needs a template's bigrams to number
between t / (2 - t) and (2 - t) / t times the unit's, so a unit is compared with templates of such sizes alone, and units
that can't be of any such size go before their bigrams are made.

A notice that is wrapped over lines or shares its line with other text is found as a passage: a run of words of the text that begins and ends with a
bigram of a template (no other run can be the best) and has no more bigrams, counted with repeats, than Dice >= t allows. Runs that overlap are one
unit, and a run that overlaps a line, or lies in a text, that itself matches the same licence as well is no unit besides. The templates are a fixed table of a few kilobytes and are the only
side that is broadcast; what remains after that join are shared bigrams, a few rows, so all shuffles are small.

Nulls: null and empty texts match nothing. Rows repeated with one doc_id are one document and get its matches each; a
null doc_id counts as one. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Standard short notices of public licences, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_bigrams(templates=TEMPLATES) -> list[tuple[int, str, int, str]]:
    """(template, licence, number of its bigrams, bigram) of all templates."""
    rows = []
    for t, (name, text) in enumerate(templates):
        words = re.findall("[a-z0-9]+", text.lower())
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        rows += [(t, name, len(pairs), p) for p in pairs]
    return rows


def bounds(threshold: float, templates=TEMPLATES) -> tuple[int, int]:
    """The smallest and largest number of bigrams that any template can match."""
    sizes = [r[2] for r in template_bigrams(templates)]
    return int(min(sizes) * threshold / (2 - threshold)), int(max(sizes) * (2 - threshold) / threshold) + 1


def normal(text: Column) -> Column:
    """Line by line, words of a-z and 0-9 with one space between."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_replace(low, "[^a-z0-9\n]+", " ")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbours of an array of words (a lambda's variable, so that it is made once)."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b)))


def let(value: Column, body) -> Column:
    """body(value), with value made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def passages(lines: Column, threshold: float, templates) -> Column:
    """Runs of words at or over the threshold, of an array of normalised lines: template, license, lo and hi (bigrams' places), from_line, to_line, dice."""
    least = threshold / (2 - threshold)
    by: dict[tuple[int, str, int], list[str]] = {}
    for t, name, size, pair in template_bigrams(templates):
        by.setdefault((t, name, size), []).append(pair)
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(name).alias("name"), F.lit(size).alias("size"), F.lit(ceil(size * least - 1e-9)).alias("need"), F.lit(int(size / least + 1e-9)).alias("most"), F.array(*map(F.lit, pairs)).alias("pairs")) for (t, name, size), pairs in by.items()])
    every = sorted({pair for pairs in by.values() for pair in pairs})
    fewest = min(ceil(size * least - 1e-9) for _, _, size in by)
    none = F.array().cast("array<struct<template:int,license:string,lo:int,hi:int,from_line:int,to_line:int,dice:double>>")

    def line_of(counts: Column, place: Column) -> Column:
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("line"))
        step = lambda acc, n: F.struct((acc["words"] + n).alias("words"), (acc["line"] + (acc["words"] + n <= place).cast("int")).alias("line"))
        return F.aggregate(counts, start, step, lambda acc: acc["line"])

    def run(pairs: Column, counts: Column, t: Column, near: Column, last: Column, k: Column) -> Column:
        lo = F.element_at(near, 1)["i"]
        n = F.size(F.array_distinct(F.slice(pairs, lo + 1, last["i"] - lo + 1)))
        both = F.size(F.array_distinct(F.transform(F.slice(near, F.lit(1), k + 1), lambda x: x["pair"])))
        return F.struct(t["t"].alias("template"), t["name"].alias("license"), lo.alias("lo"), last["i"].alias("hi"), line_of(counts, lo).alias("from_line"), line_of(counts, last["i"] + 1).alias("to_line"), (2.0 * both / (n + t["size"])).alias("dice"))

    def from_start(pairs: Column, counts: Column, t: Column, near: Column) -> Column:
        enough = F.size(F.array_distinct(F.transform(near, lambda x: x["pair"]))) >= t["need"]
        ends = lambda near: F.transform(near, lambda last, k: F.when(k + 1 >= t["need"], run(pairs, counts, t, near, last, k)))
        return F.when(enough, F.filter(ends(near), lambda r: r["dice"] >= threshold)).otherwise(none)

    def of_template(pairs: Column, counts: Column, t: Column, hits: Column) -> Column:
        start = lambda x, s: let(F.filter(F.slice(hits, s + 1, t["most"]), lambda y: y["i"] < x["i"] + t["most"]), lambda near: from_start(pairs, counts, t, near))
        return F.when(F.size(hits) >= t["need"], F.flatten(F.transform(hits, start))).otherwise(none)

    def of_hits(pairs: Column, counts: Column, hits: Column) -> Column:
        each = lambda t: let(F.filter(hits, lambda x: F.array_contains(t["pairs"], x["pair"])), lambda mine: of_template(pairs, counts, t, mine))
        return F.when(F.size(hits) >= fewest, F.flatten(F.transform(table, each))).otherwise(none)

    def of_lines(worded: Column) -> Column:
        counts = F.transform(worded, F.size)
        words = F.flatten(worded)
        rest = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
        pairs = let(words, lambda w: F.zip_with(F.slice(w, F.lit(1), rest(w)), F.slice(w, F.lit(2), rest(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
        hits = lambda p: F.filter(F.transform(p, lambda pair, i: F.when(pair.isin(every), F.struct(i.alias("i"), pair.alias("pair")))), lambda x: x.isNotNull())
        return let(counts, lambda c: let(pairs, lambda p: let(hits(p), lambda h: of_hits(p, c, h))))

    words_of = lambda line: F.filter(F.split(line, " "), lambda w: w != "")
    return let(F.transform(lines, words_of), of_lines)


def license_passages(docs: DataFrame, threshold: float, templates) -> DataFrame:
    """doc_id, line (-2 less the place of the unit's first bigram), from_line, to_line, license, template and dice."""
    lines = F.split(normal(F.col("text")), "\n")
    found = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("unit"), F.inline(passages(lines, threshold, templates)))
    before = Window.partitionBy("doc_id", "unit").orderBy("lo", "hi", "template")
    first = F.col("lo") > F.coalesce(F.max("hi").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    begun = found.withColumn("first", F.when(first, F.col("lo")))
    return begun.select("doc_id", (-2 - F.max("first").over(before.rowsBetween(Window.unboundedPreceding, 0))).alias("line"), "from_line", "to_line", "license", "template", "dice")


def license_matches(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, line, license, template and dice of every unit and template at or over the threshold."""
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame(template_bigrams(templates), "template int, license string, size int, bigram string")
    least, most = bounds(threshold, templates)
    texts = docs.where("text IS NOT NULL").select("doc_id", normal(F.col("text")).alias("text"))
    split = texts.select("doc_id", F.regexp_replace("text", "[ \n]+", " ").alias("whole"), F.split("text", "\n").alias("lines"))
    units = F.concat(F.array("whole"), F.when(F.size("lines") > 1, F.col("lines")).otherwise(F.array().cast("array<string>")))
    worded = F.transform(units, lambda u: F.split(F.trim(u), " "))
    # n words have n - 1 bigrams at most, and at least one less than there are distinct words in any part of them
    few = lambda w: F.size(F.array_distinct(F.slice(w, F.lit(1), F.lit(4 * most)))) <= most + 1
    pairs = F.transform(worded, lambda w: F.when((F.size(w) > least) & ((F.size(w) <= most + 1) | few(w)), bigrams(w)).otherwise(F.array().cast("array<string>")))
    # bigrams are made in the generator, below which no filter can move and make them again
    made = split.select("doc_id", F.posexplode_outer(pairs).alias("line", "pairs"))
    sized = made.where(F.size("pairs").between(max(1, least), most)).select("doc_id", (F.col("line") - 1).alias("line"), F.xxhash64("pairs").alias("unit"), "pairs")
    shared = sized.select("doc_id", "line", "unit", F.size("pairs").alias("n"), F.explode_outer("pairs").alias("bigram")).join(F.broadcast(table), "bigram")
    shared = shared.where((F.col("size") >= F.col("n") * (threshold / (2 - threshold))) & (F.col("size") <= F.col("n") * ((2 - threshold) / threshold)))
    counts = shared.groupBy("doc_id", "line", "unit", "n", "template", "license", "size").agg(F.countDistinct("bigram").alias("both"))
    dice = 2.0 * F.col("both") / (F.col("n") + F.col("size"))
    found = written(counts.where(dice >= threshold).select("doc_id", "line", "license", "template", dice.alias("dice")), "unit-matches")
    runs = license_passages(docs, threshold, templates).alias("r")
    covers = (F.col("f.line") == -1) | F.col("f.line").between(F.col("r.from_line"), F.col("r.to_line"))
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.license") == F.col("f.license")) & (F.col("r.dice") <= F.col("f.dice"))
    more = runs.join(found.alias("f"), same & covers, "left_anti").groupBy("doc_id", "line", "license", "template").agg(F.max("dice").alias("dice"))
    return found.unionByName(more)


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, license (of the best match, ties by name), dice, n_units (that match) and licenses (all, comma-separated) of every row."""
    found = license_matches(docs.select("doc_id", "text"), threshold, templates)
    best = found.groupBy("doc_id").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"),
        F.countDistinct("line").alias("n_units"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
    )
    rows = docs.select("doc_id").alias("a").join(best.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    return rows.select("a.doc_id", F.col("best.license").alias("license"), F.round(-F.col("best.d"), 6).alias("dice"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    values = ", ".join(f"({t}, '{n}', {s}, '{b}')" for t, n, s, b in template_bigrams())
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return f"""
WITH table_(template, license, size, bigram) AS (VALUES {values}),
texts AS (SELECT doc_id, regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM texts),
units AS (SELECT doc_id, -1 AS line, replace(text, chr(10), ' ') AS unit FROM lines
  UNION ALL SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS unit FROM lines WHERE len(l) > 1),
words AS (SELECT doc_id, line, string_split(trim(regexp_replace(unit, ' +', ' ', 'g')), ' ') AS w FROM units),
pairs AS (SELECT doc_id, line, list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS p FROM words),
sized AS (SELECT doc_id, line, len(p) AS n, unnest(p) AS bigram FROM pairs WHERE len(p) BETWEEN {bounds(threshold)[0]} AND {bounds(threshold)[1]}),
counts AS (SELECT doc_id, line, n, template, license, size, count(DISTINCT bigram) AS common FROM sized JOIN table_ USING (bigram)
  WHERE size >= n * {low!r}::DOUBLE AND size <= n * {high!r}::DOUBLE GROUP BY ALL),
found AS (SELECT doc_id, line, license, 2.0 * common / (n + size) AS dice FROM counts WHERE 2.0 * common / (n + size) >= {threshold}),
best AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, count(DISTINCT line) AS n_units,
  string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM found GROUP BY doc_id)
SELECT d.doc_id, license, round(dice::DOUBLE, 6) AS dice, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN best b ON d.doc_id IS NOT DISTINCT FROM b.doc_id
"""
