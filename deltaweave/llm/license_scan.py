"""Licence scans: Dice coefficient over word bigrams against templates.

A text is cut into segments at line ends and after punctuation; a unit is any
run of consecutive segments, so a notice is found wrapped over lines or beside
other words of its line.  Units and templates are lower-cased, cut into words of
letters, digits and dots, and become sets of adjacent word pairs.  The
coefficient of two sets is twice the shared pairs over the sum of both sizes.
For a threshold t only a unit of t / (2 - t) to (2 - t) / t times a template's
size can reach it, by its pairs with repeats; other units are not compared with
that template.  A unit names its best template, and counts if no unit that
overlaps it has a better coefficient.

To reach the threshold a unit must share all but a third of a template's pairs,
and so hold one of any third of them: texts without a word from the longest
that make up such a third of some template are left out by a plain search.  The
pairs of the others meet the pairs of all templates in one equality join on a
64-bit hash; the template side has a size fixed by the template list and is
broadcast.  A unit starts and ends in segments with shared pairs: more segments
would only lower its coefficient.

Defined cases: a null or empty text, or a unit of one word, has no pairs and
finds nothing; of equal coefficients the first template by name counts, and of
units the one with more pairs, then the first; repeated rows stay repeated;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

THRESHOLD = 0.8
NOT_WORDS, FINAL_DOTS = r"[^\p{L}\p{N}.]+", r"\.+( |$)"
#: What a segment ends with, beside a line end.
SEGMENT_END = r"([.,;:!?])[ \t]+"
#: Licence notices by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), NOT_WORDS, " ")
    return F.filter(F.split(F.trim(F.regexp_replace(plain, FINAL_DOTS, " ")), " +"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Hashes of the adjacent word pairs, in order; none of fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def template_pairs(spark, templates: dict[str, str]) -> DataFrame:  # noqa: ANN001
    """(pair, template, size) of every template."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string").select("template", _words(F.col("text")).alias("words"))
    sized = rows.select("template", F.array_distinct(_pairs(F.col("words"))).alias("pairs")).select("template", F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))
    return keep(sized.select("pair", "template", "size"), "templates")


def marker_words(spark, templates: dict[str, str], threshold: float) -> list[str]:  # noqa: ANN001
    """Words of which every unit that reaches the threshold holds one."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string").select(_words(F.col("text")).alias("words")).collect()
    out: set[str] = set()
    for row in rows:
        pairs = set(zip(row["words"], row["words"][1:], strict=False))
        # one pair more than may be missing, with a margin for rounding
        needed = min(len(pairs), len(pairs) - int(len(pairs) * threshold / (2 - threshold) - 1e-9))
        covered: set[tuple[str, str]] = set()
        for word in sorted(set(row["words"]), key=lambda w: (-len(w), w)):
            if len(covered) >= needed:
                break
            out.add(word)
            covered |= {p for p in pairs if word in p}
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """row, doc_id, unit, last, template and dice of the licences in ``docs``.

    ``row`` numbers the rows of ``docs``; ``unit`` and ``last`` are the first and
    last segment, from 0.
    """
    spark, templates = docs.sparkSession, templates or TEMPLATES
    known = F.broadcast(template_pairs(spark, templates))
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    lowered = F.lower("text")
    marked = reduce(lambda a, w: a | F.contains(lowered, F.lit(w)), marker_words(spark, templates, threshold), F.lit(False))
    cut = F.split(F.regexp_replace("text", SEGMENT_END, "$1\n"), "\n")
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").where(marked).select("row", "doc_id", F.transform(cut, _words).alias("segments"))
    place = F.flatten(F.transform("segments", lambda w, i: F.array_repeat(i, F.size(w))))
    texts = texts.select("row", "doc_id", F.flatten("segments").alias("words"), place.alias("place"))
    texts = keep(texts.select("row", "doc_id", _pairs(F.col("words")).alias("pairs"), "place").where(F.size("pairs") > 0), "texts")
    # shared pairs by text and template, with the segments of both words
    each = texts.select("row", "place", F.posexplode("pairs").alias("k", "pair")).select("row", "pair", F.get("place", F.col("k")).alias("a"), F.get("place", F.col("k") + 1).alias("b"))
    shared = each.join(known, "pair").groupBy("row", "template", "size").agg(F.collect_list(F.struct("pair", "a", "b")).alias("hits"))
    enough = F.size(F.array_distinct("hits.pair")) >= F.col("size") * least - 1e-9
    shared = shared.where(enough).join(texts, "row")
    starts = shared.select("*", F.explode(F.array_distinct("hits.a")).alias("unit"))
    first = F.array_position("place", F.col("unit")).cast("int")
    starts = starts.withColumn("first", first)
    # words up to the end of a segment: the place of the last of its words
    ends = F.filter(F.array_distinct("hits.b"), lambda x: x >= F.col("unit"))
    units = starts.select("*", F.explode(ends).alias("last"))
    # the numbers of segments ascend, so those of the unit are a run from its first word on
    in_unit = F.size(F.filter(F.slice("place", F.col("first"), F.ceil(F.col("size") * most).cast("int") + 2), lambda x: x <= F.col("last")))
    units = units.withColumn("n_pairs", in_unit - 1).where((F.col("n_pairs") >= F.col("size") * least - 1e-9) & (F.col("n_pairs") <= F.col("size") * most + 1e-9))
    inside = F.filter("hits", lambda h: (h["a"] >= F.col("unit")) & (h["b"] <= F.col("last")))
    n = F.size(F.array_distinct(F.slice("pairs", F.col("first"), F.col("n_pairs"))))
    units = units.select("row", "doc_id", "template", "unit", "last", "n_pairs", (2 * F.size(F.array_distinct(F.transform(inside, lambda h: h["pair"]))) / (n + F.col("size"))).alias("dice"))
    order = F.struct((-F.col("dice")).alias("dice"), (-F.col("n_pairs")).alias("n_pairs"), "unit", "last", "template")
    best = units.where(F.col("dice") >= threshold).groupBy("row", "doc_id", "unit", "last").agg(F.min(order).alias("o"))
    best = keep(best, "units")
    # a unit counts if it is the best one in each of its segments
    held = best.select("row", "o", F.explode(F.sequence("unit", "last")).alias("segment"))
    tops = held.groupBy("row", "segment").agg(F.min("o").alias("o"))
    won = tops.groupBy("row", "o").agg(F.count(F.lit(1)).alias("segments")).where(F.col("segments") == F.col("o.last") - F.col("o.unit") + 1)
    return best.join(won.select("row", "o"), ["row", "o"]).select("row", "doc_id", "unit", "last", "o.template", (-F.col("o.dice")).alias("dice"))


def license_of(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licenses (sorted names), n_lines (the units found) and best_dice of the documents with a licence."""
    found = scan(docs, templates, threshold)
    return found.groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_set("template")).alias("licenses"),
        F.count(F.lit(1)).alias("n_lines"),
        F.max("dice").alias("best_dice"),
    ).drop("row")
