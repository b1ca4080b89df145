"""Licence scan: lines and whole texts compared with licence templates.

A unit is each line of a text and, where it has several lines, the whole text.  Units and templates
are normalised (lower case, runs of anything but letters and digits become one space) and reduced to
their sets of word bigrams.  The Dice coefficient ``2 |A and B| / (|A| + |B|)`` cannot reach the
threshold ``t`` unless ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``, so only templates of a fitting
size are compared; a unit that fits none is dropped before any comparison.  The best template at
or above the threshold is reported for each unit.

Licences that are neither a line nor a whole text (wrapped, or inside a longer line) are found in
windows over all words, see ``scan_windows``; the DuckDB twin has lines and whole texts only.

Spark built-ins only; every unit is judged inside its row, and nothing is shuffled.

Defined cases: null, empty and one-word units match nothing; equal coefficients go to the licence
name that sorts first; repeated rows are reported each; repeated bigrams count once; other columns
are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcart.llm.text import let

THRESHOLD = 0.8
WHOLE_TEXT = -1          # unit number of the whole text; lines count from 0

# Short notices and opening paragraphs of common licences.
TEMPLATES = {
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause opening": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"),
    "CC-BY-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC opening": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT notice": "Released under the MIT License.",
    "MIT opening": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}

# For windows also usual notices and longer texts.
WINDOW_TEMPLATES = TEMPLATES | {
    "Apache-2.0 under": "under the Apache License, Version 2.0",
    "BSD-2-Clause conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "GPL-2.0 header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."),
    "MIT licensed": "Licensed under the MIT License.",
    "MIT text": TEMPLATES["MIT opening"] + (
        " The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
}

_GAP = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _least_common(size: int, threshold: float) -> int:
    """How many bigrams a set must share with a template of ``size`` to reach the threshold."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))


def _unit_words(unit: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(unit), _GAP, " "), " "), "")


def _bigrams(w: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                                        lambda x, i: F.concat_ws(" ", F.get(w, i), x)))


def _dice(grams: Column, template: list[str], threshold: float) -> Column:
    """The coefficient where the sizes allow it to reach the threshold, else null."""
    n = len(template)
    fits = (F.size(grams) * (2 - threshold) >= n * threshold) & (F.size(grams) * threshold <= n * (2 - threshold))
    known = F.array(*[F.lit(g) for g in template])
    return F.when(fits, 2.0 * F.size(F.array_intersect(grams, known)) / (F.size(grams) + n))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, line, license, dice, n_bigrams``: every unit at least ``threshold`` like a template."""
    known = sorted((name, template_bigrams(text)) for name, text in (templates or TEMPLATES).items())
    known = [(name, grams) for name, grams in known if grams]
    if not known:
        raise ValueError("no template has two words")
    least = min(len(g) for _, g in known) * threshold / (2 - threshold)
    most = max(len(g) for _, g in known) * (2 - threshold) / threshold

    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    units = let(lines, lambda x: F.concat(
        F.transform(x, lambda y, i: F.struct(i.alias("line"), y.alias("unit"))),
        F.when(F.size(x) > 1, F.array(F.struct(F.lit(WHOLE_TEXT).alias("line"), text.alias("unit"))))
        .otherwise(F.array().cast("array<struct<line:int,unit:string>>"))))

    def grams(unit: Column) -> Column:
        # too few words cannot make enough bigrams; the exact size is checked on the set below
        return let(_unit_words(unit), lambda w: F.when(F.size(w) - 1 >= least, _bigrams(w)))

    sets = F.filter(F.transform(units, lambda u: F.struct(u["line"].alias("line"), grams(u["unit"]).alias("grams"))),
                    lambda u: (F.size(u["grams"]) >= least) & (F.size(u["grams"]) <= most))
    rows = docs.select("doc_id", F.explode(sets).alias("u")).select("doc_id", "u.line", "u.grams")
    dice = [_dice(F.col("grams"), g, threshold) for _, g in known]
    ranked = F.array(*[F.struct((-d).alias("d"), F.lit(name).alias("license"))
                       for d, (name, _) in zip(dice, known, strict=True)])
    best = F.get(F.sort_array(F.filter(ranked, lambda x: x["d"] <= -threshold)), F.lit(0))
    found = rows.select("doc_id", "line", F.size("grams").alias("n_bigrams"), best.alias("best")).where("best is not null")
    return found.select("doc_id", "line", F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"),
                        "n_bigrams")


def scan_windows(docs: DataFrame, templates: dict[str, str] | None = None,
                 threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``scan_licenses`` for windows over all words of a text, whatever its lines.

    A window has as many words as its template (fewer at the text's end), starts at a word pair of the
    template and ends at one.  Windows at least ``threshold`` like their template are taken from the
    best down (then the longest, the first, by name), each where it shares no word with one taken before or
    with a line that ``scan_licenses`` reports; none is taken from a text it reports as a whole.
    ``line`` is the line in which the window starts."""
    known = sorted((name, _words(text)) for name, text in (WINDOW_TEMPLATES if templates is None else templates).items())
    known = [(name, w, template_bigrams(" ".join(w))) for name, w in known if len(w) > 1]
    if not known:
        raise ValueError("no template has two words")
    everything = sorted({g for _, _, grams in known for g in grams})
    fewest = min(_least_common(len(g), threshold) for _, _, g in known)

    def pairs(w: Column) -> Column:
        # positions of word pairs that some template has
        return F.filter(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct(
            i.alias("p"), F.concat_ws(" ", F.get(w, i), x).alias("g"))), lambda x: x["g"].isin(everything))

    def windows(hits: Column, name: str, length: int, grams: list[str]) -> Column:
        need = _least_common(len(grams), threshold)

        def near(mine: Column) -> Column:
            # so many hits must lie within the window's length, or its coefficient cannot be reached
            return F.filter(F.transform(mine, lambda x, i: F.struct(
                x["p"].alias("p"), F.get(mine, i + (need - 1))["p"].alias("q"), i.alias("i"))),
                            lambda x: x["q"] - x["p"] <= length - 2)

        def judged(mine: Column) -> Column:
            def one(x: Column) -> Column:
                return let(F.filter(F.slice(mine, x["i"] + 1, F.lit(length - 1)), lambda y: y["p"] <= x["p"] + (length - 2)),
                           lambda inside: counted(x, inside))

            def counted(x: Column, inside: Column) -> Column:
                return let(F.array_max(F.transform(inside, lambda y: y["p"])), lambda last: let(
                    F.size(F.array_distinct(F.transform(F.slice(F.col("w"), x["p"] + 1, last - x["p"] + 1),
                                                        lambda y, i: F.concat_ws(" ", y, F.get(F.col("w"), x["p"] + i + 1))))),
                    lambda n: F.struct(
                        (-2.0 * F.size(F.array_distinct(F.transform(inside, lambda y: y["g"]))) / (n + len(grams))).alias("d"),
                        (-n).alias("less"), x["p"].alias("from"), F.lit(name).alias("license"), (last + 1).alias("to"))))
            return F.filter(F.transform(near(mine), one), lambda x: x["d"] <= -threshold)

        return let(F.filter(hits, lambda x: x["g"].isin(grams)), judged)

    def free(x: Column, taken: Column) -> Column:
        return ~F.exists(taken, lambda y: (x["from"] <= y["to"]) & (y["from"] <= x["to"]))

    text = F.coalesce("text", F.lit(""))
    # by explode, not by where: a filter would be pushed down and judge every text twice
    rows = docs.select("doc_id", F.explode(F.filter(F.array(let(_unit_words(text), lambda w: F.struct(
        text.alias("text"), w.alias("w"), pairs(w).alias("hits")))), lambda z: F.size(z["hits"]) >= fewest)).alias("z"))
    rows = rows.select("doc_id", "z.text", "z.w", "z.hits")
    found = F.concat(*[windows(F.col("hits"), n, len(w), g) for n, w, g in known])
    rows = rows.select("doc_id", "text", "w", F.explode(F.filter(F.array(found), lambda x: F.size(x) > 0)).alias("found"))

    # lines with their first and last words, and whether the scan of units reports them
    units = sorted((n, template_bigrams(t)) for n, t in TEMPLATES.items())

    def reported(w: Column) -> Column:
        return let(_bigrams(w), lambda g: F.coalesce(
            F.greatest(*[F.coalesce(_dice(g, t, threshold), F.lit(0.0)) for _, t in units]) >= threshold, F.lit(False)))

    lines = F.transform(F.split("text", "\n"), lambda x: _unit_words(x))
    rows = rows.select("doc_id", "found", "w", lines.alias("lines"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int,hit:boolean>>").alias("all"))
    spans = F.aggregate("lines", start, lambda acc, w: F.struct(
        (acc["at"] + F.size(w)).alias("at"), F.concat(acc["all"], F.array(F.struct(
            acc["at"].alias("from"), (acc["at"] + F.size(w) - 1).alias("to"),
            (F.when(F.size(w) > 1, reported(w)).otherwise(False)).alias("hit")))).alias("all")), lambda acc: acc["all"])
    whole = F.struct(F.lit(0).alias("from"), (F.size("w") - 1).alias("to"), reported(F.col("w")).alias("hit"))
    rows = rows.select("doc_id", "found", F.concat(spans, F.array(whole)).alias("spans"))
    open_ = F.filter(F.sort_array("found"), lambda x: free(x, F.filter(F.col("spans"), lambda y: y["hit"])))
    none = F.array().cast("array<struct<d:double,less:int,from:int,license:string,to:int>>")
    taken = F.aggregate(open_, none, lambda acc, x: F.when(free(x, acc), F.concat(acc, F.array(x))).otherwise(acc))
    rows = rows.select("doc_id", "spans", F.explode(taken).alias("x"))
    line = F.size(F.filter("spans", lambda y: y["to"] < F.col("x.from")))
    return rows.select("doc_id", line.alias("line"), F.col("x.license").alias("license"), (-F.col("x.d")).alias("dice"),
                       (-F.col("x.less")).alias("n_bigrams"))


def find_licenses(docs: DataFrame) -> DataFrame:
    """Lines, whole texts and windows, one row for each licence found."""
    return scan_licenses(docs).unionByName(scan_windows(docs))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB SQL, without the pruning."""
    rows = ", ".join("('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''")) for n, t in TEMPLATES.items())
    tokens = ("list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), "
              "lambda y: y <> '')")
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT r, doc_id, {WHOLE_TEXT} AS line, t AS x FROM d WHERE len(ls) > 1
      UNION ALL SELECT r, doc_id, i - 1, ls[i] FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT r, doc_id, line, {tokens.format('x')} AS ws FROM u),
b AS (SELECT r, doc_id, line, {grams.format('ws')} AS bs FROM w WHERE len(ws) > 1),
tw AS (SELECT name, {tokens.format('body')} AS ws FROM (VALUES {rows}) AS v(name, body)),
t AS (SELECT name, {grams.format('ws')} AS tb FROM tw),
m AS (SELECT r, doc_id, line, name, len(bs) AS n_bigrams,
             CAST(2 * len(list_intersect(bs, tb)) AS DOUBLE) / (len(bs) + len(tb)) AS dice FROM b, t)
SELECT doc_id, CAST(line AS INTEGER) AS line, name AS license, dice, CAST(n_bigrams AS INTEGER) AS n_bigrams
FROM m WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, name) = 1"""
