"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above (operator 8).

Every line of a text is a segment. Term weights are ``tf * (ln((1 + N) / (1 + df)) + 1)`` with document frequencies over all
documents; terms that no template has weigh as if no document had them. A line is like a template if the cosine reaches the
threshold. By the Cauchy-Schwarz bound such a line must hold one of the template's heaviest terms, those without which the rest
of its norm stays below the threshold, so only lines with one of these are weighed.

Further segments are paragraphs and runs of comment lines, comment marks removed and lines joined, and the whole of license files.
Paragraphs are weighed against the headers that licenses ask for (``HEADERS``), runs and whole files against whole license texts
(``license_texts``). Here a term weighs ``(1 + ln tf) * (ln((1 + T) / (1 + tf_T)) + 1)`` with frequencies over the ``T`` templates of
the kind, so that what tells licenses apart weighs most. A segment that reaches the threshold must hold a number of a template's rarer
terms (:func:`telling_terms`). Texts that don't are not cut at all, segments that don't are not weighed.

A file's own license is that of its best segment. Files named as license files speak for their directory; a file without a license of
its own takes that of the nearest directory above that has one, by a join on the paths of its ancestors.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import lower_ascii, small_side
from threadloom.session import cut_lineage

TERM = "[a-z0-9]+"
THRESHOLD = 0.75
#: Terms of fewer characters tell templates from prose badly.
LONG_TERM = 5
#: Directories with a license up to this many rows go to every task; more are joined by a shuffle.
BROADCAST_DIRECTORIES = 200_000
#: Texts that may hold a license, by id and hash, up to this many rows.
BROADCAST_TEXTS = 200_000

#: Notices that name a license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_GNU = ("is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; "
        "either version {1} of the License, or (at your option) any later version.")
#: Paragraphs that licenses ask for at the head of files, and the first paragraph of short ones.
HEADERS = {
    "AGPL-3.0": "This program " + _GNU.format("Affero General Public License", 3),
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                  "You may obtain a copy of the License at",
    "GPL-2.0": "This program " + _GNU.format("General Public License", 2),
    "GPL-3.0": "This program " + _GNU.format("General Public License", 3),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This library " + _GNU.format("Lesser General Public License", "2.1"),
    "LGPL-3.0": "This library " + _GNU.format("Lesser General Public License", 3),
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
           "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
           "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
               "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: A comment mark at the start of a line.
COMMENT = r"(?m)^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--)"
#: Names, in lower case and without an ending, of files that speak for their directory.
LICENSE_FILES = ("license", "licence", "copying", "notice")


def whole_texts() -> dict[str, str]:
    """Whole license texts by name. That of the AGPL is made from the GPL, which it repeats but for its names and section 13."""
    texts = {p.name.removesuffix(".txt"): p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    texts["AGPL-3.0"] = texts["GPL-3.0"].replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL") + (
        " Remote Network Interaction. If you modify the Program, your modified version must prominently offer all users interacting with it remotely "
        "through a computer network an opportunity to receive the Corresponding Source of your version from a network server at no charge.")
    return texts


def terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def inverse_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Weights of the templates' terms over all documents, and of a term that no document has."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(f"({TERM})"))
    found = F.array_intersect(words, F.array(*map(F.lit, vocabulary)))
    seen = {r["term"]: r["n"] for r in docs.select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = docs.count()
    weigh = lambda n: math.log((1 + total) / (1 + n)) + 1
    return {t: weigh(seen.get(t, 0)) for t in vocabulary}, weigh(0)


def needed_terms(weights: Mapping[str, float], threshold: float) -> list[str]:
    """The heaviest terms of a template; without any of them no text reaches the threshold."""
    rest, norm, out = 0.0, math.sqrt(sum(w * w for w in weights.values())), []
    for term in sorted(weights, key=lambda t: (weights[t], t)):
        rest += weights[term] ** 2
        if math.sqrt(rest) >= threshold * norm * (1 - 1e-9):
            out.append(term)
    return out


def scan_lines(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, mark, license, score)`` of the best line of each text that has one; ``mark`` is ``xxhash64`` of the text.

    Ties go to the license that comes first by name.
    """
    counts = {name: terms(text) for name, text in templates.items()}
    vocabulary = sorted(set().union(*counts.values()))
    idf, unknown = inverse_frequencies(docs, vocabulary)
    weights = {name: {t: n * idf[t] for t, n in c.items()} for name, c in counts.items()}
    needed = sorted(set().union(*(needed_terms(w, threshold) for w in weights.values())))

    text = F.coalesce("text", F.lit(""))
    pattern = f"(?<![a-z0-9])(?:{'|'.join(needed)})(?![a-z0-9])"
    # Most texts have no such term at all and are settled by one search.
    some = docs.select("doc_id", F.xxhash64(text).alias("mark"), lower_ascii(text).alias("_text")).filter(F.col("_text").rlike(pattern)).distinct()
    lines = some.select("doc_id", "mark", F.posexplode(F.split("_text", r"\n")).alias("_line", "_said")).filter(F.col("_said").rlike(pattern))
    words = lines.select("doc_id", "mark", "_line", F.explode(F.regexp_extract_all("_said", F.lit(f"({TERM})"))).alias("term"))

    idf_rows = F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("_idf")) for t, w in idf.items()]))
    template_rows = F.inline(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(t).alias("term"), F.lit(w / math.sqrt(sum(x * x for x in ws.values()))).alias("_w2"))
                                       for name, ws in weights.items() for t, w in ws.items()]))
    one = docs.sparkSession.range(1)  # both sides have as many rows as the templates have terms
    weighed = words.groupBy("doc_id", "mark", "_line", "term").agg(F.count(F.lit(1)).alias("_tf")).join(F.broadcast(one.select(idf_rows)), "term", "left").withColumn(
        "_w", F.col("_tf") * F.coalesce("_idf", F.lit(unknown)))
    norms = weighed.groupBy("doc_id", "mark", "_line").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    dots = weighed.join(F.broadcast(one.select(template_rows)), "term").groupBy("doc_id", "mark", "_line", "license").agg(F.sum(F.col("_w") * F.col("_w2")).alias("_dot"))
    same = dots.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), F.col("_line").alias("_l"), "license", "_dot")
    scored = norms.join(same, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")) & (F.col("_line") == F.col("_l"))).select(
        "doc_id", "mark", "license", F.round(F.col("_dot") / F.col("_norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    return scored.groupBy("doc_id", "mark").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("license")).select(
        "doc_id", "mark", "license", "score")


def _damped(templates: Mapping[str, str]) -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """Weights of each template's terms with length 1, and inverse frequencies of known and of unknown terms, over the templates."""
    counts = {name: terms(text) for name, text in templates.items()}
    seen = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in seen.items()}
    weights = {name: {t: (1 + math.log(n)) * idf[t] for t, n in c.items()} for name, c in counts.items()}
    norms = {name: math.sqrt(sum(w * w for w in ws.values())) for name, ws in weights.items()}
    return {name: {t: w / norms[name] for t, w in ws.items()} for name, ws in weights.items()}, idf, math.log(1 + len(counts)) + 1


def telling_terms(weights: Mapping[str, float], idf: Mapping[str, float], threshold: float) -> tuple[list[str], int]:
    """Some terms of a template, of length 1, that occur in few templates, and how many of them a text at the threshold has at least.

    Cosine is no larger than the length of what the text has of the template. At the threshold only ``1 - threshold ** 2`` of the squares
    can be missing, so of any part of the terms the text has the rest. The part of the rarest terms is taken that still asks for a third
    as many terms as any part does; short words, which every prose has, are left aside where the others ask for any.
    """
    parts = []
    for least in sorted({(len(t) >= LONG_TERM, idf[t]) for t in weights}, reverse=True):
        part = sorted(t for t in weights if (len(t) >= LONG_TERM, idf[t]) >= least)
        squares = sorted((weights[t] ** 2 for t in part), reverse=True)
        lack, number = sum(squares) - (1 - threshold * threshold) - 1e-9, 0
        while lack > 0:
            lack, number = lack - squares[number], number + 1
        parts.append((number, part))
    most = max((n for n, p in parts if min(map(len, p)) >= LONG_TERM), default=0) or max(n for n, _ in parts)
    number, part = next(p for p in parts if p[0] and 3 * p[0] >= most)
    return part, number


def _telling(sets: Sequence[Mapping[str, str]], threshold: float) -> list[tuple[list[str], int]]:
    return [telling_terms(w, idf, threshold) for weights, idf, _ in map(_damped, sets) for w in weights.values()]


def _may_reach(words: Column, templates: Mapping[str, str], threshold: float) -> Column:
    """Whether the words of a segment may reach the threshold with any template."""
    told = _telling([templates], threshold)
    listed = lambda ts: F.split(F.lit(" ".join(ts)), " ")
    every = listed(sorted(set().union(*(t for t, _ in told))))

    def held(found: Column) -> Column:
        return functools.reduce(lambda x, y: x | y, [F.size(F.array_intersect(found, listed(t))) >= n for t, n in told])

    # Bound to names by lambdas, or the words would be cut anew for every template.
    shared = F.transform(F.array(words), lambda w: F.array_intersect(w, every))
    return F.exists(shared, lambda found: (F.size(found) >= min(n for _, n in told)) & held(found))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TERM})"))


def scan_segments(segments: DataFrame, templates: Mapping[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, mark, license, score)`` of all templates at the threshold for ``segments (doc_id, mark, said)``, in lower case."""
    weights, idf, unknown = _damped(templates)
    held = segments.select("doc_id", "mark", _words(F.col("said")).alias("_words")).filter(_may_reach(F.col("_words"), templates, threshold))
    # A segment is known by its words; equal ones of a text are one.
    numbered = held.withColumn("_seg", F.xxhash64("_words")).dropDuplicates(["doc_id", "mark", "_seg"])
    counted = numbered.select("doc_id", "mark", "_seg", F.explode("_words").alias("term")).groupBy("doc_id", "mark", "_seg", "term").agg(F.count(F.lit(1)).alias("_tf"))
    one = segments.sparkSession.range(1)  # both sides have as many rows as the templates have terms
    idf_rows = one.select(F.explode(F.from_json(F.lit(json.dumps(idf)), "map<string,double>")).alias("term", "_idf"))
    template_rows = one.select(F.explode(F.from_json(F.lit(json.dumps(weights)), "map<string,map<string,double>>")).alias("license", "_ws")).select(
        "license", F.explode("_ws").alias("term", "_w2"))
    weighed = counted.join(F.broadcast(idf_rows), "term", "left").withColumn("_w", (1 + F.log("_tf")) * F.coalesce("_idf", F.lit(unknown)))
    norms = weighed.groupBy("doc_id", "mark", "_seg").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    dots = weighed.join(F.broadcast(template_rows), "term").groupBy("doc_id", "mark", "_seg", "license").agg(F.sum(F.col("_w") * F.col("_w2")).alias("_dot")).select(
        F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), F.col("_seg").alias("_s"), "license", "_dot")
    return norms.join(dots, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")) & (F.col("_seg") == F.col("_s"))).select(
        "doc_id", "mark", "license", F.round(F.col("_dot") / F.col("_norm"), 6).alias("score")).filter(F.col("score") >= threshold)


def scan_blocks(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, mark, license, score)`` of paragraphs, runs of comment lines and whole license files at the threshold."""
    text = F.coalesce("text", F.lit(""))
    read = files.select("doc_id", F.xxhash64(text).alias("mark"), lower_ascii(text).alias("_text"), F.coalesce(_speaks(F.col("path")), F.lit(False)).alias("_speaks"))
    told = _telling([HEADERS, whole_texts()], threshold)
    one = files.sparkSession.range(1)  # both sides are as large as the templates
    terms_of = one.select(F.explode(F.from_json(F.lit(json.dumps({i: t for i, (t, _) in enumerate(told)})), "map<string,array<string>>")).alias("_t", "_terms")).select(
        "_t", F.explode("_terms").alias("term"))
    needs = one.select(F.explode(F.from_json(F.lit(json.dumps({i: n for i, (_, n) in enumerate(told)})), "map<string,int>")).alias("_t", "_need"))
    # Most texts have too few of any template's own words for all of their parts.
    words = read.select("doc_id", "mark", F.explode(F.array_distinct(_words(F.col("_text")))).alias("term"))
    met = words.join(F.broadcast(terms_of), "term").groupBy("doc_id", "mark", "_t").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(needs), "_t").filter("_n >= _need")
    few = cut_lineage(met.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).distinct())
    read = read.join(small_side(few, BROADCAST_TEXTS), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left_semi")
    plain = F.regexp_replace("_text", COMMENT, "")
    paragraphs = read.select("doc_id", "mark", F.explode(F.split(plain, r"\n[ \t\r]*\n")).alias("said"))
    # What stands between lines without a comment mark.
    code = r"(?m)^(?![ \t]*(?://|/\*|\*|#|--|;|%|<!--))[ \t]*[^ \t\r\n].*$"
    runs = read.select("doc_id", "mark", F.explode(F.split("_text", code)).alias("said"))
    whole = read.filter("_speaks").select("doc_id", "mark", F.col("_text").alias("said"))
    return scan_segments(paragraphs, HEADERS, threshold).unionByName(scan_segments(runs.unionByName(whole), whole_texts(), threshold))


def _speaks(path: Column) -> Column:
    """Is it a file that speaks for its directory?"""
    return F.lower(F.regexp_extract(path, r"([^/.]*)[^/]*\z", 1)).isin(*LICENSE_FILES)


def directory(path: Column) -> Column:
    """The part before the last ``/``; empty at the top."""
    return F.regexp_extract(path, r"(?s)\A(.*)/", 1)


def scan(files: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, path, license, how, score, from_path)``, one row per row of ``files (doc_id, path, text)``.

    ``how`` is ``own``, ``inherited`` or ``none``; ``score`` is the cosine of the segment behind the license, ``from_path`` the file it
    stands in. Of several license files in a directory the best scored speaks, then the first by path. Null and empty texts have no
    license of their own; a null path is a file without a directory, which inherits nothing. Rows that share an id are told apart by
    text. An empty table gives no rows; other columns are not used.
    """
    best = scan_lines(files, templates, threshold).unionByName(scan_blocks(files, threshold))
    found = cut_lineage(best.groupBy("doc_id", "mark").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("license")))
    own = found.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "license", "score")
    rows = files.select("doc_id", "path", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    told = cut_lineage(rows.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left").select("doc_id", "path", "license", "score"))

    spoken = told.filter(F.col("license").isNotNull() & _speaks(F.col("path"))).groupBy(directory(F.col("path")).alias("_dir")).agg(
        F.min_by(F.struct("license", "score", "path"), F.struct(-F.col("score"), "path")).alias("_from"))
    spoken = cut_lineage(spoken)

    parts = F.split(directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("_depth"), F.array_join(F.slice(parts, 1, n), "/").alias("_dir")))
    bare = told.filter(F.col("license").isNull() & F.col("path").isNotNull()).select("path").distinct()
    asked = bare.select("path", F.inline(above)).distinct()
    nearest = asked.join(small_side(spoken, BROADCAST_DIRECTORIES), "_dir").groupBy("path").agg(F.max_by("_from", "_depth").alias("_from"))
    joined = told.join(nearest.withColumnRenamed("path", "_path"), F.col("license").isNull() & (F.col("path") == F.col("_path")), "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("_from").isNotNull(), "inherited").otherwise("none")
    return joined.select("doc_id", "path", F.coalesce("license", "_from.license").alias("license"), how.alias("how"), F.coalesce("score", "_from.score").alias("score"),
                         F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("_from.path")).alias("from_path"))
