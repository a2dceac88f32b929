"""Licence scans with a trained paragraph classifier, in DataFrame and SQL functions only.

Paragraphs are bags of hashed word one- and two-grams. A multinomial logistic regression tells the
licence families and ``unknown`` apart; it is trained by gradient steps written as joins and
aggregates. Its examples are the template sentences below, whole, in part and amid other words, and
for ``unknown`` a bounded sample of the corpus' own paragraphs and sentences that only sound like a
licence. A held-out part of the examples sets the temperature of the probabilities and how probable
a family must be, so that ``unknown`` is seldom taken for one. A prediction counts once one of the
family's templates confirms it: the paragraph has most of the template's two-grams.

Texts are first looked through, once, for ``HINTS``: of every template so many two-grams hold one of
these words that a paragraph with none of them cannot be confirmed. What has no hint and none of the
``CUES`` is not scored; the test that turns this off finds the same.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.llm.common import col, staged

UNKNOWN = "unknown"
BUCKETS = 1 << 14
ROUNDS = 24
RATE, DECAY = 4.0, 1e-4
#: Corpus lines that teach ``unknown``, at most, and the texts, chosen by their hash, that they are from.
MAX_NEGATIVES, MAX_DOCS = 600, 600
#: Share of held-out ``unknown`` examples that may pass as a family.
FALSE_SHARE = 0.01
LEAST_PROBABILITY = 0.5
COVERAGE = 0.6
#: Windows of so many words, by half their size, are scored beside a whole unit. The longest template
#: fits the largest in any place, and shorter ones a window with few other words.
WINDOWS = (12, 24, 48, 80)

# Sentences of public licences, by family.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE 2.0."),
    ("Apache-2.0", "This software is distributed under the Apache License 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "You can redistribute it and or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("LGPL", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Released under the BSD 3 Clause License."),
    ("BSD", "Use of this source code is governed by a BSD style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC0", "Dedicated to the public domain under the CC0 1.0 license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved by the copyright holder."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "The GNU Affero General Public License is designed specifically to ensure that the modified source code becomes available to the community."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("Zlib", "Licensed under the zlib License."),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("Artistic-2.0", "You are permitted to use this Package under the terms of the Artistic License as specified in the Package."),
)
# Sentences that sound like a licence and are none.
SOUNDS_ALIKE = (
    "She lost her driving license last year.",
    "The permission slip must be signed by a parent.",
    "Copyright law is the topic of the second lecture.",
    "The warranty of the engine ends after two years.",
    "They asked for permission to enter the public library.",
    "A fishing license is required in this state.",
    "The general public was free to use the new software.",
    "Version 2 of the plan was redistributed to all members.",
    "The license plate was found under the bridge.",
    "Apache helicopters were seen over the valley.",
    "The students of MIT released a new map under the old name.",
    "The council granted the company a license to sell food.",
    "No copyright notice is needed for short quotes.",
    "The licensed plumber came under the terms of the contract.",
    "The clause was part of the general agreement.",
)
# Every template has one of these.
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "public domain", "all rights reserved")

# Words that are chosen as hints last.
_COMMON = frozenset("a and any by for from in is it may not of or that the this to under use with without you".split())


def _hints() -> tuple[str, ...]:
    """Words, long ones first, until of each template the two-grams without any are too few to confirm."""
    chosen: set[str] = set()
    for _, template in TEMPLATES:
        own = [w for w in re.split(r"[^a-z0-9]+", template.lower()) if w]
        grams = set(zip(own, own[1:], strict=False))
        left = sorted(set(own), key=lambda w: (w in _COMMON, -len(w), w))
        while sum(not chosen & set(g) for g in grams) >= COVERAGE * len(grams):
            chosen.add(left.pop(0))
    return tuple(sorted(chosen))


HINTS = _hints()
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
CLASSES = (*FAMILIES, UNKNOWN)


class Model(NamedTuple):
    weights: DataFrame  # bucket, w0 .. one column for each class; bucket -1 is the bias
    temperature: float
    least: float


# ---------------------------------------------------------------------------------------------
# text as columns


def _rows(spark: SparkSession, names: str, rows) -> DataFrame:
    """A few fixed rows, as literals of the plan."""
    cells = (F.struct(*(F.lit(v).alias(n) for n, v in zip(names.split(), row, strict=True))) for row in rows)
    return spark.range(1).select(F.inline(F.array(*cells)))


#: What belongs to a word, as ``words`` parts them.
_IN_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]"


def _pattern(hints: bool) -> str:
    """A cue anywhere or, with ``hints``, a hint as a word; alternatives of hints by first letter."""
    found = [re.escape(c) for c in CUES]
    if hints:
        by_letter: dict[str, list[str]] = {}
        for hint in HINTS:
            by_letter.setdefault(hint[0], []).append(hint[1:])
        some = "|".join(f"{letter}(?:{'|'.join(ends)})" for letter, ends in by_letter.items())
        found.append(f"(?<!{_IN_WORD})(?:{some})(?!{_IN_WORD})")
    return "|".join(found)


def has_cue(text: Column) -> Column:
    return F.coalesce(F.rlike(F.lower(text), F.lit(_pattern(False))), F.lit(False))


def may_hold(text: Column) -> Column:
    """Whether a text has a cue, or a hint as a word of its own."""
    return F.coalesce(F.rlike(F.lower(text), F.lit(_pattern(True))), F.lit(False))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def two_grams(own: str) -> Column:
    """The distinct neighbours among the words in column ``own``."""
    pairs = f"transform(sequence(0, size({own}) - 2), i -> concat({own}[i], ' ', {own}[i + 1]))"
    return F.expr(f"if(size({own}) < 2, array(), array_distinct({pairs}))")


def buckets(own: str, grams: str) -> Column:
    """The hashed one- and two-grams, and -1 for the bias."""
    return F.expr(f"array_union(array(-1L), array_distinct(transform(concat({own}, {grams}), g -> pmod(xxhash64(g), {BUCKETS}L))))")


def _bagged(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("own", words(F.col(text))).withColumn("grams", two_grams("own"))


# ---------------------------------------------------------------------------------------------
# training


def _examples(docs: DataFrame, text: str) -> DataFrame:
    """``label`` (place in CLASSES), ``held`` and ``bag`` of all examples."""
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(col(text)).alias("h"), col(text).alias("t")).where(F.length("t") > 20)
    # the least hashes are found first, so that no text is shuffled
    least = texts.select("h").distinct().orderBy("h").limit(MAX_DOCS)
    chosen = texts.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"])
    lines = chosen.select(F.explode(F.split("t", "\n")).alias("t")).where((F.length("t") > 20) & ~has_cue(F.col("t")))
    negatives = staged(lines.distinct().orderBy(F.xxhash64("t")).limit(MAX_NEGATIVES).coalesce(1), "licences-negatives")
    alike = _rows(spark, "t", ((t,) for t in SOUNDS_ALIKE))
    unknown = negatives.unionByName(alike).select(F.lit(len(CLASSES) - 1).alias("label"), "t")
    templates = _rows(spark, "label t", ((FAMILIES.index(f), t) for f, t in TEMPLATES))
    parts = _bagged(templates, "t").select("label", "own", F.expr("size(own)").alias("n"))
    # whole; the first and last two thirds; and amid words of the corpus
    cuts = parts.select("label", F.explode(F.expr(
        "array(own, slice(own, 1, greatest(2, cast(ceil(n * 0.67) as int))), slice(own, greatest(1, cast(floor(n * 0.33) as int)), n))")).alias("own"))
    whole = cuts.select("label", F.array_join("own", " ").alias("t"))
    lone = negatives.orderBy(F.xxhash64("t", F.lit(1))).limit(200).select(
        F.pmod(F.xxhash64("t", F.lit(2)), F.lit(len(TEMPLATES))).alias("k"), F.substring("t", 1, 200).alias("around"))
    numbered = _rows(spark, "k label t", ((k, FAMILIES.index(f), t) for k, (f, t) in enumerate(TEMPLATES)))
    amid = numbered.join(lone, "k").select("label", F.concat_ws(" ", "around", "t").alias("t"))
    rows = whole.unionByName(amid).unionByName(unknown).distinct()
    bagged = _bagged(rows, "t").where("size(own) > 0")
    return staged(bagged.select(F.xxhash64("t", "label").alias("ex"), "label", (F.pmod(F.xxhash64("t"), F.lit(5)) == 0).alias("held"),
                                buckets("own", "grams").alias("bag")).dropDuplicates(["ex"]).coalesce(1), "licences-examples")


def _scores(bags: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """The classes' scores ``z`` of rows with a ``bag``."""
    held = bags.select(*keys, F.explode("bag").alias("bucket")).join(weights, "bucket")
    sums = held.groupBy(*keys).agg(*(F.sum(f"w{k}").alias(f"w{k}") for k in range(len(CLASSES))))
    return sums.select(*keys, F.array(*(f"w{k}" for k in range(len(CLASSES)))).alias("z"))


def _softmax(z: str, heat: float = 1.0) -> Column:
    return F.expr(f"""transform({z}, v -> exp((v - array_max({z})) / {heat!r}D) /
        aggregate({z}, 0D, (s, u) -> s + exp((u - array_max({z})) / {heat!r}D)))""")


def train(docs: DataFrame, text: str = "text") -> Model:
    """The classifier; its examples are bounded by the templates and ``MAX_NEGATIVES``.

    A round is a handful of joins and sums over these few rows. Each input is one file, so a round is
    one stage without a shuffle.
    """
    examples = _examples(docs, text).coalesce(1)
    n = len(CLASSES)
    taught = examples.where("not held")
    flat = staged(taught.select("ex", "label", F.explode("bag").alias("bucket")), "licences-features").coalesce(1)
    sizes = taught.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    per = taught.join(sizes, "label").select("ex", "label", (1 / (F.col("n_label") * n)).alias("share"))
    per = staged(per, "licences-shares").coalesce(1)
    weights = flat.select("bucket").distinct().select("bucket", *(F.lit(0.0).alias(f"{c}{k}") for c in "wm" for k in range(n)))
    for _ in range(ROUNDS):
        chance = _scores(taught.select("ex", "bag"), weights, "ex").select("ex", _softmax("z").alias("p"))
        off = per.join(chance, "ex").select("ex", *(
            (F.col("share") * (F.element_at("p", k + 1) - (F.col("label") == k).cast("double"))).alias(f"d{k}") for k in range(n)))
        slope = flat.join(off, "ex").groupBy("bucket").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(n)))
        # a step with momentum
        moved = weights.join(slope, "bucket").select("bucket", *(f"w{k}" for k in range(n)), *(
            (0.8 * F.col(f"m{k}") - RATE * (F.col(f"d{k}") + DECAY * F.col(f"w{k}"))).alias(f"m{k}") for k in range(n)))
        weights = staged(moved.select("bucket", *((F.col(f"w{k}") + F.col(f"m{k}")).alias(f"w{k}") for k in range(n)), *(f"m{k}" for k in range(n))), "licences-weights").coalesce(1)
    weights = weights.select("bucket", *(f"w{k}" for k in range(n)))
    held = examples.where("held")
    judged = staged(held.select("ex", "label").join(_scores(held.select("ex", "bag"), weights, "ex"), "ex"), "licences-held")
    heats = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
    loss = judged.agg(*(F.avg(-F.log(F.element_at(_softmax("z", h), F.col("label") + 1) + 1e-12)).alias(f"h{k}") for k, h in enumerate(heats))).first()
    heat = min(zip(loss, heats, strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))[1]
    family = F.array_max(F.slice("p", 1, n - 1))
    passing = judged.where(F.col("label") == n - 1).select(_softmax("z", heat).alias("p")).agg(F.percentile(family, F.lit(1 - FALSE_SHARE))).first()[0]
    return Model(weights, heat, max(LEAST_PROBABILITY, passing or 0.0))


# ---------------------------------------------------------------------------------------------
# scanning


def paragraphs(docs: DataFrame, text: str, gate: bool = True) -> DataFrame:
    """Lines, and paragraphs of several lines, that may hold a licence; with their place."""
    def listed(pattern: str, kind: str) -> Column:
        return F.transform(F.split(col(text), pattern), lambda part, place: F.struct(F.lit(kind).alias("kind"), place.alias("place"), part.alias("part")))

    blocks = F.filter(listed(r"\n[ \t\r]*\n", "paragraph"), lambda u: F.contains(u["part"], F.lit("\n")))
    rows = docs.select("doc_id", "row", F.explode(F.concat(listed("\n", "line"), blocks)).alias("unit")).select("doc_id", "row", "unit.*")
    return rows.where(may_hold(F.col("part")) if gate else F.length("part") > 0)


def _known_grams() -> list[tuple[str, ...]]:
    """Two-grams of the templates with a hint: each window that a template can confirm has one."""
    lists = (re.findall(r"[a-z0-9]+", t.lower()) for _, t in TEMPLATES)
    return sorted({g for own in lists for g in zip(own, own[1:], strict=False) if set(g) & set(HINTS)})


def windows(found: DataFrame) -> DataFrame:
    """Units of ``found`` whole and in the windows that a template could confirm: ``id``, place ``a`` to
    ``b`` and own words of each.

    Where a unit has a two-gram of a template with a hint is found once, by position; windows
    are then made around these places only, on a grid of half their size.
    """
    listed = ", ".join(f"'{x} {y}'" for x, y in _known_grams())
    marks = f"filter(sequence(0, n - 2), i -> concat(own[i], ' ', own[i + 1]) IN ({listed}))"
    spans = ["array(struct(0 AS a, n AS b))"]
    for size in WINDOWS:
        step = size // 2
        last = f"cast(ceil((n - {size}) / {step}) as int)"
        # those before and behind a mark; the last one ends with the unit
        around = f"array_distinct(flatten(transform(marks, m -> array(least({last}, greatest(0, m div {step} - 1)), least({last}, m div {step}), {last}))))"
        spans.append(f"if(n > {size}, transform({around}, i -> struct(cast(least(i * {step}, n - {size}) as int) AS a, "
                     f"cast(least(i * {step}, n - {size}) + {size} as int) AS b)), array())")
    rows = found.select("id", "own", F.size("own").alias("n")).where("n > 0")
    rows = rows.withColumn("marks", F.expr(f"if(n < 2, array(), {marks})"))
    rows = rows.select("id", "own", F.explode(F.expr(f"concat({', '.join(spans)})")).alias("span"))
    return rows.select("id", "span.a", "span.b", F.expr("slice(own, span.a + 1, span.b - span.a)").alias("own"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, gate: bool = True) -> DataFrame:
    """One row per document: ``families`` (confirmed, sorted), ``findings`` and ``n_unknown``.

    A finding is a line or a paragraph of several lines: its kind, place, predicted family,
    probability, template coverage, and text. ``n_unknown`` counts the lines with a cue, or with most
    of a template of the predicted family, that no family claims or no template confirms. Units are also looked at in overlapping windows, so a notice counts
    wherever it stands in a long one; of windows that overlap, a family gives way to another that covers
    more of its template. A unit with several families has a finding for each. A null or empty text has no findings. Rows that repeat an id and
    a text get the same result each. No documents give no rows; other columns are not read.
    """
    model = model or train(docs, text)
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).withColumn("row", F.xxhash64("text"))
    # the few texts that pass, written: they are listed, and their units dealt anew, from there
    once = staged(rows.where(may_hold(F.col("text")) if gate else F.col("text").isNotNull()).dropDuplicates(["doc_id", "row"]), "licences-texts")
    found = paragraphs(once, "text", gate)
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    found = staged(found.repartition(tasks, "doc_id", "row", "kind", "place").withColumn("id", F.monotonically_increasing_id()), "licences-found")
    wanted = _bagged(_rows(docs.sparkSession, "k t", ((FAMILIES.index(f) + 1, t) for f, t in TEMPLATES)), "t")
    wanted = wanted.select("k", F.col("grams").alias("wanted"))
    bagged = found.select("id", words(F.col("part")).alias("own"))
    parts = windows(bagged).withColumn("grams", two_grams("own"))
    parts = staged(parts.withColumn("win", F.monotonically_increasing_id()), "licences-windows")
    bags = parts.select("win", buckets("own", "grams").alias("bag"))
    chance = _scores(bags, model.weights, "win").select("win", _softmax("z", model.temperature).alias("p"))
    n = len(CLASSES)
    family = F.array_max(F.slice("p", 1, n - 1))
    chance = chance.select("win", family.alias("probability"), F.array_position("p", family).cast("int").alias("k"),
                           (F.element_at("p", n) < family).alias("ahead"))
    compared = parts.select("id", "win", "a", "b", "grams").join(chance, "win").join(wanted, "k").groupBy("id", "win", "a", "b", "probability", "k", "ahead").agg(
        F.max(F.size(F.array_intersect("grams", "wanted")) / F.size("wanted")).alias("coverage"))
    names = F.array(*map(F.lit, FAMILIES))
    confirmed = F.col("ahead") & (F.col("probability") >= model.least) & (F.col("coverage") >= COVERAGE)
    compared = compared.withColumn("family", F.when(confirmed, F.element_at(names, F.col("k"))).otherwise(UNKNOWN))
    # the windows of a unit that count, without those that overlap a better covered one of another family
    window = F.struct("a", "b", "family", "coverage", "probability")
    per_unit = compared.groupBy("id").agg(F.max("coverage").alias("most"),
                                          F.collect_list(F.when(F.col("family") != UNKNOWN, window)).alias("ws"))
    best = F.expr("""filter(ws, w -> not exists(ws, v -> v.family <> w.family and v.coverage > w.coverage and v.a < w.b and w.a < v.b))""")
    per_unit = per_unit.select("id", "most", F.explode_outer(best).alias("w"))
    per_unit = per_unit.groupBy("id", F.coalesce("w.family", F.lit(UNKNOWN)).alias("family")).agg(
        F.max("most").alias("most"), F.max(F.struct("w.coverage", "w.probability")).alias("w"))
    per_unit = per_unit.select("id", "family", F.coalesce("w.coverage", "most").alias("coverage"), F.col("w.probability").alias("probability"))
    judged = found.select("id", "doc_id", "row", "kind", "place", "part").join(per_unit, "id")
    finding = F.struct("kind", "place", "family", F.round("probability", 6).alias("probability"), F.round("coverage", 6).alias("coverage"), F.col("part").alias("text"))
    known = F.col("family") != UNKNOWN
    per = judged.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_set(F.when(known, F.col("family")))).alias("families"),
        F.array_sort(F.collect_list(F.when(known, finding))).alias("findings"),
        F.count(F.when(~known & (has_cue(F.col("part")) | (F.col("coverage") >= COVERAGE)) & (F.col("kind") == "line"), 1)).alias("n_unknown"))
    light, per = rows.select("doc_id", "row"), per.withColumnRenamed("doc_id", "i").withColumnRenamed("row", "r")
    joined = light.join(per, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left")
    none = lambda c: F.coalesce(c, F.array().cast(per.schema[c].dataType))
    return joined.select("doc_id", none("families").alias("families"), none("findings").alias("findings"),
                         F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))
