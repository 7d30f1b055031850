"""Operator 10: licence scans, in DataFrame and SQL functions and Spark's own machine learning.

Paragraphs are lines and runs of up to eight lines between blank ones, so that wrapped notices
are read whole. A logistic regression on binary word 1- and 2-grams gives each paragraph a
licence family or the unknown class. It is trained on notices made by rule from the families'
public names and wordings, on sentences that merely use their words, and on a bounded sample
of the corpus' own lines; the least probability that counts is calibrated on such sentences
and lines kept apart. A prediction stands when the paragraph holds enough of the word pairs of
one of the family's templates. A paragraph that holds none of the cue words can't hold so many
of any template's pairs (see ``cues``), so only others are judged.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.llm.common import materialize, release

# fixed values: notices by licence family, in their usual public wording
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 2-Clause license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "Public-Domain": ("This work is dedicated to the public domain.", "Released into the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."),
    "Proprietary": ("Copyright by the author. All rights reserved.", "All rights reserved. No part of this work may be reproduced without the written permission of the copyright owner."),
}
# sentences that are no notices
OTHERS = (
    "She lost her driving license on the way to the office.",
    "The license plate of the car was covered with snow.",
    "He asked for permission to leave the room early.",
    "The warranty of the washing machine ends in May.",
    "The city council granted a license to sell food at the fair.",
    "The general public was invited to the opening of the library.",
    "A public library is free to use for every person in town.",
    "Version 2.0 of the game was released in spring.",
    "The source of the river lies in the public forest.",
    "They redistribute bread to people under the bridge.",
    "The terms of the contract were discussed for hours.",
    "Copyright law is taught in the second year.",
    "The fishing license costs four euros this year.",
    "Without the permission of the owner nobody may enter.",
    "The mozilla team met in the creative part of the town.",
    "An apache helicopter flew over the field.",
    "You may use this door except in winter.",
    "The commons were used by all the farmers of the village.",
    "This work was done under the direction of the teacher.",
    "The license was revoked after the third offence.",
    "All rights of passage were reserved for the king.",
    "A copy of this file was sent to any person who asked.",
    "The poet released her third book under another name.",
    "Licensed drivers may park in the yard.",
    "The pilot is licensed to fly at night.",
    "No warranty covers damage by water.",
)
# fixed values: public names of the families' licences
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT license", "Expat MIT License", "X11 MIT License"),
    "Apache": ("Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0 license", "Apache Software License 2.0"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPL-3.0-or-later license"),
    "LGPL": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-2.1-only license"),
    "AGPL": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0-only license"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause license", "New BSD License", "Modified BSD License"),
    "MPL": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0 license"),
    "CC-BY": ("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
}
SAID = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "Published under the terms of the {}.", "This work is licensed under the {}.", "This software is available under the {}.", "The code is covered by the {}.", "You may use it under {}.")
# sentences about licences that grant nothing
ABOUT = ("The lawyer compared the {} with three others.", "A talk on the {} was held in spring.", "Nobody in the office had read the {}.", "They argued for hours about the {}.", "His thesis deals with the history of the {}.", "The {} was mentioned in the first lecture.")
FRAMES = ("{}", "{} See the file LICENSE for details.", "Note: {}", "{} Thank you for reading.", "The following applies. {}", "{} Please read it with care.")
#: Documents of the corpus whose lines are examples of the unknown class, and lines taken at most: a bounded sample for fitting.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 200, 1500
#: Words of running text, which never are cues.
PLAIN = frozenset("a all and any are as at be by can for free in is it may no not of or public software source terms that the this to under use version with without work you".split())
#: Lines of a window, and lines from one to the next: any five lines in a row lie in one.
WINDOW, STEP = 8, 4
UNKNOWN = "unknown"
WORD = r"[^a-z0-9]+"


def words_of(text: Column) -> Column:
    """Words of letters a-z and digits, in lower case."""
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct 1- and 2-grams; a pair holds a blank."""
    return F.array_distinct(F.concat(words, pairs_of(words)))


def pairs_of(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _pairs(text: str) -> list[str]:
    w = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _needed(n: int, share: float) -> int:
    """The least number of n pairs that is at least share of them."""
    return next(k for k in range(n + 1) if k / float(n) >= share)


def cues(share: float) -> list[str]:
    """Words, of which every text with ``share`` of the pairs of any template holds one.

    They are taken one by one, those in most pairs first, until no template has so many pairs without any of them.
    """
    pairs = [_pairs(t) for v in TEMPLATES.values() for t in v]
    out: list[str] = []
    while True:
        left = [[p for p in own if not set(p.split()) & set(out)] for own in pairs]
        open_ = [rest for own, rest in zip(pairs, left, strict=True) if len(rest) >= _needed(len(own), share)]
        if not open_:
            return out
        counts: dict[str, int] = {}
        for rest in open_:
            for p in rest:
                for w in set(p.split()) - PLAIN:
                    counts[w] = counts.get(w, 0) + 1
        if not counts:
            raise ValueError("a template has too few words that are not in PLAIN")
        out.append(min(counts, key=lambda w: (-counts[w], w)))


def _literal(spark: SparkSession, rows: list[tuple[str, str, bool]]) -> DataFrame:
    made = [F.struct(F.lit(a).alias("text"), F.lit(b).alias("family"), F.lit(c).alias("apart")) for a, b, c in rows]
    return spark.range(1).select(F.explode(F.array(*made)).alias("x")).select("x.*")


def examples() -> list[tuple[str, str, bool]]:
    """(text, family, whether it is kept apart for calibration and held-out figures)."""
    out = [(f.format(t), k, False) for k, v in TEMPLATES.items() for t in v for f in FRAMES]
    out += [(s.format(n), k, (i + j) % 4 == 3) for k, v in NAMES.items() for i, n in enumerate(v) for j, s in enumerate(SAID)]
    names = [n for v in NAMES.values() for n in v]
    out += [(f.format(t), UNKNOWN, i % 3 == 2) for i, t in enumerate(OTHERS) for f in FRAMES]
    out += [(s.format(n), UNKNOWN, (i + j) % 3 == 2) for i, n in enumerate(names) for j, s in enumerate(ABOUT)]
    return out + [(f.format(""), UNKNOWN, False) for f in FRAMES[1:]]


def sample_lines(docs: DataFrame, share: float) -> DataFrame:
    """text, family and apart of a bounded sample of lines of docs that hold no template's share of pairs: no notices by definition."""
    some = docs.where("text is not null").select("text", F.xxhash64("text").alias("_h")).orderBy("_h").limit(SAMPLE_DOCUMENTS)
    lines = some.select(F.explode(F.split("text", "\n")).alias("text")).where(F.trim("text") != "")
    lines = lines.select("text", F.xxhash64("text").alias("_h")).orderBy("_h").limit(SAMPLE_LINES)
    held = lines.where(F.greatest(*(_template_share(words_of(F.col("text")), t) for v in TEMPLATES.values() for t in v)) < share)
    return held.select("text", F.lit(UNKNOWN).alias("family"), (F.pmod("_h", F.lit(3)) == 2).alias("apart"))


@dataclass
class Model:
    families: list[str]  # UNKNOWN is the first
    bias: list[float]
    weights: DataFrame  # gram, w: one weight a family; no more rows than the made examples have grams
    least: float
    held_out: dict[str, float]  # figures on the examples kept apart


def train(spark: SparkSession, false_share: float = 0.01, docs: DataFrame | None = None, share: float = 0.6) -> Model:
    """Fits the regression to the examples, and lines of docs if given, and calibrates the least probability.

    That is the one above which at most false_share of the unknown examples kept apart are given a family.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    own = _literal(spark, examples()).withColumn("made", F.lit(True))
    if docs is not None:
        own = own.unionByName(sample_lines(docs, share).withColumn("made", F.lit(False)))
    own = materialize(own.coalesce(1).withColumn("grams", grams_of(words_of(F.col("text")))), "notices")
    used = own.where("not apart")
    # grams of the corpus alone tell nothing of licences
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(used.where("made"))
    order = StringIndexer(inputCol="family", outputCol="label", stringOrderType="frequencyDesc").fit(used)
    fitted = LogisticRegression(maxIter=40, regParam=0.002, family="multinomial").fit(order.transform(vocabulary.transform(used)))
    labels = list(order.labels)
    families = [UNKNOWN, *(x for x in labels if x != UNKNOWN)]
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    at = [labels.index(x) for x in families]
    weights = _weights(spark, list(vocabulary.vocabulary), matrix[at])
    model = Model(families, [float(bias[k]) for k in at], weights, 0.0, {})
    apart = own.where("apart").withColumn("_row", F.monotonically_increasing_id()).withColumn("_unit", F.lit(0))
    judged = apart.select("_row", F.col("family").alias("true")).join(predict(apart.select("_row", "_unit", "text"), model), "_row", "left")
    wrong = judged.where(F.col("true") == UNKNOWN).select(F.when(F.col("family") != UNKNOWN, F.col("p")).otherwise(0.0).alias("p"))
    model.least = max(0.5, float(wrong.agg(F.percentile("p", 1 - false_share)).first()[0] or 0.0))
    said = F.when(F.col("p") >= model.least, F.col("family")).otherwise(F.lit(UNKNOWN))
    right = (F.coalesce(said, F.lit(UNKNOWN)) == F.col("true")).cast("double")
    figures = judged.groupBy((F.col("true") == UNKNOWN).alias("u")).agg(F.avg(right).alias("share"))
    model.held_out = {"unknown" if r["u"] else "families": r["share"] for r in figures.collect()}  # two rows
    release(own)
    return model


def _weights(spark: SparkSession, grams: list[str], matrix) -> DataFrame:
    """gram and w, its column of matrix: as a literal text, so that no Python worker makes the rows."""
    text = json.dumps([{"gram": g, "w": [float(x) for x in matrix[:, j]]} for j, g in enumerate(grams)])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<gram:string,w:array<double>>>")).alias("x")).select("x.*")


def predict(paragraphs: DataFrame, model: Model) -> DataFrame:
    """_row, _unit, family and p, its probability, of paragraphs (_row, _unit, text) with a gram that the model knows."""
    grams = paragraphs.select("_row", "_unit", F.explode(grams_of(words_of(F.col("text")))).alias("gram"))
    n = len(model.families)
    found = grams.join(F.broadcast(model.weights), "gram")
    sums = found.groupBy("_row", "_unit").agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(n)))
    raw = [F.col(f"s{i}") + F.lit(model.bias[i]) for i in range(n)]
    top = F.greatest(*raw)
    total = sum((F.exp(x - top) for x in raw), F.lit(0.0))
    best = F.array_max(F.array(*(F.struct(x.alias("x"), F.lit(k).alias("k")) for x, k in zip(raw, model.families, strict=True))))
    return sums.select("_row", "_unit", best["k"].alias("family"), (F.exp(best["x"] - top) / total).alias("p"))


def template_share(words: Column, family: Column) -> Column:
    """The largest share of a template's word pairs that words hold, over the family's templates; names and years aside."""
    out = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        own = [_template_share(words, t) for t in texts]
        out = F.when(family == name, F.greatest(*own)).otherwise(out)
    return out


def _template_share(words: Column, text: str) -> Column:
    own = _pairs(text)
    return F.size(F.array_intersect(F.array(*map(F.lit, own)), pairs_of(words))) / F.lit(float(len(own)))


def paragraphs_of(text: Column) -> Column:
    """The lines of text that are not blank, and the windows of lines in a row between blank ones, joined by blanks."""
    lines = F.split(text, "\n")
    single = F.filter(lines, lambda x: F.trim(x) != "")
    runs = F.transform(F.split(text, r"\n[ \t\r\f\x0B]*\n"), lambda r: F.filter(F.split(r, "\n"), lambda x: F.trim(x) != ""))

    def windows(run: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(run) - F.lit(STEP + 1)), F.lit(STEP))
        return F.transform(starts, lambda a: F.array_join(F.slice(run, a + 1, F.lit(WINDOW)), " "))

    several = F.filter(runs, lambda r: F.size(r) > 1)
    return F.concat(single, F.flatten(F.transform(several, windows)))


def scan_licences(docs: DataFrame, share: float = 0.6, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licences and licences of every row of docs.

    n_paragraphs counts the lines that are not blank, n_licences the families confirmed in some
    paragraph; licences lists them in order, joined by commas. Null and empty texts have none;
    texts are read whole, however long. Rows that share a doc_id are judged each for itself.
    Other columns are ignored; an empty table gives an empty result.
    """
    model = model or train(docs.sparkSession, docs=docs, share=share)
    # a word is a run of letters and digits with others around it
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), WORD, " "), F.lit(" "))
    words = cues(share)
    cue = lambda c: F.greatest(*(F.contains(c, F.lit(f" {x} ")) for x in words))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_plain", plain(F.col("text")))
    n = F.when(F.trim("text") == "", F.lit(0)).otherwise(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")))
    some = F.when(cue(F.col("_plain")), F.filter(paragraphs_of(F.col("text")), lambda x: cue(plain(x))))
    # row numbers hold for one reading only; what is written has few paragraphs of the texts
    rows = materialize(rows.select("_row", "doc_id", n.cast("long").alias("n_paragraphs"), some.alias("units")), "paragraphs")
    paragraphs = rows.select("_row", F.posexplode("units").alias("_unit", "text"))
    judged = predict(paragraphs, model).where((F.col("family") != UNKNOWN) & (F.col("p") >= model.least))
    checked = judged.join(paragraphs, ["_row", "_unit"]).where(template_share(words_of(F.col("text")), F.col("family")) >= share)
    per = checked.groupBy("_row").agg(F.array_sort(F.collect_set("family")).alias("families"))
    out = rows.select("_row", "doc_id", "n_paragraphs").join(per, "_row", "left")
    return out.select("doc_id", "n_paragraphs", F.when(F.col("families").isNull(), 0).otherwise(F.size("families")).cast("long").alias("n_licences"), F.coalesce(F.array_join("families", ","), F.lit("")).alias("licences"))
