"""Licence scan: a trained paragraph classifier, in DataFrame functions and Spark's own learners only.

A paragraph is a run of lines between blank ones, so a notice may be wrapped at any width. Its features are the hashed
one- and two-word sequences it holds; a sparse multinomial logistic regression separates the licence
families, other licence language (``unknown``) and ordinary text (``none``). The examples are made from
public notice templates and identifier tags (whole, cut at either end, with a word left out, between
ordinary words) and from a bounded number of paragraphs of the corpus that hold no licence word. A held-out
part of them calibrates the probabilities (temperature) and the least probability at which a family is
named; below it the verdict is ``unknown``. A named family is confirmed by the share of one of its templates'
word pairs that the paragraph holds, a pair counting less the more families use it, so that shared
boilerplate confirms nothing. A paragraph longer than the examples is classified in overlapping pieces of
their length, so that every notice is whole in one. Where a paragraph names a family, its other pieces are
parts of that notice and no unknown ones, and a BSD notice that gives its clauses is not also a general one.

Bounds (documented parameters): ``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters give the
ordinary paragraphs. Every paragraph of every document is classified.

Defined results: a null, empty or blank text has no paragraphs. Rows with equal doc_id and text count as
one document and get equal results; null doc_ids take part. Other columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakeline.llm.common import BLANKS, drawn, whole_text
from wakeline.session import saved

SAMPLE_DOCS, SAMPLE_CHARS = 400, 8000
FEATURES = 1 << 13
#: A template confirms a family if the paragraph holds this share of its word pairs.
LEAST_SIMILARITY = 0.5

#: Notices by which public licences are commonly stated, sentence by sentence, and their public identifiers.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
                   "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "mit": ("Released under the MIT License.", "This software is licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    "isc": ("Licensed under the ISC License.", "Released under the terms of the ISC license.", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Released under the GPL version 2 only.", "Licensed under GPLv2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GPL version 3 or later.", "Licensed under GPLv3.", "SPDX-License-Identifier: GPL-3.0-or-later",
                "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is released under the LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
             "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later",
                 "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    "bsd": ("Licensed under a BSD-style license.", "Distributed under the BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "bsd-2-clause": ("Distributed under the 2-clause BSD license.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the Simplified BSD License."),
    "bsd-3-clause": ("Licensed under the BSD 3-Clause License.", "Distributed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "epl-2.0": ("Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    "unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc0": ("Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "No part of this work may be reproduced without the written permission of the publisher.",
                    "This document is confidential and proprietary; unauthorized copying is prohibited."),
    "unknown": ("Use of this source code is governed by a license that can be found in the LICENSE file.", "See the license for details.",
                "Distributed under the terms of the project license.", "Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: LicenseRef-Vendor",
                "This software is subject to the licence agreement of its vendor.", "The use of this material is subject to the license terms."),
    "none": ("The driver renewed his license at the office.", "Version 2.0 of the report was released on Monday.", "The public may visit the reserved seats.",
             "They asked for permission to work late.", "A general in the free world wrote the foundation of the law.", "The commons were open and the rights of way were kept."),
}
FAMILIES = tuple(k for k in TEMPLATES if k not in ("unknown", "none"))
CLASSES = tuple(TEMPLATES)
#: Families that say less than another one that the same paragraph names.
GENERAL = {"bsd": ("bsd-2-clause", "bsd-3-clause")}
#: Ordinary words around a template in the examples.
AROUND = 64
#: What separates paragraphs.
BLANK_LINES = r"\n(?:[\x20\x09-\x0D]*\n)+"
_TRIGGERS = "licen|copyright|reserved|permission|redistribut|permitted|public domain|proprietary|spdx"


@dataclass(frozen=True)
class LicenceModel:
    features: PipelineModel
    scorer: object
    temperature: float
    least: float


def _paragraphs(text: Column) -> Column:
    """The runs of lines between blank ones."""
    return F.filter(F.split(text, BLANK_LINES), lambda p: F.btrim(p, F.lit(BLANKS)) != "")


def _word_list(line: Column) -> Column:
    """Lower-cased words of letters and digits."""
    bare = F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _plain(template: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in template.lower()).split()


#: Words of a piece: those of the longest template and the words around it. Pieces overlap by the longest template.
PIECE = AROUND + max(len(_plain(t)) for of in TEMPLATES.values() for t in of)


def _pieces(words: Column) -> Column:
    """The words of a line in overlapping pieces; a line of at most ``PIECE`` words is one."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (PIECE - AROUND)), F.lit(AROUND))
    return F.when(F.size(words) <= PIECE, F.array(words)).otherwise(F.transform(starts, lambda i: F.slice(words, i, PIECE)))


def _pairs(words: Column) -> Column:
    """Two-word sequences; a single word stands for itself."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(words)


def _variants(words: list[str], ordinary: list[str]) -> list[list[str]]:
    """A template whole, cut, with a word left out, and between ordinary words."""
    n = len(words)
    found = [words] + [words[i:] for i in (1, 2, 3) if n - i >= 4] + [words[:-i] for i in (1, 2, 3) if n - i >= 4]
    found += [words[:i] + words[i + 1:] for i in range(n) if n >= 6]
    for i in range(0, max(0, len(ordinary) - AROUND), AROUND):
        before = (8, AROUND // 2, AROUND - 4)[i // AROUND % 3]  # near the front, in the middle, near the end
        found.append(ordinary[i:i + before] + words + ordinary[i + before:i + AROUND])
    return found


def _examples(spark: SparkSession, paragraphs: DataFrame) -> DataFrame:
    """words, label and whether the example is held out for calibration."""
    plain = paragraphs.filter(~F.lower("line").rlike(_TRIGGERS)).select(F.explode(_pieces(_word_list(F.col("line")))).alias("words")).filter(F.size("words") > 0)
    # at most 20 paragraphs of bounded length reach the driver, as ordinary words around the templates
    around = [w for r in plain.orderBy(F.xxhash64("words"), "words").limit(20).collect() for w in r["words"][:40]]
    rows = []
    for label, (name, templates) in enumerate(TEMPLATES.items()):
        for template in templates:
            rows += [(v, float(label), i % 4 == 3) for i, v in enumerate(_variants(_plain(template), around))]
    made = spark.createDataFrame(rows, "words array<string>, label double, held boolean")
    none = plain.select("words", F.lit(float(CLASSES.index("none"))).alias("label"), (F.pmod(F.xxhash64("words"), F.lit(4)) == 3).alias("held"))
    return made.unionByName(none)


def _rank(words: DataFrame, model: LicenceModel) -> DataFrame:
    """Adds ``family`` (class named by the classifier) and its calibrated ``probability``."""
    scored = model.scorer.transform(model.features.transform(words)).withColumn("_raw", vector_to_array("rawPrediction"))
    top = F.array_max("_raw")
    total = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + F.exp((x - top) / model.temperature))
    names = F.array(*[F.lit(c) for c in CLASSES])
    return scored.withColumns({"family": F.get(names, (F.array_position("_raw", top) - 1).cast("int")), "probability": 1.0 / total}).drop(
        "_raw", "rawPrediction", "probabilities", "prediction", "pairs", "f1", "f2", "features")


def train(docs: DataFrame) -> LicenceModel:
    """The classifier, with ordinary paragraphs from a bounded sample of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    small = drawn(docs.select("doc_id", F.col("text").cast("string").alias("text")), SAMPLE_DOCS).filter(F.length("text") <= SAMPLE_CHARS)
    paragraphs = saved(small.select(F.explode(_paragraphs(F.col("text"))).alias("line")), "sample")
    examples = saved(_examples(spark, paragraphs).coalesce(1), "examples")
    features = Pipeline(stages=[NGram(n=2, inputCol="words", outputCol="pairs"), HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="f1"),
                                HashingTF(numFeatures=FEATURES, binary=True, inputCol="pairs", outputCol="f2"),
                                VectorAssembler(inputCols=["f1", "f2"], outputCol="features")]).fit(examples)
    learner = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, standardization=False, probabilityCol="probabilities")
    weighed = examples.filter("not held").join(F.broadcast(examples.filter("not held").groupBy("label").agg((1000.0 / F.count("*")).alias("weight"))), "label")
    scorer = learner.setWeightCol("weight").fit(features.transform(weighed).orderBy("label", "words").coalesce(1))
    return _calibrated(LicenceModel(features, scorer, 1.0, 0.0), examples.filter("held"))


def _calibrated(model: LicenceModel, held: DataFrame) -> LicenceModel:
    """Temperature of least log loss on the held-out examples, and the probability that one true family in fifty falls below."""
    rows = model.scorer.transform(model.features.transform(held)).select("label", vector_to_array("rawPrediction").alias("raw"), "words").orderBy("label", "words").collect()
    # a family weighs as much as ordinary text, however many paragraphs the sample has
    n = {c: sum(r["label"] == c for r in rows) for c in {r["label"] for r in rows}}

    def chances(raw: list[float], t: float) -> list[float]:
        top = max(raw)
        e = [math.exp((x - top) / t) for x in raw]
        return [x / sum(e) for x in e]

    def loss(t: float) -> float:
        return -sum(math.log(max(1e-12, chances(r["raw"], t)[int(r["label"])])) / n[r["label"]] for r in rows)

    best = min((0.25 * 1.2 ** i for i in range(20)), key=loss)
    right = sorted(chances(r["raw"], best)[int(r["label"])] for r in rows if CLASSES[int(r["label"])] in FAMILIES)
    return replace(model, temperature=best, least=min(0.5, right[len(right) // 50]) if right else 0.5)


def findings(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """doc_id, h (hash of the text), place of the paragraph, ``family`` or unknown, probability and similarity of every finding.

    A paragraph in which several pieces name families has a row for each of them, with the highest values; it
    is unknown only if no piece names one.
    """
    spark = docs.sparkSession
    text = whole_text(F.col("text").cast("string"))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.posexplode(_paragraphs(text)).alias("place", "line"))
    rows = lines.select("doc_id", "h", "place", _word_list(F.col("line")).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("words", F.explode(_pieces(F.col("words"))))
    ranked = _rank(rows, model).filter("family <> 'none'")
    known = [(name, _plain(t)) for name in FAMILIES for t in TEMPLATES[name]]
    # one row a template, fixed: its pairs, those that few families use counting more
    near = F.broadcast(spark.createDataFrame(_weighed(known), "family string, templates array<map<string, double>>"))
    # a general family's piece may hold the clause of a special one too, which only its template can show
    special = F.lit(None).cast("array<string>")
    for general, more in GENERAL.items():
        special = F.when(F.col("family") == general, F.array(*[F.lit(x) for x in more])).otherwise(special)
    tried = ranked.withColumn("tried", F.explode(F.concat(F.array("family"), F.coalesce(special, F.array().cast("array<string>")))))
    tried = tried.withColumns({"extra": F.col("tried") != F.col("family"), "family": F.col("tried")}).drop("tried")
    joined = tried.withColumn("own", F.array_distinct(_pairs(F.col("words")))).join(near, "family", "left")
    share = F.transform("templates", lambda t: F.aggregate("own", F.lit(0.0), lambda a, pair: a + F.coalesce(F.try_element_at(t, pair), F.lit(0.0))))
    out = joined.withColumn("similarity", F.least(F.lit(1.0), F.coalesce(F.array_max(share), F.lit(0.0)))).filter(~F.col("extra") | (F.col("similarity") >= LEAST_SIMILARITY))
    sure = (F.col("similarity") >= LEAST_SIMILARITY) & (F.col("probability") >= model.least)
    best = [F.max(c).alias(c) for c in ("probability", "similarity")]
    out = out.withColumn("sure", sure).groupBy("doc_id", "h", "place", F.col("family").alias("named")).agg(
        F.max("sure").alias("sure"), *[F.coalesce(F.max(F.when(F.col("sure"), F.col(c))), F.max(c)).alias(c) for c in ("probability", "similarity")])
    out = out.groupBy("doc_id", "h", "place", F.when(F.col("sure"), F.col("named")).otherwise("unknown").alias("family")).agg(*best)
    # pieces of one paragraph: at most its number of families, whatever its length
    whole = out.groupBy("doc_id", "h", "place").agg(F.collect_list(F.struct("family", "probability", "similarity")).alias("found"), F.collect_set("family").alias("names"))
    less = F.lit(False)
    for general, special in GENERAL.items():
        less = less | ((F.col("f.family") == general) & F.arrays_overlap("names", F.array(*[F.lit(x) for x in special])))
    named = F.size(F.array_remove("names", "unknown")) > 0
    return whole.select("doc_id", "h", "place", "names", F.explode("found").alias("f")).filter(~less & ~(named & (F.col("f.family") == "unknown"))).select("doc_id", "h", "place", "f.*")


def _weighed(known: list[tuple[str, list[str]]]) -> list[tuple[str, list[dict[str, float]]]]:
    """For each family the pairs of its templates with weights that add up to 1; a pair of n families weighs 1/n^2 of a family's own."""
    pairs = [(name, set(map(" ".join, zip(t, t[1:]))) or set(t)) for name, t in known]
    used = Counter(pair for pair, _ in {(p, name) for name, of in pairs for p in of})
    out: dict[str, list[dict[str, float]]] = {}
    for name, of in pairs:
        total = sum(1 / used[p] ** 2 for p in of)
        out.setdefault(name, []).append({p: 1 / used[p] ** 2 / total for p in sorted(of)})
    return list(out.items())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, n_unknown and ``families`` (sorted names) of every document."""
    found = saved(findings(docs, train(docs)), "licences")
    lines = found.groupBy("doc_id", "h", "place").agg(F.collect_set("family").alias("named"))
    per = lines.groupBy(F.col("doc_id").alias("_of"), F.col("h").alias("_h")).agg(
        F.count("*").alias("n_licences"), F.count_if(F.array_contains("named", "unknown")).alias("n_unknown"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("named")))).alias("families"))
    text = whole_text(F.col("text").cast("string"))
    n = F.size(_paragraphs(text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), n.cast("long").alias("n_paragraphs"))
    out = rows.join(per, rows["doc_id"].eqNullSafe(F.col("_of")) & (rows["h"] == F.col("_h")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licences", zero).alias("n_licences"), F.coalesce("n_unknown", zero).alias("n_unknown"),
                      F.coalesce("families", F.array().cast("array<string>")).alias("families"))
