import random
import re
import textwrap

import pytest

from wakeline.llm import licences as L

from .conftest import odd_texts


@pytest.fixture(scope="module")
def model(odd):
    return L.train(odd)


def test_notices_are_named_and_others_unknown(spark, odd, model):
    notices = [(name, t) for name in L.FAMILIES for t in L.TEMPLATES[name]]
    rows = [(i, f"plain words before it\n\n{t} Extra words here.\n \nand after") for i, (_, t) in enumerate(notices)]
    rows += [(100, "Licensed under the Foo Bar Public Licence 7"), (101, None), (102, " \n "), (None, notices[0][1]), (103, notices[0][1]), (103, notices[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = L.findings(docs, model).collect()
    assert len(found) == len({(r.doc_id, r.place, r.family) for r in found})
    named = {(r.doc_id, r.place): r.family for r in found}
    right = [named.get((i, 1)) == name for i, (name, _) in enumerate(notices)]
    assert sum(right) >= 0.9 * len(right)
    assert named.get((100, 0), "unknown") == "unknown" and not {101, 102} & {d for d, _ in named}
    assert all(0 < r.probability <= 1 and 0 <= r.similarity <= 1 for r in found)


def test_ordinary_text_is_left_alone(spark, odd, model):
    assert L.findings(odd, model).count() == 0


def test_scan_counts(spark, odd, no_documents):
    out = L.scan(odd.unionByName(odd.limit(1).selectExpr("900L AS doc_id", "'x y z\n \nAll rights reserved.' AS text", "label", "key", "score", "n"))).collect()
    assert len(out) == len(odd_texts()) + 1
    last = next(r for r in out if r.doc_id == 900)
    assert (last.n_paragraphs, last.n_licences, list(last.families)) == (2, 1, ["proprietary"])
    assert L.scan(no_documents).count() == 0


def test_main_path_runs_no_python(odd, model):
    plan = L.findings(odd, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_notices_in_long_lines_are_found(spark, odd, model):
    rnd = random.Random(5)
    ordinary = lambda n: " ".join(f"w{rnd.randrange(300)}" for _ in range(n))
    notices = [(name, t) for name in L.FAMILIES for t in L.TEMPLATES[name]]
    rows = [(i, f"{ordinary(800 + 7 * i)} {t} {ordinary(5 * i)}") for i, (_, t) in enumerate(notices)]
    rows += [(100, f"{ordinary(300)} Licensed under the Mozilla Public License 2.0. {ordinary(300)} Released under the MIT License."), (101, ordinary(3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.family) for r in L.findings(docs, model).collect()}
    assert sum((i, name) in found for i, (name, _) in enumerate(notices)) >= 0.9 * len(notices)
    assert {(100, "mit"), (100, "mpl-2.0")} <= found and 101 not in {d for d, _ in found}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
CASES = {
    "mit": [MIT, "SPDX-License-Identifier: MIT", "This software is licensed under the MIT License."], "bsd": [BSD], "bsd-3-clause": [BSD + " " + ENDORSE, "SPDX-License-Identifier: BSD-3-Clause"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1."], "isc": ["Licensed under the ISC License."],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3."], "apache-2.0": ["SPDX-License-Identifier: Apache-2.0"], "epl-2.0": ["Licensed under the Eclipse Public License 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


@pytest.mark.parametrize("width", [None, 76, "five words"])
def test_wrapped_notices_are_one_finding(spark, odd, model, width):
    """However a notice is broken into lines, with comment signs or without, it is one finding of its family."""
    def wrapped(text):
        words = text.split()
        lines = [" ".join(words)] if width is None else textwrap.wrap(" ".join(words), width) if width == 76 else [" ".join(words[i:i + 5]) for i in range(0, len(words), 5)]
        return "\n".join(" * " + line for line in lines)

    cases = [(name, t) for name, of in CASES.items() for t in of]
    docs = spark.createDataFrame([(i, "some words of the file\n\n" + wrapped(t) + "\n\nmore words of the file") for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    found = {}
    for r in L.findings(docs, model).collect():
        found.setdefault(r.doc_id, []).append((r.place, r.family))
    assert {i: found.get(i) for i in range(len(cases))} == {i: [(1, name)] for i, (name, _) in enumerate(cases)}


def test_scores_equal_a_plain_sum(spark, odd, model):
    """The classifier's verdicts, recomputed from its weights and hashed words one by one."""
    import math

    words = [L._plain(t)[:L.PIECE] for of in L.TEMPLATES.values() for t in of] + [["w1", "data", "the", "license"]]
    got = L._rank(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, words array<string>"), model).select("i", "family", "probability").collect()
    stages = model.features.stages
    weights, bias = model.scorer.coefficientMatrix.toArray(), model.scorer.interceptVector.toArray()
    for r in got:
        own = words[r.i]
        at = {stages[1].indexOf(w) for w in own} | {L.FEATURES + stages[2].indexOf(f"{a} {b}") for a, b in zip(own, own[1:])}
        raw = [bias[c] + sum(weights[c, j] for j in at) for c in range(len(L.CLASSES))]
        top = max(raw)
        assert r.family == L.CLASSES[raw.index(top)]
        assert r.probability == pytest.approx(1 / sum(math.exp((x - top) / model.temperature) for x in raw), rel=1e-6)
