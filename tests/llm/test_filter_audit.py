import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from wakeline.llm import filter_audit as A

from .conftest import odd_texts

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """Per row the letters of the filters that it fails."""
    first = {}
    for d, t in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    out = []
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and t in first and first[t] < d}
        out.append({k for k, bad in found.items() if bad})
    return out


def brute(rows, parts, labels):
    bad, out = fails(rows), set()
    for part in {p or "" for p in parts}:
        own = [(rows[i][0], bad[i]) for i in range(len(rows)) if (parts[i] or "") == part]
        lines, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [d for d, b in own if f in b and not b & before]
                shapley[f] += len(gone)
                lines.append((part, "".join(order), step, sum(not b & (before | {f}) for _, b in own), len(gone), sum(f in b and bool(b & before) for _, b in own),
                              sum(b == {f} for _, b in own), sum(labels.get(d, (0, 0))[0] for d in gone), sum(labels.get(d, (0, 0))[1] for d in gone)))
        out |= {(*line, shapley[line[1][line[2] - 1]]) for line in lines}
    return out


@pytest.fixture(scope="module")
def audited(spark):
    rows = odd_texts()
    parts = [None if i % 5 == 0 else "" if i % 5 == 1 else f"s{i % 3}" for i in range(len(rows))]
    table = spark.createDataFrame([(d, t, p, "x", 1, "y", True) for (d, t), p in zip(rows, parts)],
                                  "doc_id long, text string, source string, part string, id int, _copy string, row boolean")
    said = {i: (int(i % 2), int(i % 3 == 0)) for i in range(0, 210, 2)}
    # 4 is labelled twice: either row counts; a label without id belongs to nobody
    labels = spark.createDataFrame([(d, q, t, "e") for d, (q, t) in said.items()] + [(4, 1, 0, "e"), (None, 1, 1, "e"), (300, 1, 1, "e")], "doc_id long, quality int, toxic int, part string")
    said[4] = (1, said[4][1])
    return table, labels, brute(rows, parts, said)


def test_every_order_equals_brute_force(audited):
    docs, labels, want = audited
    filters = A.text_filters()
    got = A.audit(A.marked(docs, filters), list(filters), labels).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_other_filters_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc"), (4, None)], "doc_id long, text string")
    filters = {"short": F.length("text") < 2, "odd": F.length("text") % 2 == 1, "unknown": F.lit(None).cast("boolean")}
    got = {(r.filter_order, r.step): r for r in A.audit(A.marked(docs.withColumn("source", F.lit("s")), filters), list(filters)).collect()}
    assert len(got) == 18
    first = got["shortoddunknown", 1]
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.good_lost) == (2, 2, 0, 1, 0)
    second = got["shortoddunknown", 2]
    assert (second.kept, second.removed, second.redundant, second.unique_fails) == (1, 1, 1, 1)
    assert got["shortoddunknown", 3].removed == 0 and got["shortoddunknown", 3].kept == 1


def test_empty_table(no_documents):
    filters = A.text_filters()
    assert A.audit(A.marked(no_documents.withColumn("source", F.lit("s")), filters), list(filters)).count() == 0
