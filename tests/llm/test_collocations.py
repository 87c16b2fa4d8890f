import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wakeline.llm import collocations as P

from .conftest import UPPER, odd_texts

FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def counted(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    return f, n


def brute(rows, rule):
    f, n = counted(rows, rule.longest)
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= rule.support}
    out = {}
    for (lang, w), a in found.items():
        if any(own == lang and len(v) > len(w) and 100 * b >= rule.cover_percent * a and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (own, v), b in found.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:rule.most], 1)}


def corpus():
    rnd = random.Random(5)
    common = "the old man of the sea went to New York city and came back from the new york city".split()
    rows = [(["en", "de", None][i % 3], t) for i, (_, t) in enumerate(odd_texts())]
    for i in range(150):
        w = [rnd.choice(common) for _ in range(rnd.randint(0, 30))]
        rows.append((["en", "en", "und", "é"][i % 4], "".join(x + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for x in w) + "of the Sea " * (i % 4)))
    return rows


@pytest.mark.parametrize("rule", [P.Mining(), P.Mining(support=6, shards=3, most=40), P.Mining(support=3, shards=1, cover_percent=80)])
def test_phrases_equal_brute_force(spark, rule):
    rows = corpus()
    docs = spark.createDataFrame([(x, t, 1, "p", 2) for x, t in rows], "lang string, text string, a int, phrase string, n int").repartition(5)
    got = {tuple(r[c] for c in FIELDS) for r in P.collocations(docs, rule).collect()}
    want = brute(rows, rule)
    assert len(want) > 10 and got == want


def test_full_bitmap_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_BITS", 1 << 16)
    monkeypatch.setattr(P, "MOST_BITS", 1 << 16)
    rows = [("x", " ".join(f"w{i % 97}" for i in range(s, s + 4000, 1 + s))) for s in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {tuple(r[c] for c in FIELDS) for r in P.collocations(docs).collect()}
    assert got == brute(rows, P.Mining())


def test_shards_lose_no_frequent_phrase(spark):
    rows = [("en", f"rare pair {i}") for i in range(10)] + [("en", f"rare couple {i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert [r.phrase for r in P.collocations(docs).collect()] == ["rare pair"]


def test_long_texts_are_read_in_windows(monkeypatch):
    """Windows of a few bytes give the words and phrases of whole texts."""
    texts = [t for _, t in corpus() if t] + ["", "a" * 500, "one two, " * 200, "no end here " * 50]
    monkeypatch.setattr(P, "WINDOW_BYTES", 64)
    batch = pa.record_batch([pa.array(["x"] * len(texts)), pa.array(np.zeros(len(texts), np.int32)), pa.array(texts)], ["lang", "shard", "text"])
    got = Counter()
    for lang, _, data, begins in P.windows(batch):
        w = P.Words(lang, data, begins)
        for n in (1, 2, 3):
            got.update(w.strings(w.phrases(n)[0], n).to_pylist())
    f, _ = counted([("x", t) for t in texts], 3)
    assert got == Counter({" ".join(w): c for (_, w), c in f.items()})


class Everything:
    def holds(self, h):
        return np.ones(len(h), bool)


def counted_by_a_task(spark, monkeypatch, batches):
    """For each batch of rows that a task gives out: windows it has read by then, and the rows."""
    tasks, read, windows = [], [], P.windows

    class Texts:
        def mapInArrow(self, task, schema):
            tasks.append(task)
            return spark.createDataFrame([], schema)

    monkeypatch.setattr(P, "windows", lambda batch: (read.append(1) or w for w in windows(batch)))
    monkeypatch.setattr(P, "opened", lambda shared: Everything())
    monkeypatch.setattr(P, "WINDOW_BYTES", 1 << 12)
    monkeypatch.setattr(P, "HELD_BYTES", 1 << 18, raising=False)
    P.exact_counts(Texts(), 3, None)
    given = [(len(read), out.to_pylist()) for out in tasks[0](iter(batches))]
    return given, len(read)


def arrow(rows):
    return pa.record_batch([pa.array([x for x, _ in rows]), pa.array(np.zeros(len(rows), np.int32)), pa.array([t for _, t in rows])], ["lang", "shard", "text"])


def test_counts_held_by_a_task_are_bounded(spark, monkeypatch):
    """Many different phrases leave a task before its batch is read; what it holds doesn't grow with a batch."""
    rows = [(["en", "de"][i % 2], " ".join(f"w{i}x{j}" for j in range(60)) + " of the sea") for i in range(800)]
    given, windows = counted_by_a_task(spark, monkeypatch, [arrow(rows)])
    seen = [0, *sorted({at for at, _ in given})]
    assert windows >= 100 and max(b - a for a, b in zip(seen, seen[1:])) < windows / 4
    f, n = counted(rows, 3)
    want = Counter({(lang, " ".join(w), len(w)): c for (lang, w), c in f.items()}) + Counter({(lang, "", 0): c for lang, c in n.items()})
    got = Counter()
    for r in (r for _, out in given for r in out):
        got[r["lang"], r["phrase"], r["words"]] += r["c"]
    assert got == want


def test_frequent_phrase_is_one_row_of_a_task(spark, monkeypatch):
    """Few phrases are combined over windows and batches, not given out over and over."""
    rows = [("en", "of the sea, of the land. " * 30)] * 400
    given, windows = counted_by_a_task(spark, monkeypatch, [arrow(rows[:250]), arrow(rows[250:])])
    got = [(r["phrase"], r["words"], r["c"]) for _, out in given for r in out]
    f, n = counted(rows, 3)
    assert windows > 50 and sorted(got) == sorted([(" ".join(w), len(w), c) for (_, w), c in f.items()] + [("", 0, n["en"])])


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
