import re

import pytest
from pyspark.sql import functions as F

from wakeline.llm import curriculum as C

from .conftest import odd_texts


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights, most=3):
    """Share all words by weight; a source over its cap stops there and the rest is shared again."""
    left, open_, out = sum(sizes.values()), {s for s in sizes if weights[s] > 0}, dict.fromkeys(sizes, 0.0)
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > most * sizes[s]}
        for s in over or open_:
            out[s] = most * sizes[s] if over else level * weights[s]
        left -= sum(out[s] for s in over)
        open_ = open_ - over if over else set()
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(d, t, [None, "", "a", "b", "Z", "é", "tiny"][i % 7 if i % 11 else 6]) for i, (d, t) in enumerate(odd_texts())]
    docs = spark.createDataFrame([(d, t, s, 1, "l", 2.0) for d, t, s in rows], "doc_id long, text string, source string, size int, lot string, target double").cache()
    return rows, docs, C.mix(docs, C.ranked_schedule(docs)).collect()


def test_targets_follow_weights_and_caps(mixed):
    rows, _, got = mixed
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = {s: sum(size(t) for _, t, own in rows if own == s) for s in names}
    want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    assert {r.source: r.source_size for r in got} == sizes
    for r in got:
        assert r.target == pytest.approx(want[r.source])
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(sizes.values()))
    assert sum(len(names) > 0 for _ in got) == len(rows)


def test_taken_words_come_near_the_target(mixed):
    rows, _, got = mixed
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
    assert all(r.taken == r.size * r.copies and (r.size == 0 or r.copies <= 3) and len(r.times) == r.copies for r in got)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), size(t)) for d, t, _ in rows)


def test_times_rise_with_demand(mixed):
    for r in mixed[2]:
        assert list(r.times) == sorted(r.times) and all(0 <= t <= 1 for t in r.times)


def test_schedules_shape_the_training(spark):
    """Two sources of equal size: one fades out, one comes in; the share of words over time follows the curve."""
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    schedule = spark.createDataFrame([("a", 0.0, 2.0), ("a", 0.5, 0.0), ("a", 1.0, 0.0), ("b", 0.0, 0.0), ("b", 1.0, 1.0)], "source string, t double, weight double")
    got = C.mix(docs, schedule).collect()
    assert {r.source: r.target for r in got} == {"a": 20000.0, "b": 20000.0}
    for source, read in (("a", lambda t: 1 - (1 - min(t, 0.5) / 0.5) ** 2), ("b", lambda t: t * t)):
        times = [t for r in got if r.source == source for t in r.times]
        assert len(times) == 2000
        for t in (0.1, 0.25, 0.5, 0.8):
            assert sum(x < t for x in times) / 2000 == pytest.approx(read(t), abs=0.002)
    none = C.mix(docs, schedule.filter("source = 'a'")).collect()
    assert {r.source: (r.target, r.taken > 0) for r in none if r.source == "b"} == {"b": (0.0, False)}


def test_small_documents_level_out_large_ones(spark, monkeypatch):
    rows = [(i, "x " * (900 if i < 3 else 1 + i % 5), "s") for i in range(3000)] + [(5000 + i, "y " * 7, "t") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(C, "LARGE_SHARE", 0.01)
    got = C.mix(docs, C.ranked_schedule(docs)).collect()
    for source, most in (("s", 5), ("t", 7)):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= most / 2


def test_reruns_and_partitions_agree(mixed, spark):
    _, docs, got = mixed
    again = C.mix(docs.repartition(7), C.ranked_schedule(docs)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_stream_is_the_training_order(mixed):
    rows, docs, got = mixed
    out = C.stream(docs, C.mix(docs, C.ranked_schedule(docs))).collect()
    assert [r.time for r in out] == sorted(t for r in got for t in r.times)
    assert sum(size(r.text) for r in out) == sum(r.taken for r in got)


def test_empty_table(no_documents):
    docs = no_documents.withColumn("source", F.lit("s"))
    assert C.mix(docs, C.ranked_schedule(docs)).count() == 0
