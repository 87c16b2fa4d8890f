import random
import zlib

import pytest

from wakeline.llm import toxicity as T

BAD = ["vileword", "nastyterm", "awfulone", "badstem"]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    syllables = ["an", "the", "ou", "ti", "on", "er", "sh", "re", "in", "ed", "li", "mo"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(1200):
        w = [word() for _ in range(rnd.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3 + len(w) // 30):
                w.insert(rnd.randint(0, len(w)), rnd.choice(BAD))
        rows.append((i, " ".join(w), "label"))
        if i % 10 != 9:
            labels.append((i, int(toxic), 1))
    labels += [(5000, 1, 0), (None, 1, 0), (3, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    scored = {r.doc_id: r for r in T.score(docs, T.train(docs, labels)).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [scored[i].predicted == (i % 6 == 0) for i in held]
    assert len(held) > 200 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())
    kept = {r.doc_id for r in T.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in scored.items() if not r.predicted}


def test_held_out_labels_are_never_read(spark, corpus):
    docs, labels = corpus
    other = labels.withColumn("toxic", T.F.when(T.held_out(), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    assert T.train(docs, labels) == T.train(docs, other)


def test_odd_texts_and_missing_labels(spark, corpus, odd, no_documents):
    docs, labels = corpus
    model = T.train(docs, labels)
    assert T.score(odd, model).filter("score between 0 and 1").count() == odd.count()
    assert T.score(no_documents, model).count() == 0
    none = labels.limit(0)
    assert T.train(docs, none).prior == 0 and T.score(docs.limit(3), T.train(docs, none)).filter("score = 0").count() == 3
    one = T.train(docs, labels.filter("toxic = 1"))
    assert one.weights == () and one.prior == 1
    assert T.drop_toxic(odd, none).columns == odd.columns


def test_of_two_labels_the_smaller_counts(corpus):
    """Conflicting and repeated labels train the model that the smallest of them would."""
    docs, labels = corpus
    both = labels.unionByName(labels.filter("doc_id % 60 = 0").withColumn("toxic", T.F.lit(0))).unionByName(labels.filter("doc_id % 7 = 0"))
    plain = labels.withColumn("toxic", T.F.when(T.F.col("doc_id") % 60 == 0, 0).otherwise(T.F.col("toxic")))
    assert T.train(docs, both.repartition(5)) == T.train(docs, plain)


def test_rows_are_judged_by_their_own_text(spark, corpus):
    """Of two rows with one doc_id the toxic one goes; rows without id are judged too, and all columns come through."""
    docs, labels = corpus
    marked = T.score(docs, T.train(docs, labels)).join(docs.select("doc_id", "text"), "doc_id")
    bad, good = (marked.filter(f"predicted = {c} and length(text) > 500").orderBy("doc_id").first().text for c in (1, 0))
    rows = [(7001, bad, 1.5, [1, 2], "a"), (7001, good, None, None, "b"), (None, bad, 2.5, [], "c"), (None, good, 0.0, [3], "d"), (7002, good, 0.0, [3], "e")]
    more = spark.createDataFrame(rows, "doc_id long, text string, score double, c0 array<int>, predicted string")
    whole = docs.select("doc_id", "text").withColumns({"score": T.F.lit(None).cast("double"), "c0": T.F.lit(None).cast("array<int>"), "predicted": T.F.lit("z")}).unionByName(more)
    out = T.drop_toxic(whole, labels)
    assert out.columns == whole.columns and out.dtypes == whole.dtypes
    got = {r.predicted: r for r in out.filter("predicted <> 'z'").collect()}
    assert set(got) == {"b", "d", "e"} and got["d"].c0 == [3] and got["b"].score is None
