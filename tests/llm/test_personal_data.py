import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wakeline.llm import personal_data as P

from .conftest import odd_texts

digits = lambda s: re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, digits(s)[::-1]))) % 10 == 0


FORMS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(s)),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15))
TEXTS = ["a@b.c_d@e.f +1 (2) 3456789", "1.2.3.4.5.6.7.8 999.1.1.1 00000000000256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111 1", "\u0001a@b.cc é 😀 x@y.zz",
         "++12 3456789012 +1", "1" * 5000, "5500005555555559 5500005555555559", "+123456789 +123456789 - 12", "@a.b a@.b a@b..c a@b-.c-", "1 2 3 4 5 6 7 8 9 " * 500,
         "4111111111111111.4.4.4", "4111111111111111 - 4111111111111111", "call +1.2.3.4 now 12345678901234567890"]


@pytest.fixture(scope="module")
def found(spark, odd):
    rows = [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(2000, "IBAN DE89370400440532013000 and DE00370400440532013000"), (2001, "Mr. John Smith, ssn 078-05-1120 or 000-05-1120"),
                                                           (2002, "a" * 50_000 + "@")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    return rows, P.scan(docs).collect()


def test_base_spans_equal_plain_expressions(found):
    texts = {}
    for d, t in odd_texts() + found[0]:
        texts.setdefault(d, []).append(t or "")
    got = {}
    for r in found[1]:
        got.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.found if s.kind in P.BASE])
    assert got.keys() == texts.keys()
    for d, many in texts.items():
        want = [[] if len(t) > 50_000 and "@" in t[-1:] else [(k, *m.span()) for k, p, ok in FORMS for m in re.finditer(p, t) if ok(m[0])] for t in many]
        assert sorted(got[d]) == sorted(want), many[0][:80]


def test_method_adds_spans(found):
    kinds = {r.doc_id: [s.kind for s in r.found] for r in found[1]}
    assert "iban" in kinds[2000] and "name" in kinds[2001] and "ssn" in kinds[2001]


def test_expectation_maximisation_trusts_the_better_labeler():
    # labelers 0 and 1 agree, labeler 2 votes at random, labeler 3 is silent
    patterns = [("name", (1, 1, 1, 0), 50), ("name", (1, 1, -1, 0), 50), ("name", (-1, -1, 1, 0), 50), ("name", (-1, -1, -1, 0), 50)]
    trust = P.estimate(patterns)
    p = [trust.probability(kind, v) for kind, v, _ in patterns]
    assert min(p[:2]) > 0.75 and max(p[2:]) < 0.1
    weight = lambda i: math.log(trust.chance["name", i][0][2] / trust.chance["name", i][1][2])
    assert weight(2) < min(weight(0), weight(1))


def test_one_sided_data_teach_no_blind_trust():
    """Candidates that are all good say nothing on what makes a bad one."""
    trust = P.estimate([("card", (1, 1, 1, 1), 5000), ("card", (1, 1, 0, 1), 5000)])
    assert trust.probability("card", (1, 1, 0, 1)) > 0.95 > 0.2 > trust.probability("card", (-1, 0, 0, 1))
    assert trust.probability("iban", (-1, 1, 1, 1)) < 0.2 < 0.8 < trust.probability("iban", (1, 1, 0, 1))


def planted(seed, n):
    """(text, start, end, true) of candidates whose truth is known, in varied company."""
    rnd, rows = random.Random(seed), []
    number = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def iban(good):
        body = "3704" + number(14)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{(check if good else (check + 1) % 97):02d}{body}"

    def card(good):
        body = rnd.choice("45") + number(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)) == good)

    for _ in range(n):
        good = rnd.random() < 0.5
        kind = rnd.choice(["iban", "card", "ssn", "name"])
        if kind in ("iban", "card"):
            value, cue = (iban if kind == "iban" else card)(good), rnd.choice(["", "", "account ", "card ", "see "])
        elif kind == "ssn":
            value, cue = f"{rnd.randint(100, 600)}-{rnd.randint(10, 99)}-{number(3)}7", rnd.choice(["ssn ", "social "] if good else ["order ", "serial ", "version ", "on "])
        else:
            value, cue = rnd.choice(["Mr. John Smith", "Dr. Anna Weber", "Mrs. Mary Stone"] if good else ["Dr. Big Mac", "Mr. Zip Fast", "Ms. Red Tower"]), rnd.choice(["", "with "])
        before = rnd.choice(["We heard that ", "Then, as before, ", "It is "]) + cue
        rows.append((before + value + " came up.", len(before), len(before) + len(value), good))
    return rows


def test_classifier_beats_the_majority_vote_on_held_out_candidates(spark):
    rows = planted(1, 600) + planted(2, 400)
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    model = P.train(P.candidates(docs.filter("doc_id < 600")))
    spans = P.candidates(docs.filter("doc_id >= 600")).select("doc_id", F.explode("found").alias("s"))
    scored = spans.select("doc_id", "s.start", "s.end", model.score(F.col("s")).alias("p"), sum(P.votes(F.col("s")).values()).alias("yes")).collect()
    scored = [r for r in scored if (r.start, r.end) == rows[r.doc_id][1:3]]
    assert len(scored) == 400
    loss = lambda p, good: -math.log(max(1e-6, p if good else 1 - p))
    ours = sum(loss(r.p, rows[r.doc_id][3]) for r in scored) / 400
    vote = sum(loss(min(0.95, max(0.05, 0.5 + r.yes / 8)), rows[r.doc_id][3]) for r in scored) / 400
    assert ours < 0.3 and ours < 0.7 * vote
    assert sum((r.p >= 0.5) == rows[r.doc_id][3] for r in scored) >= 380


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="supplied tables are not here")
def test_a_model_of_the_supplied_texts_can_say_no(spark):
    texts = {"IBAN DE89370400440532013000": 1, "IBAN DE00370400440532013000": 0, "ssn 078-05-1120": 1, "000-00-0000": 0, "serial 123-45-6789": 0, "Mr. John Smith": 1, "Dr. Big Mac": 0}
    model = P.train(P.saved(P.candidates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), "candidates"))
    assert max(map(abs, model.weights.values())) > 1
    found = P.candidates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.doc_id: r.p for r in found.select("doc_id", F.explode("found").alias("s")).filter("not s.kind in ('card', 'phone')").select("doc_id", model.score(F.col("s")).alias("p")).collect()}
    assert {t: int(got[i] >= 0.5) for i, t in enumerate(texts)} == texts


def test_no_candidates_and_no_rows(spark, no_documents):
    assert P.scan(no_documents).count() == 0
    assert P.scan(spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")).collect()[0].found == []


def test_main_path_runs_no_python(odd):
    plan = P.candidates(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
