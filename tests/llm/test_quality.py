import re

import pytest
from pyspark.sql import functions as F

from wakeline.llm import quality as Q

from .conftest import odd_texts


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    inside = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed


EXTRA = ["a b c d e a b c d e a b c", "x " * 40, "a b c d e f a b c d e", "\n".join(["same line of words here"] * 4), "*** | <b> & $5 #1 100%\n\n", "THIS IS ALL IN CAPITAL LETTERS AND MUCH TOO LOUD FOR THIS"]


def test_counts_equal_brute_force(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string"))
    got = Q.judge(docs).collect()
    want = sorted((str(d), *brute(t)) for d, t in odd_texts() + [(500 + i, t) for i, t in enumerate(EXTRA)])
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert {r.doc_id for r in got if r.rejected_by == "shouting"} == {505}


def test_order_changes_no_verdict(odd):
    counted = Q.counts(odd)
    verdicts = [{(str(r.doc_id), r.text): r.x is None for r in counted.select("doc_id", "text", Q.rejected_by(rules).alias("x")).collect()} for rules in (Q.RULES, Q.RULES[::-1])]
    assert verdicts[0] == verdicts[1]


def test_useful_rules_come_first(spark):
    docs = spark.createDataFrame([(i, "few words") for i in range(50)], "doc_id long, text string")
    assert {r.name for r in Q.order_rules(Q.counts(docs))[:1]} == {"few_words"}


def test_empty_table_and_no_python(no_documents, odd):
    assert Q.judge(no_documents).count() == 0
    plan = Q.counts(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_counts_alone_equal_counts_together(odd):
    rows = Q.counts(odd.select("doc_id", "text"))
    alone = Q.single_counts()
    got = rows.select(*[F.col(name) for name in alone], *[value.alias(f"own_{name}") for name, value in alone.items()]).collect()
    assert all(r[name] == r[f"own_{name}"] for r in got for name in alone)


@pytest.mark.parametrize("turned", [False, True])
def test_the_lazy_cascade_gives_the_same_verdicts(odd, turned):
    rules = Q.RULES[::-1] if turned else Q.RULES
    judged = Q.counts(odd).withColumn("rejected_by", Q.rejected_by(rules)).select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "rejected_by").collect()
    odd = odd.withColumn("n_words", F.lit("mine"))
    lazy = Q.cascade(odd, rules)
    assert {r.n_words for r in lazy.select("n_words").distinct().collect()} == {"mine"}
    assert lazy.columns == [*odd.columns, "rejected_by", "kept"]
    got = lazy.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "rejected_by").collect()
    assert sorted(map(str, got)) == sorted(map(str, judged))


def test_a_count_is_made_only_for_rows_that_need_it(spark):
    """A rule that would fail on a row is never evaluated behind one that rejects the row."""
    docs = spark.createDataFrame([(1, "short one"), (2, "a b c d e f g h i j k l 12")], "doc_id long, text string")
    rules = [Q.Rule("few_words", "n_words < 10"), Q.Rule("breaks", "n_words > 0 AND assert_true(n_words >= 10) IS NULL AND n_repeat_words < 0")]
    assert {r.doc_id: r.rejected_by for r in Q.cascade(docs, rules).collect()} == {1: "few_words", 2: None}


def test_rules_are_picked_by_what_they_add():
    """Dear counts come late unless they pay, and a count that is there already costs nothing more."""
    dear, cheap, same = Q.Rule("dear", "n_repeat_words > 1"), Q.Rule("cheap", "n_words < 10"), Q.Rule("same", "n_words > 90")
    rows = [((True, True, False), 50), ((True, False, False), 20), ((False, False, True), 10), ((False, False, False), 20)]
    costs = {"n_repeat_words": 1.0, "n_words": 0.3}, {"dear": 0.01, "cheap": 0.01, "same": 0.01}
    assert [r.name for r in Q.picked([dear, cheap, same], rows, *costs)] == ["cheap", "same", "dear"]
    assert [r.name for r in Q.picked([dear, cheap, same], rows, {"n_repeat_words": 0.01, "n_words": 5.0}, costs[1])] == ["dear", "same", "cheap"]
