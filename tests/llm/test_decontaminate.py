import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wakeline.llm import decontaminate as D

ITEM = "If Tom buys 3 apples for 5 eur and sells 3 of them for 9 eur, what does she earn today"


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(10, ITEM), (11, "thing here now"), (12, None), (None, ""), (13, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (14, "wholly other words that stand in no document of this small table at all")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_parameters_change_and_slots_must_agree(spark, bench):
    rows = [(1, "Before it. If Anna buys 7 apples for 12 eur and sells 7 of them for 30 eur, what does she earn today"),
            (2, "If Anna buys 7 apples for 12 eur and sells 8 of them for 30 eur, what does she earn today"),  # 3 stands for 7 and 8
            (3, "IF TOM BUYS 3 APPLES"), (4, None), (5, ""), (6, "some short thing here now, ok"), (7, "20 21 22 23 24 25 26 27 28 29 30 31 32 33"),
            (8, ITEM.replace("apples", "pears")), (None, ITEM), (9, ITEM), (9, ITEM), (20, ITEM[:40]), (21, "long " * 20_000 + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item": F.lit("x"), "hash": F.lit(1)})
    got = defaultdict(list)
    for r in D.mark(docs, bench).collect():
        got[r.doc_id].append(list(r["items"]))
    assert got == {1: [[10]], 2: [[]], 3: [[]], 4: [[]], 5: [[]], 6: [[11]], 7: [[]], 8: [[10]], None: [[10]], 9: [[10], [10]], 20: [[]], 21: [[10]]}
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 7, 20]


def test_units_and_tokens(spark):
    df = spark.createDataFrame([("It weighs 5kg or 1,000.5 Km in Paris, ÉCOLE.",)], "text string").select(D.tokens(F.col("text")).alias("t"), D.values(F.col("text")).alias("v")).first()
    assert df.t == ["it", "weighs", D.NUMBER, D.UNIT, "or", D.NUMBER, D.UNIT, "in", D.NAME, "école"]
    assert df.v == ["It", "weighs", f"{D.NUMBER}5", f"{D.UNIT}kg", "or", f"{D.NUMBER}1,000.5", f"{D.UNIT}Km", "in", f"{D.NAME}Paris", "ÉCOLE"]


def test_supplied_tables_equal_window_counting(spark):
    """Without slots in the supplied texts the method must find the plain runs of words."""
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    windows, size = defaultdict(set), {}
    for r in items.collect():
        w = plain(r.text)
        size[r.item_id] = len(w) - 7
        for k in range(len(w) - 7):
            windows[tuple(w[k:k + 8])].add((r.item_id, k))
    want = defaultdict(set)
    for r in docs.collect():
        w, seen = plain(r.text), Counter()
        for k in range(len(w) - 7):
            seen.update((i, k - j) for i, j in windows.get(tuple(w[k:k + 8]), ()))
        want[r.doc_id] |= {i for (i, _), n in seen.items() if n >= min(6, size[i])}
    got = {r.doc_id: set(r["items"]) for r in D.mark(docs, items).collect()}
    assert got == dict(want) and any(want.values())


def test_empty_tables(spark, no_documents, bench, odd):
    assert D.mark(no_documents, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(odd, none).count() == odd.count()


def test_main_path_runs_no_python(odd, bench):
    plan = D.mark(odd, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def _found(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: list(r["items"]) for r in D.mark(docs, bench).collect()}


def test_what_precedes_a_text_changes_nothing(spark):
    items = ["What is the largest planet in our solar system today?", "What is the oldest bridge?",
             "Tom has 3 red balls. Tom buys 4 more balls. Tom gives 2 to Ann. How many are left?"]
    other = "Eva has 8 red balls. Eva buys 9 more balls. Eva gives 5 to Lea. How many are left?"
    texts = [f"{before}{items[i]} {after}" for i in (0, 1) for before in ("1) ", "He asked, ", "and so on ", "Here: ", "") for after in ("", "And more")]
    texts += [items[0].lower(), "It is in our solar system today", other, f"He said, {other}", other.replace("Eva gives", "Ida gives")]
    got = _found(spark, items, texts)
    assert [got[i] for i in range(20)] == [[0]] * 10 + [[1]] * 10
    assert [got[i] for i in range(20, 25)] == [[0], [], [2], [2], []]


def test_copies_rich_in_numbers_and_names_are_found(spark):
    items = ["Compute 12 + 45 - 7 * 3 / 9.", "Solve 3x + 5 = 20 and 2, 4, 6, 8, 10, 12.", "Sort 14, 3, 9, 27, 81, 5, 60.",
             "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "with Anna, Bert, Carl, Dora, Emil, Fred, Gerd, Hans, Ida"]
    texts = [f"Some words. {i} And more." for i in items]
    texts += ["Compute 13 + 46 - 8 * 4 / 10.", "20 21 22 23 24 25 26 27 28 29 30 31 32 33", "with Nina, Olaf, Paul, Rosa, Sven, Tina, Udo, Vera, Willi"]
    got = _found(spark, items, texts)
    assert [got[i] for i in range(len(texts))] == [[0], [1], [2], [3], [4], [], [], []]


def test_an_edited_slot_spoils_only_its_run(spark):
    words = "the old harbour was closed by the council after storms had broken every wall along its northern side"
    year = f"in 2020 {words} and in 2020 it was opened again"
    german = "damals sah der Hafen noch anders aus als heute und viele kleine boote lagen dort am ufer bis der Hafen dann geschlossen wurde"
    roles = "she pays 3 coins for every loaf of bread that he bakes, then some quite unlike things follow and he sells 3 sheep to the farmer who lives by the river"
    # runs of 11 and 13 tokens: the roles of 3 are asked for in each alone
    changed = roles.replace("3 coins", "7 coins").replace("3 sheep", "9 sheep")
    texts = [year.replace("in 2020 it", "in 2021 it"), german.replace("der Hafen dann", "der Kanal dann"),
             changed.replace("some quite unlike things", "a few very other words"), changed, "in 2021 the old harbour was closed by the mayor and in 2022 it was opened again"]
    got = _found(spark, [year, german, roles], texts)
    assert [got[i] for i in range(5)] == [[0], [1], [2], [2], []]
