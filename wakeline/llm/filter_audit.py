"""Audit of a chain of filters: what every order of them removes, and what that costs.

Each filter is a relation: a stored table of the ids that fail it. What is left after a prefix of filters
depends on their set alone, so the survivors of every set are made once, level by level: a left-semi join
with the next filter's relation gives what it removes, a left-anti join what it leaves. Every order of
the filters is then read off those counts. Only rows that fail some filter take part; the others survive
every prefix and are just counted.

Defined results: a null text is empty, a null part the empty string. A row without id has no smaller id
and no label. Repeated rows count each. An id labelled twice has a label if any of its rows says so. Other
columns are ignored, also where their names clash. Without rows there is no part and no result row.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.llm.common import BLANK_RUN, whole_text, words
from wakeline.session import saved

COUNTS = ("n", "good", "toxic")


def text_filters() -> dict[str, Column]:
    """Five conditions on which a document fails, over ``text``, ``_words`` and ``_copy``."""
    text, n_words = F.col("text"), F.size("_words")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n_words < 50,
        "B": 100 * F.size(F.array_distinct("_words")) < 65 * n_words,
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
        "E": F.col("_copy"),
    }


def marked(docs: DataFrame, filters: Mapping[str, Column], part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``id``, ``part`` and a boolean for each filter (null counts as passed).

    ``_copy`` (equal to the text of a smaller id) is found by the SHA-256 of whole texts: the smallest id of
    a text is combined before the shuffle, and the join back meets one row a text, so a text that very many
    rows share is split over tasks. Filters that use it are evaluated after that join.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole_text(F.col(text).cast("string")).alias("text"))
    rows = rows.withColumn("_words", words(F.col("text")))
    late = {name for name, fails in filters.items() if "_copy" in str(fails)}
    early = [F.coalesce(fails, F.lit(False)).alias(name) for name, fails in filters.items() if name not in late]
    seen = saved(rows.select("id", "part", *early, F.unhex(F.sha2("text", 256)).alias("_digest")), "audit-texts")
    first = seen.groupBy("_digest").agg(F.min("id").alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1").drop("_rows")
    first = saved(first, "audit-copies")  # read by a shuffle of its own, so that adaptive execution can split a text's rows
    seen = seen.join(first, "_digest", "left").withColumn("_copy", F.coalesce(F.col("_first") < F.col("id"), F.lit(False)))
    return seen.select("id", "part", *[filters[f].alias(f) if f in late else F.col(f) for f in filters])


@dataclass(frozen=True)
class Relations:
    """Stored tables: all rows (row, part, good, toxic, touched) and the rows that fail each filter."""

    rows: DataFrame
    fails: dict[str, DataFrame]


def relations(found: DataFrame, names: Sequence[str], labels: DataFrame | None = None, key: str = "doc_id") -> Relations:
    """Store one id table a filter from the booleans of :func:`marked`; ``labels`` has quality and toxic by key."""
    if labels is None:
        found = found.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        said = labels.groupBy(F.col(key).alias("id")).agg((F.max("quality") == 1).cast("int").alias("good"), (F.max("toxic") == 1).cast("int").alias("toxic"))
        found = found.join(said, "id", "left").fillna(0, ["good", "toxic"])
    touched = F.lit(False)
    for name in names:
        touched = touched | F.col(name)
    # a row number of its own, as ids may repeat; it is fixed by being written
    rows = saved(found.withColumn("row", F.monotonically_increasing_id()).withColumn("touched", touched), "audit-rows")
    return Relations(rows, {name: saved(rows.filter(F.col(name)).select("row"), f"audit-fails-{name}") for name in names})


def tally(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def walk(store: Relations) -> tuple[DataFrame, DataFrame]:
    """What each filter removes after each set of others, and what each set leaves, by part.

    Returns (removed: part, before, bit, counts) and (left: part, after, n); sets are bit masks in the order
    of the relations. Sets grow by higher bits only, so each is made once; rows that fail no filter are left out.
    """
    names = list(store.fails)
    fails = None
    for bit, name in enumerate(names):
        one = store.fails[name].withColumn("bit", F.lit(bit))
        fails = one if fails is None else fails.unionByName(one)
    alive = store.rows.filter("touched").select(F.lit(0).alias("before"), "row", "part", "good", "toxic")
    removed, left = [], []
    for level in range(len(names)):
        bits = F.filter(F.array(*[F.lit(b) for b in range(len(names))]), lambda b: F.expr("before").bitwiseAND(F.call_function("shiftleft", F.lit(1), b)) == 0)
        tried = alive.withColumn("bit", F.explode(bits))
        removed.append(saved(tally(tried.join(fails, ["row", "bit"], "left_semi"), "part", "before", "bit"), "audit-removed"))
        higher = tried.filter(F.call_function("shiftleft", F.lit(1), F.col("bit")) > F.col("before"))
        after = F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("bit"))).alias("before")
        alive = saved(higher.join(fails, ["row", "bit"], "left_anti").select(after, "row", "part", "good", "toxic"), "audit-left")
        left.append(alive.groupBy("part", F.col("before").alias("after")).agg(F.count("*").alias("kept")))
    return union(removed), saved(union(left), "audit-kept")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def audit(found: DataFrame, names: Sequence[str], labels: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    removed: fail this filter and none before; kept: survivors after it; redundant: fail it but were removed
    before; unique_fails: fail no other filter; shapley: what this filter removes, summed over all orders.
    """
    names = list(names)
    store = relations(found, names, labels, key)
    removed, left = walk(store)
    totals = store.rows.groupBy("part").agg(F.count_if(~F.col("touched")).alias("clean"), F.array(*[F.count_if(F.col(f)) for f in names]).alias("failing"))
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, bit in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[b] for b in order), "step": step, "bit": bit, "before": before, "after": before | 1 << bit})
            before |= 1 << bit
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int, after int>>")
    grid = totals.select("part", "clean", "failing", F.inline(plan))
    grid = grid.join(removed, ["part", "before", "bit"], "left").join(left, ["part", "after"], "left").fillna(0, [*COUNTS, "kept"])
    others = (1 << len(names)) - 1
    alone = removed.filter(F.col("before") == F.lit(others).bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.col("bit")))).select("part", "bit", F.col("n").alias("unique_fails"))
    every = grid.groupBy("part", "bit").agg(F.sum("n").alias("shapley"))
    grid = grid.join(alone, ["part", "bit"], "left").fillna(0, ["unique_fails"]).join(every, ["part", "bit"])
    return grid.select("part", "filter_order", "step", (F.col("clean") + F.col("kept")).alias("kept"), F.col("n").alias("removed"),
                       (F.get("failing", "bit") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
                       F.col("toxic").alias("toxic_lost"), "shapley")
