"""Quality rules as a short-circuit cascade.

Each rule is a condition on which a document is rejected, over counts of the text. On a bounded sample the
time that each count and each condition takes is measured, over what reading the sample alone takes, and
which rows each rule rejects. Rules are then picked one by one: always the one that rejects most of the rows
still left, per second that it adds to what earlier rules have computed already. A row stops at the first
rule that rejects it: :func:`cascade` computes a count only for rows that reach a rule which needs it. The
order changes the work and never the verdict. :func:`judge` also returns all counts, of every row.

Counts follow fixed definitions (see ``counts``); windows of five words are told apart by 64-bit hashes
within one text (two of n different windows are confused with a chance of n^2 / 2^65).

Defined results: a null, empty or blank text has no words, all its counts are 0 and it is rejected.
Repeated rows get equal results. Columns beside the text are kept as they are; clashing names of computed
columns are replaced.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.llm.common import BLANK_RUN, BLANKS, drawn, whole_text, words
from wakeline.session import saved

WINDOW = 5
#: Rows on which cost and selectivity are measured.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """Rejects where the SQL condition holds; it may use the text and the counts."""

    name: str
    reject: str


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("line_copies", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("shouting", r"2 * length(regexp_replace(text, '[^\\p{Lu}]+', '')) > length(regexp_replace(text, '[^\\p{L}]+', ''))"),
    Rule("letters", r"10 * length(regexp_replace(text, '[^\\p{L}]+', '')) < 6 * word_chars"),
)


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of whole texts.

    n_words; word_chars (code points in words); n_symbols (characters of ``#*$%&|<>``); n_lines (lines
    with a word); n_dup_lines (of those, equal to an earlier one); n_repeat_words (words inside windows of
    five words that occur twice or more in the text, the first time included).
    """
    body = F.col(text)
    out = df.withColumn(text, whole_text(F.col(text).cast("string"))).withColumn("_w", words(body))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    # positions of windows, a hash for each
    hashes = F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))
    out = out.withColumn("_h", F.when(F.size("_w") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    some = F.size("_h") > F.size(F.array_distinct("_h"))
    ordered = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(some, ordered))
    again = lambda s, i: (s.h == F.get("_s", i - 1).h) | (s.h == F.get("_s", i + 1).h)
    found = F.array_sort(F.transform(F.filter("_s", again), lambda s: s.i))
    out = out.withColumn("_p", found)
    steps = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, n: a + n)
    return out.withColumns({
        "word_chars": F.length(F.regexp_replace(body, BLANK_RUN, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_p").isNull(), F.lit(0).cast("long")).otherwise(covered),
    }).drop("_w", "_lines", "_h", "_s", "_p")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(w: Column) -> Column:
    """Words inside windows of five that occur twice or more, from the array of words."""
    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, n: a + n)

    def again(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h))
        return _let(F.array_sort(F.transform(twice, lambda x: x.i)), covered)

    def told(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) > F.size(F.array_distinct(h)), _let(ordered, again)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) > WINDOW, _let(hashes, told)).otherwise(F.lit(0).cast("long"))


def single_counts(text: str = "text") -> dict[str, Column]:
    """Each count on its own, for rows that need no other."""
    body = F.col(text)
    filled = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.btrim(body, F.lit(BLANKS))
    return {
        "n_words": F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(BLANK_RUN)) + 1).cast("long"),
        "word_chars": F.length(F.regexp_replace(body, BLANK_RUN, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size(filled).cast("long"),
        "n_dup_lines": _let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _let(words(body), _repeated),
    }


def needs(rule: Rule) -> list[str]:
    """Counts that a rule's condition names."""
    return [name for name in single_counts() if re.search(rf"\b{name}\b", rule.reject)]


def _seconds(sample: DataFrame, value: Column) -> float:
    """Least time of two runs that compute a value for every row."""
    took = []
    for _ in range(2):
        start = time.perf_counter()
        sample.agg(F.max(F.hash(value))).collect()
        took.append(time.perf_counter() - start)
    return min(took)


def picked(rules: Sequence[Rule], rows: Sequence[tuple[tuple[bool, ...], int]], count_cost: dict[str, float], rule_cost: dict[str, float]) -> list[Rule]:
    """The rules, each time the one with most rejections of the rows left per second it adds.

    ``rows``: which rules reject, and how many rows that holds for. A rule that rejects nothing more comes
    after the others, the cheaper first.
    """
    left, known, order = list(rows), set(), []
    while len(order) < len(rules):
        def worth(i: int) -> tuple[float, float]:
            added = rule_cost[rules[i].name] + sum(count_cost[c] for c in needs(rules[i]) if c not in known)
            return sum(n for flags, n in left if flags[i]) / added, -added

        best = max((i for i, r in enumerate(rules) if r not in order), key=worth)
        order.append(rules[best])
        known |= set(needs(rules[best]))
        left = [(flags, n) for flags, n in left if not flags[best]]
    return order


def order_rules(counted: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules in the order :func:`picked`, measured on a sample that has its text and counts."""
    sample = saved(counted, "sample")
    flags = sample.groupBy(*[F.coalesce(F.expr(r.reject), F.lit(False)).alias(r.name) for r in rules]).agg(F.count("*").alias("n")).collect()
    least = 1e-4
    reading = _seconds(sample, F.length("text"))
    count_cost = {name: max(least, _seconds(sample, value) - reading) for name, value in single_counts().items() if any(name in needs(r) for r in rules)}
    rule_cost = {r.name: max(least, _seconds(sample, F.expr(r.reject)) - reading) for r in rules}
    return picked(rules, [(tuple(r[rule.name] for rule in rules), r["n"]) for r in flags], count_cost, rule_cost)


def rejected_by(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects a row, null for none; later rules aren't evaluated."""
    out = F.when(F.expr(rules[0].reject), rules[0].name)
    for rule in rules[1:]:
        out = out.when(F.expr(rule.reject), rule.name)
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: DataFrame | None = None) -> DataFrame:
    """The documents with counts, ``base_failed``, ``rejected_by`` and ``kept``.

    ``sample``: documents on which the order of the rules is measured; by default a bounded part of docs.
    """
    ordered = order_rules(counts(drawn(docs, SAMPLE_ROWS) if sample is None else sample), rules)
    out = counts(docs).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rejected_by", rejected_by(ordered))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The documents with ``rejected_by`` and ``kept``; a count is computed only for rows that reach a rule needing it.

    ``rules`` are taken in their order; by default RULES, ordered on a bounded part of docs.
    """
    if rules is None:
        rules = order_rules(counts(drawn(docs, SAMPLE_ROWS)))
    clash = {c: f"_own_{c}" for c in docs.columns if c in single_counts()}
    out, made = docs.withColumnsRenamed(clash).withColumns({"_whole": F.col("text"), "text": whole_text(F.col("text").cast("string")), "rejected_by": F.lit(None).cast("string")}), []
    alive = F.col("rejected_by").isNull()
    for rule in rules:
        new = [name for name in needs(rule) if name not in made]
        out = out.withColumns({name: F.when(alive, value) for name, value in single_counts().items() if name in new})
        out = out.withColumn("rejected_by", F.when(alive, F.when(F.expr(rule.reject), rule.name)).otherwise(F.col("rejected_by")))
        made += new
    kept = [c for c in docs.columns if c not in ("rejected_by", "kept")]
    return out.select(*[F.col("_whole" if c == "text" else clash.get(c, c)).alias(c) for c in kept], "rejected_by", F.col("rejected_by").isNull().alias("kept"))
