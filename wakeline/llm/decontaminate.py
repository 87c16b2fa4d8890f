"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text is cut into tokens once and read in three ways. Literally: lower-cased words and numbers without
punctuation. As a template: numbers, units of measure and names (capitalised words inside a sentence) turn
into typed placeholders (words in capitals are no names). As an open template: capitalised words that begin a
sentence or a list item are placeholders of names, too, so a reading never hangs on what precedes the text.
Windows of ``window`` tokens of the documents are hash-joined with those of the benchmark items, any reading
with any. Hits of a document and an item on one diagonal (same distance between their places) are an alignment;
it counts with ``least_windows`` windows or all of the item's. Then the slots are checked: in a run of matched
windows that touch, every value of the item must stand for one value of the document (3 -> 5 everywhere), which
keeps re-parameterised questions and drops texts that merely share a form. Windows equal in their literal
values count whatever the slots of their run say.

Fixed by definition: template windows with more than half placeholders say nothing and are left out, on both
sides; literal windows are never left out, so copies of texts rich in numbers or names are found by them.
Items shorter than a window are matched as a whole; items without a word or number match nothing.

Only windows of the benchmark and hits are shuffled. The benchmark side of the join is left to Spark's own
size check. Windows are compared by 64-bit hashes.

Defined results: a null or empty text is clean. Rows with equal doc_id and text count as one document and
get equal results; null doc_ids take part. Items without id count as item -1. Other columns are kept
(``decontaminate``) or ignored (``hits``), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.llm.common import whole_text
from wakeline.session import saved

#: Placeholders: letters that texts hardly use. A text that does has a slot there.
NUMBER, UNIT, NAME = "\u2115", "\u2124", "\u2119"
#: Stands before a capitalised word that is no NAME, being the first of a sentence or list item.
FIRST = "\u211a"
#: Common units of measure.
UNITS = "mm cm dm m km mg g kg t ml cl l s ms min h hz khz mhz ghz w kw mw v kv a ma j kj mj kcal cal pa kpa bar k c f mi ft in yd lb lbs oz mph kmh eur usd gbp"
# a form's first character is tested before what stands in front of it
_NAME_FORM = r"\p{Lu}(?<=[\p{L},;)] \p{Lu})\p{Ll}\p{L}*+(?!\p{N})"
_FIRST_FORM = rf"\p{{Lu}}(?<![{NUMBER}{UNIT}{NAME}])(?<![\p{{L}}\p{{N}}]\p{{Lu}})\p{{Ll}}\p{{L}}*+(?!\p{{N}})"
_NUMBER_FORM = r"[0-9](?<![\p{L}\p{N}][0-9])(?:[.,]?[0-9])*+"
# what parts tokens: not a point or comma between digits
_BETWEEN = r"(?:[^\p{L}\p{N}.,]|[.,](?![0-9])|[.,](?<![0-9][.,]))++"
_UNIT_FORM = rf"(?i)({NUMBER}[0-9.,]*+ {{1,3}})({'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])"


@dataclass(frozen=True)
class Decontamination:
    window: int = 8
    #: Six windows of eight are a run of 13 tokens, or shorter ones on one diagonal.
    least_windows: int = 6


def _spaced(text: Column) -> Column:
    """The tokens with one space between, the placeholder of their kind, if they have one, in front of the value."""
    named = F.regexp_replace(text, _NAME_FORM, f" {NAME}$0 ")
    numbered = F.regexp_replace(named, _NUMBER_FORM, f" {NUMBER}$0 ")
    measured = F.regexp_replace(numbered, _UNIT_FORM, f"$1{UNIT}$2 ")
    return F.btrim(F.regexp_replace(F.regexp_replace(measured, _FIRST_FORM, f" {FIRST}$0 "), _BETWEEN, " "))


def _split(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _marked(text: Column) -> Column:
    return _split(_spaced(text))


def _kind(token: Column) -> Column:
    return F.substring(token, 1, 1)


def _literal(token: Column) -> Column:
    return F.lower(F.ltrim(token, F.lit(NUMBER + UNIT + NAME + FIRST)))


def _template(token: Column) -> Column:
    return F.when(_kind(token).isin(NUMBER, UNIT, NAME), _kind(token)).otherwise(_literal(token))


def _open_template(token: Column) -> Column:
    return F.when(_kind(token) == FIRST, F.lit(NAME)).otherwise(_template(token))


def tokens(text: Column) -> Column:
    """Template tokens of a text."""
    return F.transform(_marked(text), _template)


def values(text: Column) -> Column:
    """The same tokens with the values behind their placeholders."""
    return F.transform(_marked(text), lambda w: F.ltrim(w, F.lit(FIRST)))


def _read(rows: DataFrame) -> DataFrame:
    """Adds ``marked`` tokens of ``text``, ``slots`` and ``opens`` (placeholders inside, at beginnings) and token hashes of the readings."""
    rows = rows.withColumn("spaced", _spaced(F.col("text")))
    rows = rows.withColumns({"slots": F.col("spaced").rlike(f"[{NUMBER}{UNIT}{NAME}]"), "opens": F.contains("spaced", F.lit(FIRST))})
    # a text without placeholders has one reading
    rows = rows.withColumn("marked", _split(F.when(F.col("slots") | F.col("opens"), F.col("spaced")).otherwise(F.lower("spaced")))).drop("spaced")
    reading = lambda of: F.transform("marked", lambda w: F.xxhash64(of(w)))
    return rows.withColumns({"t0": F.when(F.col("slots") | F.col("opens"), reading(_literal)).otherwise(F.transform("marked", lambda w: F.xxhash64(w))),
                             "t1": F.when(F.col("slots"), reading(_template)), "t2": F.when(F.col("opens"), reading(_open_template))})


def _hash(reading: str, i: Column, size: int | Column) -> Column:
    return F.xxhash64(F.lit(size) if isinstance(size, int) else size, F.slice(reading, i, size))


def _hashes(size: int) -> Column:
    """array<struct<pos, hash>> of the windows of one size; ``t0`` to ``t2`` hold the token hashes."""
    starts = F.when(F.size("t0") >= size, F.sequence(F.lit(1), F.size("t0") - (size - 1))).otherwise(F.array().cast("array<int>"))
    of = lambda t: F.transform(starts, lambda i: F.struct(i.alias("pos"), _hash(t, i, size).alias("hash")))
    return F.when(F.col("slots") & F.col("opens"), F.concat(of("t0"), of("t1"), of("t2"))).when(F.col("slots"), F.concat(of("t0"), of("t1"))).when(
        F.col("opens"), F.concat(of("t0"), of("t2"))).otherwise(of("t0"))


def _items(benchmark: DataFrame, p: Decontamination) -> DataFrame:
    """item, its marked tokens, window size, number of windows and windows (pos; hash and filled of every reading)."""
    text = whole_text(F.col("text").cast("string"))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), text.alias("text"))
    # items of one id stay apart by their texts
    rows = _read(rows.withColumn("item", F.struct("item_id", F.xxhash64("text").alias("of"))))
    rows = rows.filter(F.size("marked") > 0).withColumn("size", F.least(F.size("marked"), F.lit(p.window)))
    rows = rows.withColumns({"t1": F.coalesce("t1", "t0"), "t2": F.coalesce("t2", "t1", "t0")})
    starts = F.sequence(F.lit(1), F.size("marked") - F.col("size") + 1)

    def filled(i: Column, *kinds: str) -> Column:
        return 2 * F.size(F.filter(F.slice("marked", i, F.col("size")), lambda w: _kind(w).isin(*kinds))) <= F.col("size")

    window = F.transform(starts, lambda i: F.struct(
        i.alias("place"), *[_hash(t, i, F.col("size")).alias(t) for t in ("t0", "t1", "t2")],
        filled(i, NUMBER, UNIT, NAME).alias("filled1"), filled(i, NUMBER, UNIT, NAME, FIRST).alias("filled2")))
    return rows.select("item", "marked", "size", window.alias("windows"), "opens").withColumn("n_all", F.size("windows"))


def _known(items: DataFrame) -> DataFrame:
    """One row for every hash of an item's window: ``form`` (1 template, 2 open template), place, filled, literal."""
    rows = []
    for form in (1, 2):
        filled = F.col(f"w.filled{form}")
        n = F.size(F.filter(F.col(f"windows.filled{form}"), lambda full: full))
        # without a word that opens a sentence the open template is the template
        of = items.filter("opens") if form == 2 else items
        of = of.select("item", "size", "n_all", n.alias("n_filled"), F.lit(form).alias("form"), F.explode("windows").alias("w"))
        literal = F.struct(F.col("w.t0").alias("hash"), F.lit(True).alias("literal"))
        template = F.struct(F.col(f"w.t{form}").alias("hash"), F.lit(False).alias("literal"))
        either = F.when(filled & (F.col("w.t0") != F.col(f"w.t{form}")), F.array(literal, template)).otherwise(F.array(literal))
        rows.append(of.select("item", "size", "n_all", "n_filled", "form", F.col("w.place").alias("place"), filled.alias("filled"), F.explode(either).alias("k")))
    return rows[0].unionByName(rows[1]).select("item", "size", "n_all", "n_filled", "form", "place", "filled", "k.hash", "k.literal")


_LINE = ("doc_id", "h", "item", "form", "shift")


def _counts(p: Decontamination, n: Column, n_filled: Column) -> Column:
    """Whether an alignment of ``n`` windows, ``n_filled`` of them filled ones, counts."""
    least = F.lit(p.least_windows)
    return (n >= F.least(least, F.col("n_all"))) | ((n_filled > 0) & (n_filled >= F.least(least, F.col("n_filled"))))


def hits(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, h (hash of the text) and ``items`` (sorted ids) of the contaminated documents."""
    items = saved(_items(benchmark, p), "items")
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most ``window`` numbers
    if not sizes:
        sizes = [p.window]
    text = whole_text(F.col("text").cast("string"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    read = _read(slim).select("doc_id", "h", "slots", "opens", "t0", "t1", "t2")
    seen = read.select("doc_id", "h", F.explode(F.concat(*[_hashes(n) for n in sorted(sizes)])).alias("s"))
    seen = seen.select("doc_id", "h", "s.pos", "s.hash")
    met = seen.join(_known(items), "hash").withColumn("shift", F.col("pos") - F.col("place"))
    met = met.groupBy(*_LINE, "place", "size", "n_all", "n_filled", "filled").agg(F.max("literal").alias("literal"))
    line, before = Window.partitionBy(*_LINE), Window.partitionBy(*_LINE).orderBy("place")
    met = met.withColumns({"n": F.count("*").over(line), "n_met": F.count_if("filled").over(line), "n_literal": F.count_if("literal").over(line),
                           "_new": F.when(F.col("place") - F.lag("place").over(before) <= F.col("size"), 0).otherwise(1)})
    met = met.withColumn("run", F.sum("_new").over(before)).filter(_counts(p, F.col("n"), F.col("n_met")))
    sure = F.col("n_literal") >= F.least(F.lit(p.least_windows), F.col("n_all"))
    met = saved(met.withColumn("sure", sure).drop("n", "n_met", "n_literal", "_new"), "alignments")
    good = met.filter("sure").unionByName(_consistent(slim, items, met.filter("not sure")))
    lines = good.groupBy(*_LINE, "n_all", "n_filled").agg(F.count("*").alias("n"), F.count_if("filled").alias("n_met"))
    lines = lines.filter(_counts(p, F.col("n"), F.col("n_met")))
    return lines.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item.item_id")).alias("items"))


def _consistent(slim: DataFrame, items: DataFrame, met: DataFrame) -> DataFrame:
    """Windows of the runs in which every value of the item stands for one value of the document, and literal ones."""
    runs = met.groupBy(*_LINE, "run").agg(F.min("place").alias("lo"), F.max(F.col("place") + F.col("size") - 1).alias("hi"))
    given = items.select("item", F.posexplode("marked").alias("at", "value")).withColumn("at", F.col("at") + 1)
    given = given.filter(_kind(F.col("value")).isin(NUMBER, UNIT, NAME, FIRST))
    asked = runs.join(given, "item").filter("at between lo and hi").filter((F.col("form") == 2) | (_kind(F.col("value")) != FIRST))
    asked = saved(asked, "slots")
    if not asked.head(1):
        return met
    need = asked.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).distinct()
    texts = slim.join(need, slim["doc_id"].eqNullSafe(F.col("of")) & (slim["h"] == F.col("of_h")), "left_semi").dropDuplicates(["doc_id", "h"])
    filled = texts.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), F.posexplode(_marked(F.col("text"))).alias("there", "other"))
    filled = filled.filter(_kind(F.col("other")).isin(NUMBER, UNIT, NAME, FIRST))
    same = asked["doc_id"].eqNullSafe(F.col("of")) & (asked["h"] == F.col("of_h")) & (asked["at"] + asked["shift"] - 1 == F.col("there"))
    slot = lambda c: F.when(_kind(F.col(c)) == FIRST, F.concat(F.lit(NAME), F.substring(c, 2, 1 << 30))).otherwise(F.col(c))
    # the same word at the beginning of both is just a word
    word = (_kind(F.col("value")) == FIRST) & (_literal(F.col("value")) == _literal(F.col("other")))
    pairs = asked.join(filled, same).filter(~word).withColumns({"value": slot("value"), "other": slot("other")}).filter(_kind(F.col("value")) == _kind(F.col("other")))
    broken = pairs.groupBy(*_LINE, "run", "value").agg(F.countDistinct("other").alias("n")).filter("n > 1")
    broken = broken.select(*[F.col(c).alias(f"bad_{c}") for c in (*_LINE, "run")]).distinct()
    kept = [met[c].eqNullSafe(F.col(f"bad_{c}")) for c in (*_LINE, "run")]
    kept.append(~met["literal"])
    return met.join(broken, kept, "left_anti")


def _same(docs: DataFrame) -> Column:
    return docs["doc_id"].cast("long").eqNullSafe(F.col("_of")) & (F.xxhash64(whole_text(docs["text"].cast("string"))) == F.col("_h"))


def mark(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """doc_id and ``items`` (sorted ids, empty for a clean text) of every document."""
    found = hits(docs, benchmark, p).select(F.col("doc_id").alias("_of"), F.col("h").alias("_h"), "items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text(F.col("text").cast("string"))).alias("h"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(F.col("_of")) & (rows["h"] == F.col("_h")), "left")
    return out.select("doc_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """The clean documents."""
    found = hits(docs, benchmark, p).select(F.col("doc_id").alias("_of"), F.col("h").alias("_h"))
    return docs.join(found, _same(docs), "left_anti").select(*docs.columns)
