"""Line dedup: a suffix array over the corpus's line ids, by distributed prefix doubling.

A document is its sequence of lines with a word in them, without the blanks around. Lines that occur once
cut it into segments; only segments are ranked. Doubling: the rank of a run of 2h lines is the dense rank
of the pair of ranks of its halves, among the distinct pairs of the whole corpus, so that ranks order the
suffixes by their first lines. Rounds end when no run of the new length repeats, or the runs are long enough.

From each line on, the shortest run of at least ``min_words`` words is taken, and up to each line the
shortest one. The suffixes that share such a run are one interval of the suffix array, with a longest
common prefix of at least its length; two ranks of a doubled length, from its start and to its end, name it.
Every run of an interval but the first (by doc_id, then line) is a repeat. Overlapping repeats make up the
maximal repeated runs: a longer run with an earlier copy is covered by the short runs inside it. Their lines
are deleted, so the first copy of everything stays.

Every round shuffles a few numbers for each repeated line. A round's distinct pairs are counted before
they are dealt out, so a line that fills a third of the corpus is one row of them.

Defined results: blank lines take no part and stay. A null text stays null, an empty one empty. Overlapping
repeats of one document count (of a line that repeats n times in a row the first stays). Null doc_ids come
last in the order. Rows with equal doc_id and text count as one document and get equal results. Other
columns are kept as they are, whatever their names. Limits: 2^26 lines with a word in a text, 2^37 texts
with repeated lines. Lines are told apart by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wakeline.llm.common import BLANKS, words
from wakeline.session import saved

MIN_WORDS = 20
#: Up to this measured size the list of deleted lines is broadcast, so that the texts needn't be shuffled.
BROADCAST_BYTES = 16 << 20
_LINE_BITS = 26


def ranked(keys: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``rank`` from 1 to distinct keys, by ranges: rows of a range plus all rows before it."""
    parts = saved(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranks")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_part").withColumn("rank", inside + F.col("_offset")).drop("_part", "_offset")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and of each line with a word: its place in the text, its number, 128 bits, its words."""
    text = F.col("text").cast("string")
    bare = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("place"), F.btrim(line, F.lit(BLANKS)).alias("line")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"),
                       F.posexplode(F.filter(bare, lambda s: s["line"] != "")).alias("i", "s"))
    line = F.col("s.line")
    return rows.select("doc_id", "h", "i", "s.place", F.xxhash64(line).alias("id1"), F.xxhash64(F.lit(1), line).alias("id2"), F.size(words(line)).cast("long").alias("w"))


def _sequences(lines: DataFrame) -> DataFrame:
    """d (number of the document), i, place, rank, w and ``end`` (of its segment) of every repeated line."""
    lines = saved(lines.distinct(), "lines")
    kinds = lines.groupBy("id1", "id2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = lines.join(ranked(kinds, "id1", "id2"), ["id1", "id2"]).drop("id1", "id2")
    rows = saved(rows.withColumn("last", F.col("doc_id").isNull()), "repeated")
    numbers = ranked(rows.select("last", "doc_id", "h").distinct(), "last", "doc_id", "h").select(
        F.col("doc_id").alias("of"), F.col("h").alias("of_h"), F.col("rank").alias("d"))
    rows = rows.join(numbers, rows["doc_id"].eqNullSafe(numbers["of"]) & (rows["h"] == numbers["of_h"])).drop("of", "of_h", "last")
    rows = rows.withColumn("segment", F.col("i") - F.row_number().over(W.partitionBy("d").orderBy("i")))
    return rows.withColumn("end", F.max("i").over(W.partitionBy("d", "segment")) + 1)


def _pos(d: str = "d", i: str = "i") -> Column:
    return F.shiftleft(F.col(d), _LINE_BITS) + F.col(i)


def _double(rows: DataFrame, longest: int) -> DataFrame:
    """Adds ``ranks``: those of the runs of 1, 2, 4, ... lines from each line on, while they repeat."""
    rows = saved(rows.withColumn("ranks", F.array("rank")).drop("rank"), "levels")
    h = 1
    while 2 * h <= longest:
        last = F.element_at("ranks", -1)
        ahead = F.coalesce(F.lead(last, h).over(W.partitionBy("d", "segment").orderBy("i")), F.lit(0))
        pairs = saved(rows.withColumns({"a": last, "b": ahead}), "pairs")
        whole = (F.col("i") + 2 * h <= F.col("end")).cast("int")
        distinct = saved(pairs.groupBy("a", "b").agg(F.sum(whole).alias("whole")), "distinct")
        if not distinct.filter("whole > 1").head(1):
            break
        names = ranked(distinct.select("a", "b"), "a", "b")
        rows = saved(pairs.join(names, ["a", "b"]).withColumn("ranks", F.concat("ranks", F.array("rank"))).drop("a", "b", "rank"), "levels")
        h *= 2
    return rows


def _repeats(rows: DataFrame, min_words: int) -> DataFrame:
    """d, i and ``until`` of the shortest runs of enough words that have an earlier copy."""
    order = W.partitionBy("d", "segment").orderBy("i")

    def size(near: Column) -> Column:
        """Lines of the shortest run of enough words, 0 if all are too few; a line has a word at least."""
        sums = F.aggregate(near, F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(0).alias("m")),
                           lambda a, w: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["w"] + w).alias("w"), (a["m"] + 1).alias("m"))))
        return F.when(sums["w"] >= min_words, sums["m"]).otherwise(0)

    sized = rows.withColumns({"on": size(F.collect_list("w").over(order.rowsBetween(0, min_words - 1))),
                              "up": size(F.reverse(F.collect_list("w").over(order.rowsBetween(1 - min_words, 0))))})
    runs = sized.select("d", F.explode(F.array(F.struct("i", F.col("on").alias("m")), F.struct((F.col("i") - F.col("up") + 1).alias("i"), F.col("up").alias("m")))).alias("s"))
    runs = runs.select("d", "s.i", "s.m").filter("m > 0").distinct()
    level = F.floor(F.log2("m")).cast("int")  # exact for the small m here
    heads = rows.select("d", "i", F.col("ranks").alias("head"))
    tails = rows.select("d", F.col("i").alias("at"), F.col("ranks").alias("tail"))
    runs = runs.join(heads, ["d", "i"]).filter(level < F.size("head")).withColumn("at", (F.col("i") + F.col("m") - F.expr("shiftleft(1, cast(floor(log2(m)) AS int))")).cast("int"))
    named = saved(runs.join(tails, ["d", "at"]).select("d", "i", "m", F.get("head", level).alias("a"), F.get("tail", level).alias("b")), "runs")
    first = named.groupBy("m", "a", "b").agg(F.count("*").alias("n"), F.min(_pos()).alias("start")).filter("n > 1")
    return named.join(first, ["m", "a", "b"]).filter(F.col("start") < _pos()).groupBy("d", "i").agg(F.max(F.col("i") + F.col("m")).alias("until"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h (hash of the text) and the ``places`` (0-based lines) to delete, for documents that have any."""
    rows = _double(_sequences(_lines(docs)), min_words)
    runs = saved(_repeats(rows, min_words), "repeats")
    rows = rows.select("d", "i", "segment", "place", "doc_id", "h").join(runs, ["d", "i"], "left")
    reach = F.max("until").over(W.partitionBy("d", "segment").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    gone = rows.withColumn("reach", reach).filter("reach > i")
    return gone.groupBy("d").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.collect_list("place").alias("places")).drop("d")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their repeated lines; ``_lines_deleted`` has the number of deleted lines."""
    gone = saved(repeated_lines(docs, min_words), "places").select(F.col("doc_id").alias("_of"), F.col("h").alias("_h"), F.col("places").alias("_places"))
    size = gone.agg((24 * F.count("*") + 4 * F.coalesce(F.sum(F.size("_places")), F.lit(0))).alias("bytes")).first()["bytes"]
    if size <= BROADCAST_BYTES:  # a small list travels to the texts; a larger one meets them by a sort-merge join
        gone = F.broadcast(gone)
    text = F.col("text").cast("string")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_of")) & (F.xxhash64(text) == F.col("_h"))
    joined = docs.join(gone, same, "left")
    left = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_places", i))
    out = joined.withColumns({"text": F.when(F.col("_places").isNull(), text).otherwise(F.array_join(left, "\n")),
                              "_lines_deleted": F.coalesce(F.size("_places"), F.lit(0)).cast("long")})
    return out.select(*docs.columns, "_lines_deleted")
