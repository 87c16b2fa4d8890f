"""Mixing sources along a time-varying curriculum.

A schedule gives every source a weight that changes over training time t from 0 to 1, linearly between its
knots. Its integral is the source's weight in the whole mix; targets follow those weights, no source beyond
``most_repeats`` times its size, the excess going to the others. A source's demand up to time t is its target
times the integral of its weight up to t; inverting that function at the place of a document in its source
gives the time at which the document is read, and a range sort by that time is the training order.

Documents are whole. All documents are read ``floor(target / size)`` times; of the remaining demand the
largest documents of a source (each over a thousandth of it, so fewer than a thousand) are dealt by carrying
the rounding error from each to the next smaller one, and the others, in a seeded order, take up what is
left. A source misses its target by half of one of its small documents, unless it has too few of them.

Nothing of a source meets in one task: documents are range-sorted by (source, lot, row) over all tasks, and
running totals are made inside a task's range and joined with the totals of the ranges before. One row for
each source, for each source and range, and the large documents are the only things that meet.

Defined results: a null text has size 0, a null source is a source of its own (last). Documents of size 0
are placed but take no words. Rows without id and repeated rows count each; equal rows share their places
in any order, so reruns agree. Sources without schedule take nothing. Other columns are ignored, also where
their names clash. An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.llm.common import BLANK_RUN, BLANKS, whole_text
from wakeline.session import saved

#: Documents over this share of their source are dealt one after the other.
LARGE_SHARE = 0.001


def n_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(BLANK_RUN)) + 1).cast("long")


def lot_of(key: Column, body: Column, seed: int) -> Column:
    """Place of a row in the seeded order: the first 60 bits of an MD5 of seed, key and text."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), body)
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def ranked_schedule(docs: DataFrame, source: str = "source", cycle: int = 3, swing: float = 0.5) -> DataFrame:
    """A schedule for sources by code point, null last: mean weights 1 to ``cycle``, repeating.

    Odd places rise from (1 - swing) to (1 + swing) times their weight over the training, even ones fall.
    """
    names = docs.select(F.col(source).cast("string").alias("source")).distinct()
    names = names.withColumn("_place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)  # one row a source
    weight, sign = (F.col("_place") % cycle + 1).cast("double"), F.when(F.col("_place") % 2 == 0, 1.0).otherwise(-1.0)
    knots = F.array(*[F.struct(F.lit(t).alias("t"), (weight * (1.0 + sign * (swing * way))).alias("weight")) for t, way in ((0.0, -1.0), (1.0, 1.0))])
    return names.select("source", F.inline(knots))


def curves(schedule: DataFrame) -> DataFrame:
    """One row a source: ``weight`` (integral) and its pieces (start, weight at the start, slope, integral before)."""
    by = Window.partitionBy("source").orderBy("t")
    piece = schedule.withColumns({"width": F.lead("t").over(by) - F.col("t"), "next": F.lead("weight").over(by)}).filter("width > 0")
    piece = piece.withColumn("area", (F.col("weight") + F.col("next")) / 2.0 * F.col("width"))
    piece = piece.withColumn("before", F.sum("area").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("area"))
    knot = F.struct("t", F.col("weight").alias("w"), ((F.col("next") - F.col("weight")) / F.col("width")).alias("slope"), "before", "width")
    return piece.groupBy("source").agg(F.sum("area").alias("weight"), F.array_sort(F.collect_list(knot)).alias("pieces"))


def targets(sizes: DataFrame, schedule: DataFrame, most_repeats: int = 3) -> DataFrame:
    """Targets by filling up: the level is the words left for the sources not yet full over their weights.

    ``sizes``: source, source_size. Sources fill in the order of cap over weight. Only one row a source meets.
    """
    known = curves(schedule).withColumnRenamed("source", "_name")
    out = sizes.join(known, F.col("source").eqNullSafe(F.col("_name")), "left").drop("_name")
    out = out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("cap", (F.col("source_size") * most_repeats).cast("double"))
    every = Window.partitionBy(F.lit(1))
    fills = every.orderBy(F.col("fills_at").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"fills_at": F.try_divide("cap", "weight"), "total": F.sum("source_size").over(every).cast("double"), "weights": F.sum("weight").over(every)})
    full, used = F.coalesce(F.sum("cap").over(fills), F.lit(0.0)), F.coalesce(F.sum("weight").over(fills), F.lit(0.0))
    out = out.withColumn("level", F.try_divide(F.col("total") - full, F.col("weights") - used))
    open_at = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("fills_at", "source", "level"))
    out = out.withColumn("level", F.min(F.when(F.col("weight") > 0, open_at)).over(every).level)
    target = F.when(F.col("weight") <= 0, 0.0).when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return out.withColumn("target", target).drop("level", "cap", "fills_at", "total", "weights")


def dealt(large: DataFrame) -> DataFrame:
    """Extra copies of large documents (source, row, extra, missed), the error carried from larger to smaller.

    ``large``: source, row, lot, size, share. Fewer than 1 / LARGE_SHARE rows of a source exist.
    """
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "lot", "row"], ascending=[False, True, True], ignore_index=True)
        extra, carry = np.zeros(len(rows), bool), 0.0
        for i, (size, share) in enumerate(zip(rows["size"], rows["share"])):
            carry += size * share
            if 2 * carry >= size and share > 0:
                extra[i], carry = True, carry - size
        return pd.DataFrame({"source": rows["source"], "row": rows["row"], "extra": extra, "missed": np.r_[np.zeros(len(rows) - 1), carry] if len(rows) else []})

    return large.groupBy("source").applyInPandas(deal, "source string, row long, extra boolean, missed double")


def running(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Running totals before each row within its source, over rows range-sorted by (source, lot, row)."""
    rows = ranged.withColumns({f"_{name}": value for name, value in sums.items()})
    per = rows.groupBy("source", "range").agg(*[F.sum(f"_{name}").alias(name) for name in sums])
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    per = per.select(F.col("source").alias("_source"), F.col("range").alias("_range"), *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums])
    inside = Window.partitionBy("source", "range").orderBy("lot", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_{name}": F.coalesce(F.sum(f"_{name}").over(inside), F.lit(0)) for name in sums})
    rows = rows.join(per, (F.col("range") == F.col("_range")) & F.col("source").eqNullSafe(F.col("_source")))
    return rows.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_source", "_range", *[f"_{name}" for name in sums])


def time_of(demand: Column) -> Column:
    """Training time at which a source has asked for ``demand`` words: its curve inverted, piece by piece."""
    area = F.try_divide(demand, F.col("target")) * F.col("weight")
    piece = F.element_at(F.filter("pieces", lambda p: p.before <= area), -1)
    rest = area - piece.before
    root = F.sqrt(F.greatest(F.lit(0.0), piece.w * piece.w + 2.0 * piece.slope * rest))
    return F.least(F.lit(1.0), piece.t + F.when(rest <= 0, 0.0).otherwise(F.least(piece.width, F.try_divide(2.0 * rest, piece.w + root))))


def mix(docs: DataFrame, schedule: DataFrame, most_repeats: int = 3, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """One row a document: key, source, size, source_size, target, copies, taken, lot and the times of its copies.

    ``schedule``: source, t, weight (knots of t from 0 to 1). Times are ascending; :func:`stream` makes the
    training order of them.
    """
    body = whole_text(F.col(text).cast("string"))
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(body).alias("size"), lot_of(F.col(key), body, seed).alias("lot"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")  # written, so numbers stay
    plan = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), schedule, most_repeats), "mix-targets")
    whole = F.least(F.lit(most_repeats), F.floor(F.try_divide("target", "source_size"))).cast("long")
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, whole).otherwise(0)).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("share", F.coalesce(F.try_divide("rest", "source_size"), F.lit(0.0)))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(rows.repartitionByRange(tasks, "source", "lot", "row").withColumn("range", F.spark_partition_id()), "mix-ranges")
    of = plan.withColumnRenamed("source", "_source")
    ranged = ranged.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    is_large = F.col("size") > LARGE_SHARE * F.col("source_size")
    chosen = saved(dealt(ranged.filter(is_large).select("source", "row", "lot", "size", "share")), "mix-large")
    missed = chosen.groupBy(F.col("source").alias("_source")).agg(F.sum("missed").alias("missed"))
    small = F.when(is_large, 0).otherwise(F.col("size"))
    out = running(ranged, {"start": F.col("size"), "small_start": small}).withColumn("small", small)
    small_total = ranged.groupBy(F.col("source").alias("_of")).agg(F.sum(small).alias("small_total"))
    out = out.join(missed, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    out = out.join(small_total, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    out = out.join(chosen.select("row", "extra"), "row", "left")
    # half of a small document or more within the rest of the demand: it is read once more
    demand = F.col("small_total") * F.col("share") + F.coalesce("missed", F.lit(0.0))
    once_more = F.when(is_large, F.coalesce("extra", F.lit(False))).otherwise((F.col("rest") > 0) & (2 * F.col("small_start") + F.col("size") <= 2 * demand))
    out = out.withColumn("copies", F.when(F.col("size") == 0, F.when(F.col("target") > 0, 1).otherwise(0)).otherwise(F.col("passes") + once_more.cast("int")).cast("int"))
    # place of the k-th copy: whole passes lie one after the other, the last is compressed to the demand that is left
    place = lambda k: F.least(F.col("target"), k * F.col("source_size") + F.when(k < F.col("passes"), F.col("start")).otherwise(F.col("start") * F.col("share")))
    times = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: time_of(place(k)))
    out = out.withColumn("times", F.when(F.col("copies") > 0, times).otherwise(F.array().cast("array<double>")))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"), "lot", "times")


def stream(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """The training order: key, text, time, a row for each copy, range-sorted by time."""
    body = F.col(text).cast("string")
    texts = docs.select(F.col(key).alias("_key"), body.alias(text), lot_of(F.col(key), whole_text(body), seed).alias("_lot"))
    texts = texts.groupBy("_key", "_lot").agg(F.first(text).alias(text))  # equal rows are one text
    copies = mixed.select(key, "lot", F.explode("times").alias("time"))
    out = copies.join(texts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("lot") == F.col("_lot")))
    return out.select(key, text, "time", "lot").orderBy("time", "lot", key).drop("lot")
