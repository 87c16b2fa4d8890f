"""Ordered per-vessel computation, also when one vessel holds most of the rows.

Normally a vessel's rows fit one task, and every function here is a window over
``mmsi``: one shuffle, which chained windows share.

:func:`spread_hot` checks the size of the largest vessel.  Beyond the limit it
cuts the rows into time chunks (column ``_chunk``), and the same functions then
work inside (vessel, chunk), while the little that must cross a chunk border
travels through a summary with one row per (vessel, chunk):

* :func:`with_previous` / :func:`with_next` carry the neighbouring row,
* :func:`with_running` carries running totals and last known values,
* :func:`with_margins` copies the K bordering rows, for any row-frame window,
* :func:`with_totals` spreads group aggregates back to the rows.

Results are the same either way, also for rows with a NULL key or time, which are
chunks of their own and come first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

CHUNK = "_chunk"
EDGE = "_edge"
ORDER = ("time", "event_id")
VESSEL = ("mmsi",)
CHUNK_HOURS = 6.0
HOT_ROWS = 5_000_000


def chunked(df: DataFrame, hours: float = CHUNK_HOURS, time: str = "time") -> DataFrame:
    """Cut every key into time chunks."""
    return df.withColumn(CHUNK, F.floor(F.unix_micros(F.col(time)) / F.lit(int(hours * 3600e6))))


def spread_hot(df: DataFrame, keys: Sequence[str] = VESSEL, limit: int = HOT_ROWS,
               hours: float = CHUNK_HOURS) -> DataFrame:
    """Chunk the rows if any key has more of them than one task should sort."""
    top = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return chunked(df, hours) if top and top > limit else df


def is_chunked(df: DataFrame) -> bool:
    return CHUNK in df.columns


def unchunked(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK, EDGE)


def frame_window(df: DataFrame, keys: Sequence[str] = VESSEL, order: Sequence[str] = ORDER) -> WindowSpec:
    """The ordered window in which a task sees a key's rows."""
    inside = [CHUNK] if is_chunked(df) else []
    return Window.partitionBy(*keys, *inside).orderBy(*order)


def _carry(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a summary to the rows of its keys; rows with a NULL key or time meet theirs too."""
    there = {c: f"_of_{c}" for c in keys}
    same = reduce(and_, [df[c].eqNullSafe(F.col(n)) for c, n in there.items()])
    return df.join(summary.withColumnsRenamed(there), same).drop(*there.values())


def _neighbour(df, cols, keys, order, out, forward):
    packed = F.struct(*[F.col(c) for c in cols])
    step = F.lead if forward else F.lag
    near = step(packed).over(frame_window(df, keys, order))
    if not is_chunked(df):
        return df.withColumn(out, near)
    pick = F.min_by if forward else F.max_by
    borders = df.groupBy(*keys, CHUNK).agg(
        pick(packed, F.struct(*[F.col(c) for c in order])).alias("_border")
    )
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = borders.select(*keys, CHUNK, step("_border").over(across).alias("_carried"))
    return _carry(df, carried, [*keys, CHUNK]).withColumn(out, F.coalesce(near, F.col("_carried"))).drop("_carried")


def with_previous(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = VESSEL,
                  order: Sequence[str] = ORDER, out: str = "prev") -> DataFrame:
    """Add struct ``out`` holding ``cols`` of the preceding row (NULL at the start)."""
    return _neighbour(df, cols, keys, order, out, forward=False)


def with_next(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = VESSEL,
              order: Sequence[str] = ORDER, out: str = "next") -> DataFrame:
    """Add struct ``out`` holding ``cols`` of the following row (NULL at the end)."""
    return _neighbour(df, cols, keys, order, out, forward=True)


def with_running(df: DataFrame, sums: dict[str, Column] | None = None,
                 lasts: dict[str, Column] | None = None, keys: Sequence[str] = VESSEL,
                 order: Sequence[str] = ORDER) -> DataFrame:
    """Add sums so far and last non-NULL values so far, from a key's first row on."""
    sums, lasts = sums or {}, lasts or {}
    so_far = frame_window(df, keys, order).rowsBetween(Window.unboundedPreceding, 0)
    if not is_chunked(df):
        return df.withColumns({n: F.sum(c).over(so_far) for n, c in sums.items()}
                              | {n: F.last(c, ignorenulls=True).over(so_far) for n, c in lasts.items()})
    df = df.withColumns({f"_in_{n}": c for n, c in {**sums, **lasts}.items()})
    at = F.struct(*[F.col(c) for c in order])
    per_chunk = df.groupBy(*keys, CHUNK).agg(
        *[F.sum(f"_in_{n}").alias(f"_all_{n}") for n in sums],
        *[F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), at)).alias(f"_all_{n}") for n in lasts],
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *keys, CHUNK,
        *[F.sum(f"_all_{n}").over(before).alias(f"_pre_{n}") for n in sums],
        *[F.last(f"_all_{n}", ignorenulls=True).over(before).alias(f"_pre_{n}") for n in lasts],
    )
    df = _carry(df, carried, [*keys, CHUNK])
    new = {}
    for n in sums:
        own, pre = F.sum(f"_in_{n}").over(so_far), F.col(f"_pre_{n}")
        new[n] = F.when(own.isNull(), pre).otherwise(own + F.coalesce(pre, F.lit(0)))
    for n in lasts:
        new[n] = F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(so_far), F.col(f"_pre_{n}"))
    return df.withColumns(new).drop(*[f"_{p}_{n}" for n in new for p in ("in", "pre")])


def with_margins(df: DataFrame, before: int = 0, after: int = 0,
                 keys: Sequence[str] = VESSEL, order: Sequence[str] = ORDER) -> DataFrame:
    """Copy up to ``before``/``after`` bordering rows into each chunk, marked EDGE.

    A :func:`frame_window` whose frame reaches no further is then exact on every
    row that is not EDGE; :func:`drop_margins` removes the copies.
    """
    if not is_chunked(df):
        return df
    plain = list(df.columns)
    rest = [c for c in plain if c not in (*keys, CHUNK)]
    early, late = (Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c in order])
                   for up in (True, False))
    ranked = df.withColumns({"_first": F.row_number().over(early), "_last": F.row_number().over(late)})
    borders = ranked.filter((F.col("_first") <= after) | (F.col("_last") <= before)).groupBy(*keys, CHUNK).agg(
        F.collect_list(F.struct("_first", "_last", *rest)).alias("_rows"))
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    chunks = lambda lo, hi: F.collect_list(F.struct(F.col(CHUNK).alias("c"), F.col("_rows").alias("r"))).over(across.rowsBetween(lo, hi))
    copies = []
    if before:
        near_first = F.sort_array(chunks(-before, -1), asc=False)
        copies.append(F.slice(F.flatten(F.transform(near_first, lambda o: F.array_sort(
            F.filter(o["r"], lambda x: x["_last"] <= before), lambda x, y: x["_last"] - y["_last"]))), 1, before))
    if after:
        near_first = F.sort_array(chunks(1, after))
        copies.append(F.slice(F.flatten(F.transform(near_first, lambda o: F.array_sort(
            F.filter(o["r"], lambda x: x["_first"] <= after), lambda x, y: x["_first"] - y["_first"]))), 1, after))
    rows = copies[0] if len(copies) == 1 else F.concat(*copies)
    copied = borders.select(*keys, CHUNK, rows.alias("_rows")).select(*keys, CHUNK, F.explode("_rows").alias("_row"))
    copied = copied.select(*[F.col(c) if c in (*keys, CHUNK) else F.col(f"_row.{c}").alias(c) for c in plain])
    return df.withColumn(EDGE, F.lit(False)).unionByName(copied.withColumn(EDGE, F.lit(True)))


def drop_margins(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(EDGE)).drop(EDGE) if EDGE in df.columns else df


def with_totals(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Add aggregates over all rows of a key to each of them."""
    if not is_chunked(df):
        whole = Window.partitionBy(*keys)
        return df.withColumns({n: c.over(whole) for n, c in aggs.items()})
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    # the chunk is part of the join key, so a hot key meets its totals in many tasks
    spread = _carry(df.select(*keys, CHUNK).distinct(), totals, keys)
    return _carry(df, spread, [*keys, CHUNK])


def with_positions(df: DataFrame, keys: Sequence[str] = VESSEL,
                   order: Sequence[str] = ORDER, out: str = "position") -> DataFrame:
    """0-based row position inside each key."""
    if not is_chunked(df):
        return df.withColumn(out, F.row_number().over(frame_window(df, keys, order)).cast("long") - 1)
    one = {out: F.lit(1).cast("long")}
    return with_running(df, sums=one, keys=keys, order=order).withColumn(out, F.col(out) - 1)
