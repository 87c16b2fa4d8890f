"""Trajectory reconstruction: segments, resampling, interpolation, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions import geo, times
from wakeline.operators import ordered as O

SEGMENT = ("mmsi", "segment_id")


def with_segments(df: DataFrame, max_gap_minutes: float = 30.0, min_points: int = 6) -> DataFrame:
    """Cut each vessel at gaps longer than the limit; short segments go.

    Adds ``prev`` (the vessel's preceding fix), ``time_diff`` in seconds,
    ``starts_segment``, ``segment_id`` (0-based) and ``segment_points``.
    """
    df = O.with_previous(df, [c for c in ("time", "lat", "lon", "sog", "cog") if c in df.columns])
    df = df.withColumn("time_diff", times.seconds_between(F.col("time"), F.col("prev.time")))
    gap = F.col("time_diff") > max_gap_minutes * 60
    df = df.withColumn("starts_segment", F.coalesce(gap, F.lit(True)))
    df = O.with_running(df, sums={"segment_id": F.when(gap, 1).otherwise(0).cast("long")})
    df = O.with_totals(df, SEGMENT, {"segment_points": F.count("*")})
    return df.filter(F.col("segment_points") >= min_points)


def segment(df: DataFrame, max_gap_minutes: float = 30.0, min_points: int = 6) -> DataFrame:
    """:func:`with_segments` without its working columns."""
    return O.unchunked(with_segments(df, max_gap_minutes, min_points)).drop("prev", "time_diff", "starts_segment")


def segment_statistics(segments: DataFrame) -> DataFrame:
    per = segments.groupBy(*SEGMENT).agg(F.count("*").alias("n"))
    per_vessel = per.groupBy("mmsi").agg(
        F.count("*").alias("s"), F.sum("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    return per_vessel.agg(
        F.count("*").alias("vessels"), F.sum("s").alias("segments"), F.sum("n").alias("points"),
        F.min("lo").alias("min_points"), F.max("hi").alias("max_points"),
        (F.sum("n") / F.sum("s")).alias("avg_points"), F.avg("s").alias("segments_per_vessel"),
    )


def trajectories(segments: DataFrame, mmsi: int | None = None, segment_id: int | None = None) -> DataFrame:
    if mmsi is not None:
        segments = segments.filter(F.col("mmsi") == mmsi)
    if segment_id is not None:
        segments = segments.filter(F.col("segment_id") == segment_id)
    return segments


def last_points(df: DataFrame, n: int = 20, keys: Sequence[str] = ("mmsi",),
                cols: Sequence[str] = ("lat", "lon", "sog", "cog")) -> DataFrame:
    """The latest ``n`` fixes per key in time order; a shorter key is reported, not dropped."""
    newest = [F.col(c).desc() for c in O.ORDER]
    inside = [O.CHUNK] if O.is_chunked(df) else []
    for part in ([*keys, *inside], list(keys)) if inside else (list(keys),):
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(*newest))).filter(F.col("_r") <= n)
    points = F.sort_array(F.collect_list(F.struct(*O.ORDER, *cols)))
    return df.groupBy(*keys).agg(points.alias("points"), F.count("*").alias("n_points")).withColumn(
        "error", F.when(F.col("n_points") < n, F.lit("too short")))


#: Bins that one row may stand for before it is cut.
PIECE = 1000


def _first_values(df: DataFrame, cols: Sequence[str], step_s: int) -> DataFrame:
    """One row per vessel and bin that has reports: first non-NULL values, number of reports, first and last time.

    All that follows is ordered by vessel, so this is the only shuffle; a hot vessel's chunks stay chunks.
    Rows without vessel or time have no place on the grid.
    """
    bin_ = F.floor(F.unix_micros("time") / F.lit(step_s * 1_000_000)) * step_s
    rows = O.unchunked(df).filter(F.col("mmsi").isNotNull() & F.col("time").isNotNull()).select("mmsi", *O.ORDER, *cols, bin_.alias("bin"))
    keys = ["mmsi"]
    if O.is_chunked(df):
        width = max(int(O.CHUNK_HOURS * 3600) // step_s, 1) * step_s
        rows, keys = rows.withColumn(O.CHUNK, F.floor(F.col("bin") / width)), ["mmsi", O.CHUNK]
    at = F.struct(*O.ORDER)
    return rows.repartition(*keys).groupBy(*keys, "bin").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols],
        F.count("*").alias("_reports"), F.min("time").alias("_from"), F.max("time").alias("_to"))


def _expanded(df: DataFrame, step_s: int) -> DataFrame:
    """Each row once for every bin from ``bin`` up to ``_stop``, as column ``at``.

    A long silence is first cut into pieces, so that no array grows with it.
    """
    step, piece = F.lit(step_s).cast("long"), F.lit(step_s * PIECE).cast("long")
    df = df.withColumn("_piece", F.explode(F.sequence("bin", "_stop", piece)))
    return df.withColumn("at", F.explode(F.sequence("_piece", F.least("_stop", F.col("_piece") + piece - step), step)))


def _with_stop(df: DataFrame, step_s: int, cols: Sequence[str] = ()) -> DataFrame:
    """``_stop``: the last bin before the vessel's next report; ``next`` has further columns of that row."""
    df = O.with_next(df, ["bin", *cols], order=["bin"])
    return df.withColumn("_stop", F.coalesce(F.col("next.bin") - step_s, F.col("bin")))


def resample_forward(df: DataFrame, cols: Sequence[str] = ("lat", "lon", "sog", "cog"),
                     step_s: int = 60, min_rows: int = 20, min_span_s: float = 300.0) -> DataFrame:
    """First value per step, gaps filled forward; vessels too short before or after go.

    Values are carried from report to report; each report then stands for the steps up to the next one.
    """
    df = O.with_totals(_first_values(df, cols, step_s), ["mmsi"], {"_all": F.sum("_reports"), "_first": F.min("_from"), "_last": F.max("_to")})
    df = df.filter((F.col("_all") >= min_rows) & (times.seconds_between(F.col("_last"), F.col("_first")) >= min_span_s))
    df = O.with_running(df, lasts={f"_f_{c}": F.col(c) for c in cols}, order=["bin"])
    df = _with_stop(df, step_s).dropna(subset=[f"_f_{c}" for c in cols])
    df = O.with_totals(df, ["mmsi"], {"_steps": F.sum((F.col("_stop") - F.col("bin")) / step_s + 1)}).filter(F.col("_steps") >= min_rows)
    return _expanded(df, step_s).select("mmsi", F.timestamp_seconds("at").alias("time"), *[F.col(f"_f_{c}").alias(c) for c in cols])


def _reversed(df: DataFrame) -> DataFrame:
    """Let chunks run the other way, for values still to come."""
    return df.withColumn(O.CHUNK, -F.col(O.CHUNK)) if O.is_chunked(df) else df


def resample_linear(df: DataFrame, cols: Sequence[str] = ("lat", "lon", "sog"),
                    step_s: int = 60) -> DataFrame:
    """First value per step, straight lines between them, ends held.

    A report knows the last value up to it and the first one after it, and stands for the steps between.
    """
    df = _first_values(df, cols, step_s)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("bin").alias("t"), F.col(c).alias("v"))) for c in cols}
    back = _reversed(df.withColumn("_back", -F.col("bin")))
    df = _reversed(O.with_running(back, lasts={f"_b_{c}": k for c, k in known.items()}, order=["_back"]))
    df = O.with_running(df, lasts={f"_a_{c}": k for c, k in known.items()}, order=["bin"])
    df = _with_stop(df, step_s, [f"_b_{c}" for c in cols])
    ends = {f"_{e}{f}_{c}": of[f] for c in cols for e, of in (("a", F.col(f"_a_{c}")), ("b", F.col(f"next._b_{c}"))) for f in "tv"}
    df = _expanded(df.select("mmsi", "bin", "_stop", *cols, *[v.alias(k) for k, v in ends.items()]), step_s)
    out = {}
    for c in cols:
        at, av, bt, bv = (F.col(f"_{e}_{c}") for e in ("at", "av", "bt", "bv"))
        line = av + (bv - av) * ((F.col("at") - at) / F.nullif(bt - at, F.lit(0)))
        out[c] = F.coalesce(F.when(F.col("at") == F.col("bin"), F.col(c)), line, av, bv)
    return df.select("mmsi", F.timestamp_seconds("at").alias("time"), *[v.alias(c) for c, v in out.items()])


def interpolate_pair(lat1: Column, lon1: Column, t1: Column, lat2: Column, lon2: Column,
                     t2: Column, at: Column) -> tuple[Column, Column]:
    """Straight-line position between two fixes; NULL outside them or on missing input."""
    span = times.seconds_between(t2, t1)
    share = F.when(span == 0, 0.0).otherwise(times.seconds_between(at, t1) / span)
    usable = at.between(t1, t2) & lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return (F.when(usable, lat1 + (lat2 - lat1) * share), F.when(usable, lon1 + (lon2 - lon1) * share))


def positions_at(fixes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Position of each (mmsi, query_id, time) of ``wanted``, from the fixes around it."""
    f = fixes.select("mmsi", "time", F.col("event_id").alias("_id"), "lat", "lon", F.lit(0).alias("_q"),
                     F.lit(None).cast("long").alias("query_id"))
    q = wanted.select("mmsi", "time", F.lit(None).cast("long").alias("_id"), F.lit(None).cast("double").alias("lat"),
                      F.lit(None).cast("double").alias("lon"), F.lit(1).alias("_q"), "query_id")
    both = f.unionByName(q)
    both = O.chunked(both) if O.is_chunked(fixes) else both
    fix = F.when(F.col("_q") == 0, F.struct("time", "lat", "lon"))
    both = O.with_running(both, lasts={"_a": fix}, order=["time", "_q", "_id", "query_id"])
    both = both.withColumns({"_back": -F.unix_micros("time"), "_back_id": -F.col("_id")})
    # a fix at the very instant counts as the one after as well
    back = O.with_running(_reversed(both), lasts={"_b": fix}, order=["_back", "_q", "_back_id", "query_id"])
    lat, lon = interpolate_pair(F.col("_a.lat"), F.col("_a.lon"), F.col("_a.time"),
                                F.col("_b.lat"), F.col("_b.lon"), F.col("_b.time"), F.col("time"))
    return back.filter(F.col("_q") == 1).select("mmsi", "query_id", "time", lat.alias("lat"), lon.alias("lon"))


def track_lengths(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Length, end-to-end displacement and mean speed per track.

    Needs ``prev`` and ``starts_segment`` as :func:`with_segments` leaves them.
    """
    hop = F.when(F.col("starts_segment"), 0.0).otherwise(
        geo.haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")))
    at, place = F.struct(*O.ORDER), F.struct("lat", "lon")
    ends = df.groupBy(*keys).agg(
        F.sum(hop).alias("length_km"), F.min_by(place, at).alias("a"), F.max_by(place, at).alias("b"),
        F.min("time").alias("lo"), F.max("time").alias("hi"), F.count("*").alias("points"))
    hours = times.seconds_between(F.col("hi"), F.col("lo")) / 3600
    hours = F.when(hours > 0, hours)
    return ends.select(
        *keys, "points", "length_km",
        geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("displacement_km"),
        F.coalesce(F.col("length_km") / hours, F.lit(0.0)).alias("mean_speed_kmh"))


def track_summaries(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    seconds = times.seconds_between(F.max("time"), F.min("time"))
    return df.groupBy(*keys).agg(
        (seconds / 3600).alias("duration_h"),
        (seconds / F.nullif(F.count("*") - 1, F.lit(0))).alias("mean_dt_s"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
