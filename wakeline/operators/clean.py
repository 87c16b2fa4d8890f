"""Projections and filters that turn raw records into usable reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wakeline import schema as S
from wakeline.functions import codes, geo, times
from wakeline.operators import ordered as O


def rename_aliases(df: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Legacy and log field names to canonical ones (never over an existing column)."""
    table = S.LOG_ALIASES | S.TABLE_ALIASES if table is None else table
    wanted = {old: new for old, new in table.items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(wanted)


def null_sentinels(df: DataFrame, nav_status: bool = False) -> DataFrame:
    table = dict(S.SENTINELS, **({"nav_status": 15} if nav_status else {}))
    return df.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in table.items() if c in df.columns})


def null_out_of_range(df: DataFrame) -> DataFrame:
    """lat/lon outside their bounds, or sog negative or at its ceiling, become NULL."""
    lat, lon, sog = F.col("lat"), F.col("lon"), F.col("sog")
    return df.withColumns({
        "lat": F.when(lat.between(*S.RANGES["lat"]), lat),
        "lon": F.when(lon.between(*S.RANGES["lon"]), lon),
        "sog": F.when((sog >= 0) & (sog < S.RANGES["sog"][1]), sog),
    })


def with_message_class(df: DataFrame, coding: str = "basic") -> DataFrame:
    pick = codes.basic_class if coding == "basic" else codes.task_class
    return df.withColumn("msg_class", pick(F.col("msg_type")))


def with_node_type(df: DataFrame) -> DataFrame:
    vessel = F.col("node_type").isin("vessel_a", "vessel_b")
    return df.withColumn("node_type", codes.node_type(F.col("msg_class"))).withColumn(
        "has_temporal_edge", vessel)


def valid_mmsi(mmsi: Column, rule: str = "strict") -> Column:
    ship = mmsi.between(100_000_000, 799_999_999)
    if rule == "strict":
        return ship
    if rule == "wide":
        return ship | mmsi.between(2_000_000, 9_999_999) | mmsi.between(990_000_000, 999_999_999)
    if rule == "text":
        return mmsi.cast("string").rlike(r"^(?!00|99)\d{9}$")
    raise ValueError(f"unknown rule {rule!r}")


def valid_position(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & (lat != 91.0) & (lon != 181.0), F.lit(False))


def filter_positions(df: DataFrame) -> DataFrame:
    return df.filter(valid_position(F.col("lat"), F.col("lon")))


def repair_motion(df: DataFrame) -> DataFrame:
    """Unusable sog and cog become 0; two flags say which were repaired."""
    sog, cog = F.col("sog"), F.col("cog")
    ok_sog = F.coalesce(sog.between(0, 50) & (F.abs(sog - 102.3) > 0.1), F.lit(False))
    ok_cog = F.coalesce((cog >= 0) & (cog < 360), F.lit(False))
    return df.withColumns({
        "sog_repaired": ~ok_sog, "cog_repaired": ~ok_cog,
        "sog": F.when(ok_sog, sog).otherwise(0.0),
        "cog": F.when(ok_cog, cog).otherwise(0.0),
    })


def clean(df: DataFrame, rule: str = "strict") -> DataFrame:
    """Sentinels and ranges to NULL, then rows without position or valid MMSI go."""
    df = null_out_of_range(null_sentinels(df))
    return df.dropna(subset=["lat", "lon"]).filter(valid_mmsi(F.col("mmsi"), rule))


def select_area(df: DataFrame, box: tuple[float, float, float, float] | None = None,
                start=None, end=None, ship_types: Sequence[int] | None = None) -> DataFrame:
    """Inclusive bounding box (lat0, lat1, lon0, lon1), time range and ship types."""
    if box is not None:
        df = df.filter(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))
    if start is not None:
        df = df.filter(F.col("time") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("time") <= F.lit(end))
    if ship_types:
        df = df.filter(F.col("ship_type").isin(*ship_types))
    return df


def for_task(df: DataFrame, task: str) -> DataFrame:
    kept = S.TASKS[task]["classes"]
    return df if kept is None else df.filter(F.col("msg_class").isin(*kept))


def moving(df: DataFrame, low: float = 0.5, high: float = 50.0) -> DataFrame:
    return df.filter((F.col("sog") > low) & (F.col("sog") < high))


def drop_implied_speeding(df: DataFrame, max_knots: float = 50.0) -> DataFrame:
    """Drop rows whose speed from the preceding row is beyond the limit."""
    df = O.with_previous(df, ["time", "lat", "lon"])
    hours = times.seconds_between(F.col("time"), F.col("prev.time")) / 3600
    nm = geo.haversine_nm(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    df = df.withColumn("implied_knots", F.when(hours > 0, nm / hours)).drop("prev")
    return O.unchunked(df.filter(F.col("implied_knots").isNull() | (F.col("implied_knots") <= max_knots)))


def drop_duplicates(df: DataFrame, seq: str = "event_id") -> DataFrame:
    """One row per (mmsi, time): the first received.

    An aggregate, so repeated copies collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in ("mmsi", "time")]
    first = F.min_by(F.struct(*rest), F.col(seq)).alias("_first")
    return df.groupBy("mmsi", "time").agg(first).select(
        *[F.col(c) if c in ("mmsi", "time") else F.col(f"_first.{c}").alias(c) for c in df.columns])


def clip_stationary(df: DataFrame, below: float = 0.5) -> DataFrame:
    return df.withColumn("sog", F.when(F.col("sog") < below, 0.0).otherwise(F.col("sog")))


def collapse_jitter(df: DataFrame, radius_m: float = 50.0, below: float = 0.5) -> DataFrame:
    """Runs of stationary fixes, each within the radius of the one before, become one point."""
    df = O.with_previous(df, ["lat", "lon", "sog"])
    near = 1000 * geo.haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")) <= radius_m
    same = F.coalesce(near & (F.col("sog") < below) & (F.col("prev.sog") < below), F.lit(False))
    df = O.with_running(df.withColumn("_same", same), sums={"run": F.when(F.col("_same"), 0).otherwise(1)})
    return df.groupBy("mmsi", "run").agg(
        F.min("time").alias("time"), F.max("time").alias("end_time"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.count("*").alias("fixes"),
    )


def smooth(df: DataFrame, rows: int = 5, how: str = "median") -> DataFrame:
    """Trailing median or mean of lat/lon over at most ``rows`` fixes."""
    df = O.with_margins(df, before=rows - 1)
    w = O.frame_window(df).rowsBetween(-(rows - 1), 0)
    pick = (lambda c: F.percentile(c, F.lit(0.5))) if how == "median" else F.avg
    df = df.withColumns({f"{c}_smooth": pick(F.col(c)).over(w) for c in ("lat", "lon")})
    return O.unchunked(O.drop_margins(df))


def rule_anomalies(df: DataFrame) -> DataFrame:
    """Speed, course, jump and own-behaviour anomaly flags per row."""
    df = O.with_previous(df, ["lat", "lon", "cog"])
    df = O.with_totals(df, ["mmsi"], {"_mean": F.avg("sog"), "_std": F.stddev_samp("sog")})
    turn = geo.circular_error(F.col("cog"), F.col("prev.cog"))
    jump = geo.haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    no = F.lit(False)
    return O.unchunked(df.withColumns({
        "speed_anomaly": F.coalesce((F.col("sog") > 30) | (F.col("sog") < 0), no),
        "course_anomaly": F.coalesce(turn > 90, no),
        "position_jump": F.coalesce(jump > 10, no),
        "speed_deviation": (F.col("sog") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0)),
    }).drop("prev", "_mean", "_std"))
