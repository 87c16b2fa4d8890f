"""Per-row features from neighbouring rows, windows cut for training, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions import geo, times
from wakeline.functions.pin import pinned
from wakeline.operators import ordered as O

SEGMENT = ("mmsi", "segment_id")
MOTION = ("lat", "lon", "sog", "cog")


def step_features(segments: DataFrame) -> DataFrame:
    """Distance, bearing, speed, course and turn features from the fix before.

    Expects :func:`tracks.with_segments` output.  ``time_diff`` is the vessel's
    gap, so a segment's first row shows it while its deltas are NULL.
    """
    inside = ~F.col("starts_segment")
    prev = lambda c: F.when(inside, F.col(f"prev.{c}"))
    here = (F.col("lat"), F.col("lon"))
    before = (prev("lat"), prev("lon"))
    minutes = F.nullif(F.col("time_diff") / 60, F.lit(0.0))
    df = pinned(segments, {
        "distance_km": F.when(inside, geo.haversine_km(*before, *here)).otherwise(0.0),
        "bearing": geo.bearing_deg(*before, *here),
        "speed_delta": F.col("sog") - prev("sog"),
        "course_delta": geo.angle_delta(F.col("cog") - prev("cog")),
    })
    return df.withColumns({
        "distance_nm": F.col("distance_km") / geo.KM_PER_NM,
        "acceleration": F.col("speed_delta") / minutes,
        "turn_rate": F.col("course_delta") / minutes,
        "course_drift": geo.circular_error(F.col("heading"), F.col("cog")),
        "bearing_deviation": geo.circular_error(F.col("bearing"), F.col("cog")),
    })


def drop_outliers(steps: DataFrame, max_knots: float = 75.0, max_acceleration: float = 2.0,
                  max_turn: float = 30.0) -> DataFrame:
    """Drop impossible steps; at near-zero speed a course change means nothing."""
    long_enough = F.col("segment_points") >= 3
    knots = F.when(F.col("time_diff") > 0, F.col("distance_nm") / (F.col("time_diff") / 3600))
    bad = (F.coalesce(knots > max_knots, F.lit(False))
           | F.coalesce(F.abs("acceleration") > max_acceleration, F.lit(False))
           | F.coalesce(F.abs("turn_rate") > max_turn, F.lit(False)))
    drifting = F.coalesce(long_enough & (F.col("sog") < 0.5) & (F.abs("course_delta") > 5), F.lit(False))
    kept = steps.filter(~(long_enough & bad))
    return kept.withColumns({c: F.when(drifting, 0.0).otherwise(F.col(c)) for c in ("course_delta", "turn_rate")})


def movement_features(df: DataFrame, wrap: bool = True) -> DataFrame:
    """Speed and course change and distance to the vessel's previous row."""
    df = O.with_previous(df, MOTION)
    turn = F.col("cog") - F.col("prev.cog")
    hop = geo.haversine_nm(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    return O.unchunked(df.withColumns({
        "speed_change": F.coalesce(F.col("sog") - F.col("prev.sog"), F.lit(0.0)),
        "course_change": F.coalesce(geo.angle_delta(turn) if wrap else turn, F.lit(0.0)),
        "distance_nm": F.coalesce(hop, F.lit(0.0)),
    }).drop("prev"))


def simple_diffs(df: DataFrame, cols: Sequence[str] = MOTION) -> DataFrame:
    df = O.with_previous(df, cols)
    return O.unchunked(df.withColumns(
        {f"d_{c}": F.coalesce(F.col(c) - F.col(f"prev.{c}"), F.lit(0.0)) for c in cols}).drop("prev"))


def grid_velocities(df: DataFrame, step_s: float = 60.0, legacy: bool = False) -> DataFrame:
    """North and east speed in m/s from the previous row.

    ``legacy`` keeps the older degree-based scaling by 1852/3600.
    """
    df = O.with_previous(df, ["time", "lat", "lon"])
    dt = F.coalesce(times.seconds_between(F.col("time"), F.col("prev.time")), F.lit(step_s))
    dt = F.when(dt > 0, dt).otherwise(1e-6)
    dlat = F.coalesce(F.col("lat") - F.col("prev.lat"), F.lit(0.0))
    dlon = F.coalesce(F.col("lon") - F.col("prev.lon"), F.lit(0.0))
    if legacy:
        north, east = dlat / dt * (1852 / 3600), dlon / dt * (1852 / 3600)
    else:
        north, east = dlat * geo.M_PER_DEG / dt, dlon * geo.metres_per_lon_degree(F.col("lat")) / dt
    return O.unchunked(df.withColumns({"v_north": north, "v_east": east}).drop("prev"))


def _local_motion(df: DataFrame, keys: Sequence[str], after: int) -> DataFrame:
    """Local metres and first and second differences; bordering rows still in."""
    df = O.with_totals(df, keys, {"_lat0": F.avg("lat"), "_lon0": F.avg("lon")})
    x, y = geo.to_local(F.col("lat"), F.col("lon"), F.col("_lat0"), F.col("_lon0"))
    df = O.with_margins(df.withColumns({"x": x, "y": y}).drop("_lat0", "_lon0"), before=2, after=after, keys=keys)
    w = O.frame_window(df, keys)
    gap = times.seconds_between(F.col("time"), F.lag("time").over(w))
    dt = F.when(F.col("dt_s") > 0, F.col("dt_s")).otherwise(1e-6)
    step = lambda c: (F.col(c) - F.lag(c).over(w)) / dt
    df = df.withColumn("dt_s", gap).withColumns({"vx": step("x"), "vy": step("y")})
    df = df.withColumns({
        "speed_mps": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")),
        "track_heading": F.pmod(F.degrees(F.atan2("vx", "vy")), F.lit(360.0)),
        "ax": step("vx"), "ay": step("vy"),
    })
    turn = geo.angle_delta(F.col("track_heading") - F.lag("track_heading").over(w))
    return df.withColumn("turn_deg_s", turn / dt)


def local_motion(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Metres around the track centroid, velocity, acceleration, heading, turn rate."""
    return O.unchunked(O.drop_margins(_local_motion(df, keys, after=0)))


def plausibility(df: DataFrame, keys: Sequence[str] = SEGMENT, max_speed: float = 25.7,
                 max_acceleration: float = 0.5, max_gap_s: float = 3600.0) -> DataFrame:
    """Mark fixes touched by an impossible speed, acceleration or long gap.

    A fast step spoils both its ends, an acceleration its three fixes, a gap the
    later fix.
    """
    df = _local_motion(df, keys, after=2)
    w = O.frame_window(df, keys)
    flag = lambda c: F.coalesce(c, F.lit(False))
    df = df.withColumns({
        "fast": flag(F.col("speed_mps") > max_speed),
        "jerky": flag(F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")) > max_acceleration),
        "gap": flag(F.col("dt_s") > max_gap_s),
    })
    ahead = lambda c, k: flag(F.lead(c, k).over(w))
    bad = (F.col("fast") | F.col("jerky") | F.col("gap")
           | ahead("fast", 1) | ahead("jerky", 1) | ahead("jerky", 2))
    return O.unchunked(O.drop_margins(df.withColumn("plausible", ~bad)))


def plausibility_report(marked: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    n = F.count("*")
    return marked.groupBy(*keys).agg(
        n.alias("total_points"), F.count_if("fast").alias("invalid_speed"),
        F.count_if("jerky").alias("invalid_acceleration"), F.count_if("gap").alias("time_gaps"),
        F.count_if("plausible").alias("valid_points"),
        (F.count_if("plausible") / n).alias("validity_rate"))


def vessel_statistics(df: DataFrame) -> DataFrame:
    """Whole-vessel speed and course spread and mean turn on every row."""
    df = O.with_previous(df, ["cog"])
    turn = F.abs(geo.angle_delta(F.col("cog") - F.col("prev.cog")))
    df = O.with_totals(df.withColumn("_turn", turn).drop("prev"), ["mmsi"], {
        "sog_mean": F.avg("sog"), "sog_std": F.stddev_samp("sog"),
        "cog_std": F.stddev_samp("cog"), "turn_mean": F.avg("_turn")})
    return O.unchunked(df.drop("_turn"))


def rolling_mean_std(df: DataFrame, cols: Sequence[str] = ("sog", "cog"), rows: int = 5) -> DataFrame:
    df = O.with_margins(df, before=rows - 1)
    w = O.frame_window(df).rowsBetween(-(rows - 1), 0)
    out = {}
    for c in cols:
        out[f"{c}_mean_{rows}"], out[f"{c}_std_{rows}"] = F.avg(c).over(w), F.stddev_samp(c).over(w)
    return O.unchunked(O.drop_margins(df.withColumns(out)))


def rolling_statistics(df: DataFrame, cols: Sequence[str] = MOTION, rows: int = 5,
                       keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Trailing mean, spread, extremes, median and slope per column."""
    df = O.with_positions(df, keys, out="_pos")
    df = O.with_margins(df, before=rows - 1, keys=keys)
    w = O.frame_window(df, keys).rowsBetween(-(rows - 1), 0)
    out = {}
    for c in cols:
        out |= {
            f"{c}_mean": F.avg(c).over(w), f"{c}_std": F.stddev_pop(c).over(w),
            f"{c}_min": F.min(c).over(w), f"{c}_max": F.max(c).over(w),
            f"{c}_median": F.percentile(c, F.lit(0.5)).over(w),
            f"{c}_slope": F.coalesce(F.regr_slope(F.col(c), F.col("_pos").cast("double")).over(w), F.lit(0.0)),
        }
    return O.unchunked(O.drop_margins(df.withColumns(out))).drop("_pos")


def design_matrix(df: DataFrame, cols: Sequence[str] = MOTION, keys: Sequence[str] = SEGMENT,
                  lags: Sequence[int] = (1, 2, 3), windows: Sequence[int] = (3, 5, 10),
                  horizons: Sequence[int] = (1,)) -> DataFrame:
    """Lag, difference and rolling features plus delta targets, one row per step with enough history.

    A target beyond the end of the track is NULL; its row still serves shorter
    horizons and forecasts.
    """
    df = O.with_positions(df, keys)
    df = O.with_margins(df, before=max(max(lags), max(windows) - 1), after=max(horizons), keys=keys)
    w = O.frame_window(df, keys)
    out = {}
    for c in cols:
        out |= {f"{c}_lag{k}": F.lag(c, k, 0.0).over(w) for k in lags}
        out[f"{c}_diff"] = F.coalesce(F.col(c) - F.lag(c, 1).over(w), F.lit(0.0))
        for r in windows:
            frame = w.rowsBetween(-(r - 1), 0)
            out |= {f"{c}_mean{r}": F.avg(c).over(frame), f"{c}_std{r}": F.stddev_pop(c).over(frame)}
        out |= {f"{c}_t{h}": F.lead(c, h).over(w) - F.col(c) for h in horizons}
    df = O.drop_margins(df.withColumns(out))
    return O.unchunked(df.filter(F.col("position") >= max(lags)))


def horizon_targets(df: DataFrame, horizon: int, cols: Sequence[str] = ("lat", "lon"),
                    keys: Sequence[str] = SEGMENT, deltas: bool = True) -> DataFrame:
    """Value (or change) h rows ahead for every h up to the horizon."""
    df = O.with_margins(df, after=horizon, keys=keys)
    w = O.frame_window(df, keys)
    out = {f"{c}_h{h}": F.lead(c, h).over(w) - (F.col(c) if deltas else 0.0)
           for c in cols for h in range(1, horizon + 1)}
    return O.unchunked(O.drop_margins(df.withColumns(out)))


def _gradient(c: str, w) -> Column:
    behind, ahead = F.lag(c).over(w), F.lead(c).over(w)
    return (F.when(behind.isNull(), ahead - F.col(c)).when(ahead.isNull(), F.col(c) - behind)
            .otherwise((ahead - behind) / 2))


def kinematic_features(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    df = O.with_margins(df, before=1, after=1, keys=keys)
    w = O.frame_window(df, keys)
    df = df.withColumns({
        "acceleration": _gradient("sog", w),
        "turn": F.coalesce(geo.angle_delta(F.col("cog") - F.lag("cog").over(w)), F.lit(0.0)),
        "sog_sin_cog": F.col("sog") * F.sin(F.radians("cog")),
    })
    return O.unchunked(O.drop_margins(df))


def interaction_features(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    df = O.with_margins(df, before=1, after=1, keys=keys)
    w = O.frame_window(df, keys)
    df = df.withColumns({
        "vx": F.col("sog") * F.cos(F.radians("cog")), "vy": F.col("sog") * F.sin(F.radians("cog")),
        "lat_change": _gradient("lat", w), "lon_change": _gradient("lon", w),
    })
    return O.unchunked(O.drop_margins(df))


def spatial_context(segments: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Distance to the track centroid, spread and distance covered so far.

    Expects ``prev`` and ``starts_segment`` from :func:`tracks.with_segments`.
    """
    df = O.with_totals(segments, keys, {
        "_lat0": F.avg("lat"), "_lon0": F.avg("lon"),
        "spread_lat": F.stddev_pop("lat"), "spread_lon": F.stddev_pop("lon")})
    dlat, dlon = F.col("lat") - F.col("_lat0"), F.col("lon") - F.col("_lon0")
    hop = F.when(F.col("starts_segment"), 0.0).otherwise(
        geo.haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")))
    df = df.withColumn("centroid_distance", F.sqrt(dlat * dlat + dlon * dlon)).drop("_lat0", "_lon0")
    return O.unchunked(O.with_running(df, sums={"cumulative_km": hop}, keys=keys))


def area_centre_distance(df: DataFrame) -> DataFrame:
    """Distance in NM to the table's mean position (one aggregate row)."""
    centre = df.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).first()
    return df.withColumn("centre_nm", geo.haversine_nm(
        F.col("lat"), F.col("lon"), F.lit(centre["lat"]), F.lit(centre["lon"])))


def sequences(df: DataFrame, length: int, horizon: int, inputs: Sequence[str] = MOTION,
              targets: Sequence[str] = MOTION, keys: Sequence[str] = ("mmsi",),
              stride: int = 1) -> DataFrame:
    """Every window of ``length`` rows with the ``horizon`` rows after it.

    Rows stay rows: one output row per window, holding array columns.
    """
    if stride > 1:
        df = O.with_positions(df, keys, out="_pos")
    df = O.with_margins(df, after=length + horizon - 1, keys=keys)
    w = O.frame_window(df, keys).rowsBetween(0, length + horizon - 1)
    packed = F.struct("time", *[c for c in dict.fromkeys([*inputs, *targets])])
    df = O.drop_margins(df.withColumn("_all", F.collect_list(packed).over(w)))
    df = df.filter(F.size("_all") == length + horizon)
    if stride > 1:
        df = df.filter(F.col("_pos") % stride == 0).drop("_pos")
    pick = lambda cols: lambda s: F.struct(*[s[c].alias(c) for c in cols])
    return df.select(
        *keys, F.col("event_id").alias("sample_id"), F.col("time").alias("start_time"),
        F.transform(F.slice("_all", 1, length), pick(["time", *inputs])).alias("input"),
        F.transform(F.slice("_all", length + 1, horizon), pick(["time", *targets])).alias("target"))


def reconstruction_windows(df: DataFrame, length: int, cols: Sequence[str] = MOTION,
                           keys: Sequence[str] = ("mmsi",)) -> DataFrame:
    return sequences(df, length, 0, cols, cols, keys).withColumn("target", F.col("input"))


def label_windows(df: DataFrame, length: int, labels: Sequence[str], cols: Sequence[str] = MOTION,
                  keys: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Windows whose target is the labels of their last row."""
    wins = sequences(df, length, 0, [*cols, *labels], (), keys)
    last = F.element_at("input", -1)
    return wins.withColumns({c: last[c] for c in labels}).drop("target")


def integrate_deltas(deltas: DataFrame, keys: Sequence[str] = ("sample_id",),
                     cols: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Absolute positions from per-step changes (``d_*``) and the last fix (``last_*``).

    A sample has at most one forecast horizon of steps, so a plain window will do.
    """
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumns({c: F.col(f"last_{c}") + F.sum(f"d_{c}").over(w) for c in cols})


def z_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    return df.withColumns({f"{c}_z": (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] + 1e-8) for c in cols})


def fit_scaler(train: DataFrame, cols: Sequence[str]):
    """Standard scaler fitted on the training rows; apply with :func:`apply_scaler`."""
    packed = VectorAssembler(inputCols=list(cols), outputCol="_vec", handleInvalid="skip")
    return StandardScaler(inputCol="_vec", outputCol="_scaled", withMean=True, withStd=True).fit(packed.transform(train))


def apply_scaler(model, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scaled copies of the columns; a column without spread is only centred."""
    means, stds = model.mean.toArray(), model.std.toArray()
    return df.withColumns({f"{c}_scaled": (F.col(c) - float(m)) / float(s if s > 0 else 1.0)
                           for c, m, s in zip(cols, means, stds)})


def message_intervals(df: DataFrame) -> DataFrame:
    """Minutes since the vessel's previous message."""
    df = O.with_previous(df, ["time"])
    return O.unchunked(df.withColumn(
        "interval_min", times.seconds_between(F.col("time"), F.col("prev.time")) / 60).drop("prev"))


def interval_histogram(df: DataFrame, upper: float = 60.0, bins: int = 60) -> DataFrame:
    gaps = message_intervals(df).filter(F.col("interval_min").between(0, upper))
    index = F.least(F.floor(F.col("interval_min") / (upper / bins)), F.lit(bins - 1))
    return gaps.groupBy(index.alias("bin")).agg(F.count("*").alias("n"))


def behaviour_windows(steps: DataFrame, rows: int = 10, sharp_turn: float = 10.0) -> DataFrame:
    """Trailing speed and turning behaviour plus turn radius and leg angle per row."""
    speed_mps = F.col("sog") * geo.KNOTS_TO_MPS
    turn_rad_s = F.radians(F.abs("turn_rate")) / 60
    df = steps.withColumn("turn_radius_m", speed_mps / F.nullif(turn_rad_s, F.lit(0.0)))
    df = O.with_margins(df.drop("prev"), before=rows - 1, after=1, keys=SEGMENT)
    w = O.frame_window(df, SEGMENT)
    frame = w.rowsBetween(-(rows - 1), 0)
    sharp = F.when(F.abs("course_delta") > sharp_turn, 1).otherwise(0)
    df = df.withColumns({
        "mean_speed": F.avg("sog").over(frame), "max_speed": F.max("sog").over(frame),
        "std_speed": F.stddev_samp("sog").over(frame), "sharp_turns": F.sum(sharp).over(frame),
        "leg_angle": geo.circular_error(F.lead("bearing").over(w), F.col("bearing")),
    })
    return O.unchunked(O.drop_margins(df))


def turn_per_length(df: DataFrame) -> DataFrame:
    """Turn rate per metre of ship length."""
    return df.withColumn("turn_per_metre", F.abs("turn_rate") / F.nullif(F.col("length"), F.lit(0)))
