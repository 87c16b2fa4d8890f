"""Closest approach, rules of the road and collision features over row pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions import codes, geo
from wakeline.functions.pin import pinned
from wakeline.operators import proximity as P
from wakeline.session import saved

INF = float("inf")
STILL = 1e-10  # squared relative speed below which two vessels keep their distance


def with_cpa(pairs: DataFrame) -> DataFrame:
    """Closest approach of each pair, in metres and seconds, on a plane at the first vessel."""
    dx, dy = geo.to_local(F.col("other_lat"), F.col("other_lon"), F.col("lat"), F.col("lon"))
    v1, v2 = geo.knots_to_mps(F.col("sog")), geo.knots_to_mps(F.col("other_sog"))
    vx1, vy1 = geo.velocity_east(v1, F.col("cog")), geo.velocity_north(v1, F.col("cog"))
    vx2, vy2 = geo.velocity_east(v2, F.col("other_cog")), geo.velocity_north(v2, F.col("other_cog"))
    df = pairs.withColumns({"_dx": dx, "_dy": dy, "_vx1": vx1, "_vy1": vy1, "_vx2": vx2, "_vy2": vy2})
    df = df.withColumns({"_dvx": F.col("_vx2") - F.col("_vx1"), "_dvy": F.col("_vy2") - F.col("_vy1")})
    rel2 = F.col("_dvx") * F.col("_dvx") + F.col("_dvy") * F.col("_dvy")
    along = F.col("_dx") * F.col("_dvx") + F.col("_dy") * F.col("_dvy")
    df = df.withColumn("_rel2", rel2)
    df = df.withColumn("tcpa_s", F.when(F.col("_rel2") < STILL, 0.0).otherwise(-along / F.nullif(F.col("_rel2"), F.lit(0.0))))
    t = F.col("tcpa_s")
    ex, ey = F.col("_dx") + F.col("_dvx") * t, F.col("_dy") + F.col("_dvy") * t
    lat1, lon1 = geo.from_local(F.col("_vx1") * t, F.col("_vy1") * t, F.col("lat"), F.col("lon"))
    lat2, lon2 = geo.from_local(F.col("_dx") + F.col("_vx2") * t, F.col("_dy") + F.col("_vy2") * t, F.col("lat"), F.col("lon"))
    df = pinned(df, {
        "cpa_m": F.sqrt(ex * ex + ey * ey), "tcpa_s": t,
        "motion": F.when(F.col("_rel2") < STILL, "parallel").when(t > 0, "approaching").otherwise("receding"),
        "cpa_lat": lat1, "cpa_lon": lon1, "other_cpa_lat": lat2, "other_cpa_lon": lon2,
        "relative_knots": F.sqrt(F.col("_rel2")) / geo.KNOTS_TO_MPS,
    })
    df = df.withColumn("warning", codes.cpa_warning(F.col("cpa_m"), F.col("tcpa_s")))
    return df.drop("_dx", "_dy", "_vx1", "_vy1", "_vx2", "_vy2", "_dvx", "_dvy", "_rel2")


#: What closest approach needs of a row.
MOTION = ("event_id", "mmsi", "lat", "lon", "sog", "cog")


def _usable(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["lat", "lon", "sog", "cog"])


def _positive(column: str) -> Column:
    """The least value of a summary, NULL if there is none."""
    return F.when(F.min(column) < INF, F.min(column))


def collision_features(df: DataFrame, radius_nm: float = 10.0, same_vessel: bool = False) -> DataFrame:
    """Per row: lowest CPA, soonest TCPA, neighbours, motion against the lowest-CPA one."""
    near = P.near_summaries(_usable(df), radius_nm, same_vessel=same_vessel, state=MOTION, pick="worst")
    pairs = with_cpa(near)
    toward = geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon"))
    worst = F.min_by(F.struct(F.col("relative_knots").alias("v"), toward.alias("b")), F.struct("cpa_m", "other_event_id"))
    per_row = pairs.groupBy("event_id").agg(
        F.min("cpa_m").alias("min_cpa"), _positive("tcpa_min").alias("min_tcpa"),
        F.sum("n").alias("num_nearby"), worst.alias("_w"))
    out = df.join(per_row, "event_id", "left")
    return out.withColumns({
        "min_cpa": F.coalesce("min_cpa", F.lit(INF)), "min_tcpa": F.coalesce("min_tcpa", F.lit(INF)),
        "num_nearby": F.coalesce("num_nearby", F.lit(0)),
        "relative_speed": F.coalesce("_w.v", F.lit(0.0)), "relative_bearing": F.coalesce("_w.b", F.lit(0.0)),
    }).drop("_w")


def collision_targets(features: DataFrame) -> DataFrame:
    """Risk ladder and time to collision."""
    return features.withColumns({
        "collision_risk": codes.collision_risk(F.col("min_cpa"), F.col("min_tcpa")),
        "time_to_collision": F.col("min_tcpa")})


def edge_features(df: DataFrame, radius_nm: float = 10.0, same_vessel: bool = False) -> DataFrame:
    near = P.near_summaries(_usable(df), radius_nm, same_vessel=same_vessel, state=MOTION, measured=True)
    return near.groupBy("event_id").agg(
        (F.sum("distance_sum") / F.sum("n")).alias("avg_distance"), F.min("distance_min").alias("min_distance"),
        (F.sum("knots_sum") / F.sum("n")).alias("avg_relative_velocity"),
        _positive("tcpa_min").alias("min_tcpa"), F.sum("n").alias("degree"))


def graph_features(df: DataFrame, radius_nm: float = 10.0, bucket_s: int = 60, min_rows: int = 3,
                   same_vessel: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Density, mean degree and mean local clustering of each bucket's proximity graph.

    ``among``: the rows that may have edges, if not all.  Triangles are counted block by block in arrays
    (:func:`proximity.near_triangles`); buckets in which row numbers repeat go by :func:`_edge_clustering`.
    """
    bucket = F.floor(F.unix_micros("time") / F.lit(bucket_s * 1_000_000)) * bucket_s
    nodes = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows)
    rows = (df if among is None else among).withColumn("bucket", bucket)
    repeated = saved(rows.dropna(subset=["bucket", "event_id"]).groupBy("bucket", "event_id").agg(F.count("*").alias("n")).filter(
        "n > 1").select("bucket").distinct(), "repeated")
    if repeated.isEmpty():
        per_bucket = P.near_triangles(rows, radius_nm, bucket_s, same_vessel)
    else:
        per_bucket = P.near_triangles(rows.join(repeated, "bucket", "left_anti"), radius_nm, bucket_s, same_vessel).unionByName(
            _edge_clustering(rows.join(repeated, "bucket", "left_semi"), radius_nm, bucket_s, same_vessel))
    n = F.col("n")
    return nodes.join(per_bucket, "bucket", "left").select(
        "bucket", "n", (F.coalesce("ends", F.lit(0)) / (n * (n - 1))).alias("density"),
        (F.coalesce("ends", F.lit(0)) / n).alias("avg_degree"), (F.coalesce("c", F.lit(0.0)) / n).alias("clustering"))


def _edge_clustering(df: DataFrame, radius_nm: float, bucket_s: int, same_vessel: bool) -> DataFrame:
    """The sums of :func:`proximity.near_triangles` from lists of edges, where row numbers may repeat.

    Each edge points from its lower-degree end, so a row keeps at most
    sqrt(2 * edges of its bucket) out-neighbours; triangles come from
    intersecting those short lists, never from all pairs of neighbours.
    """
    ends = [F.col("bucket"), F.col("event_id").alias("u"), F.col("other_event_id").alias("v")]
    # the pair join is the costly part and its result is used several times
    pairs = P.near_pairs(df, radius_nm, bucket_s, same_vessel, state=("event_id", "mmsi", "time", "lat", "lon"))
    edges = saved(pairs.select(*ends), "edges")
    degree = edges.groupBy("bucket", "u").agg(F.count("*").alias("d"))
    both = edges.join(degree, ["bucket", "u"]).join(
        degree.select("bucket", F.col("u").alias("v"), F.col("d").alias("dv")), ["bucket", "v"])
    upward = both.filter(F.struct("d", "u") < F.struct(F.col("dv").alias("d"), F.col("v").alias("u"))).select("bucket", "u", "v")
    out = upward.groupBy("bucket", "u").agg(F.collect_list("v").alias("out"))
    meet = upward.join(out, ["bucket", "u"]).join(
        out.select("bucket", F.col("u").alias("v"), F.col("out").alias("out_v")), ["bucket", "v"])
    meet = meet.withColumn("common", F.array_intersect("out", "out_v")).filter(F.size("common") > 0)
    corners = meet.select("bucket", F.inline(F.concat(
        F.array(F.struct(F.col("u").alias("node"), F.size("common").alias("t")),
                F.struct(F.col("v").alias("node"), F.size("common").alias("t"))),
        F.transform("common", lambda w: F.struct(w.alias("node"), F.lit(1).alias("t"))))))
    triangles = corners.groupBy("bucket", "node").agg(F.sum("t").alias("t"))
    local = degree.join(triangles.withColumnRenamed("node", "u"), ["bucket", "u"], "left")
    share = 2.0 * F.coalesce("t", F.lit(0)) / F.nullif(F.col("d") * (F.col("d") - 1), F.lit(0))
    return local.groupBy("bucket").agg(F.sum("d").alias("ends"), F.sum(F.coalesce(share, F.lit(0.0))).alias("c"))


def interaction_scores(df: DataFrame, radius_nm: float = 10.0, cpa_nm: float = 0.27,
                       same_vessel: bool = False, among: DataFrame | None = None) -> DataFrame:
    """0.6 closeness + 0.4 low CPA against the nearest neighbour, 0 without one.

    ``among``: the rows to look for neighbours in, if not those scored.
    """
    near = P.near_summaries(_usable(df if among is None else among), radius_nm, same_vessel=same_vessel, state=MOTION, pick="nearest")
    pairs = with_cpa(P.with_distance(near))
    near = pairs.groupBy("event_id").agg(
        F.min_by(F.struct("distance_nm", "cpa_m"), F.struct("distance_nm", "other_event_id")).alias("n"))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    score = (0.6 * clip(1 - F.col("n.distance_nm") / radius_nm)
             + 0.4 * clip(1 - F.col("n.cpa_m") / 1000 / geo.KM_PER_NM / cpa_nm))
    return df.join(near, "event_id", "left").withColumn("interaction_score", F.coalesce(score, F.lit(0.0))).drop("n")


def graph_snapshots(df: DataFrame, minutes: int = 10, radius_km: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per window: node rows, edge rows and the size target.

    Tables instead of dense matrices, so that a crowded window is no single row.
    """
    seconds = minutes * 60
    bucket = F.floor(F.unix_micros("time") / F.lit(seconds * 1_000_000)) * seconds
    rows = df.withColumn("bucket", bucket)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") >= 2)
    nodes = rows.join(sizes.select("bucket"), "bucket", "left_semi").select("bucket", "event_id", "lat", "lon", "sog", "cog")
    pairs = P.near_pairs(df, radius_km / geo.KM_PER_NM, seconds, same_vessel=True,
                         state=("event_id", "mmsi", "time", "lat", "lon"))
    edges = pairs.select("bucket", "event_id", "other_event_id", (F.col("distance_nm") * geo.KM_PER_NM).alias("distance_km"))
    return nodes, edges, sizes


# ------------------------------------------------------------- rules of the road

def with_bearings(pairs: DataFrame) -> DataFrame:
    """Bearing to the other vessel off each bow, and the angle between courses."""
    there = geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon"))
    full = F.lit(360.0)
    return pinned(pairs.withColumn("_b", there), {
        "bearing_off_bow": F.pmod(F.col("_b") - F.col("cog"), full),
        "other_bearing_off_bow": F.pmod(F.pmod(F.col("_b") + 180, full) - F.col("other_cog"), full),
        "crossing_angle": geo.circular_error(F.col("cog"), F.col("other_cog")),
    }).drop("_b")


def encounter_type(off: Column, other_off: Column, angle: Column, head_on: float = 15.0,
                   overtaking: float = 135.0) -> Column:
    """Ordered rules: overtaking, head-on, parallel, crossing."""
    abaft = lambda b: b.between(overtaking, 360 - overtaking)
    ahead = lambda b: (b <= head_on) | (b >= 360 - head_on)
    opposite = angle >= 180 - head_on
    crossing = angle.between(head_on, 180 - head_on)
    return (
        F.when(abaft(off), "overtaking_taken")
        .when(abaft(other_off), "overtaking_given")
        .when(opposite & ahead(off) & ahead(other_off), "head_on")
        .when(angle <= head_on, "parallel_same")
        .when(opposite, "parallel_opposite")
        .when(crossing & (off > 0) & (off < 180), "crossing_starboard")
        .when(crossing & (off > 180), "crossing_port")
        .otherwise("unknown"))


# Required action of the first and the second vessel.
ACTIONS = {
    "head_on": ("both_alter", "both_alter"),
    "crossing_starboard": ("give_way", "stand_on"),
    "crossing_port": ("stand_on", "give_way"),
    "overtaking_given": ("stand_on", "give_way"),
    "overtaking_taken": ("give_way", "stand_on"),
    "parallel_same": ("no_action", "no_action"),
    "parallel_opposite": ("no_action", "no_action"),
    "unknown": ("unknown", "unknown"),
}


def with_encounter(pairs: DataFrame) -> DataFrame:
    df = with_bearings(pairs)
    kind = encounter_type(F.col("bearing_off_bow"), F.col("other_bearing_off_bow"), F.col("crossing_angle"))
    df = df.withColumn("encounter", kind)
    return df.withColumns({
        "action": codes.lookup(F.col("encounter"), {k: a for k, (a, _) in ACTIONS.items()}),
        "other_action": codes.lookup(F.col("encounter"), {k: b for k, (_, b) in ACTIONS.items()}),
        "encounter_risk": codes.encounter_risk(F.col("encounter"), F.col("bearing_off_bow")),
    })


def complies(action: Column, course_change: Column, speed_change: Column,
             course_limit: float = 5.0, speed_limit: float = 0.1) -> Column:
    course, speed = F.coalesce(course_change, F.lit(0.0)), F.coalesce(speed_change, F.lit(0.0))
    held = (F.abs(course) <= course_limit) & (F.abs(speed) <= speed_limit)
    return F.when(action == "stand_on", held).when(action.isin("give_way", "both_alter"), ~held).otherwise(True)


def check_compliance(encounters: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Join what each vessel did (event_id, course_change, speed_change) and judge it.

    Without ``actions`` the pairs bring them along, as lists ``done`` and ``other_done`` of structs.
    """
    if actions is None:
        df = encounters.select("*", F.inline("done")).select("*", F.inline("other_done").alias("other_course_change", "other_speed_change"))
    else:
        mine = actions.select("event_id", "course_change", "speed_change")
        theirs = actions.select(F.col("event_id").alias("other_event_id"), F.col("course_change").alias("other_course_change"),
                                F.col("speed_change").alias("other_speed_change"))
        df = encounters.join(mine, "event_id", "left").join(theirs, "other_event_id", "left")
    df = df.withColumns({
        "compliant": complies(F.col("action"), F.col("course_change"), F.col("speed_change")),
        "other_compliant": complies(F.col("other_action"), F.col("other_course_change"), F.col("other_speed_change"))})
    return df.withColumn("overall_compliant", F.col("compliant") & F.col("other_compliant"))


# ------------------------------------------------------------- forecasts against neighbours

def cpa_forecast_errors(both: DataFrame, metres: float = 50.0, seconds: float = 30.0) -> DataFrame:
    """Errors of predicted against true CPA (``pred_*`` and ``true_*`` columns)."""
    d = F.abs(F.col("pred_cpa_m") - F.col("true_cpa_m"))
    t = F.abs(F.col("pred_tcpa_s") - F.col("true_tcpa_s"))
    df = both.withColumns({"distance_error_m": d, "time_error_s": t})
    return df.withColumns({
        "distance_accurate": F.col("distance_error_m") <= metres, "time_accurate": F.col("time_error_s") <= seconds,
        "overall_accurate": (F.col("distance_error_m") <= metres) & (F.col("time_error_s") <= seconds),
        "distance_error_pct": F.col("distance_error_m") / F.nullif(F.col("true_cpa_m"), F.lit(0.0)) * 100,
        "time_error_pct": F.coalesce(F.col("time_error_s") / F.nullif(F.abs("true_tcpa_s"), F.lit(0.0)) * 100, F.lit(0.0)),
    })


def collision_forecast_metrics(both: DataFrame, limit_m: float = 500.0) -> DataFrame:
    d, t = F.abs(F.col("pred_cpa_m") - F.col("true_cpa_m")), F.abs(F.col("pred_tcpa_s") - F.col("true_tcpa_s"))
    risky = F.col("true_cpa_m") < limit_m
    return both.agg(
        F.avg(d).alias("cpa_error_mean"), F.stddev_pop(d).alias("cpa_error_std"), F.avg(t).alias("tcpa_error_mean"),
        (F.count_if(risky & (F.col("pred_cpa_m") < limit_m)) / F.nullif(F.count_if(risky), F.lit(0))).alias("collision_recall"),
        F.count("*").alias("encounters"))


def warning_events(both: DataFrame, limit_m: float = 1000.0) -> DataFrame:
    """A warning wherever the predicted CPA is below the limit, false if the true one is above."""
    return both.filter(F.col("pred_cpa_m") < limit_m).select(
        "event_id", "time", "mmsi", F.lit("collision").alias("threat_type"),
        (F.col("pred_tcpa_s") / 60).alias("warning_time"), F.coalesce(F.col("true_cpa_m") > limit_m, F.lit(True)).alias("false_positive"),
        codes.ops_severity(F.col("pred_cpa_m"), F.col("pred_tcpa_s"), F.lit("collision")).alias("severity"),
        F.col("pred_cpa_m").alias("cpa_distance"), F.col("pred_tcpa_s").alias("tcpa_time"),
        F.create_map(F.lit("other_mmsi"), F.col("other_mmsi").cast("string")).alias("metadata"))


def moved(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add each step's change of position."""
    w = Window.partitionBy(*keys).orderBy("step")
    return df.withColumns({"vlat": F.col("lat") - F.lag("lat").over(w), "vlon": F.col("lon") - F.lag("lon").over(w)})


def motion_lists(own: DataFrame) -> DataFrame:
    """sample_id, the list ``steps`` of its steps with their change of position, and whether a step ``repeats``."""
    lists = moved(own, ["sample_id"]).groupBy("sample_id").agg(F.collect_list(F.struct("step", "lat", "lon", "vlat", "vlon")).alias("steps"))
    return lists.withColumn("repeats", F.size(F.array_distinct(F.col("steps.step"))) < F.size("steps"))


def stepwise_risk(own: DataFrame | None, neighbours: DataFrame | None, limit_m: float = 500.0, horizon: int = 12,
                  pairs: DataFrame | None = None) -> DataFrame:
    """Mean sigmoid risk over steps and neighbours of each sample, in step units.

    ``own``: sample_id, step, lat, lon; ``neighbours`` adds neighbour_id.  ``pairs``, alone or besides, are neighbours whose
    steps don't repeat and that bring both tracks along: sample_id and the lists ``steps`` and ``other_steps`` of :func:`motion_lists`.
    """
    mine, theirs = ("step", "lat", "lon", "vlat", "vlon"), ("lat", "lon", "vlat", "vlon")
    counts = F.col("vlat").isNotNull() & (F.col("step") <= horizon)
    columns, met = ["sample_id", *mine, *[f"n_{c}" for c in theirs]], []
    if pairs is not None:
        j = pairs.select("sample_id", F.inline("steps").alias(*mine), "other_steps").filter(counts)
        same = F.filter("other_steps", lambda s: s["step"] == F.col("step"))
        met.append(j.select("sample_id", *mine, F.inline(F.transform(same, lambda s: F.struct(*[s[c].alias(f"n_{c}") for c in theirs])))))
    if neighbours is not None:
        a = moved(own, ["sample_id"]).filter(counts)
        b = moved(neighbours, ["sample_id", "neighbour_id"]).select("sample_id", "neighbour_id", "step", *[F.col(c).alias(f"n_{c}") for c in theirs])
        met.append(a.join(b, ["sample_id", "step"]).select(*columns))
    j = reduce(DataFrame.unionByName, met)
    px, py = F.col("lat") - F.col("n_lat"), F.col("lon") - F.col("n_lon")
    vx, vy = F.col("vlat") - F.col("n_vlat"), F.col("vlon") - F.col("n_vlon")
    rel2 = vx * vx + vy * vy
    t = F.greatest(F.lit(0.0), F.when(rel2 > 1e-6, -(px * vx + py * vy) / rel2).otherwise(0.0))
    j = pinned(j, {"_t": t, "_px": px, "_py": py, "_vx": vx, "_vy": vy})
    ex, ey = F.col("_px") + F.col("_t") * F.col("_vx"), F.col("_py") + F.col("_t") * F.col("_vy")
    metres = F.sqrt(ex * ex + ey * ey) * 111000.0
    risk = 1 / (1 + F.exp((metres - limit_m) / 100.0)) * F.exp(-0.1 * F.col("_t"))
    return j.groupBy("sample_id").agg(F.avg(risk).alias("risk"))
