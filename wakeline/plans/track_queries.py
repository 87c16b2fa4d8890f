"""Registered queries: cleaning, segments, step and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import codes, geo, times
from wakeline.operators import clean as C
from wakeline.operators import features as FE
from wakeline.operators import proximity as P
from wakeline.operators import tracks as TR
from wakeline.plans import adapter as A
from wakeline.plans.adapter import bear, circ, fold, hav, secs, with_sql
from wakeline.plans.registry import query

# ------------------------------------------------------------- flagship

@query("flagship_segment_summary", with_sql("step") + """
SELECT mmsi, segment_id, count(*) AS points, sum(distance_km) AS km, avg(sog) AS mean_sog
FROM step WHERE NOT (coalesce(distance_km/1.852/nullif(CASE WHEN seg_row>1 OR time_diff>0 THEN time_diff END/3600,0)>75,false)
  OR coalesce(abs(acceleration)>2,false) OR coalesce(abs(turn_rate)>30,false))
GROUP BY 1,2""", "km mean_sog")
def flagship(spark, sf):
    kept = FE.drop_outliers(A.steps(spark, sf))
    return kept.groupBy("mmsi", "segment_id").agg(
        F.count("*").alias("points"), F.sum("distance_km").alias("km"), F.avg("sog").alias("mean_sog"))


# ------------------------------------------------------------- projections

@query("prj1_rename_aliases", with_sql("msg") + """
SELECT event_id, mmsi, time, lat, lon, sog, cog, msg_type FROM msg""", "lat lon sog cog")
def rename(spark, sf):
    m = A.messages(spark, sf).select("event_id", "mmsi", F.col("time").alias("timestamp"), F.col("lat").alias("latitude"),
                                     F.col("lon").alias("longitude"), F.col("sog").alias("speed"),
                                     F.col("cog").alias("course"), F.col("msg_type").alias("type"))
    return C.rename_aliases(m)


@query("prj2_null_sentinels", with_sql("msg", "stat") + """
SELECT m.event_id, nullif(lat,91.0) AS lat, nullif(lon,181.0) AS lon, nullif(sog,102.3) AS sog,
  nullif(heading,511) AS heading, nullif(draught,25.5) AS draught
FROM msg m LEFT JOIN stat s ON s.event_id=m.event_id""", "lat lon sog draught")
def sentinels(spark, sf):
    m = A.messages(spark, sf).join(A.static_messages(spark, sf).select("event_id", "draught"), "event_id", "left")
    return C.null_sentinels(m).select("event_id", "lat", "lon", "sog", "heading", "draught")


@query("prj3_null_out_of_range", with_sql("msg") + """
SELECT event_id, CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS lat, CASE WHEN lon BETWEEN -180 AND 180 THEN lon END AS lon,
  CASE WHEN sog>=0 AND sog<102.2 THEN sog END AS sog FROM msg""", "lat lon sog")
def ranges(spark, sf):
    return C.null_out_of_range(A.messages(spark, sf)).select("event_id", "lat", "lon", "sog")


@query("prj4_message_class", with_sql("msg") + """
SELECT event_id, CASE msg_type WHEN 1 THEN 'A_pos' WHEN 3 THEN 'A_pos' WHEN 18 THEN 'B_pos' WHEN 5 THEN 'Static' ELSE 'StaticB' END AS basic_class,
  CASE msg_type WHEN 1 THEN 'A_pos' WHEN 3 THEN 'A_pos' WHEN 18 THEN 'B_pos' WHEN 5 THEN 'static_voyage' ELSE 'static_data' END AS task_class
FROM msg""")
def classes(spark, sf):
    t = F.col("msg_type")
    return A.messages(spark, sf).select("event_id", codes.basic_class(t).alias("basic_class"), codes.task_class(t).alias("task_class"))


@query("prj5_node_type", with_sql("msg") + """
SELECT event_id, CASE msg_type WHEN 1 THEN 'vessel_a' WHEN 3 THEN 'vessel_a' WHEN 18 THEN 'vessel_b' ELSE 'metadata' END AS node_type,
  msg_type IN (1,3,18) AS has_temporal_edge FROM msg""")
def nodes(spark, sf):
    m = C.with_node_type(C.with_message_class(A.messages(spark, sf), "task"))
    return m.select("event_id", "node_type", "has_temporal_edge")


# ------------------------------------------------------------- filters

@query("flt1_mmsi_rules", with_sql("msg") + """
SELECT event_id, mmsi BETWEEN 100000000 AND 799999999 AS strict_ok,
  mmsi BETWEEN 100000000 AND 799999999 OR mmsi BETWEEN 2000000 AND 9999999 OR mmsi BETWEEN 990000000 AND 999999999 AS wide_ok,
  length(mmsi::VARCHAR)=9 AND NOT starts_with(mmsi::VARCHAR,'00') AND NOT starts_with(mmsi::VARCHAR,'99') AS text_ok
FROM (SELECT event_id, CASE k%4 WHEN 0 THEN mmsi WHEN 1 THEN mmsi//100 WHEN 2 THEN mmsi+790000000 ELSE mmsi*5 END AS mmsi FROM msg)""")
def mmsi_rules(spark, sf):
    m, k = F.col("mmsi"), F.col("k") % 4
    varied = F.when(k == 0, m).when(k == 1, F.expr("mmsi div 100")).when(k == 2, m + 790000000).otherwise(m * 5)
    out = A.messages(spark, sf).select("event_id", varied.alias("mmsi"))
    return out.select("event_id", *[C.valid_mmsi(m, r).alias(f"{r}_ok") for r in ("strict", "wide", "text")])


@query("flt2_valid_positions", with_sql("msg") + """
SELECT event_id, lat, lon FROM msg WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""", "lat lon")
def valid_positions(spark, sf):
    return C.filter_positions(A.messages(spark, sf)).select("event_id", "lat", "lon")


@query("flt3_repair_motion", with_sql("msg") + """
SELECT event_id, NOT (sog BETWEEN 0 AND 50) AS sog_repaired, NOT (cog>=0 AND cog<360) AS cog_repaired,
  CASE WHEN sog BETWEEN 0 AND 50 THEN sog ELSE 0 END AS sog, CASE WHEN cog>=0 AND cog<360 THEN cog ELSE 0 END AS cog FROM msg""", "sog cog")
def repair(spark, sf):
    return C.repair_motion(A.messages(spark, sf)).select("event_id", "sog_repaired", "cog_repaired", "sog", "cog")


@query("flt4_clean", with_sql("pos") + "SELECT event_id, mmsi, time, lat, lon, sog, cog, heading FROM pos", "lat lon sog cog heading")
def clean(spark, sf):
    return A.positions(spark, sf).select("event_id", "mmsi", "time", "lat", "lon", "sog", "cog", "heading")


@query("flt5_area_time_type", with_sql("pos", "latest") + """
SELECT p.event_id, p.mmsi, lat, lon FROM pos p JOIN latest USING (mmsi)
WHERE lat BETWEEN 61.95 AND 62.1 AND lon BETWEEN -6.85 AND -6.7 AND ship_type IN (70,80,30)
  AND time BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-01 09:00:00'""", "lat lon")
def area(spark, sf):
    from wakeline.operators import statics as ST

    p = ST.enrich(A.positions(spark, sf), ST.merged_static(A.static_messages(spark, sf)))
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-01 02:00:00", "2024-01-01 09:00:00"))
    out = C.select_area(p, (61.95, 62.1, -6.85, -6.7), start, end, [70, 80, 30])
    return out.select("event_id", "mmsi", "lat", "lon")


@query("flt6_task_subset", with_sql("msg") + """
SELECT task, count(*) AS n FROM msg, (VALUES ('trajectory_prediction',[1,3,18]),('anomaly_detection',[1,3,18,5]),
  ('graph_neural_networks',[1,3,18,5,24]),('collision_avoidance',[1,3,18]),('port_operations',[1,3,18,5]),
  ('environmental_monitoring',[1,3,18]),('search_and_rescue',[1,3,18])) t(task, kinds)
WHERE list_contains(kinds, msg_type) GROUP BY task""")
def task_subset(spark, sf):
    from wakeline import schema as S

    m = C.with_message_class(A.messages(spark, sf), "task")
    kept = F.array_compact(F.array(*[
        F.when(F.lit(s["classes"] is None) | F.col("msg_class").isin(*(s["classes"] or ("",))), F.lit(t))
        for t, s in S.TASKS.items()]))
    return m.select(F.explode(kept).alias("task")).groupBy("task").agg(F.count("*").alias("n"))


@query("flt7_moving", with_sql("pos") + "SELECT event_id, sog FROM pos WHERE sog>0.5 AND sog<50", "sog")
def moving(spark, sf):
    return C.moving(A.positions(spark, sf)).select("event_id", "sog")


@query("flt8_implied_speed", with_sql("pos") + f"""
SELECT event_id, mmsi, implied_knots FROM (SELECT event_id, mmsi, {hav('lag(lat) OVER v', 'lag(lon) OVER v', 'lat', 'lon')}/1.852/nullif({secs('time', 'lag(time) OVER v')}/3600,0) AS implied_knots
FROM pos WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id)) WHERE implied_knots IS NULL OR implied_knots<=50""", "implied_knots")
def implied(spark, sf):
    return C.drop_implied_speeding(A.positions(spark, sf)).select("event_id", "mmsi", "implied_knots")


@query("flt9_drop_outliers", with_sql("step") + """
SELECT event_id, mmsi, segment_id, CASE WHEN sog<0.5 AND abs(course_delta)>5 THEN 0 ELSE course_delta END AS course_delta,
  CASE WHEN sog<0.5 AND abs(course_delta)>5 THEN 0 ELSE turn_rate END AS turn_rate FROM step
WHERE NOT (coalesce(CASE WHEN time_diff>0 THEN distance_km/1.852/(time_diff/3600) END>75,false) OR coalesce(abs(acceleration)>2,false) OR coalesce(abs(turn_rate)>30,false))""",
       "course_delta turn_rate")
def outliers(spark, sf):
    return FE.drop_outliers(A.steps(spark, sf)).select("event_id", "mmsi", "segment_id", "course_delta", "turn_rate")


_LOCAL = with_sql("seg") + """, loc AS (SELECT *, (lon-avg(lon) OVER g)*cos(radians(avg(lat) OVER g))*(6371000.0::DOUBLE*3.141592653589793::DOUBLE/180) AS x,
  (lat-avg(lat) OVER g)*(6371000.0::DOUBLE*3.141592653589793::DOUBLE/180) AS y FROM seg WINDOW g AS (PARTITION BY mmsi, segment_id)),
d0 AS (SELECT *, """ + secs('time', 'lag(time) OVER s') + """ AS dt_s FROM loc WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id)),
d1 AS (SELECT *, CASE WHEN dt_s>0 THEN dt_s ELSE 1e-6 END AS h FROM d0),
d2 AS (SELECT *, (x-lag(x) OVER s)/h AS vx, (y-lag(y) OVER s)/h AS vy FROM d1 WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id)),
d3 AS (SELECT *, sqrt(vx*vx+vy*vy) AS speed_mps, ((degrees(atan2(vx,vy))%360)+360)%360 AS track_heading, (vx-lag(vx) OVER s)/h AS ax, (vy-lag(vy) OVER s)/h AS ay
  FROM d2 WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id)),
d4 AS (SELECT *, """ + fold('(track_heading-lag(track_heading) OVER s)') + """/h AS turn_deg_s FROM d3 WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id))
"""


@query("fn8_local_motion", _LOCAL + "SELECT event_id, x, y, vx, vy, speed_mps, ax, ay FROM d4", "x y vx vy speed_mps ax ay", 4)
def local_motion(spark, sf):
    return FE.local_motion(A.segments(spark, sf)).select("event_id", "x", "y", "vx", "vy", "speed_mps", "ax", "ay")


@query("flt10_plausibility", _LOCAL + """, f AS (SELECT *, coalesce(speed_mps>25.7,false) AS fast, coalesce(sqrt(ax*ax+ay*ay)>0.5,false) AS jerky, coalesce(dt_s>3600,false) AS gap FROM d4),
b AS (SELECT *, fast OR jerky OR gap OR coalesce(lead(fast) OVER s,false) OR coalesce(lead(jerky) OVER s,false) OR coalesce(lead(jerky,2) OVER s,false) AS bad
  FROM f WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id))
SELECT mmsi, segment_id, count(*) AS total_points, count(*) FILTER (fast) AS invalid_speed, count(*) FILTER (jerky) AS invalid_acceleration,
  count(*) FILTER (gap) AS time_gaps, count(*) FILTER (NOT bad) AS valid_points, count(*) FILTER (NOT bad)/count(*)::DOUBLE AS validity_rate
FROM b GROUP BY 1,2""", "validity_rate")
def plausibility(spark, sf):
    return FE.plausibility_report(FE.plausibility(A.segments(spark, sf)))


@query("flt11_rule_anomalies", with_sql("pos") + f"""
SELECT event_id, coalesce(sog>30 OR sog<0,false) AS speed_anomaly, coalesce({circ('cog', 'pcog')}>90,false) AS course_anomaly,
  coalesce({hav('plat', 'plon', 'lat', 'lon')}>10,false) AS position_jump, (sog-m)/nullif(sd,0) AS speed_deviation
FROM (SELECT *, lag(cog) OVER v AS pcog, lag(lat) OVER v AS plat, lag(lon) OVER v AS plon, avg(sog) OVER (PARTITION BY mmsi) AS m,
  stddev_samp(sog) OVER (PARTITION BY mmsi) AS sd FROM pos WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id))""", "speed_deviation")
def anomalies(spark, sf):
    return C.rule_anomalies(A.positions(spark, sf)).select("event_id", "speed_anomaly", "course_anomaly", "position_jump", "speed_deviation")


@query("flt12_duplicates", with_sql("msg") + """
SELECT mmsi, time, min(event_id) AS event_id, arg_min(sog, event_id) AS sog FROM (
  SELECT event_id, mmsi, date_trunc('hour', time) AS time, sog FROM msg) GROUP BY 1,2""", "sog")
def duplicates(spark, sf):
    m = A.messages(spark, sf).select("mmsi", F.date_trunc("hour", "time").alias("time"), "event_id", "sog")
    return C.drop_duplicates(m)


@query("flt13_stationary_clip", with_sql("pos") + "SELECT event_id, CASE WHEN sog<0.5 THEN 0 ELSE sog END AS sog FROM pos", "sog")
def clip(spark, sf):
    return C.clip_stationary(A.positions(spark, sf)).select("event_id", "sog")


@query("flt14_collapse_jitter", with_sql("pos") + f"""
SELECT mmsi, run, min(time) AS time, max(time) AS end_time, avg(lat) AS lat, avg(lon) AS lon, count(*) AS fixes FROM (
 SELECT *, CAST(sum(CASE WHEN coalesce(near,false) THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi ORDER BY time, event_id) AS BIGINT) AS run FROM (
  SELECT *, sog<5 AND lag(sog) OVER v<5 AND 1000*{hav('lag(lat) OVER v', 'lag(lon) OVER v', 'lat', 'lon')}<=500 AS near
  FROM pos WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id))) GROUP BY 1,2""", "lat lon")
def jitter(spark, sf):
    return C.collapse_jitter(A.positions(spark, sf), radius_m=500.0, below=5.0)


@query("flt14_smooth", with_sql("pos") + """
SELECT event_id, quantile_cont(lat,0.5) OVER w AS lat_smooth, quantile_cont(lon,0.5) OVER w AS lon_smooth FROM pos
WINDOW w AS (PARTITION BY mmsi ORDER BY time, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", "lat_smooth lon_smooth")
def smooth(spark, sf):
    return C.smooth(A.positions(spark, sf)).select("event_id", "lat_smooth", "lon_smooth")


# ------------------------------------------------------------- trajectories

@query("trj1_segments", with_sql("seg") + "SELECT event_id, mmsi, segment_id, segment_points FROM seg")
def segments(spark, sf):
    return A.segments(spark, sf).select("event_id", "mmsi", "segment_id", "segment_points")


@query("trj2_segment_statistics", with_sql("seg") + """
SELECT count(*) AS vessels, CAST(sum(s) AS BIGINT) AS segments, CAST(sum(n) AS BIGINT) AS points, min(lo) AS min_points, max(hi) AS max_points,
  sum(n)/sum(s)::DOUBLE AS avg_points, avg(s) AS segments_per_vessel FROM (
 SELECT mmsi, count(*) AS s, sum(n) AS n, min(n) AS lo, max(n) AS hi FROM (SELECT mmsi, segment_id, count(*) AS n FROM seg GROUP BY 1,2) GROUP BY 1)""",
       "avg_points segments_per_vessel")
def segment_statistics(spark, sf):
    return TR.segment_statistics(A.segments(spark, sf))


@query("trj3_one_vessel", with_sql("seg") + "SELECT event_id, segment_id, time, lat, lon FROM seg WHERE mmsi=200000007", "lat lon")
def one_vessel(spark, sf):
    return TR.trajectories(A.segments(spark, sf), mmsi=200000007).select("event_id", "segment_id", "time", "lat", "lon")


@query("trj4_last_points", with_sql("seg") + """
SELECT mmsi, segment_id, count(*) AS n_points, CASE WHEN count(*)<8 THEN 'too short' END AS error, avg(lat) AS mean_lat, arg_max_null(sog, event_id) AS last_sog
FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, segment_id ORDER BY time DESC, event_id DESC) AS r FROM seg) WHERE r<=8 GROUP BY 1,2""", "mean_lat last_sog", 9)
def last_points(spark, sf):
    out = TR.last_points(A.segments(spark, sf), 8, keys=("mmsi", "segment_id"))
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lat"])
    return out.select("mmsi", "segment_id", "n_points", "error", (total / F.col("n_points")).alias("mean_lat"),
                      F.element_at("points", -1)["sog"].alias("last_sog"))


_BIN = """, b AS (SELECT *, epoch_us(time)//60000000*60 AS bin FROM pos),
f AS (SELECT mmsi, bin, arg_min(lat, event_id) FILTER (lat IS NOT NULL) AS lat, arg_min(lon, event_id) FILTER (lon IS NOT NULL) AS lon,
  arg_min(sog, event_id) FILTER (sog IS NOT NULL) AS sog, arg_min(cog, event_id) FILTER (cog IS NOT NULL) AS cog FROM b GROUP BY 1,2),
g AS (SELECT mmsi, unnest(range(min(bin), max(bin)+60, 60)) AS bin FROM f GROUP BY 1),
j AS (SELECT g.mmsi, g.bin, lat, lon, sog, cog FROM g LEFT JOIN f USING (mmsi, bin))
"""


@query("trj5_resample_forward", with_sql("pos") + _BIN.replace("FROM pos)", f"FROM pos WHERE mmsi IN (SELECT mmsi FROM pos GROUP BY 1 HAVING count(*)>=20 AND {secs('max(time)', 'min(time)')}>=300))") + """
SELECT * FROM (SELECT mmsi, make_timestamp(bin*1000000) AS time, last_value(lat IGNORE NULLS) OVER v AS lat, last_value(lon IGNORE NULLS) OVER v AS lon,
  last_value(sog IGNORE NULLS) OVER v AS sog, last_value(cog IGNORE NULLS) OVER v AS cog FROM j WINDOW v AS (PARTITION BY mmsi ORDER BY bin))
WHERE lat IS NOT NULL AND lon IS NOT NULL AND sog IS NOT NULL AND cog IS NOT NULL""", "lat lon sog cog")
def resample_forward(spark, sf):
    return TR.resample_forward(A.positions(spark, sf))


@query("trj6_resample_linear", with_sql("pos") + _BIN + ", ".join([""] + [f"""k_{c} AS (SELECT mmsi, bin, {c},
  max(bin) FILTER ({c} IS NOT NULL) OVER (PARTITION BY mmsi ORDER BY bin) AS ta, min(bin) FILTER ({c} IS NOT NULL) OVER (PARTITION BY mmsi ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb,
  last_value({c} IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY bin) AS va, first_value({c} IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM j)""" for c in ("lat", "lon", "sog")]) + """
SELECT mmsi, make_timestamp(bin*1000000) AS time, """ + ", ".join(
    f"coalesce(k_{c}.{c}, k_{c}.va+(k_{c}.vb-k_{c}.va)*((bin-k_{c}.ta)/nullif(k_{c}.tb-k_{c}.ta,0)::DOUBLE), k_{c}.va, k_{c}.vb) AS {c}"
    for c in ("lat", "lon", "sog")) + " FROM k_lat JOIN k_lon USING (mmsi, bin) JOIN k_sog USING (mmsi, bin)", "lat lon sog", 11)
def resample_linear(spark, sf):
    return TR.resample_linear(A.positions(spark, sf))


@query("trj7_positions_at", with_sql("pos") + """, q AS (SELECT event_id AS query_id, mmsi, time FROM msg WHERE msg_type IN (5,24)),
p AS (SELECT q.query_id, q.mmsi, q.time, (SELECT max(time) FROM pos WHERE pos.mmsi=q.mmsi AND pos.time<=q.time) AS ta,
  (SELECT min(time) FROM pos WHERE pos.mmsi=q.mmsi AND pos.time>=q.time) AS tb FROM q)
SELECT p.query_id, p.mmsi, p.time, a.lat+(b.lat-a.lat)*(CASE WHEN tb=ta THEN 0 ELSE """ + secs('p.time', 'ta') + "/" + secs('tb', 'ta') + """ END) AS lat,
  a.lon+(b.lon-a.lon)*(CASE WHEN tb=ta THEN 0 ELSE """ + secs('p.time', 'ta') + "/" + secs('tb', 'ta') + """ END) AS lon
FROM p LEFT JOIN pos a ON a.mmsi=p.mmsi AND a.time=p.ta LEFT JOIN pos b ON b.mmsi=p.mmsi AND b.time=p.tb""", "lat lon")
def positions_at(spark, sf):
    wanted = A.static_messages(spark, sf).select("mmsi", "time", F.col("event_id").alias("query_id"))
    return TR.positions_at(A.positions(spark, sf), wanted)


@query("trj9_track_lengths", with_sql("step") + f"""
SELECT mmsi, segment_id, count(*) AS points, sum(distance_km) AS length_km,
  {hav('arg_min(lat, event_id)', 'arg_min(lon, event_id)', 'arg_max(lat, event_id)', 'arg_max(lon, event_id)')} AS displacement_km,
  coalesce(sum(distance_km)/nullif({secs('max(time)', 'min(time)')}/3600,0),0) AS mean_speed_kmh FROM step GROUP BY 1,2""",
       "length_km displacement_km mean_speed_kmh")
def track_lengths(spark, sf):
    return TR.track_lengths(TR.with_segments(A.positions(spark, sf)))


@query("trj10_track_summaries", with_sql("seg") + f"""
SELECT mmsi, segment_id, {secs('max(time)', 'min(time)')}/3600 AS duration_h, {secs('max(time)', 'min(time)')}/nullif(count(*)-1,0) AS mean_dt_s,
  min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM seg GROUP BY 1,2""",
       "duration_h mean_dt_s min_lat max_lat min_lon max_lon")
def track_summaries(spark, sf):
    return TR.track_summaries(A.segments(spark, sf))


# ------------------------------------------------------------- scalar functions

@query("fn_geometry", with_sql("step") + f"""
SELECT event_id, {hav('plat', 'plon', 'lat', 'lon')} AS km, {hav('plat', 'plon', 'lat', 'lon')}/1.852 AS nm, {bear('plat', 'plon', 'lat', 'lon')} AS bearing,
  CASE WHEN time_diff>0 AND {hav('plat', 'plon', 'lat', 'lon')}/1.852/(time_diff/3600)<=100 THEN {hav('plat', 'plon', 'lat', 'lon')}/1.852/(time_diff/3600) END AS knots,
  {fold('(cog-pcog)')} AS turn, {circ('cog', 'pcog')} AS turn_size, sog*0.514444*cos(radians(90-cog)) AS v_east, sog*0.514444*sin(radians(90-cog)) AS v_north,
  (lon-plon)*cos(radians(plat))*(6371000.0::DOUBLE*3.141592653589793::DOUBLE/180) AS x, (lat-plat)*(6371000.0::DOUBLE*3.141592653589793::DOUBLE/180) AS y,
  {circ('heading', 'cog')} AS course_drift, CASE WHEN sog IS NOT NULL THEN least(greatest(sog/20,0),1) END AS speed_factor FROM step WHERE plat IS NOT NULL""",
       "km nm bearing knots turn turn_size v_east v_north x y course_drift speed_factor")
def geometry(spark, sf):
    s = A.steps(spark, sf).filter(~F.col("starts_segment"))
    here, before = (F.col("lat"), F.col("lon")), (F.col("prev.lat"), F.col("prev.lon"))
    nm, mps = geo.haversine_nm(*before, *here), geo.knots_to_mps(F.col("sog"))
    x, y = geo.to_local(*here, *before)
    return s.select(
        "event_id", geo.haversine_km(*before, *here).alias("km"), nm.alias("nm"), geo.bearing_deg(*before, *here).alias("bearing"),
        geo.speed_knots(nm, F.col("time_diff") / 3600).alias("knots"),
        geo.angle_delta(F.col("cog") - F.col("prev.cog")).alias("turn"), geo.circular_error(F.col("cog"), F.col("prev.cog")).alias("turn_size"),
        geo.velocity_east(mps, F.col("cog")).alias("v_east"), geo.velocity_north(mps, F.col("cog")).alias("v_north"),
        x.alias("x"), y.alias("y"), "course_drift", codes.clip01(F.col("sog"), 20.0).alias("speed_factor"))


@query("fn_time_parts", with_sql("msg") + """
SELECT event_id, hour(time)/24.0::DOUBLE AS hour_norm, (isodow(time)-1)/7.0::DOUBLE AS weekday_norm, month(time)/12.0::DOUBLE AS month_norm,
  sin(hour(time)*(2*pi())/24) AS hour_sin, cos(hour(time)*(2*pi())/24) AS hour_cos, sin((isodow(time)-1)*(2*pi())/7) AS weekday_sin,
  cos((isodow(time)-1)*(2*pi())/7) AS weekday_cos, hour(time)<6 OR hour(time)>18 AS night, isodow(time)>=6 AS weekend FROM msg""",
       "hour_norm weekday_norm month_norm hour_sin hour_cos weekday_sin weekday_cos")
def time_parts(spark, sf):
    t = F.col("time")
    return A.messages(spark, sf).select("event_id", *[c.alias(n) for n, c in times.time_features(t).items()],
                                        times.is_night(t).alias("night"), times.is_weekend(t).alias("weekend"))


@query("fn11_vessel_category_size", with_sql("stat") + """
SELECT event_id, CASE WHEN ship_type BETWEEN 70 AND 74 THEN 'cargo' WHEN ship_type BETWEEN 80 AND 85 OR ship_type=89 THEN 'tanker'
  WHEN ship_type=30 THEN 'fishing' WHEN ship_type BETWEEN 60 AND 69 THEN 'passenger' ELSE 'other' END AS category,
  coalesce(to_bow,0)+coalesce(to_stern,0) AS length, coalesce(to_port,0)+coalesce(to_starboard,0) AS width FROM stat""")
def category_size(spark, sf):
    return A.static_messages(spark, sf).select(
        "event_id", codes.vessel_category(F.col("ship_type")).alias("category"),
        codes.vessel_length(F.col("to_bow"), F.col("to_stern")).alias("length"),
        codes.vessel_width(F.col("to_port"), F.col("to_starboard")).alias("width"))


@query("fn12_behaviour", with_sql("pos") + """
SELECT mmsi, h, m AS mean_sog, CASE WHEN m IS NULL THEN 'unknown' WHEN m<0.5 THEN 'anchored' WHEN m<3 THEN 'maneuvering' WHEN m<15 THEN 'transit' ELSE 'high_speed' END AS behaviour
FROM (SELECT mmsi, hour(time)::INTEGER AS h, avg(sog) AS m FROM pos GROUP BY 1,2)""", "mean_sog")
def behaviour(spark, sf):
    m = A.positions(spark, sf).groupBy("mmsi", F.hour("time").alias("h")).agg(F.avg("sog").alias("mean_sog"))
    return m.withColumn("behaviour", codes.behaviour(F.col("mean_sog")))


@query("fn14_parse_rxtime", with_sql("msg") + """
SELECT event_id, CASE WHEN k%5<>0 AND k%7<>0 THEN date_trunc('second', time) END AS time FROM msg""")
def rxtime(spark, sf):
    text = F.date_format("time", "yyyyMMddHHmmss")
    spoiled = F.when(F.col("k") % 5 == 0, F.regexp_replace(text, "^2024", "20241")).when(
        F.col("k") % 7 == 0, F.concat(F.substring(text, 1, 4), F.lit("13"), F.substring(text, 7, 8))).otherwise(text)
    return A.messages(spark, sf).select("event_id", times.parse_rxtime(spoiled).alias("time"))


# ------------------------------------------------------------- window features

_V = "WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id)"
_S = "WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id)"


@query("win1_step_features", with_sql("step") + f"""
SELECT event_id, time_diff, distance_km, bearing, distance_km/1.852 AS distance_nm, speed_delta, acceleration, course_delta, turn_rate,
  {circ('heading', 'cog')} AS course_drift, {circ('bearing', 'cog')} AS bearing_deviation FROM step""",
       "time_diff distance_km bearing distance_nm speed_delta acceleration course_delta turn_rate course_drift bearing_deviation")
def step_features(spark, sf):
    return A.steps(spark, sf).select("event_id", "time_diff", "distance_km", "bearing", "distance_nm", "speed_delta",
                                     "acceleration", "course_delta", "turn_rate", "course_drift", "bearing_deviation")


@query("win2_movement", with_sql("pos") + f"""
SELECT event_id, coalesce(sog-lag(sog) OVER v,0) AS speed_change, coalesce({fold('(cog-lag(cog) OVER v)')},0) AS course_change,
  coalesce({hav('lag(lat) OVER v', 'lag(lon) OVER v', 'lat', 'lon')}/1.852,0) AS distance_nm FROM pos {_V}""", "speed_change course_change distance_nm")
def movement(spark, sf):
    return FE.movement_features(A.positions(spark, sf)).select("event_id", "speed_change", "course_change", "distance_nm")


@query("win3_simple_diffs", with_sql("pos") + "SELECT event_id, " + ", ".join(f"coalesce({c}-lag({c}) OVER v,0) AS d_{c}" for c in FE.MOTION) + f" FROM pos {_V}",
       "d_lat d_lon d_sog d_cog")
def simple_diffs(spark, sf):
    return FE.simple_diffs(A.positions(spark, sf)).select("event_id", *[f"d_{c}" for c in FE.MOTION])


@query("win4_grid_velocities", with_sql("pos") + f""", d AS (SELECT event_id, lat, coalesce(lat-lag(lat) OVER v,0) AS dlat, coalesce(lon-lag(lon) OVER v,0) AS dlon,
  coalesce({secs('time', 'lag(time) OVER v')},60) AS dt FROM pos {_V})
SELECT event_id, dlat*(6371000.0::DOUBLE*3.141592653589793::DOUBLE/180)/dt AS v_north, dlon*(cos(radians(lat))*(6371000.0::DOUBLE*3.141592653589793::DOUBLE/180))/dt AS v_east FROM d""", "v_north v_east", 5)
def grid_velocities(spark, sf):
    return FE.grid_velocities(A.positions(spark, sf)).select("event_id", "v_north", "v_east")


@query("win5_vessel_statistics", with_sql("pos") + f"""
SELECT event_id, avg(sog) OVER m AS sog_mean, stddev_samp(sog) OVER m AS sog_std, stddev_samp(cog) OVER m AS cog_std, avg(turn) OVER m AS turn_mean
FROM (SELECT *, abs({fold('(cog-lag(cog) OVER v)')}) AS turn FROM pos {_V}) WINDOW m AS (PARTITION BY mmsi)""", "sog_mean sog_std cog_std turn_mean")
def vessel_statistics(spark, sf):
    return FE.vessel_statistics(A.positions(spark, sf)).select("event_id", "sog_mean", "sog_std", "cog_std", "turn_mean")


@query("win6_rolling_mean_std", with_sql("pos") + """
SELECT event_id, avg(sog) OVER w AS sog_mean_5, stddev_samp(sog) OVER w AS sog_std_5, avg(cog) OVER w AS cog_mean_5, stddev_samp(cog) OVER w AS cog_std_5
FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY time, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", "sog_mean_5 sog_std_5 cog_mean_5 cog_std_5", 5)
def rolling_mean_std(spark, sf):
    return FE.rolling_mean_std(A.positions(spark, sf)).select("event_id", "sog_mean_5", "sog_std_5", "cog_mean_5", "cog_std_5")


_ROLL = [f"{c}_{s}" for c in ("lat", "sog", "cog") for s in ("mean", "std", "min", "max", "median", "slope")]


@query("win7_rolling_statistics", with_sql("step") + "SELECT event_id, " + ", ".join(
    f"avg({c}) OVER w AS {c}_mean, stddev_pop({c}) OVER w AS {c}_std, min({c}) OVER w AS {c}_min, max({c}) OVER w AS {c}_max, "
    f"quantile_cont({c},0.5) OVER w AS {c}_median, coalesce(CASE WHEN isfinite(regr_slope({c}, seg_row::DOUBLE) OVER w) THEN regr_slope({c}, seg_row::DOUBLE) OVER w END,0) AS {c}_slope" for c in ("lat", "sog", "cog")) + """
FROM step WINDOW w AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", " ".join(_ROLL), 9)
def rolling_statistics(spark, sf):
    return FE.rolling_statistics(A.segments(spark, sf), ("lat", "sog", "cog")).select("event_id", *_ROLL)


_DM = ["sog_lag1", "sog_lag3", "cog_lag2", "sog_diff", "sog_mean3", "sog_std3", "cog_mean5", "cog_std10", "lat_mean10", "sog_t1", "lat_t1"]


@query("win8_design_matrix", with_sql("step") + """
SELECT event_id, position, sog_lag1, sog_lag3, cog_lag2, sog_diff, sog_mean3, sog_std3, cog_mean5, cog_std10, lat_mean10, sog_t1, lat_t1 FROM (
SELECT event_id, seg_row-1 AS position, lag(sog,1) OVER s AS sog_lag1, lag(sog,3) OVER s AS sog_lag3, lag(cog,2) OVER s AS cog_lag2, coalesce(sog-lag(sog) OVER s,0) AS sog_diff,
  avg(sog) OVER r3 AS sog_mean3, stddev_pop(sog) OVER r3 AS sog_std3, avg(cog) OVER r5 AS cog_mean5, stddev_pop(cog) OVER r10 AS cog_std10, avg(lat) OVER r10 AS lat_mean10,
  lead(sog) OVER s-sog AS sog_t1, lead(lat) OVER s-lat AS lat_t1 FROM step
WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id), r3 AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id ROWS 2 PRECEDING),
 r5 AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id ROWS 4 PRECEDING), r10 AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id ROWS 9 PRECEDING))
WHERE position>=3""", " ".join(_DM), 9)
def design_matrix(spark, sf):
    return FE.design_matrix(A.segments(spark, sf)).select("event_id", "position", *_DM)


def _grad(c):
    return f"CASE WHEN lag({c}) OVER s IS NULL THEN lead({c}) OVER s-{c} WHEN lead({c}) OVER s IS NULL THEN {c}-lag({c}) OVER s ELSE (lead({c}) OVER s-lag({c}) OVER s)/2 END"


@query("win9_kinematic", with_sql("seg") + f"""
SELECT event_id, {_grad('sog')} AS acceleration, coalesce({fold('(cog-lag(cog) OVER s)')},0) AS turn, sog*sin(radians(cog)) AS sog_sin_cog FROM seg {_S}""", "acceleration turn sog_sin_cog")
def kinematic(spark, sf):
    return FE.kinematic_features(A.segments(spark, sf)).select("event_id", "acceleration", "turn", "sog_sin_cog")


@query("win10_interaction", with_sql("seg") + f"""
SELECT event_id, sog*cos(radians(cog)) AS vx, sog*sin(radians(cog)) AS vy, {_grad('lat')} AS lat_change, {_grad('lon')} AS lon_change FROM seg {_S}""", "vx vy lat_change lon_change")
def interaction(spark, sf):
    return FE.interaction_features(A.segments(spark, sf)).select("event_id", "vx", "vy", "lat_change", "lon_change")


@query("win11_spatial_context", with_sql("step", "port") + f""", np AS (SELECT event_id, min({hav('step.lat', 'step.lon', 'port.lat', 'port.lon')}) AS port_km FROM step, port GROUP BY 1)
SELECT event_id, sqrt((lat-avg(lat) OVER g)*(lat-avg(lat) OVER g)+(lon-avg(lon) OVER g)*(lon-avg(lon) OVER g)) AS centroid_distance,
  stddev_pop(lat) OVER g AS spread_lat, stddev_pop(lon) OVER g AS spread_lon, sum(distance_km) OVER s AS cumulative_km, port_km
FROM step JOIN np USING (event_id) WINDOW g AS (PARTITION BY mmsi, segment_id), s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id)""",
       "centroid_distance spread_lat spread_lon cumulative_km port_km", 5)
def spatial_context(spark, sf):
    out = FE.spatial_context(TR.with_segments(A.positions(spark, sf)))
    return P.nearest_port(out, A.ports(spark, sf)).select(
        "event_id", "centroid_distance", "spread_lat", "spread_lon", "cumulative_km", "port_km")


@query("win12_centre_distance", with_sql("pos") + f"""
SELECT event_id, {hav('lat', 'lon', 'mlat', 'mlon')}/1.852 AS centre_nm FROM pos, (SELECT avg(lat) AS mlat, avg(lon) AS mlon FROM pos)""", "centre_nm")
def centre(spark, sf):
    return FE.area_centre_distance(A.positions(spark, sf)).select("event_id", "centre_nm")


@query("win13_sequences", with_sql("pos") + """
SELECT * FROM (SELECT mmsi, event_id AS sample_id, time AS start_time, avg(lat) OVER i AS mean_lat, lead(sog,9) OVER v AS last_sog, lead(lat,14) OVER v AS target_lat,
  sum(cog) OVER t AS target_cog_sum, lead(event_id,14) OVER v AS ender FROM pos
WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id), i AS (PARTITION BY mmsi ORDER BY time, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING),
 t AS (PARTITION BY mmsi ORDER BY time, event_id ROWS BETWEEN 10 FOLLOWING AND 14 FOLLOWING)) WHERE ender IS NOT NULL""".replace("SELECT * FROM (", "SELECT mmsi, sample_id, start_time, mean_lat, last_sog, target_lat, target_cog_sum FROM ("),
       "mean_lat last_sog target_lat target_cog_sum")
def sequences(spark, sf):
    s = FE.sequences(A.positions(spark, sf), 10, 5)
    add = lambda c: lambda a, p: a + p[c]
    return s.select("mmsi", "sample_id", "start_time", (F.aggregate("input", F.lit(0.0), add("lat")) / 10).alias("mean_lat"),
                    F.element_at("input", -1)["sog"].alias("last_sog"), F.element_at("target", -1)["lat"].alias("target_lat"),
                    F.aggregate("target", F.lit(0.0), add("cog")).alias("target_cog_sum"))


@query("win14_strided_windows", with_sql("pos", "latest") + """
SELECT w.mmsi, sample_id, last_lat, target_lon, ship_type, length FROM (SELECT mmsi, event_id AS sample_id, lead(lat,11) OVER v AS last_lat, lead(lon,15) OVER v AS target_lon, row_number() OVER v AS r FROM pos
WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id)) w LEFT JOIN latest USING (mmsi) WHERE target_lon IS NOT NULL AND (r-1)%5=0""", "last_lat target_lon")
def strided(spark, sf):
    from wakeline.operators import statics as ST

    s = FE.sequences(A.positions(spark, sf), 12, 4, stride=5)
    s = ST.enrich(s, ST.merged_static(A.static_messages(spark, sf)))
    return s.select("mmsi", "sample_id", F.element_at("input", -1)["lat"].alias("last_lat"),
                    F.element_at("target", -1)["lon"].alias("target_lon"), "ship_type", "length")


@query("win15_reconstruction_windows", with_sql("pos") + """
SELECT mmsi, event_id AS sample_id, l AS last_lat, true AS same FROM (SELECT mmsi, event_id, lead(lat,9) OVER v AS l FROM pos
WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id)) WHERE l IS NOT NULL""", "last_lat")
def reconstruction(spark, sf):
    s = FE.reconstruction_windows(A.positions(spark, sf), 10)
    return s.select("mmsi", "sample_id", F.element_at("target", -1)["lat"].alias("last_lat"), (F.col("input") == F.col("target")).alias("same"))


@query("win16_label_windows", with_sql("pos") + """
SELECT mmsi, event_id AS sample_id, fast FROM (SELECT mmsi, event_id, lead(coalesce(sog,0)>20,9) OVER v AS fast FROM pos
WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id)) WHERE fast IS NOT NULL""")
def labels(spark, sf):
    p = A.positions(spark, sf).withColumn("fast", F.coalesce(F.col("sog"), F.lit(0.0)) > 20)
    return FE.label_windows(p, 10, ["fast"]).select("mmsi", "sample_id", "fast")


@query("win17_horizon_targets", with_sql("seg") + "SELECT event_id, " + ", ".join(
    f"lead({c},{h}) OVER s-{c} AS {c}_h{h}" for c in ("lat", "lon") for h in (1, 2, 3)) + f" FROM seg {_S}", "lat_h1 lat_h2 lat_h3 lon_h1 lon_h2 lon_h3")
def horizon_targets(spark, sf):
    return FE.horizon_targets(A.segments(spark, sf), 3).select("event_id", *[f"{c}_h{h}" for c in ("lat", "lon") for h in (1, 2, 3)])


@query("win18_integrate_deltas", with_sql("seg") + f"""
SELECT event_id AS sample_id, step, lat+(CASE step WHEN 1 THEN 1 WHEN 2 THEN 1+0.9 ELSE 1+0.9+0.8 END::DOUBLE)*dlat AS lat, lon+(CASE step WHEN 1 THEN 1 WHEN 2 THEN 1+0.9 ELSE 1+0.9+0.8 END::DOUBLE)*dlon AS lon
FROM (SELECT event_id, lat, lon, lat-lag(lat) OVER s AS dlat, lon-lag(lon) OVER s AS dlon FROM seg {_S}), (VALUES (1),(2),(3)) t(step) WHERE dlat IS NOT NULL""", "lat lon")
def integrate(spark, sf):
    s = TR.with_segments(A.positions(spark, sf)).filter(~F.col("starts_segment"))
    d = s.select(F.col("event_id").alias("sample_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("step"),
                 F.col("lat").alias("last_lat"), F.col("lon").alias("last_lon"),
                 (F.col("lat") - F.col("prev.lat")).alias("d_lat"), (F.col("lon") - F.col("prev.lon")).alias("d_lon"))
    fade = 1.1 - F.col("step") * 0.1
    d = d.withColumns({"d_lat": F.col("d_lat") * fade, "d_lon": F.col("d_lon") * fade})
    return FE.integrate_deltas(d).select("sample_id", "step", "lat", "lon")


@query("win19_z_scores", with_sql("pos") + """
SELECT event_id, (sog-ms)/(ss+1e-8::DOUBLE) AS sog_z, (cog-mc)/(sc+1e-8::DOUBLE) AS cog_z FROM pos,
 (SELECT avg(sog) AS ms, stddev_samp(sog) AS ss, avg(cog) AS mc, stddev_samp(cog) AS sc FROM pos)""", "sog_z cog_z")
def z_scores(spark, sf):
    return FE.z_scores(A.positions(spark, sf), ["sog", "cog"]).select("event_id", "sog_z", "cog_z")


@query("win20_train_scaler", with_sql("pos") + """
SELECT event_id, (lat-ml)/sl AS lat_scaled, (cog-mc)/sc AS cog_scaled FROM pos,
 (SELECT avg(lat) AS ml, stddev_samp(lat) AS sl, avg(cog) AS mc, stddev_samp(cog) AS sc FROM pos WHERE time<TIMESTAMP '2024-01-01 08:00:00')""", "lat_scaled cog_scaled")
def train_scaler(spark, sf):
    p = A.positions(spark, sf)
    model = FE.fit_scaler(p.filter(F.col("time") < F.lit("2024-01-01 08:00:00").cast("timestamp")), ["lat", "cog"])
    return FE.apply_scaler(model, p, ["lat", "cog"]).select("event_id", "lat_scaled", "cog_scaled")


@query("win21_interval_histogram", with_sql("gap") + """
SELECT CAST(least(floor(time_diff/60),59) AS BIGINT) AS bin, count(*) AS n FROM gap WHERE time_diff/60 BETWEEN 0 AND 60 GROUP BY 1""")
def interval_histogram(spark, sf):
    return FE.interval_histogram(A.positions(spark, sf))


@query("win22_behaviour_windows", with_sql("step") + f"""
SELECT event_id, avg(sog) OVER w AS mean_speed, max(sog) OVER w AS max_speed, stddev_samp(sog) OVER w AS std_speed,
  CAST(sum(CASE WHEN abs(course_delta)>10 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS sharp_turns,
  {circ('lead(bearing) OVER s', 'bearing')} AS leg_angle, sog*0.514444/nullif(radians(abs(turn_rate))/60,0) AS turn_radius_m FROM step
WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id), w AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id ROWS 9 PRECEDING)""",
       "mean_speed max_speed std_speed leg_angle turn_radius_m", 5)
def behaviour_windows(spark, sf):
    return FE.behaviour_windows(A.steps(spark, sf)).select("event_id", "mean_speed", "max_speed", "std_speed", "sharp_turns", "leg_angle", "turn_radius_m")


@query("win22_turn_per_length", with_sql("step", "latest") + """
SELECT event_id, abs(turn_rate)/nullif(length,0) AS turn_per_metre FROM step LEFT JOIN latest USING (mmsi)""", "turn_per_metre")
def turn_per_length(spark, sf):
    from wakeline.operators import statics as ST

    s = ST.enrich(A.steps(spark, sf), ST.merged_static(A.static_messages(spark, sf)))
    return FE.turn_per_length(s).select("event_id", "turn_per_metre")
