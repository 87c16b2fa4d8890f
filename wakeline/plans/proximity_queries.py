"""Registered queries: neighbours, collision features, rules of the road."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wakeline.functions import codes
from wakeline.operators import collision as CO
from wakeline.operators import models as M
from wakeline.operators import proximity as P
from wakeline.operators import tracks as TR
from wakeline.plans import adapter as A
from wakeline.plans.adapter import bear, circ, fold, hav, secs, with_sql
from wakeline.plans.registry import query

MPD = "(6371000.0::DOUBLE*3.141592653589793::DOUBLE/180)"


def _pairs(extra="", radius=10.0, width=60, state="pos", same=False):
    apart = "" if same else " AND a.mmsi<>b.mmsi"
    return f""", bk AS (SELECT *, epoch_us(time)//{width}000000*{width} AS bucket FROM {state}{extra}),
pair AS (SELECT * FROM (SELECT a.bucket, a.event_id, a.mmsi, a.time, a.lat, a.lon, a.sog, a.cog, b.event_id AS oid, b.mmsi AS omm, b.lat AS olat, b.lon AS olon, b.sog AS osog, b.cog AS ocog,
  {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}/1.852 AS d FROM bk a JOIN bk b ON a.bucket=b.bucket AND a.event_id<>b.event_id{apart}) WHERE d<{radius})
"""


def _cpa(src="pair"):
    return f""", c0 AS (SELECT *, (olon-lon)*(cos(radians(lat))*{MPD}) AS dx, (olat-lat)*{MPD} AS dy,
  sog*0.514444*cos(radians(90-cog)) AS vx1, sog*0.514444*sin(radians(90-cog)) AS vy1, osog*0.514444*cos(radians(90-ocog)) AS vx2, osog*0.514444*sin(radians(90-ocog)) AS vy2 FROM {src}),
c1 AS (SELECT *, vx2-vx1 AS dvx, vy2-vy1 AS dvy, (vx2-vx1)*(vx2-vx1)+(vy2-vy1)*(vy2-vy1) AS rel2 FROM c0),
c2 AS (SELECT *, CASE WHEN rel2<1e-10 THEN 0 ELSE -(dx*dvx+dy*dvy)/rel2 END AS tcpa FROM c1),
cpa AS (SELECT *, sqrt((dx+dvx*tcpa)*(dx+dvx*tcpa)+(dy+dvy*tcpa)*(dy+dvy*tcpa)) AS cpa, sqrt(rel2)/0.514444 AS rel_kn FROM c2)
"""


_FULL = " WHERE lat IS NOT NULL AND sog IS NOT NULL AND cog IS NOT NULL"


@query("jon4_near_pairs", with_sql("pos") + _pairs() + "SELECT event_id, oid AS other_event_id, d AS distance_nm FROM pair", "distance_nm")
def near_pairs(spark, sf):
    return P.near_pairs(A.positions(spark, sf)).select("event_id", "other_event_id", "distance_nm")


@query("jon4_near_pairs_same_vessel", with_sql("pos") + _pairs(same=True) + "SELECT event_id, oid AS other_event_id, d AS distance_nm FROM pair", "distance_nm")
def near_pairs_same(spark, sf):
    return P.near_pairs(A.positions(spark, sf), same_vessel=True).select("event_id", "other_event_id", "distance_nm")


@query("jon5_in_port", with_sql("pos", "port") + f"""
SELECT event_id, bool_or({hav('pos.lat', 'pos.lon', 'port.lat', 'port.lon')}/1.852<=1) AS in_port FROM pos, port GROUP BY 1""")
def in_port(spark, sf):
    return P.in_port(A.positions(spark, sf), A.ports(spark, sf)).select("event_id", "in_port")


@query("jon5_nearest_port", with_sql("pos", "port") + f"""
SELECT event_id, arg_min(port_id, d) AS port_id, min(d) AS port_km FROM (SELECT event_id, port_id, {hav('pos.lat', 'pos.lon', 'port.lat', 'port.lon')} AS d FROM pos, port) GROUP BY 1""", "port_km")
def nearest_port(spark, sf):
    return P.nearest_port(A.positions(spark, sf), A.ports(spark, sf)).select("event_id", "port_id", "port_km")


@query("jon6_nearest_waypoint", with_sql("pos", "port") + """
SELECT event_id, min(d) AS degrees FROM (SELECT event_id, port_id, sqrt((pos.lat-port.lat)*(pos.lat-port.lat)+(pos.lon-port.lon)*(pos.lon-port.lon)) AS d FROM pos, port) GROUP BY 1""", "degrees")
def nearest_waypoint(spark, sf):
    return P.nearest_place(A.positions(spark, sf), A.ports(spark, sf), "port_id", "waypoint_id", "degrees", planar=True).select("event_id", "degrees")


@query("jon7_nearest_vessel", with_sql("pos") + _pairs() + "SELECT event_id, arg_min(oid, (d, oid)) AS other_event_id, min(d) AS distance_nm FROM pair GROUP BY 1", "distance_nm")
def nearest_vessel(spark, sf):
    return P.nearest_neighbours(P.nearest_pairs(A.positions(spark, sf))).select("event_id", "other_event_id", "distance_nm")


_CPA = with_sql("pos") + _pairs(_FULL) + _cpa()


@query("col1_cpa_tcpa", _CPA + f"""
SELECT event_id, oid AS other_event_id, cpa AS cpa_m, tcpa AS tcpa_s, CASE WHEN rel2<1e-10 THEN 'parallel' WHEN tcpa>0 THEN 'approaching' ELSE 'receding' END AS motion,
  vy1*tcpa/{MPD}+lat AS cpa_lat, vx1*tcpa/(cos(radians(lat))*{MPD})+lon AS cpa_lon,
  CASE WHEN NOT tcpa>0 THEN 'none' WHEN cpa<=250 AND tcpa<=600 THEN 'critical' WHEN cpa<=375 AND tcpa<=600 THEN 'high' WHEN cpa<=500 AND tcpa<=600 THEN 'medium'
    WHEN cpa<=750 AND tcpa<=900 THEN 'low' ELSE 'none' END AS warning FROM cpa""", "cpa_m tcpa_s cpa_lat cpa_lon", 4)
def cpa_tcpa(spark, sf):
    pairs = P.near_pairs(A.positions(spark, sf).dropna(subset=["sog", "cog"]))
    return CO.with_cpa(pairs).select("event_id", "other_event_id", "cpa_m", "tcpa_s", "motion", "cpa_lat", "cpa_lon", "warning")


_COL = _CPA + f""", agg AS (SELECT event_id, min(cpa) AS mc, min(tcpa) FILTER (tcpa>0) AS mt, count(*) AS n, arg_min(rel_kn, (cpa, oid)) AS rs,
  arg_min({bear('lat', 'lon', 'olat', 'olon')}, (cpa, oid)) AS rb FROM cpa GROUP BY 1),
col AS (SELECT pos.event_id, coalesce(mc,'Infinity'::DOUBLE) AS min_cpa, coalesce(mt,'Infinity'::DOUBLE) AS min_tcpa, coalesce(n,0) AS num_nearby, coalesce(rs,0) AS relative_speed, coalesce(rb,0) AS relative_bearing
  FROM pos LEFT JOIN agg USING (event_id))
"""


@query("col2_collision_features", _COL + "SELECT * FROM col", "min_cpa min_tcpa relative_speed relative_bearing", 4)
def collision_features(spark, sf):
    return CO.collision_features(A.positions(spark, sf)).select(
        "event_id", "min_cpa", "min_tcpa", "num_nearby", "relative_speed", "relative_bearing")


@query("col3_col4_collision_targets", _COL + """
SELECT event_id, CASE WHEN min_cpa<250 AND min_tcpa<300 THEN 1.0 WHEN min_cpa<500 AND min_tcpa<600 THEN 0.75 WHEN min_cpa<1000 AND min_tcpa<1200 THEN 0.5
  WHEN min_cpa<2000 AND min_tcpa<1800 THEN 0.25 ELSE 0 END::DOUBLE AS collision_risk, min_tcpa AS time_to_collision FROM col""", "collision_risk time_to_collision", 4)
def collision_targets(spark, sf):
    return CO.collision_targets(CO.collision_features(A.positions(spark, sf))).select("event_id", "collision_risk", "time_to_collision")


@query("col5_edge_features", _CPA + """
SELECT event_id, avg(d) AS avg_distance, min(d) AS min_distance, avg(rel_kn) AS avg_relative_velocity, min(tcpa) FILTER (tcpa>0) AS min_tcpa, count(*) AS degree FROM cpa GROUP BY 1""",
       "avg_distance min_distance avg_relative_velocity min_tcpa", 4)
def edge_features(spark, sf):
    return CO.edge_features(A.positions(spark, sf))


@query("col6_graph_features", with_sql("pos") + _pairs() + """,
deg AS (SELECT bucket, event_id, count(*) AS d FROM pair GROUP BY 1,2),
tri AS (SELECT a.bucket, a.event_id, count(*) AS t FROM pair a JOIN pair b ON a.bucket=b.bucket AND a.event_id=b.event_id AND a.oid<b.oid
  JOIN pair c ON c.bucket=a.bucket AND c.event_id=a.oid AND c.oid=b.oid GROUP BY 1,2),
loc AS (SELECT deg.bucket, sum(deg.d) AS ends, sum(CASE WHEN deg.d>1 THEN coalesce(t,0)*2.0::DOUBLE/(deg.d*(deg.d-1)) ELSE 0 END) AS c FROM deg LEFT JOIN tri USING (bucket, event_id) GROUP BY 1)
SELECT n.bucket, n, coalesce(ends,0)/(n*(n-1))::DOUBLE AS density, coalesce(ends,0)/n::DOUBLE AS avg_degree, coalesce(c,0)/n AS clustering
FROM (SELECT bucket, count(*) AS n FROM bk GROUP BY 1 HAVING count(*)>=3) n LEFT JOIN loc USING (bucket)""", "density avg_degree clustering")
def graph_features(spark, sf):
    return CO.graph_features(A.positions(spark, sf))


@query("col7_interaction_score", _CPA + """, near AS (SELECT event_id, min(d) AS d, arg_min(cpa, (d, oid)) AS c FROM cpa GROUP BY 1)
SELECT pos.event_id, CASE WHEN d IS NULL THEN 0 ELSE 0.6::DOUBLE*least(greatest(1-d/10,0),1)+0.4::DOUBLE*least(greatest(1-c/1000/1.852/0.27,0),1) END AS interaction_score
FROM pos LEFT JOIN near USING (event_id)""", "interaction_score")
def interaction_score(spark, sf):
    return CO.interaction_scores(A.positions(spark, sf)).select("event_id", "interaction_score")


_SNAP = with_sql("pos") + _pairs(width=600, radius="5/1.852", same=True)


@query("col8_snapshot_nodes", _SNAP + "SELECT bucket, event_id, lat, lon, sog, cog, count(*) OVER (PARTITION BY bucket) AS size FROM bk QUALIFY count(*) OVER (PARTITION BY bucket)>=2", "lat lon sog cog")
def snapshot_nodes(spark, sf):
    nodes, _, sizes = CO.graph_snapshots(A.positions(spark, sf))
    return nodes.join(sizes, "bucket")


@query("col8_snapshot_edges", _SNAP + "SELECT bucket, event_id, oid AS other_event_id, d*1.852 AS distance_km FROM pair", "distance_km")
def snapshot_edges(spark, sf):
    return CO.graph_snapshots(A.positions(spark, sf))[1]


_ENC = _CPA + f""", e0 AS (SELECT *, {bear('lat', 'lon', 'olat', 'olon')} AS b FROM cpa),
e1 AS (SELECT *, ((b-cog)%360+360)%360 AS b1, (((b+180)%360-ocog)%360+360)%360 AS b2, {circ('cog', 'ocog')} AS ang FROM e0),
enc AS (SELECT *, CASE WHEN b1 BETWEEN 135 AND 225 THEN 'overtaking_taken' WHEN b2 BETWEEN 135 AND 225 THEN 'overtaking_given'
  WHEN ang>=165 AND (b1<=15 OR b1>=345) AND (b2<=15 OR b2>=345) THEN 'head_on' WHEN ang<=15 THEN 'parallel_same' WHEN ang>=165 THEN 'parallel_opposite'
  WHEN b1>0 AND b1<180 THEN 'crossing_starboard' WHEN b1>180 THEN 'crossing_port' ELSE 'unknown' END AS encounter FROM e1)
"""
_ACT = """CASE WHEN encounter='head_on' THEN 'both_alter' WHEN encounter IN ('crossing_starboard','overtaking_taken') THEN 'give_way'
  WHEN encounter IN ('crossing_port','overtaking_given') THEN 'stand_on' WHEN encounter LIKE 'parallel%' THEN 'no_action' ELSE 'unknown' END"""
_OACT = """CASE WHEN encounter='head_on' THEN 'both_alter' WHEN encounter IN ('crossing_starboard','overtaking_taken') THEN 'stand_on'
  WHEN encounter IN ('crossing_port','overtaking_given') THEN 'give_way' WHEN encounter LIKE 'parallel%' THEN 'no_action' ELSE 'unknown' END"""


def _encounters(spark, sf):
    pairs = P.near_pairs(A.positions(spark, sf).dropna(subset=["sog", "cog"]))
    return CO.with_encounter(CO.with_cpa(pairs))


@query("col9_bearings", _ENC + "SELECT event_id, oid AS other_event_id, b1 AS bearing_off_bow, b2 AS other_bearing_off_bow, ang AS crossing_angle FROM enc", "bearing_off_bow other_bearing_off_bow crossing_angle")
def bearings(spark, sf):
    return _encounters(spark, sf).select("event_id", "other_event_id", "bearing_off_bow", "other_bearing_off_bow", "crossing_angle")


@query("col10_col11_encounters", _ENC + f"""
SELECT event_id, oid AS other_event_id, encounter, {_ACT} AS action, {_OACT} AS other_action,
  CASE WHEN encounter='head_on' THEN 'high' WHEN encounter LIKE 'crossing%' THEN CASE WHEN b1 BETWEEN 60 AND 120 OR b1 BETWEEN 240 AND 300 THEN 'high' ELSE 'medium' END
  WHEN encounter LIKE 'overtaking%' THEN 'medium' WHEN encounter LIKE 'parallel%' THEN 'low' ELSE 'none' END AS encounter_risk FROM enc""")
def encounters(spark, sf):
    return _encounters(spark, sf).select("event_id", "other_event_id", "encounter", "action", "other_action", "encounter_risk")


_DONE = f""", moved AS (SELECT event_id, {fold('(lead(cog) OVER v-cog)')} AS dc, lead(sog) OVER v-sog AS ds FROM pos WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id)),
judged AS (SELECT enc.event_id, enc.oid, {_ACT} AS action, {_OACT} AS oaction, coalesce(m.dc,0) AS dc, coalesce(m.ds,0) AS ds, coalesce(o.dc,0) AS odc, coalesce(o.ds,0) AS ods
  FROM enc LEFT JOIN moved m ON m.event_id=enc.event_id LEFT JOIN moved o ON o.event_id=enc.oid)
"""


def _ok(action, dc, ds):
    held = f"(abs({dc})<=5 AND abs({ds})<=0.1)"
    return f"CASE WHEN {action}='stand_on' THEN {held} WHEN {action} IN ('give_way','both_alter') THEN NOT {held} ELSE true END"


@query("col12_compliance", _ENC + _DONE + f"""
SELECT event_id, oid AS other_event_id, {_ok('action', 'dc', 'round(ds,3)')} AS compliant, {_ok('oaction', 'odc', 'round(ods,3)')} AS other_compliant,
  ({_ok('action', 'dc', 'round(ds,3)')}) AND ({_ok('oaction', 'odc', 'round(ods,3)')}) AS overall_compliant FROM judged""")
def compliance(spark, sf):
    from wakeline.functions import geo
    from wakeline.operators import ordered as O

    p = O.with_next(A.positions(spark, sf), ["sog", "cog"])
    actions = F.struct(geo.angle_delta(F.col("next.cog") - F.col("cog")).alias("course_change"),
                       F.round(F.col("next.sog") - F.col("sog"), 3).alias("speed_change"))
    # what a row's number did goes with the row, so that pairs needn't be joined
    p = p.withColumn("did", actions).withColumn("done", F.collect_list("did").over(Window.partitionBy("event_id")))
    pairs = P.near_pairs(O.unchunked(p).dropna(subset=["sog", "cog"]), state=[*P.STATE, "done"])
    out = CO.check_compliance(CO.with_encounter(CO.with_cpa(pairs)))
    return out.select("event_id", "other_event_id", "compliant", "other_compliant", "overall_compliant")


# Forecast against truth: one dead-reckoned step per fix, met by the others of that minute.
FORECAST = f""", lagged AS (SELECT *, lag(time) OVER s AS t1, lag(time,2) OVER s AS t2, lag(lat) OVER s AS lat1, lag(lon) OVER s AS lon1,
  {", ".join(f"lead({c},{h}) OVER s AS {c}_{h}" for h in (1, 2, 3, 4, 5) for c in ("time", "lat", "lon", "sog", "cog"))} FROM seg
  WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id)),
speed AS (SELECT *, greatest({secs('time', 't1')},1e-6) AS gap, greatest(coalesce(({secs('time', 't1')}+{secs('t1', 't2')})/2,{secs('time', 't1')}),1e-6) AS dt FROM lagged WHERE lat1 IS NOT NULL AND lat_5 IS NOT NULL),
raw AS (SELECT *, (lon-lon1)*(cos(radians(lat1))*{MPD})/gap AS rx, (lat-lat1)*{MPD}/gap AS ry FROM speed),
cap AS (SELECT *, CASE WHEN sqrt(rx*rx+ry*ry)>50*0.514444 THEN 50*0.514444/sqrt(rx*rx+ry*ry) ELSE 1 END AS k FROM raw),
fc AS (SELECT mmsi, segment_id, event_id AS sample_id, time AS origin_time, h AS step, ry*k*(dt*h)/{MPD}+lat AS pred_lat, rx*k*(dt*h)/(cos(radians(lat))*{MPD})+lon AS pred_lon, sog AS pred_sog, cog AS pred_cog,
  {", ".join(f"CASE h {' '.join(f'WHEN {h} THEN {c}_{h}' for h in (1, 2, 3, 4, 5))} END AS true_{c}" for c in ("time", "lat", "lon", "sog", "cog"))}
  FROM cap, (VALUES (1),(2),(3),(4),(5)) t(h))
"""
FORECAST_COLS = "pred_lat pred_lon pred_sog pred_cog true_lat true_lon true_sog true_cog"


def forecast(spark, sf, horizon=5):
    return M.dead_reckoning(TR.with_segments(A.positions(spark, sf)).drop("prev"), horizon)


@query("mdl1_dead_reckoning", with_sql("seg") + FORECAST + f"SELECT mmsi, segment_id, sample_id, step, {', '.join(FORECAST_COLS.split())} FROM fc", FORECAST_COLS)
def dead_reckoning(spark, sf):
    return forecast(spark, sf).select("mmsi", "segment_id", "sample_id", "step", *FORECAST_COLS.split())


def _first_step(spark, sf):
    """Predicted and true state one step ahead, paired with the vessels near the truth."""
    one = forecast(spark, sf).filter("step = 1").dropna(subset=["pred_sog", "true_sog"])
    truth = one.select(F.col("sample_id").alias("event_id"), "mmsi", F.col("true_time").alias("time"), F.col("true_lat").alias("lat"),
                       F.col("true_lon").alias("lon"), F.col("true_sog").alias("sog"), F.col("true_cog").alias("cog"),
                       F.struct(*[F.col(f"pred_{c}").alias(f"_{c}") for c in ("lat", "lon", "sog", "cog")]).alias("pred"))
    # what a row's number predicts goes with the row, so that pairs needn't be joined
    truth = truth.withColumn("preds", F.collect_list("pred").over(Window.partitionBy("event_id")))
    pairs = P.near_pairs(truth, state=[*P.STATE, "preds"], other_state=P.STATE)
    true = CO.with_cpa(pairs).withColumnsRenamed({"cpa_m": "true_cpa_m", "tcpa_s": "true_tcpa_s"})
    both = true.select("*", F.inline("preds")).drop("preds", "lat", "lon", "sog", "cog", "motion", "warning", "relative_knots", "cpa_lat", "cpa_lon", "other_cpa_lat", "other_cpa_lon")
    both = both.withColumnsRenamed({f"_{c}": c for c in ("lat", "lon", "sog", "cog")})
    return CO.with_cpa(both).withColumnsRenamed({"cpa_m": "pred_cpa_m", "tcpa_s": "pred_tcpa_s"})


def _cpa_on(src, lat, lon, sog, cog, out):
    dx, dy = f"(olon-{lon})*(cos(radians({lat}))*{MPD})", f"(olat-{lat})*{MPD}"
    dvx = f"(osog*0.514444*cos(radians(90-ocog))-{sog}*0.514444*cos(radians(90-{cog})))"
    dvy = f"(osog*0.514444*sin(radians(90-ocog))-{sog}*0.514444*sin(radians(90-{cog})))"
    return f""", {out}0 AS (SELECT *, {dx} AS {out}dx, {dy} AS {out}dy, {dvx} AS {out}vx, {dvy} AS {out}vy FROM {src}),
{out}1 AS (SELECT *, CASE WHEN {out}vx*{out}vx+{out}vy*{out}vy<1e-10 THEN 0 ELSE -({out}dx*{out}vx+{out}dy*{out}vy)/({out}vx*{out}vx+{out}vy*{out}vy) END AS {out}_t FROM {out}0),
{out} AS (SELECT *, sqrt(({out}dx+{out}vx*{out}_t)*({out}dx+{out}vx*{out}_t)+({out}dy+{out}vy*{out}_t)*({out}dy+{out}vy*{out}_t)) AS {out}_c FROM {out}1)"""


FIRST = FORECAST + """, one AS (SELECT * FROM fc WHERE step=1 AND pred_sog IS NOT NULL AND true_sog IS NOT NULL),
tru AS (SELECT sample_id AS event_id, mmsi, true_time AS time, true_lat AS lat, true_lon AS lon, true_sog AS sog, true_cog AS cog FROM one)
""" + _pairs(state="tru") + ", pp AS (SELECT pair.*, one.pred_lat, one.pred_lon, one.pred_sog, one.pred_cog FROM pair JOIN one ON one.sample_id=pair.event_id)" + _cpa_on(
    "pp", "lat", "lon", "sog", "cog", "tr") + _cpa_on("tr", "pred_lat", "pred_lon", "pred_sog", "pred_cog", "pr") + "\n"


@query("col13_cpa_forecast_errors", with_sql("seg") + FIRST + """
SELECT avg((abs(pr_c-tr_c)<=50)::INT) AS distance_accuracy_rate, avg((abs(pr_t-tr_t)<=30)::INT) AS time_accuracy_rate, avg((abs(pr_c-tr_c)<=50 AND abs(pr_t-tr_t)<=30)::INT) AS overall_accuracy_rate,
  avg(abs(pr_c-tr_c)) AS mean_distance_error_m, stddev_pop(abs(pr_c-tr_c)) AS std_distance_error_m, quantile_cont(abs(pr_c-tr_c),0.5) AS median_distance_error_m FROM pr""",
       "distance_accuracy_rate time_accuracy_rate overall_accuracy_rate mean_distance_error_m std_distance_error_m median_distance_error_m", 3)
def cpa_forecast_errors(spark, sf):
    from wakeline.operators import quantiles as Q

    e = CO.cpa_forecast_errors(_first_step(spark, sf))
    rate = lambda c: F.avg(F.col(c).cast("int"))
    means = e.agg(rate("distance_accurate").alias("distance_accuracy_rate"), rate("time_accurate").alias("time_accuracy_rate"),
                  rate("overall_accurate").alias("overall_accuracy_rate"), F.avg("distance_error_m").alias("mean_distance_error_m"),
                  F.stddev_pop("distance_error_m").alias("std_distance_error_m"))
    median = Q.percentiles(e, [], "distance_error_m", {"median_distance_error_m": 0.5}, again=True)
    return Q.side_by_side(means, median)


@query("col14_collision_forecast_metrics", with_sql("seg") + FIRST + """
SELECT avg(abs(pr_c-tr_c)) AS cpa_error_mean, stddev_pop(abs(pr_c-tr_c)) AS cpa_error_std, count(*) FILTER (tr_c<500 AND pr_c<500)/nullif(count(*) FILTER (tr_c<500),0)::DOUBLE AS collision_recall, count(*) AS encounters FROM pr""",
       "cpa_error_mean cpa_error_std collision_recall", 3)
def collision_metrics(spark, sf):
    return CO.collision_forecast_metrics(_first_step(spark, sf)).drop("tcpa_error_mean")


WARN = FIRST + """, warn AS (SELECT event_id, time, mmsi, omm, pr_t/60 AS warning_time, tr_c>1000 AS false_positive, pr_c AS cpa_distance, pr_t AS tcpa_time,
  CASE WHEN pr_c<100 AND pr_t<120 THEN 'critical' WHEN pr_c<300 AND pr_t<300 THEN 'high' WHEN pr_c<500 AND pr_t<600 THEN 'medium' ELSE 'low' END AS severity FROM pr WHERE pr_c<1000)
"""


def warnings(spark, sf):
    return CO.warning_events(_first_step(spark, sf))


@query("col15_warning_events", with_sql("seg") + WARN + "SELECT event_id, mmsi, CAST(omm AS VARCHAR) AS other_mmsi, false_positive, severity, cpa_distance FROM warn", "cpa_distance", 3)
def warning_events(spark, sf):
    return warnings(spark, sf).select("event_id", "mmsi", F.col("metadata")["other_mmsi"].alias("other_mmsi"), "false_positive", "severity", "cpa_distance")


@query("fn16_severity_ladders", _CPA + """
SELECT event_id, oid AS other_event_id, CASE WHEN cpa<250 AND tcpa<300 AND tcpa>0 THEN 1.0 WHEN cpa<500 AND tcpa<600 AND tcpa>0 THEN 0.75 WHEN cpa<1000 AND tcpa<1200 AND tcpa>0 THEN 0.5 WHEN cpa<2000 AND tcpa<1800 AND tcpa>0 THEN 0.25 ELSE 0 END::DOUBLE AS risk,
  CASE WHEN cpa<100 AND tcpa<120 THEN 'critical' WHEN cpa<300 AND tcpa<300 THEN 'high' WHEN cpa<500 AND tcpa<600 THEN 'medium' ELSE 'low' END AS ops,
  CASE WHEN tcpa<120 THEN 'critical' WHEN tcpa<300 THEN 'high' WHEN tcpa<600 THEN 'medium' ELSE 'low' END AS other_ops,
  CASE WHEN cpa<500 AND tcpa<600 THEN 'high' WHEN cpa<2000 AND tcpa<1800 THEN 'medium' ELSE 'low' END AS tier FROM cpa""", "risk")
def severities(spark, sf):
    c = CO.with_cpa(P.near_pairs(A.positions(spark, sf).dropna(subset=["sog", "cog"])))
    d, t = F.col("cpa_m"), F.col("tcpa_s")
    return c.select("event_id", "other_event_id", codes.collision_risk(d, t).alias("risk"), codes.ops_severity(d, t, F.lit("collision")).alias("ops"),
                    codes.ops_severity(d, t, F.lit("grounding")).alias("other_ops"), codes.alert_tier(d, t).alias("tier"))
