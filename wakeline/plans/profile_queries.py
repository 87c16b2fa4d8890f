"""Registered queries: profiles, data quality, warning statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import clean as C
from wakeline.operators import profile as PR
from wakeline.operators import quality as QU
from wakeline.operators import statics as ST
from wakeline.plans import adapter as A
from wakeline.plans.adapter import hav, secs, with_sql
from wakeline.plans.proximity_queries import WARN, warnings
from wakeline.plans.registry import query


@query("agg2_dataset_summary", with_sql("pos") + f"""
SELECT count(*) AS messages, count(DISTINCT mmsi) AS vessels, min(time) AS first_time, max(time) AS last_time, {secs('max(time)', 'min(time)')}/86400 AS duration_days,
  min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, array_to_string(list_sort(list(DISTINCT msg_type)), ',') AS msg_types FROM pos""",
       "duration_days min_lat max_lat min_lon max_lon")
def summary(spark, sf):
    return PR.dataset_summary(A.positions(spark, sf))


_KIN = ("sog", "cog", "heading", "turn_rate", "acceleration")


@query("agg3_kinematic_statistics", with_sql("step") + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, 100.0::DOUBLE*count({c})/count(*) AS valid_percent,
  quantile_cont({c},0.25) AS q25, quantile_cont({c},0.5) AS median, quantile_cont({c},0.75) AS q75 FROM step""" for c in _KIN), "mean std min max valid_percent q25 median q75")
def kinematics(spark, sf):
    return PR.kinematic_statistics(A.steps(spark, sf), _KIN)


@query("agg4_type_distribution", with_sql("msg") + """
SELECT msg_type, n, round(100.0::DOUBLE*n/sum(n) OVER (),2) AS percent, CASE msg_type WHEN 1 THEN 'Position Report Class A (Scheduled)' WHEN 3 THEN 'Position Report Class A (Response)'
  WHEN 5 THEN 'Static and Voyage Related Data' WHEN 18 THEN 'Standard Class B Position Report' WHEN 24 THEN 'Static Data Report' END AS description
FROM (SELECT msg_type, count(*) AS n FROM msg GROUP BY 1)""", "percent")
def types(spark, sf):
    return PR.type_distribution(A.messages(spark, sf))


@query("agg5_static_completeness", with_sql("stat") + " UNION ALL ".join(f"""
SELECT '{c}' AS field, count(DISTINCT mmsi) FILTER ({c} IS NOT NULL) AS known, 100.0::DOUBLE*count(DISTINCT mmsi) FILTER ({c} IS NOT NULL)/count(DISTINCT mmsi) AS percent FROM stat""" for c in ST.VOYAGE), "percent")
def completeness(spark, sf):
    return PR.static_completeness(A.static_messages(spark, sf), ST.VOYAGE)


@query("agg6_funnel", with_sql("msg") + """, f AS (SELECT count(*) AS raw, count(*) FILTER (a) AS n1, count(*) FILTER (a AND b) AS n2, count(*) FILTER (a AND b AND c) AS n3 FROM
 (SELECT mmsi BETWEEN 100000000 AND 799999999 AS a, lat<=90 AND lon<=180 AS b, sog BETWEEN 0 AND 25 AS c FROM msg))
SELECT stage, gate, n, 100.0::DOUBLE*n/raw AS percent FROM (SELECT raw, unnest([0,1,2,3])::INT AS stage, unnest(['raw','valid_mmsi','valid_position','valid_speed']) AS gate, unnest([raw,n1,n2,n3]) AS n FROM f)""", "percent")
def funnel(spark, sf):
    return PR.funnel(A.messages(spark, sf), {
        "valid_mmsi": C.valid_mmsi(F.col("mmsi")), "valid_position": C.valid_position(F.col("lat"), F.col("lon")),
        "valid_speed": F.col("sog").between(0, 25)})


@query("agg7_hourly_activity", with_sql("pos") + "SELECT hour(time)::INT AS hour, count(*) AS n, avg(sog) AS mean_sog FROM pos GROUP BY 1", "mean_sog")
def hourly(spark, sf):
    return PR.hourly_activity(A.positions(spark, sf))


@query("agg7_weekday_activity", with_sql("pos") + "SELECT dayname(time) AS day, count(*) AS n FROM pos GROUP BY 1")
def weekday(spark, sf):
    return PR.weekday_activity(A.positions(spark, sf))


@query("agg8_hour_type_matrix", with_sql("pos", "latest") + "SELECT hour(time)::INT AS hour, " + ", ".join(
    f"count(*) FILTER (ship_type={t}) AS type_{t}" for t in A.SHIP_TYPES) + " FROM pos LEFT JOIN latest USING (mmsi) GROUP BY 1")
def hour_type(spark, sf):
    p = ST.enrich(A.positions(spark, sf), ST.merged_static(A.static_messages(spark, sf)))
    return PR.hour_type_matrix(p, A.SHIP_TYPES)


@query("agg9_speed_histogram", with_sql("pos") + """, r AS (SELECT min(sog) AS lo, (max(sog)-min(sog))/50 AS w FROM pos)
SELECT CAST(least(floor((sog-lo)/w),49) AS INT) AS bin, count(*) AS n, any_value(lo+CAST(least(floor((sog-lo)/w),49) AS INT)*w) AS left FROM pos, r WHERE sog IS NOT NULL GROUP BY 1""".replace(" AS left", ' AS "left"'), '"left"')
def speed_histogram(spark, sf):
    return PR.histogram(A.positions(spark, sf), "sog", 50)


@query("agg9_course_histogram", with_sql("pos") + """SELECT CAST(least(floor(cog/(360.0::DOUBLE/35)),34) AS INT) AS bin, count(*) AS n FROM pos GROUP BY 1""")
def course_histogram(spark, sf):
    return PR.histogram(A.positions(spark, sf), "cog", 35, 0.0, 360.0).drop("left")


@query("agg9_turn_histogram", with_sql("step") + """, q AS (SELECT quantile_cont(turn_rate,0.01) AS lo, quantile_cont(turn_rate,0.99) AS hi FROM step)
SELECT CAST(least(floor((turn_rate-lo)/((hi-lo)/50)),49) AS INT) AS bin, count(*) AS n FROM step, q WHERE turn_rate BETWEEN lo AND hi GROUP BY 1""")
def turn_histogram(spark, sf):
    return PR.trimmed_histogram(A.steps(spark, sf), "turn_rate").drop("left")


_COR = ("sog", "cog", "heading", "turn_rate", "acceleration", "lat", "lon")


@query("agg10_correlations", with_sql("step") + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a},{b}) AS corr FROM step" for a in _COR for b in _COR), "corr")
def correlations(spark, sf):
    return PR.correlations(A.steps(spark, sf), _COR)


@query("agg11_cube_statistics", with_sql("pos") + """
SELECT count(DISTINCT mmsi) AS vessels, count(DISTINCT time) AS timestamps, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
  count(sog)/(count(DISTINCT mmsi)*count(DISTINCT time))::DOUBLE AS complete_sog, count(heading)/(count(DISTINCT mmsi)*count(DISTINCT time))::DOUBLE AS complete_heading FROM pos""",
       "min_lat max_lat min_lon max_lon complete_sog complete_heading", 9)
def cube(spark, sf):
    return PR.cube_statistics(A.positions(spark, sf), ["sog", "heading"])


@query("agg12_structure_nulls", with_sql("pos") + """
SELECT count(*) AS rows, count(DISTINCT mmsi) AS vessels, count(*)-count(DISTINCT (mmsi,time)) AS duplicates, count(*)-count(sog) AS null_sog, count(*)-count(heading) AS null_heading,
  100.0::DOUBLE*(2*count(*)-count(sog)-count(heading))/(count(*)*2) AS null_percent, 100.0::DOUBLE*(count(*)-count(DISTINCT (mmsi,time)))/count(*) AS duplicate_percent, 2 AS columns, 0 AS missing_columns, '' AS verdict
FROM (SELECT mmsi, date_trunc('minute', time) AS time, sog, heading FROM pos)""", "null_percent duplicate_percent")
def structure(spark, sf):
    p = A.positions(spark, sf).withColumn("time", F.date_trunc("minute", "time"))
    return QU.structure(p, ["sog", "heading"])


@query("agg13_tail_outliers", with_sql("step") + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(*) FILTER ({c}<lo OR {c}>hi) AS outliers, 100.0::DOUBLE*count(*) FILTER ({c}<lo OR {c}>hi)/count({c}) AS percent, 100.0::DOUBLE*count(*) FILTER ({c}<lo OR {c}>hi)/count({c})>5 AS warning
FROM step, (SELECT quantile_cont({c},0.01) AS lo, quantile_cont({c},0.99) AS hi FROM step)""" for c in ("heading", "time_diff", "turn_rate")), "percent")
def tails(spark, sf):
    return QU.tail_outliers(A.steps(spark, sf), ["heading", "time_diff", "turn_rate"])


@query("agg14_domain", with_sql("msg") + """
SELECT count(*) FILTER (NOT mmsi BETWEEN 100000000 AND 799999999) AS invalid_mmsi, count(*) FILTER (abs(lat)>90) AS invalid_lat, count(*) FILTER (abs(lon)>180) AS invalid_lon,
  count(*) FILTER (sog<0 OR sog>102.2) AS invalid_sog, count(*) FILTER (cog<0 OR cog>=360) AS invalid_cog, count(*) FILTER (heading<0 OR heading>=360) AS invalid_heading FROM msg""")
def domain(spark, sf):
    return QU.domain(A.messages(spark, sf))


@query("agg15_temporal", with_sql("gap") + f"SELECT count(*) FILTER (time_diff>3600) AS time_gaps, 0 AS backward_steps, {secs('max(time)', 'min(time)')}/3600 AS range_hours FROM gap", "range_hours")
def temporal(spark, sf):
    return QU.temporal(A.positions(spark, sf))


@query("agg16_spatial", with_sql("pos") + f"""
SELECT max(lat)-min(lat) AS extent_lat, max(lon)-min(lon) AS extent_lon, count(*) FILTER (hop>10) AS position_jumps FROM (
 SELECT lat, lon, {hav('lag(lat) OVER v', 'lag(lon) OVER v', 'lat', 'lon')} AS hop FROM pos WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id))""", "extent_lat extent_lon")
def spatial(spark, sf):
    return QU.spatial(A.positions(spark, sf), jump_km=10.0)


@query("agg17_task_rules", with_sql("pos") + """, v AS (SELECT count(*) AS vessels, count(*) FILTER (n<10) AS short_vessels FROM (SELECT count(*) AS n FROM pos GROUP BY mmsi)),
w AS (SELECT max(s)-min(s)+1 AS windows, count(*) FILTER (k>=2) AS busy FROM (SELECT epoch_us(time)//600000000 AS s, count(DISTINCT mmsi) AS k FROM pos GROUP BY 1))
SELECT vessels, short_vessels, short_vessels>0.5*vessels AS many_short, windows, windows-busy AS sparse_windows, windows-busy>0.5*windows AS many_sparse, true AS missing_ship_type FROM v, w""")
def task_rules(spark, sf):
    return QU.task_rules(A.positions(spark, sf))


_VQ = with_sql("pos") + f""", vq AS (SELECT mmsi, count(*) AS length, {secs('max(time)', 'min(time)')}/3600 AS duration_hours, avg(sog) AS avg_speed, max(sog) AS max_speed,
  count(*) FILTER (abs(cog-pc)>10) AS course_changes, 0.0::DOUBLE AS position_accuracy FROM (SELECT *, lag(cog) OVER (PARTITION BY mmsi ORDER BY time, event_id) AS pc FROM pos) GROUP BY 1)
"""


@query("agg18_vessel_quality", _VQ + "SELECT * FROM vq", "duration_hours avg_speed max_speed position_accuracy")
def vessel_quality(spark, sf):
    return QU.vessel_quality(A.positions(spark, sf))


@query("agg18_fleet_quality", _VQ + """
SELECT count(*) AS num_trajectories, avg(length) AS avg_length, avg(duration_hours) AS avg_duration, count(*) FILTER (length<10) AS short_trajectories,
  count(*) FILTER (length>1000) AS long_trajectories, count(*) FILTER (max_speed>30) AS high_speed_trajectories FROM vq""", "avg_length avg_duration")
def fleet_quality(spark, sf):
    return QU.fleet_quality(QU.vessel_quality(A.positions(spark, sf)))


@query("agg19_coverage", with_sql("pos") + f"""
SELECT a AS extent_deg2, h AS extent_hours, v/greatest(a,0.01) AS vessels_per_deg2, n/greatest(h,1) AS records_per_hour FROM (
 SELECT (max(lat)-min(lat))*(max(lon)-min(lon)) AS a, {secs('max(time)', 'min(time)')}/3600 AS h, count(DISTINCT mmsi) AS v, count(*) AS n FROM pos)""", "extent_deg2 extent_hours vessels_per_deg2 records_per_hour")
def coverage(spark, sf):
    return QU.coverage(A.positions(spark, sf))


_T = "warning_time"


@query("agg22_warning_times", with_sql("seg") + WARN + f"""
SELECT avg({_T}) AS mean, stddev_pop({_T}) AS std, min({_T}) AS min, max({_T}) AS max, count(*) AS n, quantile_cont({_T},0.5) AS median, quantile_cont({_T},0.1) AS p10,
  quantile_cont({_T},0.25) AS p25, quantile_cont({_T},0.75) AS p75, quantile_cont({_T},0.9) AS p90 FROM warn WHERE severity='low'""", "mean std min max median p10 p25 p75 p90", 3)
def warning_times(spark, sf):
    return PR.warning_times(warnings(spark, sf), "low")


@query("agg23_false_alerts", with_sql("seg") + WARN + """
SELECT coalesce(severity,'all') AS severity, count(*) AS total, count(*) FILTER (false_positive) AS false_positives, count(*) FILTER (NOT false_positive) AS true_positives,
  count(*) FILTER (false_positive)/count(*)::DOUBLE AS rate, count(*) FILTER (false_positive)/12.0::DOUBLE AS false_per_hour FROM warn GROUP BY ROLLUP(severity)""", "rate false_per_hour")
def false_alerts(spark, sf):
    return PR.false_alerts(warnings(spark, sf), hours=12.0)


def _handled(spark, sf):
    """Vessels with their type, handled when they have a segment; the reason otherwise."""
    from wakeline.functions import codes

    seen = A.positions(spark, sf).groupBy("mmsi").agg(F.count("*").alias("n"), F.max("sog").alias("top"))
    static = ST.merged_static(A.static_messages(spark, sf)).select("mmsi", codes.vessel_category(F.col("ship_type")).alias("vessel_type"))
    v = static.join(seen, "mmsi", "left")
    ok = F.coalesce((F.col("n") >= 38) & (F.col("top") < 25), F.lit(False))
    reason = F.when(F.col("n").isNull() | (F.col("n") < 38), "few_fixes").otherwise("too_fast")
    return v.select("mmsi", "vessel_type", ok.alias("handled"), reason.alias("reason"))


_HAND = with_sql("pos", "latest") + """, hv AS (SELECT mmsi, CASE WHEN ship_type BETWEEN 70 AND 74 THEN 'cargo' WHEN ship_type BETWEEN 80 AND 85 OR ship_type=89 THEN 'tanker' WHEN ship_type=30 THEN 'fishing' WHEN ship_type BETWEEN 60 AND 69 THEN 'passenger' ELSE 'other' END AS vessel_type,
  coalesce(n>=38 AND top<25,false) AS handled, CASE WHEN n IS NULL OR n<38 THEN 'few_fixes' ELSE 'too_fast' END AS reason FROM latest LEFT JOIN (SELECT mmsi, count(*) AS n, max(sog) AS top FROM pos GROUP BY 1) USING (mmsi))
"""


@query("agg24_traffic_coverage", _HAND + """
SELECT coalesce(vessel_type,'all') AS vessel_type, count(*) AS total, count(*) FILTER (handled) AS handled, 100.0::DOUBLE*count(*) FILTER (handled)/count(*) AS percent FROM hv GROUP BY ROLLUP(vessel_type)""", "percent")
def traffic_coverage(spark, sf):
    return PR.traffic_coverage(_handled(spark, sf))


@query("agg24_unhandled_reasons", _HAND + "SELECT reason, count(*) AS n FROM hv WHERE NOT handled GROUP BY 1")
def reasons(spark, sf):
    return PR.unhandled_reasons(_handled(spark, sf))


@query("agg25_warning_patterns", with_sql("seg") + WARN + f"""
SELECT date_trunc('hour', time) AS time_bin, count(*) AS warning_count, round(avg(false_positive::INT),3) AS false_positive_rate, round(avg({_T}),3) AS mean_warning_time,
  round(quantile_cont({_T},0.5),3) AS median_warning_time, round(stddev_samp({_T}),3) AS std_warning_time, round(avg((severity='critical')::INT),3) AS critical_rate FROM warn GROUP BY 1""",
       "false_positive_rate mean_warning_time median_warning_time std_warning_time critical_rate", 2)
def patterns(spark, sf):
    return PR.warning_patterns(warnings(spark, sf))


_PROFILED = ("msg_type", "heading", "mmsi", "sog")


@query("agg26_column_profile", with_sql("msg") + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{t}' AS type, count(DISTINCT {c}) AS "distinct", CASE WHEN count(DISTINCT {c})<=200 THEN count(DISTINCT {c}) END AS listed FROM msg""" for c, t in zip(_PROFILED, ("int", "int", "bigint", "double"))))
def column_profile(spark, sf):
    out = PR.column_profile(A.messages(spark, sf).select(*_PROFILED), threshold=200)
    return out.select("column", "type", "distinct", F.when(F.col("values").isNotNull(), F.size("values")).cast("long").alias("listed"))
