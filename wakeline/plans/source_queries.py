"""Registered queries: log text in, tables and documents out, static data."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import features as FE
from wakeline.operators import splits as SP
from wakeline.operators import statics as ST
from wakeline.plans import adapter as A
from wakeline.plans.adapter import with_sql
from wakeline.plans.registry import query
from wakeline.session import scratch_path
from wakeline.sources import logs as L
from wakeline.sources import tables as TB

_GOOD = "k%23<>0 AND k%29<>1 AND k%31<>2"


def log_lines(spark, sf):
    """Receiver log text of every event, with noise, broken JSON and missing fields mixed in."""
    k = F.col("k")
    m = A.messages(spark, sf).join(A.static_messages(spark, sf).drop("time", "mmsi", "msg_type"), "event_id", "left")
    payload = F.to_json(F.struct(
        F.lit("AIS").alias("class"), F.when(k % 31 != 2, F.date_format("time", "yyyyMMddHHmmss")).alias("rxtime"),
        F.col("msg_type").alias("type"), "mmsi", "lat", "lon", F.col("sog").alias("speed"), F.col("cog").alias("course"),
        "heading", F.col("name").alias("shipname"), F.col("call_sign").alias("callsign"), "imo",
        F.col("ship_type").alias("shiptype"), "to_bow", "to_stern", "to_port", "to_starboard", "draught", "partno",
        F.lit("A").alias("channel"), F.col("event_id").alias("seq")))
    body = (F.when(k % 23 == 0, "[AIS engine v0.61 #0-0] received: 6 msgs")
            .when(k % 29 == 1, F.substring(payload, F.lit(1), F.length(payload) - 1)).otherwise(payload))
    stamp = F.date_format("time", "yyyy-MM-dd HH:mm:ss,SSS")
    return m.select(F.concat_ws(" - ", stamp, body).alias("value"))


def _log_file(spark, sf):
    path = scratch_path(spark, "log")
    log_lines(spark, sf).write.text(path)
    return path


def _parsed(spark, sf):
    return L.parse_lines(L.read_lines(spark, _log_file(spark, sf)))


@query("src1_read_ais_log", with_sql("msg") + f"""
SELECT event_id AS seq, mmsi, date_trunc('second', time) AS time, msg_type, CASE WHEN lat<=90 THEN lat END AS lat, CASE WHEN lon<=180 THEN lon END AS lon,
  CASE WHEN sog<102.2 THEN sog END AS sog, cog, nullif(heading,511) AS heading,
  CASE msg_type WHEN 1 THEN 'A_pos' WHEN 3 THEN 'A_pos' WHEN 18 THEN 'B_pos' WHEN 5 THEN 'Static' ELSE 'StaticB' END AS msg_class FROM msg WHERE {_GOOD}""", "lat lon sog cog")
def read_ais_log(spark, sf):
    return L.read_ais_log(spark, _log_file(spark, sf)).select(
        "seq", "mmsi", "time", "msg_type", "lat", "lon", "sog", "cog", "heading", "msg_class")


@query("src2_receiver_positions", with_sql("msg") + """
SELECT event_id AS seq, mmsi, date_trunc('milliseconds', time) AS time, msg_type, lat, lon, CASE WHEN sog BETWEEN 0 AND 50 THEN sog ELSE 0 END AS sog, cog
FROM msg WHERE k%23<>0 AND k%29<>1 AND msg_type IN (1,2,3,18,19) AND lat<=90 AND lon<=180""", "lat lon sog cog")
def receiver_positions(spark, sf):
    places, _ = L.receiver_tables(_parsed(spark, sf))
    return places.select("seq", "mmsi", "time", "msg_type", "lat", "lon", "sog", "cog")


@query("src2_receiver_static", with_sql("stat") + """
SELECT s.event_id AS seq, s.mmsi, partno, name, call_sign, ship_type FROM stat s JOIN ev USING (event_id) WHERE k%23<>0 AND k%29<>1""")
def receiver_static(spark, sf):
    _, static = L.receiver_tables(_parsed(spark, sf))
    return static.select("seq", "mmsi", "partno", "name", "call_sign", "ship_type")


# the first 500 messages of a log stamped by the minute, where the border falls inside a minute
@query("src2_receiver_first", with_sql("msg") + """, fr AS (SELECT event_id, date_trunc('minute', time) AS time, msg_type, lat, lon, sog, cog, mmsi FROM msg WHERE k%23<>0 AND k%29<>1 ORDER BY 2, 1 LIMIT 500)
SELECT event_id AS seq, mmsi, time, msg_type, lat, lon, CASE WHEN sog BETWEEN 0 AND 50 THEN sog ELSE 0 END AS sog, cog FROM fr WHERE msg_type IN (1,2,3,18,19) AND lat<=90 AND lon<=180""", "lat lon sog cog")
def receiver_first(spark, sf):
    path = scratch_path(spark, "log")
    log_lines(spark, sf).select(F.regexp_replace("value", r"^(.{16}):\d\d,\d{3} - ", "$1:00,000 - ").alias("value")).write.text(path)
    places, _ = L.read_receiver_log(spark, path, max_records=500)
    return places.select("seq", "mmsi", "time", "msg_type", "lat", "lon", "sog", "cog")


@query("src3_reject_counts", with_sql("msg") + """
SELECT reason, CASE WHEN reason NOT IN ('noise','malformed') THEN msg_type END AS msg_type, count(*) AS n FROM (SELECT msg_type,
  CASE WHEN k%23=0 THEN 'noise' WHEN k%29=1 THEN 'malformed' WHEN k%31=2 THEN 'no_time'
  WHEN msg_type IN (1,2,3,18,19) AND NOT (lat<=90 AND lon<=180) THEN 'bad_position' WHEN msg_type IN (1,2,3,18,19) AND NOT sog<=50 THEN 'bad_speed' ELSE 'valid' END AS reason FROM msg)
GROUP BY 1,2""")
def reject_counts(spark, sf):
    out = L.reject_counts(_parsed(spark, sf))
    return out


@query("src4_read_for_task", with_sql("msg", "stat") + f"""
SELECT m.event_id AS n_id, m.mmsi, m.msg_type, draught, s.ship_type FROM msg m LEFT JOIN stat s ON s.event_id=m.event_id WHERE {_GOOD} AND m.msg_type IN (1,2,3,18,19,27,4,21,5,24)
""".replace("m.event_id AS n_id, ", "CAST(m.mmsi AS BIGINT) + m.msg_type AS n_key, "), "draught")
def read_for_task(spark, sf):
    t = L.read_for_task(L.read_lines(spark, _log_file(spark, sf)), ["port_operations"])
    return t.select((F.col("mmsi") + F.col("msg_type")).alias("n_key"), "mmsi", "msg_type", "draught", "ship_type")


@query("src4_task_coverage", with_sql("msg") + f"""
SELECT task, count(*) FILTER (list_contains(kinds, msg_type)) AS n, 100.0::DOUBLE*count(*) FILTER (list_contains(kinds, msg_type))/count(*) AS percent
FROM msg, (VALUES ('anomaly_detection',[1,3,18,5]),('collision_avoidance',[1,3,18])) t(task, kinds) WHERE {_GOOD} AND msg_type IN (1,3,18,5,24) GROUP BY task""", "percent")
def task_coverage(spark, sf):
    tasks = ["anomaly_detection", "collision_avoidance"]
    return L.task_coverage(L.read_for_task(L.read_lines(spark, _log_file(spark, sf)), tasks), tasks)


@query("src5_read_tracks", with_sql("pos") + "SELECT mmsi, event_id, lat, lon, sog, heading FROM pos", "lat lon sog heading")
def read_tracks(spark, sf):
    base = scratch_path(spark, "tracks")
    p = A.positions(spark, sf).select("mmsi", "event_id", "lat", "lon", "sog", "heading")
    p.filter("event_id % 2 = 0").write.parquet(f"{base}/a")
    p.filter("event_id % 2 = 1").withColumnsRenamed({"lat": "latitude", "lon": "longitude", "sog": "speed"}).write.csv(f"{base}/b.csv", header=True)
    return TB.read_tracks(spark, [f"{base}/a", f"{base}/b.csv"]).select("mmsi", "event_id", "lat", "lon", "sog", "heading")


_DOC = with_sql("seg", "latest") + "SELECT s.mmsi, segment_id, event_id AS seq, time, lat, lon, sog, cog, name, call_sign, ship_type, length FROM seg s LEFT JOIN latest USING (mmsi)"


def _enriched(spark, sf):
    return ST.enrich(A.segments(spark, sf), ST.merged_static(A.static_messages(spark, sf)))


@query("src6_snk3_vessel_documents", _DOC, "lat lon sog cog")
def vessel_documents(spark, sf):
    path = scratch_path(spark, "documents")
    TB.write_vessel_documents(TB.vessel_documents(_enriched(spark, sf), max_points=10), path)
    return TB.read_vessel_documents(spark, path).drop("width")


@query("snk1_daily_parquet", with_sql("msg") + """
SELECT strftime(time + to_days(CAST(u%3 AS INTEGER)), '%Y-%m-%d') AS date, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM msg GROUP BY 1""")
def daily(spark, sf):
    path = scratch_path(spark, "daily")
    m = A.messages(spark, sf).withColumn("time", F.col("time") + F.make_dt_interval((F.col("u") % 3).cast("int")))
    # the days fill from two logs, one of which is written again
    for log, rows in (("odd", "event_id % 2 = 1"), ("even", "event_id % 2 = 0"), ("odd", "event_id % 2 = 1")):
        TB.write_daily(m.filter(rows), path, log)
    return spark.read.parquet(path).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("vessels"))


@query("snk2_flat_export", with_sql("seg") + "SELECT 'csv' AS fmt, mmsi, segment_id, event_id, lat, sog FROM seg UNION ALL SELECT 'parquet', mmsi, segment_id, event_id, lat, sog FROM seg", "lat sog")
def flat(spark, sf):
    base = scratch_path(spark, "flat")
    s = A.segments(spark, sf).select("mmsi", "segment_id", "event_id", "lat", "sog")
    TB.write_flat(s, f"{base}/p", "parquet")
    TB.write_flat(spark.read.parquet(f"{base}/p"), f"{base}/c.csv", "csv")
    read = [TB.read_tracks(spark, [f"{base}/{p}"]).drop("unread").withColumn("fmt", F.lit(f)) for p, f in (("p", "parquet"), ("c.csv", "csv"))]
    return TB.union_all(read)


@query("snk4_static_sidecar", with_sql("seg", "latest") + "SELECT DISTINCT s.mmsi, segment_id, name, call_sign, ship_type, length FROM seg s LEFT JOIN latest USING (mmsi)")
def sidecar(spark, sf):
    path = scratch_path(spark, "sidecar")
    TB.write_flat(TB.static_sidecar(_enriched(spark, sf)).drop("width"), path, "csv")
    return spark.read.csv(path, header=True, schema="mmsi long, segment_id long, name string, call_sign string, ship_type int, length int")


def _samples(spark, sf):
    s = FE.sequences(A.positions(spark, sf), 8, 2)
    return SP.by_cut_date(s, "start_time", "2024-01-01 06:00:00", val_days=0.1)


_SAMPLES = with_sql("pos") + """, smp AS (SELECT mmsi, event_id AS sample_id, time AS start_time, lead(sog,7) OVER v AS x_7_sog, lead(lat,9) OVER v AS y_1_lat FROM pos
  WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id)), split AS (SELECT *, CASE WHEN start_time<TIMESTAMP '2024-01-01 06:00:00' THEN 'train'
  WHEN start_time<TIMESTAMP '2024-01-01 08:24:00' THEN 'validation' ELSE 'test' END AS split FROM smp WHERE y_1_lat IS NOT NULL)
"""


@query("snk5_snk7_dataset", _SAMPLES + "SELECT mmsi, sample_id, split, x_7_sog, y_1_lat FROM split", "x_7_sog y_1_lat")
def dataset(spark, sf):
    base = scratch_path(spark, "dataset")
    TB.write_dataset(_samples(spark, sf), base, flatten=True)
    samples = spark.read.parquet(f"{base}/samples")
    return samples.select("mmsi", "sample_id", "split", "x_7_sog", "y_1_lat")


@query("snk6_dataset_metadata", _SAMPLES + """
SELECT (SELECT count(*) FROM split) AS samples, (SELECT count(DISTINCT mmsi) FROM split) AS sample_vessels, count(*) AS rows, count(DISTINCT mmsi) AS vessels,
  min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, 'time,lat,lon,sog,cog' AS features, 'time,lat,lon,sog,cog' AS targets FROM pos""",
       "min_lat max_lat min_lon max_lon")
def metadata(spark, sf):
    base = scratch_path(spark, "dataset")
    TB.write_dataset(_samples(spark, sf), base)
    samples = spark.read.parquet(f"{base}/samples")
    TB.write_metadata(TB.dataset_metadata(samples, A.positions(spark, sf)), base, {"length": "8", "horizon": "2"})
    _, meta = TB.read_dataset(spark, base)
    return meta.select("samples", "sample_vessels", "rows", "vessels", "min_lat", "max_lat", "min_lon", "max_lon",
                       F.concat_ws(",", "features").alias("features"), F.concat_ws(",", "targets").alias("targets"))


@query("snk8_score_export", with_sql("pos") + "SELECT event_id, coalesce(sog,0)*2 AS score FROM pos", "score")
def score_export(spark, sf):
    path = scratch_path(spark, "scores")
    scores = A.positions(spark, sf).select("event_id", (F.coalesce("sog", F.lit(0.0)) * 2).alias("score"))
    TB.write_scores(scores, f"{path}/csv", "csv")
    TB.write_scores(scores, f"{path}/json", "json")
    a = spark.read.csv(f"{path}/csv", header=True, schema="event_id long, score double")
    b = spark.read.schema("event_id long, score double").json(f"{path}/json")
    return a.join(b, ["event_id", "score"])


# ------------------------------------------------------------- static data

@query("agg1_latest_static", with_sql("stat") + "SELECT mmsi, " + ", ".join(f"max_by({c}, event_id) FILTER ({c} IS NOT NULL) AS {c}" for c in ST.VOYAGE) + " FROM stat GROUP BY mmsi", "draught")
def latest_static(spark, sf):
    return ST.latest_static(A.static_messages(spark, sf))


@query("jon1_static_enrichment", with_sql("seg", "latest") + "SELECT event_id, s.mmsi, name, ship_type, length FROM seg s LEFT JOIN latest USING (mmsi)")
def enrichment(spark, sf):
    return _enriched(spark, sf).select("event_id", "mmsi", "name", "ship_type", "length")


@query("jon2_merge_parts", with_sql("stat") + """
SELECT coalesce(a.mmsi,b.mmsi) AS mmsi, a.name, b.call_sign, b.ship_type, b.to_bow FROM
 (SELECT mmsi, max_by(name, event_id) AS name FROM stat WHERE msg_type=24 AND partno=0 GROUP BY 1) a
 FULL JOIN (SELECT mmsi, max_by(call_sign, event_id) AS call_sign, max_by(ship_type, event_id) AS ship_type, max_by(to_bow, event_id) AS to_bow FROM stat WHERE msg_type=24 AND partno=1 GROUP BY 1) b ON a.mmsi=b.mmsi""")
def merge_parts(spark, sf):
    return ST.merged_parts(A.static_messages(spark, sf)).select("mmsi", "name", "call_sign", "ship_type", "to_bow")


@query("jon3_prefer_type5", with_sql("latest") + "SELECT mmsi, name, call_sign, ship_type, imo, length FROM latest")
def prefer_type5(spark, sf):
    return ST.merged_static(A.static_messages(spark, sf)).select("mmsi", "name", "call_sign", "ship_type", "imo", "length")


@query("set1_union", with_sql("msg", "stat") + """
SELECT event_id, mmsi, lat, NULL AS ship_type FROM msg WHERE msg_type IN (1,3,18) UNION ALL SELECT event_id, mmsi, NULL, ship_type FROM stat""", "lat")
def union(spark, sf):
    m = A.messages(spark, sf).filter("msg_type in (1,3,18)").select("event_id", "mmsi", "lat")
    return TB.union_all([m, A.static_messages(spark, sf).select("event_id", "mmsi", "ship_type")])


@query("srt1_vessel_time_order", with_sql("pos") + """
SELECT event_id, mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY time, event_id)-1 AS position FROM pos""")
def ordered(spark, sf):
    from wakeline.operators import ordered as O

    return O.with_positions(A.positions(spark, sf)).select("event_id", "mmsi", "position")


@query("srt2_longest_tracks", with_sql("pos") + "SELECT mmsi, count(*) AS n FROM pos GROUP BY 1 HAVING count(*)>=40 ORDER BY n DESC, mmsi LIMIT 5")
def longest(spark, sf):
    n = A.positions(spark, sf).groupBy("mmsi").agg(F.count("*").alias("n"))
    return n.filter("n >= 40").orderBy(F.desc("n"), "mmsi").limit(5)




# the resampled rows of every builder: first value per minute, carried forward
_RESAMPLED = with_sql("pos") + """, b AS (SELECT *, epoch_us(time)//60000000*60 AS bin FROM pos WHERE mmsi IN (SELECT mmsi FROM pos GROUP BY 1 HAVING count(*)>=20 AND epoch_us(max(time))-epoch_us(min(time))>=300000000)),
f AS (SELECT mmsi, bin, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon, arg_min(sog, event_id) FILTER (sog IS NOT NULL) AS sog, arg_min(cog, event_id) FILTER (cog IS NOT NULL) AS cog FROM b GROUP BY 1,2),
g AS (SELECT mmsi, unnest(range(min(bin), max(bin)+60, 60)) AS bin FROM f GROUP BY 1),
rs0 AS (SELECT mmsi, bin, last_value(lat IGNORE NULLS) OVER v AS lat, last_value(lon IGNORE NULLS) OVER v AS lon, last_value(sog IGNORE NULLS) OVER v AS sog, last_value(cog IGNORE NULLS) OVER v AS cog
  FROM g LEFT JOIN f USING (mmsi, bin) WINDOW v AS (PARTITION BY mmsi ORDER BY bin)),
rs AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mmsi) AS rows FROM rs0 WHERE sog IS NOT NULL AND cog IS NOT NULL) WHERE rows>=20)"""


def _windows_sql(length: int, value: str) -> str:
    """Windows of ``length`` rows by split, with the sum of a value of their last row."""
    return _RESAMPLED + f""", wn AS (SELECT *, lag(bin, {length - 1}) OVER v AS start FROM (SELECT *, {value} AS value FROM rs) WINDOW v AS (PARTITION BY mmsi ORDER BY bin)),
sp AS (SELECT value, row_number() OVER (ORDER BY substr(md5(mmsi||'-'||start||'-42'),1,15), mmsi, start)-1 AS i, count(*) OVER () AS n FROM wn WHERE start IS NOT NULL)
SELECT CASE WHEN i<n//10 THEN 'test' WHEN i<n//10+n//5 THEN 'validation' ELSE 'train' END AS split, count(*) AS n, sum(value) AS total FROM sp GROUP BY 1"""


@query("udf3_anomaly_dataset", _windows_sql(30, "avg(sog) OVER (PARTITION BY mmsi)"), "total", 4)
def anomaly_dataset(spark, sf):
    from wakeline.operators import tasks as TK

    samples = TK.build_dataset("anomaly_detection", A.positions(spark, sf))
    return samples.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.element_at("target", -1)["sog_mean"]).alias("total"))


# neighbours within 10 NM in the same minute
_NEARBY = """(SELECT count(*) FROM rs o WHERE o.bin=rs1.bin AND o.mmsi<>rs1.mmsi AND 2*6371.0*asin(least(1, sqrt(sin(radians(o.lat-rs1.lat)/2)*sin(radians(o.lat-rs1.lat)/2)
 +cos(radians(rs1.lat))*cos(radians(o.lat))*sin(radians(o.lon-rs1.lon)/2)*sin(radians(o.lon-rs1.lon)/2))))/1.852<10)"""


@query("udf3_collision_dataset", _windows_sql(30, _NEARBY.replace("rs1", "rs")), "total", 4)
def collision_dataset(spark, sf):
    from wakeline.operators import tasks as TK

    samples = TK.build_dataset("collision_avoidance", A.positions(spark, sf))
    return samples.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.element_at("input", -1)["num_nearby"]).cast("double").alias("total"))


@query("udf3_graph_dataset", _RESAMPLED + f""", nd AS (SELECT bin//600*600 AS win, {_NEARBY.replace("rs1", "rs")} AS degree FROM rs),
wn AS (SELECT win, count(*) AS size, sum(degree) AS degree FROM nd GROUP BY 1 HAVING count(*)>=2),
sp AS (SELECT *, row_number() OVER (ORDER BY substr(md5(win||'-42'),1,15), win)-1 AS i, count(*) OVER () AS n FROM wn)
SELECT CASE WHEN i<n//10 THEN 'test' WHEN i<n//10+n//5 THEN 'validation' ELSE 'train' END AS split, sum(size)::BIGINT AS n, count(*) AS windows, sum(degree)::DOUBLE AS total FROM sp GROUP BY 1""", "total", 4)
def graph_dataset(spark, sf):
    from wakeline.operators import tasks as TK

    return _graph_totals(TK.build_dataset("graph_network", A.positions(spark, sf)))


def _graph_totals(samples):
    return samples.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("window").alias("windows"),
                                        F.sum(F.element_at("input", 1)["degree"]).cast("double").alias("total"))


@query("udf3_task_dataset", with_sql("pos") + """, b AS (SELECT mmsi, epoch_us(time)//60000000 AS m, event_id, sog, cog FROM pos WHERE mmsi IN (SELECT mmsi FROM pos GROUP BY 1 HAVING count(*)>=20)),
v AS (SELECT mmsi, max(m)-greatest(min(m) FILTER (sog IS NOT NULL),min(m) FILTER (cog IS NOT NULL))+1 AS rows FROM b GROUP BY 1),
w AS (SELECT CAST(sum(greatest(rows-34,0)) AS BIGINT) AS n FROM v WHERE rows>=20)
SELECT split, CASE split WHEN 'test' THEN n//10 WHEN 'validation' THEN n//5 ELSE n-n//10-n//5 END AS n, 30 AS input_rows, 5 AS target_rows FROM w, (VALUES ('train'),('validation'),('test')) t(split)""")
def task_dataset(spark, sf):
    from wakeline.operators import tasks as TK

    samples = TK.build_dataset("trajectory_prediction", A.positions(spark, sf))
    return samples.groupBy("split").agg(F.count("*").alias("n"), F.max(F.size("input")).alias("input_rows"), F.max(F.size("target")).alias("target_rows"))
