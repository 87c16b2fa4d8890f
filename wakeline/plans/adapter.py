"""Ship reports derived from the supplied ``events`` table, in Spark and in SQL.

``k`` is the integer inside ``props``; thirty days are compressed to twelve
hours so that tracks are dense enough to segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.operators import clean as C
from wakeline.operators import features as FE
from wakeline.operators import ordered as O
from wakeline.operators import tracks as TR

EPOCH_US = 1704067200000000
SHIP_TYPES = (70, 71, 80, 81, 30, 60, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOVING_EVENTS = "event_type IN ('click', 'view', 'purchase')"


def messages(spark: SparkSession, sf_dir: str, events: str = "true") -> DataFrame:
    """Every event as a raw message, sentinels and all.

    ``events`` narrows the scan itself, where Parquet can skip row groups.
    """
    # one-element arrays pin the derived values: each is computed once per row,
    # however often filters and expressions above refer to it
    ev = table(spark, sf_dir, "events").filter(events).selectExpr(
        "event_id", "ts", "event_type", "value", "user_id AS u",
        "explode(array(cast(get_json_object(props, '$.k') AS int))) AS k")
    return ev.selectExpr(f"""inline(array(struct(
        event_id,
        timestamp_micros((unix_micros(cast(ts AS timestamp)) - {EPOCH_US}) div 60 + {EPOCH_US}) AS time,
        u + 200000000 AS mmsi,
        CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 18 WHEN 'signup' THEN 5 ELSE 24 END AS msg_type,
        IF(k = 99, 91.0D, 61.9D + (u % 15) * 0.02D + k * 0.0001D) AS lat,
        IF(k = 99, 181.0D, -6.9D + ((u div 15) % 10) * 0.03D + ((7 * k) % 100) * 0.0001D) AS lon,
        IF(k = 98, 102.3D, round(least(value / 10, 30.0D), 1)) AS sog,
        ((37 * u + 36 * k) % 3600) / 10D AS cog,
        IF(k % 10 = 0, 511, cast((37 * u + 3 * k) % 360 AS int)) AS heading,
        k, u)))""")


def static_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type 5 and type 24 messages; what a part does not carry is NULL."""
    m = messages(spark, sf_dir, f"NOT {MOVING_EVENTS}")
    u, k = F.col("u"), F.col("k")
    five, part = F.col("msg_type") == 5, F.when(F.col("msg_type") == 24, k % 2)
    with_name = five | (part == 0)
    with_size = five | (part == 1)
    types = F.array(*[F.lit(x) for x in SHIP_TYPES])
    i = lambda c: c.cast("int")
    return m.select(
        "event_id", "time", "mmsi", "msg_type", i(part).alias("partno"),
        F.when(with_name, F.concat(F.lit("V"), u)).alias("name"),
        F.when(with_size, F.concat(F.lit("C"), u)).alias("call_sign"),
        F.when(five, u + 9_000_000).alias("imo"),
        F.when(with_size, F.element_at(types, i(u % 7) + 1)).alias("ship_type"),
        F.when(with_size, i(u % 80) + 20).alias("to_bow"),
        F.when(with_size, i(u % 20) + 10).alias("to_stern"),
        F.when(with_size, i(u % 5) + 3).alias("to_port"),
        F.when(with_size, i(u % 7) + 3).alias("to_starboard"),
        F.when(five, F.when(k == 97, 25.5).otherwise((u % 9 + 3).cast("double"))).alias("draught"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean position reports (types 1, 3 and 18 here)."""
    m = messages(spark, sf_dir, MOVING_EVENTS).drop("k", "u")
    cleaned = C.clean(m).withColumn("heading", F.col("heading").cast("double"))
    return O.spread_hot(cleaned)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.segment(positions(spark, sf_dir))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.step_features(TR.with_segments(positions(spark, sf_dir)))


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.cast("long").alias("port_id"),
        (61.9 + (n % 5) * 0.07).alias("lat"), (-6.9 + F.expr("n_nationkey div 5") * 0.06).alias("lon"))


# ---------------------------------------------------------------- checking SQL

def with_sql(*ctes: str) -> str:
    """`WITH` clause holding the named building blocks and what they need."""
    order, seen = [], set()

    def need(name):
        if name in seen:
            return
        seen.add(name)
        for other in NEEDS.get(name, ()):
            need(other)
        order.append(name)

    for c in ctes:
        need(c)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"


def hav(lat1, lon1, lat2, lon2) -> str:
    # the last term keeps NULL in, NULL out: least() skips NULLs
    return (f"(12742.0*asin(sqrt(least(1.0, sin(radians({lat2}-{lat1})/2)*sin(radians({lat2}-{lat1})/2)"
            f"+cos(radians({lat1}))*cos(radians({lat2}))*sin(radians({lon2}-{lon1})/2)*sin(radians({lon2}-{lon1})/2))))+0*({lat1}+{lat2}))")


def bear(lat1, lon1, lat2, lon2) -> str:
    a = (f"degrees(atan2(sin(radians({lon2}-{lon1}))*cos(radians({lat2})),"
         f"cos(radians({lat1}))*sin(radians({lat2}))-sin(radians({lat1}))*cos(radians({lat2}))*cos(radians({lon2}-{lon1}))))")
    return f"((({a}) % 360 + 360) % 360)"


def fold(x) -> str:
    return f"(CASE WHEN {x} > 180 THEN {x}-360 WHEN {x} < -180 THEN {x}+360 ELSE {x} END)"


def circ(a, b) -> str:
    return f"least(abs({a}-{b}), 360-abs({a}-{b}))"


def secs(later, earlier) -> str:
    return f"((epoch_us({later})-epoch_us({earlier}))/1e6)"


NEEDS = {
    "msg": ("ev",), "stat": ("msg",), "pos": ("msg",), "gap": ("pos",), "cut": ("gap",),
    "seg": ("cut",), "step": ("seg",), "latest": ("stat",),
}
SQL = {
    "ev": "SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, user_id AS u FROM events",
    "msg": f"""SELECT event_id, make_timestamp((epoch_us(ts)-{EPOCH_US})//60+{EPOCH_US}) AS time, 200000000+u AS mmsi,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 18 WHEN 'signup' THEN 5 ELSE 24 END AS msg_type,
  CASE WHEN k=99 THEN 91.0::DOUBLE ELSE 61.9::DOUBLE+(u%15)*0.02::DOUBLE+k*0.0001::DOUBLE END AS lat,
  CASE WHEN k=99 THEN 181.0::DOUBLE ELSE -6.9::DOUBLE+((u//15)%10)*0.03::DOUBLE+((7*k)%100)*0.0001::DOUBLE END AS lon,
  CASE WHEN k=98 THEN 102.3::DOUBLE ELSE round(least(value/10,30::DOUBLE),1) END AS sog,
  ((37*u+36*k)%3600)/10::DOUBLE AS cog,
  CASE WHEN k%10=0 THEN 511 ELSE CAST((37*u+3*k)%360 AS INTEGER) END AS heading, k, u FROM ev""",
    "stat": """SELECT event_id, time, mmsi, msg_type, CASE WHEN msg_type=24 THEN k%2 END AS partno,
  CASE WHEN msg_type=5 OR k%2=0 THEN 'V'||u END AS name,
  CASE WHEN msg_type=5 OR k%2=1 THEN 'C'||u END AS call_sign,
  CASE WHEN msg_type=5 THEN 9000000+u END AS imo,
  CASE WHEN msg_type=5 OR k%2=1 THEN ([70,71,80,81,30,60,0])[CAST(u%7 AS INTEGER)+1] END AS ship_type,
  CASE WHEN msg_type=5 OR k%2=1 THEN CAST(20+u%80 AS INTEGER) END AS to_bow,
  CASE WHEN msg_type=5 OR k%2=1 THEN CAST(10+u%20 AS INTEGER) END AS to_stern,
  CASE WHEN msg_type=5 OR k%2=1 THEN CAST(3+u%5 AS INTEGER) END AS to_port,
  CASE WHEN msg_type=5 OR k%2=1 THEN CAST(3+u%7 AS INTEGER) END AS to_starboard,
  CASE WHEN msg_type=5 THEN CASE WHEN k=97 THEN 25.5::DOUBLE ELSE (3+u%9)::DOUBLE END END AS draught
  FROM msg WHERE msg_type IN (5,24)""",
    "pos": """SELECT event_id, time, mmsi, msg_type, lat, lon,
  CASE WHEN sog>=0 AND sog<102.2 THEN sog END AS sog, cog, nullif(heading,511)::DOUBLE AS heading
  FROM msg WHERE msg_type IN (1,2,3,18,19) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180
  AND mmsi BETWEEN 100000000 AND 799999999""",
    "gap": f"""SELECT *, {secs('time', 'lag(time) OVER v')} AS time_diff FROM pos
  WINDOW v AS (PARTITION BY mmsi ORDER BY time, event_id)""",
    "cut": """SELECT *, CAST(sum(CASE WHEN time_diff>1800 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY time, event_id) AS BIGINT) AS segment_id FROM gap""",
    "seg": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mmsi, segment_id) AS segment_points FROM cut) WHERE segment_points>=6""",
    "step": f"""SELECT *,
  CASE WHEN plat IS NULL THEN 0.0 ELSE {hav('plat', 'plon', 'lat', 'lon')} END AS distance_km,
  CASE WHEN plat IS NOT NULL THEN {bear('plat', 'plon', 'lat', 'lon')} END AS bearing,
  sog-psog AS speed_delta, {fold('(cog-pcog)')} AS course_delta,
  (sog-psog)/nullif(time_diff/60,0) AS acceleration, {fold('(cog-pcog)')}/nullif(time_diff/60,0) AS turn_rate
  FROM (SELECT *, lag(lat) OVER s AS plat, lag(lon) OVER s AS plon, lag(sog) OVER s AS psog, lag(cog) OVER s AS pcog,
        row_number() OVER s AS seg_row FROM seg
        WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id))""",
    "latest": """SELECT mmsi, coalesce(max_by(name, event_id) FILTER (msg_type=5 AND name IS NOT NULL), max_by(name, event_id) FILTER (msg_type=24 AND name IS NOT NULL)) AS name,
  coalesce(max_by(call_sign, event_id) FILTER (msg_type=5 AND call_sign IS NOT NULL), max_by(call_sign, event_id) FILTER (msg_type=24 AND call_sign IS NOT NULL)) AS call_sign,
  coalesce(max_by(ship_type, event_id) FILTER (msg_type=5 AND ship_type IS NOT NULL), max_by(ship_type, event_id) FILTER (msg_type=24 AND ship_type IS NOT NULL)) AS ship_type,
  max_by(imo, event_id) FILTER (msg_type=5 AND imo IS NOT NULL) AS imo,
  coalesce(max_by(to_bow+to_stern, event_id) FILTER (msg_type=5), max_by(to_bow+to_stern, event_id) FILTER (msg_type=24 AND to_bow IS NOT NULL)) AS length
  FROM stat GROUP BY mmsi""",
    "port": """SELECT n_nationkey::BIGINT AS port_id, 61.9::DOUBLE+(n_nationkey%5)*0.07::DOUBLE AS lat, -6.9::DOUBLE+(n_nationkey//5)*0.06::DOUBLE AS lon FROM nation""",
}
