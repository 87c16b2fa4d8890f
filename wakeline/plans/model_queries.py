"""Registered queries: simplification, waypoints, routes, forecasting models."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import evaluate as EV
from wakeline.operators import features as FE
from wakeline.operators import models as M
from wakeline.operators import proximity as P
from wakeline.operators import routes as R
from wakeline.operators import splits as SP
from wakeline.plans import adapter as A
from wakeline.plans.adapter import with_sql
from wakeline.plans.registry import query

EPS = 0.002

_DIST = """CASE WHEN s.lat=e.lat AND s.lon=e.lon THEN sqrt((r.lat-s.lat)*(r.lat-s.lat)+(r.lon-s.lon)*(r.lon-s.lon))
  ELSE abs((e.lon-s.lon)*r.lat-(e.lat-s.lat)*r.lon+e.lat*s.lon-e.lon*s.lat)/sqrt((e.lon-s.lon)*(e.lon-s.lon)+(e.lat-s.lat)*(e.lat-s.lat)) END"""
_SIMPLE = with_sql("step").replace("WITH ", "WITH RECURSIVE ", 1) + f""", piece AS (SELECT mmsi, segment_id, 1::BIGINT AS a, max(seg_row) AS b FROM step GROUP BY 1,2
 UNION ALL SELECT mmsi, segment_id, unnest([a,f]) AS a, unnest([f,b]) AS b FROM (
  SELECT p.mmsi, p.segment_id, p.a, p.b, arg_max(r.seg_row, ({_DIST}, -r.seg_row)) AS f, max({_DIST}) AS d FROM piece p
  JOIN step s ON s.mmsi=p.mmsi AND s.segment_id=p.segment_id AND s.seg_row=p.a JOIN step e ON e.mmsi=p.mmsi AND e.segment_id=p.segment_id AND e.seg_row=p.b
  JOIN step r ON r.mmsi=p.mmsi AND r.segment_id=p.segment_id AND r.seg_row>p.a AND r.seg_row<p.b GROUP BY 1,2,3,4) WHERE d>{EPS}),
simple AS (SELECT event_id, mmsi, segment_id, lat, lon FROM step JOIN (SELECT mmsi, segment_id, a AS k FROM piece UNION SELECT mmsi, segment_id, b FROM piece) q USING (mmsi, segment_id) WHERE seg_row=k)
"""


@query("trj8_simplify", _SIMPLE + "SELECT event_id, mmsi, segment_id, lat, lon FROM simple", "lat lon")
def simplify(spark, sf):
    return R.simplify(A.segments(spark, sf), EPS).select("event_id", "mmsi", "segment_id", "lat", "lon")


def _clusters(spark, sf):
    return R.cluster_points(R.simplify(A.segments(spark, sf), EPS), eps=0.004, min_samples=12)


# Clusters of core points by repeated smallest-label spreading over close pairs.
_CLUSTER = _SIMPLE + """, near AS (SELECT a.event_id AS a, b.event_id AS b, (a.lat-b.lat)*(a.lat-b.lat)+(a.lon-b.lon)*(a.lon-b.lon) AS d FROM simple a JOIN simple b ON abs(a.lat-b.lat)<=0.004 AND abs(a.lon-b.lon)<=0.004
  WHERE (a.lat-b.lat)*(a.lat-b.lat)+(a.lon-b.lon)*(a.lon-b.lon)<=0.004::DOUBLE*0.004::DOUBLE),
core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*)>=12), link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a=r.id WHERE r.root<l.b),
lab AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1),
rim AS (SELECT n.a AS id, arg_min(cluster, (n.d, cluster)) AS cluster FROM near n JOIN lab ON lab.id=n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY 1),
mem AS (SELECT * FROM lab UNION ALL SELECT * FROM rim), way AS (SELECT cluster, avg(lat) AS lat, avg(lon) AS lon, count(*) AS points FROM mem JOIN simple ON simple.event_id=mem.id GROUP BY 1)
"""


@query("agg20_waypoints", _CLUSTER + "SELECT lat, lon, points FROM way", "lat lon", 9)
def waypoints(spark, sf):
    return R.waypoints(_clusters(spark, sf)).drop("waypoint_id")


def _tagged(spark, sf):
    places = R.waypoints(_clusters(spark, sf))
    return P.nearest_place(A.segments(spark, sf), places, "waypoint_id", "waypoint_id", "degrees", planar=True)


@query("agg21_route_graph", _CLUSTER + """, tg AS (SELECT seg.mmsi, seg.segment_id, seg.time, seg.event_id, arg_min(way.lat::VARCHAR, sqrt((seg.lat-way.lat)*(seg.lat-way.lat)+(seg.lon-way.lon)*(seg.lon-way.lon))) AS w FROM seg, way GROUP BY ALL),
h AS (SELECT w, lead(w) OVER (PARTITION BY mmsi, segment_id ORDER BY time, event_id) AS v FROM tg), g AS (SELECT least(w,v) AS a, greatest(w,v) AS b, count(*) AS weight FROM h WHERE w<>v GROUP BY 1,2)
SELECT weight, count(*) AS edges FROM g GROUP BY 1""")
def route_graph(spark, sf):
    return R.route_graph(_tagged(spark, sf)).groupBy("weight").agg(F.count("*").alias("edges"))


@query("agg21_port_graph", with_sql("seg", "port") + """, tg AS (SELECT seg.event_id, seg.mmsi, seg.segment_id, seg.time, arg_min(port_id, (sqrt((seg.lat-port.lat)*(seg.lat-port.lat)+(seg.lon-port.lon)*(seg.lon-port.lon)), port_id)) AS w FROM seg, port GROUP BY ALL),
h AS (SELECT w, lead(w) OVER (PARTITION BY mmsi, segment_id ORDER BY time, event_id) AS v FROM tg) SELECT least(w,v) AS a, greatest(w,v) AS b, count(*) AS weight FROM h WHERE w<>v GROUP BY 1,2""")
def port_graph(spark, sf):
    places = A.ports(spark, sf).withColumnRenamed("port_id", "waypoint_id")
    tagged = P.nearest_place(A.segments(spark, sf), places, "waypoint_id", "waypoint_id", "degrees", planar=True)
    return R.route_graph(tagged)


def _histories(spark, sf):
    return FE.sequences(A.segments(spark, sf), 6, 3, keys=("mmsi", "segment_id"))


def _scored(spark, sf, kind):
    seq = _histories(spark, sf)
    pred = M.kalman_forecast(seq, 3, kind)
    true = seq.select("sample_id", F.posexplode("target").alias("i", "t")).select(
        "sample_id", (F.col("i") + 1).alias("step"), F.col("t.lat").alias("true_lat"), F.col("t.lon").alias("true_lon"))
    # variances span many powers of ten, so their logarithms are compared
    logs = {f"log_{c}": F.log(c) for c in ("var_x", "var_y")}
    if kind == "turn":
        pred = pred.withColumn("correlation", F.col("cov_xy") / F.sqrt(F.col("var_x") * F.col("var_y"))).drop("cov_xy")
    return EV.match(pred.withColumns(logs).drop("var_x", "var_y"), true)


def _kalman_sql(kind: str) -> str:
    """The filter of one axis (its covariance serves both), unrolled by recursion over fixes and then over steps."""
    n = 2 if kind == "velocity" else 3
    names = ["p", "v", "a"][:n]
    g = ["w*w/2", "w", "1"][:n]
    power = {0: "1", 1: "w", 2: "(w*w/2)"}
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    cell = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    cov = ", ".join(cell(i, j) for i, j in cells)
    state = lambda t="": ", ".join(f"{t}{axis}{k}" for axis in "xy" for k in names)
    moved = ", ".join(" + ".join(f"{power[j - i]}*{axis}{names[j]}" for j in range(i, n)) + f" AS {axis}{names[i]}" for axis in "xy" for i in range(n))
    spread = ", ".join(" + ".join(f"{power[k - i]}*{power[m - j]}*{cell(k, m)}" for k in range(i, n) for m in range(j, n))
                       + f" + {M.NOISE[kind] ** 2!r}*({g[i]})*({g[j]}) AS {cell(i, j)}" for i, j in cells)
    gain = ", ".join(f"c0{i}/(c00+{M.MEASURED_M ** 2!r}) AS k{i}" for i in range(n))
    fixed = ", ".join(f"{axis}{names[i]} + k{i}*({axis}m - {axis}p) AS {axis}{names[i]}" for axis in "xy" for i in range(n))
    lower = ", ".join(f"{cell(i, j)} - k{i}*c0{j} AS {cell(i, j)}" for i, j in cells)
    start = [f"{M.START[k] ** 2!r}::DOUBLE" for k in ("position", "velocity", "acceleration")[:n]]
    begin = ", ".join(f"{start[i] if i == j else '0::DOUBLE'} AS {cell(i, j)}" for i, j in cells)
    v = lambda axis, i: f"({axis}[{i + 1}]-{axis}[{i}])/w[{i}]"
    first = {"p": "{0}[6]", "v": v("{0}", 5), "a": f"({v('{0}', 5)}-{v('{0}', 4)})/w[5]"}
    opening = ", ".join(f"{first[k].format(axis)} AS {axis}{k}" for axis in "xy" for k in names)
    limit = lambda k, most: f"least(1, {most!r}/greatest(sqrt(x{k}*x{k}+y{k}*y{k}), 1e-12))"
    most = {"v": M.MAX_MPS, "a": M.MAX_ACCELERATION}
    caps = ", ".join(f"{axis}{k}" if k == "p" else f"{axis}{k}*{limit(k, most[k])} AS {axis}{k}" for axis in "xy" for k in names)
    return with_sql("seg").replace("WITH ", "WITH RECURSIVE ", 1) + f""", wn AS (
 SELECT event_id AS sample_id, list(lat) OVER o AS la, list(lon) OVER o AS lo, list(epoch_us(time)) OVER o AS ts FROM seg
 WINDOW o AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)),
hs AS (SELECT *, list_avg(la[1:6]) AS rla, list_avg(lo[1:6]) AS rlo, {geo.M_PER_DEG!r}::DOUBLE AS ky, {geo.M_PER_DEG!r}::DOUBLE*cos(radians(list_avg(la[1:6]))) AS kx FROM wn WHERE len(la)=9),
ax AS (SELECT sample_id, rla, rlo, kx, ky, list_transform(lo[1:6], lambda q: (q-rlo)*kx) AS x, list_transform(la[1:6], lambda q: (q-rla)*ky) AS y,
  list_transform(range(1, 6), lambda i: greatest((ts[i+1]-ts[i])/1e6, 1e-6)) AS w, greatest((ts[6]-ts[4])/2e6, 1e-6) AS gap FROM hs),
kf(sample_id, i, {state()}, {cov}) AS (SELECT sample_id, 0, {opening}, {begin} FROM ax
 UNION ALL SELECT sample_id, i+1, {fixed}, {lower} FROM (SELECT *, {gain} FROM (
  SELECT sample_id, i, xm, ym, {moved}, {spread} FROM (SELECT kf.*, ax.w[i+1] AS w, ax.x[i+2] AS xm, ax.y[i+2] AS ym FROM kf JOIN ax USING (sample_id) WHERE i<5)))),
fo(sample_id, step, {state()}, {cov}) AS (SELECT sample_id, 0, {state()}, {cov} FROM kf WHERE i=5
 UNION ALL SELECT sample_id, step+1, {caps}, {cov} FROM (SELECT sample_id, step, {moved}, {spread} FROM (SELECT fo.*, gap AS w FROM fo JOIN ax USING (sample_id) WHERE step<3)))
SELECT sample_id, step, yp/ky+rla AS pred_lat, xp/kx+rlo AS pred_lon, ln(c00) AS log_var_x, ln(c00) AS log_var_y, 0::DOUBLE AS cov_xy, la[6+step] AS true_lat, lo[6+step] AS true_lon
FROM fo JOIN ax USING (sample_id) JOIN (SELECT sample_id, la, lo FROM wn) USING (sample_id) WHERE step>0"""


def _turn_sql() -> str:
    """The coordinated turn: five states and the fifteen cells of their covariance, by the same recursions."""
    size = range(5)
    cell = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    cells = [(i, j) for i in size for j in size if i <= j]
    names = ", ".join([f"s{i}" for i in size] + [cell(*c) for c in cells])
    rows = [{0: "1", 1: "al", 3: "ac"}, {1: "cc", 3: "ss"}, {2: "1", 1: "-ac", 3: "al"}, {1: "-ss", 3: "cc"}, {4: "1"}]
    noise = [f"{M.NOISE[n] ** 2!r}*{p}" for n, p in (("position", "w*w"), ("velocity", "w"), ("position", "w*w"), ("velocity", "w"), ("turn", "w"))]
    angles = lambda src: (f"SELECT *, sin(om*w) AS ss, cos(om*w) AS cc, sin(om*w)/om AS al, (1-cos(om*w))/om AS ac "  # noqa: E731
                          f"FROM (SELECT *, CASE WHEN abs(s4)>1e-6 THEN s4 ELSE 1e-6 END AS om FROM ({src}))")
    moved = ", ".join([" + ".join(f"({c})*s{k}" for k, c in rows[i].items()) + f" AS s{i}" for i in size] + [
        " + ".join(f"({a})*({b})*{cell(k, m)}" for k, a in rows[i].items() for m, b in rows[j].items()) + (f" + {noise[i]}" if i == j else "") + f" AS {cell(i, j)}" for i, j in cells])
    seen = M.MEASURED_M ** 2
    det = f"((c00+{seen!r})*(c22+{seen!r})-c02*c02)"
    gain = ", ".join(f"({cell(i, 0)}*(c22+{seen!r})-{cell(i, 2)}*c02)/{det} AS gx{i}, ({cell(i, 2)}*(c00+{seen!r})-{cell(i, 0)}*c02)/{det} AS gy{i}" for i in size)
    fixed = ", ".join([f"s{i}+gx{i}*(xm-s0)+gy{i}*(ym-s2) AS s{i}" for i in size] + [f"{cell(i, j)}-gx{i}*{cell(0, j)}-gy{i}*{cell(2, j)} AS {cell(i, j)}" for i, j in cells])
    start = [M.START[n] ** 2 for n in ("position", "velocity", "position", "velocity", "turn")]
    opening = "x[6], vx[5], y[6], vy[5], list_avg(tn), " + ", ".join(f"{start[i] if i == j else 0.0!r}::DOUBLE" for i, j in cells)
    slow = f"least(1, {M.MAX_MPS!r}/greatest(sqrt(s1*s1+s3*s3), 1e-12))"
    caps = f"s0, s1*{slow} AS s1, s2, s3*{slow} AS s3, greatest(least(s4, {float(M.MAX_TURN)!r}), {-float(M.MAX_TURN)!r}) AS s4, " + ", ".join(cell(*c) for c in cells)
    half = "(pi()-1e-9)"
    folded = f"((d+{half})-2*pi()*floor((d+{half})/(2*pi()))-{half})"
    return _kalman_sql("velocity").split("kf(sample_id")[0] + f"""tv AS (SELECT *, list_transform(range(1, 6), lambda i: (x[i+1]-x[i])/w[i]) AS vx, list_transform(range(1, 6), lambda i: (y[i+1]-y[i])/w[i]) AS vy FROM ax),
tc AS (SELECT *, list_transform(range(1, 6), lambda i: atan2(vx[i], vy[i])) AS co FROM tv),
ta AS (SELECT *, list_transform(list_transform(range(3, 6), lambda i: {{'d': co[i]-co[i-1], 'w': w[i]}}), lambda q: {folded.replace("d+", "q.d+")}/q.w) AS tn FROM tc),
kf(sample_id, i, {names}) AS (SELECT sample_id, 2, {opening} FROM ta
 UNION ALL SELECT sample_id, i+1, {fixed} FROM (SELECT *, {gain} FROM (SELECT sample_id, i, xm, ym, {moved} FROM ({angles("SELECT kf.*, ta.w[i+1] AS w, ta.x[i+2] AS xm, ta.y[i+2] AS ym FROM kf JOIN ta USING (sample_id) WHERE i<5")})))),
fo(sample_id, step, {names}) AS (SELECT sample_id, 0, {names} FROM kf WHERE i=5
 UNION ALL SELECT sample_id, step+1, {caps} FROM (SELECT sample_id, step, {moved} FROM ({angles("SELECT fo.*, gap AS w FROM fo JOIN ta USING (sample_id) WHERE step<3")})))
SELECT sample_id, step, s2/ky+rla AS pred_lat, s0/kx+rlo AS pred_lon, ln(c00) AS log_var_x, ln(c22) AS log_var_y, c02/sqrt(c00*c22) AS correlation, la[6+step] AS true_lat, lo[6+step] AS true_lon
FROM fo JOIN ta USING (sample_id) JOIN (SELECT sample_id, la, lo FROM wn) USING (sample_id) WHERE step>0"""


_FORECAST = "pred_lat pred_lon log_var_x log_var_y cov_xy true_lat true_lon"


@query("mdl2_kalman_velocity", _kalman_sql("velocity"), _FORECAST, 5)
def kalman_velocity(spark, sf):
    return _scored(spark, sf, "velocity")


@query("mdl3_kalman_turn", _turn_sql(), _FORECAST.replace("cov_xy", "correlation"), 5)
def kalman_turn(spark, sf):
    return _scored(spark, sf, "turn")


@query("mdl3_kalman_acceleration", _kalman_sql("acceleration"), _FORECAST, 5)
def kalman_acceleration(spark, sf):
    return _scored(spark, sf, "acceleration")


def _matrix(spark, sf):
    m = FE.design_matrix(A.segments(spark, sf), ("lat", "lon"), horizons=(1, 3))
    return SP.by_cut_date(m, "time", "2024-01-01 08:00:00", 1)


@query("mdl4_forest")
def forest(spark, sf):
    m = _matrix(spark, sf)
    models = M.fit_forest(m.filter("split = 'train'"), trees=8, depth=5)
    out = M.apply_forest(models, m.filter("split <> 'train'"))
    return out.select("event_id", "pred_lat_h1", "pred_lon_h1", "pred_lat_h3", "pred_lon_h3")


@query("mdl4_forest_facts", with_sql("step") + """, t AS (SELECT time, seg_row, lead(lat) OVER s-lat AS move FROM step WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id))
SELECT count(*) AS scored, count(move) AS with_truth, avg(abs(move)) AS no_change_error, true AS complete, true AS better FROM t WHERE seg_row>3 AND time>=TIMESTAMP '2024-01-01 08:00:00'""", "no_change_error", 9)
def forest_facts(spark, sf):
    """All later rows get a forecast, and on the whole it beats standing still."""
    m = _matrix(spark, sf)
    models = M.fit_forest(m.filter("split = 'train'"), horizons=(1,), trees=8, depth=5)
    out = M.apply_forest(models, m.filter("split <> 'train'"))
    still, miss = F.avg(F.abs("lat_t1")), F.avg(F.abs(F.col("pred_lat_t1") - F.col("lat_t1")))
    return out.agg(F.count("*").alias("scored"), F.count("lat_t1").alias("with_truth"), still.alias("no_change_error"),
                   (F.count_if(F.col("pred_lat_h1").isNull()) == 0).alias("complete"), (miss < still).alias("better"))


@query("mdl4_importance_sums", "SELECT unnest([1, 1, 3, 3])::INT AS horizon, unnest(['lat', 'lon', 'lat', 'lon']) AS target, 22 AS features, 1.0::DOUBLE AS total", "total")
def importance_sums(spark, sf):
    found = importances(spark, sf)
    return found.groupBy("horizon", "target").agg(F.count("*").cast("int").alias("features"), F.sum("importance").alias("total"))


@query("mdl4_forest_rolling")
def forest_rolling(spark, sf):
    m = _matrix(spark, sf)
    models = M.fit_forest(m.filter("split = 'train'"), horizons=(1,), trees=8, depth=5)
    seq = FE.sequences(A.segments(spark, sf), 10, 0, keys=("mmsi", "segment_id"))
    states = seq.select("sample_id", F.transform("input", lambda p: p["lat"]).alias("hist_lat"),
                        F.transform("input", lambda p: p["lon"]).alias("hist_lon"))
    return M.roll_forest(models, states, 3)


@query("mdl4_importances")
def importances(spark, sf):
    models = M.fit_forest(_matrix(spark, sf).filter("split = 'train'"), trees=8, depth=5)
    return spark.createDataFrame(M.importances(models), "horizon int, target string, feature string, importance double")


@query("mdl5_boosted")
def boosted(spark, sf):
    seq = SP.by_cut_date(FE.sequences(A.segments(spark, sf), 6, 2, keys=("mmsi", "segment_id")), "start_time", "2024-01-01 08:00:00", 1)
    models = M.fit_boosted(seq.filter("split = 'train'"), (1, 2), rounds=5, depth=3)
    out = M.apply_boosted(models, seq.filter("split <> 'train'"))
    return out.select("sample_id", *[f"pred_{c}_{s}" for s in (1, 2) for c in ("lat", "lon")])


@query("mdl5_boosted_facts", with_sql("seg") + """, wn AS (SELECT list(lat) OVER o AS la, time FROM seg WINDOW o AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
w AS (SELECT la, time<TIMESTAMP '2024-01-01 08:00:00' AS train FROM wn WHERE len(la)=8)
SELECT count(*) AS scored, avg(abs(la[7]-mean)) AS mean_error, true AS complete, true AS better FROM w, (SELECT avg(la[7]) AS mean FROM w WHERE train) WHERE NOT train""", "mean_error", 9)
def boosted_facts(spark, sf):
    """All later windows get a forecast, and on the whole it beats the training mean."""
    seq = SP.by_cut_date(FE.sequences(A.segments(spark, sf), 6, 2, keys=("mmsi", "segment_id")), "start_time", "2024-01-01 08:00:00", 1)
    train = seq.filter("split = 'train'")
    out = M.apply_boosted(M.fit_boosted(train, (1,), ("lat",), rounds=5, depth=3), seq.filter("split <> 'train'"))
    true = F.element_at("target", 1)["lat"]
    mean = train.agg(F.avg(true).alias("mean")).first()["mean"]
    plain, miss = F.avg(F.abs(true - F.lit(mean))), F.avg(F.abs(true - F.col("pred_lat_1")))
    return out.agg(F.count("*").alias("scored"), plain.alias("mean_error"), (F.count_if(F.col("pred_lat_1").isNull()) == 0).alias("complete"), (miss < plain).alias("better"))


@query("mdl6_batch_scoring", with_sql("pos") + """
SELECT event_id, CASE WHEN sog<=25 THEN sqrt(sog) END AS score, CASE WHEN sog>25 THEN 'ValueError: too fast' END AS error FROM pos WHERE sog IS NOT NULL""", "score")
def batch_scoring(spark, sf):
    def model(batch):
        if (batch["sog"] > 25).any():
            raise ValueError("too fast")
        return batch["sog"] ** 0.5

    p = A.positions(spark, sf).filter("sog is not null").select("event_id", "sog")
    return M.score_batches(p, model, key="event_id")
