"""Registered queries: forecast scoring, slices, statistics, splits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wakeline.functions import codes
from wakeline.operators import collision as CO
from wakeline.operators import evaluate as EV
from wakeline.operators import failures as FA
from wakeline.operators import features as FE
from wakeline.operators import proximity as P
from wakeline.operators import splits as SP
from wakeline.operators import statics as ST
from wakeline.operators import stats as TS
from wakeline.plans import adapter as A
from wakeline.plans.adapter import circ, fold, hav, secs, with_sql
from wakeline.plans.proximity_queries import FORECAST, forecast
from wakeline.plans.proximity_queries import _pairs as _pairs_sql
from wakeline.plans.registry import query
from wakeline.session import saved

_SQ = "((pred_lat-true_lat)*(pred_lat-true_lat)+(pred_lon-true_lon)*(pred_lon-true_lon))"


def _errors_of(src):
    return f"""SELECT *, {hav('pred_lat', 'pred_lon', 'true_lat', 'true_lon')} AS km, sqrt({_SQ}) AS degrees, {_SQ} AS square,
  abs(pred_sog-true_sog) AS sog_error, {circ('pred_cog', 'true_cog')} AS cog_error, {fold('(pred_cog-true_cog)')} AS cog_delta FROM {src}"""


_ERR = with_sql("seg", "latest", "port") + FORECAST + f", er AS ({_errors_of('fc')})\n"


@query("jon8_prediction_truth", with_sql("pos") + """, p AS (SELECT event_id AS sample_id, s AS step, lat+s*0.001::DOUBLE AS pred_lat FROM pos, (VALUES (1),(2),(3)) t(s)),
t AS (SELECT event_id AS sample_id, s AS step, lead(lat) OVER v AS true_lat FROM pos, (VALUES (1),(2)) t(s) WINDOW v AS (PARTITION BY mmsi, s ORDER BY time, event_id))
SELECT sample_id, step, pred_lat, true_lat FROM p JOIN t USING (sample_id, step) WHERE true_lat IS NOT NULL""", "pred_lat true_lat")
def prediction_truth(spark, sf):
    from wakeline.operators import ordered as O

    p = O.with_next(A.positions(spark, sf), ["lat"])
    pred = p.select(F.col("event_id").alias("sample_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("step"), "lat")
    pred = pred.select("sample_id", "step", (F.col("lat") + F.col("step") * 0.001).alias("pred_lat"))
    true = p.filter("next is not null").select(F.col("event_id").alias("sample_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("step"),
                                               F.col("next.lat").alias("true_lat"))
    return EV.match(pred, true)


@query("jon9_features_targets", with_sql("step") + """
SELECT a.event_id, a.distance_km, b.sog FROM step a JOIN pos b ON a.mmsi=b.mmsi AND a.time=b.time AND a.event_id=b.event_id""", "distance_km sog")
def features_targets(spark, sf):
    targets = A.positions(spark, sf).select("mmsi", "time", "event_id", "sog")
    return EV.match(A.steps(spark, sf).select("mmsi", "time", "event_id", "distance_km"), targets, ["mmsi", "time", "event_id"]).select(
        "event_id", "distance_km", "sog")


@query("evl1_evl2_position_course", _ERR + """
SELECT avg(km) AS ade_km, (SELECT avg(km) FROM er WHERE step=5) AS fde_km, sqrt(avg(km*km)) AS rmse_km, sqrt(avg(cog_delta*cog_delta)) AS course_rmse FROM er""", "ade_km fde_km rmse_km course_rmse", 5)
def position_metrics(spark, sf):
    return EV.position_metrics(forecast(spark, sf))


_G = [f"(pred_{c}-true_{c})" for c in EV.FOUR]
_MSE = "(" + "+".join(f"sum({g}*{g})" for g in _G) + ")/(" + "+".join(f"count({g})" for g in _G) + ")"
_MAE = "(" + "+".join(f"sum(abs({g}))" for g in _G) + ")/(" + "+".join(f"count({g})" for g in _G) + ")"


@query("evl3_planar_metrics", _ERR + f"""
SELECT {_MSE} AS mse, {_MAE} AS mae, sqrt({_MSE}) AS rmse, avg(degrees) AS ade, (SELECT avg(degrees) FROM er WHERE step=5) AS fde, sqrt(avg(square)/2)*111 AS position_rmse_km,
  avg(sog_error) AS speed_mae, avg(cog_error) AS course_mae, avg(degrees) FILTER (step=1) AS error_1step, avg(degrees) FILTER (step=5) AS error_5step FROM er""",
       "mse mae rmse ade fde position_rmse_km speed_mae course_mae error_1step error_5step", 5)
def planar_metrics(spark, sf):
    return EV.planar_metrics(forecast(spark, sf), (1, 5))


_SAMPLE = _ERR + ", sm AS (SELECT sample_id, avg(km) AS mean_km, sqrt(avg(cog_delta*cog_delta)) AS course_rmse FROM er GROUP BY 1)\n"


@query("evl4_sample_metrics", _SAMPLE + "SELECT * FROM sm", "mean_km course_rmse", 5)
def sample_metrics(spark, sf):
    return EV.sample_metrics(forecast(spark, sf))


def _boot(src, keys, value, row, n, seed=42, out="rep"):
    """Replicate means per key, the same hash draws as in Spark."""
    k = "".join(f"{x}, " for x in keys)
    base = f"('0x'||substr(md5({row}::VARCHAR||'-{seed}'), 1, 8))::BIGINT"
    weight = "+".join(f"(u>={edge})::INT" for edge in TS._POISSON)
    return f""", {out}0 AS (SELECT {k}{value} AS x, replicate, ({base}+replicate*{TS._STRIDE})%4294967296 AS a FROM {src}, range(0, {n}) b(replicate) WHERE {value} IS NOT NULL),
{out}1 AS (SELECT *, (xor(a, a>>16)*{TS._MIX[0]})%4294967296 AS b FROM {out}0), {out}2 AS (SELECT *, (xor(b, b>>15)*{TS._MIX[1]})%4294967296 AS c FROM {out}1),
{out}3 AS (SELECT *, xor(c, c>>15) AS u FROM {out}2),
{out} AS (SELECT {k}replicate, sum(w*x)/sum(w) AS m FROM (SELECT *, {weight} AS w FROM {out}3) GROUP BY ALL HAVING sum(w)>0)
"""


@query("evl5_metric_summary", _SAMPLE + ", ml AS (SELECT sample_id, 'mean_km' AS metric, mean_km AS score FROM sm UNION ALL SELECT sample_id, 'course_rmse', course_rmse FROM sm)"
       + _boot("ml", ["metric"], "score", "sample_id", 40) + """
SELECT a.metric, value, n, low, high, std, min, max, q25, median, q75, high-low AS ci_width FROM (SELECT metric, avg(score) AS value, count(*) AS n, stddev_pop(score) AS std, min(score) AS min, max(score) AS max,
  quantile_cont(score,0.25) AS q25, quantile_cont(score,0.5) AS median, quantile_cont(score,0.75) AS q75 FROM ml GROUP BY 1) a
JOIN (SELECT metric, quantile_cont(m,0.025) AS low, quantile_cont(m,0.975) AS high FROM rep GROUP BY 1) c ON a.metric=c.metric""", "value low high std min max q25 median q75 ci_width", 5)
def metric_summary(spark, sf):
    return EV.metric_summary(EV.sample_metrics(forecast(spark, sf)), ["mean_km", "course_rmse"], n=40)


def candidates(spark, sf):
    """Three forecasts per sample, shifted north by 0, 0.004 and 0.008 degrees per step."""
    fc = forecast(spark, sf).select("*", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2)])).alias("candidate"))
    return fc.withColumn("pred_lat", F.col("pred_lat") + F.col("candidate") * 0.004 * F.col("step"))


_CAND = with_sql("seg") + FORECAST + f", cd AS (SELECT * REPLACE (pred_lat+candidate*0.004::DOUBLE*step AS pred_lat) FROM fc, (VALUES (0),(1),(2)) t(candidate)), er AS ({_errors_of('cd')})\n"


@query("evl6_best_of_n", _CAND + """
SELECT step, avg(best) AS mean, max(best) AS max, count(*) AS n, quantile_cont(best,0.5) AS median, quantile_cont(best,0.9) AS p90 FROM (SELECT sample_id, step, min(km) AS best FROM er GROUP BY 1,2) GROUP BY 1""", "mean max median p90", 5)
def best_of_n(spark, sf):
    return EV.best_of_n(candidates(spark, sf))


@query("evl7_multi_hypothesis", _CAND + """, ea AS (SELECT sample_id, candidate, avg(km) AS mean_km, avg(square) AS mse, max(km) AS max_km, sqrt(avg(square)) AS rmse FROM er GROUP BY 1,2)
SELECT sample_id, arg_min(candidate,(mean_km,candidate)) AS best_candidate, min(mean_km) AS mean_km, arg_min(rmse,(mean_km,candidate)) AS best_rmse, arg_min(max_km,(mean_km,candidate)) AS best_max_km,
  avg(rmse) AS mean_rmse, stddev_pop(rmse) AS std_rmse, min(rmse) AS min_rmse FROM ea GROUP BY 1""", "mean_km best_rmse best_max_km mean_rmse std_rmse min_rmse", 5)
def multi_hypothesis(spark, sf):
    return EV.multi_hypothesis(candidates(spark, sf)).drop("best_mse")


def scored(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))
    return A.table(spark, sf, "labels").join(d, "doc_id")


_SCORED = "WITH sc AS (SELECT doc_id, quality, toxic, n_chars/(n_chars+1000.0::DOUBLE) AS score FROM labels JOIN documents USING (doc_id))\n"


@query("evl8_classification", _SCORED + """, c AS (SELECT count(*) FILTER (score>=0.5 AND quality=1) AS tp, count(*) FILTER (score>=0.5 AND quality=0) AS fp, count(*) FILTER (score<0.5 AND quality=1) AS fn, avg(score) AS mean_score FROM sc),
u AS (SELECT sum(CASE WHEN p.score>q.score THEN 1.0 WHEN p.score=q.score THEN 0.5 ELSE 0 END)::DOUBLE/count(*) AS roc_auc FROM sc p, sc q WHERE p.quality=1 AND q.quality=0)
SELECT tp, fp, fn, mean_score, tp/(tp+fp)::DOUBLE AS precision, tp/(tp+fn)::DOUBLE AS recall, 2*tp/(2*tp+fp+fn)::DOUBLE AS f1, roc_auc FROM c, u""", "mean_score precision recall f1 roc_auc")
def classification(spark, sf):
    return EV.classification_metrics(scored(spark, sf), "quality", "score")


@query("evl9_anomaly_scores", with_sql("pos") + """, w AS (SELECT event_id, avg(m) AS score FROM (SELECT a.event_id, (b.cog-avg(b.cog) OVER (PARTITION BY a.event_id))*(b.cog-avg(b.cog) OVER (PARTITION BY a.event_id)) AS m FROM
 (SELECT event_id, mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY time, event_id) AS r, count(*) OVER (PARTITION BY mmsi) AS n FROM pos) a
 JOIN (SELECT mmsi, cog, row_number() OVER (PARTITION BY mmsi ORDER BY time, event_id) AS r FROM pos) b ON a.mmsi=b.mmsi AND b.r BETWEEN a.r AND a.r+9 WHERE a.r+9<=a.n) GROUP BY 1)
SELECT count(*) AS n, avg((score>11000)::INT) AS detection_rate, avg(score) AS mean_score FROM w""", "detection_rate mean_score", 4)
def anomaly_scores(spark, sf):
    w = FE.reconstruction_windows(A.positions(spark, sf), 10)
    x = F.transform("input", lambda p: p["cog"])
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / 10
    w = w.select("sample_id", x.alias("x"), F.transform(x, lambda v: mean).alias("rebuilt"))
    return EV.detection_summary(EV.reconstruction_scores(w, "x", "rebuilt", 11000.0))


def _described(spark, sf):
    """Per-sample errors with vessel type, port distance and neighbours within 5 km."""
    fc = forecast(spark, sf)
    errors = EV.sample_errors(fc)
    p = A.positions(spark, sf)
    near = P.near_summaries(p, 5 / 1.852, state=("event_id", "mmsi", "lat", "lon")).groupBy("event_id").agg(F.sum("n").alias("vessel_count_5km"))
    p = P.nearest_port(p.select("event_id", "mmsi", "lat", "lon"), A.ports(spark, sf))
    p = ST.enrich(p.select("event_id", "mmsi", "port_km"), ST.merged_static(A.static_messages(spark, sf)))
    p = p.join(near, "event_id", "left").select(F.col("event_id").alias("sample_id"), "mmsi", "port_km", "ship_type",
                                                 F.coalesce("vessel_count_5km", F.lit(0)).alias("vessel_count_5km"))
    return errors.join(p, "sample_id")


_DESC = _ERR + f""", me AS (SELECT sample_id, (avg(abs(pred_lat-true_lat))+avg(abs(pred_lon-true_lon)))/2 AS error FROM fc GROUP BY 1),
bk AS (SELECT *, epoch_us(time)//60000000 AS bucket FROM pos),
cnt AS (SELECT a.event_id, count(*) AS c FROM bk a JOIN bk b ON a.bucket=b.bucket AND a.mmsi<>b.mmsi AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}<5 GROUP BY 1),
prt AS (SELECT event_id, min({hav('pos.lat', 'pos.lon', 'port.lat', 'port.lon')}) AS port_km FROM pos, port GROUP BY 1),
ds AS (SELECT me.sample_id, error, port_km, ship_type, coalesce(c,0) AS vc, CASE WHEN ship_type BETWEEN 70 AND 74 THEN 'cargo' WHEN ship_type BETWEEN 80 AND 85 OR ship_type=89 THEN 'tanker' WHEN ship_type=30 THEN 'fishing' WHEN ship_type BETWEEN 60 AND 69 THEN 'passenger' ELSE 'other' END AS cat
  FROM me JOIN pos ON pos.event_id=me.sample_id JOIN prt ON prt.event_id=me.sample_id LEFT JOIN cnt ON cnt.event_id=me.sample_id LEFT JOIN latest ON latest.mmsi=pos.mmsi)
"""
_BINLIST = ", ".join(f"('{d}','{b}')" for d, bs in EV.BINS.items() for b in bs)


@query("evl10_sliced_errors", _DESC + f""", q AS (SELECT quantile_cont(vc,0.33) AS a, quantile_cont(vc,0.67) AS b FROM ds),
lg AS (SELECT sample_id, error, 'vessel_type' AS dim, cat AS bin FROM ds UNION ALL SELECT sample_id, error, 'port_distance', CASE WHEN port_km<5 THEN '<5km' WHEN port_km<20 THEN '5-20km' ELSE '>20km' END FROM ds
  UNION ALL SELECT sample_id, error, 'traffic_density', CASE WHEN vc<=a THEN 'low' WHEN vc>=b THEN 'high' ELSE 'medium' END FROM ds, q)""" + _boot("lg", ["dim", "bin"], "error", "sample_id", 40) + f"""
SELECT l.dim, l.bin, coalesce(n,0) AS n, mean, std, CASE WHEN n>=10 THEN low END AS low, CASE WHEN n>=10 THEN high END AS high FROM (VALUES {_BINLIST}) l(dim, bin)
LEFT JOIN (SELECT dim, bin, count(*) AS n, avg(error) AS mean, stddev_pop(error) AS std FROM lg GROUP BY 1,2) s ON s.dim=l.dim AND s.bin=l.bin
LEFT JOIN (SELECT dim, bin, quantile_cont(m,0.025) AS low, quantile_cont(m,0.975) AS high FROM rep GROUP BY 1,2) c ON c.dim=l.dim AND c.bin=l.bin""", "mean std low high")
def sliced_errors(spark, sf):
    d = _described(spark, sf)
    slices = {"vessel_type": codes.vessel_category(F.col("ship_type")), "traffic_density": EV.density_bins(d),
              "port_distance": EV.port_bins(F.col("port_km"))}
    return EV.sliced_errors(d, slices, EV.BINS, n=40)


@query("evl11_custom_slice", _DESC + """
SELECT 'parity' AS dim, l.bin, count(sample_id) AS n, avg(error) AS mean, stddev_pop(error) AS std FROM (VALUES ('even'),('odd'),('none')) l(bin)
LEFT JOIN (SELECT *, CASE WHEN sample_id%2=0 THEN 'even' ELSE 'odd' END AS bin FROM ds) d ON d.bin=l.bin GROUP BY l.bin""", "mean std")
def custom_slice(spark, sf):
    parity = F.when(F.col("sample_id") % 2 == 0, "even").otherwise("odd")
    return EV.sliced_errors(EV.sample_errors(forecast(spark, sf)), {"parity": parity}, {"parity": ("even", "odd", "none")}, n=4).drop("low", "high")


_STEP = _ERR + ", se AS (SELECT *, (abs(pred_lat-true_lat)+abs(pred_lon-true_lon))/2 AS e FROM fc)"


@query("evl12_horizon_curve", _STEP + _boot("se", ["step"], "e", "sample_id", 40) + """, cv AS (SELECT step, avg(e) AS mean, stddev_pop(e) AS std, count(*) AS n FROM se GROUP BY 1)
SELECT cv.step, mean, std, n, (mean-lag(mean) OVER s)/lag(mean) OVER s AS rise, coalesce((mean-lag(mean) OVER s)/lag(mean) OVER s>0.10,false) AS critical, low, high
FROM cv JOIN (SELECT step, quantile_cont(m,0.025) AS low, quantile_cont(m,0.975) AS high FROM rep GROUP BY 1) c ON c.step=cv.step WINDOW s AS (ORDER BY cv.step)""", "mean std rise low high")
def horizon_curve(spark, sf):
    return EV.horizon_curve(EV.with_step_error(forecast(spark, sf)), n=40)


@query("evl12_degradation", _STEP + """, cv AS (SELECT step, avg(e) AS mean FROM se GROUP BY 1)
SELECT count(*) AS steps, arg_max(mean, step) AS final_error, regr_slope(ln(mean), step) AS degradation FROM cv""", "final_error degradation")
def degradation(spark, sf):
    return EV.degradation(EV.horizon_curve(EV.with_step_error(forecast(spark, sf))))


_TYPED = _STEP + """, ty AS (SELECT se.*, coalesce(ship_type,0) AS ship_type FROM se LEFT JOIN latest USING (mmsi)), cv AS (SELECT ship_type, step, avg(e) AS mean, stddev_pop(e) AS std, count(*) AS n FROM ty
  WHERE ship_type IN (SELECT ship_type FROM ty GROUP BY 1 HAVING count(DISTINCT sample_id)>=5) GROUP BY 1,2)
"""


def _typed(spark, sf):
    fc = ST.enrich(EV.with_step_error(forecast(spark, sf)), ST.merged_static(A.static_messages(spark, sf)).select("mmsi", "ship_type"))
    return EV.sliced_curves(fc.withColumn("ship_type", F.coalesce("ship_type", F.lit(0))), "ship_type")


@query("evl13_sliced_curves", _TYPED + "SELECT * FROM cv", "mean std")
def sliced_curves(spark, sf):
    return _typed(spark, sf).select("ship_type", "step", "mean", "std", "n")


@query("evl13_best_worst_bin", _TYPED + """, fe AS (SELECT ship_type, arg_max(mean, step) AS f FROM cv GROUP BY 1)
SELECT arg_min(ship_type,(f,ship_type)) AS best, arg_max(ship_type,(f,ship_type)) AS worst, min(f) AS best_error, max(f) AS worst_error, count(*) AS bins FROM fe""", "best_error worst_error")
def best_worst(spark, sf):
    return EV.best_and_worst(_typed(spark, sf), "ship_type")


_MODELS = _CAND + ", se AS (SELECT *, (abs(pred_lat-true_lat)+abs(pred_lon-true_lon))/2 AS e FROM cd)" + _boot("se", ["candidate", "step"], "e", "sample_id", 40) + """,
cv AS (SELECT a.candidate, a.step, mean, low, high FROM (SELECT candidate, step, avg(e) AS mean FROM se GROUP BY 1,2) a
 JOIN (SELECT candidate, step, quantile_cont(m,0.025) AS low, quantile_cont(m,0.975) AS high FROM rep GROUP BY 1,2) c ON a.candidate=c.candidate AND a.step=c.step)
"""


def _model_curves(spark, sf):
    return EV.horizon_curve(EV.with_step_error(candidates(spark, sf)), ["candidate"], n=40)


@query("evl14_compare_curves", _MODELS + """
SELECT x.candidate AS a, y.candidate AS b, x.step, x.mean-y.mean AS mean_diff, (x.mean-y.mean)/y.mean AS relative_diff, NOT (x.high<y.low OR y.high<x.low) AS ci_overlap FROM cv x JOIN cv y ON x.step=y.step AND x.candidate<y.candidate""", "mean_diff relative_diff")
def compare_curves(spark, sf):
    return EV.compare_curves(_model_curves(spark, sf), "candidate")


@query("evl14_better_curve", _MODELS + """, dg AS (SELECT candidate, arg_max(mean, step) AS f, regr_slope(ln(mean), step) AS d FROM cv GROUP BY 1)
SELECT x.candidate AS a, y.candidate AS b, CASE WHEN x.f<y.f AND x.d<y.d THEN x.candidate WHEN x.f>y.f AND x.d>y.d THEN y.candidate WHEN (x.f-y.f)+0.5*(x.d-y.d)<0 THEN x.candidate ELSE y.candidate END AS better, x.d-y.d AS degradation_diff FROM dg x JOIN dg y ON x.candidate<y.candidate""", "degradation_diff")
def better_curve(spark, sf):
    return EV.better_curve(EV.horizon_curve(EV.with_step_error(candidates(spark, sf)), ["candidate"]), "candidate")


_WORST = _DESC + ", wc AS (SELECT * FROM ds ORDER BY error DESC, sample_id LIMIT 60)\n"


def _worst(spark, sf):
    return EV.worst_cases(_described(spark, sf), 60)


@query("evl15_worst_cases", _WORST + "SELECT sample_id, error, port_km, ship_type, vc AS vessel_count_5km FROM wc", "error port_km")
def worst(spark, sf):
    return _worst(spark, sf).drop("mmsi")


_CASE_COLS = ("error", "port_km", "vessel_count_5km")


def _clusters_sql(k: int = 5, rounds: int = 20) -> str:
    """Farthest-point seeds and Lloyd rounds written out, a step each; a centre is a list of three numbers."""
    cols = ("error", "port_km", "vc")
    z = ", ".join(f"round(({c}-avg({c}) OVER ())/stddev_samp({c}) OVER (), 9)" for c in cols)
    gap = lambda a, b: "round(" + "+".join(f"({a}[{i}]-{b}[{i}])*({a}[{i}]-{b}[{i}])" for i in (1, 2, 3)) + ", 9)"
    out = f""", z AS (SELECT sample_id, [{z}] AS z FROM wc),
s0 AS MATERIALIZED (SELECT 0 AS c, z AS m FROM z ORDER BY {gap('z', '[0.0, 0.0, 0.0]')} DESC, sample_id LIMIT 1)"""
    for i in range(1, k):
        out += f""",
s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT {i}, z FROM (SELECT z, (SELECT min({gap('z.z', 'm')}) FROM s{i - 1}) AS far, sample_id FROM z ORDER BY far DESC, sample_id LIMIT 1))"""
    near = lambda src: f"SELECT sample_id, z, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT sample_id, z, c, {gap('z', 'm')} AS d FROM z, {src}) GROUP BY ALL"
    last = f"s{k - 1}"
    for i in range(rounds):
        out += f""",
l{i} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM {last} LEFT JOIN (SELECT c, [{", ".join(f"round(avg(z[{j}]), 9)" for j in (1, 2, 3))}] AS n FROM ({near(last)}) GROUP BY c) USING (c))"""
        last = f"l{i}"
    dot = lambda a, b: "+".join(f"{a}[{i}]*{b}[{i}]" for i in (1, 2, 3))
    return out + f""",
fin AS MATERIALIZED ({near(last)}),
su AS (SELECT c AS o, count(*) AS n, avg({dot('z', 'z')}) AS q, [avg(z[1]), avg(z[2]), avg(z[3])] AS y FROM fin GROUP BY c),
md AS (SELECT sample_id, c, o, n, {dot('z', 'z')}+q-2*({dot('z', 'y')}) AS md FROM fin, su),
ab AS (SELECT sample_id, max(CASE WHEN o=c THEN n END) AS n, max(CASE WHEN o=c THEN md END) AS a, min(CASE WHEN o<>c THEN md END) AS b FROM md GROUP BY sample_id),
si AS (SELECT avg(CASE WHEN n=1 THEN 0 ELSE (b-a*n/(n-1))/greatest(b, a*n/(n-1)) END) AS silhouette FROM ab)
SELECT c AS cluster, sample_id, place, distance, silhouette FROM (SELECT c, sample_id, sqrt(d) AS distance, row_number() OVER (PARTITION BY c ORDER BY d, sample_id) AS place FROM fin), si WHERE place<=3"""


@query("evl16_failure_clusters", _WORST + _clusters_sql(), "distance silhouette")
def failure_clusters(spark, sf):
    found, silhouette = FA.cluster_cases(_worst(spark, sf), _CASE_COLS, k=5)
    near = FA.representatives(found).select("cluster", "sample_id", "place", "distance")
    return near.withColumn("silhouette", F.lit(silhouette))


@query("evl16_cluster_facts", _WORST + " SELECT count(*) AS cases, 5::BIGINT AS clusters, true AS nearest, true AS apart FROM wc")
def failure_cluster_facts(spark, sf):
    """Every case is in a cluster, representatives are its nearest cases, and clusters are apart."""
    found, silhouette = FA.cluster_cases(_worst(spark, sf), _CASE_COLS, k=5)
    near = FA.representatives(found).groupBy("cluster").agg(F.max("distance").alias("far"), F.count("*").alias("shown"))
    closer = found.join(near, "cluster").groupBy("cluster").agg(F.count("*").alias("cases"), F.count_if(F.col("distance") < F.col("far")).alias("closer"), F.first("shown").alias("shown"))
    return closer.agg(F.sum("cases").alias("cases"), F.count("*").alias("clusters"), F.bool_and(F.col("closer") < F.col("shown")).alias("nearest"),
                      F.lit(silhouette > 0).alias("apart"))


@query("evl17_cluster_profiles", _WORST + """, cl AS (SELECT *, CASE WHEN port_km<3 THEN 0 WHEN port_km<6 THEN 1 ELSE 2 END AS cluster, coalesce(ship_type,0) AS vt FROM wc),
tc AS (SELECT cluster, vt, count(*) AS n FROM cl GROUP BY 1,2), tp AS (SELECT cluster, arg_max(vt,(n,vt)) AS dominant_type, max(n) AS m FROM tc GROUP BY 1)
SELECT cl.cluster, count(*) AS cases, avg(port_km) AS mean_port_km, stddev_pop(port_km) AS std_port_km, avg(error) AS mean_error, avg(vc) AS mean_vessel_count_5km, stddev_pop(vc) AS std_vessel_count_5km,
  any_value(dominant_type) AS dominant_type, any_value(m)/count(*)::DOUBLE AS type_share,
  any_value(dominant_type) || CASE WHEN avg(port_km)<5 THEN '/harbour' WHEN avg(port_km)<20 THEN '/coast' ELSE '/sea' END || CASE WHEN avg(error)>2 THEN '/critical' WHEN avg(error)>1 THEN '/high' ELSE '/medium' END AS label
FROM cl JOIN tp USING (cluster) GROUP BY 1""", "mean_port_km std_port_km mean_error mean_vessel_count_5km std_vessel_count_5km type_share")
def cluster_profiles(spark, sf):
    km = F.col("port_km")
    c = _worst(spark, sf).withColumns({"cluster": F.when(km < 3, 0).when(km < 6, 1).otherwise(2), "vessel_type": F.coalesce("ship_type", F.lit(0))})
    return FA.cluster_profiles(c, ["vessel_count_5km"])


@query("evl18_case_cards", _WORST + """, ar AS (SELECT sample_id, list(pred_lat ORDER BY step)||list(pred_lon ORDER BY step) AS p, list(true_lat ORDER BY step)||list(true_lon ORDER BY step) AS t FROM fc WHERE sample_id IN (SELECT sample_id FROM wc) GROUP BY 1),
ub AS (SELECT sample_id, unnest(p) AS p, unnest(t) AS t FROM ar), nm AS (SELECT sample_id, avg(abs(p-t)) AS mean_absolute_diff, max(abs(p-t)) AS max_absolute_diff, sqrt(sum((p-t)*(p-t))) AS diff_norm, sqrt(sum((p-t)*(p-t)))/(sqrt(sum(t*t))+1e-8) AS relative_error FROM ub GROUP BY 1)
SELECT sample_id, error, sqrt(port_km*port_km+vc*vc) AS feature_norm, (port_km+vc)/2 AS feature_mean, mean_absolute_diff, max_absolute_diff, diff_norm, relative_error,
  coalesce(nullif(concat_ws(',', CASE WHEN ship_type IN (70,71) THEN 'cargo_motion' WHEN ship_type IN (80,81) THEN 'tanker_turns' WHEN ship_type=30 THEN 'fishing_motion' END,
    CASE WHEN port_km<5 THEN 'harbour_motion' WHEN port_km>20 THEN 'open_water_motion' END, CASE WHEN error>2 THEN 'check_data,combine_models' END), ''), 'inspect') AS tips FROM wc JOIN nm USING (sample_id)""",
       "error feature_norm feature_mean mean_absolute_diff max_absolute_diff diff_norm relative_error")
def case_cards(spark, sf):
    w = _worst(spark, sf)
    fc = forecast(spark, sf).join(w.select("sample_id"), "sample_id", "left_semi")
    both = lambda side: F.sort_array(F.collect_list(F.struct("step", f"{side}_lat", f"{side}_lon"))).alias(side)
    arrays = fc.groupBy("sample_id").agg(both("pred"), both("true"))
    flat = lambda s: F.concat(F.transform(s, lambda p: p[f"{s}_lat"]), F.transform(s, lambda p: p[f"{s}_lon"]))
    cases = w.join(arrays, "sample_id").select("*", flat("pred").alias("prediction"), flat("true").alias("target"), F.col("ship_type").alias("vessel_type"))
    cards = FA.case_cards(cases, ["port_km", "vessel_count_5km"])
    tips = F.array_join("recommendations", ",")
    return cards.select("sample_id", "error", "feature_norm", "feature_mean", "mean_absolute_diff", "max_absolute_diff", "diff_norm", "relative_error", tips.alias("tips"))


_W = "exp(-0.1::DOUBLE*(step-1))*CASE WHEN step<=6 THEN 2 ELSE 1 END"


@query("evl19_weighted_error", _ERR + f"""
SELECT false AS decay, avg(square/2)+0.5*avg((sog_error*sog_error+cog_delta*cog_delta)/2) AS loss, avg(square/2) AS position, avg((sog_error*sog_error+cog_delta*cog_delta)/2) AS movement FROM er
UNION ALL SELECT true, avg({_W}*square/2)+0.5*avg({_W}*(sog_error*sog_error+cog_delta*cog_delta)/2), avg({_W}*square/2), avg({_W}*(sog_error*sog_error+cog_delta*cog_delta)/2) FROM er""", "loss position movement", 4)
def weighted_error(spark, sf):
    fc = forecast(spark, sf)
    return EV.weighted_error(fc).withColumn("decay", F.lit(False)).unionByName(EV.weighted_error(fc, decay=True).withColumn("decay", F.lit(True)))


@query("col16_stepwise_risk", with_sql("seg") + FORECAST + _pairs_sql(radius=2.0) + """, tr AS (SELECT sample_id, step, pred_lat AS lat, pred_lon AS lon, pred_lat-lag(pred_lat) OVER w AS vlat, pred_lon-lag(pred_lon) OVER w AS vlon FROM fc WINDOW w AS (PARTITION BY sample_id ORDER BY step)),
j AS (SELECT a.sample_id, a.lat-b.lat AS px, a.lon-b.lon AS py, a.vlat-b.vlat AS vx, a.vlon-b.vlon AS vy FROM tr a JOIN pair p ON p.event_id=a.sample_id JOIN tr b ON b.sample_id=p.oid AND b.step=a.step WHERE a.vlat IS NOT NULL),
t AS (SELECT *, greatest(0, CASE WHEN vx*vx+vy*vy>1e-6 THEN -(px*vx+py*vy)/(vx*vx+vy*vy) ELSE 0 END) AS t FROM j)
SELECT sample_id, avg(1/(1+exp((sqrt((px+t*vx)*(px+t*vx)+(py+t*vy)*(py+t*vy))*111000-500)/100))*exp(-0.1::DOUBLE*t)) AS risk FROM t GROUP BY 1""", "risk")
def stepwise_risk(spark, sf):
    fc = forecast(spark, sf)
    own = fc.select("sample_id", "step", F.col("pred_lat").alias("lat"), F.col("pred_lon").alias("lon"))
    # the tracks go with the rows, so that pairs needn't be joined; where row numbers repeat, they are
    lists = CO.motion_lists(own).withColumnRenamed("sample_id", "event_id")
    p = A.positions(spark, sf).join(lists, "event_id")
    p = p.withColumn("repeats", F.col("repeats") | (F.count("*").over(Window.partitionBy("event_id")) > 1))
    near = P.near_pairs(p, 2.0, state=("event_id", "mmsi", "time", "lat", "lon", "steps", "repeats")).withColumnRenamed("event_id", "sample_id")
    if saved(p.filter("repeats").select("event_id"), "repeated").isEmpty():
        return CO.stepwise_risk(None, None, pairs=near)
    again = near.filter("repeats OR other_repeats").select("sample_id", F.col("other_event_id").alias("neighbour_id"))
    track = own.withColumnRenamed("sample_id", "neighbour_id")
    return CO.stepwise_risk(own, again.join(track, "neighbour_id"), pairs=near.filter("NOT repeats AND NOT other_repeats"))


@query("col17_feasibility", with_sql("seg") + f""", w AS (SELECT event_id, cog, sog, lag(cog) OVER s AS pc, lag(sog) OVER s AS ps FROM seg WINDOW s AS (PARTITION BY mmsi, segment_id ORDER BY time, event_id))
SELECT avg(greatest(abs({fold('(cog-pc)')})/5.0-5.0,0)+greatest(abs(sog-ps)/5.0-0.5,0)) AS penalty FROM w WHERE pc IS NOT NULL AND ps IS NOT NULL AND sog IS NOT NULL""", "penalty")
def feasibility(spark, sf):
    s = A.segments(spark, sf)
    sample = F.col("mmsi") * 100000 + F.col("segment_id")
    step = F.unix_micros("time") * 1000 + F.col("event_id") % 1000
    return EV.feasibility(s.select(sample.alias("sample_id"), step.alias("step"), F.col("cog").alias("pred_cog"), F.col("sog").alias("pred_sog")))


# ------------------------------------------------------------- model tables

def fold_scores(spark, sf):
    """Scores of three models over 24 folds (hours by two), from the three candidates."""
    fc = EV.with_step_error(candidates(spark, sf))
    fold = (F.unix_micros("origin_time") / F.lit(1800_000_000)).cast("long") % 24
    return fc.groupBy(F.format_string("m%d", "candidate").alias("model"), F.lit("mae").alias("metric"), fold.cast("int").alias("fold")).agg(
        F.round(F.avg("abs_error"), 9).alias("score"))


_FOLDS = _CAND + """, fs AS (SELECT 'm'||candidate AS model, 'mae' AS metric, CAST(epoch_us(origin_time)//1800000000%24 AS INT) AS fold, round(avg((abs(pred_lat-true_lat)+abs(pred_lon-true_lon))/2),9) AS score FROM cd GROUP BY ALL)"""
_PAIR = _FOLDS + ", pr AS (SELECT x.fold, x.model AS model_a, y.model AS model_b, x.score AS a, y.score AS b FROM fs x JOIN fs y ON x.fold=y.fold AND x.model<y.model)\n"


def _pairs(spark, sf):
    s = fold_scores(spark, sf)
    a = s.select("fold", F.col("model").alias("model_a"), F.col("score").alias("a"))
    b = s.select("fold", F.col("model").alias("model_b"), F.col("score").alias("b"))
    return a.join(b, "fold").filter("model_a < model_b")


@query("evl20_rank_models", _FOLDS + """, ms AS (SELECT model, 'mae' AS metric, avg(score) AS value FROM fs GROUP BY 1 UNION ALL SELECT model, 'recall', 1/(1+round(avg(score),3)) FROM fs GROUP BY 1)
SELECT model, metric, value, rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric='mae' THEN value ELSE -value END)+(count(*) OVER (PARTITION BY metric, value)-1)/2.0::DOUBLE AS rank FROM ms""", "value rank")
def rank_models(spark, sf):
    s = fold_scores(spark, sf)
    mae = s.groupBy("model").agg(F.avg("score").alias("value")).withColumn("metric", F.lit("mae"))
    recall = s.groupBy("model").agg((1 / (1 + F.round(F.avg("score"), 3))).alias("value")).withColumn("metric", F.lit("recall"))
    return EV.rank_models(mae.unionByName(recall))


@query("bst1_bootstrap_percentile", with_sql("pos") + _boot("pos", [], "sog", "event_id", 100) + """
SELECT (SELECT avg(sog) FROM pos) AS value, (SELECT count(sog) FROM pos) AS n, quantile_cont(m,0.025) AS low, quantile_cont(m,0.975) AS high FROM rep""", "value low high")
def bootstrap_percentile(spark, sf):
    return TS.bootstrap_ci(A.positions(spark, sf), [], "sog", "event_id", 100)


@query("bst1_bootstrap_basic", with_sql("pos") + ", hp AS (SELECT *, hour(time)::INT AS h FROM pos)" + _boot("hp", ["h"], "sog", "event_id", 100) + """
SELECT a.h, value, n, 2*value-hi AS low, 2*value-lo AS high FROM (SELECT h, avg(sog) AS value, count(sog) AS n FROM hp GROUP BY 1) a JOIN (SELECT h, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi FROM rep GROUP BY 1) r ON a.h=r.h""", "value low high")
def bootstrap_basic(spark, sf):
    p = A.positions(spark, sf).withColumn("h", F.hour("time"))
    return TS.bootstrap_ci(p, ["h"], "sog", "event_id", 100, method="basic")


def _normal(x: str) -> str:
    """Normal distribution function in SQL, by its power series."""
    series = f"list_sum(list_transform(range(0, 100), lambda k: exp((2*k+1)*ln(greatest(abs({x}), 1e-300)) + k*ln(2) + lgamma(k+1) - lgamma(2*k+2))))"
    return f"(0.5 + sign({x})*exp(-({x})*({x})/2)/sqrt(2*pi())*{series})"


# The bias as a normal quantile comes from Newton steps; both ends are then ranks among the replicates.
_BCA = (with_sql("pos") + ", hp AS (SELECT *, hour(time)::INT AS h FROM pos)" + _boot("hp", ["h"], "sog", "event_id", 100)).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ob AS (SELECT h, avg(sog) AS value, count(sog) AS n FROM hp GROUP BY 1),
cu AS (SELECT hp.h, avg((sog-value)*(sog-value)*(sog-value))/nullif(var_pop(sog)*stddev_pop(sog), 0)/(6*sqrt(count(sog))) AS a FROM hp JOIN ob USING (h) GROUP BY 1),
sh AS (SELECT h, avg((m<value)::INT) AS share, list(m ORDER BY m) AS ms FROM rep JOIN ob USING (h) GROUP BY 1),
nw(h, share, i, z) AS (SELECT h, share, 0, 0::DOUBLE FROM sh WHERE share>0 AND share<1 UNION ALL SELECT h, share, i+1, z-({_normal("z")}-share)*sqrt(2*pi())*exp(z*z/2) FROM nw WHERE i<25),
lv AS (SELECT h, ms, coalesce(a, 0) AS a, z, unnest([-1, 1]) AS side FROM sh JOIN cu USING (h) LEFT JOIN (SELECT h, z FROM nw WHERE i=25) USING (h)),
sf AS (SELECT h, ms, side, CASE WHEN z IS NULL THEN 0.5+side*0.475 ELSE z+(z+side*1.959963984540054)/(1-a*(z+side*1.959963984540054)) END AS u, z IS NULL AS plain FROM lv),
rk AS (SELECT h, ms, side, CASE WHEN plain THEN u ELSE {_normal("u")} END*(len(ms)-1) AS r FROM sf),
en AS (SELECT h, side, ms[floor(r)::INT+1]+(ms[ceil(r)::INT+1]-ms[floor(r)::INT+1])*(r-floor(r)) AS v FROM rk)
SELECT h, value, n, max(v) FILTER (side=-1) AS low, max(v) FILTER (side=1) AS high FROM ob JOIN en USING (h) GROUP BY ALL"""


@query("bst1_bootstrap_bca", _BCA, "value low high")
def bootstrap_bca(spark, sf):
    return TS.bootstrap_ci(A.positions(spark, sf).withColumn("h", F.hour("time")), ["h"], "sog", "event_id", 100, method="BCa")


@query("udf2_bootstrap_statistic", with_sql("pos") + _boot("pos", [], "sog", "event_id", 60).replace("sum(w*x)/sum(w)", "sqrt(sum(w*x*x)/sum(w))") + """
SELECT (SELECT sqrt(avg(sog*sog)) FROM pos) AS value, (SELECT count(sog) FROM pos) AS n, quantile_cont(m,0.025) AS low, quantile_cont(m,0.975) AS high FROM rep""", "value low high")
def bootstrap_statistic(spark, sf):
    rms = lambda x, w: F.sqrt(F.sum(w * x * x) / F.sum(w))
    return TS.bootstrap_ci(A.positions(spark, sf), [], "sog", "event_id", 60, statistic=rms)


@query("bst2_bootstrap_difference", with_sql("pos") + _boot("pos", ["msg_type"], "sog", "event_id", 100) + """, df AS (SELECT replicate, max(m) FILTER (msg_type=1)-max(m) FILTER (msg_type=18) AS gap FROM rep GROUP BY 1)
SELECT (SELECT avg(sog) FILTER (msg_type=1)-avg(sog) FILTER (msg_type=18) FROM pos) AS difference, quantile_cont(gap,0.025) AS low, quantile_cont(gap,0.975) AS high FROM df""", "difference low high")
def bootstrap_difference(spark, sf):
    return TS.bootstrap_difference(A.positions(spark, sf), "msg_type", 1, 18, "sog", "event_id", 100)


@query("bst2_bootstrap_medians", with_sql("pos") + _boot("pos", ["msg_type"], "cog", "event_id", 20).rsplit(",\nrep AS", 1)[0] + f""", ws AS (SELECT *, {"+".join(f"(u>={e})::INT" for e in TS._POISSON)} AS w FROM rep3 WHERE msg_type IN (1,18)),
md AS (SELECT msg_type, replicate, quantile_cont(x,0.5) AS m FROM ws, range(0,10) c(k) WHERE k<w GROUP BY 1,2), gp AS (SELECT replicate, max(m) FILTER (msg_type=1)-max(m) FILTER (msg_type=18) AS gap FROM md GROUP BY 1)
SELECT (SELECT quantile_cont(cog,0.5) FILTER (msg_type=1)-quantile_cont(cog,0.5) FILTER (msg_type=18) FROM pos) AS difference, quantile_cont(gap,0.025) AS low, quantile_cont(gap,0.975) AS high FROM gp""", "difference low high")
def bootstrap_medians(spark, sf):
    return TS.bootstrap_medians(A.positions(spark, sf), "msg_type", 1, 18, "cog", "event_id", 20)


def _tail(density: str, x: str) -> str:
    """Logarithm of a two-sided probability: the density beyond |x| at x/u, by Simpson's rule over u from 0 to 1."""
    return (f"CASE WHEN {x}=0 THEN 0 ELSE ln(2*list_sum(list_transform(range(1, 4001), lambda k: (CASE WHEN k=4000 THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END)"
            f"*{density.format(x=f'(abs({x})*4000.0/k)')}*abs({x})*16000000.0/k/k))/12000) END")


def _student(t: str, v: str) -> str:
    return _tail(f"exp(lgamma(({v}+1)/2.0)-lgamma({v}/2.0)-0.5*ln({v}*pi())-({v}+1)/2.0*ln(1+{{x}}*{{x}}/{v}))", t)


_GAUSS = "exp(-0.5*{x}*{x})/sqrt(2*pi())"
# ways to reach each rank sum with ranks 1..r, row by row
_WAYS = """, wy(r, ways) AS (SELECT 0, [1::DOUBLE] || list_transform(range(0, 1275), lambda q: 0::DOUBLE) UNION ALL
 SELECT r+1, list_transform(range(1, 1277), lambda q: ways[q]+CASE WHEN q>r+1 THEN ways[q-r-1] ELSE 0 END) FROM wy WHERE r<50)"""
_RANKED = """, rk AS (SELECT model_a, model_b, a-b AS d, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(a-b))+(count(*) OVER (PARTITION BY model_a, model_b, abs(a-b))-1)/2.0::DOUBLE AS r,
  count(*) OVER (PARTITION BY model_a, model_b, abs(a-b)) AS same FROM pr WHERE a<>b),
wc0 AS (SELECT model_a, model_b, coalesce(sum(r) FILTER (d>0),0) AS w_plus, coalesce(sum(r) FILTER (d<0),0) AS w_minus, count(*) AS n, sum(same*same-1) AS ties FROM rk GROUP BY 1,2),
wc1 AS (SELECT w.*, least(w_plus, w_minus) AS w, pairs FROM wc0 w JOIN (SELECT model_a, model_b, count(a-b) AS pairs FROM pr GROUP BY 1,2) USING (model_a, model_b)),
wx AS (SELECT wc1.*, CASE WHEN n<=50 AND ties=0 AND n=pairs THEN ln(least(1, 2*list_sum(ways[1:w::INT+1])/pow(2, n))) ELSE """ + _tail(_GAUSS, "((w-n*(n+1)/4.0)/sqrt(n*(n+1)*(2*n+1)/24.0-ties/48.0))") + """ END AS log_p
 FROM wc1 LEFT JOIN wy ON wy.r=n)"""


def _log_p(df, name="p"):
    """Probabilities span many powers of ten, so their logarithms are compared."""
    return df.withColumn(f"log_{name}", F.log(name)).drop(name)


@query("tst1_paired_t", _PAIR + """, d AS (SELECT model_a, model_b, avg(a-b) AS mean_difference, stddev_samp(a-b) AS sd, count(*) AS n FROM pr GROUP BY 1,2)
SELECT model_a, model_b, mean_difference, n, n-1 AS df, mean_difference/(sd/sqrt(n)) AS t, mean_difference/sd AS effect, CASE WHEN abs(mean_difference/sd)<0.2 THEN 'negligible' WHEN abs(mean_difference/sd)<0.5 THEN 'small' WHEN abs(mean_difference/sd)<0.8 THEN 'medium' ELSE 'large' END AS effect_label,
 """ + _student("(mean_difference/(sd/sqrt(n)))", "(n-1)") + """ AS log_p FROM d""", "mean_difference t effect log_p", 4)
def paired_t(spark, sf):
    return _log_p(TS.paired_t(_pairs(spark, sf), "a", "b", ["model_a", "model_b"])).drop("significant")


@query("tst2_wilcoxon", _PAIR.replace("WITH ", "WITH RECURSIVE ", 1) + _WAYS + _RANKED + " SELECT model_a, model_b, w_plus, w_minus, n, w, log_p FROM wx", "w_plus w_minus w log_p", 4)
def wilcoxon(spark, sf):
    return _log_p(TS.wilcoxon(_pairs(spark, sf), "a", "b", ["model_a", "model_b"])).select("model_a", "model_b", "w_plus", "w_minus", "n", "w", "log_p")


@query("tst3_cliffs_delta", with_sql("pos") + """, g AS (SELECT msg_type, sog FROM pos WHERE sog IS NOT NULL), c AS (SELECT (SELECT count(*) FROM g WHERE msg_type=1) AS n1, (SELECT count(*) FROM g WHERE msg_type=18) AS n2,
 (SELECT sum(sign(a.sog-b.sog))::BIGINT FROM g a, g b WHERE a.msg_type=1 AND b.msg_type=18) AS dominance) SELECT dominance, n1, n2, dominance/(n1*n2)::DOUBLE AS delta,
 CASE WHEN abs(dominance/(n1*n2)::DOUBLE)<0.147 THEN 'negligible' WHEN abs(dominance/(n1*n2)::DOUBLE)<0.33 THEN 'small' WHEN abs(dominance/(n1*n2)::DOUBLE)<0.474 THEN 'medium' ELSE 'large' END AS effect_label FROM c""", "delta", 9)
def cliffs_delta(spark, sf):
    return TS.cliffs_delta(A.positions(spark, sf), "msg_type", 1, 18, "sog")


@query("tst4_mcnemar", _SCORED + """, r AS (SELECT (score>=0.5)=(quality=1) AS x, (score<0.3)=(quality=1) AS y FROM sc), c AS (SELECT count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c, count(*) FILTER (x AND y) AS "both", count(*) FILTER (NOT x AND NOT y) AS neither FROM r)
SELECT *, CASE WHEN b+c<25 THEN 'exact' ELSE 'chi-square' END AS test, CASE WHEN b+c<25 THEN least(b,c) ELSE (abs(b-c)-1)*(abs(b-c)-1)/(b+c)::DOUBLE END AS statistic,
 CASE WHEN b+c<25 THEN ln(least(1, 2*list_sum(list_transform(range(0, least(b,c)+1), lambda i: exp(lgamma(b+c+1)-lgamma(i+1)-lgamma(b+c-i+1))))/pow(2, b+c))) ELSE """ + _tail(_GAUSS, "((abs(b-c)-1)/sqrt((b+c)::DOUBLE))") + """ END AS log_p FROM c""", "statistic log_p", 4)
def mcnemar(spark, sf):
    right = F.col("quality") == 1
    s = scored(spark, sf).select(((F.col("score") >= 0.5) == right).alias("x"), ((F.col("score") < 0.3) == right).alias("y"))
    return _log_p(TS.mcnemar(s, "x", "y")).drop("significant")


_P = with_sql("pos") + """, pv AS (SELECT 'f'||(mmsi%3) AS family, mmsi AS test_id, round(least(1.0,0.0005::DOUBLE*count(*)*((mmsi%17)+1)),6) AS p FROM pos GROUP BY mmsi), rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test_id) AS i, count(*) OVER (PARTITION BY family) AS m FROM pv)
"""
_COR = {
    "bonferroni": "p*m", "sidak": "1-pow(1-p,m)", "holm": "max(p*(m-i+1)) OVER up", "holm-sidak": "max(1-pow(1-p,m-i+1)) OVER up",
    "simes-hochberg": "min(p*(m-i+1)) OVER down", "fdr_bh": "min(p*m/i) OVER down", "fdr_by": "min(p*m*(SELECT sum(1.0::DOUBLE/k) FROM range(1, (SELECT max(m)+1 FROM rk r2 WHERE r2.family=rk.family)) t(k))/i) OVER down",
}


@query("tst5_corrections", _P.replace("pv), rk", "pv), rk") + ", hm AS (SELECT family, sum(1.0::DOUBLE/k) AS h FROM (SELECT DISTINCT family, m FROM rk), LATERAL (SELECT unnest(range(1, m+1)) AS k) GROUP BY 1) " + " UNION ALL ".join(
    f"SELECT '{n}' AS method, rk.family, test_id, least({x if n != 'fdr_by' else 'min(p*m*h/i) OVER down'},1.0) AS corrected FROM rk JOIN hm USING (family) WINDOW up AS (PARTITION BY rk.family ORDER BY p, test_id), down AS (PARTITION BY rk.family ORDER BY p DESC, test_id DESC)"
    for n, x in _COR.items()), "corrected")
def corrections(spark, sf):
    m = F.col("mmsi")
    p = A.positions(spark, sf).groupBy("mmsi").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("f"), m % 3).alias("family"), m.alias("test_id"),
        F.round(F.least(F.lit(1.0), 0.0005 * F.col("n") * ((m % 17) + 1)), 6).alias("p"))
    out = None
    for method in TS.METHODS:
        one = TS.corrected(p, method).select(F.lit(method).alias("method"), "family", "test_id", "corrected")
        out = one if out is None else out.unionByName(one)
    return out


@query("tst6_model_summary", _FOLDS + _boot("fs", ["metric", "model"], "score", "(model||'-'||fold)", 40) + """
SELECT a.metric, a.model, mean, std, n, low, high, mean=min(mean) OVER () AS best FROM (SELECT metric, model, avg(score) AS mean, stddev_samp(score) AS std, count(*) AS n FROM fs GROUP BY 1,2) a
JOIN (SELECT model, quantile_cont(m,0.025) AS low, quantile_cont(m,0.975) AS high FROM rep GROUP BY 1) r ON a.model=r.model""", "mean std low high")
def model_summary(spark, sf):
    return TS.model_summary(fold_scores(spark, sf), n=40)


@query("tst6_compare_models", _PAIR.replace("WITH ", "WITH RECURSIVE ", 1) + _WAYS + _RANKED + """,
tt AS (SELECT model_a, model_b, count(*) AS n, avg(a-b) AS mean_difference, avg(a-b)/(stddev_samp(a-b)/sqrt(count(*))) AS t,
  (SELECT sum(sign(x.a-y.b)) FROM pr x, pr y WHERE x.model_a=pr.model_a AND x.model_b=pr.model_b AND y.model_a=pr.model_a AND y.model_b=pr.model_b)/(count(*)*count(*)) AS delta FROM pr GROUP BY pr.model_a, pr.model_b),
pp AS (SELECT tt.*, wx.w, wx.log_p AS log_w_p, """ + _student("t", "(tt.n-1)") + """ AS log_t_p FROM tt JOIN wx USING (model_a, model_b)),
ch AS (SELECT *, CASE WHEN n<20 THEN log_w_p ELSE log_t_p END AS log_p FROM pp),
hm AS (SELECT *, log_p+ln(count(*) OVER ()-row_number() OVER (ORDER BY log_p, model_a, model_b)+1) AS up FROM ch)
SELECT 'mae' AS metric, model_a, model_b, n, mean_difference, delta, t, w, log_t_p, log_w_p, log_p, least(0, max(up) OVER (ORDER BY log_p, model_a, model_b)) AS log_corrected FROM hm""",
       "mean_difference delta t w log_t_p log_w_p log_p log_corrected", 4)
def compare_models(spark, sf):
    out = TS.compare_models(fold_scores(spark, sf))
    for name in ("t_p", "w_p", "p", "corrected"):
        out = _log_p(out, name)
    return out.drop("significant")


# ------------------------------------------------------------- splits

@query("spl1_random_split", with_sql("pos") + """, r AS (SELECT event_id, row_number() OVER (ORDER BY substr(md5(event_id::VARCHAR||'-42'),1,15), event_id)-1 AS i, count(*) OVER () AS n FROM pos)
SELECT event_id, CASE WHEN i<floor(n*0.1::DOUBLE) THEN 'test' WHEN i<floor(n*0.1::DOUBLE)+floor(n*0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM r""")
def random_split(spark, sf):
    return SP.random_split(A.positions(spark, sf), "event_id").select("event_id", "split")


@query("spl2_ordered_split", with_sql("pos") + """, r AS (SELECT event_id, row_number() OVER (ORDER BY mmsi, time, event_id)-1 AS i, count(*) OVER () AS n FROM pos)
SELECT event_id, CASE WHEN i<floor(n*0.7::DOUBLE) THEN 'train' WHEN i<floor(n*(0.7::DOUBLE+0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r""")
def ordered_split(spark, sf):
    p = A.positions(spark, sf)
    return SP.ordered_split(p, [F.col("mmsi"), F.unix_micros("time"), F.col("event_id")]).select("event_id", "split")


@query("spl3_cut_date_split", with_sql("pos") + """
SELECT event_id, CASE WHEN time<TIMESTAMP '2024-01-01 06:00:00' THEN 'train' WHEN time<TIMESTAMP '2024-01-01 08:24:00' THEN 'validation' ELSE 'test' END AS split FROM pos WHERE time<TIMESTAMP '2024-01-01 10:48:00'""")
def cut_date(spark, sf):
    return SP.by_cut_date(A.positions(spark, sf), "time", "2024-01-01 06:00:00", 0.1, 0.1).select("event_id", "split")


_ROWS = with_sql("pos") + ", r AS (SELECT *, row_number() OVER (ORDER BY time, event_id)-1 AS i, count(*) OVER () AS n FROM pos)"
_TS = _ROWS + """, f AS (SELECT r.*, k AS fold, n-(4-k)*(n//5) AS s0, n-(4-k)*(n//5)+n//5 AS s1 FROM r, range(0,4) t(k)), te AS (SELECT fold, max(time) AS train_end FROM f WHERE i<s0 GROUP BY 1),
tf AS (SELECT f.event_id, f.mmsi, f.time, f.fold::INT AS fold, CASE WHEN i<s0 THEN 'train' ELSE 'test' END AS side FROM f JOIN te USING (fold) WHERE i<s0 OR (i<s1 AND epoch_us(f.time)-epoch_us(train_end)>=3600000000))
"""


@query("spl4_time_series_folds", _TS + "SELECT fold, side, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM tf GROUP BY 1,2")
def time_series_folds(spark, sf):
    t = SP.time_series_folds(A.positions(spark, sf), 4)
    return t.groupBy("fold", "side").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_GF = with_sql("pos") + """, sz AS (SELECT mmsi, count(*) AS rows FROM pos GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY rows DESC, mmsi)-1 AS r FROM sz),
gf AS (SELECT mmsi, rows, CAST(CASE WHEN (r//4)%2=0 THEN r%4 ELSE 3-r%4 END AS INT) AS test_fold FROM rk)
"""


@query("spl5_group_folds", _GF + "SELECT * FROM gf")
def group_folds(spark, sf):
    return SP.group_folds(A.positions(spark, sf), 4)


@query("spl6_combined_folds", _GF + """, t AS (SELECT p.*, test_fold, k AS fold FROM pos p JOIN gf USING (mmsi), range(0,4) q(k)),
tr AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY time, event_id)-1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM t WHERE test_fold<>fold)
SELECT fold::INT AS fold, 'test' AS side, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM t WHERE test_fold=fold GROUP BY 1
UNION ALL SELECT fold::INT, 'train', count(*), min(event_id), max(event_id) FROM tr WHERE i<n-3*(n//4) GROUP BY 1""")
def combined_folds(spark, sf):
    t = SP.combined_folds(A.positions(spark, sf), 4)
    return t.groupBy("fold", "side").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def _counted(t):
    return t.groupBy("fold", "side").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_CNT = "SELECT fold::INT AS fold, side, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM x WHERE side IS NOT NULL GROUP BY 1,2"


@query("spl7_purged_folds", _ROWS + """, x AS (SELECT event_id, k AS fold, CASE WHEN i>=greatest(0,n-(k+1)*(n//5)-50-2000) AND i<n-(k+1)*(n//5)-50 THEN 'train' WHEN i>=n-(k+1)*(n//5) AND i<n-k*(n//5) THEN 'test' END AS side FROM r, range(0,4) t(k))
""" + _CNT)
def purged_folds(spark, sf):
    return _counted(SP.purged_folds(A.positions(spark, sf), 4, gap_rows=50, max_train=2000))


@query("spl7_blocking_folds", _ROWS + """, x AS (SELECT event_id, k AS fold, CASE WHEN i<k*(n//8+10)-10 AND i>=greatest(0,k*(n//8+10)-10-(n-4*(n//8))) THEN 'train' WHEN i>=k*(n//8+10) AND i<k*(n//8+10)+n//8 THEN 'test' END AS side FROM r, range(1,4) t(k))
""" + _CNT)
def blocking_folds(spark, sf):
    return _counted(SP.blocking_folds(A.positions(spark, sf), 4, gap_rows=10))


@query("spl7_vessel_time_folds", _ROWS + """, y AS (SELECT event_id, mmsi, k AS fold, substr(md5(mmsi::VARCHAR||'-'||(42+k)),1,15)<'ccccccccccccccc' AS chosen, CASE WHEN i<n-(k+1)*(n//4) THEN 'train' WHEN i<n-k*(n//4) THEN 'test' END AS side FROM r, range(0,3) t(k)),
x AS (SELECT * FROM y WHERE chosen=(side='train'))
""" + _CNT)
def vessel_time_folds(spark, sf):
    return _counted(SP.vessel_time_folds(A.positions(spark, sf), 3))


@query("spl8_split_quality", _TS + """, ov AS (SELECT fold, count(*) FILTER (s>1) AS group_overlap FROM (SELECT fold, mmsi, count(DISTINCT side) AS s FROM tf GROUP BY 1,2) GROUP BY 1),
q AS (SELECT fold, count(*) FILTER (side='train') AS train_rows, count(*) FILTER (side='test') AS test_rows, """ + secs("min(time) FILTER (side='test')", "max(time) FILTER (side='train')") + """/60 AS gap_minutes FROM tf GROUP BY 1)
SELECT fold, train_rows, test_rows, group_overlap, gap_minutes, gap_minutes<0 AS time_overlap, test_rows/train_rows::DOUBLE AS ratio FROM q JOIN ov USING (fold)""", "gap_minutes ratio")
def split_quality(spark, sf):
    return SP.split_quality(SP.time_series_folds(A.positions(spark, sf), 4))


@query("spl9_group_distribution", _GF + "SELECT mmsi, rows, k::INT AS fold, CASE WHEN test_fold=k THEN 'test' ELSE 'train' END AS side FROM gf, range(0,4) t(k)")
def group_distribution(spark, sf):
    return SP.group_distribution(A.positions(spark, sf), 4)


@query("jon10_shared_groups", _TS + "SELECT fold, mmsi FROM tf WHERE side='train' INTERSECT SELECT fold, mmsi FROM tf WHERE side='test'")
def shared_groups(spark, sf):
    return SP.shared_groups(SP.time_series_folds(A.positions(spark, sf), 4))
