"""Small fixtures against known values and brute force."""

import math
from datetime import datetime, timedelta, timezone

import kalman_reference
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakeline.functions import codes, geo, times
from wakeline.operators import clean as C
from wakeline.operators import collision as CO
from wakeline.operators import failures as FA
from wakeline.operators import models as M
from wakeline.operators import proximity as P
from wakeline.operators import quantiles as Q
from wakeline.operators import routes as R
from wakeline.operators import splits as SP
from wakeline.operators import stats as ST
from wakeline.operators import tasks as TK
from wakeline.sources import logs as L
from wakeline.sources import tables as TB


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_geometry(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    r = one(spark, km=geo.haversine_km(*lit(0, 0, 0, 1)), none=geo.haversine_km(F.lit(None).cast("double"), *lit(0, 0, 1)),
            east=geo.bearing_deg(*lit(0, 0, 0, 1)), south=geo.bearing_deg(*lit(1, 0, 0, 0)),
            fold=geo.angle_delta(F.lit(-350.0)), circle=geo.circular_error(*lit(359, 2)), fast=geo.speed_knots(*lit(500, 1)))
    assert r.km == pytest.approx(111.195, abs=1e-3) and r.none is None
    assert (r.east, r.south, r.fold, r.circle, r.fast) == (90.0, 180.0, 10.0, 3.0, None)


def test_local_round_trip(spark):
    x, y = geo.to_local(F.lit(60.1), F.lit(10.2), F.lit(60.0), F.lit(10.0))
    lat, lon = geo.from_local(x, y, F.lit(60.0), F.lit(10.0))
    r = one(spark, lat=lat, lon=lon)
    assert r.lat == pytest.approx(60.1) and r.lon == pytest.approx(10.2)


def test_log_lines(spark, tmp_path):
    good = '2025-05-08 11:10:19,454 - {"class":"AIS","rxtime":"20250508101019","type":1,"mmsi":231477000,"lat":91.0,"lon":181.0,"speed":102.3,"course":10.0,"heading":511}'
    lines = [good, "2025-05-08 11:10:20,000 - [AIS engine v0.61 #0-0] received: 6 msgs", "no stamp", good[:-1], "2025-05-08 11:10:19,454 - {}",
             '2025-05-08 11:10:19,454 - {"type":1,"mmsi":1}', good.replace("20250508101019", "20251308101019")]
    (tmp_path / "a.log").write_text("\n".join(lines))
    got = L.read_ais_log(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].msg_class == "A_pos" and got[0].time == datetime(2025, 5, 8, 10, 10, 19)
    assert (got[0].lat, got[0].lon, got[0].sog, got[0].heading) == (None, None, None, None)
    parsed = L.parse_lines(L.read_lines(spark, str(tmp_path)))
    reasons = {r.reject: r["count"] for r in parsed.groupBy("reject").count().collect()}
    assert reasons == {None: 1, "noise": 2, "malformed": 1, "no_type": 1, "no_time": 2}
    places, static = L.receiver_tables(parsed)
    assert places.count() == 0 and static.count() == 0


def test_gzip_log(spark, tmp_path):
    import gzip

    line = '2025-05-08 11:10:19,454 - {"class":"AIS","rxtime":"20250508101019","type":5,"mmsi":231477000,"shipname":"A"}'
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write(line)
    assert L.read_ais_log(spark, str(tmp_path)).first().name == "A"


def test_mmsi_rules(spark):
    df = spark.createDataFrame([(231477000,), (2500000,), (992000000,), (12345,), (None,)], "mmsi long")
    got = df.select(*[C.valid_mmsi(F.col("mmsi"), r).alias(r) for r in ("strict", "wide", "text")]).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, False), (False, True, False), (False, False, False), (None, None, None)]


PAIRS = {  # lat, lon, sog, cog of both, then what must hold
    "head_on": ((60.0, 10.0, 10.0, 0.0, 60.1, 10.0, 10.0, 180.0), "approaching", "head_on"),
    "parallel": ((60.0, 10.0, 10.0, 0.0, 60.0, 10.01, 10.0, 0.0), "parallel", "parallel_same"),
    "receding": ((60.0, 10.0, 10.0, 180.0, 60.1, 10.0, 10.0, 0.0), "receding", "overtaking_taken"),
}


@pytest.mark.parametrize("name", PAIRS)
def test_cpa_and_encounter(spark, name):
    v, motion, kind = PAIRS[name]
    df = spark.createDataFrame([v], "lat double, lon double, sog double, cog double, other_lat double, other_lon double, other_sog double, other_cog double")
    r = CO.with_encounter(CO.with_cpa(df)).first()
    assert (r.motion, r.encounter) == (motion, kind)
    if name == "head_on":
        assert r.cpa_m < 10 and r.tcpa_s > 0 and r.action == "both_alter"
    if name == "parallel":
        assert r.tcpa_s == 0
    if name == "receding":
        assert r.tcpa_s < 0 and r.warning == "none"


@pytest.mark.parametrize("crowded", [5000, 3])
@pytest.mark.parametrize("centre", [(62.0, -6.8), (0.0, 179.95), (89.8, 10.0)])
def test_near_pairs_match_brute_force(spark, centre, crowded):
    rng = np.random.default_rng(3)
    n = 60
    lat = np.clip(centre[0] + rng.uniform(-0.3, 0.3, n), -90, 90)
    lon = (centre[1] + rng.uniform(-0.4, 0.4, n) + 180) % 360 - 180
    minute = rng.integers(0, 2, n)
    rows = [(i, 200000000 + i % 40, datetime(2024, 1, 1) + timedelta(minutes=int(m), seconds=i % 60), float(a), float(b), 5.0, 5.0)
            for i, (a, b, m) in enumerate(zip(lat, lon, minute))]
    df = spark.createDataFrame(rows, "event_id long, mmsi long, time timestamp, lat double, lon double, sog double, cog double")
    got = {(r.event_id, r.other_event_id) for r in P.near_pairs(df, crowded=crowded).collect()}

    def nm(i, j):
        p, q = math.radians(lat[i]), math.radians(lat[j])
        a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon[j] - lon[i]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(a))) / 1.852

    want = {(i, j) for i in range(n) for j in range(n) if i % 40 != j % 40 and minute[i] == minute[j] and nm(i, j) < 10}
    assert got == want and want


@pytest.mark.parametrize("planar,places", [(True, 30), (False, 30), (True, 700), (False, 1)])
def test_nearest_place(spark, planar, places):
    rng = np.random.default_rng(5)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-20, 20, (40, 2)))]
    spots = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-30, 30, (places, 2)))]
    df = spark.createDataFrame(points + [(90, None, 1.0), (91, None, None)], "event_id long, lat double, lon double")
    there = spark.createDataFrame(spots + [(9000, None, None)], "port_id long, lat double, lon double")
    got = {r.event_id: (r.port_id, r.d) for r in P.nearest_place(df, there, "port_id", "port_id", "d", planar).collect()}
    assert got.pop(90) == got.pop(91) == (None, None)

    def far(p, q):
        if planar:
            return math.hypot(p[1] - q[1], p[2] - q[2])
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    for p in points:
        d, port = min((far(p, q), q[0]) for q in spots)
        assert got[p[0]][0] == port and got[p[0]][1] == pytest.approx(d, rel=1e-9)


def test_nearest_of_no_places(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "event_id long, lat double, lon double")
    none = spark.createDataFrame([(1, None, None)], "port_id long, lat double, lon double")
    for there in (none, none.limit(0)):
        assert P.nearest_place(df, there, "port_id", "p", "d").first()[-2:] == (None, None)


def test_logs_of_one_day_add_up(spark, fleet, tmp_path):
    day = fleet.withColumn("time", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id)"))
    for log, rows in (("a", "event_id % 2 = 0"), ("b", "event_id % 2 = 1"), ("a", "event_id % 2 = 0")):
        TB.write_daily(day.filter(rows), str(tmp_path), log)
    assert spark.read.parquet(str(tmp_path)).count() == fleet.count()


def test_flat_samples_take_the_longest_arrays(spark):
    rows = [(1, [(1.0,)], [(5.0,)]), (2, [(1.0,), (2.0,)], []), (3, None, [(6.0,), (7.0,), (8.0,)])]
    df = spark.createDataFrame(rows, "sample_id long, input array<struct<lat: double>>, target array<struct<lat: double>>")
    got = {tuple(r) for r in TB.flat_samples(df).select("sample_id", "x_0_lat", "x_1_lat", "y_0_lat", "y_2_lat").collect()}
    assert got == {(1, 1.0, None, 5.0, None), (2, 1.0, 2.0, None, None), (3, None, None, 6.0, 8.0)}


def test_an_outlier_leaves_the_bins_even(spark):
    values = [i / 1000 for i in range(20_000)] + [1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert Q.percentiles(df, [], "v", {"a": 0.5, "b": 1.0}).first().asDict() == {"a": 10.0, "b": 1e15}
    counts = Q._with_bins(df.withColumn("k", F.lit(1)), "v", ["k"]).groupBy("_bin").count().collect()
    assert max(r["count"] for r in counts) < 4 * len(values) / Q.BINS


def _forecast(spark, tracks, horizon, kind):
    """Kalman forecast of (lat, lon, seconds) arrays: one list of (lat, lon, var_x, var_y, cov_xy) a track."""
    rows = [(i, [(float(a), float(o), datetime.fromtimestamp(1.7e9 + float(s), timezone.utc)) for a, o, s in zip(*track)]) for i, track in enumerate(tracks)]
    df = spark.createDataFrame(rows, "sample_id long, input array<struct<lat: double, lon: double, time: timestamp>>")
    out = M.kalman_forecast(df, horizon, kind)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {i: [] for i in range(len(tracks))}
    for r in out.orderBy("sample_id", "step").collect():
        got[r.sample_id].append((r.pred_lat, r.pred_lon, r.var_x, r.var_y, r.cov_xy))
    return got


@pytest.mark.parametrize("rate", [0.01, -0.01])
def test_turn_model_follows_a_circle(spark, rate):
    """Ten fixes of a steady turn, then ten steps ahead, against the true circle."""
    k, metre = np.arange(20), geo.M_PER_DEG
    east, north = 5 / rate * (1 - np.cos(rate * 10 * k)), 5 / rate * np.sin(rate * 10 * k)
    lat, lon = 60 + north / metre, 10 + east / (metre * np.cos(np.radians(60)))
    miss = {}
    for kind in ("turn", "velocity"):
        got = _forecast(spark, [(lat[:10], lon[:10], 10.0 * k[:10])], 10, kind)[0]
        miss[kind] = np.hypot((got[-1][0] - lat[-1]) * metre, (got[-1][1] - lon[-1]) * metre * np.cos(np.radians(60)))
    assert miss["turn"] < 20 < miss["velocity"]


@pytest.mark.parametrize("kind", ["velocity", "turn", "acceleration"])
def test_kalman_takes_tracks_of_any_length(spark, kind):
    """Every track of a mixed table equals the numpy filter on that track alone."""
    rng, tracks = np.random.default_rng(4), []
    for n in (3, 4, 5, 6, 9, 30, 3, 12):
        tracks.append((60 + np.cumsum(rng.normal(0, 0.003, n)), -179.5 + np.cumsum(rng.normal(0, 0.005, n)), np.cumsum(rng.choice([30, 61, 600], n))))
    got = _forecast(spark, [*tracks, ([1.0], [2.0], [0.0]), ([], [], [])], 4, kind)
    assert got[len(tracks)] == got[len(tracks) + 1] == []
    for i, (lat, lon, t) in enumerate(tracks):
        want = np.stack(kalman_reference.kalman_batch(kind, lat[None], lon[None], (t - t[0])[None].astype(float), 4), axis=-1)[0]
        assert np.array(got[i]) == pytest.approx(want, rel=1e-6, abs=1e-6)
    two = _forecast(spark, [([60.0, 60.01], [5.0, 5.0], [0.0, 60.0])], 2, kind)[0]
    assert len(two) == 2 and np.isfinite(two).all()


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "v": np.round(rng.exponential(10, 500), 1)})
    pdf.loc[:200, "v"] = 3.5  # one value holds much of the data
    df = spark.createDataFrame(pdf)
    got = Q.percentiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["a", "m", "z"]], np.percentile(g["v"], [10, 50, 99]))


def _dbscan(points, eps, min_samples):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= min_samples
    label = np.full(len(points), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = i
                todo += list(np.flatnonzero(core & (d[j] <= eps)))
    return core, label, d


@pytest.mark.parametrize("spread", [0.02, 0.15])
def test_clusters_match_brute_force(spark, spread):
    rng = np.random.default_rng(11)
    centres = np.array([[0, 0], [0.5, 0.5], [0.5, 0.9], [3, 3]])
    points = np.concatenate([c + rng.normal(0, spread, (60, 2)) for c in centres] + [np.tile([[5.0, 5.0]], (30, 1)), rng.uniform(-3, 6, (40, 2))])
    eps, need = 0.1, 6
    core, label, _ = _dbscan(points, eps, need)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "lat double, lon double")
    got = R.cluster_points(df, eps, need).toPandas()
    where = {(a, b): c for a, b, c in zip(got["lat"], got["lon"], got["cluster"])}
    groups = {}
    for p, c, k in zip(points, core, label):
        if c:
            groups.setdefault(where[tuple(p)], set()).add(k)
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({k for c, k in zip(core, label) if c})
    sizes = got.groupby("cluster")["n"].sum()
    assert sizes.sum() == sum(1 for i in range(len(points)) if core[i] or (np.sqrt(((points - points[i]) ** 2).sum(1))[core] <= eps).any())


def test_cut_points(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 300), rng.permutation(300)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    ordered = sorted(zip(a.tolist(), b.tolist()))
    assert SP.cut_points(df, [F.col("a"), F.col("b")], [0, 17, 299]) == [ordered[i] for i in (0, 17, 299)]


def test_group_folds_keep_vessels_apart(fleet):
    folds = SP.group_k_fold(fleet, 3)
    assert SP.shared_groups(folds).count() == 0
    assert folds.filter("side = 'test'").count() == fleet.count()


def test_tail_probabilities():
    assert ST.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert ST.student_p(0.5, 3) == pytest.approx(0.65145, abs=1e-4)
    assert ST.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert ST.chi2_one_p(3.841459) == pytest.approx(0.05, abs=1e-6)
    assert ST.binomial_half_cdf(3, 10) == pytest.approx(0.171875)
    assert ST.signed_rank_exact_p(3, 6) == pytest.approx(0.15625)


def test_paired_tests(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, 30)
    b = a - 0.4 + rng.normal(0, 0.5, 30)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    t = ST.paired_t(df, "a", "b").first()
    d = a - b
    assert t.t == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(30))) and t.significant
    w = ST.wilcoxon(df, "a", "b").first()
    ranks = pd.Series(abs(d)).rank()
    assert (w.w_plus, w.w_minus) == pytest.approx((ranks[d > 0].sum(), ranks[d < 0].sum()))
    assert w.p < 0.05
    same = ST.paired_t(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double"), "a", "b").first()
    assert (same.t, same.p, same.effect_label) == (0.0, 1.0, "negligible")


def test_mcnemar_example(spark):
    rows = [(True, True)] * 50 + [(True, False)] * 5 + [(False, True)] * 10 + [(False, False)] * 35
    r = ST.mcnemar(spark.createDataFrame(rows, "x boolean, y boolean"), "x", "y").first()
    assert (r.b, r.c, r.test, r.statistic) == (5, 10, "exact", 5.0)
    assert r.p == pytest.approx(0.3017578, abs=1e-6)


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.08, 0.002]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, test_id long, p double")
    want = {"bonferroni": [0.05, 0.2, 0.15, 0.4, 0.01], "holm": [0.04, 0.09, 0.09, 0.09, 0.01], "fdr_bh": [0.025, 0.05, 0.05, 0.08, 0.01],
            "simes-hochberg": [0.04, 0.08, 0.08, 0.08, 0.01]}
    for method, values in want.items():
        got = [r.corrected for r in ST.corrected(df, method).orderBy("test_id").collect()]
        assert got == pytest.approx(values), method


@pytest.mark.parametrize("method", ["percentile", "basic", "BCa"])
def test_bootstrap_covers_the_mean(spark, method):
    rng = np.random.default_rng(6)
    x = rng.exponential(2.0, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    r = ST.bootstrap_ci(df, [], "v", "id", 400, method=method).first()
    half = 1.96 * x.std(ddof=1) / 20
    assert r.value == pytest.approx(x.mean())
    assert r.low == pytest.approx(x.mean() - half, abs=half / 2) and r.high == pytest.approx(x.mean() + half, abs=half / 2)
    moved = ST.bootstrap_ci(df.repartition(7), [], "v", "id", 400, method=method).first()
    assert (moved.low, moved.high) == pytest.approx((r.low, r.high))


@pytest.mark.parametrize("kind", ["velocity", "turn", "acceleration"])
def test_kalman_follows_a_straight_line(spark, kind):
    t = np.arange(8) * 60.0
    lat, lon = 60 + 0.001 * np.arange(8), 10 + 0.002 * np.arange(8)
    got = np.array(_forecast(spark, [(lat, lon, t)], 3, kind)[0])
    np.testing.assert_allclose(got[:, 0], 60 + 0.001 * np.arange(8, 11), atol=2e-3)
    np.testing.assert_allclose(got[:, 1], 10 + 0.002 * np.arange(8, 11), atol=4e-3)
    assert (np.diff(got[:, 2]) > 0).all()


def test_scoring_isolates_errors(spark):
    def model(b):
        if (b["x"] < 0).any():
            raise ValueError("negative")
        return b["x"] * 2

    rows = {r.sample_id: (r.score, r.error) for r in M.score_batches(
        spark.createDataFrame([(1, 1.0), (2, -1.0), (3, 3.0)], "sample_id long, x double").coalesce(1), model).collect()}
    assert rows == {1: (2.0, None), 2: (None, "ValueError: negative"), 3: (6.0, None)}


def test_vessel_documents_round_trip(spark, fleet, tmp_path):
    from wakeline.operators import tracks as TR

    segments = TR.segment(fleet).withColumns({"name": F.lit("A"), "ship_type": F.lit(70)})
    docs = TB.vessel_documents(segments, max_points=9)
    assert docs.select(F.max(F.size("trajectory"))).first()[0] <= 9
    TB.write_vessel_documents(docs, str(tmp_path / "d"))
    back = TB.read_vessel_documents(spark, str(tmp_path / "d"))
    assert back.select("seq").exceptAll(segments.select(F.col("event_id").alias("seq"))).count() == 0
    assert back.count() == segments.count()


def test_graph_windows_stay_whole(fleet):
    samples = TK.build_dataset("graph_network", fleet, TK.TaskConfig(min_rows=5)).collect()
    sides, sizes = {}, {}
    for r in samples:
        sides.setdefault(r.window, set()).add(r.split)
        sizes[r.window] = sizes.get(r.window, 0) + 1
        assert 0 <= r.target[0].interaction_score <= 1 and r.input[0].degree >= 0
    assert all(len(s) == 1 for s in sides.values()) and all(r.window_size == sizes[r.window] >= 2 for r in samples)
    assert {r.split for r in samples} == {"train", "validation", "test"} and len({r.sample_id for r in samples}) == len(samples)


@pytest.mark.parametrize("task", ["trajectory_prediction", "anomaly_detection", "collision_avoidance"])
def test_task_builders(fleet, task):
    samples = TK.build_dataset(task, fleet, TK.TaskConfig(length=5, horizon=2, min_rows=5))
    counts = {r.split: r["count"] for r in samples.groupBy("split").count().collect()}
    n = sum(counts.values())
    assert counts["test"] == int(n * 0.1) and counts["validation"] == int(n * 0.2)


def test_registry_accepts_new_tasks(fleet):
    class Speed(TK.TrajectoryPrediction):
        pass

    TK.register_builder("speed", Speed)
    assert TK.BUILDERS.pop("speed") is Speed
    with pytest.raises(ValueError):
        TK.build_dataset("nothing", fleet)


def test_severity_ladders(spark):
    r = one(spark, a=codes.collision_risk(F.lit(100.0), F.lit(100.0)), b=codes.collision_risk(F.lit(100.0), F.lit(-1.0)),
            c=codes.ops_severity(F.lit(9999.0), F.lit(60.0), F.lit("grounding")), d=codes.cpa_warning(F.lit(240.0), F.lit(500.0)),
            e=codes.vessel_category(F.lit(89)), f=codes.behaviour(F.lit(None).cast("double")), g=times.parse_rxtime(F.lit("20240230000000")))
    assert tuple(r) == (1.0, 0.0, "critical", "critical", "tanker", "unknown", None)


def test_csv_whole_numbers_with_a_point_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,event_id,ship_type,lat,sog\n219000001.0,9007199254740993,70.0,62.5,x\n219000002,2,70.5,,1.5\n,3.0,,1,\n")
    rows = {r.event_id: r for r in TB.read_tracks(spark, [str(tmp_path / "a.csv")]).collect()}
    assert (rows[9007199254740993].mmsi, rows[9007199254740993].ship_type, rows[9007199254740993].sog) == (219000001, 70, None)
    assert rows[9007199254740993].unread == '{"sog":"x"}' and rows[2].unread == '{"ship_type":"70.5"}' and rows[3].unread is None
    assert rows[3].mmsi is None and rows[2].sog == 1.5


def test_differing_parquet_files_are_read_whole(spark, tmp_path):
    days = tmp_path / "days"
    for day in range(3):
        extra = "" if day % 2 else ", 4.5D AS draught"
        spark.sql(f"SELECT {day}L AS event_id, 1L AS mmsi{extra}").coalesce(1).write.mode("append").parquet(str(days))
    assert {r.event_id: r.draught for r in TB.read_tracks(spark, [str(days)]).collect()} == {0: 4.5, 1: None, 2: 4.5}


def test_graph_query_has_a_node_a_minute(spark, fleet, monkeypatch):
    from wakeline.plans import catalog, source_queries

    monkeypatch.setattr(source_queries.A, "positions", lambda spark, sf: fleet)
    got = catalog.QUERIES["udf3_graph_dataset"](spark, "").toPandas()
    fixes = fleet.select("mmsi", "event_id", F.unix_seconds("time").alias("s"), "lat", "lon", "sog").toPandas().sort_values("event_id")
    # the first value of a minute, carried forward; minutes before the first speed go
    nodes = []
    for mmsi, rows in fixes.groupby("mmsi"):
        first = rows.assign(bin=rows.s // 60 * 60).groupby("bin")[["lat", "lon", "sog"]].first()
        grid = first.reindex(range(first.index[0], first.index[-1] + 60, 60)).ffill().dropna()[["lat", "lon"]]
        nodes += [(mmsi, b, lat, lon) for b, lat, lon in grid.itertuples()]
    nodes = pd.DataFrame(nodes, columns=["mmsi", "bin", "lat", "lon"])
    pairs = nodes.merge(nodes, on="bin").query("mmsi_x != mmsi_y")
    a, b = np.radians(pairs.lat_x), np.radians(pairs.lat_y)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(pairs.lon_y - pairs.lon_x) / 2) ** 2
    near = pairs[2 * 6371.0 * np.arcsin(np.sqrt(h)) / 1.852 < 10]
    nodes["window"] = nodes.bin // 600 * 600
    sizes = nodes.groupby("window").size()
    sizes = sizes[sizes >= 2]
    assert (got.n.sum(), got.windows.sum()) == (sizes.sum(), len(sizes))
    assert got.total.sum() == (near.bin // 600 * 600).isin(sizes.index).sum() > 0


def test_first_records_with_ties_at_the_border(spark):
    """A log whose lines share one second: number and content of the lines decide, equal lines fill up."""
    rows = [("AIS", 1, datetime(2024, 1, 1, 0, 0, i // 50), 7 if i % 3 else None, i % 20) for i in range(200)]
    df = spark.createDataFrame(rows, "class string, type int, log_time timestamp, seq long, mmsi long").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[2], r[3] or 0))
    for n in (0, 1, 49, 50, 63, 120, 199, 200, 500):
        got = [tuple(r) for r in L.first_records(df, n).collect()]
        assert len(got) == min(n, 200)
        assert sorted((r[2], r[3] or 0) for r in got) == [(r[2], r[3] or 0) for r in ordered[:n]]
        again = [tuple(r) for r in L.first_records(df.repartition(3), n).collect()]
        assert sorted(map(str, again)) == sorted(map(str, got))


def _spread(points, k, rounds=20):
    """Farthest-point seeds, then Lloyd rounds, on rows already standardised."""
    gap = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(a, b)), 9)
    seeds = [[0.0] * len(points[0][1])]
    for turn in range(k):
        best = max(points, key=lambda p: (min(gap(p[1], s) for s in seeds), -p[0]))[1]
        seeds = [best] if not turn else [*seeds, best]
    for _ in range(rounds):
        own = [min(range(k), key=lambda c: (gap(p, seeds[c]), c)) for _, p in points]
        moved = [[round(float(np.mean([p[j] for (_, p), o in zip(points, own) if o == c])), 9) for j in range(len(points[0][1]))] if c in own else seeds[c] for c in range(k)]
        if moved == seeds:
            break
        seeds = moved
    return {i: min(range(k), key=lambda c: (gap(p, seeds[c]), c)) for i, p in points}


def test_clusters_need_no_luck(spark):
    rng = np.random.default_rng(3)
    centres = [(0, 0, 0), (9, 0, 1), (0, 9, 2), (9, 9, 3)]
    rows = [(i, *(float(x) for x in rng.normal(centres[i % 4], 0.8)), 5.0) for i in range(80)] + [(100 + i, 1.0, 1.0, 1.0, 5.0) for i in range(5)]
    df = spark.createDataFrame([*rows, (500, None, 1.0, 1.0, 5.0), (501, float("nan"), 1.0, 1.0, 5.0)], "sample_id long, a double, b double, c double, flat double")
    found, silhouette = FA.cluster_cases(df, ["a", "b", "c", "flat"], k=4)
    x = np.array([r[1:4] for r in rows])
    z = np.round((x - x.mean(axis=0)) / x.std(axis=0, ddof=1), 9)
    want = _spread([(r[0], [*map(float, v), 0.0]) for r, v in zip(rows, z)], 4)
    assert {r.sample_id: r.cluster for r in found.collect()} == want
    d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    own, scores = np.array([want[r[0]] for r in rows]), []
    for i in range(len(rows)):
        a = d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = min(d[i, own == c].mean() for c in set(own) - {own[i]})
        scores.append((b - a) / max(a, b))
    assert silhouette == pytest.approx(np.mean(scores), abs=1e-6) and silhouette > 0.5
    again, _ = FA.cluster_cases(df.repartition(7), ["a", "b", "c", "flat"], k=4)
    assert {r.sample_id: r.cluster for r in again.collect()} == want
    few, apart = FA.cluster_cases(df.filter("sample_id >= 100 and sample_id < 500"), ["a", "b"], k=3)
    assert {r.cluster for r in few.collect()} == {0} and apart == 0.0
