"""Neighbours by blocks against the pairs themselves, and that nothing kept or shuffled grows with the pairs."""

import math

import pytest
from pyspark.sql import functions as F

from wakeline.operators import blocks as B
from wakeline.operators import collision as CO
from wakeline.operators import proximity as P
from wakeline.operators import quantiles as Q
from wakeline.operators import tasks as TK

SCHEMA = "event_id long, mmsi long, time timestamp, lat double, lon double, sog double, cog double"


@pytest.fixture(scope="module")
def crowd(spark):
    """Two busy minutes: a port, its surroundings across the date line and one far row; some places and motions repeat."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        lat, lon = 60 + rng.normal(0, 0.12), 180 + rng.normal(0, 0.25)
        if i % 8 == 0 and i:
            lat, lon = rows[-1][3], rows[-1][4]
        lon = lon - 360 if lon >= 180 else lon
        rows.append((i, 1000 + i % 90, i % 2, lat, lon, None if i % 31 == 7 else float(rng.integers(0, 12)), float(rng.integers(0, 360))))
    rows += [(900, 1, 0, 10.0, 10.0, 5.0, 5.0), (901, 2, 0, None, 10.0, 5.0, 5.0), (902, None, 0, 60.0, 179.9, 5.0, 5.0), (None, 3, 0, 60.0, 179.9, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "event_id long, mmsi long, minute int, lat double, lon double, sog double, cog double")
    stamp = F.timestamp_micros(F.lit(1704067200000000) + F.col("minute") * 60_000_000)
    return df.withColumn("time", stamp).drop("minute").select(*P.STATE).localCheckpoint()


def brute(rows, nm, same=False):
    out = {}
    for a in rows:
        for b in rows:
            if None in (a.lat, b.lat, a.event_id, b.event_id) or a.time != b.time or a.event_id == b.event_id:
                continue
            if not same and (a.mmsi is None or b.mmsi is None or a.mmsi == b.mmsi):
                continue
            h = (math.sin(math.radians(b.lat - a.lat) / 2) ** 2
                 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2)
            d = 2 * 6371 * math.asin(math.sqrt(h)) / 1.852
            if d < nm:
                out[a.event_id, b.event_id] = d
    return out


@pytest.mark.parametrize("crowded", [7, 5000])
def test_summaries_are_those_of_all_pairs(crowd, crowded):
    want = brute(crowd.collect(), 10.0)
    got = P.near_summaries(crowd, pick="nearest", crowded=crowded).groupBy("event_id").agg(F.sum("n").alias("n")).collect()
    degree = {}
    for a, _ in want:
        degree[a] = degree.get(a, 0) + 1
    assert {r.event_id: r.n for r in got} == degree
    nearest = {r.event_id: r.other_event_id for r in P.nearest_neighbours(P.nearest_pairs(crowd, crowded=crowded)).collect()}
    pairs = {r.event_id: r.other_event_id for r in P.nearest_neighbours(P.near_pairs(crowd, crowded=crowded)).collect()}
    assert nearest == pairs


def test_near_pairs_across_the_date_line(crowd):
    for same in (False, True):
        got = {(r.event_id, r.other_event_id): r.distance_nm for r in P.near_pairs(crowd, same_vessel=same, crowded=20).collect()}
        assert got == pytest.approx(brute(crowd.collect(), 10.0, same))


def test_collision_features_are_those_of_all_pairs(crowd):
    pairs = CO.with_cpa(P.near_pairs(crowd.dropna(subset=["lat", "lon", "sog", "cog"])))
    want = {r.event_id: r for r in pairs.groupBy("event_id").agg(
        F.min("cpa_m").alias("c"), F.min(F.when(F.col("tcpa_s") > 0, F.col("tcpa_s"))).alias("t"), F.count("*").alias("n"),
        F.avg("distance_nm").alias("d"), F.avg("relative_knots").alias("v"),
        F.min_by("relative_knots", F.struct("cpa_m", "other_event_id")).alias("w")).collect()}
    got = {r.event_id: r for r in CO.collision_features(crowd).filter("num_nearby > 0").collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        w = want[k]
        assert (r.num_nearby, r.min_cpa, r.relative_speed) == (w.n, w.c, pytest.approx(w.w))
        assert r.min_tcpa == pytest.approx(math.inf if w.t is None else w.t)
    for r in CO.edge_features(crowd).collect():
        assert (r.degree, r.avg_distance, r.avg_relative_velocity) == (want[r.event_id].n, pytest.approx(want[r.event_id].d), pytest.approx(want[r.event_id].v))


def test_equal_neighbours_take_one_row(spark):
    """Hundreds of rows in one place: the least approach is 0 for all, and one row comes out of each."""
    df = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") + 1000).alias("mmsi"), F.timestamp_micros(F.lit(0)).alias("time"),
                                 F.lit(60.0).alias("lat"), F.lit(5.0).alias("lon"), F.lit(3.0).alias("sog"), (F.col("id") % 50).cast("double").alias("cog"))
    for pick in ("worst", "nearest"):
        got = P.near_summaries(df, pick=pick, crowded=90).collect()
        assert [r.n for r in got] == [299] * 300
        assert all(r.other_event_id == (1 if r.event_id == 0 else 0) for r in got)


@pytest.mark.parametrize("tile", [2048, 16])
def test_clustering_by_blocks(spark, crowd, monkeypatch, tile):
    import pyarrow as pa

    rows = [r for r in crowd.collect() if None not in (r.event_id, r.mmsi, r.lat) and r.time.minute == 0]
    near = brute(rows, 10.0)
    links = {}
    for a, b in near:
        links.setdefault(a, set()).add(b)
    want = sum(sum(len(links[b] & n) for b in n) / (len(n) * (len(n) - 1)) for n in links.values() if len(n) > 1)
    table = pa.table({"event_id": [r.event_id for r in rows], "mmsi": [r.mmsi for r in rows], "lat": [r.lat for r in rows],
                      "lon": [r.lon for r in rows], "_home": [True] * len(rows)})
    monkeypatch.setattr(B, "TILE", tile)
    assert B.triangles(table, 18.52, False) == (len(near), pytest.approx(want))


def test_graph_features_with_repeated_numbers(crowd):
    """Buckets whose row numbers repeat go by edge lists; others, by blocks; both as if alone."""
    whole = crowd.dropna(subset=["event_id"])
    minute = F.minute("time")
    once = {r.bucket: r for r in CO.graph_features(whole, 10.0).collect()}
    mixed = {r.bucket: r for r in CO.graph_features(whole.unionByName(whole.filter(minute == 1).limit(1)), 10.0).collect()}
    edges = {r.bucket: r for r in CO._edge_clustering(whole, 10.0, 60, False).collect()}
    first, second = sorted(once)
    assert mixed[first] == once[first] and mixed[second].n == once[second].n + 1
    for b, r in once.items():
        assert (r.avg_degree * r.n, r.clustering * r.n) == (pytest.approx(edges[b].ends), pytest.approx(edges[b].c))


@pytest.fixture
def written(monkeypatch):
    """(label, rows) of every table that is written on the way."""
    found = []
    for module in (P, CO, TK, Q):
        def noted(df, label, f=module.saved):
            out = f(df, label)
            found.append((label, out.count()))
            return out

        monkeypatch.setattr(module, "saved", noted)
    return found


def test_graph_dataset_writes_no_pairs(spark, written):
    df = spark.range(40 * 30).select(
        F.col("id").alias("event_id"), (F.col("id") % 40 + 1000).alias("mmsi"), F.timestamp_micros(F.expr("id div 40 * 60000000")).alias("time"),
        (60 + (F.col("id") % 40) * 0.001).alias("lat"), F.lit(5.0).alias("lon"), F.lit(3.0).alias("sog"), (F.col("id") % 50).cast("double").alias("cog"))
    out = TK.build_dataset("graph_network", df)
    assert out.agg(F.sum(F.element_at("input", 1)["degree"]).alias("d")).first().d == 40 * 39 * 30
    assert max(n for _, n in written) <= 40 * 30


def test_collision_dataset_writes_rows_not_windows(spark, written):
    df = spark.range(4 * 60).select(
        F.col("id").alias("event_id"), (F.col("id") % 4 + 1000).alias("mmsi"), F.timestamp_micros(F.expr("id div 4 * 60000000")).alias("time"),
        (60 + (F.col("id") % 4) * 0.001).alias("lat"), F.lit(5.0).alias("lon"), F.lit(3.0).alias("sog"), (F.col("id") % 50).cast("double").alias("cog"))
    out = TK.build_dataset("collision_avoidance", df)
    assert out.count() == 4 * 31 and {r.n for r in out.select(F.element_at("input", -1)["num_nearby"].alias("n")).collect()} == {3}
    assert "samples" not in {label for label, _ in written}


def test_percentiles_counted_in_two_passes(spark):
    import random

    rng = random.Random(5)
    values = [0.0, -0.0, 1.0, 2.0, 4.0, 2.0 - 2 ** -52, 2.0 + 2 ** -51, 1e-310, -1e-310, 1e300, -1e300, math.inf, 3.0, 3.0, 3.0, None]
    values += [rng.lognormvariate(0, 5) * rng.choice((-1, 1)) for _ in range(500)] + [rng.uniform(1, 1.01) for _ in range(500)]
    df = spark.createDataFrame([(i % 3 if i % 50 else None, v) for i, v in enumerate(values)], "k int, v double")
    wanted = {f"p{i}": i / 20 for i in range(20)}
    for keys in ([], ["k"]):
        one, two = (sorted(map(tuple, Q.percentiles(df, keys, "v", wanted, again=a).select(*keys, *wanted).collect())) for a in (False, True))
        assert len(one) == len(two) and all(x == pytest.approx(y) for x, y in zip(one, two))
    bins = [r.b for r in spark.createDataFrame([(v,) for v in sorted(x for x in values if x is not None)], "v double").coalesce(1).select(Q._octave_bin("v").alias("b")).collect()]
    assert bins == sorted(bins)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_compliance_with_lists_is_that_of_joins(crowd):
    did = crowd.select("event_id", (F.col("event_id") % 7).cast("double").alias("course_change"), F.when(F.col("event_id") % 3 > 0, 0.05).alias("speed_change"))
    plain = crowd.dropna(subset=["sog", "cog"])
    want = CO.check_compliance(CO.with_encounter(CO.with_cpa(P.near_pairs(plain))), did)
    lists = plain.join(did.groupBy("event_id").agg(F.collect_list(F.struct("course_change", "speed_change")).alias("done")), "event_id")
    pairs = P.near_pairs(lists, state=[*P.STATE, "done"])
    got = CO.check_compliance(CO.with_encounter(CO.with_cpa(pairs)))
    cols = ["event_id", "other_event_id", "compliant", "other_compliant", "overall_compliant"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    assert joins(got) == joins(pairs)


def test_stepwise_risk_with_lists_is_that_of_joins(spark, crowd):
    own = crowd.filter("event_id % 5 > 0").select(F.col("event_id").alias("sample_id"), "lat", "lon", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("step"))
    own = own.withColumns({"lat": F.col("lat") + F.col("step") * F.col("step") * 1e-3, "lon": F.col("lon") + F.col("sample_id") * F.col("step") * 1e-5})
    near = P.near_pairs(crowd).select(F.col("event_id").alias("sample_id"), F.col("other_event_id").alias("neighbour_id"))
    want = CO.stepwise_risk(own, near.join(own.withColumnRenamed("sample_id", "neighbour_id"), "neighbour_id"))
    rows = crowd.join(CO.motion_lists(own).withColumnRenamed("sample_id", "event_id"), "event_id")
    pairs = P.near_pairs(rows, state=("event_id", "mmsi", "time", "lat", "lon", "steps"))
    got = CO.stepwise_risk(None, None, pairs=pairs.select(F.col("event_id").alias("sample_id"), "steps", "other_steps"))
    both = [{r.sample_id: r.risk for r in x.collect()} for x in (got, want)]
    assert len(both[0]) > 50 and both[0] == pytest.approx(both[1])
    assert joins(got) == joins(pairs)
    # one part of the pairs by joins, the other by lists
    half = F.col("event_id") % 2 == 0
    part = near.filter(F.col("sample_id") % 2 == 1).join(own.withColumnRenamed("sample_id", "neighbour_id"), "neighbour_id")
    mixed = CO.stepwise_risk(own, part, pairs=pairs.filter(half).select(F.col("event_id").alias("sample_id"), "steps", "other_steps"))
    assert {r.sample_id: r.risk for r in mixed.collect()} == pytest.approx(both[1])


def test_forecast_pairs_are_not_joined(spark, tmp_path, monkeypatch):
    from wakeline.plans import proximity_queries as PQ

    spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_micros(1704067200000000 + F.col("id") * 60_000_000).alias("ts"), (F.col("id") % 4).alias("user_id"),
                            F.lit("click").alias("event_type"), F.lit(50.0).alias("value"), F.format_string('{"k": %d}', F.col("id") % 90).alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    found = []
    monkeypatch.setattr(P, "near_pairs", lambda *a, f=P.near_pairs, **k: found.append(f(*a, **k)) or found[-1])
    both = PQ._first_step(spark, str(tmp_path))
    assert joins(both) == joins(found[0])
