"""Chunked computation must equal the plain windows, however small the chunks."""

import pytest
from pyspark.sql import functions as F

from wakeline.operators import clean as C
from wakeline.operators import features as FE
from wakeline.operators import models as M
from wakeline.operators import ordered as O
from wakeline.operators import quality as QU
from wakeline.operators import routes as R
from wakeline.operators import tracks as TR


def _flat(df):
    df = df.drop("prev", "next", "_chunk")
    keys = [c for c in ("event_id", "mmsi", "segment_id", "time", "sample_id", "step", "run", "query_id") if c in df.columns]
    cols = [F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    return df.select(*cols).orderBy(*keys).collect() if keys else df.select(*cols).collect()


def _wanted(fixes):
    return fixes.select("mmsi", F.expr("time + interval 100 seconds").alias("time"), F.col("event_id").alias("query_id"))


OPERATORS = {
    "implied": C.drop_implied_speeding,
    "jitter": lambda d: C.collapse_jitter(d, 900.0, 20.0),
    "smooth": C.smooth,
    "anomalies": C.rule_anomalies,
    "segments": TR.segment,
    "last": lambda d: TR.last_points(d, 7).withColumn("points", F.to_json("points")),
    "forward": lambda d: TR.resample_forward(d, min_rows=5),
    "linear": TR.resample_linear,
    "at": lambda d: TR.positions_at(d, _wanted(d)),
    "lengths": lambda d: TR.track_lengths(TR.with_segments(d)),
    "steps": lambda d: FE.step_features(TR.with_segments(d)),
    "motion": lambda d: FE.local_motion(TR.with_segments(d).drop("prev")),
    "plausible": lambda d: FE.plausibility(TR.with_segments(d).drop("prev")),
    "vessel": FE.vessel_statistics,
    "rolling": lambda d: FE.rolling_statistics(TR.with_segments(d).drop("prev")),
    "matrix": lambda d: FE.design_matrix(TR.with_segments(d).drop("prev"), horizons=(1, 3)),
    "kinematic": lambda d: FE.kinematic_features(TR.with_segments(d).drop("prev")),
    "spatial": lambda d: FE.spatial_context(TR.with_segments(d)),
    "sequences": lambda d: FE.sequences(d, 8, 3, stride=2).select("sample_id", F.to_json("input").alias("i"), F.to_json("target").alias("t")),
    "behaviour": lambda d: FE.behaviour_windows(FE.step_features(TR.with_segments(d))),
    "reckoning": lambda d: M.dead_reckoning(TR.with_segments(d).drop("prev"), 4),
    "temporal": QU.temporal,
    "arrivals": lambda d: QU.temporal(d.withColumn("event_id", F.col("event_id").bitwiseXOR(F.lit(5)))),
    "positions": lambda d: O.with_positions(d),
}


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(QU, "ARRIVALS", 50)


@pytest.mark.parametrize("name", ["steps", "positions", "segments", "spatial", "rolling"])
def test_rows_without_vessel_or_time_stay(spark, fleet, name):
    gaps = fleet.withColumns({"mmsi": F.when(F.col("event_id") % 11 != 3, F.col("mmsi")), "time": F.when(F.col("event_id") % 13 != 5, F.col("time"))})
    plain, split = (_flat(OPERATORS[name](d)) for d in (gaps, O.chunked(gaps, hours=0.4)))
    assert plain == split and len(plain) >= 0.5 * fleet.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_change_nothing(fleet, name):
    run = OPERATORS[name]
    assert _flat(run(O.chunked(fleet, hours=0.4))) == _flat(run(fleet))


def test_spread_hot_looks_at_the_largest_vessel(fleet):
    assert not O.is_chunked(O.spread_hot(fleet))
    assert O.is_chunked(O.spread_hot(fleet, limit=100))


def test_long_segments_simplify_like_short_ones(fleet):
    segments = TR.segment(fleet, max_gap_minutes=1e6)
    here = {r.event_id for r in R.simplify(segments, 0.004).collect()}
    split = {r.event_id for r in R.simplify(segments, 0.004, local_points=12).collect()}
    assert here == split and len(here) < segments.count()
