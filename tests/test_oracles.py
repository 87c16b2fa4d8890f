"""Registered queries against their SQL in DuckDB, on the smallest supplied tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from check import compare, database

SF = "/root/testdata/sf0.001"
NAMES = ["flagship_segment_summary", "src1_read_ais_log", "src3_reject_counts", "src6_snk3_vessel_documents", "snk1_daily_parquet",
         "prj4_message_class", "flt9_drop_outliers", "flt10_plausibility", "flt12_duplicates", "trj1_segments", "trj5_resample_forward",
         "trj7_positions_at", "trj8_simplify", "win1_step_features", "win7_rolling_statistics", "win13_sequences", "jon2_merge_parts",
         "jon4_near_pairs", "col2_collision_features", "col6_graph_features", "col10_col11_encounters", "agg3_kinematic_statistics",
         "agg13_tail_outliers", "agg23_false_alerts", "evl3_planar_metrics", "evl8_classification", "bst1_bootstrap_percentile",
         "tst3_cliffs_delta", "tst5_corrections", "spl1_random_split", "spl4_time_series_folds", "spl6_combined_folds", "str3_stream_segments", "trj6_resample_linear",
         "mdl3_kalman_turn", "evl16_failure_clusters", "src2_receiver_first", "str4_stream_steps", "str6_stream_pairs"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables are not here")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    want = database(SF).execute(entry_points.oracle_sql()[name]).df()
    assert compare(got, want) is None


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
