from pathlib import Path

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from check import compare, database

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables are not here")


@pytest.mark.parametrize("name", ["op4_line_dedup", "op6_warc_dictionary", "op10_quality_rules", "op11_curriculum_mix", "op12_filter_audit", "op13_collocations"])
def test_query_matches_sql(spark, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    assert compare(got, database(SF).execute(entry_points.oracle_sql()[name]).df()) is None


def test_all_operators_are_registered():
    names = entry_points.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


def test_pipeline_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2]
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in coded} == seen[-1] and all(r.n_tokens == len(r.ids) for r in coded)
    assert docs.filter("n_chars <> length(text)").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == seen[-1]
