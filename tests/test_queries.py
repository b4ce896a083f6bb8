"""A few registered queries against DuckDB at the smallest scale; ``check.py`` does all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "w4_reveal_drought", "w28_prepare_cues", "j5_composite_rank", "f18_classify_beats", "s8_links", "j2_tag_search", "j5b_auto_search", "j6_overlap_lines", "j12_narration_mentions",
    "j15_cascading_candidates", "j16_best_file", "j20_lists_all_probes", "a9_degree_estimates", "r1_asset_memory_stream", "s2_subtitle_corpus", "s3_subtitle_events", "s10_loaded_twice",
    "w29_enrich_cues", "w30_plan_sounds", "w42_plan_transitions", "w43_choose_cuts_and_moves", "e2_storyboard_audit"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), [d[0] for d in cur.description])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 15
