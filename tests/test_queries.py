"""Every registered query of the reports against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from burstlake.plans import queries, review  # noqa: F401  registers its queries, too

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = db.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want


#: Queries that SQL does not express: their values are tested on small tables, by the test that is named.
TESTED_APART = {
    "a34_sketches": "test_sketches_are_near_exact_counts", "e3_moments": "test_one_pass_equals_a_plain_scan_however_it_is_split",
    "a23_accumulate": "test_misspellings_are_folded_where_they_are_rare", "a26_consensus": "test_consensus_of_a_group", "g13_choice": "test_choices_are_learned", "g14_bootstrap": "test_bootstrap_interval", "g2_cluster_by_look": "test_plates_decide_clusters",
    "g24_fuzzy": "test_fuzzy_matches", "g25_merge_sweep": "test_merge_sweep", "g3_merge_on_plates": "test_plates_join_groups_as_they_grow", "g4_signatures": "test_signature_clusters", "g5_cluster_faces": "test_large_cameras_and_albums_are_scanned_in_batches", "g6_consolidate": "test_consolidated_album",
    "t1_settled": "test_files_are_offered_once_settled", "t4_live_sessions": "test_live_sessions", "w20_rate": "test_sliding_rate", "w4_merge_bursts": "test_bursts_of_one_subject_are_joined", "w5_split_moments": "test_moments_equal_a_plain_scan", "w8_sets": "test_sets_keep_aperture_and_shutter",
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_run_whole_and_are_tested_apart(spark, name):
    here = os.path.dirname(os.path.abspath(__file__))
    assert any(f"def {TESTED_APART[name]}(" in open(f).read() for f in glob.glob(f"{here}/test_*.py"))
    df = queries.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
