import pytest

import __spark_entry__ as entry
import check_parity

SF = "/root/testdata/sf0.001"
SAMPLE = ["a01_regression_metrics", "a08_binned_metrics", "a16_crosstab_with_margins", "a26_spearman", "a33_paired_bootstrap", "e03_convex_weights", "e12_sealed_selection", "f04_distances",
          "j04_closest_observation", "j09_member_alignment", "p05_exclusion_reasons", "r02_corner_sky", "r08_connected_components", "r19_petrosian_photometry", "s03_prediction_folder",
          "s14_run_table", "v11_content_fingerprint", "w05_stratified_split", "x01_stream_of_chunks"]


@pytest.fixture(scope="module")
def con():
    return check_parity.duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    msg, _, _ = check_parity.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert msg.startswith("ok"), msg


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
