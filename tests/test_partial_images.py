"""Images that lack pixels: the last image of a table may have fewer tiles than a whole one."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_parity import compare

NAMES = ["r21_asymmetry", "s06_pixel_cache", "r23_gini_segmentation", "r27_structure_scalars", "r40_box_background", "r40_smooth_background", "r47_map_correlation",
         "r06_image_metrics", "r12_gaussian_smoothing", "r13_box_mean", "r13_running_median", "r14_neighbour_sources", "r18_symmetric_fill", "r22_smoothness"]


@pytest.fixture(scope="module")
def partial(tmp_path_factory):
    """One whole image and two that end after 6 and after 19 of 25 tiles."""
    at = tmp_path_factory.mktemp("partial")
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE vec_id < 31 OR vec_id BETWEEN 50 AND 68) TO '{at}/embeddings.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", NAMES)
def test_partial_images(spark, partial, name):
    at, con = partial
    result, *_ = compare(spark, con, at, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_gaps_of_a_cube_are_refused_unless_the_layout_allows_them(spark):
    from photonloom.sources import pixel_cache as PC

    cube = spark.createDataFrame([(1, [1.0] * 15 + [None]), (2, [1.0] * 15 + [float("nan")])], "obj_id long, g array<double>")
    why = lambda gaps: [r[0] for r in cube.orderBy("obj_id").select(PC.reading_fault(PC.CubeLayout(4, 4, ("g",), gaps=gaps))).collect()]
    assert why(False) == ["values of g not finite"] * 2 and why(True) == [None, "values of g not finite"]


def test_half_way_means_are_rounded_alike(spark):
    """on sf0.1 three means lay exactly between two results of six decimals."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    name = "r05_band_collapses"
    assert compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql()[name])[0].startswith("ok")
