import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.operators import models as MD
from photonloom.operators.raster.filters import median_filter, running_median


def sorted_medians(img, size):
    h = size // 2
    p = np.pad(img, ((h, size - h - 1), (h, size - h - 1)), mode="edge")
    return np.array([[np.sort(p[y:y + size, x:x + size].ravel())[size * size // 2] for x in range(img.shape[1])] for y in range(img.shape[0])])


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17])
@pytest.mark.parametrize("kind", ["continuous", "ties", "constant"])
def test_running_median_agrees_with_sorting_every_window(size, kind):
    rng = np.random.default_rng(size)
    img = {"continuous": rng.normal(size=(23, 23)), "ties": rng.integers(0, 4, (23, 23)).astype(float), "constant": np.full((23, 23), 2.0)}[kind]
    assert np.array_equal(running_median(img, size), sorted_medians(img, size))


def test_median_filter_of_an_image_with_missing_pixels(spark):
    rng = np.random.default_rng(3)
    img = rng.normal(size=(6, 6))
    rows = [(7, "g", y, x, None if (y, x) == (2, 2) else float(img[y, x])) for y in range(6) for x in range(6) if (y, x) != (4, 4)]
    got = {(r["y"], r["x"]): r["smooth"] for r in median_filter(spark.createDataFrame(rows, "obj_id long, band string, y int, x int, flux double"), 6, 3).collect()}
    img[2, 2] = img[4, 4] = 0.0
    want = sorted_medians(img, 3)
    assert len(got) == 35 and all(got[k] == want[k] for k in got)


def vectors(spark, x, scalar, parts):
    rows = [(i, [float(v) for v in r], float(s)) for i, (r, s) in enumerate(zip(x, scalar))]
    return spark.createDataFrame(rows, "id long, v array<double>, s double").repartition(parts, "id")


def test_moments_over_several_blocks_and_tasks_are_those_of_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 300)) @ rng.normal(size=(300, 300)) + 1e6  # far from zero: plain sums of squares would cancel
    s = x[:, 0] - x[:, 299]
    n, mean, comoment = MD.vector_moments(vectors(spark, x, s, 7), ["v", "s"], 301)
    full = np.column_stack([x, s])
    assert n == 90 and np.allclose(mean, full.mean(axis=0), rtol=1e-12)
    assert np.allclose(comoment, np.cov(full.T, bias=True) * 90, rtol=1e-6, atol=1e-4)


def test_scores_are_uncorrelated_explain_most_and_carry_the_scalar(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 12)) + 0.1 * rng.normal(size=(200, 12)) + 5
    x[:, 4] = 3.0  # without spread
    s = rng.normal(size=200) * 7 + 2
    m = MD.VectorScores(3).fit(vectors(spark, x, s, 5), "v", 12, "s")
    got = np.array([r["scores"] for r in m.transform(vectors(spark, x, s, 3)).orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    u, d, vt = np.linalg.svd(z, full_matrices=False)
    signs = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])
    assert np.allclose(got[:, :3], u[:, :3] * signs * np.sqrt(200), atol=1e-8)
    assert np.allclose(got[:, 3], (s - s.mean()) / s.std())
    assert np.allclose(np.cov(got[:, :3].T, bias=True), np.eye(3), atol=1e-9)
    assert np.allclose(m.explained, (d ** 2 / (d ** 2).sum())[:3]) and m.explained.sum() > 0.95


def test_incomplete_rows_get_no_scores_and_do_not_enter_the_fit(spark):
    good = [(i, [float(i % 3), float(i % 5)], float(i)) for i in range(15)]
    bad = [(20, None, 1.0), (21, [1.0, None], 1.0), (22, [1.0], 1.0), (23, [1.0, float("nan")], 1.0), (24, [1.0, 2.0], None), (25, [1.0, float("inf")], 1.0), (26, [], 1.0)]
    schema = "id long, v array<double>, s double"
    m, both = MD.VectorScores(2).fit(spark.createDataFrame(good, schema), "v", 2, "s"), spark.createDataFrame(good + bad, schema)
    again = MD.VectorScores(2).fit(both, "v", 2, "s")
    assert again.n == 15 and np.allclose(again.mean, m.mean) and np.allclose(again.variance, m.variance)
    rows = m.transform(both.withColumn("extra", F.lit(1))).collect()
    assert sorted(r["id"] for r in rows if r["scores"] is None) == list(range(20, 27)) and rows[0]["extra"] == 1
    with pytest.raises(ValueError, match="no complete row"):
        MD.VectorScores(1).fit(spark.createDataFrame([], schema), "v", 2)
