import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from photonloom.operators.raster import filters as FI
from photonloom.operators.raster import morphology as MO
from photonloom.operators.raster import pixels as PX
from photonloom.operators.raster import profile as PR
from photonloom.operators.raster import segment as SE
from photonloom.operators.raster import sky as SK


def table(spark, img, obj=1, band="r"):
    y, x = np.indices(img.shape)
    pdf = pd.DataFrame({"obj_id": obj, "band": band, "y": y.ravel(), "x": x.ravel(), "flux": img.ravel().astype(float)})
    return spark.createDataFrame(pdf, "obj_id long, band string, y int, x int, flux double")


def grid(rows, side, col):
    out = np.full((side, side), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r[col]
    return out


def disc(side, h):
    y, x = np.indices((side, side))
    return np.exp(-np.hypot(y - (side - 1) / 2, x - (side - 1) / 2) / h)


def flood(mask, eight):
    lab, todo = np.zeros(mask.shape, int), []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (eight or a == 0 or b == 0)]
    for p in zip(*np.nonzero(mask)):
        if lab[p]:
            continue
        lab[p] = p[0] * mask.shape[1] + p[1] + 1
        todo.append(p)
        while todo:
            y, x = todo.pop()
            for a, b in steps:
                q = (y + a, x + b)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not lab[q]:
                    lab[q] = lab[p]
                    todo.append(q)
    return lab


@pytest.mark.parametrize("eight", [False, True])
def test_labels_against_flood_fill(eight):
    for seed in range(6):
        m = np.random.default_rng(seed).random((23, 23)) < 0.3 + 0.08 * seed
        assert (SE.min_labels(m, eight) == flood(m, eight)).all()


def test_exponential_disc_radii_and_concentration(spark):
    """Closed form: half of the light within 1.678 scale lengths, 90 % within 3.890, concentration near 2.7."""
    side, h = 121, 6.0
    img = disc(side, h)
    px = table(spark, img, band="g").union(table(spark, img)).union(table(spark, img, band="z"))
    r = PR.petrosian_photometry(px, side, 1.0).first()
    assert r["petro_converges"] and not r["aperture_truncated"]
    assert r["R50"] == pytest.approx(1.678 * h, rel=0.03) and r["R90"] == pytest.approx(3.890 * h, rel=0.06)
    assert r["rp_px"] == pytest.approx(2.16 * r["R50"], rel=0.05) and r["concentration"] == pytest.approx(2.7, abs=0.15)
    assert r["ratio_R50_g_r"] == pytest.approx(1)


def test_sky_is_recovered_under_outliers(spark):
    img = np.random.default_rng(0).normal(0.05, 0.004, (60, 60))
    img[:2, :2] = 5.0
    img[58:, 58:] = 0.0
    r = SK.corner_sky(table(spark, img), 60, 30.0).first()
    assert r["sky"] == pytest.approx(0.05, abs=5e-4) and r["sky_sigma"] == pytest.approx(0.004, rel=0.08)
    few = SK.corner_sky(table(spark, img), 60, 41.5).first()
    assert few["sky"] == 0.0 and few["sky_sigma"] is None


def test_filters_against_numpy(spark):
    img = np.random.default_rng(1).normal(size=(15, 15))
    px = table(spark, img)
    k = np.array(FI.gaussian_kernel(0.8))
    pad = np.pad(img, len(k) // 2, mode="symmetric")
    rows = np.array([np.convolve(r, k, mode="valid") for r in pad])
    want = np.array([np.convolve(c, k, mode="valid") for c in rows.T]).T
    assert grid(FI.gaussian(px, 15, 0.8).collect(), 15, "smooth") == pytest.approx(want)
    near = np.pad(img, 1, mode="edge")
    med = np.array([[np.median(near[y:y + 3, x:x + 3]) for x in range(15)] for y in range(15)])
    assert grid(FI.median_filter(px, 15, 3).collect(), 15, "smooth") == pytest.approx(med)


def test_gini_limits_and_shape(spark):
    flat = table(spark, np.ones((9, 9)), 1)
    point = np.zeros((9, 9))
    point[4, 4] = 1.0
    px = flat.union(table(spark, point, 2)).withColumn("seg", F.lit(True))
    g = {r["obj_id"]: r["gini"] for r in MO.gini(px).collect()}
    assert g[1] == pytest.approx(0) and g[2] == pytest.approx(1)
    y, x = np.indices((41, 41))
    e = np.exp(-(((x - 20) / 8.0) ** 2 + ((y - 20) / 4.0) ** 2) / 2)
    s = MO.shape(table(spark, e).withColumn("seg", F.lit(True))).first()
    assert s["axis_ratio"] == pytest.approx(0.5, abs=0.03) and s["angle"] == pytest.approx(0, abs=1e-6)


def test_symmetric_image_has_no_asymmetry(spark):
    size = spark.createDataFrame([(1, 6.0, 0.0)], "obj_id long, rp_px double, sky_sigma double")
    r = MO.asymmetry(table(spark, disc(31, 3.0)), size, 31).first()
    assert r["asymmetry"] == pytest.approx(0, abs=1e-9) and (r["centre_dx"], r["centre_dy"]) == (0, 0)


def test_views_fill_and_masks(spark):
    img = np.random.default_rng(2).random((8, 8))
    px = table(spark, img)
    views = PX.square_symmetries(px, 8).collect()
    seen = {k: grid([r for r in views if r["view"] == k], 8, "flux") for k in range(8)}
    assert len({v.tobytes() for v in seen.values()}) == 8
    assert any((v == np.rot90(img)).all() for v in seen.values()) and any((v == img[:, ::-1]).all() for v in seen.values())
    d = px.withColumn("m", F.expr("(y = 0 AND x = 0) OR (y = 1 AND x = 1) OR (y = 6 AND x = 6)"))
    out = grid(PX.symmetric_fill(d, 8, "m").collect(), 8, "flux")
    assert out[0, 0] == img[7, 7] and out[1, 1] == 0 and out[6, 6] == 0
    ring = np.zeros((9, 9))
    ring[2:7, 2:7] = 1
    ring[4, 4] = 0
    m = SE.fill_holes(table(spark, ring).withColumn("m", F.col("flux") > 0), 9, "m")
    assert m.where("m").count() == 25
    assert SE.dilate(m, 9, "m", 1).where("m").count() == 45


def test_object_mask_and_neighbour(spark):
    y, x = np.indices((40, 40))
    img = np.random.default_rng(3).normal(0, 0.01, (40, 40)) + disc(40, 3.0) + np.exp(-((y - 6) ** 2 + (x - 32) ** 2) / 4.0)
    m = SE.threshold_segmentation(table(spark, img), 40, 5.0, 10)
    assert m.where("in_mask AND y = 20 AND x = 20").count() == 1 and m.where("in_mask AND y = 6 AND x = 32").count() == 0
    n = SE.neighbour_sources(table(spark, img), 40)
    assert n.where("y = 6 AND x = 32").count() == 1 and n.where("y = 20 AND x = 20").count() == 0


def test_stamp_keeps_cells_outside_the_image(spark):
    px = table(spark, np.ones((20, 20)))
    geo = spark.createDataFrame([(1, 20.0, 0.0)], "obj_id long, rp_px double, pa_rad double")
    got = {(r["v"], r["u"]): r["flux"] for r in PX.stamp(px, geo, 20, 16, 1.5).collect()}
    assert len(got) == 256 and got[0, 0] == 0 and got[8, 8] > 0


def test_spline_weights_meet_the_boxes():
    w = np.array(SK.spline_weights(20, 5))
    assert w.sum(1) == pytest.approx(np.ones(20))
    assert w[[2, 7, 12, 17]] == pytest.approx(np.eye(4), abs=1e-12)  # a pixel at a box's centre has its level
    assert w[::-1, ::-1] == pytest.approx(w)
    assert np.array(SK.spline_weights(7, 7)) == pytest.approx(np.ones((7, 1)))


def test_dropped_boxes_are_filled(spark):
    img = np.add.outer(np.arange(20.0) // 5, 10 * (np.arange(20.0) // 5))
    px = table(spark, img).withColumn("bad", (F.col("y") < 5) & (F.col("x") < 5))
    got = {(r["by"], r["bx"]): r["level"] for r in SK.box_background(px, 20, 5, F.col("bad")).collect()}
    assert len(got) == 16 and all(v is not None for v in got.values())
    d = {(i, j): np.hypot(i, j) for i in range(4) for j in range(4) if i or j}
    near = sorted(d, key=lambda k: (d[k], k))[:10]
    mesh = {k: k[0] + 10 * k[1] for k in d} | {(0, 0): sum((k[0] + 10 * k[1]) / d[k] for k in near) / sum(1 / d[k] for k in near)}
    for (i, j), v in got.items():
        assert v == pytest.approx(np.median([mesh[a, b] for a in range(max(0, i - 1), min(4, i + 2)) for b in range(max(0, j - 1), min(4, j + 2))]))
    whole = SK.smooth_background(px, SK.box_background(px, 20, 5, F.col("bad")), 5, 20)
    assert whole.where("background IS NULL").count() == 0


def test_nearest_source_stands_above_the_background_and_leaves_others(spark):
    rng = np.random.default_rng(5)
    y, x = np.indices((40, 40))
    blob = lambda cy, cx, s: np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s))
    img = 0.3 + rng.normal(0, 0.05, (40, 40)) + 3 * blob(18, 21, 3.0) + 4 * blob(33, 6, 2.0)  # all of it above 1.5 times the noise
    d = {(r["y"], r["x"]): r for r in SE.nearest_source_mask(table(spark, img).withColumn("noise", F.lit(0.05)), 40, F.col("noise"), 1.5, 1.5).collect()}
    assert d[18, 21]["in_object"] and not d[18, 21]["in_other"]
    assert d[33, 6]["in_other"] and not d[33, 6]["in_object"]
    assert sum(r["in_object"] for r in d.values()) < 400 and sum(r["in_other"] for r in d.values()) < 300
