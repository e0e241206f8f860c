"""Non-parametric morphology on one band."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.functions.scalars import safe_div
from photonloom.operators.raster.filters import box_mean, gaussian, gaussian_kernel, median_filter, own_gaussian, smooth
from photonloom.operators.raster.pixels import KEYS, rotate180, with_radius
from photonloom.operators.raster.segment import components, with_flag
from photonloom.session import cut_lineage

# Extent and box of the smoothness, smoothing of the Gini mask, half-pixel search of the asymmetry centre.
CAS_EXTENT, CAS_BOX, GINI_SMOOTH, CENTRE_SEARCH = 1.5, 0.25, 0.2, 3


def asymmetry(px: DataFrame, size: DataFrame, side: int, search: int = CENTRE_SEARCH) -> DataFrame:
    """Asymmetry under 180 degree rotation, minimized over half-pixel centres, with the analytic noise term removed.
    `size` has obj_id, rp_px and sky_sigma.

    An image is one array, and each batch of images is turned about all centres at once: a centre shifted by half a pixel
    shifts the turned image by one, around the border. No pixel is copied and nothing is joined. Only pixels whose partner the image
    has as well are compared.
    """
    c = (side - 1) / 2
    images = px.groupBy(*KEYS).agg(F.collect_list(F.struct("y", "x", "flux")).alias("image"))
    images = images.join(size.where("rp_px IS NOT NULL").select("obj_id", F.least(CAS_EXTENT * F.col("rp_px"), F.lit(c - 3)).alias("r_ap"), F.col("sky_sigma").cast("double").alias("sky_sigma")), "obj_id")

    def turn(batches):
        yy, xx = np.mgrid[0:side, 0:side]
        for b in batches:
            if not b.num_rows:
                continue
            img = np.full((b.num_rows, side, side), np.nan)
            y, x, flux = (c.to_numpy(zero_copy_only=False) for c in b.column(2).flatten().flatten())
            img[np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy()), y, x] = flux
            r_ap = np.asarray(b.column(3), float)
            best = [None] * len(img)
            for sy in range(-search, search + 1):
                for sx in range(-search, search + 1):
                    inside = np.sqrt((yy - (c + sy / 2)) ** 2 + (xx - (c + sx / 2)) ** 2)[None] < r_ap[:, None, None]
                    other = np.roll(img[:, ::-1, ::-1], (sy, sx), axis=(1, 2))
                    inside = inside & ~np.isnan(img) & ~np.isnan(other)
                    num = np.where(inside, np.abs(img - other), 0).sum((1, 2))
                    den = np.where(inside, np.abs(img), 0).sum((1, 2))
                    area = inside.sum((1, 2))
                    for i in np.flatnonzero(den > 0):
                        found = (round(float(num[i] / den[i]), 12), sy, sx, float(den[i]), int(area[i]))
                        best[i] = found if best[i] is None else min(best[i], found)
            at = pa.array([i for i, f in enumerate(best) if f is not None], pa.int64())
            cells = list(zip(*(f for f in best if f is not None))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(4).take(at), *[pa.array(v, t) for v, t in zip(cells, (pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))]],
                                             names=["obj_id", "band", "sky_sigma", "raw", "sy", "sx", "den", "area"])

    kind = px.schema["obj_id"].dataType.simpleString()
    best = images.select("obj_id", "band", "image", "r_ap", "sky_sigma").mapInArrow(turn, f"obj_id {kind}, band string, sky_sigma double, raw double, sy int, sx int, den double, area bigint")
    noise = F.coalesce(F.col("area") * (2 * F.col("sky_sigma") / math.sqrt(math.pi)) / F.col("den"), F.lit(0.0))
    return best.select(*KEYS, (F.col("raw") - noise).alias("asymmetry"), (F.col("sx") / 2).alias("centre_dx"), (F.col("sy") / 2).alias("centre_dy"))


def smoothness(px: DataFrame, size: DataFrame, side: int) -> DataFrame:
    """Positive residual over a box of a quarter Petrosian radius in the annulus 0.25-1.5, analytic noise term removed."""
    k = F.floor(CAS_BOX * F.col("rp_px")).cast("int")
    sizes = size.where("rp_px IS NOT NULL").withColumn("k", k).where("k >= 2")
    sm = box_mean(px, sizes, side, side // 2)
    d = with_radius(px, side).join(sm, [*KEYS, "y", "x"]).join(sizes, "obj_id")
    d = d.where((F.col("r") >= CAS_BOX * F.col("rp_px")) & (F.col("r") <= CAS_EXTENT * F.col("rp_px")))
    per_px = F.coalesce(F.col("sky_sigma") * F.sqrt(1 - 1 / (F.col("k") * F.col("k"))) / math.sqrt(2 * math.pi), F.lit(0.0))
    agg = d.groupBy(*KEYS).agg(F.sum(F.greatest(F.col("flux") - F.col("smooth"), F.lit(0.0))).alias("pos"), F.count("*").alias("n"), F.sum("flux").alias("total"), F.max(per_px).alias("noise"))
    return agg.select(*KEYS, F.when(F.col("total") > 0, (F.col("pos") - F.col("n") * F.col("noise")) / F.col("total")).alias("smoothness"))


def gini_segmentation(px: DataFrame, size: DataFrame, side: int) -> DataFrame:
    """Pixels whose smoothed flux reaches its mean in the Petrosian ring, 8-connected to the centre; where the centre is not
    among them, to the brightest smoothed pixel. Each object is smoothed with its own width; without a pixel in the ring
    nothing is segmented."""
    sizes = size.where("rp_px IS NOT NULL").select("obj_id", "rp_px")
    sm = own_gaussian(px, sizes.select("obj_id", (GINI_SMOOTH * F.col("rp_px")).alias("sigma")), side)
    d = with_radius(sm, side).join(sizes, "obj_id")
    level = F.avg(F.when(F.abs(F.col("r") - F.col("rp_px")) < 0.5, F.col("smooth"))).over(W.partitionBy(*KEYS))
    d = cut_lineage(d.withColumn("_b", F.coalesce(F.col("smooth") >= level, F.lit(False))))
    c = side // 2
    lab = components(d, side, "_b", eight=True).join(d.select(*KEYS, "y", "x", "smooth"), [*KEYS, "y", "x"])
    first = F.struct((F.col("y") == c) & (F.col("x") == c), "smooth", -F.col("y"), -F.col("x"))  # of equal pixels the first in reading order
    return with_flag(px, lab.withColumn("_t", F.max_by("label", first).over(W.partitionBy(*KEYS))).where("label = _t"), "seg")


def gini(px: DataFrame, seg: str = "seg") -> DataFrame:
    """Rank-weighted sum of |flux| inside the segmentation."""
    d = px.where(F.col(seg)).withColumn("_a", F.abs("flux"))
    w = W.partitionBy(*KEYS)
    d = d.withColumns({"_i": F.row_number().over(w.orderBy("_a", "y", "x")), "_n": F.count("*").over(w)})
    g = d.groupBy(*KEYS).agg(F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col("_a")).alias("num"), F.max("_n").alias("n"), F.sum("_a").alias("s"))
    return g.select(*KEYS, F.when((F.col("n") > 1) & (F.col("s") > 0), F.col("num") / ((F.col("n") - 1) * F.col("s"))).alias("gini"))


def _moments(px: DataFrame, value: Column) -> DataFrame:
    """Flux-weighted centroid next to every pixel of its image."""
    w = W.partitionBy(*KEYS)
    d = px.withColumn("_I", value).withColumn("_tot", F.sum("_I").over(w))
    return d.withColumns({"_xc": F.sum(F.col("_I") * F.col("x")).over(w) / F.col("_tot"), "_yc": F.sum(F.col("_I") * F.col("y")).over(w) / F.col("_tot")})


def m20(px: DataFrame, seg: str = "seg") -> DataFrame:
    """Second moment of the brightest 20 % of the flux; the pixel that crosses the share is included."""
    d = _moments(px.where(F.col(seg)), F.col("flux")).where("_tot > 0")
    w = W.partitionBy(*KEYS).orderBy(F.col("_I").desc(), "y", "x")
    d2 = (F.col("x") - F.col("_xc")) * (F.col("x") - F.col("_xc")) + (F.col("y") - F.col("_yc")) * (F.col("y") - F.col("_yc"))
    d = d.withColumns({"_d2": d2, "_before": F.coalesce(F.sum("_I").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))})
    mo = F.col("_I") * F.col("_d2")
    g = d.groupBy(*KEYS).agg(F.sum(mo).alias("tot"), F.sum(F.when(F.col("_before") < 0.2 * F.col("_tot"), mo)).alias("top"))
    return g.select(*KEYS, F.when((F.col("top") > 0) & (F.col("tot") > 0), F.log10(F.col("top") / F.col("tot"))).alias("m20"))


def shape(px: DataFrame, seg: str = "seg") -> DataFrame:
    """Axis ratio and position angle from second moments of the positive flux (2 x 2 eigenvalues in closed form)."""
    d = _moments(px.where(F.col(seg) & (F.col("flux") > 0)), F.col("flux"))
    dx, dy, i = F.col("x") - F.col("_xc"), F.col("y") - F.col("_yc"), F.col("_I")
    g = d.groupBy(*KEYS).agg((F.sum(i * dx * dx) / F.sum(i)).alias("mxx"), (F.sum(i * dy * dy) / F.sum(i)).alias("myy"), (F.sum(i * dx * dy) / F.sum(i)).alias("mxy"))
    half, diff = (F.col("mxx") + F.col("myy")) / 2, (F.col("mxx") - F.col("myy")) / 2
    root = F.sqrt(diff * diff + F.col("mxy") * F.col("mxy"))
    l1, l2 = half + root, F.greatest(half - root, F.lit(0.0))
    return g.select(*KEYS, F.when(l1 > 0, F.sqrt(l2 / l1)).alias("axis_ratio"), (0.5 * F.atan2(2 * F.col("mxy"), F.col("mxx") - F.col("myy"))).alias("angle"))


def asymmetry_map(px: DataFrame, side: int, mask: str) -> DataFrame:
    return rotate180(px, side, "flux", "_m").withColumn("value", F.when(F.col(mask), F.abs(F.col("flux") - F.col("_m"))).otherwise(0.0)).drop("_m")


def clumpiness_map(px: DataFrame, side: int, mask: str, sigma: float = 2.0) -> DataFrame:
    d = px.join(gaussian(px, side, sigma), [*KEYS, "y", "x"])
    return d.withColumn("value", F.when(F.col(mask), F.greatest(F.col("flux") - F.col("smooth"), F.lit(0.0))).otherwise(0.0)).drop("smooth")


#: Structure maps by name.
MAPS = {"asymmetry": asymmetry_map, "clumpiness": clumpiness_map}


def structure_scalars(px: DataFrame, side: int, mask: str, maps=("asymmetry", "clumpiness")) -> DataFrame:
    """Map total over the masked flux, one column per map."""
    out = None
    for name in maps:
        d = MAPS[name](px, side, mask).groupBy(*KEYS).agg((F.sum("value") / F.greatest(F.sum(F.when(F.col(mask), F.col("flux")).otherwise(0.0)), F.lit(1e-8))).alias(name))
        out = d if out is None else out.join(d, KEYS)
    return out


def clumpiness(px: DataFrame, side: int, mask: str, core_px: float, sky_r: float, method: str = "median", size: int = 17, sigma: float = 8.0,
               min_region: int = 20, min_sky: int = 100) -> DataFrame:
    """Share of the object's light in small structures: positive residual over a median (or Gaussian) filter outside the
    core, with the residual of the sky per pixel subtracted."""
    sm = median_filter(px, side, size) if method == "median" else smooth(px, side, gaussian_kernel(sigma, 2.5), "nearest")
    d = with_radius(px, side).join(sm, [*KEYS, "y", "x"]).withColumn("_p", F.greatest(F.col("flux") - F.col("smooth"), F.lit(0.0)))
    region = F.col(mask) & (F.col("r") >= core_px)
    sky = (F.col("r") > sky_r) & ~F.col(mask) & (F.col("flux") != 0)
    corner = sky & (F.col("y") < side // 5) & (F.col("x") < side // 5)
    g = d.groupBy(*KEYS).agg(F.count_if(region).alias("n"), F.count_if(sky).alias("n_sky"), F.sum(F.when(region, F.col("_p"))).alias("p"),
                             F.sum(F.when(region, F.greatest("flux", F.lit(0.0)))).alias("total"), F.avg(F.when(sky, F.col("_p"))).alias("noise_all"),
                             F.count_if(corner).alias("n_corner"), F.avg(F.when(corner, F.col("_p"))).alias("noise_corner"))
    noise = F.when(F.col("n_corner") >= min_sky, F.col("noise_corner")).otherwise(F.col("noise_all"))
    ok = (F.col("n") >= min_region) & (F.col("n_sky") >= min_sky) & (F.col("total") > 0)
    return g.select(*KEYS, F.when(ok, (F.col("p") - F.col("n") * noise) / F.col("total")).alias("clumpiness"))
