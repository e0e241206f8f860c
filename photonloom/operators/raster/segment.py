"""Masks: thresholds, connected components, holes, dilation, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.functions.scalars import equivalent_radius, flux_limit, safe_div
from photonloom.operators.raster.filters import gaussian
from photonloom.operators.raster.pixels import KEYS, with_radius
from photonloom.operators.raster.profile import isophotal_radius
from photonloom.operators.raster.sky import border_background, clipped


def min_labels(mask: np.ndarray, eight: bool) -> np.ndarray:
    """Label of a pixel = smallest pixel index of its component (1-based, 0 outside), by neighbour minima and label jumping."""
    n, m = mask.shape
    far = n * m + 1
    lab = np.where(mask, np.arange(1, n * m + 1).reshape(n, m), far)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    while True:
        pad = np.pad(lab, 1, constant_values=far)
        new = lab
        for dy, dx in steps:
            for s in (1, -1):
                new = np.minimum(new, pad[1 + s * dy:1 + s * dy + n, 1 + s * dx:1 + s * dx + m])
        new = np.where(mask, new, far)
        root = np.append(new.ravel(), far)
        new = np.where(mask, root[np.minimum(new, far) - 1], far)
        if (new == lab).all():
            return np.where(mask, lab, 0)
        lab = new


def components(px: DataFrame, side: int, flag: str, eight: bool = False) -> DataFrame:
    """(obj_id, band, y, x, label) of the flagged pixels.

    Components need a fixpoint that no single plan can express. An image never exceeds side x side pixels, so the image is the
    unit: pixels are already laid out by obj_id, each image is labelled by one vectorized task group, and there is no iteration
    over the cluster, no join and no extra shuffle.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((side, side), bool)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        mask[y, x] = True
        return pdf.assign(label=min_labels(mask, eight)[y, x])

    return px.where(F.col(flag)).select(*KEYS, "y", "x").groupBy(*KEYS).applyInPandas(run, "obj_id long, band string, y int, x int, label int")


def central_component(labels: DataFrame, side: int, rule: str = "nearest", cy: int | None = None, cx: int | None = None) -> DataFrame:
    """Pixels of the component at the centre; if the centre is background, the nearest one ('nearest') or the largest."""
    cy, cx = (side // 2 if cy is None else cy), (side // 2 if cx is None else cx)
    d2 = (F.col("y") - cy) * (F.col("y") - cy) + (F.col("x") - cx) * (F.col("x") - cx)
    image = W.partitionBy(*KEYS)
    size = F.count("*").over(W.partitionBy(*KEYS, "label"))
    order = F.struct((d2 > 0).alias("a"), (-F.col("_n")).alias("b"), "label") if rule == "largest" else F.struct(d2.alias("a"), F.col("y"), F.col("x"))
    d = labels.withColumn("_n", size)
    return d.withColumn("_t", F.min_by("label", order).over(image)).where("label = _t").drop("_t", "_n")


def with_flag(px: DataFrame, selected: DataFrame, name: str) -> DataFrame:
    """Mark the pixels listed in `selected` (a subset of the same images)."""
    return (px.join(selected.select(*KEYS, "y", "x").withColumn("_f", F.lit(True)), [*KEYS, "y", "x"], "left")
            .withColumn(name, F.coalesce("_f", F.lit(False))).drop("_f"))


def fill_holes(px: DataFrame, side: int, flag: str) -> DataFrame:
    """Background components that do not touch the border join the mask."""
    outside = components(px.withColumn("_o", ~F.col(flag)), side, "_o")
    edge = F.col("y").isin(0, side - 1) | F.col("x").isin(0, side - 1)
    touches = F.max(edge).over(W.partitionBy(*KEYS, "label"))
    holes = outside.withColumn("_t", touches).where("NOT _t")
    return with_flag(px, holes, "_h").withColumn(flag, F.col(flag) | F.col("_h")).drop("_h")


def dilate(px: DataFrame, side: int, flag: str, k: int) -> DataFrame:
    """K steps of the cross-shaped element reach |dy| + |dx| <= k. Only flagged pixels are copied to their reach."""
    offs = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a) + abs(b) <= k]
    reach = F.expr("array(" + ", ".join(f"named_struct('a', {a}, 'b', {b})" for a, b in offs) + ")")
    grown = (px.where(F.col(flag)).select(*KEYS, "y", "x", F.explode(reach).alias("o"))
             .select(*KEYS, (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x")).distinct())
    return with_flag(px.drop(flag), grown, flag)


def threshold_segmentation(px: DataFrame, side: int, nsigma: float, min_area: int) -> DataFrame:
    """Above median + nsigma std of the border, the central component (else the largest), area floor, holes filled."""
    bg = border_background(px, side)
    d = px.join(bg, KEYS).withColumn("_b", F.col("flux") > F.col("sky") + nsigma * F.col("sky_sigma"))
    sel = central_component(components(d, side, "_b"), side, "largest")
    sel = sel.withColumn("_n", F.count("*").over(W.partitionBy(*KEYS))).where(F.col("_n") >= min_area)
    return fill_holes(with_flag(px, sel, "in_mask"), side, "in_mask")


def smoothed_mask(px: DataFrame, side: int, nsigma: float | None, limit: float | None, smooth_px: float, grow_px: int) -> DataFrame:
    """R07/R15 for cubes: sky-subtracted and smoothed, above a noise threshold or a surface brightness limit, the component
    nearest to the centre, holes filled, grown."""
    bg = border_background(px, side).select(*KEYS, "sky")
    d = px.join(bg, KEYS).withColumn("_d", F.col("flux") - F.col("sky")).drop("sky")
    s = (gaussian(d, side, smooth_px, value="_d") if smooth_px > 0 else d.select(*KEYS, "y", "x", F.col("_d").alias("smooth"))).withColumnRenamed("smooth", "flux")
    if limit is not None:
        s = s.withColumn("_b", F.col("flux") > limit)
    else:
        s = s.join(border_background(s, side), KEYS).withColumn("_b", F.col("flux") > F.col("sky") + nsigma * F.col("sky_sigma"))
    c = int(round((side - 1) / 2))
    sel = central_component(components(s, side, "_b"), side, "nearest", c, c)
    out = fill_holes(with_flag(px, sel, "in_mask"), side, "in_mask")
    return dilate(out, side, "in_mask", grow_px) if grow_px > 0 else out


def detected_sources(px: DataFrame, side: int, nsigma: float = 3.0, min_px: int = 5) -> DataFrame:
    """Pixels of sources (8-connected, at least min_px) with their label; `_c` is the label at the centre, if any."""
    d = px.join(border_background(px, side), KEYS).withColumn("_b", F.col("flux") - F.col("sky") > nsigma * F.col("sky_sigma"))
    lab = components(d, side, "_b", eight=True).withColumn("_n", F.count("*").over(W.partitionBy(*KEYS, "label"))).where(F.col("_n") >= min_px).drop("_n")
    c = int(round((side - 1) / 2))
    here = F.max(F.when((F.col("y") == c) & (F.col("x") == c), F.col("label"))).over(W.partitionBy(*KEYS))
    return lab.withColumn("_c", here)


def neighbour_sources(px: DataFrame, side: int, nsigma: float = 3.0, min_px: int = 5) -> DataFrame:
    """Pixels of sources other than the central one, with their label."""
    return detected_sources(px, side, nsigma, min_px).where("_c IS NULL OR label <> _c").drop("_c")


def neighbour_mask(px: DataFrame, side: int, nsigma: float = 3.0, min_px: int = 5, grow_px: int = 3) -> DataFrame:
    d = with_flag(px, neighbour_sources(px, side, nsigma, min_px), "is_neighbour")
    return dilate(d, side, "is_neighbour", grow_px) if grow_px else d


def nearest_source_mask(px: DataFrame, side: int, noise: Column, nsigma: float = 1.5, sigma_px: float = 3.0, min_px: int = 5) -> DataFrame:
    """Smoothed detection; the source whose centroid is nearest the centre becomes the object (holes filled), the rest are
    other sources. The threshold is `nsigma` times the noise above the clipped mean of the smoothed image."""
    s = gaussian(px, side, sigma_px, mode="constant").join(px.select(*KEYS, "y", "x", noise.alias("_noise")), [*KEYS, "y", "x"])
    s = clipped(s, KEYS, F.col("smooth"), rounds=10).withColumn("_level", F.avg("_v").over(W.partitionBy(*KEYS)))
    lab = components(s.withColumn("_b", F.col("smooth") > F.col("_level") + nsigma * F.col("_noise")), side, "_b", eight=True)
    by_label = W.partitionBy(*KEYS, "label")
    lab = lab.withColumns({"_n": F.count("*").over(by_label), "_cy": F.avg("y").over(by_label), "_cx": F.avg("x").over(by_label)}).where(F.col("_n") >= min_px)
    c = (side - 1) / 2
    dist = (F.col("_cy") - c) * (F.col("_cy") - c) + (F.col("_cx") - c) * (F.col("_cx") - c)
    lab = lab.withColumn("_t", F.min_by("label", F.struct(dist.alias("d"), "label")).over(W.partitionBy(*KEYS)))
    d = with_flag(with_flag(px, lab, "_any"), lab.where("label = _t"), "in_object")
    d = fill_holes(d, side, "in_object")
    return d.withColumn("in_other", F.col("_any") & ~F.col("in_object")).drop("_any")


def collapsed_sky_free(px: DataFrame, side: int, name: str = "grz") -> DataFrame:
    """Sum of the bands after each band's border background is removed, as a band of its own."""
    d = px.join(border_background(px, side).select(*KEYS, "sky"), KEYS)
    return d.groupBy("obj_id", "y", "x").agg(F.sum(F.col("flux") - F.col("sky")).alias("flux")).select("obj_id", F.lit(name).alias("band"), "y", "x", "flux")


def candidate_masks(px: DataFrame, side: int, pixscale: float, nsigma: float, smooth_px: float, grow_px: int, sb_limit: float) -> DataFrame:
    """(obj_id, mask, y, x, in_mask) for a threshold mask per band, one on the collapsed bands, and an isophote in r."""
    every = px.unionByName(collapsed_sky_free(px, side))
    thr = smoothed_mask(every, side, nsigma, None, smooth_px, grow_px).select("obj_id", F.concat(F.lit("thr_"), "band").alias("mask"), "y", "x", "in_mask")
    iso = smoothed_mask(px.where("band = 'r'"), side, None, flux_limit(sb_limit, pixscale), smooth_px, grow_px)
    return thr.unionByName(iso.select("obj_id", F.lit("sb_r").alias("mask"), "y", "x", "in_mask"))


def mask_report(px: DataFrame, masks: DataFrame, reference: DataFrame, side: int, pixscale: float, ref_factor: float, sb_limit: float,
                bands=("g", "r", "z")) -> DataFrame:
    """Light fraction, contamination, area ratio, equivalent and isophotal radius per mask. `reference` has obj_id, th90. An empty
    mask has area 0; the contamination is 0 where an image has no source."""
    bg = border_background(px, side).select(*KEYS, "sky")
    sub = px.join(bg, KEYS).withColumn("sub", F.col("flux") - F.col("sky")).drop("sky")
    found = detected_sources(px, side).select(*KEYS, "y", "x", (F.col("_c").isNull() | (F.col("label") != F.col("_c"))).alias("contaminant"), F.lit(True).alias("source"))
    own = sub.join(found, [*KEYS, "y", "x"], "left").fillna(False, ["contaminant", "source"])
    shared = neighbour_mask(collapsed_sky_free(px, side), side).select("obj_id", "y", "x", "is_neighbour")
    d = own.join(shared, ["obj_id", "y", "x"]).withColumn("clean", F.when(F.col("is_neighbour"), 0.0).otherwise(F.col("sub")))
    d = with_radius(d, side).join(reference, "obj_id")
    ref_px = ref_factor * F.col("th90") / pixscale
    sums = d.groupBy("obj_id", "band").agg(F.sum(F.when(F.col("r") <= ref_px, F.col("clean"))).alias("ref_flux"), F.max("source").alias("has_source"))
    def within(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("in_mask"), value)), F.lit(0.0))

    inside = d.join(masks, ["obj_id", "y", "x"])
    m = inside.groupBy("obj_id", "mask", "band").agg(within(F.col("clean")).alias("light"), within(F.col("sub")).alias("total"), within(F.when(F.col("contaminant"), F.col("sub"))).alias("foreign"),
                                                     F.count_if("in_mask").alias("area_px"), F.max("th90").alias("th90"))
    iso = isophotal_radius(d.select("obj_id", "band", "y", "x", F.col("clean").alias("flux"), "th90"), side, pixscale, sb_limit, ref_px)
    m = m.join(sums, ["obj_id", "band"]).join(iso, ["obj_id", "band"], "left")
    m = m.withColumns({"light_frac": F.when(F.col("ref_flux") > 0, F.col("light") / F.col("ref_flux")), "contam": F.when(~F.col("has_source"), 0.0).when(F.col("total") > 0, F.col("foreign") / F.col("total"))})
    r90 = F.first("th90") / pixscale
    cols = [F.first(F.when(F.col("band") == b, F.col(c)), ignorenulls=True).alias(f"{c}_{b}") for c in ("light_frac", "contam", "r_iso") for b in bands]
    return m.groupBy("obj_id", "mask").agg((equivalent_radius(F.first("area_px")) * pixscale).alias("r_mask"), safe_div(F.first("area_px"), F.pi() * r90 * r90).alias("area_ratio"), *cols)


def mask_summary(report: DataFrame) -> DataFrame:
    """Mean and sample std of every metric per mask."""
    metrics = [c for c, ty in report.dtypes if ty == "double"]
    return report.groupBy("mask").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])
