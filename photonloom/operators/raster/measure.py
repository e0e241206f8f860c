"""Whole-object measurement (R46): photometry and morphology of every object in one plan, with a status instead of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.operators.raster import morphology as MO
from photonloom.operators.raster.pixels import KEYS, symmetric_fill, with_radius
from photonloom.operators.raster.profile import petrosian_photometry
from photonloom.operators.raster.segment import dilate, neighbour_sources, smoothed_mask, with_flag
from photonloom.operators.raster.sky import corner_sky
from photonloom.session import cut_lineage

# Object mask of the photometry (threshold, smoothing, growth) and growth of the neighbour mask, in pixels.
SEG_NSIGMA, SEG_SMOOTH, SEG_GROW, NEIGHBOUR_GROW = 2.0, 2.0, 2, 3


def clean_pixels(px: DataFrame, side: int, r_min: float, minimum: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sky-subtracted pixels with neighbours and uncovered pixels filled by symmetry; the sky of each band; the flags (obj_id, y, x,
    foreign) of neighbours outside the object; and per object the neighbour sources and the largest uncovered share of a
    band. Sources are counted before the fill, which removes them."""
    sky = corner_sky(px, side, r_min, minimum)
    sub = px.join(sky.select(*KEYS, "sky"), KEYS).withColumn("no_data", F.col("flux") == 0)
    # The masks below read these pixels many times, so they are materialized once.
    sub = cut_lineage(sub.withColumn("flux", F.when(F.col("no_data"), 0.0).otherwise(F.col("flux") - F.col("sky"))).drop("sky"))
    ref = sub.where("band = 'r'").select(*KEYS, "y", "x", "flux")
    own = smoothed_mask(ref, side, SEG_NSIGMA, None, SEG_SMOOTH, SEG_GROW).select("obj_id", "y", "x", "in_mask")
    sources = cut_lineage(neighbour_sources(ref, side))
    near = dilate(with_flag(ref, sources, "is_neighbour"), side, "is_neighbour", NEIGHBOUR_GROW).select("obj_id", "y", "x", "is_neighbour")
    flags = cut_lineage(own.join(near, ["obj_id", "y", "x"]).select("obj_id", "y", "x", (F.col("is_neighbour") & ~F.col("in_mask")).alias("foreign")))
    d = sub.join(flags, ["obj_id", "y", "x"]).withColumn("fill", F.col("foreign") | F.col("no_data"))
    counted = sources.groupBy("obj_id").agg(F.countDistinct("label").alias("n_sources"))
    empty = sub.groupBy(*KEYS).agg(F.avg(F.col("no_data").cast("double")).alias("s")).groupBy("obj_id").agg(F.max("s").alias("no_data_share"))
    return symmetric_fill(d.drop("no_data", "foreign"), side, "fill").drop("fill"), sky, flags, empty.join(counted, "obj_id", "left").fillna(0, ["n_sources"])


def measure_objects(px: DataFrame, side: int, pixscale: float, r_min: float, minimum: int = 100) -> DataFrame:
    """One row per object: photometry, concentration, asymmetry, smoothness, Gini, M20, shape, Petrosian radius in arcsec, shares of
    the aperture that neighbours cover and of the image without data, sky noise by band, source count, status and reason."""
    clean, sky, flags, counts = clean_pixels(px, side, r_min, minimum)
    clean, sky = cut_lineage(clean), cut_lineage(sky)
    phot = cut_lineage(petrosian_photometry(clean, side, pixscale))
    sizes = phot.select("obj_id", "rp_px").join(sky.where("band = 'r'").select("obj_id", "sky_sigma"), "obj_id")
    r = clean.where("band = 'r'")
    seg = cut_lineage(MO.gini_segmentation(r, sizes, side))
    out = phot.withColumn("R_P", F.col("rp_px") * pixscale)
    for d in (MO.asymmetry(r, sizes, side), MO.smoothness(r, sizes, side), MO.gini(seg), MO.m20(seg), MO.shape(seg)):
        out = out.join(d.drop("band"), "obj_id", "left")
    inside = with_radius(flags, side).join(phot.select("obj_id", "ap_px"), "obj_id").where("r < ap_px")
    noise = sky.groupBy("obj_id").agg(*[F.max(F.when(F.col("band") == b, F.col("sky_sigma"))).alias(f"sky_sigma_{b}") for b in "grz"])
    for d in (inside.groupBy("obj_id").agg(F.avg(F.col("foreign").cast("double")).alias("neighbour_share")), counts, noise):
        out = out.join(d, "obj_id", "left")
    why = F.concat_ws("; ", F.when(~F.col("petro_converges"), "Petrosian radius not reached"), F.when(F.col("gini").isNull(), "no segmentation"),
                      F.when(F.col("smoothness").isNull(), "smoothness undefined"))
    return out.withColumn("reason", why).withColumn("status", F.when(F.col("reason") == "", "ok").otherwise("partial"))
