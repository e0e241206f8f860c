"""Radial profiles: growth curves, Petrosian and fraction radii, rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.functions.scalars import magnitude, safe_div, surface_brightness
from photonloom.operators.raster.pixels import KEYS, with_radius

# Definition of the Petrosian radius and the aperture in its units; radial step in pixels.
PETRO_ETA = 0.2
PETRO_RING = (0.8, 1.25)
PETRO_APERTURE = 2.0
STEP = 0.5
CAS_EXTENT = 1.5


def n_bins(side: int, step: float = STEP) -> int:
    c = (side - 1) / 2
    return int(math.ceil(math.sqrt(2) * c / step)) + 1


def growth(px: DataFrame, side: int, step: float = STEP, value: str = "flux") -> DataFrame:
    """(obj_id, band, bin, radius, flux_cum, area_cum): light and pixels inside each bin edge, from one partial aggregate by
    (image, bin) and a running sum over at most a few hundred bins."""
    d = with_radius(px, side).groupBy(*KEYS, F.floor(F.col("r") / step).cast("int").alias("bin")).agg(F.sum(value).alias("s"), F.count("*").alias("a"))
    dense = d.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("s", "a").alias("v")))).alias("m"))
    dense = dense.select(*KEYS, "m", F.explode(F.sequence(F.lit(0), F.lit(n_bins(side, step) - 1))).alias("bin"))
    cell = F.col("m")[F.col("bin")]
    dense = dense.select(*KEYS, "bin", F.coalesce(cell["s"], F.lit(0.0)).alias("s"), F.coalesce(cell["a"], F.lit(0)).alias("a"))
    w = W.partitionBy(*KEYS).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return dense.select(*KEYS, "bin", ((F.col("bin") + 1) * step).alias("radius"), F.sum("s").over(w).alias("flux_cum"), F.sum("a").over(w).alias("area_cum"))


def profile_rows(px: DataFrame, side: int, step: float = STEP) -> DataFrame:
    """One row per image and band with the cumulative arrays `cf`, `ca` at the edges 0, step, 2 step, ..."""
    g = growth(px, side, step).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("bin", "flux_cum", "area_cum"))).alias("g"))
    return g.select(*KEYS, F.concat(F.array(F.lit(0.0)), F.transform("g", lambda s: s["flux_cum"])).alias("cf"),
                    F.concat(F.array(F.lit(0.0)), F.transform("g", lambda s: s["area_cum"].cast("double"))).alias("ca"))


def interp(curve: Column, r: Column, step: float = STEP) -> Column:
    """J14 on a curve held in an array: linear between edges, constant beyond the last."""
    p = r / step
    i = F.floor(p).cast("int")
    last = F.size(curve) - 1
    lo = F.get(curve, F.least(i, last))
    hi = F.get(curve, F.least(i + 1, last))
    return lo + (hi - lo) * (p - i)


def petrosian_radius(cf: Column, ca: Column, r_max: float, eta: float = PETRO_ETA, step: float = STEP) -> Column:
    """First radius where the ring brightness falls below eta times the mean inside, interpolated to the sample before."""
    a_in, a_out = PETRO_RING
    n = max(int(math.ceil((r_max / a_out - 2.0) / step - 1e-9)), 0)
    if n < 3:
        return F.lit(None).cast("double")
    radii = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: 2.0 + j * F.lit(step))

    def ratio(r: Column) -> Column:
        ring = (interp(cf, a_out * r) - interp(cf, a_in * r)) / F.greatest(interp(ca, a_out * r) - interp(ca, a_in * r), F.lit(1.0))
        inside = interp(cf, r) / F.greatest(interp(ca, r), F.lit(1.0))
        return F.when(inside > 0, ring / inside)

    q = F.transform(radii, ratio)
    i = F.array_position(F.transform(q, lambda v: F.coalesce(v < eta, F.lit(False))), True).cast("int")
    q0, q1 = F.get(q, i - 2), F.get(q, i - 1)
    r0 = 2.0 + (i - 2) * step
    return F.when(i >= 2, r0 + (q0 - eta) / (q0 - q1) * step)


def fraction_radius(cf: Column, total: Column, fraction: float, r_lim: Column, step: float = STEP) -> Column:
    """First radius (up to r_lim) that holds `fraction` of `total`."""
    want = fraction * total
    edges = F.slice(cf, F.lit(1), (F.floor(r_lim / step) + 1).cast("int"))
    i = F.array_position(F.transform(edges, lambda f: f >= want), True).cast("int")
    f0, f1 = F.get(cf, i - 2), F.get(cf, i - 1)
    return F.when((total > 0) & (i >= 2), (i - 2) * step + (want - f0) / (f1 - f0) * step)


def petrosian_photometry(clean: DataFrame, side: int, pixscale: float) -> DataFrame:
    """R19 (on sky-subtracted, filled pixels): Petrosian radius in r, the same aperture in every band, fluxes, magnitudes, radii,
    size ratios, inner and outer magnitudes and flags; R20: concentration. One row per object."""
    edge = (side - 1) / 2 - 1
    p = profile_rows(clean, side)
    wide = p.groupBy("obj_id").agg(*[F.first(F.when(F.col("band") == b, F.col(c)), ignorenulls=True).alias(f"{c}_{b}") for b in "grz" for c in ("cf", "ca")])
    d = wide.withColumn("rp_px", petrosian_radius(F.col("cf_r"), F.col("ca_r"), edge))
    d = d.withColumn("ap_px", F.least(PETRO_APERTURE * F.col("rp_px"), F.lit(edge)))
    d = d.withColumns({f"flux_{b}": F.when(F.col("ap_px").isNotNull(), interp(F.col(f"cf_{b}"), F.col("ap_px"))) for b in "grz"})
    radii = {f"px{int(100 * f)}": fraction_radius(F.col("cf_r"), F.col("flux_r"), f, F.col("ap_px")) for f in (0.2, 0.5, 0.8, 0.9)}
    radii |= {f"px50_{b}": fraction_radius(F.col(f"cf_{b}"), F.col(f"flux_{b}"), 0.5, F.col("ap_px")) for b in "gz"}
    ext = F.least(CAS_EXTENT * F.col("rp_px"), F.lit(n_bins(side) * STEP))
    d = d.withColumns(radii).withColumn("_ext", ext).withColumn("_tot", interp(F.col("cf_r"), F.col("_ext")))
    d = d.withColumns({"_c20": fraction_radius(F.col("cf_r"), F.col("_tot"), 0.2, F.col("_ext")), "_c80": fraction_radius(F.col("cf_r"), F.col("_tot"), 0.8, F.col("_ext"))})
    out = {"petro_converges": F.col("rp_px").isNotNull(), "aperture_truncated": F.coalesce(PETRO_APERTURE * F.col("rp_px") > edge, F.lit(False)),
           "concentration": F.when((F.col("_c20") > 0) & (F.col("_c80") > 0), 5 * F.log10(F.col("_c80") / F.col("_c20")))}
    for n in (20, 50, 80, 90):
        out[f"R{n}"] = F.col(f"px{n}") * pixscale
    for b in "gz":
        out[f"ratio_R50_{b}_r"] = safe_div(f"px50_{b}", "px50")
    for b in "grz":
        cf = F.col(f"cf_{b}")
        out[f"m_{b}"] = magnitude(f"flux_{b}")
        out[f"m_in_{b}"] = magnitude(F.when(F.col("px50").isNotNull(), interp(cf, F.col("px50"))))
        out[f"m_out_{b}"] = magnitude(F.when(F.col("px90").isNotNull(), interp(cf, F.col("px90")) - interp(cf, F.col("px50"))))
    return d.withColumns(out).drop("_ext", "_tot", "_c20", "_c80", *[f"{c}_{b}" for b in "grz" for c in ("cf", "ca")], *[f"px50_{b}" for b in "gz"])


def isophotal_radius(px: DataFrame, side: int, pixscale: float, limit: float, r_max: Column | float, width: float = 2.0) -> DataFrame:
    """Outer edge of the last ring (up to r_max, which may be a column) whose mean brightness is above the limit."""
    r_max = r_max if isinstance(r_max, Column) else F.lit(float(r_max))
    d = with_radius(px, side).where(F.col("r") < (F.ceil((r_max + 2) / width) - 1) * width)
    rings = d.groupBy(*KEYS, F.floor(F.col("r") / width).alias("ring")).agg(F.avg("flux").alias("f"))
    sb = surface_brightness(F.greatest("f", F.lit(1e-12)), pixscale)
    return rings.groupBy(*KEYS).agg((F.max(F.when(sb < limit, F.col("ring") + 1)) * width * pixscale).alias("r_iso"))


def half_light_radius(px: DataFrame, side: int, r_max: float | None = None, r_sky: float | None = None) -> DataFrame:
    """First pixel, by radius, at which the running flux reaches half of its maximum, after the outer ring median is
    subtracted; limited to [1, r_max]."""
    r_max, r_sky = r_max or 0.43 * side, r_sky or 0.45 * side
    image = W.partitionBy(*KEYS)
    d = with_radius(px, side).withColumn("_sky", F.percentile(F.when(F.col("r") > r_sky, F.col("flux")), F.lit(0.5)).over(image)).where(F.col("r") <= r_max)
    d = d.withColumn("_c", F.sum(F.col("flux") - F.coalesce("_sky", F.lit(0.0))).over(image.orderBy("r", "y", "x").rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_top", F.greatest(F.max("_c").over(image), F.lit(1e-12)))
    half = F.min(F.when(F.col("_c") >= 0.5 * F.col("_top"), F.col("r")))
    first = F.min("r")
    return d.groupBy(*KEYS).agg(F.least(F.greatest(F.coalesce(half, first), F.lit(1.0)), F.lit(r_max)).alias("r50_px"))


def azimuthal_profile(px: DataFrame, side: int, value: str = "flux") -> DataFrame:
    """Mean in rings of integer radius; the first and the outermost ring are dropped, index 0 is ring 1."""
    d = with_radius(px, side).groupBy(*KEYS, F.floor("r").cast("int").alias("ring")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    w = W.partitionBy(*KEYS)
    d = d.withColumns({"_lo": F.min("ring").over(w), "_hi": F.max("ring").over(w)}).where("ring > _lo AND ring < _hi")
    return d.withColumn("index", F.row_number().over(w.orderBy("ring")) - 1).drop("_lo", "_hi")


def radial_gradient(profile: DataFrame, scale: DataFrame, distance: float) -> DataFrame:
    """Profile interpolated at a physical distance minus its first value; missing when the profile ends before.
    `scale` has obj_id and kpc_per_px."""
    g = profile.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "mean"))), lambda s: s["mean"]).alias("p"))
    d = g.join(scale, "obj_id")
    at = F.lit(distance) / F.col("kpc_per_px")
    inside = (F.size("p") - 1) * F.col("kpc_per_px") >= distance
    return d.select(*KEYS, F.when(inside, interp(F.col("p"), at, 1.0) - F.get("p", F.lit(0))).alias("gradient"))
