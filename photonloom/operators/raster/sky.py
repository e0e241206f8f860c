"""Sky level and noise: rings, sigma clipping, robust scales, box backgrounds."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.operators.distribution import quantiles
from photonloom.operators.raster.pixels import KEYS, with_radius

CLIP_ROUNDS = 5  # a round that removes nothing changes nothing, so the limit of rounds can be run unconditionally


def border_ring(side: int, fraction: float = 0.1, width: int | None = None) -> Column:
    b = width if width is not None else max(int(side * fraction), 1)
    return (F.col("y") < b) | (F.col("y") >= side - b) | (F.col("x") < b) | (F.col("x") >= side - b)


def clipped(px: DataFrame, keys: Sequence[str], value: Column, sigma: float = 3.0, rounds: int = CLIP_ROUNDS) -> DataFrame:
    """Values surviving iterative clipping, as `_v` (NULL when clipped or not selected). All rounds are windows over the same
    image, so they share one layout and one sort."""
    w = W.partitionBy(*keys)
    d = px.withColumn("_v", value).where("_v IS NOT NULL")
    for _ in range(rounds):
        d = d.withColumns({"_m": F.percentile("_v", F.lit(0.5)).over(w), "_s": F.stddev_pop("_v").over(w)})
        d = d.withColumn("_v", F.when(F.abs(F.col("_v") - F.col("_m")) <= sigma * F.col("_s"), F.col("_v")))
    return d.drop("_m", "_s")


def clipped_stats(px: DataFrame, keys: Sequence[str], value: Column, sigma: float = 3.0) -> DataFrame:
    return (clipped(px.select(*{*keys, "y", "x", "flux"}), keys, value, sigma).groupBy(*keys)
            .agg(F.percentile("_v", F.lit(0.5)).alias("sky"), F.stddev_pop("_v").alias("sky_sigma"), F.count("*").alias("n_sky")))


def border_background(px: DataFrame, side: int, fraction: float = 0.1) -> DataFrame:
    """R01"""
    return clipped_stats(px, KEYS, F.when(border_ring(side, fraction), F.col("flux")))


def corner_sky(px: DataFrame, side: int, r_min: float, minimum: int = 100) -> DataFrame:
    """Pixels beyond r_min that are not exactly zero; too few of them give (0, missing)."""
    d = with_radius(px, side)
    c = (side - 1) / 2
    s = clipped_stats(d, KEYS, F.when((F.sqrt((F.col("y") - c) * (F.col("y") - c) + (F.col("x") - c) * (F.col("x") - c)) > r_min) & (F.col("flux") != 0), F.col("flux")))
    every = px.groupBy(*KEYS).agg(F.count("*").alias("n_px"))
    few = F.coalesce(F.col("n_sky"), F.lit(0)) < minimum
    return every.join(s, KEYS, "left").select(*KEYS, F.when(few, 0.0).otherwise(F.col("sky")).alias("sky"), F.when(~few, F.col("sky_sigma")).alias("sky_sigma"))


def robust_ring_scale(px: DataFrame, side: int, r_fraction: float = 0.45, floor: float = 1e-6) -> DataFrame:
    """1.4826 MAD of the outer ring per image and band, zeros excluded; missing ones take the global median."""
    w = W.partitionBy(*KEYS)
    v = F.when((F.col("r") > r_fraction * side) & (F.col("flux") != 0), F.col("flux"))
    d = with_radius(px, side).withColumn("_v", v).withColumn("_m", F.percentile("_v", F.lit(0.5)).over(w))
    s = d.groupBy(*KEYS).agg((1.4826 * F.percentile(F.abs(F.col("_v") - F.col("_m")), F.lit(0.5))).alias("scale"))
    middle = quantiles(s.select(F.lit(1).alias("_k"), "scale"), ["_k"], "scale", {"g": 0.5}).select("g")
    return s.withColumn("scale", F.greatest(F.coalesce(F.col("scale"), middle.scalar()), F.lit(floor)))


def global_sky_scale(scales: DataFrame) -> DataFrame:
    """Median over objects of the per-image scale."""
    return quantiles(scales, ["band"], "scale", {"sky_scale": 0.5})


def subtract_ring_median(px: DataFrame, side: int, r_min: float) -> DataFrame:
    """The ring median is subtracted from covered pixels; zeros stay zero."""
    ring = F.when((F.col("r") > r_min) & (F.col("flux") != 0), F.col("flux"))
    d = with_radius(px, side).withColumn("_m", F.percentile(ring, F.lit(0.5)).over(W.partitionBy(*KEYS)))
    return d.withColumn("flux", F.when(F.col("flux") != 0, F.col("flux") - F.coalesce("_m", F.lit(0.0))).otherwise(0.0)).drop("_m", "r")


def border_std(px: DataFrame, side: int, width: int = 5) -> DataFrame:
    """R35"""
    return px.where(border_ring(side, width=width)).groupBy("obj_id").agg(F.stddev_samp("flux").alias("border_std"))


def box_size(r90_arcsec: Column, side: int, pixscale: float) -> Column:
    """Four times R90 in pixels, within 32 and a quarter of the side (20 px when the radius is unknown)."""
    r90 = F.coalesce(F.when(r90_arcsec > 0, r90_arcsec / pixscale), F.lit(20.0))
    return F.least(F.greatest(4 * r90, F.lit(32.0)), F.lit(float(side // 4))).cast("int")


#: Fixed value: boxes that a dropped box is filled from.
FILL_FROM = 10


def box_background(px: DataFrame, side: int, box: int, masked: Column | None = None, limit: float = 0.5) -> DataFrame:
    """(obj_id, band, by, bx, level) of every box: clipped median per box; a box masked beyond the limit, or without a pixel left,
    takes the mean of the nearest FILL_FROM others weighted by 1 / distance; 3 x 3 median of boxes, fewer at the border."""
    n = -(-side // box)
    d = px.withColumns({"by": F.expr(f"int(y div {box})"), "bx": F.expr(f"int(x div {box})"), "_masked": F.lit(False) if masked is None else masked})
    k = [*KEYS, "by", "bx"]
    w = W.partitionBy(*k)
    d = d.withColumn("_share", F.avg(F.when(F.col("_masked"), 1.0).otherwise(0.0)).over(w)).where(F.col("_share") <= limit)
    level = clipped(d, k, F.when(~F.col("_masked"), F.col("flux"))).groupBy(*k).agg(F.percentile("_v", F.lit(0.5)).alias("raw")).where("raw IS NOT NULL")
    # The mesh of an image is one small array.
    known = level.groupBy(*KEYS).agg(F.collect_list(F.struct("by", "bx", "raw")).alias("known"))
    every = known.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))).withColumns({"by": F.expr(f"int(_i div {n})"), "bx": F.expr(f"int(_i % {n})")})
    away = F.transform("known", lambda b: F.struct(((b["by"] - F.col("by")) * (b["by"] - F.col("by")) + (b["bx"] - F.col("bx")) * (b["bx"] - F.col("bx"))).alias("d2"), b["by"].alias("by"), b["bx"].alias("bx"), b["raw"].alias("raw")))
    every = every.withColumn("_near", F.slice(F.array_sort(away), 1, FILL_FROM))
    total = lambda f: F.aggregate("_near", F.lit(0.0), lambda s, b: s + f(b))
    mesh = every.select(*k, F.when(F.col("_near")[0]["d2"] == 0, F.col("_near")[0]["raw"]).otherwise(total(lambda b: b["raw"] / F.sqrt(b["d2"])) / total(lambda b: 1 / F.sqrt(b["d2"]))).alias("raw"))
    offsets = F.expr("flatten(transform(array(-1, 0, 1), a -> transform(array(-1, 0, 1), b -> struct(a AS a, b AS b))))")
    near = mesh.withColumn("_o", F.explode(offsets)).select(*KEYS, (F.col("by") + F.col("_o.a")).alias("by"), (F.col("bx") + F.col("_o.b")).alias("bx"), "raw")
    return near.where(F.col("by").between(0, n - 1) & F.col("bx").between(0, n - 1)).groupBy(*k).agg(F.percentile("raw", F.lit(0.5)).alias("level"))


def spline_weights(side: int, box: int) -> list[list[float]]:
    """[pixel][box]: the cubic spline through the box centres, mirrored at the border, as weights of the box levels."""
    n = -(-side // box)
    mirrored = lambda i: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
    knots = np.zeros((n, n))
    for i in range(n):
        for j, v in ((i, 4 / 6), (mirrored(i - 1), 1 / 6), (mirrored(i + 1), 1 / 6)):
            knots[i, j] += v
    coefficients, out = np.linalg.inv(knots), np.zeros((side, n))
    for p in range(side):
        u = (p + 0.5) / box - 0.5
        for i in range(math.floor(u) - 1, math.floor(u) + 3):
            x = abs(u - i)
            out[p] += coefficients[min(n - 1, max(0, mirrored(i)))] * (2 / 3 - x * x + x ** 3 / 2 if x < 1 else (2 - x) ** 3 / 6)
    return out.tolist()


def smooth_background(px: DataFrame, boxes: DataFrame, box: int, side: int) -> DataFrame:
    """The mesh of box levels interpolated at every pixel by a cubic spline, within the range of the levels."""
    n = -(-side // box)
    mesh = boxes.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("by", "bx", "level"))), lambda b: b["level"]).alias("_g"))
    w = F.array(*[F.array(*[F.lit(v) for v in row]) for row in spline_weights(side, box)])
    d = px.join(mesh, KEYS, "left").withColumns({"_wy": F.get(w, F.col("y")), "_wx": F.get(w, F.col("x"))})
    row = lambda i: F.aggregate(F.zip_with(F.slice("_g", i * n + 1, n), F.col("_wx"), lambda g, v: g * v), F.lit(0.0), lambda s, v: s + v)
    value = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + F.get("_wy", i) * row(i))
    return d.withColumn("background", F.greatest(F.array_min("_g"), F.least(F.array_max("_g"), value))).drop("_wy", "_wx", "_g")
