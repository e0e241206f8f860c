"""Pixel tables: construction, crops, symmetries and pixel-wise edits.

A pixel table has rows (obj_id, band, y, x, flux). Images are shuffled once, as arrays, on obj_id; the exploded rows keep that
layout, so windows and aggregates keyed by obj_id (and more) need no further exchange. One image is the largest group, and its
size is fixed by the survey.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from photonloom.functions.scalars import clip, radius

KEYS = ["obj_id", "band"]


def image_window() -> WindowSpec:
    """All pixels of one image: the largest window any raster operator opens."""
    return W.partitionBy(*KEYS)


def frame(px: DataFrame, side: int) -> DataFrame:
    """(obj_id, band, y, x) of all places of every image, with those whose pixel it lacks."""
    d = px.select(*KEYS).distinct().withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    return d.select(*KEYS, F.expr(f"int(_p div {side})").alias("y"), F.expr(f"int(_p % {side})").alias("x"))


def explode_images(images: DataFrame, flux: str, width: int) -> DataFrame:
    """Rows (obj_id, band, y, x, flux) from one array per (obj_id, band), laid out by obj_id before they are exploded."""
    d = images.repartition("obj_id").select("obj_id", "band", F.posexplode(flux).alias("p", "v"))
    return d.select("obj_id", "band", F.expr(f"int(p div {width})").alias("y"), F.expr(f"int(p % {width})").alias("x"), F.col("v").cast("double").alias("flux"))


def central_crop(px: DataFrame, side: int, crop: int) -> DataFrame:
    """Range predicate plus coordinate shift; the predicate reaches the scan of a stored pixel table."""
    if crop >= side:
        return px
    o = (side - crop) // 2
    inside = F.col("y").between(o, o + crop - 1) & F.col("x").between(o, o + crop - 1)
    return px.where(inside).withColumns({"y": F.col("y") - o, "x": F.col("x") - o})


def zero_fractions(px: DataFrame) -> DataFrame:
    return px.groupBy(*KEYS).agg(F.avg(F.when(F.col("flux") == 0, 1.0).otherwise(0.0)).alias("zero_fraction"), F.count("*").alias("n_px"))


def with_radius(px: DataFrame, side: int, name: str = "r") -> DataFrame:
    c = (side - 1) / 2
    return px.withColumn(name, radius("y", "x", c, c))


def bands_to_columns(px: DataFrame, bands=("g", "r", "z"), value: str = "flux") -> DataFrame:
    """One row per pixel with a column per band (conditional aggregate, laid out by obj_id already)."""
    return px.groupBy("obj_id", "y", "x").agg(*[F.max(F.when(F.col("band") == b, F.col(value))).alias(b) for b in bands])


def rotate180(px: DataFrame, side: int, value: str, name: str, dy: int | Column = 0, dx: int | Column = 0) -> DataFrame:
    """Each pixel next to its partner under a 180 degree rotation (plus shift), by an equi-join on computed coordinates."""
    partner = px.select("obj_id", "band", (F.lit(side - 1 + dy) - F.col("y")).alias("y"), (F.lit(side - 1 + dx) - F.col("x")).alias("x"), F.col(value).alias(name))
    return px.join(partner, ["obj_id", "band", "y", "x"], "left")


def symmetric_fill(px: DataFrame, side: int, missing: str) -> DataFrame:
    """A missing pixel takes its mirror value when that is present, else 0."""
    both = px.withColumn("_s", F.struct("flux", missing))
    d = rotate180(both, side, "_s", "_m")
    ok = F.coalesce(~F.col(f"_m.{missing}"), F.lit(False))
    return d.withColumn("flux", F.when(~F.col(missing), F.col("flux")).when(ok, F.col("_m.flux")).otherwise(0.0)).drop("_s", "_m")


def square_symmetries(px: DataFrame, side: int) -> DataFrame:
    """The eight views of the square, 0-3 quarter turns and 4-7 the same after a reflection; coordinates only."""
    m = side - 1
    views = F.expr("array(" + ", ".join(
        f"named_struct('view', {k}, 'y', {y}, 'x', {x})" for k, (y, x) in enumerate([
            ("y", "x"), (f"{m} - x", "y"), (f"{m} - y", f"{m} - x"), ("x", f"{m} - y"),
            ("y", f"{m} - x"), ("x", "y"), (f"{m} - y", "x"), (f"{m} - x", f"{m} - y")])) + ")")
    return px.withColumn("_v", F.explode(views)).select("obj_id", "band", F.col("_v.view").alias("view"), F.col("_v.y").alias("y"), F.col("_v.x").alias("x"), "flux")


def mean_over_views(px: DataFrame, side: int) -> DataFrame:
    return square_symmetries(px, side).groupBy("obj_id", "band", "y", "x").agg(F.avg("flux").alias("flux"))


def degrade(px: DataFrame, side: int, factor: int) -> DataFrame:
    """Block means replicated on the original grid."""
    block = W.partitionBy(*KEYS, F.expr(f"y div {factor}"), F.expr(f"x div {factor}"))
    return px.withColumn("flux", F.avg("flux").over(block))


def occlude_band(px: DataFrame, band: str) -> DataFrame:
    return px.withColumn("flux", F.when(F.col("band") == band, 0.0).otherwise(F.col("flux")))


def occlude_ring(px: DataFrame, r_over_r50: Column, a: float, b: float) -> DataFrame:
    """Set a <= r / R50 < b to zero."""
    return px.withColumn("flux", F.when((r_over_r50 >= a) & (r_over_r50 < b), 0.0).otherwise(F.col("flux")))


def replace_outside(px: DataFrame, in_mask: str, level: str) -> DataFrame:
    """Pixels outside the mask take the background level."""
    return px.withColumn("flux", F.when(F.col(in_mask), F.col("flux")).otherwise(F.col(level)))


def input_audit(px: DataFrame) -> DataFrame:
    """Per image and band: finiteness, all-zero flag, zero and negative shares and a content digest of the ordered values."""
    f = F.col("flux")
    bad = f.isNull() | F.isnan(f) | (F.abs(f) == float("inf"))
    text = F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.format_string("%.6f", f).alias("t")))), lambda s: s["t"]))
    return px.groupBy(*KEYS).agg(F.count_if(bad).alias("n_not_finite"), (F.max(F.abs(f)) == 0).alias("all_zero"),
                                 F.avg(F.when(f == 0, 100.0).otherwise(0.0)).alias("zero_pct"), F.avg(F.when(f < 0, 100.0).otherwise(0.0)).alias("negative_pct"),
                                 F.sha2(text, 256).alias("content_hash"))


def map_correlation(px: DataFrame, side: int, value: str = "flux") -> DataFrame:
    """Per image, correlation of a value map with its rotated counterpart."""
    return rotate180(px, side, value, "_m").groupBy(*KEYS).agg(F.corr(value, "_m").alias("corr"))


def stamp(px: DataFrame, geometry: DataFrame, side: int, out_px: int, radii: float = 2.0) -> DataFrame:
    """Aligned, rescaled stamp. `geometry` has obj_id, rp_px and pa_rad. Every sample position of every band is
    joined to its four surrounding pixels, weighted bilinearly, normalized by the mean of r and compressed; a position outside
    the image counts as 0."""
    half = radii * F.coalesce("rp_px", F.lit(20.0))
    c = (side - 1) / 2
    step = 2.0 / (out_px - 1)
    g = geometry.select("obj_id", half.alias("h"), F.cos(F.coalesce("pa_rad", F.lit(0.0))).alias("ca"), F.sin(F.coalesce("pa_rad", F.lit(0.0))).alias("sa"))
    g = g.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(out_px - 1)))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(out_px - 1))))
    U, V = F.col("h") * (F.col("u") * step - 1), F.col("h") * (F.col("v") * step - 1)
    g = g.select("obj_id", "v", "u", (F.lit(c) + U * F.col("sa") + V * F.col("ca")).alias("sy"), (F.lit(c) + U * F.col("ca") - V * F.col("sa")).alias("sx"))
    g = g.withColumns({"y0": F.floor("sy").cast("int"), "x0": F.floor("sx").cast("int"), "held": F.col("sy").between(0, side - 1) & F.col("sx").between(0, side - 1)})
    g = g.join(px.select("obj_id", "band").distinct(), "obj_id").selectExpr("obj_id", "band", "v", "u", "held", "inline(array(" + ", ".join(
        f"named_struct('y', y0 + {a}, 'x', x0 + {b}, 'w', {'(sy - y0)' if a else '(1 - sy + y0)'} * {'(sx - x0)' if b else '(1 - sx + x0)'})" for a in (0, 1) for b in (0, 1)) + "))")
    value = F.when(F.col("held"), F.col("w") * F.col("flux"))
    s = g.join(px, ["obj_id", "band", "y", "x"], "left").groupBy("obj_id", "band", "v", "u").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("flux"))
    scale = F.sum(F.when(F.col("band") == "r", F.col("flux"))).over(W.partitionBy("obj_id")) / (out_px * out_px)
    return s.withColumn("_s", scale).withColumn("flux", F.when(F.col("_s") > 0, F.asinh(F.col("flux") / F.col("_s")))).drop("_s")
