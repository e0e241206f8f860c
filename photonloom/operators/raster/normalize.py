"""Image normalization: percentile stretches, collapses, metrics and train-fitted scales."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.functions.scalars import colour_map, eight_bit, rescale01, stretch01
from photonloom.operators.distribution import quantiles
from photonloom.operators.raster.pixels import KEYS, bands_to_columns, image_window, with_radius
from photonloom.operators.raster.sky import clipped_stats, corner_sky
from photonloom.operators.splits import sampled_positions

# Constants of the logarithmic and asinh stretches, radius of the central region, 8-bit levels.
LOG_A = 1000.0
ASINH_NSIGMA = 3.0
CENTRAL_PX = 6.0


def percentile_normalize(px: DataFrame, method: str, softening: float = 0.1, upper: float = 99.5) -> DataFrame:
    """Per image, clip to the (100 - p, p) percentiles and stretch. The window is one image."""
    q = F.percentile("flux", F.array(F.lit((100 - upper) / 100), F.lit(upper / 100))).over(image_window())
    return px.withColumn("_q", q).withColumn("norm", stretch01(rescale01("flux", F.col("_q")[0], F.col("_q")[1]), method, softening)).drop("_q")


def collapses(px: DataFrame, side: int, r_min: float, minimum: int = 100) -> DataFrame:
    """(obj_id, band, y, x, flux) with the collapse as the band name: mean without sky, raw mean, inverse-variance mean."""
    d = px.join(corner_sky(px, side, r_min, minimum), KEYS)
    d = d.withColumn("_w", F.when(F.col("sky_sigma") > 0, 1 / (F.col("sky_sigma") * F.col("sky_sigma"))).otherwise(0.0))
    sub = F.col("flux") - F.col("sky")
    g = d.groupBy("obj_id", "y", "x").agg(F.avg(sub).alias("sky_free_mean"), F.avg("flux").alias("raw_mean"),
                                          F.when(F.sum("_w") > 0, F.sum(F.col("_w") * sub) / F.sum("_w")).otherwise(F.avg(sub)).alias("inverse_variance"))
    return g.selectExpr("obj_id", "y", "x", "inline(array(" + ", ".join(
        f"named_struct('band', '{c}', 'flux', {c})" for c in ("sky_free_mean", "raw_mean", "inverse_variance")) + "))").select("obj_id", "band", "y", "x", "flux")


def image_metrics(px: DataFrame, value: str, side: int, in_object: str | None = None, keys=tuple(KEYS)) -> DataFrame:
    """Entropy of the 8-bit image, saturated share of the object, width of the grey-level CDF between 15 and 85 %, central
    brightness. The histogram (at most 256 rows per image) is aggregated once; entropy and CDF read it."""
    keys = list(keys)
    d = with_radius(px, side).withColumn("u8", eight_bit(value))
    inside = F.lit(True) if in_object is None else F.col(in_object)
    hist = d.groupBy(*keys, "u8").agg(F.count("*").alias("c"), F.count_if(inside).alias("obj"), F.sum(F.when(F.col("r") < CENTRAL_PX, F.col(value))).alias("central"),
                                      F.count_if(F.col("r") < CENTRAL_PX).alias("n_central"))
    w = W.partitionBy(*keys)
    hist = hist.withColumns({"n": F.sum("c").over(w), "cum": F.sum("c").over(w.orderBy("u8").rowsBetween(W.unboundedPreceding, 0))})
    p = F.col("c") / F.col("n")
    return hist.groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"), (100 * F.sum(F.when(F.col("u8") >= 255, F.col("obj")).otherwise(0)) / F.nullif(F.sum("obj"), F.lit(0))).alias("saturation_pct"),
                                   (F.min(F.when(F.col("cum") >= 0.85 * F.col("n"), F.col("u8"))) - F.min(F.when(F.col("cum") >= 0.15 * F.col("n"), F.col("u8")))).alias("cdf_width"),
                                   (F.sum("central") / F.sum("n_central")).alias("central_brightness"))


def normalization_grid(px: DataFrame, side: int, r_min: float, minimum: int = 100) -> DataFrame:
    """3 collapses x 3 intervals x 3 stretches per image, with the metrics of R06, plus a raw-flux reference row.

    The nine (interval, stretch) settings are an array exploded inside each row, not a join.
    """
    col = collapses(px, side, r_min, minimum)
    lim = F.percentile("flux", F.array(F.lit(0.0), F.lit(0.01), F.lit(0.98), F.lit(0.99), F.lit(1.0))).over(image_window())
    noise = clipped_stats(col, KEYS, F.col("flux")).select(*KEYS, F.col("sky_sigma").alias("s"))
    d = col.withColumn("q", lim).join(noise, KEYS)
    both = F.percentile("flux", F.array(F.lit(0.01), F.lit(0.99))).over(image_window())
    d = d.withColumn("q98", both)
    limits = "array(named_struct('interval', 'min_max', 'lo', q[0], 'hi', q[4]), named_struct('interval', 'central_98', 'lo', q98[0], 'hi', q98[1]), named_struct('interval', 'percentile_1_98', 'lo', q[1], 'hi', q[2]))"
    d = d.selectExpr("obj_id", "band", "y", "x", "flux", "s", f"inline({limits})").selectExpr("*", "explode(array('linear', 'log', 'asinh')) AS stretch")
    x = rescale01("flux", F.col("lo"), F.col("hi"))
    a = F.least(F.greatest(ASINH_NSIGMA * F.col("s") / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1e-4)), F.lit(1.0))
    a = F.coalesce(a, F.lit(0.1))
    norm = (F.when(F.col("stretch") == "linear", x).when(F.col("stretch") == "log", F.log1p(LOG_A * x) / F.log1p(F.lit(LOG_A)))
            .otherwise(F.asinh(x / a) / F.asinh(1 / a)))
    m = image_metrics(d.withColumn("norm", norm), "norm", side, None, ["obj_id", "band", "interval", "stretch"]).withColumnRenamed("band", "collapse")
    ref = (with_radius(col.where("band = 'sky_free_mean'"), side).where(F.col("r") < CENTRAL_PX).groupBy("obj_id").agg(F.avg("flux").alias("central_brightness"))
           .withColumns({"collapse": F.lit("reference"), "interval": F.lit("none"), "stretch": F.lit("raw flux")}))
    return m.unionByName(ref, allowMissingColumns=True)


@dataclass(frozen=True)
class AsinhScaler:
    """asinh(f / s_b) with s_b the 75th percentile of |f| over sampled train positions, then zero mean and unit population
    deviation per band. Fitting keeps three numbers per band."""

    scale: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, positions: int | None = 512, seed: int = 0) -> "AsinhScaler":
        sample = train if positions is None else train.join(sampled_positions(train, "obj_id", positions, seed), ["obj_id", "y", "x"])
        q = quantiles(sample.withColumn("_a", F.abs("flux")), ["band"], "_a", {"s": 0.75})
        scale = {r["band"]: r["s"] for r in q.collect()}
        d = train.withColumn("_t", F.asinh(F.col("flux") / cls._by_band(scale)))
        rows = d.groupBy("band").agg(F.avg("_t").alias("m"), F.stddev_pop("_t").alias("s")).collect()
        return cls(scale, {r["band"]: r["m"] for r in rows}, {r["band"]: r["s"] for r in rows})

    @staticmethod
    def _by_band(values: dict[str, float]) -> Column:
        out = None
        for b, v in sorted(values.items()):
            out = F.when(F.col("band") == b, F.lit(v)) if out is None else out.when(F.col("band") == b, F.lit(v))
        return out

    def transform(self, px: DataFrame) -> DataFrame:
        t = F.asinh(F.col("flux") / self._by_band(self.scale))
        return px.withColumn("norm", (t - self._by_band(self.mean)) / self._by_band(self.std))


def noise_stretch(flux: Column, sigma: Column, beta: float) -> Column:
    """asinh(x / (beta sigma))"""
    return F.asinh(flux / (beta * sigma))


def stretched_scale(px: DataFrame, sigma: DataFrame, beta: float, percentile: float = 0.999) -> DataFrame:
    """High percentile of the stretched train pixels per band. `sigma` has one row per band."""
    from photonloom.session import cut_lineage

    d = px.join(cut_lineage(sigma), "band").withColumn("_t", noise_stretch(F.col("flux"), F.col("sky_scale"), beta))
    return quantiles(d, ["band"], "_t", {"scale": percentile})


def colour_image(px: DataFrame, q: float = 8.0, stretch: float = 0.5) -> DataFrame:
    """(obj_id, y, x, red, green, blue) in [0, 1]."""
    d = bands_to_columns(px)
    red, green, blue = colour_map(F.col("g"), F.col("r"), F.col("z"), q, stretch)
    return d.select("obj_id", "y", "x", red.alias("red"), green.alias("green"), blue.alias("blue"))
