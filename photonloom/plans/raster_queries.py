"""Queries over the pixel table (S06, R, W11-W16, A22, A42, A43, F11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonloom.functions.draws import hash32, key_text
from photonloom.functions.scalars import r6
from photonloom.operators.raster import filters as FI
from photonloom.operators.raster import morphology as MO
from photonloom.operators.raster import normalize as NO
from photonloom.operators.raster import pixels as PX
from photonloom.operators.raster import profile as PR
from photonloom.operators.raster import segment as SE
from photonloom.operators.raster import sky as SK
from photonloom.operators.raster.measure import measure_objects
from photonloom.operators.registry import Variant
from photonloom.plans.bindings import PIXELS_SQL, SIDE, pixels, with_sql
from photonloom.plans.cohort_queries import fresh_path
from photonloom.plans.metric_queries import rounded
from photonloom.plans.registry import Tables, query
from photonloom.session import cut_lineage
from photonloom.sources import pixel_cache as PC
from photonloom.sources.sinks import guarded_write

K = ["obj_id", "band"]
R_MIN, MIN_SKY = 22.0, 40
RAD = "sqrt((y - 19.5) * (y - 19.5) + (x - 19.5) * (x - 19.5))"
RING = "(y < 4 OR y >= 36 OR x < 4 OR x >= 36)"


def clip_sql(name: str, keys: str, value: str, source: str = "pixels", rounds: int = 5) -> str:
    """Rounds of 3-sigma clipping, one CTE per round; the final CTE has sky, sky_sigma and the mean."""
    out = [f"{name}0 AS (SELECT {keys}, {value} AS v FROM {source} WHERE ({value}) IS NOT NULL)"]
    for i in range(rounds):
        out.append(f"{name}{i + 1} AS (SELECT {keys}, v FROM (SELECT *, median(v) OVER (PARTITION BY {keys}) AS m, stddev_pop(v) OVER (PARTITION BY {keys}) AS s FROM {name}{i}) WHERE abs(v - m) <= 3 * s)")
    out.append(f"{name} AS (SELECT {keys}, median(v) AS sky, stddev_pop(v) AS sky_sigma, avg(v) AS level, count(*) AS n_sky FROM {name}{rounds} GROUP BY {keys})")
    return ",\n".join(out)


BORDER_SQL = clip_sql("bg", "obj_id, band", f"CASE WHEN {RING} THEN flux END")
CORNER_SQL = clip_sql("ck", "obj_id, band", f"CASE WHEN {RAD} > {R_MIN} AND flux <> 0 THEN flux END") + f""",
cs AS (SELECT obj_id, band, CASE WHEN n_sky < {MIN_SKY} THEN 0 ELSE sky END AS sky, CASE WHEN n_sky >= {MIN_SKY} THEN sky_sigma END AS sky_sigma FROM ck)"""
SUB_SQL = "sub AS (SELECT obj_id, band, y, x, CASE WHEN flux = 0 THEN 0 ELSE flux - sky END AS flux FROM pixels JOIN cs USING (obj_id, band))"


def sky_free(t: Tables):
    px = pixels(t)
    d = px.join(SK.corner_sky(px, SIDE, R_MIN, MIN_SKY).select(*K, "sky"), K)
    return d.withColumn("flux", F.when(F.col("flux") == 0, 0.0).otherwise(F.col("flux") - F.col("sky"))).drop("sky")


@query("s06_pixel_crop", with_sql(PIXELS_SQL, body="""
SELECT obj_id, band, count(*) AS n_px, round(avg((flux = 0)::INT), 6) AS zero_fraction, round(sum(flux), 5) AS total, max(y) AS y_max FROM pixels WHERE y BETWEEN 10 AND 29 AND x BETWEEN 10 AND 29 GROUP BY obj_id, band""").replace("max(y) AS y_max", "max(y - 10) AS y_max"))
def _(t: Tables):
    d = PX.central_crop(pixels(t), SIDE, 20)
    return d.groupBy(*K).agg(F.count("*").alias("n_px"), r6(F.avg(F.when(F.col("flux") == 0, 1.0).otherwise(0.0))).alias("zero_fraction"), F.round(F.sum("flux"), 5).alias("total"), F.max("y").alias("y_max"))


@query("s06_pixel_cache", with_sql(PIXELS_SQL, "fb AS (SELECT obj_id, bool_or(flux <= 0) AS fallback FROM pixels GROUP BY obj_id)", body="""
SELECT obj_id, band, fallback, count(*) AS n_px, round(avg((CASE WHEN fallback THEN flux ELSE log10(flux) END = 0)::INT), 6) AS zero_fraction,
  round(sum(CAST(CAST(CASE WHEN fallback THEN flux ELSE log10(flux) END AS FLOAT) AS DOUBLE)), 5) AS total FROM pixels JOIN fb USING (obj_id) WHERE y BETWEEN 10 AND 29 AND x BETWEEN 10 AND 29 GROUP BY ALL"""))
def _(t: Tables):
    """Cubes are written as files, cached in chunks of two files and read back as pixels. A cube with a pixel that has no logarithm
    falls back to its raw values; here these are most, so the budget is open. Pixels that an image lacks are gaps of its cube."""
    out, root = fresh_path(t, "pixel-cache")
    layout = PC.CubeLayout(SIDE, 20, gaps=True)
    source, _ = fresh_path(t, "cubes")
    px = pixels(t)
    places = PX.frame(px, SIDE).join(px, [*K, "y", "x"], "left")
    ordered = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("band") == b, F.struct("y", "x", "flux")))), lambda s: s["flux"]).alias(b)
    guarded_write(places.groupBy("obj_id").agg(*[ordered(b) for b in layout.bands]).repartition(8, "obj_id"), source, root)
    log = Variant("log_flux", lambda px: px.withColumn("flux", F.log10(F.when(F.col("flux") > 0, F.col("flux")))), max_failed_share=1.0)
    PC.build_cache(t.spark, source, out, root, layout, log, files_per_chunk=2)
    rows = PC.bands_to_rows(PC.read_cache(t.spark, out, layout), layout.bands)
    d = PX.explode_images(rows, "image", layout.crop).where("flux IS NOT NULL").groupBy(*K).agg(F.count("*").alias("n_px"), F.round(F.sum("flux"), 5).alias("total"))
    return d.join(rows.select(*K, "fallback", r6("zero_fraction").alias("zero_fraction")), K)


@query("r01_border_background", with_sql(PIXELS_SQL, BORDER_SQL, body="""
SELECT obj_id, band, round(sky, 7) AS sky, round(sky_sigma, 6) AS sky_sigma, n_sky AS n_kept FROM bg"""))
def _(t: Tables):
    d = SK.clipped(pixels(t), K, F.when(SK.border_ring(SIDE), F.col("flux")))
    return d.groupBy(*K).agg(F.round(F.percentile("_v", F.lit(0.5)), 7).alias("sky"), r6(F.stddev_pop("_v")).alias("sky_sigma"), F.count("_v").alias("n_kept"))


@query("r02_corner_sky", with_sql(PIXELS_SQL, CORNER_SQL, body="SELECT obj_id, band, round(sky, 7) AS sky, round(sky_sigma, 6) AS sky_sigma FROM cs"))
def _(t: Tables):
    d = SK.corner_sky(pixels(t), SIDE, R_MIN, MIN_SKY)
    return d.select(*K, F.round("sky", 7).alias("sky"), r6("sky_sigma").alias("sky_sigma"))


@query("r03_percentile_normalization", with_sql(PIXELS_SQL, """q AS (SELECT obj_id, band, quantile_cont(flux, 0.005) AS lo, quantile_cont(flux, 0.995) AS hi FROM pixels GROUP BY ALL),
n AS (SELECT obj_id, band, asinh(least(1, greatest(0, (flux - lo) / greatest(hi - lo, 1e-8))) / 0.1) / asinh(1 / 0.1) AS v FROM pixels JOIN q USING (obj_id, band))""", body="""
SELECT obj_id, band, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM n GROUP BY obj_id, band"""))
def _(t: Tables):
    d = NO.percentile_normalize(pixels(t), "asinh", 0.1, 99.5)
    return d.groupBy(*K).agg(r6(F.avg("norm")).alias("mean"), r6(F.stddev_pop("norm")).alias("std"))


COLLAPSE_SQL = """cw AS (SELECT obj_id, y, x, flux, flux - sky AS s, CASE WHEN sky_sigma > 0 THEN 1 / (sky_sigma * sky_sigma) ELSE 0 END AS w FROM pixels JOIN cs USING (obj_id, band)),
cl AS (SELECT obj_id, y, x, avg(s) AS sky_free_mean, avg(flux) AS raw_mean, sum(w * s) / sum(w) AS inverse_variance FROM cw GROUP BY ALL)"""


# Means of fluxes with four decimals can lie exactly between two results of six; as decimals the half is rounded away from
# zero whatever the order in which a sum was added.
TIE_SQL = "CAST(round(CAST({} AS DECIMAL(24, 11)), 6) AS DOUBLE)"


@query("r05_band_collapses", with_sql(PIXELS_SQL, CORNER_SQL, COLLAPSE_SQL, body=" UNION ALL ".join(
    f"SELECT obj_id, '{c}' AS band, {TIE_SQL.format(f'avg({c})')} AS mean, {TIE_SQL.format(f'max({c})')} AS max, {TIE_SQL.format(f'stddev_pop({c})')} AS std FROM cl GROUP BY obj_id" for c in ("sky_free_mean", "raw_mean", "inverse_variance"))))
def _(t: Tables):
    d = NO.collapses(pixels(t), SIDE, R_MIN, MIN_SKY)
    r = lambda c: F.round(c.cast("decimal(24,11)"), 6).cast("double")
    return d.groupBy(*K).agg(r(F.avg("flux")).alias("mean"), r(F.max("flux")).alias("max"), r(F.stddev_pop("flux")).alias("std"))


@query("r06_image_metrics", with_sql(PIXELS_SQL, f"""q AS (SELECT obj_id, band, min(flux) AS lo, max(flux) AS hi FROM pixels GROUP BY ALL),
u AS (SELECT obj_id, band, {RAD} AS r, round((flux - lo) / (hi - lo), 9) AS v FROM pixels JOIN q USING (obj_id, band)),
h AS (SELECT obj_id, band, CAST(floor(v * 255) AS INTEGER) AS u8, count(*) AS c FROM u GROUP BY ALL),
c AS (SELECT *, sum(c) OVER (PARTITION BY obj_id, band) AS n, sum(c) OVER (PARTITION BY obj_id, band ORDER BY u8) AS cum FROM h),
ce AS (SELECT obj_id, band, avg(v) AS cb FROM u WHERE r < 6 GROUP BY ALL)""", body="""
SELECT obj_id, band, round(-sum(c / n * log2(c / n)), 6) AS entropy, round(100 * sum(CASE WHEN u8 >= 255 THEN c ELSE 0 END) / max(n), 6) AS saturation_pct,
  min(u8) FILTER (cum >= 0.85 * n) - min(u8) FILTER (cum >= 0.15 * n) AS cdf_width, round(max(cb), 6) AS central_brightness FROM c LEFT JOIN ce USING (obj_id, band) GROUP BY obj_id, band"""))
def _(t: Tables):
    lo, hi = F.min("flux").over(PX.image_window()), F.max("flux").over(PX.image_window())
    d = pixels(t).withColumns({"lo": lo, "hi": hi}).withColumn("v", F.round((F.col("flux") - F.col("lo")) / (F.col("hi") - F.col("lo")), 9))
    return rounded(NO.image_metrics(d, "v", SIDE), [])


@query("r04_normalization_grid")
def _(t: Tables):
    return rounded(NO.normalization_grid(pixels(t), SIDE, R_MIN, MIN_SKY), [])


GROWTH_SQL = f"""gb AS (SELECT obj_id, band, CAST(floor({RAD} / 0.5) AS INTEGER) AS bin, sum(flux) AS s, count(*) AS a FROM {{src}} GROUP BY ALL),
ge AS (SELECT DISTINCT obj_id, band, CAST(b AS INTEGER) AS bin FROM {{src}}, range(0, 57) g(b)),
gc AS (SELECT obj_id, band, bin, (bin + 1) * 0.5 AS radius, sum(coalesce(s, 0)) OVER w AS flux_cum, CAST(sum(coalesce(a, 0)) OVER w AS BIGINT) AS area_cum
  FROM ge LEFT JOIN gb USING (obj_id, band, bin) WINDOW w AS (PARTITION BY obj_id, band ORDER BY bin ROWS UNBOUNDED PRECEDING))"""


@query("w01_growth_curve", with_sql(PIXELS_SQL, GROWTH_SQL.format(src="pixels"), body="SELECT obj_id, band, bin, CAST(radius AS DOUBLE) AS radius, round(flux_cum, 5) AS flux_cum, area_cum FROM gc"))
def _(t: Tables):
    return PR.growth(pixels(t), SIDE).withColumn("flux_cum", F.round("flux_cum", 5))


def interp_sql(c: str, r: str) -> str:
    return f"({c}[least(CAST(floor(({r}) / 0.5) AS INT), 57) + 1] + ({c}[least(CAST(floor(({r}) / 0.5) AS INT) + 1, 57) + 1] - {c}[least(CAST(floor(({r}) / 0.5) AS INT), 57) + 1]) * (({r}) / 0.5 - floor(({r}) / 0.5)))"


def frac_sql(total: str, frac: float, lim: str, c: str = "cf_r") -> str:
    i = f"coalesce(list_position(list_transform({c}[1:CAST(floor(({lim}) / 0.5) AS INT) + 1], lambda f: f >= {frac} * {total}), true), 0)"
    return f"CASE WHEN {total} > 0 AND {i} >= 2 THEN ({i} - 2) * 0.5 + ({frac} * {total} - {c}[{i} - 1]) / ({c}[{i}] - {c}[{i} - 1]) * 0.5 END"


# Petrosian radii on the profile arrays: R = 2.0, 2.5, ... below 18.5 / 1.25.
PETRO_SQL = GROWTH_SQL.format(src="sub") + f""",
pr AS (SELECT obj_id, band, list_prepend(0.0::DOUBLE, list(flux_cum ORDER BY bin)) AS cf, list_prepend(0.0::DOUBLE, list(CAST(area_cum AS DOUBLE) ORDER BY bin)) AS ca FROM gc GROUP BY ALL),
pw AS (SELECT obj_id, {", ".join(f"max(cf) FILTER (band = '{b}') AS cf_{b}, max(ca) FILTER (band = '{b}') AS ca_{b}" for b in "grz")} FROM pr GROUP BY obj_id),
pq AS (SELECT *, list_transform(range(0, 26), lambda j: CASE WHEN {interp_sql('cf_r', '2.0 + j * 0.5')} / greatest({interp_sql('ca_r', '2.0 + j * 0.5')}, 1) > 0 THEN
  ({interp_sql('cf_r', '1.25 * (2.0 + j * 0.5)')} - {interp_sql('cf_r', '0.8 * (2.0 + j * 0.5)')}) / greatest({interp_sql('ca_r', '1.25 * (2.0 + j * 0.5)')} - {interp_sql('ca_r', '0.8 * (2.0 + j * 0.5)')}, 1)
  / ({interp_sql('cf_r', '2.0 + j * 0.5')} / greatest({interp_sql('ca_r', '2.0 + j * 0.5')}, 1)) END) AS q FROM pw),
pi AS (SELECT *, coalesce(list_position(list_transform(q, lambda v: coalesce(v < 0.2, false)), true), 0) AS i FROM pq),
pp AS (SELECT *, CASE WHEN i >= 2 THEN 2.0 + (i - 2) * 0.5 + (q[i - 1] - 0.2) / (q[i - 1] - q[i]) * 0.5 END AS rp FROM pi),
pa AS (SELECT *, least(2 * rp, 18.5) AS ap FROM pp),
pf AS (SELECT *, {", ".join(f"CASE WHEN ap IS NOT NULL THEN {interp_sql(f'cf_{b}', 'ap')} END AS flux_{b}" for b in "grz")}, least(1.5 * rp, 28.5) AS ext FROM pa),
pt AS (SELECT *, {interp_sql('cf_r', 'ext')} AS tot FROM pf),
ps AS (SELECT *, {", ".join(f"{frac_sql('flux_r', f, 'ap')} AS px{int(100 * f)}" for f in (0.2, 0.5, 0.8, 0.9))}, {frac_sql('flux_g', 0.5, 'ap', 'cf_g')} AS px50_g,
  {frac_sql('tot', 0.2, 'ext')} AS c20, {frac_sql('tot', 0.8, 'ext')} AS c80 FROM pt)"""


@query("r19_petrosian_photometry", with_sql(PIXELS_SQL, CORNER_SQL, SUB_SQL, PETRO_SQL, body=f"""
SELECT obj_id, round(rp, 5) AS rp_px, rp IS NOT NULL AS petro_converges, coalesce(2 * rp > 18.5, false) AS aperture_truncated, round(flux_g, 5) AS flux_g, round(flux_r, 5) AS flux_r, round(flux_z, 5) AS flux_z,
  round(px20 * 0.262, 5) AS "R20", round(px50 * 0.262, 5) AS "R50", round(px80 * 0.262, 5) AS "R80", round(px90 * 0.262, 5) AS "R90", round(px50_g / px50, 5) AS "ratio_R50_g_r", round(22.5 - 2.5 * log10(flux_r), 5) AS m_r,
  round(22.5 - 2.5 * log10({interp_sql('cf_g', 'px50')}), 5) AS m_in_g, round(5 * log10(c80 / c20), 5) AS concentration FROM ps"""))
def _(t: Tables):
    d = PR.petrosian_photometry(sky_free(t), SIDE, 0.262)
    cols = ["rp_px", "flux_g", "flux_r", "flux_z", "R20", "R50", "R80", "R90", "ratio_R50_g_r", "m_r", "m_in_g", "concentration"]
    return d.select("obj_id", "petro_converges", "aperture_truncated", *[F.round(c, 5).alias(c) for c in cols])


@query("w14_isophotal_radius", with_sql(PIXELS_SQL, CORNER_SQL, SUB_SQL, f"""rg AS (SELECT obj_id, band, floor({RAD} / 2) AS ring, avg(flux) AS f FROM sub WHERE {RAD} < 20 GROUP BY ALL)""", body="""
SELECT obj_id, band, round((max(ring + 1) FILTER (22.5 - 2.5 * log10(greatest(f, 1e-12) / (0.262 * 0.262)) < 21.0)) * 2.0 * 0.262, 6) AS r_iso FROM rg GROUP BY obj_id, band"""))
def _(t: Tables):
    return rounded(PR.isophotal_radius(sky_free(t), SIDE, 0.262, 21.0, 18.5), [])


@query("r38_half_light_radius", with_sql(PIXELS_SQL, f"""s AS (SELECT *, {RAD} AS r FROM pixels),
k AS (SELECT obj_id, band, median(flux) AS m FROM s WHERE r > 18 GROUP BY ALL),
c AS (SELECT obj_id, band, r, sum(flux - m) OVER (PARTITION BY obj_id, band ORDER BY r, y, x ROWS UNBOUNDED PRECEDING) AS c FROM s JOIN k USING (obj_id, band) WHERE r <= 17.2),
d AS (SELECT *, max(c) OVER (PARTITION BY obj_id, band) AS top FROM c)""", body="""
SELECT obj_id, band, round(least(greatest(coalesce(min(r) FILTER (c >= 0.5 * greatest(top, 1e-12)), min(r)), 1.0), 17.2), 6) AS r50_px FROM d GROUP BY obj_id, band"""))
def _(t: Tables):
    """W15/R38"""
    return rounded(PR.half_light_radius(pixels(t), SIDE), [])


AZ_SQL = f"""az AS (SELECT obj_id, band, CAST(floor({RAD}) AS INTEGER) AS ring, avg(flux) AS mean, count(*) AS n FROM pixels GROUP BY ALL),
ap AS (SELECT obj_id, band, ring, mean, n, CAST(row_number() OVER (PARTITION BY obj_id, band ORDER BY ring) - 1 AS INTEGER) AS index FROM (
  SELECT *, min(ring) OVER (PARTITION BY obj_id, band) AS lo, max(ring) OVER (PARTITION BY obj_id, band) AS hi FROM az) WHERE ring > lo AND ring < hi)"""


@query("w11_azimuthal_profile", with_sql(PIXELS_SQL, AZ_SQL, body="SELECT obj_id, band, ring, index, n, round(mean, 6) AS mean FROM ap"))
def _(t: Tables):
    return PR.azimuthal_profile(pixels(t), SIDE).select(*K, "ring", "index", "n", r6("mean").alias("mean"))


@query("r44_radial_gradient", with_sql(PIXELS_SQL, AZ_SQL, """p AS (SELECT obj_id, band, list(mean ORDER BY index) AS p, 0.23 + 0.05 * (obj_id % 7) AS k FROM ap GROUP BY ALL),
g AS (SELECT *, 5.0 / k AS pos FROM p)""", body="""
SELECT obj_id, band, round(CASE WHEN (len(p) - 1) * k >= 5 THEN p[CAST(floor(pos) AS INT) + 1] + (p[CAST(floor(pos) AS INT) + 2] - p[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos)) - p[1] END, 6) AS gradient FROM g"""))
def _(t: Tables):
    scale = pixels(t).groupBy("obj_id").agg((0.23 + 0.05 * F.max(F.col("obj_id") % 7)).alias("kpc_per_px"))
    return rounded(PR.radial_gradient(PR.azimuthal_profile(pixels(t), SIDE), scale, 5.0), [])


@query("a42_robust_ring_scale", with_sql(PIXELS_SQL, f"""rv AS (SELECT obj_id, band, flux AS v FROM pixels WHERE {RAD} > 18 AND flux <> 0),
rm AS (SELECT obj_id, band, median(v) AS m FROM rv GROUP BY ALL),
rs AS (SELECT obj_id, band, 1.4826 * median(abs(v - m)) AS scale FROM rv JOIN rm USING (obj_id, band) GROUP BY ALL)""", body="""
SELECT r.obj_id, r.band, round(r.scale, 7) AS scale, round(g.sky_scale, 7) AS sky_scale FROM rs r JOIN (SELECT band, median(scale) AS sky_scale FROM rs GROUP BY band) g USING (band)"""))
def _(t: Tables):
    """A42 and A43."""
    s = SK.robust_ring_scale(pixels(t), SIDE)
    g = SK.global_sky_scale(s)
    return s.join(g, "band").select(*K, F.round("scale", 7).alias("scale"), F.round("sky_scale", 7).alias("sky_scale"))


@query("r45_ring_median_subtraction", with_sql(PIXELS_SQL, f"""m AS (SELECT obj_id, band, median(flux) AS m FROM pixels WHERE {RAD} > 20 AND flux <> 0 GROUP BY ALL)""", body="""
SELECT obj_id, band, round(sum(CASE WHEN flux <> 0 THEN flux - m ELSE 0 END), 5) AS total, count(*) FILTER (flux = 0) AS n_zero FROM pixels JOIN m USING (obj_id, band) GROUP BY obj_id, band"""))
def _(t: Tables):
    px = pixels(t).withColumn("raw", F.col("flux"))
    return SK.subtract_ring_median(px, SIDE, 20.0).groupBy(*K).agg(F.round(F.sum("flux"), 5).alias("total"), F.count_if(F.col("raw") == 0).alias("n_zero"))


@query("r35_border_std", with_sql(PIXELS_SQL, body="SELECT obj_id, round(stddev_samp(flux), 6) AS border_std FROM pixels WHERE y < 5 OR y >= 35 OR x < 5 OR x >= 35 GROUP BY obj_id"))
def _(t: Tables):
    return rounded(SK.border_std(pixels(t), SIDE, 5), [])


@query("r29_input_audit", with_sql(PIXELS_SQL, body="""
SELECT obj_id, band, count(*) FILTER (flux IS NULL OR NOT isfinite(flux)) AS n_not_finite, max(abs(flux)) = 0 AS all_zero, round(100 * avg((flux = 0)::INT), 6) AS zero_pct, round(100 * avg((flux < 0)::INT), 6) AS negative_pct,
  sha256(string_agg(printf('%.6f', flux), '|' ORDER BY y, x)) AS content_hash FROM pixels GROUP BY obj_id, band"""))
def _(t: Tables):
    return rounded(PX.input_audit(pixels(t)), [])


@query("r33_mean_of_symmetries", with_sql(PIXELS_SQL, """v AS (SELECT obj_id, band, y, x, flux FROM pixels UNION ALL SELECT obj_id, band, 39 - x, y, flux FROM pixels UNION ALL SELECT obj_id, band, 39 - y, 39 - x, flux FROM pixels
  UNION ALL SELECT obj_id, band, x, 39 - y, flux FROM pixels UNION ALL SELECT obj_id, band, y, 39 - x, flux FROM pixels UNION ALL SELECT obj_id, band, x, y, flux FROM pixels UNION ALL SELECT obj_id, band, 39 - y, x, flux FROM pixels
  UNION ALL SELECT obj_id, band, 39 - x, 39 - y, flux FROM pixels)""", body="SELECT obj_id, band, y, x, round(avg(flux), 5) AS flux FROM v GROUP BY obj_id, band, y, x").replace("round(avg(flux), 5)", "round(avg(flux), 7)"))
def _(t: Tables):
    return PX.mean_over_views(pixels(t), SIDE).withColumn("flux", F.round("flux", 7))


@query("r34_degraded_resolution", with_sql(PIXELS_SQL, """d AS (SELECT obj_id, band, avg(flux) OVER (PARTITION BY obj_id, band, y // 4, x // 4) AS f FROM pixels)""", body="""
SELECT obj_id, band, round(stddev_pop(f), 6) AS std, round(max(f), 8) AS max FROM d GROUP BY obj_id, band"""))
def _(t: Tables):
    return PX.degrade(pixels(t), SIDE, 4).groupBy(*K).agg(r6(F.stddev_pop("flux")).alias("std"), F.round(F.max("flux"), 8).alias("max"))


@query("r37_occlusion", with_sql(PIXELS_SQL, f"""o AS (SELECT obj_id, CASE WHEN band = 'g' THEN 0 ELSE flux END AS no_g, CASE WHEN {RAD} / 5.0 >= 0.5 AND {RAD} / 5.0 < 1.5 THEN 0 ELSE flux END AS no_ring FROM pixels)""", body="""
SELECT obj_id, round(sum(no_g), 5) AS without_g, round(sum(no_ring), 5) AS without_ring FROM o GROUP BY obj_id"""))
def _(t: Tables):
    px = PX.with_radius(pixels(t), SIDE)
    a = PX.occlude_band(px, "g").groupBy("obj_id").agg(F.round(F.sum("flux"), 5).alias("without_g"))
    b = PX.occlude_ring(px, F.col("r") / 5.0, 0.5, 1.5).groupBy("obj_id").agg(F.round(F.sum("flux"), 5).alias("without_ring"))
    return a.join(b, "obj_id")


@query("r47_map_correlation", with_sql(PIXELS_SQL, body="""
SELECT a.obj_id, a.band, round(corr(a.flux, b.flux), 6) AS corr FROM pixels a LEFT JOIN pixels b ON a.obj_id = b.obj_id AND a.band = b.band AND b.y = 39 - a.y AND b.x = 39 - a.x GROUP BY ALL"""))
def _(t: Tables):
    return rounded(PX.map_correlation(pixels(t), SIDE), [])


@query("r18_symmetric_fill", with_sql(PIXELS_SQL, """m AS (SELECT *, flux < 0.03 OR (y BETWEEN 3 AND 9 AND x BETWEEN 28 AND 34) AS missing FROM pixels)""", body="""
SELECT a.obj_id, a.band, round(sum(CASE WHEN NOT a.missing THEN a.flux WHEN NOT b.missing THEN b.flux ELSE 0 END), 5) AS total, count(*) FILTER (a.missing) AS n_missing, count(*) FILTER (a.missing AND coalesce(b.missing, true)) AS n_zero
FROM m a LEFT JOIN m b ON a.obj_id = b.obj_id AND a.band = b.band AND b.y = 39 - a.y AND b.x = 39 - a.x GROUP BY ALL"""))
def _(t: Tables):
    d = pixels(t).withColumn("missing", F.expr("flux < 0.03 OR (y BETWEEN 3 AND 9 AND x BETWEEN 28 AND 34)")).withColumn("raw", F.col("flux"))
    f = PX.symmetric_fill(d, SIDE, "missing")
    return f.groupBy(*K).agg(F.round(F.sum("flux"), 5).alias("total"), F.count_if("missing").alias("n_missing"), F.count_if(F.col("missing") & (F.col("flux") == 0)).alias("n_zero"))


@query("r42_replace_outside", with_sql(PIXELS_SQL, CORNER_SQL, body=f"""
SELECT obj_id, band, round(sum(CASE WHEN {RAD} <= 9 THEN flux ELSE sky END), 5) AS total FROM pixels JOIN cs USING (obj_id, band) GROUP BY obj_id, band"""))
def _(t: Tables):
    px = pixels(t)
    d = PX.with_radius(px, SIDE).join(SK.corner_sky(px, SIDE, R_MIN, MIN_SKY).select(*K, "sky"), K).withColumn("in_mask", F.col("r") <= 9)
    return PX.replace_outside(d, "in_mask", "sky").groupBy(*K).agg(F.round(F.sum("flux"), 5).alias("total"))


GAUSS = FI.gaussian_kernel(1.0)
GAUSS_SQL = "kr(j, w) AS (VALUES " + ", ".join(f"({j - len(GAUSS) // 2}, {w!r})" for j, w in enumerate(GAUSS)) + """),
rx AS (SELECT p.obj_id, p.band, p.y, c.x, sum(k.w * p.flux) AS v FROM (SELECT x FROM range(0, 40) g(x)) c CROSS JOIN kr k JOIN pixels p ON p.x = (CASE WHEN c.x + k.j < 0 THEN -1 - c.x - k.j WHEN c.x + k.j > 39 THEN 79 - c.x - k.j ELSE c.x + k.j END) GROUP BY ALL),
gs AS (SELECT p.obj_id, p.band, CAST(c.y AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x, sum(k.w * p.v) AS smooth FROM (SELECT x AS y FROM range(0, 40) g(x)) c CROSS JOIN kr k JOIN rx p ON p.y = (CASE WHEN c.y + k.j < 0 THEN -1 - c.y - k.j WHEN c.y + k.j > 39 THEN 79 - c.y - k.j ELSE c.y + k.j END) GROUP BY ALL)"""


@query("r12_gaussian_smoothing", with_sql(PIXELS_SQL, GAUSS_SQL, body="SELECT obj_id, band, y, x, round(smooth, 8) AS smooth FROM gs"))
def _(t: Tables):
    return FI.gaussian(pixels(t), SIDE, 1.0).withColumn("smooth", F.round("smooth", 8)).select(*K, "y", "x", "smooth")


@query("r27_structure_scalars", with_sql(PIXELS_SQL, GAUSS_SQL, f"""mm AS (SELECT p.*, {RAD.replace('y', 'p.y').replace('x', 'p.x')} <= 10 AS m FROM pixels p)""", body="""
SELECT a.obj_id, a.band, round(sum(CASE WHEN a.m THEN abs(a.flux - b.flux) ELSE 0 END) / greatest(sum(CASE WHEN a.m THEN a.flux ELSE 0 END), 1e-8), 6) AS asymmetry,
  round(sum(CASE WHEN a.m THEN greatest(a.flux - s.smooth, 0) ELSE 0 END) / greatest(sum(CASE WHEN a.m THEN a.flux ELSE 0 END), 1e-8), 6) AS clumpiness
FROM mm a LEFT JOIN mm b ON a.obj_id = b.obj_id AND a.band = b.band AND b.y = 39 - a.y AND b.x = 39 - a.x JOIN gs s ON s.obj_id = a.obj_id AND s.band = a.band AND s.y = a.y AND s.x = a.x GROUP BY ALL"""))
def _(t: Tables):
    px = PX.with_radius(pixels(t), SIDE).withColumn("in_mask", F.col("r") <= 10).drop("r")
    a = MO.asymmetry_map(px, SIDE, "in_mask")
    c = MO.clumpiness_map(px, SIDE, "in_mask", 1.0)
    flux = F.greatest(F.sum(F.when(F.col("in_mask"), F.col("flux")).otherwise(0.0)), F.lit(1e-8))
    return (a.groupBy(*K).agg(r6(F.sum("value") / flux).alias("asymmetry")).join(c.groupBy(*K).agg(r6(F.sum("value") / flux).alias("clumpiness")), K))


@query("r13_running_median", with_sql(PIXELS_SQL, f"""o AS (SELECT a.i AS dy, b.i AS dx FROM range(-2, 3) a(i), range(-2, 3) b(i)),
nb AS (SELECT obj_id, band, y, x, least({SIDE - 1}, greatest(0, y + dy)) AS ny, least({SIDE - 1}, greatest(0, x + dx)) AS nx FROM pixels, o)""", body="""
SELECT nb.obj_id, nb.band, nb.y, nb.x, median(coalesce(flux, 0)) AS smooth FROM nb LEFT JOIN pixels p ON p.obj_id = nb.obj_id AND p.band = nb.band AND p.y = ny AND p.x = nx GROUP BY ALL"""))
def _(t: Tables):
    return FI.median_filter(pixels(t), SIDE, 5)


@query("r13_box_mean", with_sql(PIXELS_SQL, """sz AS (SELECT DISTINCT obj_id, CAST(2 + obj_id % 3 AS INTEGER) AS k FROM pixels),
o AS (SELECT obj_id, k, unnest(range(-(k // 2), k - k // 2)) AS j FROM sz),
bx AS (SELECT p.obj_id, p.band, p.y, c.x, avg(p.flux) AS v FROM o JOIN (SELECT x FROM range(0, 40) g(x)) c ON true JOIN pixels p ON p.obj_id = o.obj_id AND p.x = (CASE WHEN c.x + o.j < 0 THEN -1 - c.x - o.j WHEN c.x + o.j > 39 THEN 79 - c.x - o.j ELSE c.x + o.j END) GROUP BY ALL),
by_ AS (SELECT p.obj_id, p.band, CAST(c.x AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x, avg(p.v) AS smooth FROM o JOIN (SELECT x FROM range(0, 40) g(x)) c ON true JOIN bx p ON p.obj_id = o.obj_id AND p.y = (CASE WHEN c.x + o.j < 0 THEN -1 - c.x - o.j WHEN c.x + o.j > 39 THEN 79 - c.x - o.j ELSE c.x + o.j END) GROUP BY ALL)""",
    body="SELECT obj_id, band, y, x, round(smooth, 8) AS smooth FROM by_"))
def _(t: Tables):
    px = pixels(t)
    sizes = px.groupBy("obj_id").agg((2 + F.max(F.col("obj_id") % 3)).cast("int").alias("k"))
    return FI.box_mean(px, sizes, SIDE, 4).withColumn("smooth", F.round("smooth", 8))


SEG_SQL = "sg AS (SELECT * FROM pixels WHERE band = 'r' AND flux > 0.35)"


def bright(t: Tables):
    return pixels(t).where("band = 'r'").withColumn("seg", F.col("flux") > 0.35)


@query("r24_gini", with_sql(PIXELS_SQL, SEG_SQL, """i AS (SELECT obj_id, abs(flux) AS a, row_number() OVER (PARTITION BY obj_id ORDER BY abs(flux), y, x) AS i, count(*) OVER (PARTITION BY obj_id) AS n FROM sg)""", body="""
SELECT obj_id, 'r' AS band, round(sum((2 * i - n - 1) * a) / ((max(n) - 1) * sum(a)), 6) AS gini FROM i GROUP BY obj_id"""))
def _(t: Tables):
    return rounded(MO.gini(bright(t)), [])


@query("r25_m20", with_sql(PIXELS_SQL, SEG_SQL, """c AS (SELECT obj_id, sum(flux) AS tot, sum(flux * x) / sum(flux) AS xc, sum(flux * y) / sum(flux) AS yc FROM sg GROUP BY 1),
d AS (SELECT s.obj_id, flux, tot, flux * ((x - xc) * (x - xc) + (y - yc) * (y - yc)) AS m, coalesce(sum(flux) OVER (PARTITION BY s.obj_id ORDER BY flux DESC, y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sg s JOIN c USING (obj_id))""", body="""
SELECT obj_id, 'r' AS band, round(log10(sum(m) FILTER (before < 0.2 * tot) / sum(m)), 6) AS m20 FROM d GROUP BY obj_id"""))
def _(t: Tables):
    return rounded(MO.m20(bright(t)), [])


@query("r26_shape", with_sql(PIXELS_SQL, SEG_SQL, """c AS (SELECT obj_id, sum(flux * x) / sum(flux) AS xc, sum(flux * y) / sum(flux) AS yc FROM sg GROUP BY 1),
m AS (SELECT obj_id, sum(flux * (x - xc) * (x - xc)) / sum(flux) AS mxx, sum(flux * (y - yc) * (y - yc)) / sum(flux) AS myy, sum(flux * (x - xc) * (y - yc)) / sum(flux) AS mxy FROM sg JOIN c USING (obj_id) GROUP BY obj_id),
e AS (SELECT *, (mxx + myy) / 2 AS h, sqrt(((mxx - myy) / 2) * ((mxx - myy) / 2) + mxy * mxy) AS rt FROM m)""", body="""
SELECT obj_id, 'r' AS band, round(sqrt(greatest(h - rt, 0) / (h + rt)), 6) AS axis_ratio, round(0.5 * atan2(2 * mxy, mxx - myy), 6) AS angle FROM e"""))
def _(t: Tables):
    return rounded(MO.shape(bright(t)), [])


COMPONENTS_SQL = """nb(a, b) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
fl AS (SELECT obj_id, y, x, CAST(y * 40 + x + 1 AS INTEGER) AS p FROM pixels WHERE band = 'r' AND flux > {thr}),
ed AS (SELECT f.obj_id, f.p, g.p AS q FROM fl f, nb JOIN fl g ON g.obj_id = f.obj_id AND g.y = f.y + nb.a AND g.x = f.x + nb.b),
reach AS (SELECT obj_id, p, p AS root FROM fl UNION SELECT r.obj_id, e.q, r.root FROM reach r JOIN ed e ON e.obj_id = r.obj_id AND e.p = r.p WHERE r.root < e.q),
lb AS (SELECT obj_id, p, min(root) AS label FROM reach GROUP BY ALL)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("r08_connected_components", recursive(with_sql(PIXELS_SQL, COMPONENTS_SQL.format(thr=0.25), body="""
SELECT obj_id, label, count(*) AS n_px FROM lb GROUP BY obj_id, label""")))
def _(t: Tables):
    d = pixels(t).where("band = 'r'").withColumn("_b", F.col("flux") > 0.25)
    return SE.components(d, SIDE, "_b").groupBy("obj_id", "label").agg(F.count("*").alias("n_px"))


@query("r07_threshold_mask", recursive(with_sql(PIXELS_SQL, BORDER_SQL, """nb(a, b) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
bn AS (SELECT p.obj_id, p.band, p.y, p.x, p.flux > sky + 3 * sky_sigma AS b FROM pixels p JOIN bg USING (obj_id, band)),
ce AS (SELECT obj_id, band, y, x FROM bn WHERE b AND y = 20 AND x = 20 UNION SELECT k.obj_id, k.band, k.y, k.x FROM ce c, nb JOIN bn k ON k.obj_id = c.obj_id AND k.band = c.band AND k.y = c.y + nb.a AND k.x = c.x + nb.b WHERE k.b),
mk AS (SELECT n.obj_id, n.band, n.y, n.x, c.y IS NOT NULL AS m FROM bn n LEFT JOIN ce c ON c.obj_id = n.obj_id AND c.band = n.band AND c.y = n.y AND c.x = n.x),
op AS (SELECT obj_id, band, y, x FROM mk WHERE NOT m AND (y IN (0, 39) OR x IN (0, 39)) UNION SELECT k.obj_id, k.band, k.y, k.x FROM op o, nb JOIN mk k ON k.obj_id = o.obj_id AND k.band = o.band AND k.y = o.y + nb.a AND k.x = o.x + nb.b WHERE NOT k.m),
fl AS (SELECT m.obj_id, m.band, o.y IS NULL AS f FROM mk m LEFT JOIN op o ON o.obj_id = m.obj_id AND o.band = m.band AND o.y = m.y AND o.x = m.x)""", body="""
SELECT obj_id, band, count(*) FILTER (f) AS area_px, round(avg(f::INT), 6) AS mask_fraction FROM fl GROUP BY obj_id, band""")))
def _(t: Tables):
    d = SE.threshold_segmentation(pixels(t), SIDE, 3.0, 10)
    return d.groupBy(*K).agg(F.count_if("in_mask").alias("area_px"), r6(F.avg(F.col("in_mask").cast("double"))).alias("mask_fraction"))


@query("r10_hole_filling", recursive(with_sql(PIXELS_SQL, """nb(a, b) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
mk AS (SELECT obj_id, y, x, abs(sqrt((y - 19.5) * (y - 19.5) + (x - 19.5) * (x - 19.5)) - 6) < 1.2 OR flux > 1.9 AS m FROM pixels WHERE band = 'r'),
op AS (SELECT obj_id, y, x FROM mk WHERE NOT m AND (y IN (0, 39) OR x IN (0, 39)) UNION SELECT k.obj_id, k.y, k.x FROM op o, nb JOIN mk k ON k.obj_id = o.obj_id AND k.y = o.y + nb.a AND k.x = o.x + nb.b WHERE NOT k.m)""", body="""
SELECT obj_id, count(*) FILTER (m) AS before_px, count(*) - (SELECT count(*) FROM op WHERE op.obj_id = mk.obj_id) AS after_px FROM mk GROUP BY obj_id""")))
def _(t: Tables):
    d = pixels(t).where("band = 'r'").withColumn("m", F.expr("abs(sqrt((y - 19.5D) * (y - 19.5D) + (x - 19.5D) * (x - 19.5D)) - 6) < 1.2D OR flux > 1.9D"))
    f = SE.fill_holes(d.withColumn("raw", F.col("m")), SIDE, "m")
    return f.groupBy("obj_id").agg(F.count_if("raw").alias("before_px"), F.count_if("m").alias("after_px"))


@query("r11_dilation", with_sql(PIXELS_SQL, """fl AS (SELECT obj_id, band, y, x FROM pixels WHERE flux > 0.8)""", body="""
SELECT p.obj_id, p.band, count(*) AS grown_px FROM pixels p WHERE EXISTS (SELECT 1 FROM fl WHERE fl.obj_id = p.obj_id AND fl.band = p.band AND abs(fl.y - p.y) + abs(fl.x - p.x) <= 2) GROUP BY p.obj_id, p.band"""))
def _(t: Tables):
    d = SE.dilate(pixels(t).withColumn("m", F.col("flux") > 0.8), SIDE, "m", 2)
    return d.where("m").groupBy(*K).agg(F.count("*").alias("grown_px"))


def sources_sql(flagged: str) -> str:
    """Eight-connected sources of at least five pixels of the table `flagged` (obj_id, y, x); labels spread from pixels without a smaller neighbour."""
    return f"""n8(a, b) AS (SELECT * FROM range(-1, 2) g(a), range(-1, 2) h(b) WHERE a <> 0 OR b <> 0),
fl AS (SELECT obj_id, y, x, CAST(y * 40 + x + 1 AS INTEGER) AS p FROM {flagged}),
ed AS (SELECT f.obj_id, f.p, g.p AS q FROM fl f, n8 JOIN fl g ON g.obj_id = f.obj_id AND g.y = f.y + n8.a AND g.x = f.x + n8.b),
reach AS (SELECT obj_id, p, p AS root FROM fl WHERE (obj_id, p) NOT IN (SELECT obj_id, p FROM ed WHERE q < p) UNION SELECT r.obj_id, e.q, r.root FROM reach r JOIN ed e ON e.obj_id = r.obj_id AND e.p = r.p WHERE r.root < e.q),
lb AS (SELECT obj_id, p, min(root) AS label FROM reach GROUP BY ALL),
so AS (SELECT obj_id, y, x, p, label FROM lb JOIN fl USING (obj_id, p) QUALIFY count(*) OVER (PARTITION BY obj_id, label) >= 5)"""


@query("r14_neighbour_sources", recursive(with_sql(PIXELS_SQL, BORDER_SQL, "det AS (SELECT obj_id, y, x FROM pixels JOIN bg USING (obj_id, band) WHERE band = 'r' AND flux - sky > 3 * sky_sigma)", sources_sql("det"), """
ot AS (SELECT s.* FROM so s LEFT JOIN (SELECT obj_id, label AS centre FROM so WHERE y = 20 AND x = 20) c USING (obj_id) WHERE centre IS NULL OR label <> centre),
gr AS (SELECT DISTINCT obj_id, y + a AS y, x + b AS x FROM ot, range(-3, 4) g(a), range(-3, 4) h(b) WHERE abs(a) + abs(b) <= 3 AND y + a BETWEEN 0 AND 39 AND x + b BETWEEN 0 AND 39)""", body="""
SELECT obj_id, coalesce(masked_px, 0) AS masked_px, coalesce(n_sources, 0) AS n_sources, coalesce(source_px, 0) AS source_px FROM (SELECT DISTINCT obj_id FROM pixels)
LEFT JOIN (SELECT obj_id, count(*) AS masked_px FROM gr GROUP BY obj_id) USING (obj_id) LEFT JOIN (SELECT obj_id, count(DISTINCT label) AS n_sources, count(*) AS source_px FROM ot GROUP BY obj_id) USING (obj_id)""")))
def _(t: Tables):
    """The mask is grown over the whole frame of an image, places whose pixel is lacking included."""
    px = pixels(t).where("band = 'r'")
    px = PX.frame(px, SIDE).join(px, [*K, "y", "x"], "left")
    n = SE.neighbour_sources(px, SIDE).groupBy("obj_id").agg(F.countDistinct("label").alias("n_sources"), F.count("*").alias("source_px"))
    grown = SE.neighbour_mask(px, SIDE).groupBy("obj_id").agg(F.count_if("is_neighbour").alias("masked_px"))
    return grown.join(n, "obj_id", "left").fillna(0)


def th90(t: Tables):
    return pixels(t).select("obj_id").distinct().select("obj_id", F.lit(2.2).alias("th90"))


def report_of(t: Tables):
    px = cut_lineage(pixels(t))
    masks = cut_lineage(SE.candidate_masks(px, SIDE, 0.262, 2.0, 1.0, 1, 21.0))
    return SE.mask_report(px, masks, th90(t), SIDE, 0.262, 2.0, 21.0)


@query("r17_mask_report")
def _(t: Tables):
    """Candidate masks, then their report."""
    return rounded(report_of(t), [])


@query("a22_mask_summary")
def _(t: Tables):
    return rounded(SE.mask_summary(report_of(t)), [])


G15 = FI.gaussian_kernel(1.5)
G15_SQL = f"""g15(j, w) AS (VALUES {", ".join(f"({i - len(G15) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(G15))}),
im AS (SELECT obj_id, y, x, flux - sky AS flux, sky_sigma FROM pixels JOIN bg USING (obj_id, band) WHERE band = 'r'),
sx AS (SELECT obj_id, y, x - j AS x, sum(w * flux) AS v FROM im, g15 WHERE x - j BETWEEN 0 AND 39 GROUP BY ALL),
sg AS (SELECT obj_id, y - j AS y, x, sum(w * v) AS smooth FROM sx, g15 WHERE y - j BETWEEN 0 AND 39 GROUP BY ALL)"""


@query("r41_nearest_source_mask", recursive(with_sql(PIXELS_SQL, BORDER_SQL, G15_SQL, clip_sql("sl", "obj_id", "smooth", "sg", 10),
    "det AS (SELECT obj_id, y, x FROM sg JOIN im USING (obj_id, y, x) JOIN sl USING (obj_id) WHERE smooth > level + 1.5 * im.sky_sigma)", sources_sql("det"), """
ob AS (SELECT s.* FROM so s JOIN (SELECT obj_id, arg_min(label, (d, label)) AS label FROM (SELECT obj_id, label, pow(avg(y) - 19.5, 2) + pow(avg(x) - 19.5, 2) AS d FROM so GROUP BY obj_id, label) GROUP BY obj_id) USING (obj_id, label)),
nb(a, b) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
mk AS (SELECT i.obj_id, i.y, i.x, o.p IS NOT NULL AS m FROM im i LEFT JOIN ob o USING (obj_id, y, x)),
op AS (SELECT obj_id, y, x FROM mk WHERE NOT m AND (y IN (0, 39) OR x IN (0, 39)) UNION SELECT k.obj_id, k.y, k.x FROM op o, nb JOIN mk k ON k.obj_id = o.obj_id AND k.y = o.y + nb.a AND k.x = o.x + nb.b WHERE NOT k.m),
fd AS (SELECT m.obj_id, m.y, m.x, o.y IS NULL AS inside FROM mk m LEFT JOIN op o ON o.obj_id = m.obj_id AND o.y = m.y AND o.x = m.x)""", body="""
SELECT obj_id, count(*) FILTER (inside) AS object_px, count(*) FILTER (s.p IS NOT NULL AND NOT inside) AS other_px FROM fd LEFT JOIN so s USING (obj_id, y, x) GROUP BY obj_id""")))
def _(t: Tables):
    px = pixels(t).where("band = 'r'")
    d = px.join(SK.border_background(px, SIDE), K)
    d = SE.nearest_source_mask(d.withColumn("flux", F.col("flux") - F.col("sky")), SIDE, F.col("sky_sigma"), 1.5, 1.5)
    return d.groupBy("obj_id").agg(F.count_if("in_object").alias("object_px"), F.count_if("in_other").alias("other_px"))


SIZES_SQL = """sz AS (SELECT DISTINCT obj_id, 5.0 + (obj_id % 5) * 0.5 AS rp_px, 0.01 AS sky_sigma FROM pixels)"""


def sizes(t: Tables):
    return pixels(t).groupBy("obj_id").agg((5.0 + F.max(F.col("obj_id") % 5) * 0.5).alias("rp_px")).withColumn("sky_sigma", F.lit(0.01))


@query("r21_asymmetry", with_sql(PIXELS_SQL, SIZES_SQL, """sh AS (SELECT a AS sy, b AS sx FROM range(-3, 4) g(a), range(-3, 4) h(b)),
im AS (SELECT * FROM pixels WHERE band = 'r'),
dd AS (SELECT p.obj_id, sy, sx, p.flux, p.y, p.x, sky_sigma FROM im p JOIN sz USING (obj_id), sh WHERE sqrt((p.y - (19.5 + sy / 2.0)) * (p.y - (19.5 + sy / 2.0)) + (p.x - (19.5 + sx / 2.0)) * (p.x - (19.5 + sx / 2.0))) < least(1.5 * rp_px, 16.5)),
aa AS (SELECT d.obj_id, sy, sx, round(sum(abs(d.flux - r.flux)) / sum(abs(d.flux)), 12) AS raw, sum(abs(d.flux)) AS den, count(*) AS area, max(sky_sigma) AS s FROM dd d JOIN im r ON r.obj_id = d.obj_id
  AND r.y = (39 + sy - d.y + 40) % 40 AND r.x = (39 + sx - d.x + 40) % 40 GROUP BY ALL),
bb AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY raw, sy, sx) AS k FROM aa)""", body="""
SELECT obj_id, 'r' AS band, round(raw - area * (2 * s / sqrt(pi())) / den, 6) AS asymmetry, CAST(sx / 2.0 AS DOUBLE) AS centre_dx, CAST(sy / 2.0 AS DOUBLE) AS centre_dy FROM bb WHERE k = 1"""))
def _(t: Tables):
    return rounded(MO.asymmetry(pixels(t).where("band = 'r'"), sizes(t), SIDE), [])


@query("r22_smoothness", with_sql(PIXELS_SQL, """im AS (SELECT * FROM pixels WHERE band = 'r'),
sz AS (SELECT DISTINCT obj_id, 2 * (5.0 + (obj_id % 5) * 0.5) AS rp, CAST(floor(0.25 * 2 * (5.0 + (obj_id % 5) * 0.5)) AS INTEGER) AS k FROM im),
o AS (SELECT obj_id, k, unnest(range(-(k // 2), k - k // 2)) AS j FROM sz),
bx AS (SELECT p.obj_id, p.y, c.x, avg(p.flux) AS v FROM o JOIN (SELECT x FROM range(0, 40) g(x)) c ON true JOIN im p ON p.obj_id = o.obj_id AND p.x = (CASE WHEN c.x + o.j < 0 THEN -1 - c.x - o.j WHEN c.x + o.j > 39 THEN 79 - c.x - o.j ELSE c.x + o.j END) GROUP BY ALL),
sm AS (SELECT p.obj_id, c.x AS y, p.x, avg(p.v) AS smooth FROM o JOIN (SELECT x FROM range(0, 40) g(x)) c ON true JOIN bx p ON p.obj_id = o.obj_id AND p.y = (CASE WHEN c.x + o.j < 0 THEN -1 - c.x - o.j WHEN c.x + o.j > 39 THEN 79 - c.x - o.j ELSE c.x + o.j END) GROUP BY ALL),
an AS (SELECT i.obj_id, i.flux, s.smooth, sz.k, sqrt((i.y - 19.5) * (i.y - 19.5) + (i.x - 19.5) * (i.x - 19.5)) AS r, sz.rp FROM im i JOIN sm s ON s.obj_id = i.obj_id AND s.y = i.y AND s.x = i.x JOIN sz ON sz.obj_id = i.obj_id)""", body="""
SELECT obj_id, 'r' AS band, round((sum(greatest(flux - smooth, 0)) - count(*) * max(0.01 * sqrt(1 - 1 / (k * k)) / sqrt(2 * pi()))) / sum(flux), 6) AS smoothness FROM an WHERE r >= 0.25 * rp AND r <= 1.5 * rp GROUP BY obj_id"""))
def _(t: Tables):
    s = sizes(t).withColumn("rp_px", 2 * F.col("rp_px"))
    return rounded(MO.smoothness(pixels(t).where("band = 'r'"), s, SIDE), [])


# The kernel of each object has its own width; the component grows from its first pixel by flood fill.
SEGMENT_SQL = """im AS (SELECT * FROM pixels WHERE band = 'r'),
kn AS (SELECT obj_id, rp_px, j, exp(-0.5 * pow(j / (0.2 * rp_px), 2)) AS w FROM sz, range(-8, 9) g(j) WHERE abs(j) <= floor(4 * 0.2 * rp_px + 0.5)),
kw AS (SELECT obj_id, j, w / sum(w) OVER (PARTITION BY obj_id) AS w FROM kn),
sx AS (SELECT p.obj_id, p.y, p.x - j AS x, sum(w * flux) AS v FROM im p JOIN kw USING (obj_id) WHERE p.x - j BETWEEN 0 AND 39 GROUP BY ALL),
sy AS (SELECT p.obj_id, p.y - j AS y, p.x, sum(w * v) AS smooth FROM sx p JOIN kw USING (obj_id) WHERE p.y - j BETWEEN 0 AND 39 GROUP BY ALL),
lv AS (SELECT obj_id, avg(smooth) AS level FROM sy JOIN sz USING (obj_id) WHERE abs(sqrt((y - 19.5) * (y - 19.5) + (x - 19.5) * (x - 19.5)) - rp_px) < 0.5 GROUP BY obj_id),
on_ AS (SELECT obj_id, y, x, smooth FROM sy JOIN lv USING (obj_id) WHERE smooth >= level),
seeds AS (SELECT obj_id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY NOT (y = 20 AND x = 20), smooth DESC, y, x) AS k FROM on_) WHERE k = 1),
fill(obj_id, y, x) AS (SELECT * FROM seeds UNION SELECT o.obj_id, o.y, o.x FROM fill f JOIN on_ o ON o.obj_id = f.obj_id AND abs(o.y - f.y) <= 1 AND abs(o.x - f.x) <= 1)"""


@query("r23_gini_segmentation", with_sql(PIXELS_SQL, SIZES_SQL, SEGMENT_SQL, body="""
SELECT i.obj_id, count(f.y) AS seg_px, round(sum(i.flux) FILTER (f.y IS NOT NULL), 6) AS seg_flux FROM im i LEFT JOIN fill f ON f.obj_id = i.obj_id AND f.y = i.y AND f.x = i.x GROUP BY i.obj_id""").replace("WITH", "WITH RECURSIVE", 1))
def _(t: Tables):
    d = MO.gini_segmentation(pixels(t).where("band = 'r'"), sizes(t), SIDE)
    return d.groupBy("obj_id").agg(F.count_if("seg").alias("seg_px"), r6(F.sum(F.when(F.col("seg"), F.col("flux")))).alias("seg_flux"))


@query("r28_clumpiness")
def _(t: Tables):
    px = PX.with_radius(pixels(t), SIDE).withColumn("in_mask", F.col("r") <= 9).drop("r")
    a = MO.clumpiness(px, SIDE, "in_mask", 2.0, R_MIN, "median", 7, min_sky=MIN_SKY)
    b = MO.clumpiness(px, SIDE, "in_mask", 2.0, R_MIN, "gaussian", sigma=3.0, min_sky=MIN_SKY).withColumnRenamed("clumpiness", "clumpiness_gaussian")
    return rounded(a.join(b, K), [])


@query("r30_asinh_scaler", with_sql(PIXELS_SQL, """ps AS (SELECT obj_id, y, x FROM (SELECT obj_id, y, x, row_number() OVER (PARTITION BY obj_id ORDER BY CAST('0x' || substr(md5(concat_ws('|', obj_id, y, x, '0')), 1, 8) AS BIGINT), y, x) AS k
  FROM pixels WHERE band = 'r') WHERE k <= 512),
sc AS (SELECT band, quantile_cont(abs(flux), 0.75) AS s FROM pixels JOIN ps USING (obj_id, y, x) GROUP BY band),
tr AS (SELECT band, asinh(flux / s) AS v, s FROM pixels JOIN sc USING (band))""", body="""
SELECT band, round(max(s), 7) AS scale, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM tr GROUP BY band"""))
def _(t: Tables):
    sc = NO.AsinhScaler.fit(pixels(t), 512, 0)
    return t.spark.createDataFrame([(b, round(sc.scale[b], 7), round(sc.mean[b], 6), round(sc.std[b], 6)) for b in sorted(sc.scale)], "band string, scale double, mean double, std double")


@query("r31_stretched_scale", with_sql(PIXELS_SQL, "st AS (SELECT band, asinh(flux / (3.0 * CASE band WHEN 'g' THEN 0.01 WHEN 'r' THEN 0.012 ELSE 0.015 END)) AS v FROM pixels)", body="SELECT band, round(quantile_cont(v, 0.999), 6) AS scale FROM st GROUP BY band"))
def _(t: Tables):
    sig = t.spark.createDataFrame([("g", 0.01), ("r", 0.012), ("z", 0.015)], "band string, sky_scale double")
    return rounded(NO.stretched_scale(pixels(t), sig, 3.0), [])


@query("f11_colour_image", with_sql(PIXELS_SQL, """w AS (SELECT obj_id, y, x, greatest(max(flux) FILTER (band = 'g'), 0) AS b, greatest(max(flux) FILTER (band = 'r'), 0) AS g, greatest(max(flux) FILTER (band = 'z'), 0) AS r FROM pixels GROUP BY ALL),
f AS (SELECT *, asinh(8 * ((r + g + b) / 3) / 0.5) / 8 / greatest((r + g + b) / 3, 1e-12) AS k FROM w),
t AS (SELECT obj_id, r * k AS r, g * k AS g, b * k AS b, greatest(r * k, g * k, b * k, 1) AS top FROM f)""", body="""
SELECT obj_id, round(avg(r / top), 6) AS red, round(avg(g / top), 6) AS green, round(avg(b / top), 6) AS blue, count(*) FILTER (top > 1) AS n_limited FROM t GROUP BY obj_id"""))
def _(t: Tables):
    d = NO.colour_image(pixels(t))
    full = F.greatest("red", "green", "blue") >= 0.999999999
    return d.groupBy("obj_id").agg(r6(F.avg("red")).alias("red"), r6(F.avg("green")).alias("green"), r6(F.avg("blue")).alias("blue"), F.count_if(full).alias("n_limited"))


@query("r39_aligned_stamp")
def _(t: Tables):
    geo = sizes(t).select("obj_id", "rp_px", (0.1 * (F.col("obj_id") % 5)).alias("pa_rad"))
    d = PX.stamp(pixels(t), geo, SIDE, 16, 1.5)
    return d.groupBy(*K).agg(F.count("flux").alias("n_px"), r6(F.avg("flux")).alias("mean"), r6(F.max("flux")).alias("max"))


def fill_sql(boxes: str) -> str:
    """All 4 x 4 boxes of every image, `fb`; one that is not in the table `boxes` is filled from its nearest ten."""
    return f"""gb AS (SELECT i.obj_id, i.band, a.b AS b_y, c.b AS b_x FROM (SELECT DISTINCT obj_id, band FROM pixels) i, range(0, 4) a(b), range(0, 4) c(b)),
nb AS (SELECT g.obj_id, g.band, g.b_y, g.b_x, m.sky, sqrt((m.b_y - g.b_y) ** 2 + (m.b_x - g.b_x) ** 2) AS d, row_number() OVER (PARTITION BY g.obj_id, g.band, g.b_y, g.b_x ORDER BY (m.b_y - g.b_y) ** 2 + (m.b_x - g.b_x) ** 2, m.b_y, m.b_x) AS k
  FROM gb g JOIN {boxes} m USING (obj_id, band)),
fb AS (SELECT obj_id, band, b_y, b_x, CASE WHEN min(d) = 0 THEN max(sky) FILTER (d = 0) ELSE sum(sky / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0) END AS sky FROM nb WHERE k <= 10 GROUP BY ALL)"""


BOX_SQL = clip_sql("bb", "obj_id, band, b_y, b_x", "flux", "(SELECT *, y // 10 AS b_y, x // 10 AS b_x FROM pixels)") + ",\n" + fill_sql("bb")


@query("r40_box_background", with_sql(PIXELS_SQL, BOX_SQL, body="""
SELECT a.obj_id, a.band, CAST(a.b_y AS INTEGER) AS box_y, CAST(a.b_x AS INTEGER) AS box_x, round(median(b.sky), 7) AS level FROM fb a JOIN fb b ON a.obj_id = b.obj_id AND a.band = b.band AND abs(a.b_y - b.b_y) <= 1 AND abs(a.b_x - b.b_x) <= 1 GROUP BY ALL"""))
def _(t: Tables):
    return SK.box_background(pixels(t), SIDE, 10).withColumn("level", F.round("level", 7)).withColumnsRenamed({"by": "box_y", "bx": "box_x"})


# Boxes inside the masked disc are filled from the others; the spline's coefficients come from an elimination.
MESH_SQL = clip_sql("mb", "obj_id, band, b_y, b_x", "CASE WHEN NOT masked THEN flux END", "(SELECT * FROM (SELECT *, avg(masked::INT) OVER (PARTITION BY obj_id, band, b_y, b_x) AS share FROM (SELECT *, y // 10 AS b_y, x // 10 AS b_x, sqrt((y - 19.5) * (y - 19.5) + (x - 19.5) * (x - 19.5)) <= 10 AS masked FROM pixels)) WHERE share <= 0.5)") + ",\n" + fill_sql("mb") + """,
lv AS (SELECT a.obj_id, a.band, a.b_y, a.b_x, median(b.sky) AS level FROM fb a JOIN fb b ON a.obj_id = b.obj_id AND a.band = b.band AND abs(a.b_y - b.b_y) <= 1 AND abs(a.b_x - b.b_x) <= 1 GROUP BY ALL),
el AS (SELECT 1 AS k, [[5, 1, 0, 0, 6, 0, 0, 0], [1, 4, 1, 0, 0, 6, 0, 0], [0, 1, 4, 1, 0, 0, 6, 0], [0, 0, 1, 5, 0, 0, 0, 6]]::DOUBLE[][] AS a UNION ALL
  SELECT k + 1, list_transform(a, lambda row, r: CASE WHEN r = k THEN list_transform(row, lambda v: v / a[k][k]) ELSE list_transform(row, lambda v, c: v - row[k] * a[k][c] / a[k][k]) END) FROM el WHERE k <= 4),
wt AS (SELECT p, b, sum(CASE WHEN abs(u - i) < 1 THEN 2 / 3.0 - (u - i) ** 2 + abs(u - i) ** 3 / 2 ELSE (2 - abs(u - i)) ** 3 / 6 END * a[CASE WHEN i < 0 THEN -i WHEN i > 3 THEN 8 - i ELSE i + 1 END][5 + b]) AS w
  FROM (SELECT p, (p + 0.5) / 10 - 0.5 AS u, CAST(floor((p + 0.5) / 10 - 0.5) AS INTEGER) + j AS i FROM range(0, 40) x(p), range(-1, 3) y(j)), range(0, 4) z(b), (SELECT a FROM el WHERE k = 5) GROUP BY p, b),
sb AS (SELECT obj_id, band, wy.p AS y, wx.p AS x, greatest(min(lo), least(max(hi), sum(wy.w * wx.w * level))) AS v FROM (SELECT *, min(level) OVER (PARTITION BY obj_id, band) AS lo, max(level) OVER (PARTITION BY obj_id, band) AS hi FROM lv) JOIN wt wy ON wy.b = b_y JOIN wt wx ON wx.b = b_x GROUP BY ALL)"""


@query("r40_smooth_background", with_sql(PIXELS_SQL, MESH_SQL, body="""
SELECT obj_id, band, count(v) AS n_px, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(sum(v * (y - x)), 4) AS tilt FROM sb GROUP BY ALL""").replace("WITH", "WITH RECURSIVE", 1))
def _(t: Tables):
    """The middle of each image is masked, so that its boxes are dropped and filled; the whole frame of an image gets a background."""
    px = PX.with_radius(pixels(t), SIDE)
    d = SK.smooth_background(PX.frame(px, SIDE), SK.box_background(px, SIDE, 10, F.col("r") <= 10), 10, SIDE)
    return d.groupBy(*K).agg(F.count("background").alias("n_px"), r6(F.min("background")).alias("min"), r6(F.max("background")).alias("max"), r6(F.avg("background")).alias("mean"),
                             F.round(F.sum(F.col("background") * (F.col("y") - F.col("x"))), 4).alias("tilt"))


@query("r46_object_measurement")
def _(t: Tables):
    d = measure_objects(pixels(t), SIDE, 0.262, R_MIN, MIN_SKY)
    cols = ["rp_px", "R_P", "R50", "R90", "m_r", "concentration", "asymmetry", "smoothness", "gini", "m20", "axis_ratio", "neighbour_share", "no_data_share", "sky_sigma_g", "sky_sigma_r", "sky_sigma_z"]
    return d.select("obj_id", "status", "reason", "n_sources", "petro_converges", *[F.round(c, 5).alias(c) for c in cols])
