"""Queries: scalar functions, lookups, neighbours and regressions (F, J11, J14, J15, M, E05, E06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonloom.functions import physics as PH
from photonloom.functions import scalars as S
from photonloom.functions.scalars import r6
from photonloom.operators import models as MD
from photonloom.operators.neighbours import nearest, weighted_neighbour_mean
from photonloom.operators.windows import with_distances
from photonloom.plans.bindings import OBJECTS_SQL, PRED_SQL, objects, pred_wide, with_sql
from photonloom.plans.metric_queries import rounded
from photonloom.plans.registry import Tables, query
from photonloom.plans.split_queries import h_sql
from photonloom.session import kept_rows


@query("f01_stretches", """WITH x AS (SELECT l_returnflag, l_linestatus, least(1.0, greatest(0.0, (l_quantity - 3) / 40)) AS v FROM lineitem)
SELECT l_returnflag, l_linestatus, round(avg(v), 6) AS linear, round(avg(asinh(v / 0.1) / asinh(1 / 0.1)), 6) AS asinh, round(avg(ln(1 + v / 0.1) / ln(1 + 1 / 0.1)), 6) AS log FROM x GROUP BY ALL""")
def _(t: Tables):
    v = S.rescale01("l_quantity", F.lit(3.0), F.lit(43.0))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(*[r6(F.avg(S.stretch01(v, m))).alias(m) for m in ("linear", "asinh", "log")])


PHOT_SQL = """ph AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS fg, l_extendedprice * 1.4 + l_quantity AS fr, l_extendedprice * 1.7 + 10 * l_quantity AS fz,
  1 + l_quantity / 10 AS R50, 2 + l_quantity / 4 AS R90, l_tax AS ebv, 0.01 + l_discount / 2 AS z FROM lineitem)"""


@query("f02_magnitudes", with_sql(PHOT_SQL, body="""
SELECT l_returnflag, round(avg(22.5 - 2.5 * log10(fg)), 6) AS mag_g, round(avg(22.5 - 2.5 * log10(fr / (0.262 * 0.262))), 6) AS sb_r, count(CASE WHEN fg - 50000 > 0 THEN 22.5 - 2.5 * log10(fg) END) AS n_valid FROM ph GROUP BY 1"""))
def _(t: Tables):
    fg = F.col("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.avg(S.magnitude(fg))).alias("mag_g"), r6(F.avg(S.surface_brightness(fg * 1.4 + F.col("l_quantity"), 0.262))).alias("sb_r"),
                                                  F.count(S.magnitude(fg - 50000)).alias("n_valid"))


GRID_SQL = """zg AS (SELECT i AS cell, 1 / sqrt(0.3 * pow(1 + i * 0.001, 3) + 0.7) AS e FROM range(0, 202) g(i)),
zs AS (SELECT cell, coalesce(0.5 * 0.001 * (e + lag(e) OVER (ORDER BY cell)), 0) AS a FROM zg),
zd AS (SELECT cell, 299792.458 / 73.0 * sum(a) OVER (ORDER BY cell ROWS UNBOUNDED PRECEDING) AS dc FROM zs)"""


@query("f04_distances", with_sql(OBJECTS_SQL, GRID_SQL, body="""
SELECT obj_id, round(5 * log10(dc * (1 + redshift)) + 25, 6) AS distance_modulus, round(dc / (1 + redshift) * 1000 * pi() / 648000, 6) AS kpc_per_arcsec FROM (
  SELECT obj_id, redshift, a.dc + (b.dc - a.dc) * (redshift / 0.001 - floor(redshift / 0.001)) AS dc FROM objects JOIN zd a ON a.cell = floor(redshift / 0.001) JOIN zd b ON b.cell = a.cell + 1 WHERE redshift > 0)"""))
def _(t: Tables):
    """Interpolated lookup on the redshift grid."""
    d = with_distances(objects(t).where("redshift > 0").select("obj_id", "redshift"), "redshift", 0.2)
    return d.select("obj_id", r6("distance_modulus").alias("distance_modulus"), r6("kpc_per_arcsec").alias("kpc_per_arcsec"))


@query("f03_physical_variables", with_sql(PHOT_SQL, GRID_SQL, """m AS (SELECT *, 22.5 - 2.5 * log10(fg) - 3.214 * ebv AS mg, 22.5 - 2.5 * log10(fr) - 2.165 * ebv AS mr, 22.5 - 2.5 * log10(fz) - 1.211 * ebv AS mz FROM ph),
dd AS (SELECT m.*, 5 * log10(dc * (1 + z)) + 25 AS dm, dc / (1 + z) * 1000 * pi() / 648000 AS sc FROM (SELECT m.*, a.dc + (b.dc - a.dc) * (z / 0.001 - floor(z / 0.001)) AS dc FROM m
  JOIN zd a ON a.cell = floor(z / 0.001) JOIN zd b ON b.cell = a.cell + 1) m),
q AS (SELECT l_returnflag, mg - mr AS g_r, mr - mz AS r_z, mr + 2.5 * log10(2 * pi() * R50 * R50) AS mu, mr - dm AS abs_r, 0.4 * (4.65 - (mr - dm)) AS lum, log10(R50 * sc) AS lr, log10(2 * pi() * R50 * sc * R50 * sc) AS area,
  0.673 * (mg - dm) - 1.108 * (mr - dm) + 0.996 AS mass FROM dd)""", body="""
SELECT l_returnflag, round(avg(g_r), 5) AS g_r, round(avg(r_z), 5) AS r_z, round(avg(mu), 5) AS mu50_r, round(avg(abs_r), 5) AS abs_r, round(avg(lum), 5) AS log_lum_r, round(avg(lr), 5) AS log_r50_kpc,
  round(avg(mass), 5) AS log_mass_phot, round(avg(lum - 0.306 + 1.097 * g_r), 5) AS log_mass_colour, round(avg(lum - area), 5) AS log_sigma_lum, round(avg(mass - area), 5) AS log_sigma_mass FROM q GROUP BY 1"""))
def _(t: Tables):
    d = t.spread("lineitem", "l_returnflag", "l_extendedprice", "l_quantity", "l_tax", "l_discount").selectExpr(
        "l_returnflag", "l_extendedprice AS fg", "l_extendedprice * 1.4D + l_quantity AS fr", "l_extendedprice * 1.7D + 10 * l_quantity AS fz", "1 + l_quantity / 10 AS R50", "2 + l_quantity / 4 AS R90",
        "l_tax AS ebv", "0.01D + l_discount / 2 AS z")
    for p in ("m", "m_in", "m_out"):
        d = d.withColumns({f"{p}_{b}": S.magnitude(F.col(f"f{b}")) for b in PH.BANDS})
    d = PH.physical_variables(with_distances(d, "z", 0.2))
    cols = ["g_r", "r_z", "mu50_r", "abs_r", "log_lum_r", "log_r50_kpc", "log_mass_phot", "log_mass_colour", "log_sigma_lum", "log_sigma_mass"]
    return d.groupBy("l_returnflag").agg(*[F.round(F.avg(c), 5).alias(c) for c in cols])


@query("f05_hubble_scale", with_sql(OBJECTS_SQL, body="SELECT obj_id, round(0.262 * (299792.0 * redshift / 70) * 1e6 / 206265 / 1e3, 6) AS kpc_per_px FROM objects WHERE redshift > 0"))
def _(t: Tables):
    return objects(t).where("redshift > 0").select("obj_id", r6(PH.hubble_kpc_per_px(F.col("redshift"), 0.262)).alias("kpc_per_px"))


@query("f07_pixel_radius", """SELECT l_orderkey, l_linenumber, greatest(CAST(round_even(20 / coalesce(nullif(abs(l_discount), 0), nullif(abs(l_tax) / 3600, 0) * 3600, 0.262), 0) AS INTEGER), 8) AS radius_px FROM lineitem""")
def _(t: Tables):
    r = S.pixel_radius(20.0, F.col("l_discount"), F.col("l_tax") / 3600, F.lit(None).cast("double"), 0.262)
    return t.lineitem.select("l_orderkey", "l_linenumber", r.alias("radius_px"))


@query("f09_power_transforms", """WITH x AS (SELECT l_returnflag, l_quantity AS v, l_quantity - 25 AS s FROM lineitem)
SELECT l_returnflag, round(avg(log10(v)), 6) AS log10, round(avg(abs(pow(10, log10(v)) - v)), 6) AS round_trip, round(avg((pow(v, 0.3) - 1) / 0.3), 6) AS box_cox, round(avg(ln(v)), 6) AS box_cox_zero,
  round(avg(CASE WHEN s >= 0 THEN (pow(s + 1, 0.7) - 1) / 0.7 ELSE -(pow(1 - s, 1.3) - 1) / 1.3 END), 6) AS yeo_johnson FROM x GROUP BY 1""")
def _(t: Tables):
    fwd, _ = S.log10_pair("l_quantity")
    _, back = S.log10_pair(fwd)
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.avg(fwd)).alias("log10"), r6(F.avg(F.abs(back - F.col("l_quantity")))).alias("round_trip"), r6(F.avg(S.box_cox("l_quantity", 0.3))).alias("box_cox"),
                                                  r6(F.avg(S.box_cox("l_quantity", 0.0))).alias("box_cox_zero"), r6(F.avg(S.yeo_johnson(F.col("l_quantity") - 25, 0.7))).alias("yeo_johnson"))


@query("f12_string_functions", """SELECT page_id, list_last(string_split(url, '/')) AS base, coalesce(regexp_extract(url, '([0-9]+)', 1), '') AS digits, starts_with(url, 'http') AS is_http,
  concat_ws('_', 'pred', 'fam' || page_id % 3, printf('s%02d', CAST(page_id % 7 AS INTEGER))) AS run FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", S.base_name("url").alias("base"), F.regexp_extract("url", "([0-9]+)", 1).alias("digits"), F.startswith("url", F.lit("http")).alias("is_http"),
                          S.run_name(F.concat(F.lit("fam"), (F.col("page_id") % 3).cast("string")), (F.col("page_id") % 7).cast("int")).alias("run"))


@query("f13_json_round_trip", """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def _(t: Tables):
    d = t.events.select("event_type", F.from_json("props", "k bigint").alias("p"))
    d = d.withColumn("text", F.to_json("p")).select("event_type", F.get_json_object("text", "$.k").cast("bigint").alias("k"))
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("f14_vector_functions", """WITH h AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)
SELECT vec_id, round(list_sum(a), 5) AS first_sum, round(list_sum(b), 5) AS second_sum, round(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] + p[2]) / 2)), 5) AS mean_sum,
  round(list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])), 6) AS dot FROM h""")
def _(t: Tables):
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    a, b = S.vector_half("embedding", True), S.vector_half("embedding", False)
    return t.embeddings.select("vec_id", F.round(total(a), 5).alias("first_sum"), F.round(total(b), 5).alias("second_sum"),
                               F.round(total(S.vector_mean(a, b)), 5).alias("mean_sum"), r6(S.dot(a, b)).alias("dot"))


@query("j15_sky_cells", """WITH m AS (SELECT CAST(floor((s_acctbal + 1000) / 500) AS BIGINT) AS cx, CAST(floor(s_nationkey / 5) AS BIGINT) AS cy, avg(s_acctbal) / 1e5 AS ebv FROM supplier GROUP BY ALL)
SELECT c_mktsegment, count(*) AS n, count(ebv) AS n_covered, round(avg(ebv), 6) AS mean_ebv FROM customer LEFT JOIN m ON cx = floor((c_acctbal + 1000) / 500) AND cy = floor(c_nationkey / 5) GROUP BY 1""")
def _(t: Tables):
    cell = lambda a, b: (F.floor((F.col(a) + 1000) / 500).alias("cx"), F.floor(F.col(b) / 5).alias("cy"))
    grid = t.supplier.groupBy(*cell("s_acctbal", "s_nationkey")).agg((F.avg("s_acctbal") / 1e5).alias("ebv"))
    d = t.customer.select("c_mktsegment", *cell("c_acctbal", "c_nationkey")).join(grid, ["cx", "cy"], "left")
    return d.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("ebv").alias("n_covered"), r6(F.avg("ebv")).alias("mean_ebv"))


KNN_SQL = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, CAST(b.label AS DOUBLE) AS label, list_distance(a.v, b.v) AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS position FROM d)"""


@query("j11_nearest_neighbours", with_sql(KNN_SQL, body="SELECT vec_id, neighbour, CAST(position AS INTEGER) AS position, round(distance, 6) AS distance FROM k WHERE position <= 15"))
def _(t: Tables):
    n = nearest(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 15, exclude_self=True)
    return n.select("vec_id", "neighbour", "position", r6("distance").alias("distance"))


@query("m05_neighbour_regression", with_sql(KNN_SQL, body="SELECT vec_id, count(*) AS n, round(sum(label / distance) / sum(1 / distance), 6) AS pred FROM k WHERE position <= 15 GROUP BY vec_id"))
def _(t: Tables):
    n = nearest(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 15, exclude_self=True)
    return weighted_neighbour_mean(n, "vec_id", "label").withColumn("pred", r6("pred"))


@query("m01_skew_transform")
def _(t: Tables):
    """Chosen transform per column; lambda is found on a grid, so no SQL statement is given (see the unit test)."""
    d = t.spread("lineitem", "l_extendedprice", "l_quantity", "l_discount").selectExpr("exp(l_quantity / 12) AS strong", "l_extendedprice AS mild", "pow(l_discount * 10, 3) - 1 AS signed", "IF(l_quantity > 49, 1.0D, 0.0D) AS indicator")
    rep = MD.SkewTransform.fit(d, d.columns).report
    return t.spark.createDataFrame(rep, "column string, skew_before double, kurtosis_before double, method string, lam double, lam_limited boolean, skew_after double")


@query("m03_vector_scores")
def _(t: Tables):
    """Scores have zero mean, unit population spread and no correlation with each other on the rows they were fitted on."""
    m = MD.VectorScores(8).fit(t.embeddings, "embedding", 64, "label")
    d = m.transform(t.embeddings).select("scores")
    cross = F.array(*[F.aggregate(F.slice("scores", 1, 8), F.lit(0.0), lambda s, v: s + v) * F.get("scores", F.lit(j)) for j in range(9)])
    s = d.select(F.posexplode(F.arrays_zip("scores", cross.alias("cross"))).alias("component", "c")).select("component", "c.scores", "c.cross")
    shares = F.array(*[F.lit(float(v)) for v in m.explained])
    # Without correlation the mean product of a score with the sum of all eight is 1; for the scalar it is the sum of its correlations.
    return s.groupBy("component").agg(F.count("*").alias("n"), F.round(F.abs(F.avg("scores")), 6).alias("mean"), r6(F.stddev_pop("scores")).alias("std"),
                                      r6(F.avg("cross")).alias("with_scores")).withColumn("explained", r6(F.get(shares, "component")))


def squared(m: str, c: str = "c") -> str:
    """SQL: the square of a symmetric matrix of lists, divided by its trace."""
    return f"""SELECT list_transform({m}, lambda r: list_transform(r, lambda v: v / list_sum(list_transform(range(1, len({m}) + 1), lambda k: {m}[k][k])))) AS {m}, {c} FROM (
  SELECT list_transform({m}, lambda a: list_transform({m}, lambda b: list_dot_product(a, b))) AS {m}, {c} FROM %s)"""


LEADING_SQL = """e AS (SELECT vec_id, CAST(label AS DOUBLE) AS label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) g(i)),
z AS (SELECT vec_id, i, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM e WINDOW w AS (PARTITION BY i)),
zl AS (SELECT vec_id, list(z ORDER BY i) AS z FROM z GROUP BY vec_id),
r AS (SELECT a.i, b.i AS j, avg(a.z * b.z) AS r FROM z a JOIN z b USING (vec_id) GROUP BY ALL),
rows_ AS (SELECT i, list(r ORDER BY j) AS r FROM r GROUP BY i),
p0 AS (SELECT list(r ORDER BY i) AS m, list(r ORDER BY i) AS c FROM rows_),
""" + ",\n".join(f"p{k + 1} AS (" + squared("m") % f"p{k}" + ")" for k in range(16)) + """,
lead AS (SELECT m, list_sum(list_transform(range(1, 65), lambda k: list_dot_product(m[k], c[k]))) AS variance FROM p16)"""


@query("m03_leading_component", with_sql(LEADING_SQL, body="""
SELECT vec_id, round(list_dot_product(z, list_transform(m, lambda a: list_dot_product(a, z))) / variance, 5) AS first_squared, round((label - lm) / ls, 6) AS scalar, round(variance / 64, 6) AS explained
FROM zl JOIN embeddings USING (vec_id), lead, (SELECT avg(label) AS lm, stddev_pop(label) AS ls FROM embeddings)"""))
def _(t: Tables):
    """The first score, squared as its sign is a convention, and the appended scalar of every row."""
    m = MD.VectorScores(4).fit(t.embeddings, "embedding", 64, "label")
    s = m.transform(t.embeddings)
    return s.select("vec_id", F.round(F.get("scores", F.lit(0)) ** 2, 5).alias("first_squared"), r6(F.get("scores", F.lit(4))).alias("scalar"), F.lit(round(float(m.explained[0]), 6)).alias("explained"))


RIDGE_SQL = """rt AS (SELECT redshift AS a, log_mstar AS b, d4000 AS y FROM objects WHERE split = 'Train' AND d4000 IS NOT NULL AND redshift > 0),
rm AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) AS n, var_pop(a) * count(*) + 10 AS saa, var_pop(b) * count(*) + 10 AS sbb, covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby FROM rt),
rc AS (SELECT ma, mb, my, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb FROM rm)"""


@query("m04_ridge", with_sql(OBJECTS_SQL, RIDGE_SQL, body="""
SELECT split, count(*) AS n, round(avg(my + wa * (redshift - ma) + wb * (log_mstar - mb)), 5) AS mean_pred, round(sqrt(avg(pow(my + wa * (redshift - ma) + wb * (log_mstar - mb) - d4000, 2))), 5) AS rmse
FROM objects, rc WHERE d4000 IS NOT NULL AND redshift > 0 GROUP BY split"""))
def _(t: Tables):
    d = MD.assemble(objects(t).where("d4000 IS NOT NULL AND redshift > 0").select("split", "redshift", "log_mstar", "d4000"), ["redshift", "log_mstar"])
    m = MD.ridge(d.where("split = 'Train'"), "features", "d4000", 10.0)
    e = F.col("prediction") - F.col("d4000")
    return m.transform(d).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 5).alias("mean_pred"), F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"))


@query("m06_feature_set_ablation")
def _(t: Tables):
    """The same learner with feature sets A-D over several seeds (random 85 % fits), compared by validation RMSE."""
    from photonloom.operators.splits import random_split

    sets = {"A": ["log_mstar"], "B": ["log_mstar", "log_sfr"], "C": ["log_mstar", "redshift"], "D": ["log_mstar", "log_sfr", "redshift"]}
    base = objects(t).where("d4000 IS NOT NULL AND redshift > 0").select("obj_id", "split", "log_mstar", "log_sfr", "redshift", "d4000")
    train = base.where("split = 'Train'").select("obj_id")
    # The fits read one table that has a flag per seed, and join nothing.
    for seed in (1, 2):
        part = random_split(train, "obj_id", 0.85, seed).groupBy("obj_id").agg(F.max("in_train").alias(f"train_{seed}"))
        base = base.join(part, "obj_id", "left")
    base, out = kept_rows(base), None
    for seed in (1, 2):
        for name, cols in sets.items():
            d = MD.assemble(base, cols)
            m = MD.ridge(d.where(f"train_{seed}"), "features", "d4000", 1.0)
            e = F.col("prediction") - F.col("d4000")
            row = (m.transform(d.where("split = 'Validation'")).agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(e * e))).alias("rmse"))
                   .select(F.lit(name).alias("feature_set"), F.lit(seed).alias("seed"), "n", "rmse"))
            out = row if out is None else out.unionByName(row)
    return out


@query("m07_cross_fitted_estimate")
def _(t: Tables):
    d = MD.assemble(objects(t).where("d4000 IS NOT NULL AND redshift > 0").select("obj_id", "split", "log_mstar", "log_sfr", "redshift"), ["log_mstar", "log_sfr"])
    out = MD.cross_fitted(d, "features", "redshift", "obj_id", "split", 3, 1.0, 42)
    return out.groupBy("split", "origin").agg(F.count("*").alias("n"), r6(F.avg("estimate")).alias("mean_estimate"))


@query("m10_attach_by_split", with_sql(PRED_SQL, body="""
SELECT o.split, count(*) AS n, count(p.pred_log_sfr) AS n_attached, count(*) = count(p.pred_log_sfr) AS complete FROM objects o LEFT JOIN (SELECT * FROM pred_wide WHERE family = 'conv' AND seed = 1) p USING (obj_id) GROUP BY o.split"""))
def _(t: Tables):
    p = pred_wide(t).where("family = 'conv' AND seed = 1").select("obj_id", "pred_log_sfr")
    return (objects(t).join(p, "obj_id", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("pred_log_sfr").alias("n_attached"))
            .withColumn("complete", F.col("n") == F.col("n_attached")))
