"""Queries: residual metrics and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonloom.functions.scalars import finite, r6
from photonloom.operators import metrics as M
from photonloom.operators.distribution import median_and_mad, ordered, quantiles, spearman
from photonloom.plans.bindings import (ALIGNED_SQL, MEMBERS, OBJECTS_SQL, PRED_SQL, SCALE_SQL, TARGETS, aligned, family_mean, objects,
                                       pred_long, pred_wide, scale_of, with_sql)
from photonloom.plans.registry import Tables, query
from photonloom.session import cut_lineage


def rounded(df, keys):
    """Round every double that is not a key, as the SQL side does."""
    return df.select(*[r6(c).alias(c) if ty == "double" and c not in keys else F.col(c) for c, ty in df.dtypes])


def metric_sql(keys: str, source: str, catastrophic: str = "", extra_cte: str = "", spearman: bool = True, having: str = "") -> str:
    """SQL of the residual metrics for a source with y, pred and the keys."""
    k = keys
    on = " AND ".join(f"a.{x.strip()} = b.{x.strip()}" for x in k.split(","))
    return f"""{extra_cte}
d AS (SELECT {k}, y, pred AS p, pred - y AS r FROM {source} WHERE y IS NOT NULL AND pred IS NOT NULL),
med AS (SELECT {k}, median(r) AS med FROM d GROUP BY {k}),
dev AS (SELECT {", ".join("a." + x.strip() for x in k.split(","))}, abs(a.r - b.med) AS dv FROM d a JOIN med b ON {on}),
mad AS (SELECT {k}, 1.4826 * median(dv) AS nmad FROM dev GROUP BY {k}),
outl AS (SELECT {", ".join("a." + x.strip() for x in k.split(","))}, avg(CASE WHEN a.dv > 3 * b.nmad THEN 1.0 ELSE 0.0 END) AS outlier_frac
         FROM dev a JOIN mad b ON {on} GROUP BY ALL),
ranks AS (SELECT {k}, rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1) / 2.0 AS ry,
                 rank() OVER (PARTITION BY {k} ORDER BY p) + (count(*) OVER (PARTITION BY {k}, p) - 1) / 2.0 AS rp FROM d),
rho AS (SELECT {k}, corr(ry, rp) AS spearman FROM ranks GROUP BY {k}),
base AS (SELECT {k}, count(*) AS n, sqrt(avg(r * r)) AS rmse, avg(r * r) AS mse, avg(abs(r)) AS mae, avg(r) AS bias,
           1 - avg(r * r) / nullif(var_pop(y), 0) AS r2, regr_slope(r, y) AS residual_slope, corr(y, p) AS pearson {catastrophic}
         FROM d GROUP BY {k} {having})"""


A01_SQL = with_sql(PRED_SQL, metric_sql("split, family, seed, target", "pred_long").lstrip(), body="""
SELECT split, family, seed, target, n, round(rmse, 6) AS rmse, round(mse, 6) AS mse, round(mae, 6) AS mae, round(bias, 6) AS bias,
  round(r2, 6) AS r2, round(residual_slope, 6) AS residual_slope, round(pearson, 6) AS pearson, round(med, 6) AS med,
  round(nmad, 6) AS nmad, round(outlier_frac, 6) AS outlier_frac, round(spearman, 6) AS spearman
FROM base JOIN med USING (split, family, seed, target) JOIN mad USING (split, family, seed, target)
  JOIN outl USING (split, family, seed, target) JOIN rho USING (split, family, seed, target)""")


@query("a01_regression_metrics", A01_SQL)
def _(t: Tables):
    return rounded(M.regression_metrics(pred_long(t), ["split", "family", "seed", "target"]), [])


FAMILY = ["family", "target"]
ALIGNED = [PRED_SQL, ALIGNED_SQL]
NO_RANK = """
SELECT {k}, n, round(rmse, 6) AS rmse, round(mse, 6) AS mse, round(mae, 6) AS mae, round(bias, 6) AS bias, round(r2, 6) AS r2,
  round(residual_slope, 6) AS residual_slope, round(pearson, 6) AS pearson, round(med, 6) AS med, round(nmad, 6) AS nmad,
  round(outlier_frac, 6) AS outlier_frac {more}
FROM base JOIN med USING ({k}) JOIN mad USING ({k}) JOIN outl USING ({k})"""


@query("a02_catastrophic_metrics", with_sql(
    PRED_SQL, metric_sql("family, kind, target", "pred_long", ", avg(CASE WHEN abs(r) > 0.3 THEN 1.0 ELSE 0.0 END) AS catastrophic_frac").lstrip(),
    body=NO_RANK.format(k="family, kind, target", more=", round(catastrophic_frac, 6) AS catastrophic_frac")))
def _(t: Tables):
    return rounded(M.regression_metrics(pred_long(t), ["family", "kind", "target"], catastrophic=0.3, rank=False), [])


@query("a03_normalized_mse", with_sql(PRED_SQL, SCALE_SQL, body="""
SELECT split, family, seed, target, count(*) AS n, round(avg((pred - y) * (pred - y)) / (max(sigma) * max(sigma)), 6) AS normalized_mse
FROM pred_long JOIN scale USING (target) WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY split, family, seed, target"""))
def _(t: Tables):
    k = ["split", "family", "seed", "target"]
    per = M.residuals(pred_long(t), k).groupBy(*k).agg(F.count("*").alias("n"), F.avg(F.col("r") * F.col("r")).alias("mse"))
    return per.join(F.broadcast(cut_lineage(scale_of(t))), "target").select(
        *k, "n", r6(F.col("mse") / (F.col("sigma") * F.col("sigma"))).alias("normalized_mse"))


@query("a04_family_metrics_table", with_sql(
    *ALIGNED, metric_sql("split, family, target", "family_mean").lstrip(),
    body=NO_RANK.format(k="split, family, target", more=", 'seed mean' AS variant")))
def _(t: Tables):
    out = M.regression_metrics(family_mean(t), ["split", "family", "target"], rank=False)
    return rounded(out, []).withColumn("variant", F.lit("seed mean"))


A05_BODY = """
SELECT split, family, seed, round(avg(mse / (sigma * sigma)), 6) AS criterion FROM (
  SELECT split, family, seed, target, avg((pred - y) * (pred - y)) AS mse FROM pred_long
  WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY split, family, seed, target) JOIN scale USING (target) GROUP BY split, family, seed"""


@query("a05_selection_criterion", with_sql(PRED_SQL, SCALE_SQL, body=A05_BODY))
def _(t: Tables):
    return rounded(M.normalized_criterion(pred_long(t), scale_of(t), ["split", "family", "seed"]), [])


@query("a06_object_loss", with_sql(*ALIGNED, SCALE_SQL, body="""
SELECT obj_id, family, round(avg(((pred - y) / sigma) * ((pred - y) / sigma)), 6) AS loss
FROM family_mean JOIN scale USING (target) GROUP BY obj_id, family"""))
def _(t: Tables):
    return rounded(M.object_loss(family_mean(t), scale_of(t), ["obj_id", "family"]), [])


@query("a07_group_metrics", with_sql(*ALIGNED, body="""
SELECT split, kind, family, target, count(*) AS n, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(avg(pred - y), 6) AS bias
FROM family_mean GROUP BY split, kind, family, target HAVING count(*) >= 10"""))
def _(t: Tables):
    k = ["split", "kind", "family", "target"]
    d = M.residuals(family_mean(t), k)
    return M.moments(d, k).where("n >= 10").select(*k, "n", r6("rmse").alias("rmse"), r6("bias").alias("bias"))


Z_EDGES = (0.0, 0.02, 0.04, 0.06, 0.08, 0.12)


def ladder_sql(v: str, edges, right_closed=False) -> str:
    op = ("> {0} AND {v} <= {1}" if right_closed else ">= {0} AND {v} < {1}")
    return "CASE " + " ".join(f"WHEN {v} " + op.format(lo, hi, v=v) + f" THEN {k}" for k, (lo, hi) in enumerate(zip(edges, edges[1:]))) + " END"


@query("a08_binned_metrics", with_sql(
    *ALIGNED, f"binned AS (SELECT *, {ladder_sql('redshift', Z_EDGES, True)} AS bin FROM family_mean WHERE {ladder_sql('redshift', Z_EDGES, True)} IS NOT NULL)",
    metric_sql("family, target, bin", "binned", having="HAVING count(*) >= 5").lstrip(), body="""
SELECT family, target, bin, n, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(nmad, 6) AS nmad
FROM base JOIN mad USING (family, target, bin)"""))
def _(t: Tables):
    d = family_mean(t).withColumn("bin", M.edge_bucket("redshift", Z_EDGES, right_closed=True)).where("bin is not null")
    out = M.regression_metrics(d, ["family", "target", "bin"], rank=False).where("n >= 5")
    return rounded(out.select("family", "target", "bin", "n", "rmse", "bias", "nmad"), [])


M_EDGES = (8.0, 8.5, 9.0, 9.5, 9.75, 10.0, 10.25, 10.5, 10.75, 11.0)
MOVING = f"mv AS (SELECT *, {ladder_sql('x', M_EDGES)} AS bin FROM (SELECT a.*, o.log_mstar AS x FROM family_mean a JOIN objects o USING (obj_id)))"


def with_mass_bin(t: Tables):
    mass = objects(t).select("obj_id", F.col("log_mstar").alias("x"))
    return (family_mean(t).join(mass, "obj_id").withColumn("r", F.col("pred") - F.col("y"))
            .withColumn("bin", M.edge_bucket("x", M_EDGES)).where("bin is not null"))


@query("a09_moving_median", with_sql(*ALIGNED, MOVING, body="""
SELECT family, target, bin, count(*) AS n, round(median(x), 6) AS x_med, round(median(pred - y), 6) AS med,
  round(quantile_cont(pred - y, 0.16), 6) AS p16, round(quantile_cont(pred - y, 0.84), 6) AS p84
FROM mv WHERE bin IS NOT NULL GROUP BY family, target, bin HAVING count(*) >= 10"""))
def _(t: Tables):
    k = ["family", "target", "bin"]
    d = with_mass_bin(t)
    n = d.groupBy(*k).agg(F.count("*").alias("n")).where("n >= 10")
    q = quantiles(d, k, "r", {"med": 0.5, "p16": 0.16, "p84": 0.84})
    return rounded(n.join(q, k).join(quantiles(d, k, "x", {"x_med": 0.5}), k), [])


@query("a10_quantile_interval_medians", with_sql(*ALIGNED, """edges AS (
  SELECT family, target, quantile_cont(y, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM family_mean GROUP BY family, target),
hit AS (SELECT a.family, a.target, k AS bin, y, pred - y AS r FROM family_mean a JOIN edges USING (family, target), range(0, 5) g(k)
  WHERE y >= e[k + 1] AND y <= e[k + 2])""", body="""
SELECT family, target, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(median(y), 6) AS x_med, round(median(r), 6) AS med,
  round(quantile_cont(r, 0.16), 6) AS p16, round(quantile_cont(r, 0.84), 6) AS p84
FROM hit GROUP BY family, target, bin HAVING count(*) >= 4"""))
def _(t: Tables):
    d = family_mean(t).withColumn("r", F.col("pred") - F.col("y"))
    probs = {f"e{i}": i / 5 for i in range(6)}
    edges = F.broadcast(cut_lineage(quantiles(d, FAMILY, "y", probs)))
    hits = F.expr("filter(array(" + ", ".join(f"IF(y >= e{i} AND y <= e{i + 1}, {i}, NULL)" for i in range(5)) + "), b -> b IS NOT NULL)")
    d = d.join(edges, FAMILY).withColumn("bin", F.explode(hits))
    k = [*FAMILY, "bin"]
    n = d.groupBy(*k).agg(F.count("*").alias("n")).where("n >= 4")
    q = quantiles(d, k, "r", {"med": 0.5, "p16": 0.16, "p84": 0.84})
    return rounded(n.join(q, k).join(quantiles(d, k, "y", {"x_med": 0.5}), k), [])


@query("a11_residuals_by_bin", with_sql(*ALIGNED, MOVING, """dv AS (
  SELECT family, target, bin, median(pred - y) AS med FROM mv WHERE bin IS NOT NULL GROUP BY family, target, bin),
mad AS (SELECT a.family, a.target, a.bin, 1.4826 * median(abs(a.pred - a.y - b.med)) AS nmad FROM mv a JOIN dv b USING (family, target, bin) GROUP BY ALL)""", body="""
SELECT family, target, bin, count(*) AS n, round(avg(pred - y), 6) AS mean, round(median(pred - y), 6) AS med,
  round(stddev_samp(pred - y), 6) AS std, round(max(nmad), 6) AS nmad
FROM mv JOIN mad USING (family, target, bin) GROUP BY family, target, bin"""))
def _(t: Tables):
    return rounded(M.residual_summary(with_mass_bin(t), ["family", "target", "bin"]), [])


DIRTY_SQL = """dirty AS (SELECT split, log_mstar, d4000,
  CASE WHEN redshift < 0 AND kind = 'P' THEN CAST('NaN' AS DOUBLE) WHEN redshift < 0 THEN CAST('Infinity' AS DOUBLE) ELSE redshift END AS redshift FROM objects)"""


@query("a12_column_audit", with_sql(OBJECTS_SQL, DIRTY_SQL, """long AS (
  SELECT split, 'log_mstar' AS "column", log_mstar AS v FROM dirty UNION ALL SELECT split, 'd4000', d4000 FROM dirty
  UNION ALL SELECT split, 'redshift', redshift FROM dirty),
ok AS (SELECT *, CASE WHEN isfinite(v) THEN v END AS ok FROM long)""", body="""
SELECT split, "column", count(*) AS n, count(*) FILTER (v IS NULL) AS n_missing, count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (isinf(v)) AS n_inf,
  count(ok) AS n_valid, round(min(ok), 6) AS min, round(max(ok), 6) AS max, round(avg(ok), 6) AS mean, round(stddev_samp(ok), 6) AS std,
  round(median(ok), 6) AS median
FROM ok GROUP BY split, "column" """))
def _(t: Tables):
    d = objects(t).selectExpr("split", "log_mstar", "d4000", "CASE WHEN redshift < 0 AND kind = 'P' THEN double('NaN') "
                              "WHEN redshift < 0 THEN double('Infinity') ELSE redshift END AS redshift")
    cols = ["log_mstar", "d4000", "redshift"]
    long = d.selectExpr("split", "inline(array(" + ", ".join(f"named_struct('column', '{c}', 'v', {c})" for c in cols) + "))")
    med = quantiles(long.withColumn("v", finite("v")), ["split", "column"], "v", {"median": 0.5})
    return rounded(M.column_audit(d, cols, ["split"]).join(med, ["split", "column"]), [])


@query("a13_split_summary", with_sql(OBJECTS_SQL, """long AS (
  SELECT split, 'log_mstar' AS target, log_mstar AS v FROM objects UNION ALL SELECT split, 'log_sfr', log_sfr FROM objects
  UNION ALL SELECT split, 'd4000', d4000 FROM objects)""", body="""
SELECT split, target, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
  round(quantile_cont(v, 0.1), 6) AS p10, round(median(v), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90
FROM long GROUP BY split, target"""))
def _(t: Tables):
    k = ["split", "target"]
    long = objects(t).selectExpr("split", "inline(array(" + ", ".join(f"named_struct('target', '{c}', 'v', {c})" for c in TARGETS) + "))")
    base = long.groupBy(*k).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                F.min("v").alias("min"), F.max("v").alias("max"))
    return rounded(base.join(quantiles(long, k, "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), k), [])


@query("a14_group_describe", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
  min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(median(l_extendedprice), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(t: Tables):
    d = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("v"))
    k = ["l_returnflag", "l_linestatus"]
    base = d.groupBy(*k).agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("std"),
                             F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(d, k, "v", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return base.join(q.select(*k, *[F.round(c, 4).alias(c) for c in ("p05", "p25", "p50", "p75", "p95")]), k)


@query("a15_value_counts", """
SELECT d.lang, l.quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang, l.quality""")
def _(t: Tables):
    return (t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
            .groupBy("lang", "quality").agg(F.count("*").alias("n")))


@query("a16_crosstab_with_margins", with_sql(OBJECTS_SQL, body="""
SELECT split, kind, n, round(100.0 * n / sum(n) OVER (PARTITION BY split, kind IS NULL), 4) AS row_pct
FROM (SELECT coalesce(split, 'All') AS split, kind, count(*) AS n FROM objects GROUP BY CUBE (split, kind))"""))
def _(t: Tables):
    """`cube` counts cells and margins at once; the table holds one row per cell."""
    from pyspark.sql import Window as W

    d = objects(t).cube("split", "kind").agg(F.count("*").alias("n")).withColumn("split", F.coalesce("split", F.lit("All")))
    total = F.sum("n").over(W.partitionBy("split", F.col("kind").isNull()))
    return d.withColumn("row_pct", F.round(100.0 * F.col("n") / total, 4))


PAIRS_SQL = """wide AS (SELECT obj_id, kind, target, max(y) AS label, max(pred) FILTER (family = 'conv') AS conv,
  max(pred) FILTER (family = 'vit') AS vit, max(pred) FILTER (family = 'eff') AS eff FROM family_mean GROUP BY obj_id, kind, target),
pairs AS (SELECT obj_id, kind, target, 'conv-label' AS pair, conv AS a, label AS b FROM wide UNION ALL SELECT obj_id, kind, target, 'vit-label', vit, label FROM wide
  UNION ALL SELECT obj_id, kind, target, 'conv-vit', conv, vit FROM wide UNION ALL SELECT obj_id, kind, target, 'vit-eff', vit, eff FROM wide)"""


def measure_pairs(t: Tables):
    wide = family_mean(t).groupBy("obj_id", "kind", "target").agg(
        F.max("y").alias("label"), *[F.max(F.when(F.col("family") == f, F.col("pred"))).alias(f) for f in ("conv", "vit", "eff")])
    pairs = [("conv", "label"), ("vit", "label"), ("conv", "vit"), ("vit", "eff")]
    return wide.selectExpr("obj_id", "kind", "target", "inline(array(" + ", ".join(
        f"named_struct('pair', '{a}-{b}', 'a', {a}, 'b', {b})" for a, b in pairs) + "))")


@query("a18_measure_pairs", with_sql(*ALIGNED, PAIRS_SQL, body="""
SELECT pair, target, count(*) AS n, round(avg(a - b), 6) AS bias, round(median(a - b), 6) AS med, round(stddev_samp(a - b), 6) AS std,
  round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(corr(a, b), 6) AS pearson
FROM pairs GROUP BY pair, target"""))
def _(t: Tables):
    d = measure_pairs(t).withColumn("d", F.col("a") - F.col("b"))
    k = ["pair", "target"]
    base = d.groupBy(*k).agg(F.count("d").alias("n"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("std"), F.avg(F.abs("d")).alias("mae"),
                             F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.corr("a", "b").alias("pearson"))
    return rounded(base.join(quantiles(d, k, "d", {"med": 0.5}), k), [])


@query("a19_residual_sensitivity", with_sql(*ALIGNED, PAIRS_SQL, """tagged AS (
  SELECT 'all' AS sample, pair, target, a - b AS d FROM pairs UNION ALL SELECT 'without extremes', pair, target, a - b FROM pairs WHERE abs(a - b) <= 0.15),
med AS (SELECT sample, pair, target, median(d) AS med FROM tagged GROUP BY ALL),
mad AS (SELECT sample, pair, target, 1.4826 * median(abs(d - med)) AS nmad FROM tagged JOIN med USING (sample, pair, target) GROUP BY ALL)""", body="""
SELECT sample, pair, target, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(median(d), 6) AS med, round(max(nmad), 6) AS nmad
FROM tagged JOIN mad USING (sample, pair, target) GROUP BY sample, pair, target"""))
def _(t: Tables):
    d = measure_pairs(t).withColumn("d", F.col("a") - F.col("b"))
    tags = F.when(F.abs("d") <= 0.15, F.array(F.lit("all"), F.lit("without extremes"))).otherwise(F.array(F.lit("all")))
    return rounded(M.residual_summary(d.withColumn("sample", F.explode(tags)), ["sample", "pair", "target"], "d"), [])


@query("a20_dispersion_metrics", with_sql(*ALIGNED, metric_sql("family, target", "family_mean").lstrip(), """sd AS (
  SELECT family, target, stddev_samp(pred - y) AS std, quantile_cont(pred - y, 0.16) AS p16, quantile_cont(pred - y, 0.84) AS p84 FROM family_mean GROUP BY ALL)""", body="""
SELECT family, target, n, round(std, 6) AS std, round(nmad, 6) AS nmad, round(p16, 6) AS p16, round(p84, 6) AS p84, round(spearman, 6) AS spearman, round(rmse, 6) AS rmse
FROM base JOIN mad USING (family, target) JOIN sd USING (family, target) JOIN rho USING (family, target)"""))
def _(t: Tables):
    d = family_mean(t).withColumn("r", F.col("pred") - F.col("y"))
    base = d.groupBy(*FAMILY).agg(F.count("*").alias("n"), F.stddev_samp("r").alias("std"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"))
    out = (base.join(median_and_mad(d, FAMILY, "r", outlier_factor=None).drop("med"), FAMILY)
           .join(quantiles(d, FAMILY, "r", {"p16": 0.16, "p84": 0.84}), FAMILY).join(spearman(d, FAMILY, "y", "pred"), FAMILY))
    return rounded(out, [])


@query("a21_change_against_baseline", with_sql(*ALIGNED, """d AS (SELECT family, target, y, pred AS p, pred - y AS r FROM family_mean),
med AS (SELECT family, target, median(r) AS med FROM d GROUP BY ALL),
mad AS (SELECT family, target, 1.4826 * median(abs(r - med)) AS nmad FROM d JOIN med USING (family, target) GROUP BY ALL),
f AS (SELECT family, target, count(*) AS n, sqrt(avg(r * r)) AS rmse, count(*) FILTER (abs(r - med) > 2 * nmad) AS n_out2,
  count(*) FILTER (abs(r - med) > 3 * nmad) AS n_out3, regr_slope(p, y) AS slope, regr_intercept(p, y) AS intercept
  FROM d JOIN med USING (family, target) JOIN mad USING (family, target) GROUP BY ALL)""", body="""
SELECT f.family, f.target, f.n, round(f.rmse, 6) AS rmse, f.n_out2, f.n_out3, round(f.slope, 6) AS slope, round(f.intercept, 6) AS intercept,
  round(100 * (f.rmse - b.rmse) / b.rmse, 4) AS rmse_change_pct
FROM f JOIN f b ON b.family = 'conv' AND b.target = f.target"""))
def _(t: Tables):
    d = family_mean(t).withColumn("r", F.col("pred") - F.col("y"))
    fit = median_and_mad(d, FAMILY, "r", outlier_factor=None)
    dev = F.abs(F.col("r") - F.col("med"))
    out = d.join(F.broadcast(fit), FAMILY).groupBy(*FAMILY).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"), F.count_if(dev > 2 * F.col("nmad")).alias("n_out2"),
        F.count_if(dev > 3 * F.col("nmad")).alias("n_out3"), F.regr_slope("pred", "y").alias("slope"), F.regr_intercept("pred", "y").alias("intercept"))
    return M.against_baseline(out, "family", "conv", ["target"], "rmse").select(
        *FAMILY, "n", r6("rmse").alias("rmse"), "n_out2", "n_out3", r6("slope").alias("slope"), r6("intercept").alias("intercept"),
        F.round("rmse_change_pct", 4).alias("rmse_change_pct"))


RUNS_SQL = """runs AS (SELECT split, family, seed, target, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM pred_long
  WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY split, family, seed, target)"""


def run_rmse(t: Tables):
    k = ["split", "family", "seed", "target"]
    return M.residuals(pred_long(t), k).groupBy(*k).agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"))


@query("a23_seed_stability", with_sql(PRED_SQL, RUNS_SQL, body="""
SELECT split, family, target, count(*) AS n_seeds, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS std, round(min(rmse), 6) AS min, round(max(rmse), 6) AS max
FROM runs GROUP BY split, family, target"""))
def _(t: Tables):
    return rounded(run_rmse(t).groupBy("split", "family", "target").agg(
        F.count("*").alias("n_seeds"), F.avg("rmse").alias("mean"), F.stddev_samp("rmse").alias("std"), F.min("rmse").alias("min"), F.max("rmse").alias("max")), [])


@query("a24_paired_deltas_by_seed", with_sql(PRED_SQL, RUNS_SQL, """p AS (SELECT split, target, seed, max(rmse) FILTER (family = 'conv') AS conv,
  max(rmse) FILTER (family = 'vit') AS vit, max(rmse) FILTER (family = 'eff') AS eff FROM runs GROUP BY ALL)""", body="""
SELECT split, target, round(avg(vit - conv), 6) AS delta_vit, round(avg(eff - conv), 6) AS delta_eff, count(*) FILTER (vit < conv) AS vit_improves,
  count(*) FILTER (eff < conv) AS eff_improves FROM p GROUP BY split, target"""))
def _(t: Tables):
    p = run_rmse(t).groupBy("split", "target", "seed").pivot("family", ["conv", "vit", "eff"]).agg(F.max("rmse"))
    return rounded(p.groupBy("split", "target").agg(
        F.avg(F.col("vit") - F.col("conv")).alias("delta_vit"), F.avg(F.col("eff") - F.col("conv")).alias("delta_eff"),
        F.count_if(F.col("vit") < F.col("conv")).alias("vit_improves"), F.count_if(F.col("eff") < F.col("conv")).alias("eff_improves")), [])


@query("a25_calibration_slope", with_sql(*ALIGNED, body="""
SELECT split, family, target, round(covar_samp(pred, y) / var_samp(y), 6) AS calibration_slope FROM family_mean GROUP BY split, family, target"""))
def _(t: Tables):
    return rounded(family_mean(t).groupBy("split", "family", "target").agg(F.regr_slope("pred", "y").alias("calibration_slope")), [])


@query("a26_spearman", """
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rb FROM lineitem)
SELECT l_returnflag, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY l_returnflag""")
def _(t: Tables):
    """Distributed ranks: a third of the rows share one key."""
    return rounded(spearman(t.spread("lineitem", "l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice"), [])


@query("a27_residual_correlation", with_sql(*ALIGNED, body="""
SELECT a.target, a.family AS member_a, b.family AS member_b, round(corr(a.pred - a.y, b.pred - b.y), 6) AS corr, count(*) AS n
FROM family_mean a JOIN family_mean b ON a.obj_id = b.obj_id AND a.target = b.target AND a.family < b.family GROUP BY ALL"""))
def _(t: Tables):
    return rounded(M.residual_correlation(family_mean(t), ["target"], "family"), [])


PHOTOZ_SQL = """z AS (SELECT family, redshift AS z, round(redshift * (1 + 0.3 * (pred_log_mstar - y_log_mstar)), 6) AS zp FROM pred_wide WHERE redshift > 0),
d AS (SELECT family, z, zp, (zp - z) / (1 + z) AS dz, abs(zp - z) / z AS rel, log10(zp) - log10(z) AS dl FROM z),
med AS (SELECT family, median(dz) AS med FROM d GROUP BY ALL),
mad AS (SELECT family, 1.4826 * median(abs(dz - med)) AS nmad FROM d JOIN med USING (family) GROUP BY ALL),
rk AS (SELECT family, rank() OVER (PARTITION BY family ORDER BY z) + (count(*) OVER (PARTITION BY family, z) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY family ORDER BY zp) + (count(*) OVER (PARTITION BY family, zp) - 1) / 2.0 AS rb FROM d),
rho AS (SELECT family, corr(ra, rb) AS spearman FROM rk GROUP BY ALL)"""


@query("a28_photoz_metrics", with_sql(PRED_SQL, PHOTOZ_SQL, body="""
SELECT family, count(*) AS n, round(sqrt(avg(dl * dl)), 6) AS rmse_log10z, round(avg(CASE WHEN abs(dz) > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS outlier_frac,
  round(max(med), 7) AS bias_dz, round(max(nmad), 7) AS nmad_dz, round(median(rel), 7) AS median_relative_error, round(max(spearman), 6) AS spearman
FROM d JOIN med USING (family) JOIN mad USING (family) JOIN rho USING (family) GROUP BY family"""))
def _(t: Tables):
    d = pred_wide(t).where("redshift > 0").selectExpr("family", "redshift AS z", "round(redshift * (1 + 0.3D * (pred_log_mstar - y_log_mstar)), 6) AS zp")
    out = M.photoz_metrics(d, ["family"], "z", "zp")
    fine = {"bias_dz", "nmad_dz", "median_relative_error"}
    return out.select(*[F.round(c, 7 if c in fine else 6).alias(c) if ty == "double" else F.col(c) for c, ty in out.dtypes])


@query("a39_median_baseline", with_sql(PRED_SQL, SCALE_SQL, body="""
SELECT o.split, s.target, count(*) AS n, round(sqrt(avg((s.train_median - o.y) * (s.train_median - o.y))), 6) AS rmse, round(avg(s.train_median - o.y), 6) AS bias
FROM (SELECT split, 'log_mstar' AS target, log_mstar AS y FROM objects UNION ALL SELECT split, 'log_sfr', log_sfr FROM objects
  UNION ALL SELECT split, 'd4000', d4000 FROM objects) o JOIN scale s USING (target) WHERE o.y IS NOT NULL GROUP BY o.split, s.target"""))
def _(t: Tables):
    d = objects(t).selectExpr("split", "inline(array(" + ", ".join(f"named_struct('target', '{x}', 'y', {x})" for x in TARGETS) + "))")
    d = d.join(F.broadcast(cut_lineage(scale_of(t))), "target").withColumn("pred", F.col("train_median"))
    k = ["split", "target"]
    return rounded(M.residuals(d, k).groupBy(*k).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"), F.avg("r").alias("bias")), [])


@query("a40_train_quartile_groups", with_sql(*ALIGNED, """q AS (SELECT quantile_cont(redshift, [0.25, 0.5, 0.75]) AS qz, quantile_cont(log_mstar, [0.25, 0.5, 0.75]) AS qm FROM objects WHERE split = 'Train'),
g AS (SELECT a.*, CAST((o.redshift > qz[1])::INT + (o.redshift > qz[2])::INT + (o.redshift > qz[3])::INT AS VARCHAR) AS gz,
  CAST((o.log_mstar > qm[1])::INT + (o.log_mstar > qm[2])::INT + (o.log_mstar > qm[3])::INT AS VARCHAR) AS gm
  FROM family_mean a JOIN objects o USING (obj_id), q),
l AS (SELECT 'redshift' AS grouping, gz AS grp, family, target, pred - y AS r FROM g UNION ALL SELECT 'mass', gm, family, target, pred - y FROM g
  UNION ALL SELECT 'kind', kind, family, target, pred - y FROM g)""", body="""
SELECT grouping, grp, family, target, count(*) AS n, round(sqrt(avg(r * r)), 6) AS rmse, round(avg(r), 6) AS bias FROM l GROUP BY ALL"""))
def _(t: Tables):
    o = objects(t)
    q = M.train_quartiles(o.where("split = 'Train'"), {"qz": "redshift", "qm": "log_mstar"})
    qz, qm = q.first()
    d = family_mean(t).join(o.select("obj_id", "log_mstar"), "obj_id").withColumn("r", F.col("pred") - F.col("y"))
    step = lambda c, edges: "string(" + " + ".join(f"int({c} > {e!r}D)" for e in edges) + ")"
    d = d.selectExpr("family", "target", "r", f"inline(array(named_struct('grouping', 'redshift', 'grp', {step('redshift', qz)}), "
                     f"named_struct('grouping', 'mass', 'grp', {step('log_mstar', qm)}), named_struct('grouping', 'kind', 'grp', kind)))")
    return rounded(d.groupBy("grouping", "grp", "family", "target").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"), F.avg("r").alias("bias")), [])


@query("a41_subgroup_regimes", with_sql(*ALIGNED, SCALE_SQL, body="""
SELECT family, target, CASE WHEN y <= train_median THEN 'low' ELSE 'high' END AS regime, kind, count(*) AS n, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse
FROM family_mean JOIN scale USING (target) GROUP BY ALL"""))
def _(t: Tables):
    d = family_mean(t).join(F.broadcast(cut_lineage(scale_of(t))), "target").withColumn("regime", F.when(F.col("y") <= F.col("train_median"), "low").otherwise("high"))
    e = F.col("pred") - F.col("y")
    return rounded(d.groupBy("family", "target", "regime", "kind").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")), [])


@query("a44_skew_report", """
WITH l AS (SELECT 'l_extendedprice' AS "column", l_extendedprice AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
m AS (SELECT "column", avg(v) AS mu, avg(ln(1 + v)) AS mul FROM l GROUP BY ALL),
c AS (SELECT "column", v - mu AS d, ln(1 + v) - mul AS dl FROM l JOIN m USING ("column"))
SELECT "column", round(avg(d * d * d) / pow(avg(d * d), 1.5), 5) AS skew_before, round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 5) AS kurt_before,
  round(avg(dl * dl * dl) / pow(avg(dl * dl), 1.5), 5) AS skew_after, round(avg(dl * dl * dl * dl) / pow(avg(dl * dl), 2) - 3, 5) AS kurt_after
FROM c GROUP BY "column" """)
def _(t: Tables):
    cols = ["l_extendedprice", "l_quantity", "l_discount"]
    d = t.spread("lineitem", *cols).selectExpr("inline(array(" + ", ".join(f"named_struct('column', '{c}', 'v', {c})" for c in cols) + "))")
    return d.groupBy("column").agg(F.round(F.skewness("v"), 5).alias("skew_before"), F.round(F.kurtosis("v"), 5).alias("kurt_before"),
                                   F.round(F.skewness(F.log1p("v")), 5).alias("skew_after"), F.round(F.kurtosis(F.log1p("v")), 5).alias("kurt_after"))


@query("a45_cost_by_family", """
SELECT event_type AS family, round(avg(value), 6) AS mean_minutes, arg_min(value, event_id) FILTER (value >= 1) AS first_valid_ms, round(sum(value), 4) AS total_minutes,
  round(arg_min(value, event_id) FILTER (value >= 1) * 1e6 / 3.6e6, 6) AS gpu_hours_per_million, count(DISTINCT user_id) AS members
FROM events GROUP BY event_type""")
def _(t: Tables):
    first = F.min_by("value", F.when(F.col("value") >= 1, F.col("event_id")))
    return t.events.groupBy(F.col("event_type").alias("family")).agg(
        r6(F.avg("value")).alias("mean_minutes"), first.alias("first_valid_ms"), F.round(F.sum("value"), 4).alias("total_minutes"),
        r6(first * 1e6 / 3.6e6).alias("gpu_hours_per_million"), F.countDistinct("user_id").alias("members"))


@query("a46_model_ranking", with_sql(PRED_SQL, SCALE_SQL, f"c AS ({A05_BODY})", body="""
SELECT family, round(avg(criterion), 6) AS criterion, row_number() OVER (ORDER BY round(avg(criterion), 6), family) AS position FROM c GROUP BY family"""))
def _(t: Tables):
    from pyspark.sql import Window as W

    c = rounded(M.normalized_criterion(pred_long(t), scale_of(t), ["split", "family", "seed"]), []).groupBy("family").agg(r6(F.avg("criterion")).alias("criterion"))
    # One row per family remains.
    return c.withColumn("position", F.row_number().over(W.orderBy("criterion", "family")).cast("bigint"))


@query("a47_wide_summary", with_sql(PRED_SQL, RUNS_SQL, body="""
SELECT split, family, seed, round(max(rmse) FILTER (target = 'log_mstar'), 6) AS log_mstar, round(max(rmse) FILTER (target = 'log_sfr'), 6) AS log_sfr,
  round(max(rmse) FILTER (target = 'd4000'), 6) AS d4000 FROM runs GROUP BY split, family, seed"""))
def _(t: Tables):
    return rounded(run_rmse(t).groupBy("split", "family", "seed").pivot("target", list(TARGETS)).agg(F.max("rmse")), [])


@query("a49_repeat_noise", with_sql(*ALIGNED, body="""
SELECT split, target, count(*) AS n, round(avg(s), 6) AS mean_std FROM (SELECT split, target, obj_id, stddev_samp(pred) AS s FROM aligned GROUP BY ALL) GROUP BY split, target"""))
def _(t: Tables):
    s = aligned(t).groupBy("split", "target", "obj_id").agg(F.stddev_samp("pred").alias("s"))
    return rounded(s.groupBy("split", "target").agg(F.count("*").alias("n"), F.avg("s").alias("mean_std")), [])


@query("a50_parameter_response", """
WITH l AS (SELECT 'discount' AS param, CAST(l_discount AS VARCHAR) AS value, l_quantity AS c FROM lineitem UNION ALL SELECT 'tax', CAST(l_tax AS VARCHAR), l_quantity FROM lineitem
  UNION ALL SELECT 'line', CAST(CAST(l_linenumber AS DOUBLE) AS VARCHAR), l_quantity FROM lineitem)
SELECT param, value, count(*) AS trials, median(c) AS median_criterion FROM l GROUP BY param, value""")
def _(t: Tables):
    d = t.spread("lineitem", "l_discount", "l_tax", "l_linenumber", "l_quantity").selectExpr(
        "l_quantity AS c", "inline(array(named_struct('param', 'discount', 'value', string(l_discount)), named_struct('param', 'tax', 'value', string(l_tax)), "
        "named_struct('param', 'line', 'value', string(double(l_linenumber)))))")
    k = ["param", "value"]
    return d.groupBy(*k).agg(F.count("*").alias("trials")).join(quantiles(d, k, "c", {"median_criterion": 0.5}), k)


@query("a51_density_histogram", with_sql(OBJECTS_SQL, body="""
SELECT kind, bin, n, round(n / (sum(n) OVER (PARTITION BY kind) * 0.25), 6) AS density FROM (
  SELECT kind, CAST(floor((log_mstar - 8) / 0.25) AS BIGINT) AS bin, count(*) AS n FROM objects WHERE log_mstar >= 8 AND log_mstar < 11 GROUP BY ALL)"""))
def _(t: Tables):
    return rounded(M.density_histogram(objects(t), ["kind"], "log_mstar", 8.0, 11.0, 0.25), [])


@query("a52_model_diagnostics", with_sql(*ALIGNED, """p AS (SELECT obj_id, kind, family, max(y) FILTER (target = 'log_mstar') AS ym, max(pred) FILTER (target = 'log_mstar') AS pm,
  max(y) FILTER (target = 'log_sfr') AS ys, max(pred) FILTER (target = 'log_sfr') AS ps FROM family_mean GROUP BY ALL)""", body="""
SELECT family, round(sqrt(avg((pm - ym) * (pm - ym)) FILTER (ys - ym > -10.8)), 6) AS rmse_forming, round(sqrt(avg((pm - ym) * (pm - ym)) FILTER (ys - ym <= -10.8)), 6) AS rmse_quenched,
  round(regr_slope(pm, ym), 6) AS slope_mass, round(regr_slope(ps, ys), 6) AS slope_sfr, round(corr(pm - ym, ps - ys), 6) AS residual_corr FROM p GROUP BY family"""))
def _(t: Tables):
    p = (family_mean(t).groupBy("obj_id", "kind", "family").pivot("target", ["log_mstar", "log_sfr"]).agg(F.max("y").alias("y"), F.max("pred").alias("p")))
    em, es = F.col("log_mstar_p") - F.col("log_mstar_y"), F.col("log_sfr_p") - F.col("log_sfr_y")
    # Fixed value: specific star formation rate that separates forming from quenched objects.
    forming = F.col("log_sfr_y") - F.col("log_mstar_y") > -10.8
    return rounded(p.groupBy("family").agg(
        F.sqrt(F.avg(F.when(forming, em * em))).alias("rmse_forming"), F.sqrt(F.avg(F.when(~forming, em * em))).alias("rmse_quenched"),
        F.regr_slope("log_mstar_p", "log_mstar_y").alias("slope_mass"), F.regr_slope("log_sfr_p", "log_sfr_y").alias("slope_sfr"),
        F.corr(em, es).alias("residual_corr")), [])
