"""Queries: resampling, comparison and ensembles (A29-A38, A48, A53, E, M08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonloom.functions.scalars import r6
from photonloom.operators import bootstrap as B
from photonloom.operators import ensembles as E
from photonloom.operators import metrics as M
from photonloom.operators import resample as R
from photonloom.operators.distribution import ks_statistic, quantiles, spearman
from photonloom.plans.bindings import ALIGNED_SQL, FAMILIES, OBJECTS_SQL, PRED_SQL, SCALE_SQL, TARGETS, family_mean, family_residuals, objects, pred_wide, scale_of, with_sql
from photonloom.plans.metric_queries import rounded
from photonloom.plans.registry import Tables, query
from photonloom.plans.split_queries import h_sql
from photonloom.session import cut_lineage, kept_rows

ALIGNED = [PRED_SQL, ALIGNED_SQL]
N_BOOT = 1000
PAIRS = [(a, b) for i, a in enumerate(FAMILIES) for b in FAMILIES[i + 1:]]


def copies_sql(source: str, n_boot: int, seed: int, cols: str) -> str:
    word = lambda k: f"CAST('0x' || substr(md5(concat_ws('|', obj_id, '{seed}')), {1 + 8 * k}, 8) AS BIGINT)"
    n = " + ".join(f"(x >= {e})::INT" for e in B.EDGES)
    return f"""words AS (SELECT {cols}, {word(0)} AS w0, {word(1)} AS w1 FROM {source}),
mixed AS (SELECT {cols}, CAST(rep AS INTEGER) AS rep, (xor(x, x >> 16) * {B.MIX}) % 4294967296 AS x FROM (SELECT *, (w0 + w1 * rep) % 4294967296 AS x FROM words, range(0, {n_boot}) g(rep))),
copies AS (SELECT {cols}, rep, {n} AS copies FROM (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM mixed))"""


# One row per object with the residual of every (family, target): the draws are made once per object.
ERR = [(f, t) for f in FAMILIES for t in TARGETS]
ERR_COLUMNS = ", ".join(f"r_{f}_{t}" for f, t in ERR)
ERRORS_SQL = "errors AS (SELECT obj_id, split, " + ", ".join(
    f"max(pred - y) FILTER (family = '{f}' AND target = '{t}') AS r_{f}_{t}" for f, t in ERR) + " FROM family_mean GROUP BY obj_id, split)"
#: Per replicate and (family, target): mean square, mean and mean absolute residual.
REPS_SQL = "sums AS (SELECT split, rep, sum(copies) AS n, " + ", ".join(f"sum(copies * r_{f}_{t} * r_{f}_{t}) AS q_{f}_{t}, sum(copies * r_{f}_{t}) AS b_{f}_{t}, sum(copies * abs(r_{f}_{t})) AS a_{f}_{t}" for f, t in ERR) + """ FROM copies GROUP BY split, rep),
reps AS (""" + " UNION ALL ".join(f"SELECT split, rep, '{f}' AS family, '{t}' AS target, sqrt(q_{f}_{t} / n) AS rmse, b_{f}_{t} / n AS bias, a_{f}_{t} / n AS mae FROM sums" for f, t in ERR) + ")"
LEVELS = {"lo": 0.025, "hi": 0.975}


def replicate_errors(t: Tables, seed: int):
    """(split, rep, family, target, rmse, bias, mae)"""
    d = family_mean(t).groupBy("obj_id", "split").agg(*[F.max(F.when((F.col("family") == f) & (F.col("target") == x), F.col("pred") - F.col("y"))).alias(f"b_{f}_{x}") for f, x in ERR])
    d = d.withColumns({f"q_{f}_{x}": F.col(f"b_{f}_{x}") * F.col(f"b_{f}_{x}") for f, x in ERR}).withColumns({f"a_{f}_{x}": F.abs(f"b_{f}_{x}") for f, x in ERR})
    reps = B.replicate_means(d, "obj_id", ["split"], [f"{k}_{f}_{x}" for k in "qba" for f, x in ERR], N_BOOT, seed)
    rows = ", ".join(f"named_struct('family', '{f}', 'target', '{x}', 'rmse', sqrt(q_{f}_{x}), 'bias', b_{f}_{x}, 'mae', a_{f}_{x})" for f, x in ERR)
    return reps.selectExpr("split", "rep", f"inline(array({rows}))")


def paired(reps, keys: list[str], values: list[str]):
    """(keys, rep, family, versus, value...): differences of every pair of families on the same draws."""
    one = reps.groupBy(*keys, "rep").agg(*[F.max(F.when(F.col("family") == f, F.col(v))).alias(f"{v}_{f}") for f in FAMILIES for v in values])
    rows = ", ".join(f"named_struct('family', '{b}', 'versus', '{a}', " + ", ".join(f"'{v}', {v}_{b} - {v}_{a}" for v in values) + ")" for a, b in PAIRS)
    return one.selectExpr(*keys, "rep", f"inline(array({rows}))")


def quantile_sql(columns: str, levels: dict[str, float] = LEVELS) -> str:
    return ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_{tag}" for c in columns.split() for tag, p in levels.items())


@query("a32_bootstrap_rmse_interval", with_sql(*ALIGNED, ERRORS_SQL, copies_sql("errors", N_BOOT, 1, f"obj_id, split, {ERR_COLUMNS}"), REPS_SQL, body=f"""
SELECT split, family, target, {quantile_sql('rmse bias mae')} FROM reps GROUP BY ALL"""))
def _(t: Tables):
    """Intervals of RMSE, bias and MAE of every family."""
    return rounded(R.interval(replicate_errors(t, 1), ["split", "family", "target"], {c: F.col(c) for c in ("rmse", "bias", "mae")}, LEVELS), [])


PAIRED_SQL = "pairs(family, versus) AS (VALUES " + ", ".join(f"('{b}', '{a}')" for a, b in PAIRS) + ")"


@query("a33_paired_bootstrap", with_sql(*ALIGNED, ERRORS_SQL, copies_sql("errors", N_BOOT, 2, f"obj_id, split, {ERR_COLUMNS}"), REPS_SQL, PAIRED_SQL, """
d AS (SELECT x.split, x.target, p.family, p.versus, x.rmse - y.rmse AS d, x.mae - y.mae AS m FROM pairs p JOIN reps x ON x.family = p.family JOIN reps y ON y.family = p.versus AND y.split = x.split AND y.target = x.target AND y.rep = x.rep),
ci AS (SELECT split, family, versus, target, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, quantile_cont(d, 0.05) AS lo90, quantile_cont(d, 0.95) AS hi90, quantile_cont(m, 0.025) AS mlo, quantile_cont(m, 0.975) AS mhi,
      CASE target WHEN 'd4000' THEN 0.01 ELSE 0.02 END AS margin FROM d GROUP BY ALL)""", body="""
SELECT split, family, versus, target, round(lo, 6) AS d_lo, round(hi, 6) AS d_hi, round(mlo, 6) AS mae_lo, round(mhi, 6) AS mae_hi,
  CASE WHEN hi < 0 THEN 'better' WHEN lo > 0 THEN 'worse' WHEN -margin < lo90 AND hi90 < margin THEN 'equivalent' ELSE 'inconclusive' END AS verdict FROM ci"""))
def _(t: Tables):
    """RMSE and MAE differences of every pair of families on the same draws, and the decision rule with the 90 % bounds."""
    keys = ["split", "family", "versus", "target"]
    d = paired(replicate_errors(t, 2), ["split", "target"], ["rmse", "mae"])
    ci = R.interval(d, keys, {"d": F.col("rmse"), "mae": F.col("mae")}, {**LEVELS, "lo90": 0.05, "hi90": 0.95})
    v = R.verdict(F.col("d_lo"), F.col("d_hi"), R.margin_of(), F.col("d_lo90"), F.col("d_hi90"))
    return ci.select(*keys, *[r6(c).alias(c) for c in ("d_lo", "d_hi", "mae_lo", "mae_hi")], v.alias("verdict"))


NMAD_SQL = ["src AS (SELECT obj_id, family, target, pred - y AS r FROM family_mean)", copies_sql("src", N_BOOT, 3, "obj_id, family, target, r"), """
ex AS (SELECT family, target, rep, r FROM copies, range(0, 10) k(i) WHERE i < copies),
med AS (SELECT family, target, rep, median(r) AS med FROM ex GROUP BY ALL),
mad AS (SELECT family, target, rep, 1.4826 * median(abs(r - med)) AS nmad FROM ex JOIN med USING (family, target, rep) GROUP BY ALL)"""]


def replicate_nmads(t: Tables):
    """(family, target, rep, med, nmad)"""
    reps = B.replicate_nmads(family_residuals(t), "obj_id", [], [f"r_{f}_{x}" for f, x in ERR], N_BOOT, 3)
    of = F.create_map(*[v for f, x in ERR for v in (F.lit(f"r_{f}_{x}"), F.struct(F.lit(f).alias("family"), F.lit(x).alias("target")))])
    return reps.withColumn("of", of[F.col("column")]).select("of.family", "of.target", "rep", "med", "nmad")


@query("a32_bootstrap_nmad_interval", with_sql(*ALIGNED, *NMAD_SQL, body="""
SELECT family, target, round(quantile_cont(nmad, 0.025), 6) AS nmad_lo, round(quantile_cont(nmad, 0.975), 6) AS nmad_hi FROM mad GROUP BY ALL"""))
def _(t: Tables):
    return rounded(R.interval(replicate_nmads(t), ["family", "target"], {"nmad": F.col("nmad")}, LEVELS), [])


@query("a33_paired_nmad", with_sql(*ALIGNED, *NMAD_SQL, PAIRED_SQL, """
d AS (SELECT x.target, p.family, p.versus, x.nmad - y.nmad AS d FROM pairs p JOIN mad x ON x.family = p.family JOIN mad y ON y.family = p.versus AND y.target = x.target AND y.rep = x.rep)""", body=f"""
SELECT family, versus, target, {quantile_sql('d')} FROM d GROUP BY ALL"""))
def _(t: Tables):
    """NMAD differences of every pair of families on the same draws."""
    return rounded(R.interval(paired(replicate_nmads(t), ["target"], ["nmad"]), ["family", "versus", "target"], {"d": F.col("nmad")}, LEVELS), [])


LOSS_SQL = "loss AS (SELECT obj_id, split, family, avg(((pred - y) / sigma) * ((pred - y) / sigma)) AS loss FROM family_mean JOIN scale USING (target) GROUP BY ALL)"


def losses(t: Tables, means=None):
    return M.object_loss(family_mean(t) if means is None else means, scale_of(t), ["obj_id", "split", "family"])


@query("a33_criterion_difference", with_sql(*ALIGNED, SCALE_SQL, LOSS_SQL, "diff AS (SELECT obj_id, split, " + ", ".join(f"max(loss) FILTER (family = '{b}') - max(loss) FILTER (family = '{a}') AS d_{a}_{b}" for a, b in PAIRS) + " FROM loss GROUP BY ALL)",
    copies_sql("diff", N_BOOT, 4, "obj_id, split, " + ", ".join(f"d_{a}_{b}" for a, b in PAIRS)), "sums AS (SELECT split, rep, sum(copies) AS n, " + ", ".join(f"sum(copies * d_{a}_{b}) AS d_{a}_{b}" for a, b in PAIRS) + """ FROM copies GROUP BY ALL),
reps AS (""" + " UNION ALL ".join(f"SELECT split, '{b}' AS family, '{a}' AS versus, d_{a}_{b} / n AS d FROM sums" for a, b in PAIRS) + "),\npoint AS (" + " UNION ALL ".join(f"SELECT split, '{b}' AS family, '{a}' AS versus, avg(d_{a}_{b}) AS mean_d FROM diff GROUP BY split" for a, b in PAIRS) + ")", body="""
SELECT split, family, versus, round(max(mean_d), 6) AS mean_d, round(quantile_cont(d, 0.025), 6) AS d_lo, round(quantile_cont(d, 0.975), 6) AS d_hi FROM reps JOIN point USING (split, family, versus) GROUP BY ALL"""))
def _(t: Tables):
    """Criterion difference of every pair of families."""
    wide = losses(t).groupBy("obj_id", "split").agg(*[F.max(F.when(F.col("family") == f, F.col("loss"))).alias(f) for f in FAMILIES])
    d = wide.select("obj_id", "split", *[(F.col(b) - F.col(a)).alias(f"d_{a}_{b}") for a, b in PAIRS])
    names = [f"d_{a}_{b}" for a, b in PAIRS]
    rows = "inline(array(" + ", ".join(f"named_struct('family', '{b}', 'versus', '{a}', 'd', d_{a}_{b})" for a, b in PAIRS) + "))"
    reps = B.replicate_means(d, "obj_id", ["split"], names, N_BOOT, 4).selectExpr("split", rows)
    point = d.groupBy("split").agg(*[F.avg(c).alias(c) for c in names]).selectExpr("split", rows).withColumnRenamed("d", "mean_d")
    keys = ["split", "family", "versus"]
    return rounded(R.interval(reps, keys, {"d": F.col("d")}, LEVELS).join(point, keys), [])


WILCOXON_SQL = """dd AS (SELECT a.split, a.target, round((b.pred - b.y) * (b.pred - b.y) - (a.pred - a.y) * (a.pred - a.y), 9) AS d FROM family_mean a JOIN family_mean b
  ON a.obj_id = b.obj_id AND a.target = b.target WHERE a.family = 'conv' AND b.family = 'vit'),
nz AS (SELECT split, target, d, abs(d) AS v FROM dd WHERE d <> 0),
rk AS (SELECT *, rank() OVER (PARTITION BY split, target ORDER BY v) + (count(*) OVER (PARTITION BY split, target, v) - 1) / 2.0 AS r FROM nz),
tie AS (SELECT split, target, sum(c * c * c - c) AS ties FROM (SELECT split, target, v, CAST(count(*) AS DOUBLE) AS c FROM nz GROUP BY ALL) GROUP BY ALL),
w AS (SELECT split, target, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM rk GROUP BY ALL),
z AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM w JOIN tie USING (split, target)),
p AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
pv AS (SELECT split, target, n, w_plus, w_minus, z, 2 * exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS p FROM p)"""


def wilcoxon_table(t: Tables):
    e = (F.col("pred") - F.col("y")) * (F.col("pred") - F.col("y"))
    d = (family_mean(t).where("family IN ('conv', 'vit')").groupBy("obj_id", "split", "target").pivot("family", ["conv", "vit"]).agg(F.first(e)))
    return R.wilcoxon(d, ["split", "target"], F.round(F.col("vit") - F.col("conv"), 9))


@query("a35_wilcoxon", with_sql(*ALIGNED, WILCOXON_SQL, body="SELECT split, target, n, w_plus, w_minus, round(z, 5) AS z, round(p, 8) AS p_value FROM pv"))
def _(t: Tables):
    return wilcoxon_table(t).select("split", "target", "n", "w_plus", "w_minus", F.round("z", 5).alias("z"), F.round("p_value", 8).alias("p_value"))


@query("a37_holm_correction", with_sql(*ALIGNED, WILCOXON_SQL, """s AS (SELECT split, target, p, (count(*) OVER () - row_number() OVER (ORDER BY p, split, target) + 1) * p AS step FROM pv)""", body="""
SELECT split, target, round(p, 8) AS p_value, round(least(1, max(step) OVER (ORDER BY p, split, target ROWS UNBOUNDED PRECEDING)), 8) AS p_holm FROM s"""))
def _(t: Tables):
    tests = wilcoxon_table(t).select(F.lit("report").alias("family_of_tests"), "split", "target", "p_value")
    out = R.holm(tests, ["family_of_tests"], "p_value", ["split", "target"])
    return out.select("split", "target", F.round("p_value", 8).alias("p_value"), F.round("p_holm", 8).alias("p_holm"))


@query("a36_ks_two_samples", """WITH s AS (SELECT l_returnflag, l_linestatus = 'F' AS first, l_extendedprice AS v FROM lineitem),
a AS (SELECT l_returnflag, v, count(*) FILTER (first) AS c1, count(*) FILTER (NOT first) AS c2 FROM s GROUP BY ALL),
c AS (SELECT l_returnflag, v, sum(c1) OVER w AS c1, sum(c2) OVER w AS c2, sum(c1) OVER (PARTITION BY l_returnflag) AS n1, sum(c2) OVER (PARTITION BY l_returnflag) AS n2 FROM a
  WINDOW w AS (PARTITION BY l_returnflag ORDER BY v)),
k AS (SELECT l_returnflag, max(n1) AS n1, max(n2) AS n2, max(abs(c1 / n1 - c2 / n2)) AS ks FROM c GROUP BY 1),
l AS (SELECT *, ks * sqrt(n1 * n2 / (n1 + n2)) AS lam FROM k)
SELECT l_returnflag, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(ks, 6) AS ks, round(greatest(0, least(1, 2 * (SELECT sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * lam * lam)) FROM range(1, 51) g(i)))), 6) AS p_value FROM l""")
def _(t: Tables):
    """Distributed layout: each group holds a third of the table."""
    k = ks_statistic(t.spread("lineitem", "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag"], F.col("l_linestatus") == "F", "l_extendedprice")
    return rounded(k.withColumn("p_value", R.ks_p_value(F.col("ks"), F.col("n1"), F.col("n2"))), [])


COMPLEXITY = {"conv": 1, "eff": 2, "vit": 3}
ONE_SE_SQL = """m AS (SELECT split, family, avg(loss) AS criterion FROM loss GROUP BY ALL),
best AS (SELECT split, arg_min(family, criterion) AS best FROM m GROUP BY split),
dif AS (SELECT a.split, a.family, avg(a.loss - b.loss) AS difference, stddev_samp(a.loss - b.loss) / sqrt(count(*)) AS std_error FROM loss a JOIN best USING (split)
  JOIN loss b ON b.obj_id = a.obj_id AND b.split = a.split AND b.family = best.best GROUP BY ALL),
cx(family, complexity) AS (VALUES ('conv', 1), ('eff', 2), ('vit', 3)),
t AS (SELECT split, family, best, criterion, difference, std_error, complexity, family = best OR difference <= std_error AS "within" FROM m JOIN best USING (split) JOIN dif USING (split, family) JOIN cx USING (family))"""


def one_se(t: Tables, means=None):
    cx = t.spark.createDataFrame(list(COMPLEXITY.items()), "family string, complexity int")
    return R.one_standard_error(losses(t, means), ["split"], "family", "obj_id", cx)


@query("a38_one_standard_error", with_sql(*ALIGNED, SCALE_SQL, LOSS_SQL, ONE_SE_SQL, body="""
SELECT split, family, best, complexity, round(criterion, 6) AS criterion, round(difference, 6) AS difference, round(std_error, 6) AS std_error, "within",
  family = first_value(family) OVER (PARTITION BY split ORDER BY (NOT "within"), complexity, criterion) AS chosen FROM t"""))
def _(t: Tables):
    return rounded(one_se(t), [])


@query("e13_challenger", with_sql(*ALIGNED, SCALE_SQL, LOSS_SQL, """d AS (SELECT a.family, a.loss, a.loss - b.loss AS d FROM loss a JOIN loss b ON a.obj_id = b.obj_id AND b.family = 'eff')""", body="""
SELECT family, round(avg(loss), 6) AS criterion, round(avg(d), 6) AS difference, round(stddev_samp(d) / sqrt(count(*)), 6) AS std_error,
  family <> 'eff' AND avg(d) < -greatest(stddev_samp(d) / sqrt(count(*)), 1e-6) AS wins FROM d GROUP BY family"""))
def _(t: Tables):
    return rounded(R.challenger(losses(t), "obj_id", "family", "eff"), [])


# --- ensembles ------------------------------------------------------------------------------------------------------------
@query("e01_seed_mean", with_sql(*ALIGNED, body="SELECT obj_id, target, family, y, pred FROM family_mean"))
def _(t: Tables):
    return family_mean(t).select("obj_id", "target", "family", "y", "pred")


@query("e02_uniform_mean", with_sql(*ALIGNED, """u AS (SELECT obj_id, split, target, max(y) AS y, avg(pred) AS pred FROM family_mean GROUP BY ALL)""", body="""
SELECT split, target, count(*) AS n, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(avg(pred - y), 6) AS bias FROM u GROUP BY ALL"""))
def _(t: Tables):
    u = E.uniform_mean(family_mean(t), ["obj_id", "split"])
    d = M.residuals(u, ["split", "target"])
    return rounded(M.moments(d, ["split", "target"]).select("split", "target", "n", "rmse", "bias"), [])


@query("e03_residual_gram", with_sql(*ALIGNED, body="""
SELECT a.target, a.family AS member_a, b.family AS member_b, count(*) AS n, round(avg((a.pred - a.y) * (b.pred - b.y)), 7) AS gram
FROM family_mean a JOIN family_mean b ON a.obj_id = b.obj_id AND a.target = b.target GROUP BY ALL"""))
def _(t: Tables):
    return E.residual_gram(E.member_rows(family_mean(t), "obj_id"), []).withColumn("gram", F.round("gram", 7))


def sigma_of(t: Tables) -> dict[str, float]:
    row = objects(t).where("split = 'Train'").agg(*[F.stddev_pop(x).alias(x) for x in TARGETS]).first()
    return row.asDict()


def blend_weights(t: Tables, regularization: float = 0.01, means=None):
    rows = E.member_rows((family_mean(t) if means is None else means).where("split <> 'Test'"), "obj_id")
    return E.convex_weights(E.residual_gram(rows, []), sigma_of(t), regularization)


# Independent statement of the simplex solution: every support of three members in closed form, best feasible one wins.
WEIGHTS_SQL = """gm AS (SELECT a.target, a.family AS i, b.family AS j, avg((a.pred - a.y) * (b.pred - b.y)) / (max(s.sigma) * max(s.sigma)) + CASE WHEN a.family = b.family THEN 0.01 ELSE 0 END AS q
  FROM family_mean a JOIN family_mean b ON a.obj_id = b.obj_id AND a.target = b.target JOIN scale s ON s.target = a.target WHERE a.split <> 'Test' GROUP BY a.target, a.family, b.family),
g AS (SELECT target, max(q) FILTER (i = 'conv' AND j = 'conv') AS a, max(q) FILTER (i = 'eff' AND j = 'eff') AS b, max(q) FILTER (i = 'vit' AND j = 'vit') AS c,
  max(q) FILTER (i = 'conv' AND j = 'eff') AS ab, max(q) FILTER (i = 'conv' AND j = 'vit') AS ac, max(q) FILTER (i = 'eff' AND j = 'vit') AS bc FROM gm GROUP BY target),
cand AS (SELECT *, 1.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3 FROM g UNION ALL SELECT *, 0, 1, 0 FROM g UNION ALL SELECT *, 0, 0, 1 FROM g
  UNION ALL SELECT *, (b - ab) / (a + b - 2 * ab), (a - ab) / (a + b - 2 * ab), 0 FROM g
  UNION ALL SELECT *, (c - ac) / (a + c - 2 * ac), 0, (a - ac) / (a + c - 2 * ac) FROM g
  UNION ALL SELECT *, 0, (c - bc) / (b + c - 2 * bc), (b - bc) / (b + c - 2 * bc) FROM g
  UNION ALL SELECT *, k1 / (k1 + k2 + k3), k2 / (k1 + k2 + k3), k3 / (k1 + k2 + k3) FROM (SELECT *, b * c - bc * bc - ab * c + ac * bc + ab * bc - b * ac AS k1,
      bc * ac - ab * c + a * c - ac * ac - a * bc + ab * ac AS k2, ab * bc - b * ac - a * bc + ab * ac + a * b - ab * ab AS k3 FROM g) z
  ),
val AS (SELECT target, w1, w2, w3, w1 * w1 * a + w2 * w2 * b + w3 * w3 * c + 2 * (w1 * w2 * ab + w1 * w3 * ac + w2 * w3 * bc) AS v FROM cand WHERE w1 >= 0 AND w2 >= 0 AND w3 >= 0),
wt AS (SELECT target, arg_min(w1, v) AS w1, arg_min(w2, v) AS w2, arg_min(w3, v) AS w3 FROM val GROUP BY target)""".replace("SELECT *, k1 / (k1", "SELECT target, a, b, c, ab, ac, bc, k1 / (k1")


@query("e03_convex_weights", with_sql(*ALIGNED, SCALE_SQL, WEIGHTS_SQL, body="""
SELECT target, 'conv' AS family, round(w1, 5) AS weight FROM wt UNION ALL SELECT target, 'eff', round(w2, 5) FROM wt UNION ALL SELECT target, 'vit', round(w3, 5) FROM wt"""))
def _(t: Tables):
    members, w = blend_weights(t)
    return E.weights_table(t.spark, w, members).withColumn("weight", F.round("weight", 5))


@query("e04_apply_weights", with_sql(*ALIGNED, SCALE_SQL, WEIGHTS_SQL, """bl AS (SELECT f.obj_id, f.split, f.target, max(f.y) AS y,
  sum(f.pred * CASE f.family WHEN 'conv' THEN w1 WHEN 'eff' THEN w2 ELSE w3 END) AS pred FROM family_mean f JOIN wt USING (target) GROUP BY ALL)""", body="""
SELECT split, target, count(*) AS n, round(sqrt(avg((pred - y) * (pred - y))), 5) AS rmse FROM bl GROUP BY ALL"""))
def _(t: Tables):
    members, w = blend_weights(t)
    d = E.apply_weights(family_mean(t), E.weights_table(t.spark, w, members), ["obj_id", "split"])
    e = F.col("pred") - F.col("y")
    return d.groupBy("split", "target").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"))


@query("a29_ambiguity", with_sql(*ALIGNED, SCALE_SQL, """en AS (SELECT obj_id, target, avg(pred) AS e FROM family_mean GROUP BY ALL)""", body="""
SELECT split, target, count(DISTINCT obj_id) AS n, round(avg((pred - y) * (pred - y)) / max(sigma * sigma), 6) AS member_error, round(avg((pred - e) * (pred - e)) / max(sigma * sigma), 6) AS ambiguity,
  round(avg((e - y) * (e - y)) / max(sigma * sigma), 6) AS ensemble_error FROM family_mean JOIN en USING (obj_id, target) JOIN scale USING (target) GROUP BY split, target"""))
def _(t: Tables):
    """Members weigh the same; errors in units of the squared train scale."""
    return rounded(E.ambiguity(family_mean(t), ["split"], "obj_id", scale=scale_of(t)), [])


@query("a29_weighted_ambiguity", with_sql(*ALIGNED, SCALE_SQL, WEIGHTS_SQL, """wm AS (SELECT f.*, CASE f.family WHEN 'conv' THEN w1 WHEN 'eff' THEN w2 ELSE w3 END AS w FROM family_mean f JOIN wt USING (target)),
en AS (SELECT obj_id, target, sum(w * pred) AS e FROM wm GROUP BY ALL)""", body="""
SELECT split, target, count(DISTINCT obj_id) AS n, round(sum(w * (pred - y) * (pred - y)) / count(DISTINCT obj_id) / max(sigma * sigma), 5) AS member_error,
  round(sum(w * (pred - e) * (pred - e)) / count(DISTINCT obj_id) / max(sigma * sigma), 5) AS ambiguity, round(sum(w * (e - y) * (e - y)) / count(DISTINCT obj_id) / max(sigma * sigma), 5) AS ensemble_error
FROM wm JOIN en USING (obj_id, target) JOIN scale USING (target) GROUP BY split, target"""))
def _(t: Tables):
    """With the weights of the convex blend."""
    means = kept_rows(family_mean(t))
    members, w = blend_weights(t, means=means)
    d = E.ambiguity(means, ["split"], "obj_id", E.weights_table(t.spark, w, members), scale_of(t))
    return d.select("split", "target", "n", *[F.round(c, 5).alias(c) for c in ("member_error", "ambiguity", "ensemble_error")])


@query("a30_disagreement", with_sql(*ALIGNED, body="""
SELECT split, target, count(*) AS n, round(avg(s), 6) AS mean, round(max(s), 6) AS max FROM (SELECT obj_id, split, target, stddev_pop(pred) AS s FROM family_mean GROUP BY ALL) GROUP BY ALL"""))
def _(t: Tables):
    d = E.disagreement(family_mean(t), ["obj_id", "split"])
    return rounded(d.groupBy("split", "target").agg(F.count("*").alias("n"), F.avg("disagreement").alias("mean"), F.max("disagreement").alias("max")), [])


A31_SQL = """s AS (SELECT obj_id, target, round(stddev_pop(pred), 6) AS s, round(abs(avg(pred) - max(y)), 6) AS e FROM family_mean GROUP BY ALL),
q AS (SELECT target, quantile_cont(s, [0.2, 0.4, 0.6, 0.8]) AS q FROM s GROUP BY target),
b AS (SELECT target, s, e, CAST((s >= q[1])::INT + (s >= q[2])::INT + (s >= q[3])::INT + (s >= q[4])::INT AS INTEGER) AS quintile FROM s JOIN q USING (target)),
rk AS (SELECT target, rank() OVER (PARTITION BY target ORDER BY s) + (count(*) OVER (PARTITION BY target, s) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY target ORDER BY e) + (count(*) OVER (PARTITION BY target, e) - 1) / 2.0 AS rb FROM s),
rho AS (SELECT target, corr(ra, rb) AS spearman FROM rk GROUP BY target)"""


@query("a31_error_by_disagreement", with_sql(*ALIGNED, A31_SQL, body="""
SELECT target, quintile, count(*) AS n, round(median(s), 5) AS centre, round(median(e), 5) AS median_error, round(quantile_cont(e, 0.84), 5) AS p84, round(max(spearman), 6) AS spearman
FROM b JOIN rho USING (target) GROUP BY target, quintile"""))
def _(t: Tables):
    """Disagreement between members as a signal of uncertainty."""
    d = E.disagreement(family_mean(t), ["obj_id"]).select("target", r6("disagreement").alias("s"), r6(F.abs(F.col("pred") - F.col("y"))).alias("e"))
    edges = cut_lineage(quantiles(d, ["target"], "s", {f"q{i}": i / 5 for i in range(1, 5)}))
    b = d.join(F.broadcast(edges), "target").withColumn("quintile", F.expr(" + ".join(f"int(s >= q{i})" for i in range(1, 5))))
    k = ["target", "quintile"]
    out = (b.groupBy(*k).agg(F.count("*").alias("n")).join(quantiles(b, k, "s", {"centre": 0.5}), k)
           .join(quantiles(b, k, "e", {"median_error": 0.5, "p84": 0.84}), k).join(spearman(d, ["target"], "s", "e"), "target"))
    return out.select("target", "quintile", "n", *[F.round(c, 5).alias(c) for c in ("centre", "median_error", "p84")], r6("spearman").alias("spearman"))


@query("e12_sealed_selection", with_sql(*ALIGNED, SCALE_SQL, LOSS_SQL, ONE_SE_SQL, """ch AS (SELECT family FROM (SELECT family, row_number() OVER (ORDER BY (NOT "within"), complexity, criterion) AS k FROM t WHERE split = 'Validation') WHERE k = 1),
h AS (SELECT md5(concat_ws('|', obj_id, target, printf('%.6f', pred))) AS h FROM family_mean JOIN ch USING (family) WHERE split = 'Validation'),
w AS (SELECT count(*) AS n, """ + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT) AS w{i}" for i in range(4)) + """ FROM h)""", body="""
SELECT a.attempt, ch.family AS registered, sha256(concat_ws('|', n, w0, w1, w2, w3)) AS fingerprint, a.attempt = 2 AS changed FROM ch, w, (VALUES (1), (2)) a(attempt)"""))
def _(t: Tables):
    """The choice is registered once; a second registration with altered predictions keeps the first and is reported."""
    from photonloom.operators.registry import ChoiceRegister
    from photonloom.plans.cohort_queries import fresh_path

    path, root = fresh_path(t, "register")
    means = kept_rows(family_mean(t))
    chosen = one_se(t, means).where("split = 'Validation' AND chosen").first()["family"]
    preds = means.where((F.col("family") == chosen) & (F.col("split") == "Validation")).select("obj_id", "target", "pred")
    reg = ChoiceRegister(t.spark, path, root)
    first = reg.register(chosen, preds, ["obj_id", "target"], "pred")
    second = reg.register("other", preds.withColumn("pred", F.col("pred") + 0.001), ["obj_id", "target"], "pred")
    return t.spark.createDataFrame([(1, *first), (2, *second)], "attempt int, registered string, fingerprint string, changed boolean")


@query("a53_input_importance", with_sql(*ALIGNED, f"""prm AS (SELECT a.obj_id, b.redshift AS z2 FROM (SELECT obj_id, row_number() OVER (ORDER BY obj_id) AS k FROM objects) a
  JOIN (SELECT obj_id, redshift, row_number() OVER (ORDER BY {h_sql('obj_id', 9)}, obj_id) AS k FROM objects) b USING (k)),
base AS (SELECT f.obj_id, f.family, f.target, f.y, f.pred, f.redshift, p.z2 FROM family_mean f JOIN prm p USING (obj_id)),
src AS (SELECT obj_id, family, target, (pred - y) * (pred - y) AS e0, (pred + 0.5 * (z2 - redshift) - y) * (pred + 0.5 * (z2 - redshift) - y) AS e1 FROM base)""",
    copies_sql("src", N_BOOT, 6, "obj_id, family, target, e0, e1"), """reps AS (SELECT family, target, rep, sqrt(sum(copies * e1) / sum(copies)) - sqrt(sum(copies * e0) / sum(copies)) AS d FROM copies GROUP BY ALL),
pt AS (SELECT family, target, sqrt(avg(e1)) - sqrt(avg(e0)) AS d0 FROM src GROUP BY ALL)""", body="""
SELECT 'redshift permuted' AS modification, family, target, round(max(d0), 6) AS increase, round(quantile_cont(d, 0.025), 6) AS d_lo, round(quantile_cont(d, 0.975), 6) AS d_hi FROM reps JOIN pt USING (family, target) GROUP BY family, target"""))
def _(t: Tables):
    """A covariate is permuted between all objects by a bijection, the model (linear in it) is re-evaluated, and the
    RMSE increase gets a paired interval."""
    perm = R.permuted_column(objects(t), "obj_id", "redshift", 9)
    d = family_mean(t).join(perm, "obj_id")
    e0 = F.col("pred") - F.col("y")
    e1 = F.col("pred") + 0.5 * (F.col("redshift_permuted") - F.col("redshift")) - F.col("y")
    src = cut_lineage(d.select("obj_id", "family", "target", (e0 * e0).alias("e0"), (e1 * e1).alias("e1")))
    reps = B.replicate_means(src, "obj_id", ["family", "target"], ["e0", "e1"], N_BOOT, 6)
    ci = R.interval(reps, ["family", "target"], {"d": F.sqrt("e1") - F.sqrt("e0")}, LEVELS)
    pt = src.groupBy("family", "target").agg((F.sqrt(F.avg("e1")) - F.sqrt(F.avg("e0"))).alias("increase"))
    return rounded(ci.join(pt, ["family", "target"]), []).withColumn("modification", F.lit("redshift permuted"))
