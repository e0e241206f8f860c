"""How the roles of a survey (catalogue, predictions, images) are read from the driver tables, in Spark and in SQL.

Every SQL text below is the independent statement of the same derivation; queries prepend the CTEs they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.plans.registry import Tables

TARGETS = ("log_mstar", "log_sfr", "d4000")
FAMILIES = ("conv", "vit", "eff")
SEEDS = (1, 2)
MEMBERS = [(f, k, s) for k, f in enumerate(FAMILIES) for s in SEEDS]

# --- objects: one order is one object of the catalogue ---------------------------------------------------------------
OBJECTS_SQL = """objects AS (
  SELECT o_orderkey AS obj_id, concat(o_custkey, '-', o_orderkey) AS mangaid,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Train'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Validation' ELSE 'Test' END AS split,
    o_orderstatus AS kind, o_custkey AS custkey, o_totalprice AS price,
    CASE WHEN o_totalprice >= 10000 THEN round(0.01 + o_totalprice / 5000000, 4) ELSE -1.0 END AS redshift,
    round(log10(o_totalprice) + 5, 3) AS log_mstar,
    round((o_custkey % 97) / 97.0 * 5 - 3.5 + (o_orderkey % 89) / 890.0, 3) AS log_sfr,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN NULL
         ELSE round(1 + dayofyear(o_orderdate) / 366.0 + (o_custkey % 11) / 110.0, 3) END AS d4000
  FROM orders)"""


def objects(t: Tables) -> DataFrame:
    src = t.spread("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return src.selectExpr(
        "o_orderkey AS obj_id", "concat_ws('-', o_custkey, o_orderkey) AS mangaid",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Train' "
        "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Validation' ELSE 'Test' END AS split",
        "o_orderstatus AS kind", "o_custkey AS custkey", "o_totalprice AS price",
        "IF(o_totalprice >= 10000, round(0.01D + o_totalprice / 5000000, 4), -1.0D) AS redshift",
        "round(log10(o_totalprice) + 5, 3) AS log_mstar",
        "round((o_custkey % 97) / 97.0D * 5 - 3.5D + (o_orderkey % 89) / 890.0D, 3) AS log_sfr",
        "IF(o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM', NULL, "
        "round(1 + dayofyear(o_orderdate) / 366.0D + (o_custkey % 11) / 110.0D, 3)) AS d4000")


# --- predictions: every (family, seed) predicts the three targets of every object --------------------------------------
# eff/seed 2 has no prediction where the redshift is invalid, so that alignment over members has something to drop.
PRED_WIDE_SQL = """members(family, f, seed) AS (VALUES {values}),
pred_wide AS (
  SELECT obj_id, mangaid, split, kind, custkey, redshift, log_mstar AS y_log_mstar, log_sfr AS y_log_sfr, d4000 AS y_d4000,
    {preds},
    family, seed
  FROM (SELECT *, {noises} FROM objects, members WHERE NOT (family = 'eff' AND seed = 2 AND redshift < 0)))""".format(
    values=", ".join(f"('{f}', {k}, {s})" for f, k, s in MEMBERS),
    noises=", ".join(f"2 * (((obj_id % 1000003) * 7919 + (f * 10 + seed) * 104729 * {j + 1} + {j} * 1299709) % 10007) / 10007.0 - 1 AS u{j}"
                     for j in range(3)),
    preds=",\n    ".join(f"round({t} + 0.02 * f - 0.01 * seed + ({0.1 * (j + 1):.1f} + 0.05 * f) * u{j} * u{j} * u{j}, 3) AS pred_{t}"
                         for j, t in enumerate(TARGETS)))


def pred_wide(t: Tables) -> DataFrame:
    """The prediction file format: ids, split, labels, predictions, family, seed. Members are exploded inside each row."""
    members = ", ".join(f"named_struct('family', '{f}', 'f', {k}, 'seed', {s})" for f, k, s in MEMBERS)
    d = objects(t).selectExpr("*", f"inline(array({members}))").where("NOT (family = 'eff' AND seed = 2 AND redshift < 0)")
    noise = [f"2 * (((obj_id % 1000003) * 7919 + (f * 10 + seed) * 104729 * {j + 1} + {j} * 1299709) % 10007) / 10007.0D - 1 AS u{j}"
             for j in range(3)]
    preds = [f"round({x} + 0.02D * f - 0.01D * seed + ({0.1 * (j + 1):.1f}D + 0.05D * f) * u{j} * u{j} * u{j}, 3) AS pred_{x}"
             for j, x in enumerate(TARGETS)]
    return d.selectExpr("*", *noise).selectExpr("obj_id", "mangaid", "split", "kind", "custkey", "redshift",
                                                *[f"{x} AS y_{x}" for x in TARGETS], *preds, "family", "seed")


PRED_LONG_SQL = "pred_long AS (\n" + "\n  UNION ALL ".join(
    f"SELECT obj_id, mangaid, split, kind, custkey, redshift, family, seed, '{t}' AS target, y_{t} AS y, pred_{t} AS pred FROM pred_wide"
    for t in TARGETS) + ")"

PRED_SQL = f"{OBJECTS_SQL},\n{PRED_WIDE_SQL},\n{PRED_LONG_SQL}"


def to_long(wide: DataFrame, targets=TARGETS) -> DataFrame:
    """Unpivot the targets inside each row: no shuffle."""
    row = ", ".join(f"named_struct('target', '{x}', 'y', y_{x}, 'pred', pred_{x})" for x in targets)
    return wide.selectExpr(*[c for c in wide.columns if not c.startswith(("y_", "pred_"))], f"inline(array({row}))")


def pred_long(t: Tables) -> DataFrame:
    return to_long(pred_wide(t))


# --- seed means and the train scale -----------------------------------------------------------------------------------
SCALE_SQL = "scale AS (\n" + "\n  UNION ALL ".join(
    f"SELECT '{t}' AS target, stddev_pop({t}) AS sigma, median({t}) AS train_median FROM objects WHERE split = 'Train'"
    for t in TARGETS) + ")"

# Seed mean of objects every member predicts, with complete labels.
ALIGNED_SQL = """aligned AS (
  SELECT * FROM pred_long WHERE y IS NOT NULL AND pred IS NOT NULL AND obj_id IN (
    SELECT obj_id FROM pred_wide WHERE y_d4000 IS NOT NULL GROUP BY obj_id HAVING count(DISTINCT family || '_' || seed) = 6)),
family_mean AS (
  SELECT obj_id, split, kind, redshift, target, family, max(y) AS y, round(avg(pred), 6) AS pred
  FROM aligned GROUP BY obj_id, split, kind, redshift, target, family)"""


# --- images: 25 consecutive embeddings (8 x 8) tile one 40 x 40 image; three bands add a disc, a neighbour and the sky -----
SIDE = 40
#: Images of one task. Their arrays are small, the rows exploded from them are not.
IMAGES_PER_TASK = 100
PIXELS_SQL = """tiles AS (
  SELECT vec_id // 25 AS obj_id, (vec_id % 25) // 5 AS ty, vec_id % 5 AS tx, unnest(range(1, 65)) AS p, unnest(embedding) AS e, label
  FROM embeddings),
grid AS (
  SELECT CAST(obj_id AS BIGINT) AS obj_id, CAST(ty * 8 + (p - 1) // 8 AS INTEGER) AS y, CAST(tx * 8 + (p - 1) % 8 AS INTEGER) AS x, CAST(e AS DOUBLE) AS e
  FROM tiles),
bands(band, b) AS (VALUES ('g', 0), ('r', 1), ('z', 2)),
pixels AS (
  SELECT obj_id, band, y, x,
    CASE WHEN y < 1 AND x < obj_id % 5 THEN 0.0 ELSE
    round(0.05 + 0.02 * b + (0.08 + 0.02 * b) * e
      + (1 + 0.5 * b) * exp(-sqrt((y - 19.5) * (y - 19.5) + 1.5 * (x - 19.5) * (x - 19.5)) / (2.5 + (obj_id % 4) * 0.25))
      + 0.8 * exp(-((y - 6) * (y - 6) + (x - 31 + obj_id % 3) * (x - 31 + obj_id % 3)) / 4.0), 4) END AS flux
  FROM grid, bands)"""


def images(t: Tables) -> DataFrame:
    """(obj_id, ty, tx, embedding): the tiles of an image share a partition, so pixel rows need no further shuffle."""
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-t.embeddings.count() // (25 * IMAGES_PER_TASK)))
    return (t.embeddings.select(F.expr("vec_id div 25").alias("obj_id"), F.expr("int((vec_id % 25) div 5)").alias("ty"),
                                F.expr("int(vec_id % 5)").alias("tx"), "embedding")
            .repartition(tasks, "obj_id"))


def pixels(t: Tables) -> DataFrame:
    d = images(t).select("obj_id", "ty", "tx", F.posexplode("embedding").alias("p", "e"))
    d = d.selectExpr("obj_id", "int(ty * 8 + p div 8) AS y", "int(tx * 8 + p % 8) AS x", "double(e) AS e",
                     "inline(array(named_struct('band', 'g', 'b', 0), named_struct('band', 'r', 'b', 1), named_struct('band', 'z', 'b', 2)))")
    return d.selectExpr("obj_id", "band", "y", "x", """IF(y < 1 AND x < obj_id % 5, 0.0D,
      round(0.05D + 0.02D * b + (0.08D + 0.02D * b) * e
      + (1 + 0.5D * b) * exp(-sqrt((y - 19.5D) * (y - 19.5D) + 1.5D * (x - 19.5D) * (x - 19.5D)) / (2.5D + (obj_id % 4) * 0.25D))
      + 0.8D * exp(-((y - 6) * (y - 6) + (x - 31 + obj_id % 3) * (x - 31 + obj_id % 3)) / 4.0D), 4)) AS flux""")


# --- the catalogue side --------------------------------------------------------------------------------------------------
def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def aligned(t: Tables) -> DataFrame:
    """Predictions of objects that every member predicts and whose labels are complete."""
    from photonloom.operators.alignment import align_members

    wide = pred_wide(t).where("y_d4000 IS NOT NULL")
    return to_long(align_members(wide, "obj_id", ["family", "seed"], n_members=len(MEMBERS)))


def family_mean(t: Tables) -> DataFrame:
    """Mean over the seeds of a family. The targets are unpivoted afterwards: a third of the rows enter the groups."""
    from photonloom.operators.alignment import align_members

    wide = align_members(pred_wide(t).where("y_d4000 IS NOT NULL"), "obj_id", ["family", "seed"], n_members=len(MEMBERS))
    means = [c for x in TARGETS for c in (F.max(f"y_{x}").alias(f"y_{x}"), F.round(F.avg(f"pred_{x}"), 6).alias(f"pred_{x}"))]
    return to_long(wide.groupBy("obj_id", "split", "kind", "redshift", "family").agg(*means)).select("obj_id", "split", "kind", "redshift", "target", "family", "y", "pred")


def family_residuals(t: Tables) -> DataFrame:
    """(obj_id, split, kind, redshift, r_family_target...): `family_mean` minus its label with a column per family and target. The prediction
    rows are grouped before the members of an object are counted, so a sixth of them is ordered."""
    rows = pred_wide(t).where("y_d4000 IS NOT NULL").select("obj_id", "split", "kind", "redshift", *[f"y_{x}" for x in TARGETS], *[f"pred_{x}" for x in TARGETS], "family", "seed")
    member = F.coalesce(*[F.when((F.col("family") == f) & (F.col("seed") == s), F.lit(1 << i)) for i, (f, _, s) in enumerate(MEMBERS)])
    own = lambda f, c: F.when(F.col("family") == f, F.col(c))
    means = [(F.round(F.avg(own(f, f"pred_{x}")), 6) - F.max(own(f, f"y_{x}"))).alias(f"r_{f}_{x}") for f in FAMILIES for x in TARGETS]
    wide = rows.repartition("obj_id").groupBy("obj_id", "split", "kind", "redshift").agg(F.bit_or(member).alias("_members"), *means)
    found = F.bit_or("_members").over(W.partitionBy("obj_id"))
    return wide.withColumn("_members", found).where(F.col("_members") == (1 << len(MEMBERS)) - 1).drop("_members")


def scale_of(t: Tables) -> DataFrame:
    """One row per target: sigma and median of the train labels."""
    from photonloom.operators.distribution import quantiles

    d = (objects(t).where("split = 'Train'")
         .selectExpr("inline(array(" + ", ".join(f"named_struct('target', '{x}', 'v', {x})" for x in TARGETS) + "))"))
    return (d.groupBy("target").agg(F.stddev_pop("v").alias("sigma"))
            .join(quantiles(d, ["target"], "v", {"train_median": 0.5}), "target"))
