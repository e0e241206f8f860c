"""Queries: sources, predicates, joins, sets and contracts (S, P, J, U, V)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from photonloom.functions import scalars as S
from photonloom.operators import alignment as A
from photonloom.operators import cohort as C
from photonloom.operators import contracts as V
from photonloom.plans.bindings import (ALIGNED_SQL, MEMBERS, OBJECTS_SQL, PRED_SQL, TARGETS, aligned, family_mean, objects, pred_long,
                                       pred_wide, with_sql)
from photonloom.plans.registry import Tables, query
from photonloom.session import shared_dir
from photonloom.sources import readers, sinks


def fresh_path(t: Tables, name: str) -> tuple[str, str]:
    root = shared_dir(t.spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", root


# --- sources and sinks ----------------------------------------------------------------------------------------------------
@query("s01_catalogue_csv", """SELECT CAST(c_custkey AS VARCHAR) AS mangaid, trim(c_name) AS name, c_acctbal AS ra, CAST(c_nationkey AS DOUBLE) AS dec FROM customer""")
def _(t: Tables):
    """Written once as CSV, read back with an explicit schema and text ids."""
    path, root = fresh_path(t, "catalogue")
    src = t.customer.selectExpr("concat(' ', c_custkey, ' ') AS mangaid", "c_name AS name", "c_acctbal AS ra", "double(c_nationkey) AS dec")
    sinks.guarded_write(src, path, root, fmt="csv", header=True)
    return readers.read_catalogue(t.spark, path, "mangaid string, name string, ra double, dec double", "mangaid")


@query("s03_prediction_folder", with_sql(PRED_SQL, body="""
SELECT family, seed, split, count(*) AS n, round(sum(pred_log_mstar), 3) AS total FROM pred_wide GROUP BY family, seed, split"""))
def _(t: Tables):
    from photonloom.sources.predictions import write_prediction_files

    path, root = fresh_path(t, "predictions")
    d = pred_wide(t).select("mangaid", "split", "redshift", *[f"y_{x}" for x in TARGETS], *[f"pred_{x}" for x in TARGETS], "family", "seed")
    write_prediction_files(d, path, root)
    back = readers.read_predictions(t.spark, path, d.schema)
    return back.groupBy("family", "seed", "split").agg(F.count("*").alias("n"), F.round(F.sum("pred_log_mstar"), 3).alias("total"))


@query("s04_train_scale_json", with_sql(OBJECTS_SQL, body="SELECT target, round(sigma, 6) AS sigma FROM (" + " UNION ALL ".join(
    f"SELECT '{x}' AS target, stddev_pop({x}) AS sigma FROM objects WHERE split = 'Train'" for x in TARGETS) + ")"))
def _(t: Tables):
    path, root = fresh_path(t, "scale")
    sinks.stage_summary(objects(t).where("split = 'Train'"), [], [F.stddev_pop(x).alias(x) for x in TARGETS], path, root)
    return readers.read_scale(t.spark, path, TARGETS).withColumn("sigma", S.r6("sigma"))


@query("s05_file_inventory", with_sql(OBJECTS_SQL, body="SELECT split AS obj_id, true AS has_bytes, 1::BIGINT AS n_files FROM objects GROUP BY split"))
def _(t: Tables):
    path, root = fresh_path(t, "inventory")
    sinks.guarded_write(objects(t).select("split", "obj_id").repartition("split"), path, root, partition_by=["split"])
    inv = readers.file_inventory(t.spark, path, r"^(part)-").withColumn("obj_id", F.regexp_extract("path", r"split=([A-Za-z]+)/", 1))
    return inv.groupBy("obj_id").agg(F.max(F.col("length") > 0).alias("has_bytes"), F.count("*").alias("n_files"))


@query("s09_manifest_with_url", """
SELECT c_custkey AS obj_id, 'https://www.legacysurvey.org/viewer/fits-cutout?ra=' || printf('%.6f', c_custkey % 360 + 0.25) || '&dec=' || printf('%.6f', c_nationkey * 3.5 - 40)
  || '&layer=ls-dr10&pixscale=0.262&size=800&bands=grz' AS cutout_url FROM customer""")
def _(t: Tables):
    d = t.customer.selectExpr("c_custkey AS obj_id", "c_custkey % 360 + 0.25D AS ra", "c_nationkey * 3.5D - 40 AS dec")
    return d.select("obj_id", sinks.cutout_url("ra", "dec", ("g", "r", "z"), 800, 0.262, "ls-dr10").alias("cutout_url"))


@query("s10_output_per_split", with_sql(OBJECTS_SQL, body="SELECT split, count(*) AS n, CAST(sum(obj_id) AS BIGINT) AS id_sum FROM objects GROUP BY split"))
def _(t: Tables):
    path, root = fresh_path(t, "splits")
    sinks.write_by_split(objects(t).select("obj_id", "split"), path, root)
    return t.spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("obj_id").alias("id_sum"))


@query("s11_export_predictions", with_sql(PRED_SQL, body="""
SELECT obj_id, split, redshift, y_log_mstar, y_log_sfr, y_d4000, pred_log_mstar, pred_log_sfr, pred_d4000, family, seed, false AS averaged_views
FROM pred_wide WHERE family = 'conv' AND seed = 1"""))
def _(t: Tables):
    p = pred_wide(t).where("family = 'conv' AND seed = 1").select("obj_id", *[f"pred_{x}" for x in TARGETS])
    return sinks.prediction_table(objects(t), p, "obj_id", TARGETS, "conv", 1, False)


@query("s12_training_pack", """
SELECT e.vec_id, l.quality, l.toxic, len(e.embedding) AS n_px, (SELECT count(*) FROM (SELECT unnest(e.embedding) AS v) WHERE v > 0) AS mask_px
FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id""")
def _(t: Tables):
    ids = t.embeddings.select("vec_id")
    images = t.embeddings.select("vec_id", "embedding")
    masks = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v > 0).alias("mask"))
    labels = t.labels.withColumnRenamed("doc_id", "vec_id")
    d = sinks.training_pack(ids, images, masks, labels, "vec_id")
    return d.select("vec_id", "quality", "toxic", F.size("embedding").cast("bigint").alias("n_px"),
                    F.size(F.filter("mask", lambda v: v)).cast("bigint").alias("mask_px"))


@query("s13_ensemble_store", with_sql(PRED_SQL, body="""
SELECT split, repetition, count(*) AS n, round(sum(pred), 3) AS total FROM (
  SELECT obj_id, split, CASE WHEN split = 'Test' THEN -1 ELSE seed - 1 END AS repetition, avg(pred_log_mstar) AS pred FROM pred_wide
  WHERE split <> 'Train' AND family = 'conv' GROUP BY ALL) GROUP BY split, repetition"""))
def _(t: Tables):
    path, root = fresh_path(t, "ensemble")
    w = pred_wide(t).where("family = 'conv'")
    val = w.where("split = 'Validation'").selectExpr("obj_id", "seed - 1 AS repetition", "pred_log_mstar AS pred")
    test = w.where("split = 'Test'").groupBy("obj_id").agg(F.avg("pred_log_mstar").alias("pred"))
    rows = sinks.ensemble_rows(val, test)
    sinks.guarded_write(rows, path, root)
    back = readers.read_ensemble(t.spark, path, rows.schema, objects(t).where("split <> 'Train'"), "obj_id")
    return back.groupBy("split", "repetition").agg(F.count("*").alias("n"), F.round(F.sum("pred"), 3).alias("total"))


@query("s14_run_table", with_sql(PRED_SQL, body="""
SELECT family || '-' || seed AS run_id, count(*) AS n, round(sqrt(avg((pred_log_sfr - y_log_sfr) * (pred_log_sfr - y_log_sfr))), 6) AS rmse FROM pred_wide GROUP BY ALL"""))
def _(t: Tables):
    """Half of the runs are stored first; the second pass appends only what is missing."""
    path, root = fresh_path(t, "runs")
    e = F.col("pred_log_sfr") - F.col("y_log_sfr")
    runs = (pred_wide(t).groupBy(F.concat_ws("-", "family", F.col("seed").cast("string")).alias("run_id"))
            .agg(F.count("*").alias("n"), S.r6(F.sqrt(F.avg(e * e))).alias("rmse")))
    sinks.append_runs(runs.where("run_id LIKE '%-1'"), path, root, "run_id")
    sinks.append_runs(runs, path, root, "run_id")
    return t.spark.read.parquet(path)


@query("s15_stage_summary", """SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, max(n_chars) AS max_chars FROM documents GROUP BY source""")
def _(t: Tables):
    return sinks.stage_summary(t.documents, ["source"], [F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.max("n_chars").alias("max_chars")])


# --- predicates -----------------------------------------------------------------------------------------------------------
@query("p01_published_cuts", with_sql(OBJECTS_SQL, body="""
SELECT obj_id, d4000 IS NOT NULL AND log_mstar > 8 AND log_mstar < 12 AND log_sfr > -4 AND log_sfr < 2 AS passes FROM objects"""))
def _(t: Tables):
    return objects(t).select("obj_id", C.published_cuts().alias("passes"))


@query("p02_source_quality_masks", """
SELECT c_custkey AS obj_id, c_acctbal > 0 AND c_acctbal < 9000 AS primary_valid, c_nationkey IS NOT NULL AS secondary_available, c_acctbal < -900 OR c_acctbal > 9900 AS extreme,
  CASE WHEN c_acctbal < 0 THEN 'early' WHEN c_acctbal < 5000 THEN 'late' ELSE 'unclassified' END AS class,
  CASE WHEN c_acctbal > 9000 THEN 'above cap' ELSE 'valid' END AS state FROM customer""")
def _(t: Tables):
    b = F.col("c_acctbal")
    return t.customer.select(F.col("c_custkey").alias("obj_id"), ((b > 0) & (b < 9000)).alias("primary_valid"), F.col("c_nationkey").isNotNull().alias("secondary_available"),
                             ((b < -900) | (b > 9900)).alias("extreme"),
                             C.by_ranges("c_acctbal", {"early": (None, 0.0), "late": (0.0, 5000.0)}, "unclassified").alias("class"),
                             C.validity_state("c_acctbal", 9000.0).alias("state"))


REASONS_SQL = """reasons AS (SELECT obj_id, split, concat_ws('; ', CASE WHEN log_mstar IS NULL OR log_sfr IS NULL OR d4000 IS NULL THEN 'label not finite' END,
  CASE WHEN NOT (redshift > 0) THEN 'redshift not valid' END, CASE WHEN price < 3000 THEN 'band all zero' END) AS reason FROM objects)"""


def with_reasons(t: Tables):
    labels_ok = S.finite("log_mstar").isNotNull() & S.finite("log_sfr").isNotNull() & S.finite("d4000").isNotNull()
    return C.add_reasons(objects(t), {"label not finite": ~labels_ok, "redshift not valid": ~F.coalesce(S.finite("redshift") > 0, F.lit(False)),
                                      "band all zero": F.col("price") < 3000}).select("obj_id", "split", "reason")


@query("p05_exclusion_reasons", with_sql(OBJECTS_SQL, REASONS_SQL, body="SELECT obj_id, split, reason FROM reasons WHERE reason <> ''"))
def _(t: Tables):
    return with_reasons(t).where("reason <> ''")


@query("a17_exclusion_report", with_sql(OBJECTS_SQL, REASONS_SQL, body="""
SELECT reason, count(*) FILTER (split = 'Train') AS "Train", count(*) FILTER (split = 'Validation') AS "Validation", count(*) FILTER (split = 'Test') AS "Test"
FROM reasons WHERE reason <> '' GROUP BY reason"""))
def _(t: Tables):
    d = with_reasons(t).where("reason <> ''")
    return d.groupBy("reason").pivot("split", ["Train", "Validation", "Test"]).agg(F.count("split")).fillna(0)


QC_SQL = """qc AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 7 AND l_quantity > 40 THEN 9 ELSE l_linenumber - 1 END AS qcflag FROM lineitem)"""


@query("p06_qc_filter", with_sql(QC_SQL, body="""
SELECT reason, count(*) AS n FROM (SELECT 'QCFLAG=' || qcflag || ' (' || CASE WHEN qcflag IN (1, 2) THEN 'BAD: ' ELSE 'UNKNOWN: ' END ||
  CASE qcflag WHEN 1 THEN 'wrong redshift' WHEN 2 THEN 'low S/N or empty field' ELSE 'no data' END || ')' AS reason FROM qc WHERE qcflag IN (1, 2, 9)) GROUP BY reason"""))
def _(t: Tables):
    d = C.with_qc_group(t.lineitem.selectExpr("IF(l_linenumber = 7 AND l_quantity > 40, 9, l_linenumber - 1) AS qcflag"))
    _, excluded = C.apply_qc(d, ["OK", "WARNING"])
    return excluded.groupBy("reason").agg(F.count("*").alias("n"))


@query("p07_code_groups", with_sql(QC_SQL, body="""
SELECT CASE WHEN qcflag = 0 THEN 'OK' WHEN qcflag IN (1, 2) THEN 'BAD' WHEN qcflag BETWEEN 3 AND 7 THEN 'WARNING' ELSE 'UNKNOWN' END AS qc_group, count(*) AS n FROM qc GROUP BY 1"""))
def _(t: Tables):
    d = t.lineitem.selectExpr("IF(l_linenumber = 7 AND l_quantity > 40, 9, l_linenumber - 1) AS qcflag")
    return C.with_qc_group(d).groupBy("qc_group").agg(F.count("*").alias("n"))


@query("p08_text_to_number", """SELECT event_type, count(*) AS n, count(TRY_CAST(replace(replace(json_extract_string(props, '$.k'), '9', 'x'), '"', '') AS DOUBLE)) AS n_number,
  sum(TRY_CAST(replace(json_extract_string(props, '$.k'), '9', 'x') AS DOUBLE)) AS total FROM events GROUP BY event_type""")
def _(t: Tables):
    """JSON text field, one digit spoilt, so that bad text occurs and must become missing."""
    d = t.events.select("event_type", F.translate(F.get_json_object("props", "$.k"), "9", "x").alias("k"))
    return C.to_number(d, ["k"]).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_number"), F.sum("k").alias("total"))


@query("p09_id_and_coordinates", """
SELECT count(*) FILTER (regexp_matches(id, '^\\d+-\\d+$')) AS n_good_id, count(*) FILTER (ra >= 0 AND ra < 360 AND dec BETWEEN -90 AND 90) AS n_good_position, count(*) AS n
FROM (SELECT CASE WHEN c_acctbal < 0 THEN c_name ELSE c_nationkey || '-' || c_custkey END AS id, c_acctbal / 25 AS ra, c_nationkey * 8.0 - 100 AS dec FROM customer)""")
def _(t: Tables):
    d = t.customer.selectExpr("IF(c_acctbal < 0, c_name, concat_ws('-', c_nationkey, c_custkey)) AS id", "c_acctbal / 25 AS ra", "c_nationkey * 8.0D - 100 AS dec")
    return d.agg(F.count_if(F.col("id").rlike(S.ID_PATTERN)).alias("n_good_id"), F.count_if(C.valid_coordinates("ra", "dec")).alias("n_good_position"), F.count("*").alias("n"))


@query("p11_specific_rate_class", with_sql(OBJECTS_SQL, body="""
SELECT CASE WHEN log_sfr - log_mstar > -10.8 THEN 'forming' ELSE 'quenched' END AS class, split, count(*) AS n, round(avg(log_sfr - log_mstar), 6) AS mean_rate FROM objects GROUP BY ALL"""))
def _(t: Tables):
    d = objects(t).withColumn("rate", C.specific_rate("log_sfr", "log_mstar")).withColumn("class", F.when(F.col("rate") > -10.8, "forming").otherwise("quenched"))
    return d.groupBy("class", "split").agg(F.count("*").alias("n"), S.r6(F.avg("rate")).alias("mean_rate"))


@query("p12_coverage_flags", """
WITH z AS (SELECT l_orderkey AS obj_id, avg((l_discount = 0)::INT) AS zg, avg((l_tax = 0)::INT) AS zr, avg((l_returnflag = 'N')::INT) AS zz FROM lineitem GROUP BY l_orderkey)
SELECT greatest(zg, zr, zz) > 0.05 AS partial, greatest(zg, zr, zz) >= 0.999 AS empty, count(*) AS n FROM z GROUP BY ALL""")
def _(t: Tables):
    z = t.lineitem.groupBy("l_orderkey").agg(F.avg(F.expr("int(l_discount = 0)")).alias("zg"), F.avg(F.expr("int(l_tax = 0)")).alias("zr"),
                                             F.avg(F.expr("int(l_returnflag = 'N')")).alias("zz"))
    partial, empty = C.coverage_flags(["zg", "zr", "zz"])
    return z.groupBy(partial.alias("partial"), empty.alias("empty")).agg(F.count("*").alias("n"))


@query("p13_explicit_exclusions", """
SELECT s.s_suppkey AS obj_id, coalesce(n.n_name || ' excluded', 'kept') AS reason, s.s_suppkey IN (SELECT l_suppkey FROM lineitem) AS in_catalogue
FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON s.s_nationkey = n.n_nationkey""")
def _(t: Tables):
    listed = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.concat("n_name", F.lit(" excluded")).alias("reason"))
    seen = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.lit(True).alias("hit"))
    return (t.supplier.join(listed, "s_nationkey", "left").join(seen, "s_suppkey", "left")
            .select(F.col("s_suppkey").alias("obj_id"), F.coalesce("reason", F.lit("kept")).alias("reason"), F.coalesce("hit", F.lit(False)).alias("in_catalogue")))


@query("p15_common_cohort", """
SELECT d.lang, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IN ('en', 'de', 'fr') AND coalesce(l.quality = 1, false) AND coalesce(l.toxic = 0, false) GROUP BY d.lang""")
def _(t: Tables):
    lab = t.labels.selectExpr("doc_id", "quality = 1 AS good", "toxic = 0 AS clean")
    d = t.documents.select("doc_id", "lang").join(lab, "doc_id", "left")
    return d.where(C.common_cohort("lang", ["en", "de", "fr"], "good", "clean")).groupBy("lang").agg(F.count("*").alias("n"))


@query("p16_geometry_check", """
SELECT CASE WHEN l_linenumber = 7 THEN 'shape' WHEN l_returnflag = 'R' THEN 'band order' WHEN abs(20.5 + l_tax * 20 - 20.5) > 1.0 THEN 'centre'
  WHEN abs(0.262 + l_discount / 10 - 0.262) > 0.00262 THEN 'pixel scale' WHEN l_linestatus = 'F' THEN 'rotated' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t: Tables):
    h = t.lineitem.selectExpr("array(40, 40, IF(l_linenumber = 7, 1, 3)) AS naxis", "IF(l_returnflag = 'R', array('z', 'r', 'g'), array('g', 'r', 'z')) AS bands",
                              "array(20.5D + l_tax * 20, 20.5D) AS crpix", "0.262D + l_discount / 10 AS scale", "l_linestatus = 'F' AS rotated")
    r = C.geometry_reason("naxis", "bands", "crpix", "scale", "rotated", 40, ("g", "r", "z"), 0.262)
    return h.groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


# --- joins ----------------------------------------------------------------------------------------------------------------
@query("j01_manifest_first_per_id", """
SELECT obj_id, segment, price, orderkey FROM (SELECT c_custkey AS obj_id, c_mktsegment AS segment, o_totalprice AS price, o_orderkey AS orderkey,
  row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS rn FROM customer LEFT JOIN orders ON c_custkey = o_custkey) WHERE rn = 1""")
def _(t: Tables):
    cat = t.customer.selectExpr("c_custkey AS obj_id", "c_mktsegment AS segment")
    lab = t.orders.selectExpr("o_custkey AS obj_id", "o_totalprice AS price", "o_orderkey AS orderkey")
    return C.manifest(cat, lab, "obj_id", "orderkey")


@query("j02_match_indicator", """
SELECT CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS matched, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def _(t: Tables):
    V.require(V.join_cardinality(t.documents.select("doc_id"), t.labels.select("doc_id"), ["doc_id"]), "documents and labels are not 1:1")
    d = C.indicator_join(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), ["doc_id"])
    return d.groupBy("matched").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"))


@query("j03_cohort_build", with_sql(PRED_SQL, body="""
SELECT o.split, o.kind, count(*) AS n, count(p.pred_d4000) AS n_pred, count(*) FILTER (o.d4000 IS NOT NULL AND o.log_mstar > 8 AND o.log_mstar < 12 AND o.log_sfr > -4 AND o.log_sfr < 2) AS n_pass
FROM objects o JOIN customer c ON c.c_custkey = o.custkey LEFT JOIN (SELECT * FROM pred_wide WHERE family = 'eff' AND seed = 2) p USING (obj_id) GROUP BY o.split, o.kind"""))
def _(t: Tables):
    ext = pred_wide(t).where("family = 'eff' AND seed = 2").select("obj_id", "pred_d4000")
    master = t.customer.select(F.col("c_custkey").alias("custkey"))
    d = objects(t).join(master, "custkey").join(ext, "obj_id", "left")
    return d.groupBy("split", "kind").agg(F.count("*").alias("n"), F.count("pred_d4000").alias("n_pred"), F.count_if(C.published_cuts()).alias("n_pass"))


@query("j04_closest_observation", """
WITH m AS (SELECT o_orderkey AS obj_id, l_linenumber, l_suppkey, coalesce(abs(o_totalprice / 10 - l_extendedprice) + abs(o_custkey - l_partkey), 'Infinity') AS dist
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)
SELECT obj_id, l_linenumber, l_suppkey, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY dist, l_linenumber, l_suppkey) AS rn FROM m) WHERE rn = 1""")
def _(t: Tables):
    left = t.orders.selectExpr("o_orderkey AS obj_id", "o_totalprice / 10 AS a", "o_custkey AS b")
    right = t.lineitem.selectExpr("l_orderkey AS obj_id", "l_linenumber", "l_suppkey", "l_extendedprice AS ra", "l_partkey AS rb")
    out = C.closest_match(left, right, "obj_id", {"a": "ra", "b": "rb"}, ["l_linenumber", "l_suppkey"], ["l_linenumber", "l_suppkey"])
    return out.withColumn("dist", S.round_scaled("dist", 4))


@query("j05_catalogue_cross_check", with_sql(OBJECTS_SQL, body="""
SELECT count(*) FILTER (b.obj_id IS NULL) AS unmatched, count(*) FILTER (abs(a.log_mstar - b.log_mstar) > 1e-9) AS log_mstar_diff, count(*) FILTER (abs(a.d4000 - b.d4000) > 1e-9) AS d4000_diff,
  count(*) FILTER (a.split IS DISTINCT FROM b.split OR b.split IS NULL) AS split_diff
FROM objects a LEFT JOIN (SELECT obj_id, CASE WHEN kind = 'F' THEN log_mstar + 0.01 ELSE log_mstar END AS log_mstar, CASE WHEN kind = 'P' THEN NULL ELSE d4000 END AS d4000,
  CASE WHEN price > 450000 THEN 'Train' ELSE split END AS split FROM objects WHERE redshift > 0) b USING (obj_id)"""))
def _(t: Tables):
    a = objects(t)
    b = a.where("redshift > 0").selectExpr("obj_id", "IF(kind = 'F', log_mstar + 0.01D, log_mstar) AS log_mstar", "IF(kind = 'P', NULL, d4000) AS d4000", "IF(price > 450000, 'Train', split) AS split")
    return C.cross_check(a, b, "obj_id", ["log_mstar", "d4000"], ["split"])


@query("j06_key_set_difference", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a
FULL JOIN (SELECT DISTINCT o_custkey + 3 AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def _(t: Tables):
    return C.key_set_difference(t.customer.selectExpr("c_custkey AS k"), t.orders.selectExpr("o_custkey + 3 AS k"), "k")


@query("j07_membership_filter", "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang")
def _(t: Tables):
    return (t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
            .groupBy("lang").agg(F.count("*").alias("n")))


@query("j08_anti_join_diagnostics", with_sql(PRED_SQL, body="""
SELECT 'without prediction' AS problem, split AS grp, count(*) AS n FROM objects WHERE obj_id NOT IN (SELECT obj_id FROM pred_wide WHERE family = 'eff' AND seed = 2) GROUP BY ALL
UNION ALL SELECT 'without label', lang, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL"""))
def _(t: Tables):
    p = pred_wide(t).where("family = 'eff' AND seed = 2").select("obj_id")
    a = objects(t).join(p, "obj_id", "left_anti").groupBy(F.col("split").alias("grp")).agg(F.count("*").alias("n")).withColumn("problem", F.lit("without prediction"))
    b = (t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti").groupBy(F.col("lang").alias("grp"))
         .agg(F.count("*").alias("n")).withColumn("problem", F.lit("without label")))
    return a.unionByName(b)


@query("j09_member_alignment", with_sql(*[PRED_SQL, ALIGNED_SQL], body="""
SELECT split, family, seed, count(DISTINCT obj_id) AS n_objects, (SELECT count(*) FROM (SELECT obj_id FROM pred_wide GROUP BY obj_id HAVING max(y_log_mstar) - min(y_log_mstar) > 1e-6)) AS n_conflicts
FROM aligned GROUP BY split, family, seed"""))
def _(t: Tables):
    conflicts = A.label_conflicts(pred_wide(t), "obj_id", [f"y_{x}" for x in TARGETS] + ["redshift"]).agg(F.count("*").alias("n"))
    # Every object keeps three target rows per member, so the count needs no distinct.
    return (aligned(t).groupBy("split", "family", "seed").agg((F.count("*") / 3).cast("bigint").alias("n_objects"))
            .select("*", conflicts.scalar().alias("n_conflicts")))


@query("j10_paired_models", with_sql(PRED_SQL, body="""
SELECT a.split, a.target, count(*) AS n, count(*) FILTER (abs(a.y - b.y) <= 1e-6) AS n_agree, round(avg(abs(a.pred - b.pred)), 6) AS mean_gap
FROM pred_long a JOIN pred_long b ON a.obj_id = b.obj_id AND a.split = b.split AND a.target = b.target AND a.seed = b.seed
WHERE a.family = 'conv' AND b.family = 'vit' GROUP BY a.split, a.target"""))
def _(t: Tables):
    p = pred_long(t)
    d = A.pair_models(p.where("family = 'conv'"), p.where("family = 'vit'"), ["obj_id", "split", "target", "seed"])
    return d.groupBy("split", "target").agg(F.count("*").alias("n"), F.count_if("labels_agree").alias("n_agree"),
                                            S.r6(F.avg(F.abs(F.col("pred_a") - F.col("pred_b")))).alias("mean_gap"))


@query("j16_content_leaks", """
SELECT sha256(text) AS content_hash, count(*) AS n, count(DISTINCT source) AS n_splits FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def _(t: Tables):
    return C.content_leaks(t.documents, "text", "source")


@query("j17_attach_unique_covariate", """
SELECT c_mktsegment AS segment, count(*) AS n, count(price) AS n_with, round(avg(price), 4) AS mean_price FROM customer LEFT JOIN (
  SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def _(t: Tables):
    extra = t.orders.selectExpr("o_custkey AS c_custkey", "o_totalprice AS price", "o_orderkey")
    d = C.attach_unique(t.customer.select("c_custkey", "c_mktsegment"), extra, "c_custkey", "o_orderkey")
    return d.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count("price").alias("n_with"), F.round(F.avg("price"), 4).alias("mean_price"))


@query("j18_train_standardizer", with_sql(OBJECTS_SQL, """st AS (SELECT avg(log_mstar) AS m, stddev_pop(log_mstar) AS s FROM objects WHERE split = 'Train')""", body="""
SELECT split, round(avg((log_mstar - m) / s), 6) AS mean_z, round(stddev_pop((log_mstar - m) / s), 6) AS std_z, round(max(abs(((log_mstar - m) / s) * s + m - log_mstar)), 6) AS inverse_error
FROM objects, st GROUP BY split"""))
def _(t: Tables):
    from photonloom.operators.models import StandardScaler

    sc = StandardScaler.fit(objects(t).where("split = 'Train'"), ["log_mstar"])
    d = sc.transform(objects(t), suffix="_z").select("split", "log_mstar", "log_mstar_z")
    back = sc.inverse(F.col("log_mstar_z"), "log_mstar")
    return d.groupBy("split").agg(S.r6(F.avg("log_mstar_z")).alias("mean_z"), S.r6(F.stddev_pop("log_mstar_z")).alias("std_z"),
                                  S.r6(F.max(F.abs(back - F.col("log_mstar")))).alias("inverse_error"))


# --- sets and contracts ---------------------------------------------------------------------------------------------------
@query("u01_union_of_chunks", """SELECT chunk, count(*) AS n, round(sum(v), 4) AS total FROM (
  SELECT 'acct' AS chunk, c_acctbal AS v FROM customer UNION ALL SELECT 'supp', s_acctbal FROM supplier UNION ALL SELECT 'price', p_retailprice FROM part) GROUP BY chunk""")
def _(t: Tables):
    parts = [("acct", t.customer, "c_acctbal"), ("supp", t.supplier, "s_acctbal"), ("price", t.part, "p_retailprice")]
    out = None
    for name, df, c in parts:
        d = df.select(F.lit(name).alias("chunk"), F.col(c).alias("v"))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("u02_common_ids", with_sql(PRED_SQL, body="SELECT split, count(*) AS n FROM (SELECT obj_id, split FROM pred_wide GROUP BY obj_id, split HAVING count(*) = 6) GROUP BY split"))
def _(t: Tables):
    return A.align_members(pred_wide(t), "obj_id", ["family", "seed"], len(MEMBERS)).where("family = 'conv' AND seed = 1").groupBy("split").agg(F.count("*").alias("n"))


@query("u03_id_difference", "SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(t: Tables):
    return t.lineitem.selectExpr("l_orderkey AS k").subtract(t.orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey AS k"))


@query("u04_split_overlap", """SELECT a.lang AS a, b.lang AS b, count(*) AS shared FROM (SELECT DISTINCT lang, source FROM documents) a JOIN (SELECT DISTINCT lang, source FROM documents) b
  ON a.source = b.source AND a.lang < b.lang GROUP BY ALL""")
def _(t: Tables):
    """Splits per content key are few; pairs form inside the small set, never between rows."""
    sets = t.documents.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("s"))
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("u05_design_matrix", """WITH seen AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 9000)
SELECT s.source, l.lang, 'missing' AS gap FROM (SELECT DISTINCT source FROM documents) s, (SELECT DISTINCT lang FROM documents) l
WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.source = s.source AND seen.lang = l.lang)""")
def _(t: Tables):
    return C.design_gaps(t.documents.where("n_chars > 9000").select("source", "lang"), [t.documents.select("source"), t.documents.select("lang")])


@query("v01_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables):
    return V.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("v02_join_cardinality", """SELECT c_custkey, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT c_custkey, count(*) AS n_left FROM customer GROUP BY ALL)
  FULL JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_right FROM orders GROUP BY ALL) USING (c_custkey) WHERE n_left > 1 OR n_right > 1""")
def _(t: Tables):
    return V.join_cardinality(t.customer.select("c_custkey"), t.orders.selectExpr("o_custkey AS c_custkey"), ["c_custkey"])


@query("v04_non_finite_targets", with_sql(OBJECTS_SQL, body="SELECT split, count(*) FILTER (log_mstar IS NULL) AS log_mstar, count(*) FILTER (log_sfr IS NULL) AS log_sfr, count(*) FILTER (d4000 IS NULL) AS d4000 FROM objects GROUP BY split"))
def _(t: Tables):
    return V.non_finite(objects(t), list(TARGETS), ["split"])


@query("v05_file_names", """WITH f AS (SELECT page_id, url, list_last(string_split(url, '/')) AS file FROM pages),
u AS (SELECT file, count(*) AS n_users FROM f GROUP BY file)
SELECT file, page_id, url, n_users, NOT starts_with(file, page_id || '_') AS "foreign" FROM f JOIN u USING (file) WHERE NOT starts_with(file, page_id || '_') OR n_users > 1""")
def _(t: Tables):
    return V.file_name_report(t.pages, "page_id", "url")


@query("v06_split_agreement", with_sql(OBJECTS_SQL, body="""SELECT obj_id, split, published FROM (SELECT obj_id, split, CASE WHEN price > 450000 THEN 'Test' ELSE split END AS published FROM objects)
WHERE (split = 'Test') <> (published = 'Test')"""))
def _(t: Tables):
    d = objects(t).selectExpr("obj_id", "split", "IF(price > 450000, 'Test', split) AS published")
    return V.split_disagreement(d, "split", "published", "Test")


@query("v07_split_membership", """SELECT n_splits, n_rows > n_splits AS repeated, count(*) AS n FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_splits, count(*) AS n_rows FROM orders GROUP BY 1) GROUP BY ALL""")
def _(t: Tables):
    d = V.split_membership(t.orders.select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")
    return d.groupBy("n_splits", (F.col("n_rows") > F.col("n_splits")).alias("repeated")).agg(F.count("*").alias("n"))


@query("v08_expected_counts", """SELECT coalesce(e.k, o.k) AS o_orderstatus, coalesce(e.expected, 0) AS expected, coalesce(o.observed, 0) AS observed, coalesce(e.expected, 0) = coalesce(o.observed, 0) AS agrees
FROM (VALUES ('F', 5000::BIGINT), ('O', 5000::BIGINT), ('X', 0::BIGINT)) e(k, expected) FULL JOIN (SELECT o_orderstatus AS k, count(*) AS observed FROM orders GROUP BY 1) o ON e.k = o.k""")
def _(t: Tables):
    return V.expected_counts(t.orders, "o_orderstatus", {"F": 5000, "O": 5000, "X": 0})


@query("v10_recorded_metrics_agree", with_sql(PRED_SQL, body="""
SELECT family, seed, metric, agrees FROM (SELECT family, seed, 'bias' AS metric, true AS agrees FROM pred_long GROUP BY ALL
  UNION ALL SELECT family, seed, 'mae', family <> 'vit' FROM pred_long GROUP BY ALL)"""))
def _(t: Tables):
    """The recorded table is stored first, with one family's MAE altered."""
    r = F.col("pred") - F.col("y")
    fresh = pred_long(t).groupBy("family", "seed").agg(F.avg(r).alias("bias"), F.avg(F.abs(r)).alias("mae"))
    path, root = fresh_path(t, "recorded")
    sinks.guarded_write(fresh.withColumn("mae", F.when(F.col("family") == "vit", F.col("mae") * 1.001).otherwise(F.col("mae"))), path, root)
    return V.recorded_agree(fresh, t.spark.read.parquet(path), ["family", "seed"], ["bias", "mae"]).select("family", "seed", "metric", "agrees")


FINGER_SQL = """h AS (SELECT {k}, md5({row}) AS h FROM {src}),
w AS (SELECT {k}, count(*) AS n, {sums} FROM h GROUP BY {k})"""


@query("v11_content_fingerprint", with_sql(*[PRED_SQL, ALIGNED_SQL], FINGER_SQL.format(
    k="family", row="concat_ws('|', obj_id, target, printf('%.4f', pred))", src="family_mean",
    sums=", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT) AS w{i}" for i in range(4))), body="""
SELECT family, n, sha256(concat_ws('|', n, w0, w1, w2, w3)) AS fingerprint FROM w"""))
def _(t: Tables):
    row = F.concat_ws("|", F.col("obj_id").cast("string"), "target", F.format_string("%.4f", "pred"))
    return V.fingerprint(family_mean(t), ["family"], row)


@query("v13_failure_budget", """SELECT source, count(*) AS n, count(*) FILTER (n_chars < 200) AS n_failed, round(count(*) FILTER (n_chars < 200) / count(*), 6) AS failed_share,
  count(*) FILTER (n_chars < 200) / count(*) <= 0.05 AS within_budget FROM documents GROUP BY source""")
def _(t: Tables):
    return V.failure_budget(t.documents, F.col("n_chars") < 200, ["source"]).withColumn("failed_share", S.r6("failed_share"))


@query("p14_feature_group", with_sql(OBJECTS_SQL, body="SELECT obj_id, redshift, log_mstar, log_sfr, d4000 FROM objects"))
def _(t: Tables):
    return C.project_group(objects(t), "obj_id", "catalogue")


@query("t02_limited_manifest", """
SELECT obj_id, segment, orderkey FROM (SELECT c_custkey AS obj_id, c_mktsegment AS segment, o_orderkey AS orderkey,
  row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS rn FROM customer LEFT JOIN orders ON c_custkey = o_custkey) WHERE rn = 1 ORDER BY obj_id LIMIT 200""")
def _(t: Tables):
    """The limit is the feature: a reduced run takes the first ids."""
    cat = t.customer.selectExpr("c_custkey AS obj_id", "c_mktsegment AS segment")
    return C.manifest(cat, t.orders.selectExpr("o_custkey AS obj_id", "o_orderkey AS orderkey"), "obj_id", "orderkey", limit=200)


@query("s02_normal_ids", """SELECT c_custkey, trim(c_name) AS mangaid, lower(trim(c_mktsegment)) AS segment FROM customer""")
def _(t: Tables):
    d = t.customer.select("c_custkey", F.encode(F.concat(F.lit("  "), "c_name", F.lit(" ")), "UTF-8").alias("raw"), F.lower(S.normal_id("c_mktsegment")).alias("segment"))
    return d.select("c_custkey", readers.decode_id("raw").alias("mangaid"), "segment")


@query("v03_required_columns", """SELECT c AS column_name, c IN ('l_orderkey', 'l_tax', 'l_shipdate') AS present, (SELECT count(*) FROM lineitem) AS n_rows FROM (VALUES ('l_orderkey'), ('l_tax'), ('l_shipdate'), ('l_comment')) v(c)""")
def _(t: Tables):
    want = ["l_orderkey", "l_tax", "l_shipdate", "l_comment"]
    lacking = V.missing_columns(t.lineitem, want)
    return (t.lineitem.groupBy().agg(F.count("*").alias("n_rows")).withColumn("column_name", F.explode(F.array(*[F.lit(c) for c in want])))
            .select("column_name", (~F.col("column_name").isin(lacking)).alias("present"), "n_rows"))


@query("v09_metric_sanity", with_sql(PRED_SQL, """m AS (SELECT split, family, seed, target, count(*) AS n, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM pred_long WHERE y IS NOT NULL GROUP BY ALL)""", body="""
SELECT (SELECT count(*) FROM (SELECT 1 FROM m GROUP BY split, family, seed, target HAVING count(*) > 1)) AS n_duplicate, CAST(sum((rmse IS NULL OR NOT isfinite(rmse))::INT) AS BIGINT) AS n_not_finite,
  CAST(sum((rmse < 0)::INT) AS BIGINT) AS n_negative, (SELECT count(*) FROM (SELECT split, target FROM m GROUP BY ALL HAVING count(DISTINCT n) > 1)) AS n_uneven FROM m"""))
def _(t: Tables):
    e = F.col("pred") - F.col("y")
    k = ["split", "family", "seed", "target"]
    m = pred_long(t).where("y IS NOT NULL").groupBy(*k).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return V.metric_sanity(m, k, "n", ["rmse"], ["split", "target"])
