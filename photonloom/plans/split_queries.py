"""Queries: splits, folds, samples, windows and top-n (W, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonloom.functions.scalars import r6
from photonloom.operators import contracts as V
from photonloom.operators import splits as P
from photonloom.operators.cohort import top_n
from photonloom.operators.windows import best_row, interpolate_at, mass_at_lookback, stall_epoch
from photonloom.plans.bindings import ALIGNED_SQL, OBJECTS_SQL, PRED_SQL, family_mean, objects, with_sql
from photonloom.plans.registry import Tables, query


def h_sql(*parts) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(str(p) for p in parts)})), 1, 8) AS BIGINT)"


W05_SQL = f"""ranked AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem),
sp AS (SELECT obj_id, stratum, CASE WHEN (rn - 0.5) / n <= 0.7 THEN 'train' WHEN (rn - 0.5) / n <= 0.85 THEN 'val' ELSE 'test' END AS split FROM (
  SELECT o_orderkey AS obj_id, o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h_sql('o_orderkey', 42)}, o_orderkey) AS rn,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders))"""


def split_of(t: Tables):
    d = t.orders.selectExpr("o_orderkey AS obj_id", "o_orderpriority AS stratum")
    return P.stratified_split(d, "obj_id", "stratum", {"train": 0.7, "val": 0.15, "test": 0.15}, 42)


@query("w05_stratified_split", with_sql(W05_SQL, body="SELECT obj_id, stratum, split FROM sp"))
def _(t: Tables):
    """The distributed layout: a stratum may hold a third of all objects."""
    return split_of(t)


@query("v14_frozen_split", "SELECT o_orderkey AS obj_id FROM orders WHERE false")
def _(t: Tables):
    """The recomputed split must equal the stored one for every id."""
    from photonloom.plans.cohort_queries import fresh_path
    from photonloom.sources.sinks import guarded_write

    path, root = fresh_path(t, "frozen")
    guarded_write(split_of(t), path, root)
    return V.frozen_split_mismatch(split_of(t), t.spark.read.parquet(path), "obj_id").select("obj_id")


@query("w06_validation_by_decile", with_sql(OBJECTS_SQL, f"""tr AS (SELECT obj_id, log_mstar FROM objects WHERE split = 'Train'),
e AS (SELECT list_sort(list_distinct(quantile_cont(log_mstar, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM tr),
b AS (SELECT obj_id, greatest(len(list_filter(e, lambda x: x < log_mstar)) - 1, 0) AS b FROM tr, e),
r AS (SELECT obj_id, b, row_number() OVER (PARTITION BY b ORDER BY {h_sql('obj_id', 7)}, obj_id) - 1 AS rn, count(*) OVER (PARTITION BY b) AS n FROM b)""", body="""
SELECT o.obj_id, CASE WHEN r.rn < round_even(0.15 * r.n, 0) THEN 'Validation' ELSE o.split END AS part FROM objects o LEFT JOIN r USING (obj_id)"""))
def _(t: Tables):
    return P.validation_draw(objects(t), "obj_id", "log_mstar", 0.15, 7).select("obj_id", "part")


@query("w07_repeated_folds", f"""SELECT obj_id, repetition, CAST((row_number() OVER (PARTITION BY repetition ORDER BY {h_sql('obj_id', 3, 'repetition')}, obj_id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT c_custkey AS obj_id, CAST(r AS INTEGER) AS repetition FROM customer, range(0, 3) g(r))""")
def _(t: Tables):
    return P.folds(t.customer.selectExpr("c_custkey AS obj_id"), "obj_id", 5, 3, 3)


@query("w17_random_split", f"""SELECT obj_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {h_sql('obj_id', 11)}, obj_id) - 1 < round_even(0.85 * count(*) OVER (PARTITION BY kind), 0) AS in_train
FROM (SELECT o_orderkey AS obj_id, o_orderstatus AS kind FROM orders)""")
def _(t: Tables):
    return P.random_split(t.orders.selectExpr("o_orderkey AS obj_id", "o_orderstatus AS kind"), "obj_id", 0.85, 11, ["kind"])


@query("w08_worst_per_group", with_sql(PRED_SQL, ALIGNED_SQL, body="""
SELECT family, target, obj_id, CAST(position AS INTEGER) AS position, round(err, 6) AS err FROM (SELECT family, target, obj_id, round(abs(pred - y), 6) AS err,
  row_number() OVER (PARTITION BY family, target ORDER BY round(abs(pred - y), 6) DESC, obj_id) AS position FROM family_mean) WHERE position <= 15"""))
def _(t: Tables):
    d = family_mean(t).select("family", "target", "obj_id", r6(F.abs(F.col("pred") - F.col("y"))).alias("err"))
    return top_n(d, ["family", "target"], 15, F.col("err").desc(), F.col("obj_id"))


@query("w09_best_row", """SELECT l_partkey AS run, arg_min(l_linenumber, (l_discount, l_tax, l_orderkey, l_linenumber)) AS epoch, min(l_discount) AS criterion FROM lineitem GROUP BY l_partkey""")
def _(t: Tables):
    d = t.lineitem.selectExpr("l_partkey AS run", "l_linenumber AS epoch", "l_discount AS criterion", "l_tax", "l_orderkey")
    return best_row(d, ["run"], ["epoch", "criterion"], "criterion", "l_tax", "l_orderkey", "epoch").select("run", "epoch", "criterion")


@query("w10_stall_detection", """WITH h AS (SELECT l_orderkey AS run, list(l_quantity ORDER BY l_linenumber, l_extendedprice) AS v FROM lineitem GROUP BY 1),
f AS (SELECT run, len(v) AS n, list_reduce(v, lambda a, x: CASE WHEN a.stop >= 0 THEN {'best': a.best, 'bad': a.bad, 'i': a.i + 1, 'stop': a.stop}
    WHEN x < a.best * 0.999 THEN {'best': x, 'bad': 0, 'i': a.i + 1, 'stop': -1}
    ELSE {'best': a.best, 'bad': a.bad + 1, 'i': a.i + 1, 'stop': CASE WHEN a.bad + 1 = 2 THEN a.i ELSE -1 END} END,
  {'best': 1e300::DOUBLE, 'bad': 0, 'i': 0, 'stop': -1}) AS s FROM h)
SELECT run, CASE WHEN s.stop >= 0 THEN s.stop END AS stop_epoch, s.best AS best FROM f""")
def _(t: Tables):
    """An epoch history is one order's lines: a handful of rows per run."""
    d = t.lineitem.selectExpr("l_orderkey AS run", "l_linenumber", "l_extendedprice", "l_quantity AS loss")
    return stall_epoch(d, "run", "loss", ["l_linenumber", "l_extendedprice"], precision=1e-3, patience=2)


W13_SQL = """s AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) + l_tax AS t, l_quantity AS sfr FROM lineitem),
g AS (SELECT *, coalesce(0.5 * (sfr + lag(sfr) OVER w) * (t - lag(t) OVER w), 0) AS step, lead(t) OVER w AS t1, lead(sfr) OVER w AS sfr1 FROM s WINDOW w AS (PARTITION BY run ORDER BY t)),
c AS (SELECT *, sum(step) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) AS cum FROM g),
c2 AS (SELECT *, lead(cum) OVER (PARTITION BY run ORDER BY t) AS cum1, max(cum) OVER (PARTITION BY run) AS total, max(t) OVER (PARTITION BY run) - 1.5 AS tt, min(t) OVER (PARTITION BY run) AS t0 FROM c)"""


@query("w13_cumulative_integral", with_sql(W13_SQL, body="""
SELECT run, round(10 + log10((cum + (cum1 - cum) * (tt - t) / (t1 - t)) / total), 6) AS log_mass, round(log10(sfr + (sfr1 - sfr) * (tt - t) / (t1 - t)), 6) AS log_rate
FROM c2 WHERE tt > t0 AND t <= tt AND tt < t1"""))
def _(t: Tables):
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("run").orderBy("l_linenumber", "l_extendedprice"))
    d = (t.lineitem.selectExpr("l_orderkey AS run", "l_linenumber", "l_extendedprice", "l_tax", "l_quantity AS sfr")
         .select("run", (rn + F.col("l_tax")).alias("t"), "sfr"))
    return mass_at_lookback(d, "run", "t", "sfr", 1.5, F.lit(10.0)).select("run", r6("log_mass").alias("log_mass"), r6("log_rate").alias("log_rate"))


@query("t01_ordered_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("t03_head_per_split", """SELECT lang, doc_id, CAST(position AS INTEGER) AS position FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position FROM documents) WHERE position <= 25""")
def _(t: Tables):
    return top_n(t.documents.select("lang", "doc_id"), ["lang"], 25, F.col("doc_id"))


@query("t04_seeded_sample", f"SELECT o_orderkey FROM orders ORDER BY {h_sql('o_orderkey', 5)}, o_orderkey LIMIT 50")
def _(t: Tables):
    return P.seeded_sample(t.orders.select("o_orderkey"), "o_orderkey", 50, 5)


@query("t06_representatives", with_sql(OBJECTS_SQL, """q AS (SELECT split, unnest([0.1, 0.5, 0.9]) AS quantile, unnest(quantile_cont(log_mstar, [0.1, 0.5, 0.9])) AS v FROM objects GROUP BY split)""", body="""
SELECT split, CAST(quantile AS DOUBLE) AS quantile, arg_min(obj_id, (abs(log_mstar - v), obj_id)) AS obj_id, arg_min(log_mstar, (abs(log_mstar - v), obj_id)) AS value FROM objects JOIN q USING (split) GROUP BY ALL"""))
def _(t: Tables):
    return P.nearest_to_quantiles(objects(t).select("split", "obj_id", "log_mstar"), ["split"], "obj_id", "log_mstar", [0.1, 0.5, 0.9])


@query("t07_quality_ranking", """SELECT source, round(100 * max(z), 4) AS worst_zero_pct, CAST(row_number() OVER (ORDER BY round(100 * max(z), 4) DESC, source) AS INTEGER) AS position
FROM (SELECT source, lang, avg((n_chars < 300)::INT) AS z FROM documents GROUP BY ALL) GROUP BY source""")
def _(t: Tables):
    from pyspark.sql import Window as W

    z = t.documents.groupBy("source", "lang").agg(F.avg(F.expr("int(n_chars < 300)")).alias("z"))
    z = z.groupBy("source").agg(F.round(100 * F.max("z"), 4).alias("worst_zero_pct"))
    # One row per source remains.
    return z.withColumn("position", F.row_number().over(W.orderBy(F.col("worst_zero_pct").desc(), "source")))
