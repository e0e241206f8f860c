"""Residual metrics of prediction tables. Every function takes a long table and a list of grouping keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.functions.scalars import col, finite, safe_div
from photonloom.operators.distribution import median_and_mad, quantiles, spearman
from photonloom.session import cut_lineage, kept_rows


def residuals(df: DataFrame, keys: Sequence[str], y: Column | str = "y", p: Column | str = "pred", *extra: str) -> DataFrame:
    """(keys, y, p, r): rows where either side is missing are dropped."""
    return (df.select(*keys, *extra, finite(y).alias("y"), finite(p).alias("p")).where("y is not null and p is not null")
            .withColumn("r", F.col("p") - F.col("y")))


def moments(d: DataFrame, keys: Sequence[str], catastrophic: float | None = None, prefix_extra: Sequence[Column] = ()) -> DataFrame:
    """The metrics that need one pass only."""
    r, y, p = F.col("r"), F.col("y"), F.col("p")
    sq = F.avg(r * r)
    aggs = [F.count("*").alias("n"), F.sqrt(sq).alias("rmse"), sq.alias("mse"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("bias"),
            (1 - safe_div(sq, F.var_pop(y))).alias("r2"), F.regr_slope(r, y).alias("residual_slope"), F.corr(y, p).alias("pearson")]
    if catastrophic is not None:
        aggs.append(F.avg(F.when(F.abs(r) > catastrophic, 1.0).otherwise(0.0)).alias("catastrophic_frac"))
    return d.groupBy(*keys).agg(*aggs, *prefix_extra)


def regression_metrics(df: DataFrame, keys: Sequence[str], y="y", p="pred", catastrophic: float | None = None,
                       rank: bool = True) -> DataFrame:
    """N, RMSE, MSE, MAE, R2, bias, NMAD, outlier share, residual slope, Pearson and Spearman. The base table is
    read once; all statistics come from the materialized residuals."""
    keys = list(keys)
    d = kept_rows(residuals(df, keys, y, p))
    out = moments(d, keys, catastrophic).join(median_and_mad(d, keys, "r", kept=True), keys)
    return out.join(spearman(d, keys, "y", "p"), keys) if rank else out


def normalized_criterion(df: DataFrame, scale: DataFrame, keys: Sequence[str], y="y", p="pred") -> DataFrame:
    """Mean over targets of (RMSE / sigma of the train labels)^2. `scale` has one row per target."""
    per_target = (residuals(df, [*keys, "target"], y, p).groupBy(*keys, "target")
                  .agg(F.avg(F.col("r") * F.col("r")).alias("mse")))
    return (per_target.join(F.broadcast(cut_lineage(scale)), "target")
            .groupBy(*keys).agg(F.avg(F.col("mse") / (F.col("sigma") * F.col("sigma"))).alias("criterion")))


def object_loss(df: DataFrame, scale: DataFrame, keys: Sequence[str], y="y", p="pred") -> DataFrame:
    """Mean over targets of the normalized squared error of each object."""
    e = (col(p) - col(y)) / F.col("sigma")
    return df.join(F.broadcast(cut_lineage(scale)), "target").groupBy(*keys).agg(F.avg(e * e).alias("loss"))


def edge_bucket(value: Column | str, edges: Sequence[float], right_closed: bool = False, last_closed: bool = False) -> Column:
    """0-based interval of `value` among fixed edges; NULL outside. Left-closed unless told otherwise."""
    v, b = col(value), None
    for k in range(len(edges) - 1):
        lo, hi = float(edges[k]), float(edges[k + 1])
        hit = (v > lo) & (v <= hi) if right_closed else (v >= lo) & ((v <= hi) if last_closed and k == len(edges) - 2 else (v < hi))
        b = F.when(hit, k) if b is None else b.when(hit, k)
    return b


def residual_summary(df: DataFrame, keys: Sequence[str], value: Column | str = "r", minimum: int = 1,
                     probs: dict[str, float] | None = None) -> DataFrame:
    """N, mean, sample std, NMAD and quantiles of one column per group."""
    keys = list(keys)
    d = df.select(*keys, finite(value).alias("v")).where("v is not null")
    d = kept_rows(d)
    base = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")) \
        .where(F.col("n") >= minimum)
    out = base.join(median_and_mad(d, keys, "v", outlier_factor=None, kept=True), keys)
    return out.join(quantiles(d, keys, "v", probs, kept=True), keys) if probs else out


def column_audit(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows, missing, NaN, infinite and valid counts with min, max, mean, std per column, in one pass."""
    c = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("double").alias("v")) for x in columns])
    d = df.select(*keys, F.explode(c).alias("s")).select(*keys, "s.column", "s.v").withColumn("ok", finite("v"))
    nan = F.isnan("v")
    return d.groupBy(*keys, "column").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.count_if(nan).alias("n_nan"),
        F.count_if(F.col("v").isNotNull() & ~nan & F.col("ok").isNull()).alias("n_inf"), F.count("ok").alias("n_valid"),
        F.min("ok").alias("min"), F.max("ok").alias("max"), F.avg("ok").alias("mean"), F.stddev_samp("ok").alias("std"))


def photoz_metrics(df: DataFrame, keys: Sequence[str], z: Column | str, z_pred: Column | str, outlier: float = 0.05) -> DataFrame:
    """Median and NMAD of dz/(1+z), outlier share, median relative error, RMSE of log10 z and rank correlation."""
    keys = list(keys)
    zt, zp = col(z), col(z_pred)
    d = df.select(*keys, zt.alias("z"), zp.alias("zp"), ((zp - zt) / (1 + zt)).alias("dz"), (F.abs(zp - zt) / zt).alias("rel"),
                  (F.log10(zp) - F.log10(zt)).alias("dlog"))
    base = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("dlog") * F.col("dlog"))).alias("rmse_log10z"),
                                F.avg(F.when(F.abs("dz") > outlier, 1.0).otherwise(0.0)).alias("outlier_frac"))
    dz = median_and_mad(d, keys, "dz", outlier_factor=None).withColumnsRenamed({"med": "bias_dz", "nmad": "nmad_dz"})
    rel = quantiles(d, keys, "rel", {"median_relative_error": 0.5})
    return base.join(dz, keys).join(rel, keys).join(spearman(d, keys, "z", "zp"), keys)


def residual_correlation(df: DataFrame, keys: Sequence[str], member: str, obj: str = "obj_id") -> DataFrame:
    """Correlation of residuals for every pair of members.

    The members of an object are gathered first (a handful of models per object), so pairs form inside one row.
    """
    one = (df.groupBy(*keys, obj).agg(F.array_sort(F.collect_list(F.struct(F.col(member).alias("m"), (F.col("pred") - F.col("y")).alias("r"))))
                                      .alias("ms")))
    pairs = (one.select(*keys, F.explode("ms").alias("a"), "ms").select(*keys, "a", F.explode("ms").alias("b"))
             .where("a.m < b.m"))
    return (pairs.groupBy(*keys, F.col("a.m").alias("member_a"), F.col("b.m").alias("member_b"))
            .agg(F.corr("a.r", "b.r").alias("corr"), F.count("*").alias("n")))


def against_baseline(table: DataFrame, model: str, baseline: str, keys: Sequence[str], value: str) -> DataFrame:
    """Relative change of a metric against one model's row. `table` is a metrics table (one row per model and key)."""
    table = cut_lineage(table)
    base = table.where(F.col(model) == baseline).select(*keys, F.col(value).alias("_base"))
    return (table.join(base, list(keys)).withColumn(f"{value}_change_pct", 100 * (F.col(value) - F.col("_base")) / F.col("_base"))
            .drop("_base"))


def train_quartiles(train: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row holding the quartile array of each column, from distributed order statistics."""
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    out = None
    for name, c in columns.items():
        q = quantiles(train.select(F.lit(name).alias("_k"), c), ["_k"], c, probs).select(F.array("q1", "q2", "q3").alias(name))
        values = q.first()[0]
        out = q if out is None else out.withColumn(name, F.array(*[F.lit(v) for v in values]))
    return out


def density_histogram(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, width: float) -> DataFrame:
    """Counts and density per bin inside [lo, hi); the window runs over the bins of a class, not over its rows."""
    from pyspark.sql import Window as W

    v = F.col(value)
    h = (df.where((v >= lo) & (v < hi)).groupBy(*keys, F.floor((v - lo) / width).alias("bin")).agg(F.count("*").alias("n")))
    return h.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy(*keys)) * width))
