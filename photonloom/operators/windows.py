"""Ordered operators: best rows, stall detection, integrals and interpolated lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.session import cut_lineage


def best_row(df: DataFrame, keys: Sequence[str], payload: Sequence[str], criterion: str, *tie: str) -> DataFrame:
    """The row with the smallest criterion per key, by min_by (combines before the shuffle)."""
    best = F.min_by(F.struct(*payload), F.struct(criterion, *tie)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in payload])


def stall_epoch(df: DataFrame, run: str, loss: str, order: Sequence[str], precision: float = 1e-3, patience: int = 10) -> DataFrame:
    """First epoch (0-based) at which `patience` epochs in a row failed to improve on the last accepted minimum by the
    relative precision. The rule depends on the order, so it folds over the sorted history of one run (bounded by epochs)."""
    hist = df.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(loss).alias("v")))).alias("h"))
    start = F.struct(F.lit(1e300).alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("i"), F.lit(-1).alias("stop"))

    def step(a: Column, x: Column) -> Column:
        nxt = a["i"] + 1
        improved = x["v"] < a["best"] * (1 - precision)
        kept = F.struct(a["best"].alias("best"), a["bad"].alias("bad"), nxt.alias("i"), a["stop"].alias("stop"))
        better = F.struct(x["v"].alias("best"), F.lit(0).alias("bad"), nxt.alias("i"), F.lit(-1).alias("stop"))
        worse = F.struct(a["best"].alias("best"), (a["bad"] + 1).alias("bad"), nxt.alias("i"),
                         F.when(a["bad"] + 1 == patience, a["i"]).otherwise(-1).alias("stop"))
        return F.when(a["stop"] >= 0, kept).when(improved, better).otherwise(worse)

    s = F.aggregate("h", start, step)
    return hist.select(run, s.alias("s")).select(run, F.when(F.col("s.stop") >= 0, F.col("s.stop")).alias("stop_epoch"), F.col("s.best").alias("best"))


def mass_at_lookback(df: DataFrame, run: str, t: str, rate: str, lookback: float, log_mass_now: Column) -> DataFrame:
    """Trapezoid integral of the rate along each history, scaled to the final mass and interpolated at a look-back time.
    Histories that do not reach back that far are left out."""
    w = W.partitionBy(run).orderBy(t)
    d = df.withColumn("_step", F.coalesce(0.5 * (F.col(rate) + F.lag(rate).over(w)) * (F.col(t) - F.lag(t).over(w)), F.lit(0.0)))
    d = d.withColumn("_cum", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy(run)
    d = d.withColumns({"_t1": F.lead(t).over(w), "_r1": F.lead(rate).over(w), "_c1": F.lead("_cum").over(w), "_total": F.max("_cum").over(whole),
                       "_tt": F.max(t).over(whole) - lookback, "_t0": F.min(t).over(whole)})
    at = (F.col("_tt") - F.col(t)) / (F.col("_t1") - F.col(t))
    d = d.where((F.col("_tt") > F.col("_t0")) & (F.col(t) <= F.col("_tt")) & (F.col("_tt") < F.col("_t1")))
    frac = (F.col("_cum") + (F.col("_c1") - F.col("_cum")) * at) / F.nullif(F.col("_total"), F.lit(0.0))
    then = F.col(rate) + (F.col("_r1") - F.col(rate)) * at
    return d.select(run, (log_mass_now + F.log10(F.when(frac > 0, frac))).alias("log_mass"), F.log10(F.when(then > 0, then)).alias("log_rate"))


def interpolate_at(df: DataFrame, x: Column, grid: DataFrame, step: float, columns: Sequence[str]) -> DataFrame:
    """Linear interpolation in a table given on a regular grid. `grid` has a bigint `cell` (x = cell * step) and the value
    columns; the row and its successor meet in one equi-join on the cell, never in a range join."""
    w = W.orderBy("cell")  # the grid is a lookup table of at most 10,000 rows
    ends = grid.select("cell", *columns, *[F.lead(c).over(w).alias(f"_{c}1") for c in columns])
    d = df.withColumn("_x", x / step).withColumn("cell", F.floor("_x"))
    at = F.col("_x") - F.col("cell")
    out = d.join(cut_lineage(ends), "cell", "left")
    for c in columns:
        out = out.withColumn(c, F.when(at == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}1") - F.col(c)) * at))
    return out.drop("_x", "cell", *[f"_{c}1" for c in columns])


# Flat cosmology of the labels, and the speed of light in km/s.
H0, OMEGA_M, LIGHT_KMS = 73.0, 0.3, 299792.458


def distance_grid(spark, z_max: float, step: float = 0.001) -> DataFrame:
    """comoving distance (Mpc) on a redshift grid by the trapezoid rule, as a lookup table."""
    n = int(round(z_max / step)) + 2
    if n > 10_000:
        raise ValueError("the redshift grid is limited to 10,000 rows")
    z = F.col("cell") * step
    inv = 1 / F.sqrt(OMEGA_M * (1 + z) * (1 + z) * (1 + z) + (1 - OMEGA_M))
    w = W.orderBy("cell")
    d = spark.range(n).withColumnRenamed("id", "cell").withColumn("_e", inv)
    area = F.coalesce(0.5 * step * (F.col("_e") + F.lag("_e").over(w)), F.lit(0.0))
    d = d.withColumn("_a", area)
    return d.select("cell", (LIGHT_KMS / H0 * F.sum("_a").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("comoving_mpc"))


def with_distances(df: DataFrame, z: str, z_max: float, step: float = 0.001) -> DataFrame:
    """distance modulus and kpc per arcsecond; missing where the redshift is not positive."""
    d = interpolate_at(df, F.when(F.col(z) > 0, F.col(z)), distance_grid(df.sparkSession, z_max, step), step, ["comoving_mpc"])
    lum = F.col("comoving_mpc") * (1 + F.col(z))
    arcsec = F.col("comoving_mpc") / (1 + F.col(z)) * 1000.0 * 3.141592653589793 / 648000.0
    return d.withColumns({"distance_modulus": 5 * F.log10(F.when(lum > 0, lum)) + 25, "kpc_per_arcsec": arcsec})
