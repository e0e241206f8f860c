"""Ensembles of prediction tables.

With weights that add up to one the ensemble residual is the weighted sum of member residuals, so the error of every convex
blend is a quadratic form in one Gram matrix of residuals per target. Spark computes the matrices in one aggregation; what
reaches the driver is one M x M matrix per target (M models). Search and validation over families are in `stacking`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.operators.stacking import simplex_solution


def member_rows(df: DataFrame, obj: str, keys: Sequence[str] = (), member: str = "family") -> DataFrame:
    """One row per (object, target): the residuals of the members in name order."""
    ms = F.array_sort(F.collect_list(F.struct(F.col(member).alias("m"), (F.col("pred") - F.col("y")).alias("r"), F.col("pred").alias("p"))))
    return df.groupBy(obj, *keys, "target").agg(F.max("y").alias("y"), ms.alias("ms"))


def residual_gram(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, target, member_a, member_b, n, gram): mean product of residuals of every member pair, from pairs inside a row."""
    pairs = (rows.select(*keys, "target", F.explode("ms").alias("a"), "ms").select(*keys, "target", "a", F.explode("ms").alias("b")))
    return (pairs.groupBy(*keys, "target", F.col("a.m").alias("member_a"), F.col("b.m").alias("member_b"))
            .agg(F.count("*").alias("n"), F.avg(F.col("a.r") * F.col("b.r")).alias("gram")))


def convex_weights(grams: DataFrame, sigma: dict[str, float], regularization: float) -> tuple[list[str], dict[str, np.ndarray]]:
    """Member names and, per target, the weights of the blend; the table holds members squared cells per target."""
    rows = grams.collect()
    members = sorted({r["member_a"] for r in rows})
    at = {m: i for i, m in enumerate(members)}
    by_target = {t: np.zeros((len(members), len(members))) for t in sorted({r["target"] for r in rows})}
    for r in rows:
        by_target[r["target"]][at[r["member_a"]], at[r["member_b"]]] = r["gram"] / sigma[r["target"]] ** 2
    return members, {t: simplex_solution(g, regularization) for t, g in by_target.items()}


def weights_table(spark, weights: dict[str, np.ndarray], members: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(t, m, float(w)) for t, ws in weights.items() for m, w in zip(members, ws)],
                                 "target string, family string, weight double")


def apply_weights(df: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted sum of the members; `weights` has one row per (target, member)."""
    return (df.join(F.broadcast(weights), ["target", "family"]).groupBy(*keys, "target")
            .agg(F.max("y").alias("y"), F.sum(F.col("weight") * F.col("pred")).alias("pred")))


def uniform_mean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E02"""
    return df.groupBy(*keys, "target").agg(F.max("y").alias("y"), F.avg("pred").alias("pred"))


def ambiguity(df: DataFrame, keys: Sequence[str], obj: str, weights: DataFrame | None = None, scale: DataFrame | None = None) -> DataFrame:
    """Weighted member error, ambiguity and ensemble error per key and target, in units of the squared scale (target, sigma)
    where one is given; the identity error = members - ambiguity is exact for convex weights."""
    d = df.withColumn("weight", F.lit(1.0)) if weights is None else df.join(F.broadcast(weights), ["target", "family"])
    ms = F.collect_list(F.struct(F.col("weight").alias("w"), F.col("pred").alias("p")))
    one = d.groupBy(*keys, obj, "target").agg(F.max("y").alias("y"), ms.alias("ms"), F.sum("weight").alias("sw"),
                                              F.sum(F.col("weight") * F.col("pred")).alias("sp"))
    one = one.withColumn("e", F.col("sp") / F.col("sw"))
    member = F.aggregate("ms", F.lit(0.0), lambda s, x: s + x["w"] * (x["p"] - F.col("y")) * (x["p"] - F.col("y"))) / F.col("sw")
    amb = F.aggregate("ms", F.lit(0.0), lambda s, x: s + x["w"] * (x["p"] - F.col("e")) * (x["p"] - F.col("e"))) / F.col("sw")
    err = (F.col("e") - F.col("y")) * (F.col("e") - F.col("y"))
    out = (one.select(*keys, "target", member.alias("m"), amb.alias("a"), err.alias("e2")).groupBy(*keys, "target")
           .agg(F.count("*").alias("n"), F.avg("m").alias("member_error"), F.avg("a").alias("ambiguity"), F.avg("e2").alias("ensemble_error")))
    if scale is None:
        return out
    unit = F.col("sigma") * F.col("sigma")
    return out.join(scale.select("target", "sigma"), "target").select(*keys, "target", "n", *[(F.col(c) / unit).alias(c) for c in ("member_error", "ambiguity", "ensemble_error")])


def disagreement(df: DataFrame, keys: Sequence[str], weights: DataFrame | None = None) -> DataFrame:
    """Weighted standard deviation of the members about the ensemble, per object and target."""
    if weights is None:
        return df.groupBy(*keys, "target").agg(F.max("y").alias("y"), F.avg("pred").alias("pred"), F.stddev_pop("pred").alias("disagreement"))
    d = df.join(F.broadcast(weights), ["target", "family"])
    w, p = F.col("weight"), F.col("pred")
    agg = d.groupBy(*keys, "target").agg(F.max("y").alias("y"), F.sum(w * p).alias("_p"), F.sum(w * p * p).alias("_pp"), F.sum(w).alias("_w"))
    return agg.select(*keys, "target", "y", F.col("_p").alias("pred"),
                      F.sqrt(F.greatest(F.lit(0.0), F.col("_pp") - F.col("_p") * F.col("_p") * (2 - F.col("_w")))).alias("disagreement"))
