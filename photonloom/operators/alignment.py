"""Alignment of prediction tables by object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def align_members(wide: DataFrame, obj: str, member: Sequence[str], n_members: int) -> DataFrame:
    """Keep the objects predicted by every member. One object has one row per member, so the window is a handful of rows."""
    n = F.size(F.collect_set(F.struct(*member)).over(W.partitionBy(obj)))
    return wide.withColumn("_n", n).where(F.col("_n") == n_members).drop("_n")


def label_conflicts(wide: DataFrame, obj: str, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Objects whose labels or covariates differ between members by more than the tolerance."""
    spans = wide.groupBy(obj).agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns])
    bad = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns]) > tolerance
    return spans.where(bad)


def seeds_per_family(wide: DataFrame, minimum: int = 1) -> DataFrame:
    """Families with their number of seeds and whether they reach the minimum."""
    return (wide.groupBy("family", "seed").agg(F.count("*").alias("n")).groupBy("family")
            .agg(F.count("*").alias("n_seeds"), F.max("n").alias("n_objects"), (F.count("*") >= minimum).alias("enough")))


def pair_models(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Paired rows of two models with a label check: pred_a, pred_b, y, labels_agree."""
    left = a.select(*keys, F.col("y").alias("y"), F.col("pred").alias("pred_a"))
    right = b.select(*keys, F.col("y").alias("_yb"), F.col("pred").alias("pred_b"))
    return (left.join(right, list(keys)).withColumn("labels_agree", F.abs(F.col("y") - F.col("_yb")) <= tolerance).drop("_yb"))
