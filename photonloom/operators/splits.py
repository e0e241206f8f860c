"""Splits, folds and samples from key hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.functions.draws import hash32, key_text
from photonloom.operators.cohort import top_n
from photonloom.operators.distribution import global_rank, quantiles
from photonloom.session import small


def shuffled_rank(df: DataFrame, obj: str, keys: Sequence[str], *salt) -> DataFrame:
    """(keys, obj, rank0, n_total): position of each object in a seeded permutation of its group."""
    d = df.select(*keys, obj, hash32(key_text(F.col(obj), *salt)).alias("_h"))
    return global_rank(d, keys, ["_h", obj]).drop("_h")


def stratified_split(df: DataFrame, obj: str, stratum: str, fractions: Mapping[str, float], seed: int) -> DataFrame:
    """Inside each stratum, (rank + 0.5) / n against the cumulative fractions. A table with fewer rows than splits goes
    to the first split."""
    names, acc, split = list(fractions), 0.0, None
    at = (F.col("rank0") + 0.5) / F.col("n_total")
    if abs(sum(fractions.values()) - 1.0) > 1e-6:
        raise ValueError("fractions must add up to 1")
    for name in names[:-1]:
        acc += fractions[name]
        split = F.when(at <= round(acc, 12), name) if split is None else split.when(at <= round(acc, 12), name)
    tiny = df.limit(len(names)).count() < len(names)
    d = df.withColumn(stratum, F.coalesce(F.col(stratum).cast("string"), F.lit("na")))
    out = shuffled_rank(d, obj, [stratum], seed)
    return out.select(obj, stratum, (F.lit(names[0]) if tiny or split is None else split.otherwise(names[-1])).alias("split"))


def quantile_bucket(df: DataFrame, value: str, n: int, keys: Sequence[str] = ()) -> tuple[Column, list[float]]:
    """Quantile buckets with right-closed edges, the lowest edge included and equal edges merged; returns the bucket column."""
    probs = {f"e{i}": i / n for i in range(n + 1)}
    row = quantiles(df.select(F.lit(1).alias("_k"), value), ["_k"], value, probs).first()
    edges = sorted({row[f"e{i}"] for i in range(n + 1)})
    v, b = F.col(value), F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        lo = (v >= edges[k]) if k == 0 else (v > edges[k])
        b = F.when(lo & (v <= edges[k + 1]), k).otherwise(b)
    return b, edges


def validation_draw(df: DataFrame, obj: str, label: str, fraction: float, seed: int, n_buckets: int = 10) -> DataFrame:
    """Move round(fraction * n) train objects of every label decile to Validation."""
    if fraction <= 0:
        return df.withColumn("part", F.col("split"))
    train = df.where("split = 'Train'")
    bucket, _ = quantile_bucket(train, label, n_buckets)
    ranked = shuffled_rank(train.withColumn("_b", bucket).where("_b IS NOT NULL"), obj, ["_b"], seed)
    drawn = ranked.where(F.col("rank0") < F.rint(F.lit(fraction) * F.col("n_total"))).select(obj, F.lit(True).alias("_v"))
    return df.join(drawn, obj, "left").withColumn("part", F.when(F.col("_v"), "Validation").otherwise(F.col("split"))).drop("_v")


def folds(df: DataFrame, obj: str, k: int, seed: int, repetitions: int = 1) -> DataFrame:
    """(obj, repetition, fold), folds of equal size within one row, redrawn for every repetition."""
    d = df.select(obj, F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))
    return shuffled_rank(d, obj, ["repetition"], seed, F.col("repetition")).select(
        obj, "repetition", (F.col("rank0") % k).cast("int").alias("fold"))


def random_split(df: DataFrame, obj: str, fraction: float, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first round(fraction * n) of a seeded permutation, over all rows or inside each class."""
    d = df if keys else df.withColumn("_all", F.lit(1))
    by = list(keys) or ["_all"]
    out = shuffled_rank(d, obj, by, seed)
    return out.select(obj, *keys, (F.col("rank0") < F.rint(F.lit(fraction) * F.col("n_total"))).alias("in_train"))


def seeded_sample(df: DataFrame, obj: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows; a top-n over the key hash, so each task keeps n rows."""
    return df.orderBy(hash32(key_text(F.col(obj), seed)), obj).limit(n)


def sampled_positions(pixels: DataFrame, obj: str, n: int, seed: int) -> DataFrame:
    """N pixel positions per image, seeded by the id; the same positions in every band."""
    h = hash32(key_text(F.col(obj), F.col("y"), F.col("x"), seed))
    pos = pixels.where("band = 'r'").select(obj, "y", "x", h.alias("_h"))
    return top_n(pos, [obj], n, F.col("_h"), F.col("y"), F.col("x")).drop("_h", "position")


def nearest_to_quantiles(df: DataFrame, keys: Sequence[str], obj: str, value: str, probs: Sequence[float]) -> DataFrame:
    """Per quantile the object whose value is nearest to it."""
    q = small(quantiles(df, keys, value, {f"q{i}": p for i, p in enumerate(probs)}))
    v = F.col(value)
    aggs = [F.min_by(F.struct(F.col(obj), v.alias("v")), F.struct(F.abs(v - F.col(f"q{i}")), F.col(obj))).alias(f"_{i}") for i in range(len(probs))]
    rows = F.array(*[F.struct(F.lit(float(p)).alias("quantile"), F.col(f"_{i}.{obj}").alias(obj), F.col(f"_{i}.v").alias("value"))
                     for i, p in enumerate(probs)])
    return df.join(q, list(keys)).groupBy(*keys).agg(*aggs).select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")
