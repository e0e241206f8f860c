"""Intervals, tests and paired comparison (A32-A38, A53, E13); the replicates come from `bootstrap`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.operators.distribution import global_rank, ordered

# Margins within which two models count as equivalent.
EQUIVALENCE_MARGINS = {"log_mstar": 0.02, "log_sfr": 0.02, "d4000": 0.01}


def interval(reps: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], levels: Mapping[str, float]) -> DataFrame:
    """Quantiles over replicates: `n_boot` rows per key, so the built-in percentile is exact and small."""
    out = []
    for name, c in stats.items():
        out += [F.percentile(c, F.lit(p)).alias(f"{name}_{tag}") for tag, p in levels.items()]
    return reps.groupBy(*keys).agg(*out)


def verdict(lo: Column, hi: Column, margin: Column, lo_eq: Column | None = None, hi_eq: Column | None = None) -> Column:
    """Negative means the first model is better. Equivalence looks at the bounds given for it, else at lo and hi."""
    lo_eq, hi_eq = lo if lo_eq is None else lo_eq, hi if hi_eq is None else hi_eq
    return (F.when(hi < 0, "better").when(lo > 0, "worse").when((-margin < lo_eq) & (hi_eq < margin), "equivalent")
            .otherwise("inconclusive"))


def margin_of(target: str = "target") -> Column:
    out = None
    for t, m in EQUIVALENCE_MARGINS.items():
        out = F.when(F.col(target) == t, m) if out is None else out.when(F.col(target) == t, m)
    return out


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Zelen and Severo's rational form, absolute error below 7.5e-8)."""
    # Published coefficients.
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def wilcoxon(df: DataFrame, keys: Sequence[str], d: Column) -> DataFrame:
    """Signed-rank test of paired differences; zeros dropped, ties averaged, normal approximation with tie correction."""
    keys = list(keys)
    counts = (df.select(*keys, d.alias("_d")).where("_d <> 0").select(*keys, F.abs("_d").alias("value"), (F.col("_d") > 0).cast("int").alias("_pos"))
              .groupBy(*keys, "value").agg(F.count("*").alias("n_at"), F.sum("_pos").alias("_npos")))
    t = ordered(counts, keys)
    rank, n = F.col("n_before") + (F.col("n_at") + 1) / 2, F.col("n_at").cast("double")
    out = t.groupBy(*keys).agg(F.max("n_total").alias("n"), F.sum(rank * F.col("_npos")).alias("w_plus"),
                               F.sum(rank * (n - F.col("_npos"))).alias("w_minus"),
                               F.sum(n * n * n - n).alias("_ties"))
    nn = F.col("n").cast("double")
    sd = F.sqrt(nn * (nn + 1) * (2 * nn + 1) / 24 - F.col("_ties") / 48)
    z = (F.least("w_plus", "w_minus") - nn * (nn + 1) / 4) / sd
    return out.select(*keys, "n", "w_plus", "w_minus", z.alias("z"), (2 * normal_tail(F.abs(z))).alias("p_value"))


def ks_p_value(ks: Column, n1: Column, n2: Column, terms: int = 50) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    lam = ks * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series))


def holm(df: DataFrame, keys: Sequence[str], p: str, tie: Sequence[str]) -> DataFrame:
    """Step-down correction inside each family of tests (a family is the list of tests of one report)."""
    w = W.partitionBy(*keys).orderBy(p, *tie)
    m = F.count("*").over(W.partitionBy(*keys))
    step = (m - F.row_number().over(w) + 1) * F.col(p)
    return (df.withColumn("_s", step)
            .withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_s"))


def one_standard_error(losses: DataFrame, keys: Sequence[str], model: str, obj: str, complexity: DataFrame) -> DataFrame:
    """Per key and model the mean loss, paired difference to the best, its standard error over the objects that have both,
    and the simplest model within one standard error. Any number of models: the best's losses come by a window over the
    models of one object."""
    own = losses.groupBy(*keys, obj, model).agg(F.first("loss").alias("loss")).join(complexity.select(model), model)
    mean = own.groupBy(*keys, model).agg(F.avg("loss").alias("_m")).where("_m IS NOT NULL")
    best = mean.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(model, F.struct("_m", model)).alias("best"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    paired = own.join(best, same).drop(*[f"_{k}" for k in keys])
    d = F.col("loss") - F.max(F.when(F.col(model) == F.col("best"), F.col("loss"))).over(W.partitionBy(*keys, obj))
    long = (paired.withColumn("_d", d).groupBy(*keys, "best", model)
            .agg(F.avg("loss").alias("criterion"), F.avg("_d").alias("difference"), (F.stddev_samp("_d") / F.sqrt(F.count("_d"))).alias("std_error"))
            .join(complexity, model))
    long = long.withColumn("within", (F.col(model) == F.col("best")) | (F.col("difference") <= F.col("std_error")))
    pick = F.min_by(F.col(model), F.when(F.col("within"), F.struct("complexity", "criterion"))).over(W.partitionBy(*keys))
    return long.withColumn("chosen", F.col(model) == pick)


def challenger(losses: DataFrame, obj: str, model: str, incumbent: str, floor: float = 1e-6) -> DataFrame:
    """Mean loss over repetitions per object, paired difference to the incumbent, and whether the challenger wins by more
    than one standard error."""
    per = losses.groupBy(obj, model).agg(F.avg("loss").alias("loss"))
    base = per.where(F.col(model) == incumbent).select(obj, F.col("loss").alias("_b"))
    d = F.col("loss") - F.col("_b")
    out = per.join(base, obj).groupBy(model).agg(F.avg("loss").alias("criterion"), F.avg(d).alias("difference"),
                                                 (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("std_error"))
    return out.withColumn("wins", (F.col(model) != incumbent) & (F.col("difference") < -F.greatest("std_error", F.lit(floor))))


def permuted_column(df: DataFrame, obj: str, column: str, seed: int) -> DataFrame:
    """The column reassigned between objects by a bijection: position in id order joined to position in hash order."""
    from photonloom.operators.splits import shuffled_rank

    d = df.select(F.lit(1).alias("_k"), obj, column)
    by_id = global_rank(d.select("_k", obj), ["_k"], [obj]).select(obj, "rank0")
    by_hash = shuffled_rank(d, obj, ["_k"], seed).select(F.col(obj).alias("_src"), "rank0")
    values = d.select(F.col(obj).alias("_src"), F.col(column).alias(f"{column}_permuted"))
    return by_id.join(by_hash, "rank0").join(values, "_src").select(obj, f"{column}_permuted")
