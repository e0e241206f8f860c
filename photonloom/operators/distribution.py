"""Exact order statistics of groups of any size.

A group may hold a third of the table, so neither `percentile` (one aggregation buffer per group) nor a window partitioned
by the group (one task per group) is used, at any size.

Quantiles, medians and MADs need the rows near a few ranks only. A mergeable sketch brackets each rank; one more pass counts the rows
between brackets and combines the values inside them, a share of about 1 / SKETCH of the group; the rank is read from
that condensed table. A bracket that misses its rank is widened, so the result is exact. Several columns and probabilities share
both passes.

Ranks, ties and KS need every row's place: values are reduced to (group, value, weight), range-partitioned on (group, value) and
materialized; prefix weights come from one small row per (partition, group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.functions.scalars import col
from photonloom.session import cut_lineage, kept_rows, small

#: Accuracy of the sketches: their ranks are off by at most a share of 1 / SKETCH of the group.
SKETCH = 10_000
#: Groups of 2^LARGEST rows and more have brackets of one width; nothing else depends on it.
LARGEST = 24


def value_counts(df: DataFrame, keys: Sequence[str], value: Column | str, weight: Column | str | None = None) -> DataFrame:
    """(keys, value, n_at): equal values are combined before the shuffle, so a hot value costs one row per task."""
    w = F.lit(1) if weight is None else col(weight)
    return (df.select(*keys, col(value).alias("value"), w.cast("bigint").alias("w")).where("value is not null and w > 0")
            .groupBy(*keys, "value").agg(F.sum("w").alias("n_at")))


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; b's keys go."""
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(b, on, how).drop(*[f"_k_{k}" for k in keys])


def ordered(counts: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Add n_before (weight of smaller values in the group) and n_total to a (keys, value, n_at) table."""
    keys = list(keys)
    order = list(order) if order else [F.col("value")]
    laid = cut_lineage(counts.repartitionByRange(*[F.col(k) for k in keys], *order))
    laid = laid.withColumn("_part", F.spark_partition_id())
    # One row per (partition, group): bounded by partitions + groups, because the ranges are contiguous.
    blocks = laid.groupBy(*keys, "_part").agg(F.sum("n_at").alias("_w"))
    by_group = W.partitionBy(*keys)
    blocks = blocks.select(
        *keys, "_part",
        F.coalesce(F.sum("_w").over(by_group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_w").over(by_group).alias("n_total"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (null_safe_join(laid, small(blocks), [*keys, "_part"])
            .withColumn("n_before", F.col("_base") + F.coalesce(F.sum("n_at").over(inside), F.lit(0)))
            .drop("_part", "_base"))


def average_rank() -> Column:
    """Average rank of tied values, from an `ordered` table."""
    return F.col("n_before") + (F.col("n_at") + 1) / 2


def _condensed(d: DataFrame, keys: list[str], probs: dict[str, float], spread: float) -> DataFrame:
    """(keys, _value, _n_at, _exact) of rows (keys, _x): values within the brackets by themselves, the rows between two brackets as one
    row under their smallest value."""
    # A sketch's error, and two rows to either side, for groups of 2^size rows or more.
    cuts = [(max(0.0, p - e), min(1.0, p + e)) for size in range(LARGEST + 1) for p in probs.values() for e in [spread * (2 / SKETCH + 2 / 2 ** size)]]
    q = d.groupBy(*keys).agg(F.percentile_approx("_x", [x for cut in cuts for x in cut], SKETCH).alias("_q"), F.least(F.floor(F.log2(F.count("*"))), F.lit(LARGEST)).cast("int").alias("_p"))
    at = F.col("_p") * (2 * len(probs))
    q = q.select(*keys, *[F.get("_q", at + 2 * i + side).alias(f"_{n}{i}") for i in range(len(probs)) for side, n in ((0, "lo"), (1, "hi"))])
    joined = null_safe_join(d, small(q), keys)
    within, gap = F.lit(False), F.lit(0)
    for i in range(len(probs)):
        within = within | F.col("_x").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        gap = gap + (F.col("_x") > F.col(f"_hi{i}")).cast("int")
    cells = joined.select(*keys, "_x", within.alias("_exact"), F.when(~within, gap).alias("_gap"), F.when(within, F.col("_x")).alias("_value"))
    return cells.groupBy(*keys, "_exact", "_gap", "_value").agg(F.count("*").alias("_n_at"), F.min("_x").alias("_low")).select(*keys, F.col("_low").alias("_value"), "_n_at", "_exact")


def _selected(d: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles of materialized rows (keys, _x)."""
    spread = 1.0
    while True:
        group = W.partitionBy(*keys)  # of the condensed rows
        t = _condensed(d, keys, probs, spread).withColumn("_n_before", F.coalesce(F.sum("_n_at").over(group.orderBy("_value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        t = t.withColumn("_n_total", F.sum("_n_at").over(group))
        found, cols = _read_ranks(t, keys, probs)
        out = cut_lineage(found)
        missing = F.lit(False)
        for i in range(len(probs)):
            missing = missing | F.col(f"_lo{i}").isNull() | F.col(f"_hi{i}").isNull()
        if out.where(missing).isEmpty():
            return out.select(*keys, *cols)
        spread *= 16


def _read_ranks(t: DataFrame, keys: list[str], probs: dict[str, float]) -> tuple[DataFrame, list[Column]]:
    """The values at the ranks on either side of each quantile, null where no exact row holds the rank; and the quantiles from them."""
    aggs, cols = [F.max("_n_total").alias("_n")], []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("_n_total") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = F.col("_exact") & (F.col("_n_before") <= at) & (at < F.col("_n_before") + F.col("_n_at"))
            aggs.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{side}{i}"))
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))).alias(name))
    return t.groupBy(*keys).agg(*aggs), cols


def quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, probs: dict[str, float], weight: Column | str | None = None, kept: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles; one output column per entry of `probs`. Weighted rows are ordered as a whole. The rows are
    read several times, so they are materialized unless they are `kept` already."""
    if weight is not None:
        found, cols = _read_ranks(ordered(value_counts(df, keys, value, weight), keys).withColumnsRenamed({c: f"_{c}" for c in ("value", "n_at", "n_before", "n_total")}).withColumn("_exact", F.lit(True)), list(keys), probs)
        return found.select(*keys, *cols)
    d = df.select(*keys, col(value).alias("_x")).where("_x is not null")
    return _selected(d if kept else kept_rows(d), list(keys), probs)


def median_and_mad(df: DataFrame, keys: Sequence[str], value: Column | str, outlier_factor: float | None = 3.0, kept: bool = False) -> DataFrame:
    """(keys, med, nmad[, outlier_frac]) of a column: 1.4826 MAD about the median and the share beyond `outlier_factor` times it. The rows
    are materialized unless they are `kept` already."""
    keys = list(keys)
    d = df.select(*keys, col(value).alias("_x")).where("_x is not null")
    d = d if kept else kept_rows(d)
    med = small(_selected(d, keys, {"med": 0.5}))
    dev = null_safe_join(d, med, keys).select(*keys, F.abs(F.col("_x") - F.col("med")).alias("_x"))
    mad = small(_selected(dev, keys, {"mad": 0.5}).select(*keys, (1.4826 * F.col("mad")).alias("nmad")))
    if outlier_factor is None:
        return null_safe_join(med, mad, keys)
    tail = F.avg(F.when(F.col("_x") > outlier_factor * F.col("nmad"), 1.0).otherwise(0.0))
    return null_safe_join(med, null_safe_join(dev, mad, keys).groupBy(*keys).agg(F.first("nmad").alias("nmad"), tail.alias("outlier_frac")), keys)


def spearman(df: DataFrame, keys: Sequence[str], a: Column | str, b: Column | str) -> DataFrame:
    """(keys, spearman): Pearson correlation of average ranks. Both columns are ordered in one layout (`part` tells them apart);
    pairs meet their ranks by value, equal pairs as one row. A number stands for the keys of a group."""
    keys = list(keys)
    df = df.select(*keys, col(a).cast("double").alias("_a"), col(b).cast("double").alias("_b")).where("_a is not null and _b is not null")
    groups = small(df.select(*keys).distinct().coalesce(1).withColumn("_g", F.monotonically_increasing_id()))
    pairs = kept_rows(null_safe_join(df, groups, keys).groupBy("_g", "_a", "_b").agg(F.count("*").alias("_n")))
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("v")) for n in ("_a", "_b")])
    both = pairs.select("_g", "_n", F.explode(parts).alias("s")).select("_g", "_n", "s.part", "s.v")
    table = ordered(value_counts(both, ["_g", "part"], "v", "_n"), ["_g", "part"])
    rank = average_rank() - (F.col("n_total") + 1) / 2
    of = {n: table.where(F.col("part") == n).select("_g", F.col("value").alias(n), rank.alias(f"r{n}")) for n in ("_a", "_b")}
    joined = pairs.join(of["_a"], ["_g", "_a"]).join(of["_b"], ["_g", "_b"])
    n, ra, rb = F.col("_n"), F.col("r_a"), F.col("r_b")
    sums = joined.groupBy("_g").agg(F.sum(n * ra * rb).alias("_ab"), F.sum(n * ra * ra).alias("_aa"), F.sum(n * rb * rb).alias("_bb"))
    return groups.join(sums, "_g").select(*keys, (F.col("_ab") / F.nullif(F.sqrt(F.col("_aa") * F.col("_bb")), F.lit(0.0))).alias("spearman"))


def ks_statistic(df: DataFrame, keys: Sequence[str], sample: Column, value: Column | str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: `sample` is a boolean column. Returns keys, n1, n2, ks."""
    keys = list(keys)
    counts = (df.select(*keys, sample.alias("_s"), col(value).alias("value")).where("value is not null")
              .groupBy(*keys, "value").agg(F.count("*").alias("n_at"), F.count_if("_s").alias("_first")))
    table = ordered(counts, keys)
    first = ordered(counts.select(*keys, "value", F.col("_first").alias("n_at")), keys)
    first = first.select(*keys, "value", (F.col("n_before") + F.col("n_at")).alias("_c1"), F.col("n_total").alias("n1"))
    c2 = F.col("n_before") + F.col("n_at") - F.col("_c1")
    n2 = F.col("n_total") - F.col("n1")
    return (table.join(first, [*keys, "value"])
            .groupBy(*keys).agg(F.max("n1").alias("n1"), F.max(n2).alias("n2"),
                                F.max(F.abs(F.col("_c1") / F.col("n1") - c2 / n2)).alias("ks")))


def global_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add rank0 (0-based position of each row in its group under a total order) and n_total, for groups of any size."""
    return (ordered(df.withColumn("n_at", F.lit(1).cast("bigint")), keys, [F.col(c) for c in order])
            .withColumnRenamed("n_before", "rank0").drop("n_at"))
