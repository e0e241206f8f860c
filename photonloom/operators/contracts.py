"""Contracts on tables: each returns a small report DataFrame, and `require` turns a report into an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.functions.scalars import base_name, finite


class ContractError(ValueError):
    pass


def require(violations: DataFrame, message: str) -> None:
    """Raise when a violation table has rows; at most five rows reach the driver."""
    head = violations.limit(5).collect()
    if head:
        raise ContractError(f"{message}: " + "; ".join(str(r.asDict()) for r in head))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_cardinality(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a 1:1 join, with the multiplicity on each side, also keys that one side lacks. Sides are reduced to
    counts before they meet."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    return a.join(b, list(keys), "full_outer").fillna(0, ["n_left", "n_right"]).where("n_left > 1 OR n_right > 1")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """V03"""
    return sorted(set(required) - set(df.columns))


def non_finite(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count of non-finite values per column."""
    return df.groupBy(*keys).agg(*[F.count_if(finite(c).isNull()).alias(c) for c in columns])


def file_name_report(df: DataFrame, obj: str, path: str) -> DataFrame:
    """Rows whose file name does not start with the id, or whose file serves several ids."""
    d = df.select(obj, path, base_name(path).alias("file"))
    users = d.groupBy("file").agg(F.count("*").alias("n_users"))
    return (d.join(users, "file").withColumn("foreign", ~F.startswith(F.col("file"), F.concat(F.col(obj).cast("string"), F.lit("_"))))
            .where("foreign OR n_users > 1"))


def split_disagreement(df: DataFrame, ours: str, published: str, name: str) -> DataFrame:
    """Rows where exactly one of two split columns says `name`."""
    return df.where((F.col(ours) == name) != (F.col(published) == name))


def split_membership(df: DataFrame, obj: str, split: str = "split") -> DataFrame:
    """Per id the number of splits and of rows."""
    return df.groupBy(obj).agg(F.countDistinct(split).alias("n_splits"), F.count("*").alias("n_rows"))


def expected_counts(df: DataFrame, key: str, expected: Mapping[str, int]) -> DataFrame:
    """Observed against expected rows per key value."""
    spark = df.sparkSession
    want = spark.createDataFrame(list(expected.items()), f"{key} string, expected bigint")
    got = df.groupBy(key).agg(F.count("*").alias("observed"))
    return (want.join(got, key, "full_outer").fillna(0, ["expected", "observed"])
            .withColumn("agrees", F.col("expected") == F.col("observed")))


def metric_sanity(table: DataFrame, keys: Sequence[str], n_column: str, metrics: Sequence[str], same_n: Sequence[str]) -> DataFrame:
    """One row of counts: duplicated keys, non-finite and negative metrics, key groups with differing N."""
    dup = duplicate_keys(table, keys).agg(F.count("*").alias("n_duplicate"))
    bad = table.agg(F.sum(sum((finite(m).isNull().cast("int") for m in metrics), F.lit(0))).alias("n_not_finite"),
                    F.sum(sum(((F.col(m) < 0).cast("int") for m in metrics), F.lit(0))).alias("n_negative"))
    spread = (table.groupBy(*same_n).agg(F.countDistinct(n_column).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_uneven")))
    return table.limit(1).select(dup.scalar().alias("n_duplicate"), bad.select("n_not_finite").scalar().alias("n_not_finite"),
                                 bad.select("n_negative").scalar().alias("n_negative"), spread.scalar().alias("n_uneven"))


def close(a: Column, b: Column, atol: float, rtol: float) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def recorded_agree(fresh: DataFrame, recorded: DataFrame, keys: Sequence[str], metrics: Sequence[str], atol: float = 1e-9,
                   rtol: float = 1e-7) -> DataFrame:
    """Per key and metric, whether the recomputed value equals the recorded one."""
    b = recorded.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("fresh"), F.col(f"_{m}").alias("recorded"),
                              F.coalesce(close(F.col(m), F.col(f"_{m}"), atol, rtol), F.lit(False)).alias("agrees")) for m in metrics])
    return fresh.join(b, list(keys), "full_outer").select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")


def row_digest(*columns: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def fingerprint(df: DataFrame, keys: Sequence[str], row: Column) -> DataFrame:
    """Order-free content fingerprint per group.

    Each row digest is cut into four 32-bit words; the sums of the words and the row count identify the content, and are
    plain partial aggregates, so no group is gathered anywhere. The sums are digested once per group.
    """
    d = df.select(*keys, F.md5(row).alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"_w{i}") for i in range(4)]
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), *words)
    return out.select(*keys, "n", row_digest("n", *[f"_w{i}" for i in range(4)]).alias("fingerprint"))


def frozen_split_mismatch(fresh: DataFrame, stored: DataFrame, obj: str, split: str = "split") -> DataFrame:
    """Ids whose recomputed split differs from the stored one, or that only one side knows."""
    a, b = fresh.select(obj, F.col(split).alias("fresh")), stored.select(obj, F.col(split).alias("stored"))
    return a.join(b, obj, "full_outer").where(~F.col("fresh").eqNullSafe(F.col("stored")))


def failure_budget(df: DataFrame, failed: Column, keys: Sequence[str] = (), limit: float = 0.05) -> DataFrame:
    """Share of fallback rows per group and whether it stays within the budget."""
    return (df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"))
            .withColumn("failed_share", F.col("n_failed") / F.col("n")).withColumn("within_budget", F.col("failed_share") <= limit))


def enforce_budget(df: DataFrame, failed: Column, limit: float = 0.05) -> DataFrame:
    require(failure_budget(df, failed, limit=limit).where("NOT within_budget"), f"more than {limit:.0%} of rows fell back")
    return df
