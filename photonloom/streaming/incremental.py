"""Incremental measurement and running statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(chunks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of chunks that have no stored result yet."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")


def measure_stream(spark: SparkSession, source: str, schema, measure: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Measure the chunk files that arrived since the last run and stop. The checkpoint remembers the files; every batch
    writes its own folder with overwrite, so a batch that is replayed after a lost driver replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        measure(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source).writeStream.foreachBatch(write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum and sum of squares per key; the state is three numbers per key."""
    return stream.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))


def mean_and_std(moments: DataFrame, key: str) -> DataFrame:
    m = F.col("s") / F.col("n")
    return moments.select(key, "n", m.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - m * m, F.lit(0.0))).alias("std"))


def run_moments(spark: SparkSession, source: str, schema, key: str, value: str, out: str, checkpoint: str) -> DataFrame:
    """X02 end to end: every trigger rewrites the totals so far; the last batch holds the result."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 8).parquet(source)
    (running_moments(src, key, value).writeStream.outputMode("complete").foreachBatch(write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    d = spark.read.option("recursiveFileLookup", True).parquet(out)
    last = d.agg(F.max("batch").alias("b")).scalar()
    return mean_and_std(d.where(F.col("batch") == last), key)
