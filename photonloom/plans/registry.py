"""Named queries and, where SQL can express them, the statement an independent engine must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from photonloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(t) where `t` is a `Tables`; `sql` is the equivalent statement for the same tables."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


_READERS: dict[tuple, DataFrame] = {}
#: Rows of a table that one task starts from.
ROWS_PER_TASK = 250_000


class Tables:
    """Lazy readers of the driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _key(self, name: str) -> tuple:
        return self.spark.sparkContext.applicationId, self.sf_dir, name

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        key = self._key(name)
        if key not in _READERS:
            _READERS[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return _READERS[key]

    def spread(self, name: str, *columns: str) -> DataFrame:
        """The named columns, over at least as many partitions as there are cores, and so many that each has at most
        ROWS_PER_TASK rows: a scan's tasks are cut by bytes, and every row becomes many. A scan that is already wide is left alone."""
        df = getattr(self, name).select(*columns)
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, name).count() // ROWS_PER_TASK))
        return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
