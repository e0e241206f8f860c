"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings applied when the session leaves them at Spark's default. Joins on (obj_id, y, x) may reuse a layout hashed on
#: obj_id alone, so pixel tables are shuffled once per job and not once per join. The size of a scan says nothing about a table whose
#: rows are exploded, so no join is broadcast by that estimate, only by measured sizes or a hint. Shuffles are cut fine and put together
#: up to a size, so that what one task reads stays the same on larger tables.
RUNTIME_DEFAULTS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for scripts and tests; on a cluster, spark-submit supplies master, memory and spark.checkpoint.dir."""
    b = SparkSession.builder.appName("photonloom").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**RUNTIME_DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults to a session built elsewhere."""
    for k, v in RUNTIME_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by spark.checkpoint.dir; a temporary folder only for local masters."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder lies at `path`, on whatever file system it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, so that they find it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        here = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), f"{here.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(target)
    return spark


#: Rows of a table that each task may hold.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Materialize a table that is expected to be small, such as one row per group; it is broadcast if its count says so."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def kept_rows(df: DataFrame) -> DataFrame:
    """Materialize a table of many rows that is read several times, as Parquet in the shared folder: each pass reads the columns it needs.
    Unlike `cut_lineage` this fixes the rows, not their partitions."""
    sc = df.sparkSession.sparkContext
    base = f"{shared_dir(df.sparkSession).rstrip('/')}/rows-{sc.applicationId}"
    where = sc._jvm.org.apache.hadoop.fs.Path(base)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    path = f"{base}/{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize a DataFrame in the shared folder; partition ids and contents are fixed from here on."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
