"""Readers of catalogues, prediction files, scales and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from photonloom.functions.scalars import normal_id

# Fixed value: prediction files are found by these names, either single files or the folders this package writes.
PREDICTION_GLOB = "{pred_*.csv,model=pred_*}"


def read_catalogue(spark: SparkSession, path: str, schema: str | T.StructType, obj: str) -> DataFrame:
    """CSV with an explicit schema; the id is text and trimmed."""
    return spark.read.schema(schema).csv(path, header=True).withColumn(obj, normal_id(obj))


def decode_id(c: str):
    """Binary ids to trimmed text."""
    return F.trim(F.decode(F.col(c), "UTF-8"))


def read_predictions(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """Every prediction file of a folder; an empty folder is an error."""
    reader = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
    try:
        return reader.csv(f"{folder}/{PREDICTION_GLOB}")
    except AnalysisException as e:
        raise FileNotFoundError(f"no {PREDICTION_GLOB} in {folder}") from e


def read_scale(spark: SparkSession, path: str, targets) -> DataFrame:
    """One row per target from a JSON object {target: sigma}."""
    wide = spark.read.schema(", ".join(f"{t} double" for t in targets)).json(path, multiLine=True)
    return wide.selectExpr("inline(array(" + ", ".join(f"named_struct('target', '{t}', 'sigma', {t})" for t in targets) + "))")


def file_inventory(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, obj_id, n_files) of a directory tree; contents are not read. The id is the first group of the
    pattern, applied to the file name; n_files tells ids that have more than one file."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length"))
    files = files.withColumn("obj_id", F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1)).where("obj_id <> ''")
    n = files.groupBy("obj_id").agg(F.count("*").alias("n_files"))
    return files.join(n, "obj_id")


def read_ensemble(spark: SparkSession, path: str, schema, expected: DataFrame, obj: str) -> DataFrame:
    """Stored ensemble predictions; every expected (object, split) must be present in every stored repetition."""
    from photonloom.operators.contracts import require

    d = spark.read.schema(schema).parquet(path)
    repeats = d.select("split", "repetition").distinct()
    want = expected.select(obj, "split").join(repeats, "split")
    require(want.join(d, [obj, "split", "repetition"], "left_anti"), "stored ensemble lacks objects")
    return d
