"""Prediction files: one folder per family and seed, named after the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.sources.sinks import guarded_write


def write_prediction_files(df: DataFrame, folder: str, root: str) -> str:
    """One directory model=pred_<family>_s<seed> per model, written in a single job; the model columns stay in the rows."""
    name = F.concat(F.lit("pred_"), "family", F.lit("_s"), F.col("seed").cast("string"))
    return guarded_write(df.withColumn("model", name), folder, root, fmt="csv", partition_by=["model"], header=True)
