"""Writers. Nothing is ever overwritten, and writes stay below an allowed root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.session import path_exists


def guarded_write(df: DataFrame, path: str, root: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists",
                  **options) -> str:
    """Refuse paths outside the root and existing outputs."""
    inside = path.rstrip("/") + "/"
    if not inside.startswith(root.rstrip("/") + "/") or "/../" in inside:
        raise PermissionError(f"{path} is outside {root}")
    if mode not in ("errorifexists", "append"):
        raise ValueError("only errorifexists and append are allowed")
    w = df.write.mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(path)
    return path


def write_by_split(df: DataFrame, path: str, root: str, split: str = "split") -> str:
    """One folder per split, written by the tasks that hold the rows, so a large split is many files."""
    return guarded_write(df, path, root, partition_by=[split])


def prediction_table(sample: DataFrame, predictions: DataFrame, obj: str, targets: Sequence[str], family: str, seed: int,
                     averaged_views: bool) -> DataFrame:
    """Ids, split, covariate, labels and predictions of one model, joined by id (never by position)."""
    cols = [obj, "split", "redshift", *[F.col(t).alias(f"y_{t}") for t in targets]]
    return (sample.select(*cols).join(predictions.select(obj, *[f"pred_{t}" for t in targets]), obj)
            .withColumns({"family": F.lit(family), "seed": F.lit(seed), "averaged_views": F.lit(averaged_views)}))


def training_pack(ids: DataFrame, images: DataFrame, masks: DataFrame, labels: DataFrame, obj: str) -> DataFrame:
    """Image, mask and labels of the listed ids; what an id lacks stays NULL."""
    return ids.join(images, obj, "left").join(masks, obj, "left").join(labels, obj, "left")


def ensemble_rows(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Out-of-fold rows per repetition and one test set with repetition -1."""
    v = validation.withColumn("split", F.lit("Validation"))
    return v.unionByName(test.withColumns({"split": F.lit("Test"), "repetition": F.lit(-1)}))


def append_runs(runs: DataFrame, path: str, root: str, key: str) -> DataFrame:
    """Append the runs whose key is not stored yet; returns what was new."""
    new = runs.join(stored_keys(runs, path, key), key, "left_anti")
    guarded_write(new, path, root, mode="append")
    return new


def stored_keys(like: DataFrame, path: str, key: str) -> DataFrame:
    """Keys of the runs at `path`; none where nothing has been written. What cannot be read is an error."""
    spark = like.sparkSession
    return spark.read.parquet(path).select(key).distinct() if path_exists(spark, path) else like.select(key).limit(0)


def stage_summary(df: DataFrame, keys: Sequence[str], stats: Sequence[Column], path: str | None = None, root: str | None = None) -> DataFrame:
    """Counts and scalar statistics of a stage, optionally written as JSON."""
    out = df.groupBy(*keys).agg(*stats)
    if path:
        guarded_write(out, path, root or path, fmt="json")
    return out


# Fixed value: address format of the public image cutout service.
CUTOUT_URL = "https://www.legacysurvey.org/viewer/fits-cutout?ra=%.6f&dec=%.6f&layer={layer}&pixscale={pixscale}&size={size}&bands={bands}"


def cutout_url(ra: str, dec: str, bands: Sequence[str], size: int, pixscale: float, layer: str) -> Column:
    """S09"""
    return F.format_string(CUTOUT_URL.format(layer=layer, pixscale=pixscale, size=size, bands="".join(bands)), ra, dec)
