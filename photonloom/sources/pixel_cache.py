"""Pixel cache in chunks (S06): the centre of every image cube, prepared by a variant, written in steps that can be resumed.

A cube is one row, an id and one array per band, so cropping and the controls need no shuffle. A chunk is a micro-batch of
source files: the stream's progress log fixes which files belong to it, so every file is read once, and a driver that is lost
repeats the chunk it was writing and no other. A chunk counts as soon as it stands in the manifest, and `read_cache` sees only such
chunks.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.operators.registry import VARIANTS, Variant
from photonloom.session import path_exists
from photonloom.sources.sinks import guarded_write


@dataclass(frozen=True)
class CubeLayout:
    """Row-major arrays of side x side in every band, of which the central crop x crop are stored as `storage`. With `gaps`, NULL is a pixel
    that the image lacks; it stays NULL and counts neither as a zero nor as a failure."""

    side: int
    crop: int
    bands: tuple[str, ...] = ("g", "r", "z")
    storage: str = "float"
    gaps: bool = False

    @property
    def schema(self) -> str:
        return "obj_id long, " + ", ".join(f"{b} array<double>" for b in self.bands)


def centre(c: Column, layout: CubeLayout) -> Column:
    """The central crop of a row-major array; rows are cut out of it, pixels are not exploded."""
    o = (layout.side - layout.crop) // 2
    return F.flatten(F.transform(F.sequence(F.lit(o), F.lit(o + layout.crop - 1)), lambda y: F.slice(c, (y * layout.side + o + 1).cast("int"), layout.crop)))


def reading_fault(layout: CubeLayout) -> Column:
    """Why a cube cannot be stored, NULL where it can: no id, a band of another size, or a centre with missing values."""
    fault = F.when(F.col("obj_id").isNull(), "no id")
    for b in layout.bands:
        fault = fault.when(F.coalesce(F.size(b), F.lit(0)) != layout.side ** 2, f"size of {b}")
    for b in layout.bands:
        bad = F.exists(centre(F.col(b), layout), lambda v: (F.lit(False) if layout.gaps else v.isNull()) | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False)))
        fault = fault.when(bad, f"values of {b} not finite")
    return fault


def zero_share(c: Column) -> Column:
    """Of the pixels that the array has."""
    return F.size(F.filter(c, lambda v: v == 0)) / F.nullif(F.size(F.filter(c, lambda v: v.isNotNull())), F.lit(0))


def prepared(cubes: DataFrame, layout: CubeLayout, variant: Variant) -> DataFrame:
    """Cubes after the variant, with `fallback`: a cube with one pixel that the variant cannot prepare keeps its raw values in all
    bands. The variant works on pixel rows; one cube is the largest group."""
    if variant.fn is None:
        return cubes.withColumn("fallback", F.lit(False))
    n, bands = layout.side, ", ".join(f"named_struct('band', '{b}', 'v', {b})" for b in layout.bands)
    px = (cubes.repartition("obj_id").selectExpr("obj_id", f"inline(array({bands}))").select("obj_id", "band", F.posexplode("v").alias("p", "flux"))
          .select("obj_id", "band", F.expr(f"int(p div {n})").alias("y"), F.expr(f"int(p % {n})").alias("x"), "flux", F.col("flux").alias("_before")))
    done = variant.apply(px)
    cell = lambda b: F.when(F.col("band") == b, F.struct("y", "x", F.col("flux").cast("double").alias("after"), "_before"))
    d = done.groupBy("obj_id").agg(F.coalesce(F.bool_or(F.when(F.col("_before").isNotNull(), F.col("failed")) if layout.gaps else F.col("failed")), F.lit(False)).alias("fallback"), *[F.array_sort(F.collect_list(cell(b))).alias(b) for b in layout.bands])
    values = {b: F.when(F.col("fallback"), F.transform(b, lambda s: s["_before"])).otherwise(F.transform(b, lambda s: s["after"])) for b in layout.bands}
    return d.select("obj_id", *[v.alias(b) for b, v in values.items()], "fallback")


def stored_form(cubes: DataFrame, layout: CubeLayout) -> DataFrame:
    """Centres in the storage type with the share of zeros of each band. Zeros are pixels without coverage and are counted before
    the cast, which can turn faint values into zeros."""
    d = cubes.withColumns({b: centre(F.col(b), layout) for b in layout.bands})
    return d.select("obj_id", *[F.col(b).cast(f"array<{layout.storage}>").alias(b) for b in layout.bands], *[zero_share(F.col(b)).alias(f"zero_{b}") for b in layout.bands], "fallback")


def _describe(spark: SparkSession, out: str, root: str, layout: CubeLayout, variant: Variant) -> None:
    """The first run writes its settings; a later run with other settings is refused."""
    text = json.dumps({"layout": asdict(layout), "variant": variant.key}, sort_keys=True)
    if not path_exists(spark, f"{out}/layout"):
        guarded_write(spark.range(1).select(F.lit(text).alias("layout")), f"{out}/layout", root, fmt="json")
    elif (old := spark.read.json(f"{out}/layout").first()["layout"]) != text:
        raise ValueError(f"the cache at {out} was built with other settings: {old}")


def build_cache(spark: SparkSession, source: str, out: str, root: str, layout: CubeLayout, variant: Variant = VARIANTS["raw"], files_per_chunk: int = 64) -> DataFrame:
    """Store the cubes of the Parquet files below `source`; returns the manifest (chunk, n_objects, n_fallback).

    Cubes that fail the controls are listed in `errors` and stop the run, as do more fallbacks, over all chunks, than the
    variant allows of all objects. Neither enters the manifest; the next run repeats that chunk. An empty source gives an empty cache.
    """
    _describe(spark, out, root, layout, variant)
    total = spark.read.schema(layout.schema).option("recursiveFileLookup", True).parquet(source).count()  # footers only

    def write(batch: DataFrame, chunk: int) -> None:
        here = f"chunk={chunk}"
        controls = batch.select("obj_id", reading_fault(layout).alias("reason")).where("reason IS NOT NULL")
        controls.write.mode("overwrite").parquet(f"{out}/errors/{here}")
        faults = spark.read.schema("obj_id long, reason string").parquet(f"{out}/errors/{here}")
        if (n := faults.count()) > 0:
            raise RuntimeError(f"{n} cubes fail the controls, listed in {out}/errors/{here}; one is {faults.first().asDict()}")
        stored_form(prepared(batch, layout, variant), layout).write.mode("overwrite").parquet(f"{out}/chunks/{here}")
        row = spark.read.parquet(f"{out}/chunks/{here}").agg(F.count("*").alias("n_objects"), F.count_if("fallback").alias("n_fallback"))
        n_fallback = row.first()["n_fallback"]
        before = manifest(spark, out).where(F.col("chunk") != chunk).agg(F.coalesce(F.sum("n_fallback"), F.lit(0))).first()[0]
        if before + n_fallback > variant.max_failed_share * total:
            raise RuntimeError(f"{before + n_fallback} of {total} cubes could not be prepared, more than {variant.max_failed_share:.0%}")
        row.write.mode("overwrite").parquet(f"{out}/manifest/{here}")

    (spark.readStream.schema(layout.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_chunk).parquet(source)
     .writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination())
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """One row per finished chunk."""
    schema = "n_objects long, n_fallback long, chunk int"
    return spark.read.schema(schema).parquet(f"{out}/manifest") if path_exists(spark, f"{out}/manifest") else spark.createDataFrame([], schema)


def read_cache(spark: SparkSession, out: str, layout: CubeLayout) -> DataFrame:
    """(obj_id, one array per band, zero_<band>, fallback, chunk) of the finished chunks; the manifest prunes the folders."""
    schema = ("obj_id long, " + ", ".join(f"{b} array<{layout.storage}>" for b in layout.bands) + ", " + ", ".join(f"zero_{b} double" for b in layout.bands)
              + ", fallback boolean, chunk int")
    if not path_exists(spark, f"{out}/chunks"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/chunks").join(manifest(spark, out).select("chunk"), "chunk", "left_semi")


def bands_to_rows(cache: DataFrame, bands: Sequence[str]) -> DataFrame:
    """(obj_id, band, image, zero_fraction, fallback): one row per band, made inside each row."""
    cells = ", ".join(f"named_struct('band', '{b}', 'image', {b}, 'zero_fraction', zero_{b})" for b in bands)
    return cache.selectExpr("obj_id", "fallback", f"inline(array({cells}))")
