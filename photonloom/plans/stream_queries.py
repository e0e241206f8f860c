"""Queries: resumable and streaming jobs over chunk files."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonloom.functions.scalars import r6
from photonloom.operators.registry import VARIANTS, Variant, register_variant
from photonloom.plans.bindings import PIXELS_SQL, pixels, with_sql
from photonloom.plans.cohort_queries import fresh_path
from photonloom.plans.registry import Tables, query
from photonloom.sources.sinks import guarded_write
from photonloom.streaming import incremental as I

CHUNK_SQL = "SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def chunks(t: Tables):
    return t.events.select(F.to_date("ts").alias("day"), "event_type", "value", "event_id")


def measure(df):
    return df.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s07_incremental_chunks", CHUNK_SQL)
def _(t: Tables):
    """A first run measures the chunks of one month half, the second only those without output."""
    path, root = fresh_path(t, "measured")
    c = chunks(t)
    guarded_write(measure(c.where(F.col("day") <= c.agg(F.expr("date_add(min(day), int(datediff(max(day), min(day)) / 2))")).first()[0])), path, root)
    guarded_write(measure(I.pending(c, t.spark.read.parquet(path), "day")), path, root, mode="append")
    return t.spark.read.parquet(path)


@query("x01_stream_of_chunks", CHUNK_SQL)
def _(t: Tables):
    src, root = fresh_path(t, "arrivals")
    out, _ = fresh_path(t, "stream-out")
    guarded_write(chunks(t).repartition("day"), src, root)
    I.measure_stream(t.spark, src, chunks(t).schema, measure, out, f"{out}-state")
    d = t.spark.read.option("recursiveFileLookup", True).parquet(out)
    return d.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("x02_running_moments", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def _(t: Tables):
    src, root = fresh_path(t, "arrivals")
    out, _ = fresh_path(t, "moments")
    guarded_write(chunks(t).repartition(4, "day"), src, root)
    d = I.run_moments(t.spark, src, chunks(t).schema, "event_type", "value", out, f"{out}-state")
    return d.select("event_type", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query("g01_preparation_variant", with_sql(PIXELS_SQL, body="""
SELECT obj_id, band, count(*) FILTER (flux <= 0) AS n_failed, round(avg(CASE WHEN flux > 0 THEN log10(flux) ELSE flux END), 6) AS mean, count(*) FILTER (flux <= 0) / count(*) <= 0.05 AS within_budget FROM pixels GROUP BY obj_id, band"""))
def _(t: Tables):
    """A registered variant; rows it cannot prepare keep the raw value and a reason."""
    v = register_variant(Variant("log_flux", lambda px, floor: px.withColumn("flux", F.log10(F.when(F.col("flux") > floor, F.col("flux")))), {"floor": 0.0}))
    d = VARIANTS[v.name].apply(pixels(t))
    return d.groupBy("obj_id", "band").agg(F.count_if("failed").alias("n_failed"), r6(F.avg("flux")).alias("mean"), (F.avg(F.col("failed").cast("double")) <= 0.05).alias("within_budget"))
