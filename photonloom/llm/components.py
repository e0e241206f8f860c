"""Connected components of a large edge table by alternating star contractions, each round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import stored


def _digest(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def _lowest(edges: DataFrame) -> DataFrame:
    """u and the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def roots(edges: DataFrame) -> DataFrame:
    """(u, root) for each node of edges (u, v) that isn't a root itself; root is the smallest node of the component.
    A round replaces each node's larger neighbours' links by links to its smallest neighbour, then does the same with
    smaller ones; the number of edges never grows, and rounds are logarithmic in the longest path."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = _digest(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = stored(small, "edges")
        now = _digest(e)
        if now == before:
            break
        before = now
    return e.select("u", F.col("v").alias("root"))
