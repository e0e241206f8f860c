"""Sharding by fixed virtual slots.

Every record hashes to one of a fixed number of slots. Bytes are aggregated by slot, and a stored, versioned map says
which shard holds a slot. Version 1 deals slots round-robin; a rebalance writes the next version, in which as few slots as will
do leave shards above their share and go, largest first, to the shard with the least bytes. Records never move between slots,
so an edit of the map moves whole slots and nothing is rehashed.

Defined results: a null text has no bytes; a null id hashes like any other value; repeated rows share a slot and get
positions of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import let, stored

#: Thousands of slots: fixed for the life of a data set, whatever its size.
SLOTS = 8192
#: Bytes that every row counts besides its text.
ROW_BYTES = 8


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32 and virtual slot of every row; texts are read once and not shuffled."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                       F.pmod(F.xxhash64(F.col(id_col), body), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of every slot, empty slots included: a table of fixed size."""
    used = rows.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").na.fill(0, ["n_rows", "n_bytes"])


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots dealt round-robin."""
    return loads.select("virtual_slot", F.pmod("virtual_slot", F.lit(shards)).alias("shard"), F.lit(1).alias("version"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of the map. A shard above an even share of all bytes frees slots, largest first, as long as they fit
    into what it has too much; empty slots stay, and a shard that is no more frees all. Freed slots are handed out, largest
    first, to the shard with the least bytes; shards that are new start empty. Both folds run over arrays of as many
    elements as there are slots, a constant."""
    m = slot_map.join(loads, "virtual_slot").withColumn("_share", F.sum("n_bytes").over(Window.partitionBy(F.lit(0))) / shards)  # as many rows as slots
    by_shard = m.groupBy("shard", "version").agg(F.first("_share").alias("share"), F.sum("n_bytes").alias("held"), F.array_sort(F.collect_list(F.struct((-F.col("n_bytes")).alias("k"), F.col("virtual_slot").alias("s")))).alias("slots"))
    begin = F.struct((F.col("held") - F.col("share")).alias("over"), F.filter("slots", lambda x: F.lit(False)).alias("free"))
    give = lambda a, x: F.when((x["k"] < 0) & (-x["k"] <= a["over"]), F.struct((a["over"] + x["k"]).alias("over"), F.array_append(a["free"], x).alias("free"))).otherwise(a)
    by_shard = by_shard.withColumn("free", F.when(F.col("shard") < shards, F.aggregate("slots", begin, give)["free"]).otherwise(F.col("slots")))
    kept = F.col("held") + F.aggregate("free", F.lit(0).cast("long"), lambda a, x: a + x["k"])
    one = by_shard.agg(F.array_sort(F.flatten(F.collect_list("free"))).alias("free"), F.map_from_entries(F.collect_list(F.struct("shard", kept))).alias("kept"), F.max("version").alias("version"))
    load0 = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda d: F.coalesce(F.try_element_at("kept", d), F.lit(0).cast("long")))
    start = F.struct(load0.alias("load"), F.array().cast("array<struct<s:int,d:int>>").alias("moved"))
    step = lambda a, x: let(F.array_position(a["load"], F.array_min(a["load"])).cast("int") - 1, lambda d: F.struct(
        F.transform(a["load"], lambda v, i: F.when(i == d, v - x["k"]).otherwise(v)).alias("load"), F.array_append(a["moved"], F.struct(x["s"].alias("s"), d.alias("d"))).alias("moved")))
    moved = one.select(F.explode(F.aggregate("free", start, step)["moved"]).alias("m")).select(F.col("m.s").alias("virtual_slot"), F.col("m.d").alias("to"))
    return (slot_map.join(moved, "virtual_slot", "left")
            .select("virtual_slot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version")))


def balanced_map(rows: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Stored slot loads and the stored map with both of its versions."""
    loads = stored(slot_bytes(rows, slots), "slot-bytes")
    first = first_map(loads, shards)
    return loads, stored(first.unionByName(rebalance(first, loads, shards)), "slot-map")


def assign(rows: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """shard and position of every row under the newest version of the map. A position is the number of rows in the
    shard's earlier slots plus the rank within the slot, so that no task holds a shard."""
    newest = slot_map.join(slot_map.agg(F.max("version").alias("version")), "version").join(loads, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = newest.select("virtual_slot", "shard", "version", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_base"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1)
    return ranked.join(placed, "virtual_slot").withColumn("slot", (F.col("_base") + F.col("_rank")).cast("long")).drop("_base", "_rank")


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, virtual_slot, shard, version, slot (its position in the shard)."""
    rows = stored(slotted(docs, slots), "slotted")
    loads, slot_map = balanced_map(rows, shards, slots)
    return assign(rows, slot_map, loads)
