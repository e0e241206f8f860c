"""Token ids in ORC: written in ascending id order, read back stripe by stripe.

Documents are range-partitioned and sorted by id, so that file k holds smaller ids than file k + 1 and a range of
documents is a range of files and stripes. ORC stores the ids with integer run-length encoding; row indexes and a Bloom
filter on the id let a reader skip stripes. Each row also holds the ids before it in its own file; a document's start in
the whole corpus adds the totals of the earlier files, one row per file.

Defined results: a null or empty text has only the end id; null ids come first; rows that share an id are ordered by
their text's hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonloom.llm.common import new_path
from photonloom.llm.tokens import Encoder

END_ID = 0
STRIPE_BYTES = 64 << 20
_SCHEMA = "doc_id bigint, n_tokens bigint, file_start bigint, ids array<int>"


def write_orc(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES) -> str:
    """Encode doc_id, text and write the ids below `path`."""
    ordered = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie"))

    def encode(batches):
        encoder, before = Encoder.get(vocabulary), 0
        for b in batches:
            ids, lens = encoder.encode(b.column(1))
            ends = np.cumsum(lens)
            flat = np.insert(ids, ends, end_id)
            lens = lens + 1
            offsets = np.concatenate([[0], np.cumsum(lens)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int64()), pa.array(before + offsets[:-1], pa.int64()), lists], names=["doc_id", "n_tokens", "file_start", "ids"])
            before += int(offsets[-1])

    (ordered.mapInArrow(encode, _SCHEMA).write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", 1000)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path))
    return path


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with `start`, the ids of all documents before each."""
    stored = spark.read.schema(_SCHEMA).orc(path).withColumn("_file", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"))
    totals = stored.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))  # a row per file
    before = totals.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    return stored.join(before, "_file").withColumn("start", F.col("_before") + F.col("file_start")).drop("_before", "_file", "file_start")


def checksums(batches):
    """crc32 of the ids as little-endian unsigned 32-bit integers; the ids are counted anew."""
    for b in batches:
        ids = b.column(0)
        offsets = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        crc = [zlib.crc32(data[4 * a:4 * z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), *b.columns[1:]], names=["n_tokens", "ids_crc32", *b.schema.names[1:]])


def summary(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write, read back, and return doc_id, start, n_tokens and ids_crc32 of what was read."""
    spark = docs.sparkSession
    path = write_orc(docs, new_path(spark, "orc-tokens"), vocabulary)
    stored = spark.read.schema(_SCHEMA).orc(path).withColumn("_file", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"))
    sums = stored.select("ids", "doc_id", "file_start", "_file").mapInArrow(checksums, "n_tokens bigint, ids_crc32 bigint, doc_id bigint, file_start bigint, _file int")
    totals = stored.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    return sums.join(before, "_file").select("doc_id", (F.col("_before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
