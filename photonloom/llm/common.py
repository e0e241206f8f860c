"""Helpers shared by the operators: stored tables, document rows, let-binding and prefix sums in expressions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.session import shared_dir

#: Rows of one Arrow batch: documents may be long, so that a batch stays a few MB.
ARROW_ROWS = 1000
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary lies; its files are read, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of batches handed to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder of the session, removed when the session's JVM ends."""
    sc = spark.sparkContext
    base = f"{shared_dir(spark).rstrip('/')}/llm-{sc.applicationId}"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def plus(a: Column, b: Column) -> Column:
    return a + b


def sum_of(values: Column, add=plus) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), add)


def prefix_sums(values: Column, block: int = 128, add=plus) -> Column:
    """For each element of an array of longs the sum of those before it, or what `add` makes of them with 0 as its neutral element. Two
    levels, so that a long array costs n * block and not n * n steps."""
    def inner(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: sum_of(F.slice(v, b * block + 1, block), add))
        bases = let(blocks, lambda s: F.transform(s, lambda _, i: sum_of(F.slice(s, 1, i), add)))
        return let(bases, lambda base: F.transform(v, lambda _, i: add(base[F.floor(i / block).cast("int")], sum_of(F.slice(v, (F.floor(i / block) * block).cast("int") + 1, i % block), add))))

    return let(values, lambda v: F.when(F.size(v) > 0, inner(v)).otherwise(F.array().cast("array<bigint>")))


def doc_key(id_col: str = "doc_id", text: str = "text") -> list[Column]:
    """Identity of a document row: its id, with nulls as a value of their own, and its text's hash, for ids that repeat."""
    return [F.col(id_col), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row in `_row`, so that no column of the table clashes with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The columns of the table again, in their order, with a new text where one is given."""
    return rows.select(*[(text if c == "text" and text is not None else F.col("_row").getField(c)).alias(c) for c in columns])
