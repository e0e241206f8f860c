"""From raw documents to packed sequences: each stage works on all that the one before it kept.

1. quality: documents that the classifier rejects go.
2. lines: lines that repeat an earlier line, or are one word away from it, go; documents stay.
3. near_duplicates: of documents linked by a resemblance of 0.8 or more over runs of five words, the smallest id stays;
   candidates come from SimHash links and words of minima, and are verified on the shingles.
4. decontaminate: documents with a passage of the benchmark go.
5. packing: the rest is cut and packed into sequences of 1024 tokens; a row per piece.

Stages 1 to 4 return the columns of documents. Null and empty texts pass stages 1 to 4 like any other text (after stage 3
one document without words is left) and pack as the end id alone; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from photonloom.llm import decontaminate, lines, packing, quality, resemblance
from photonloom.llm.common import prepare, stored, table, tokenizer_path

SHINGLE = 5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return resemblance.one_of_each(docs, SHINGLE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.place(packing.cut_documents(docs, tokenizer_path(), with_ids=False)).drop("part", "first", "rank")


STAGES = [("quality", good_quality), ("lines", distinct_lines), ("near_duplicates", near_duplicates), ("decontaminate", without_benchmark), ("packing", pack)]
#: Training, fingerprint components and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
