"""Registered queries of the subpackage: thin, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonloom.llm import conversations, decontaminate, lines, neighbours, orc_tokens, packing, pii, quality, resampling, sharding, simhash, statements, substrings, token_counts
from photonloom.llm.common import table, tokenizer_path
from photonloom.llm.registry import query


@query("op1_pii")
def op1_pii(spark, sf_dir):
    return pii.summary(table(spark, sf_dir, "documents"))


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


@query("op2_packing")
def op2_packing(spark, sf_dir):
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return packing.place(pieces).drop("part", "first", "rank")


@query("op7_orc_tokens")
def op7_orc_tokens(spark, sf_dir):
    return orc_tokens.summary(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    return simhash.summary(table(spark, sf_dir, "documents"))


@query("op6_substrings")
def op6_substrings(spark, sf_dir):
    return substrings.summary(table(spark, sf_dir, "documents"))


@query("op10_decontaminate")
def op10_decontaminate(spark, sf_dir):
    return decontaminate.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_lines")
def op8_lines(spark, sf_dir):
    return lines.summary(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4_quality(spark, sf_dir):
    return quality.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_neighbours")
def op9_neighbours(spark, sf_dir):
    return neighbours.summary(table(spark, sf_dir, "embeddings"))


@query("op11_resampling", statements.OP11)
def op11_resampling(spark, sf_dir):
    return resampling.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_conversations", statements.OP12)
def op12_conversations(spark, sf_dir):
    return conversations.summary(table(spark, sf_dir, "conversations"))


@query("op13_token_counts")
def op13_token_counts(spark, sf_dir):
    return token_counts.summary(table(spark, sf_dir, "documents"), tokenizer_path())
