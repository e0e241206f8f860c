"""Token counts of whole texts; huge documents by overlapping chunks that are spliced where they provably agree.

A text of at most CHUNK characters is counted by the task that reads it. A longer one is cut into chunks of CHUNK characters,
each with the first OVERLAP characters of the next one, which are dealt over the cluster and encoded with offsets. The
tokenizer first cuts a text into pieces from left to right, by a pattern that looks ahead by one character beyond white space at most, and
merges bytes within a piece only. So if two scans of one text both have a border between pieces at a place, they agree from
there on, whatever each has read before. The first chunk's borders are those of the whole text, but for the last few characters
before its end, where a look ahead or a special string may be cut off (`margin`); a border that the next chunk shares in
the overlap makes that chunk's borders from there on right too, and so on. Counts are taken from splice to splice.

Where two neighbours share no border, the overlap is widened to the whole next chunk: they are encoded as one, and the new chunk has
to agree with its neighbours again. A piece as long as the document ends as one chunk. Chunks are numbered rows of a
stored table, so that rows that share an id, or are alike, are counted apart.

Proofs hold for byte-level tokenizers without normalizer, with the usual pattern and special strings that keep the white space beside them; for
any other vocabulary, and for sentencepiece models, every text is encoded as a whole.

Defined results: a null or empty text has no tokens; an empty table gives no rows; special strings in a text count as the
library's default has them; other columns are ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import stored
from photonloom.llm.tokens import Encoder

CHUNK, OVERLAP, LIMIT = 1 << 16, 1 << 10, 1024
_TOKENIZERS: dict[str, object] = {}


def added_strings(vocabulary: str) -> list[str]:
    """Strings that the library looks for before it cuts a text into pieces."""
    with open(vocabulary, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def splittable(vocabulary: str) -> bool:
    """Whether borders of pieces can be proven for this vocabulary."""
    if not vocabulary.endswith(".json"):
        return False
    with open(vocabulary, encoding="utf-8") as f:
        v = json.load(f)
    cut = v.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in v["added_tokens"])
    return v["normalizer"] is None and v["truncation"] is None and v["padding"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and plain


def tokenizer(vocabulary: str):
    """One per worker: offsets count all characters, white space too."""
    if vocabulary not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if vocabulary.endswith(".model"):
            import sentencepiece

            _TOKENIZERS[vocabulary] = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        else:
            from tokenizers import Tokenizer, pre_tokenizers

            t = Tokenizer.from_file(vocabulary)
            t.no_truncation()
            t.no_padding()
            if splittable(vocabulary):
                t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
            _TOKENIZERS[vocabulary] = t
    return _TOKENIZERS[vocabulary]


def _lengths(vocabulary: str, texts: list[str]) -> list[int]:
    """The library's own count of whole texts."""
    t = tokenizer(vocabulary)
    if vocabulary.endswith(".model"):
        return [len(x) for x in t.encode(texts, num_threads=1)]
    return [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def whole_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of texts that a task encodes as they are. Texts without special strings are counted by
    remembered words."""
    can_split = splittable(vocabulary)
    special = added_strings(vocabulary) if can_split else []

    def count(batches):
        for b in batches:
            texts = b.column(1)
            if can_split:
                plain = pa.array(np.ones(len(texts), bool))
                for s in special:
                    plain = pc.and_(plain, pc.invert(pc.match_substring(texts, s)))
                n = np.zeros(len(texts), np.int64)
                mask = plain.to_numpy(zero_copy_only=False)
                n[mask] = Encoder.get(vocabulary).encode(texts.filter(plain))[1]
                n[~mask] = _lengths(vocabulary, texts.filter(pc.invert(plain)).to_pylist())
            else:
                n = np.array(_lengths(vocabulary, texts.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "n_bytes").mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def cut_chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Stored: row (a number of its own), doc_id, n_bytes, first and last chunk's numbers, body, tail (the next chunk's first characters)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            for row, doc_id, n_bytes, text in zip(*(c.to_pylist() for c in b.columns)):
                last = (len(text) - 1) // chunk
                for k in range(last + 1):
                    end = (k + 1) * chunk
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "n_bytes": n_bytes, "first": k, "last": k, "body": text[k * chunk:end], "tail": text[end:end + overlap]}], schema=schema)

    schema = pa.schema([("row", pa.int64()), ("doc_id", _arrow(kind)), ("n_bytes", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("body", pa.string()), ("tail", pa.string())])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text")
    made = rows.mapInArrow(cut, f"row bigint, doc_id {kind}, n_bytes bigint, first bigint, last bigint, body string, tail string")
    return stored(made.repartition("row", "first"), "chunks")


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def borders(chunks: DataFrame, vocabulary: str, overlap: int) -> DataFrame:
    """Encodes chunks: n_tokens of body and tail, and the borders of pieces within the overlaps on the left (from the chunk's
    start) and on the right (from the tail's start), each with the tokens of the chunk before it."""
    margin = max(map(len, added_strings(vocabulary)), default=0) + 8
    pair = pa.list_(pa.int64())
    schema = pa.schema([("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n_tokens", pa.int64()), ("left_at", pair), ("left_n", pair), ("right_at", pair), ("right_n", pair)])

    def encode(batches):
        t = tokenizer(vocabulary)
        for b in batches:
            for row, first, last, body, tail in zip(*(c.to_pylist() for c in b.columns)):
                e = t.encode(body + tail, add_special_tokens=False)
                words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
                begins = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
                offsets = e.offsets
                at = np.array([offsets[i][0] for i in begins], np.int64)
                sure = at <= len(body) + len(tail) - (margin if tail else 0)
                left, right = sure & (at < overlap), sure & (at >= len(body))
                yield pa.RecordBatch.from_pylist([{"row": row, "first": first, "last": last, "n_tokens": len(e), "left_at": at[left], "left_n": begins[left], "right_at": at[right] - len(body), "right_n": begins[right]}], schema=schema)

    return chunks.select("row", "first", "last", "body", "tail").mapInArrow(encode, "row bigint, first bigint, last bigint, n_tokens bigint, left_at array<bigint>, left_n array<bigint>, right_at array<bigint>, right_n array<bigint>")


def splices(edges: DataFrame) -> DataFrame:
    """Each chunk but a document's first, with the tokens of the chunk before it that end at the splice (`taken`) and its own
    tokens before the splice (`skipped`); both null where the two share no border."""
    own = edges.where("first > 0").select("row", "first", "left_at", "left_n")
    before = edges.select("row", (F.col("last") + 1).alias("first"), F.col("first").alias("before"), "right_at", "right_n")
    at = F.array_min(F.array_intersect("left_at", "right_at"))
    number = lambda n, place: F.try_element_at(n, F.array_position(place, F.col("at")).cast("int"))
    both = own.join(before, ["row", "first"]).withColumn("at", at)
    return both.select("row", "first", "before", F.when(F.col("at").isNotNull(), number(F.col("right_n"), F.col("right_at"))).alias("taken"), F.when(F.col("at").isNotNull(), number(F.col("left_n"), F.col("left_at"))).alias("skipped"))


def _widened(chunks: DataFrame, joints: DataFrame) -> DataFrame:
    """One chunk of each run of chunks that share no border."""
    fails = joints.where("taken IS NULL").select("row", "first", F.lit(True).alias("joined"))
    marked = chunks.join(fails, ["row", "first"], "left")
    # A run's head is the last chunk at or before it that isn't joined to the one before.
    head = F.max(F.when(F.col("joined").isNull(), F.col("first"))).over(Window.partitionBy("row").orderBy("first"))
    heads = marked.select("row", "first", "joined").withColumn("head", head)  # a row per chunk of a document, without its text
    runs = heads.where("joined").select("row", F.col("head").alias("first")).distinct()
    wanted = heads.join(runs.withColumnRenamed("first", "head"), ["row", "head"], "left_semi")
    parts = chunks.join(wanted.select("row", "first", "head"), ["row", "first"])
    whole = F.array_sort(F.collect_list(F.struct("first", "last", "body", "tail")))
    made = parts.groupBy("row", "head").agg(whole.alias("p"), F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"))
    end = F.element_at("p", -1)
    return made.select("row", "doc_id", "n_bytes", F.col("head").alias("first"), end["last"].alias("last"), F.array_join("p.body", "").alias("body"), end["tail"].alias("tail"))


def chunked_counts(docs: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of huge documents."""
    chunks = cut_chunks(docs, chunk, overlap)
    edges = stored(borders(chunks, vocabulary, overlap), "edges")
    while True:
        joints = stored(splices(edges), "joints")
        if joints.where("taken IS NULL").isEmpty():
            break
        wide = stored(_widened(chunks, joints), "chunks")
        covered = wide.select("row", F.explode(F.sequence("first", "last")).alias("first"))
        chunks = stored(chunks.join(covered, ["row", "first"], "left_anti").unionByName(wide.select(chunks.columns)), "chunks")
        edges = stored(edges.join(covered, ["row", "first"], "left_anti").unionByName(borders(wide, vocabulary, overlap)), "edges")
    # A document: tokens of all chunks up to their right splices, less those before their left ones.
    right = joints.select("row", F.col("before").alias("first"), "taken")
    each = edges.select("row", "first", "n_tokens").join(right, ["row", "first"], "left").join(joints.select("row", "first", "skipped"), ["row", "first"], "left")
    total = each.groupBy("row").agg(F.sum(F.coalesce("taken", "n_tokens") - F.coalesce("skipped", F.lit(0))).alias("n_tokens"))
    return chunks.where("first = 0").select("row", "doc_id", "n_bytes").join(total, "row").select("doc_id", "n_bytes", "n_tokens")


def count_tokens(docs: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    if not splittable(vocabulary):
        return whole_counts(rows, vocabulary)
    huge = F.length("text") > chunk
    return whole_counts(rows.where(~huge), vocabulary).unionByName(chunked_counts(rows.where(huge), vocabulary, chunk, overlap))


def summary(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    return count_tokens(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
