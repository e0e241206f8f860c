"""Target-distribution importance resampling over hashed word features.

A document's features are its runs of 1 to `max_words` consecutive words, joined by one space; the bucket of a feature is
the crc32 of its bytes modulo `buckets`. Counts of the buckets over all documents and over all target texts give each
bucket a gain, a document's weight is the mean gain of its features, and a seeded Gumbel draw on top of the weight
decides which documents are drawn, without replacement.

Checksums of all features of a batch are computed at once from a position table. The checksum without its start value is
linear: a byte with d bytes after it contributes a fixed number, so a feature's checksum is the XOR of its bytes'
contributions (`bitwise_xor.reduceat` over the features' spans) and a constant for its length. A span of over BLOCK bytes is
cut into blocks from its end, and neighbouring blocks are folded pair by pair: the left one is advanced over the bytes of
the right one with four lookups.

Counts are summed within each task before they meet, a row per bucket. Ranks come from a range partitioning of the scores
and the row counts of its partitions, so that no task holds all documents.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as an empty one; an id that
repeats is scored and drawn row by row, equal scores by smaller id (nulls first) and then by the text's hash; rows that are alike in all
of these take neighbouring ranks; an empty table gives no rows; an empty target gives every bucket a target count of 0; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import stored

BLOCK = 64
#: Bytes of spans that are looked up at once.
SLICE_BYTES = 1 << 20
BUCKETS, MAX_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
POLYNOMIAL = 0xEDB88320


def _position_table() -> np.ndarray:
    """[d, b]: what byte b contributes with d bytes after it."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, first >> 1 ^ np.uint32(POLYNOMIAL), first >> 1)
    rows = [first]
    for _ in range(BLOCK - 1):
        rows.append(rows[-1] >> 8 ^ first[rows[-1] & 255])
    return np.stack(rows)


class Checksums:
    """crc32 of many byte spans at once."""

    def __init__(self):
        self.table = _position_table()
        self.flat = self.table.ravel()
        self.constant = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)
        #: By level k: what each of a state's four bytes becomes BLOCK << k bytes later.
        self.levels = [np.stack([self.table[BLOCK - 1 - j] for j in range(4)])]

    def _advance(self, state: np.ndarray, level: int) -> np.ndarray:
        """The states after BLOCK << level bytes of zero."""
        while len(self.levels) <= level:
            k = len(self.levels) - 1
            self.levels.append(np.stack([self._advance(self.levels[k][j], k) for j in range(4)]))
        t = self.levels[level]
        return t[0][state & 255] ^ t[1][state >> 8 & 255] ^ t[2][state >> 16 & 255] ^ t[3][state >> 24]

    def _linear(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Linear parts of spans of 1 to BLOCK bytes."""
        out, upto, at = np.empty(len(begin), np.uint32), np.cumsum(length), 0
        while at < len(begin):
            base = upto[at] - length[at]
            end = max(at + 1, int(np.searchsorted(upto, base + SLICE_BYTES, "right")))
            n, last = length[at:end], upto[at:end] - base
            place = np.arange(last[-1], dtype=np.int32)
            after = np.repeat(last.astype(np.int32), n) - 1 - place
            value = data[place + np.repeat(begin[at:end] - (last - n), n)]
            out[at:end] = np.bitwise_xor.reduceat(self.flat[(after << 8) + value], last - n)
            at = end
        return out

    def _constants(self, length: np.ndarray) -> np.ndarray:
        """The checksum of as many bytes of zero."""
        whole, rest = np.divmod(length, BLOCK)
        state = self.constant[rest] ^ np.uint32(0xFFFFFFFF)
        for level in range(int(whole.max(initial=0)).bit_length()):
            state = np.where(whole >> level & 1, self._advance(state, level), state)
        return state ^ np.uint32(0xFFFFFFFF)

    def of(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Unsigned crc32 of data[begin:begin + length] for each span; 0 for an empty one."""
        n = -(-length // BLOCK)
        out = np.zeros(len(begin), np.uint32)
        short = np.flatnonzero(n == 1)
        out[short] = self._linear(data, begin[short], length[short]) ^ self.constant[length[short]]
        long = np.flatnonzero(n > 1)
        if len(long):
            out[long] = self._folded(data, begin[long], length[long], n[long]) ^ self._constants(length[long])
        return out

    def _folded(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, n: np.ndarray) -> np.ndarray:
        first = np.cumsum(n) - n
        from_end = np.repeat(first + n, n) - 1 - np.arange(n.sum())
        stop = np.repeat(begin + length, n) - from_end * BLOCK
        start = np.maximum(stop - BLOCK, np.repeat(begin, n))
        state, level = self._linear(data, start, stop - start), 0
        while n.max() > 1:
            half = (n + 1) // 2
            at = np.cumsum(half) - half
            right = np.repeat(first + n, half) - 1 - 2 * (np.repeat(at + half, half) - 1 - np.arange(half.sum()))
            paired = right > np.repeat(first, half)
            left = np.where(paired, state[right - 1], 0).astype(np.uint32)
            state = self._advance(left, level) ^ state[right]
            first, n, level = at, half, level + 1
        return state


def _lower_and_word_bytes() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return lower, word


LOWER, IS_WORD = _lower_and_word_bytes()
_SHARED: list[Checksums] = []


def checksums() -> Checksums:
    """One per worker."""
    if not _SHARED:
        _SHARED.append(Checksums())
    return _SHARED[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, each word's first byte and length, and each text's number of words."""
    texts = pa.array(texts).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    n_bytes = int(offsets[-1] - offsets[0])
    if not n_bytes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, np.zeros(len(texts), np.int64)
    data = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    word = IS_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < n_bytes)]
    first[border] = word[border]
    last[border - 1] = word[border - 1]
    begin = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - begin
    return data, begin, length, np.diff(np.searchsorted(begin, offsets, "left"))


def features_of(texts: pa.Array, max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of all features in a buffer, the number of the text of each, and each text's number of words."""
    data, begin, length, n_words = words_of(texts)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    if max_words == 1 or not len(begin):
        return data, begin, length, owner, n_words
    ends = np.cumsum(length + 1)
    joined = data[np.minimum(np.arange(ends[-1]) + np.repeat(begin - (ends - length - 1), length + 1), len(data) - 1)]
    joined[ends - 1] = 32
    spans = [(ends - length - 1, ends - 1, owner)]
    for n in range(2, max_words + 1):
        same = owner[n - 1:] == owner[:len(owner) - n + 1]
        spans.append((spans[0][0][:len(same)][same], spans[0][1][n - 1:][same], owner[:len(same)][same]))
    begin, end, owner = (np.concatenate(x) for x in zip(*spans))
    return joined, begin, end - begin, owner, n_words


def bucket_counts(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> DataFrame:
    """(bucket, s, t) for every bucket: how often its features occur in all documents and in all target texts."""
    texts = docs.select(F.lit(0).alias("side"), "text").unionByName(target.select(F.lit(1).alias("side"), "text"))

    def count(batches):
        crc, counts = checksums(), np.zeros((2, buckets), np.int64)
        for b in batches:
            data, begin, length, owner, _ = features_of(b.column(1), max_words)
            side = b.column(0).to_numpy()[owner]
            bucket = crc.of(data, begin, length) % buckets
            for k in (0, 1):
                counts[k] += np.bincount(bucket[side == k], minlength=buckets)
        side, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(side, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[side, bucket])], names=["side", "bucket", "n"])

    found = texts.mapInArrow(count, "side int, bucket int, n bigint").groupBy("bucket").agg(*[F.sum(F.when(F.col("side") == k, F.col("n"))).alias(c) for k, c in ((0, "s"), (1, "t"))])
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").na.fill(0, ["s", "t"])


def gains(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths; the table read has a row per bucket, a parameter."""
    rows = np.array([(r.bucket, r.s, r.t) for r in counts.collect()], np.int64)
    rows = rows[np.argsort(rows[:, 0])]
    s, t = rows[:, 1], rows[:, 2]
    total_s, total_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (total_s + buckets) / ((int(a) + 1) * (total_t + buckets)))) for a, b in zip(s, t)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, text_key, n_words, n_features and the floored mean gain of every document."""
    def weigh(batches):
        crc = checksums()
        for b in batches:
            data, begin, length, owner, n_words = features_of(b.column(1), max_words)
            gained = gain[crc.of(data, begin, length) % len(gain)]
            n = np.bincount(owner, minlength=b.num_rows)
            upto = np.concatenate([[0], np.cumsum(gained[np.argsort(owner, kind="stable")])])
            ends = np.cumsum(n)
            total = upto[ends] - upto[ends - n]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(x.astype(np.int64)) for x in (n_words, n, total // np.maximum(n, 1))]], names=["doc_id", "text_key", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id {kind}, text_key bigint, n_words bigint, n_features bigint, weight bigint")


def with_score(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """weight plus a Gumbel draw that depends on seed and id alone, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long"))


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds `rank` to the floor(percent * N / 100) highest scores of the N rows with enough words; null elsewhere."""
    open_to = F.col("n_words") >= least_words
    rows = stored(rows.withColumn("_open", open_to), "scores")
    order = [F.desc("_open"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("text_key"), F.asc("_row")]
    sorted_rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.count_if("_open").alias("_n_open"))  # a row per partition
    total = F.sum("_n_open").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.floor(total * percent / 100).alias("_limit"))
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    joined = placed.join(F.broadcast(before), "_part")
    return joined.withColumn("rank", F.when(F.col("_open") & (rank <= F.col("_limit")), rank)).drop("_part", "_at", "_row", "_open", "_before", "_limit")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, n_words, n_features, weight, score and rank of every document."""
    gain = gains(bucket_counts(docs, target, buckets, max_words), buckets)
    return drawn(with_score(weighted(docs, gain, max_words), seed), percent, least_words)


def summary(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
