"""Near duplicates by SimHash fingerprints and the generalised pigeonhole principle.

Two 64-bit fingerprints within `distance` bits, cut into m partitions with thresholds T_1..T_m that sum to
distance - m + 1, agree within T_i bits in some partition i; T_i = -1 skips a partition. A bounded sample of
fingerprints gives the correlations, by which correlated bits share a partition, and the candidates that each partition
has at each threshold; dynamic programming picks the thresholds with the fewest. Every fingerprint probes with its
partition keys and their variants within T_i bits; candidates are verified on all bits.

A bucket of more than PAIR_LIMIT fingerprints isn't paired: its members meet at their one-bit variants instead, which two
fingerprints share exactly if they differ in two bits or fewer, so the work per fingerprint is constant (for distances
over two: variants of as many bits as half the distance, rounded up, verified). Copies share one fingerprint and are
never paired. Components come from star contractions.

Defined results: a null text has no words; without words the fingerprint is zero; null ids take part but are never a
component's id, unless it has no other; repeated rows give repeated rows; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import stored
from photonloom.llm.components import roots

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 3, 2
NO_ID = -(1 << 63)
#: Fingerprints that fit the partitions and thresholds, taken in hash order. Only costs depend on them.
SAMPLE = 20_000
PARTITIONS = 3
PAIR_LIMIT = 200
#: Hashes whose bits are counted at once, so that a very long text needs no more memory.
CHUNK = 1 << 16


def gram_hashes(words: list[bytes], shingle: int = SHINGLE) -> bytes:
    """Hashes of all shingles, eight bytes each, most significant first; none without words."""
    import xxhash

    if not words:
        return b""
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    return b"".join([digest(g, SEED) for g in grams])


def bits_of(hashes: bytes) -> int:
    """Signed 64-bit fingerprint: the bits set in over half the hashes."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8 * CHUNK):
        bits = np.unpackbits(np.frombuffer(hashes[at:at + 8 * CHUNK], np.uint8).reshape(-1, 8), axis=1)
        n += len(bits)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a word sequence; zero without words."""
    return bits_of(gram_hashes(words, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp of every row: A-Z in lower case, words between ASCII white space."""
    def run(batches):
        for b in batches:
            fps = [fingerprint((t.as_buffer().to_pybytes() if t.is_valid else b"").lower().split(), shingle) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near equal width in which correlated bits are together: each starts from the bit that is least
    like those taken and takes the bits most like its own."""
    with np.errstate(invalid="ignore", divide="ignore"):
        like = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.eye(BITS)
    free, groups = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        taken = [b for g in groups for b in g]
        own = [min(free, key=lambda b: (like[b, taken].sum(), b))]
        while len(own) < width:
            own.append(max((b for b in free if b not in own), key=lambda b: (like[b, own].sum(), -b)))
        free = [b for b in free if b not in own]
        groups.append(sorted(own))
    return groups


def candidates(bits: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated probes that meet in a partition for thresholds -1, 0, .. most: pairs of the sample, and the variants
    each fingerprint has to probe with."""
    keys = bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))
    _, n = np.unique(keys, return_counts=True)
    width, same = len(group), float((n * (n - 1)).sum() / 2)
    spread = len(keys) ** 2 / 2 / 2.0 ** width
    out, ball = [0.0], 0.0
    for t in range(most + 1):
        ball += float(np.prod([(width - k) / (k + 1) for k in range(t)]))
        out.append(same + spread * (ball - 1) + len(keys) * ball)
    return out


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds of at least -1 that sum to `total` at the least cost: dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, len(cost) - 1):
                option = (c + cost[t + 1], [*ts, t])
                if used + t not in step or option < step[used + t]:
                    step[used + t] = option
        best = step
    return best[total][1]


def fit_partitions(fps: DataFrame, distance: int = DISTANCE, m: int = PARTITIONS, sample: int = SAMPLE) -> list[tuple[int, list[int], int]]:
    """(number, bits, threshold) of the partitions that are probed."""
    rows = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()  # at most `sample` numbers
    bits = bit_matrix(np.array([r[0] for r in rows], np.int64)) if rows else np.zeros((0, BITS), np.int8)
    groups = group_bits(bits, m)
    thresholds = allocate([candidates(bits, g, distance) for g in groups], distance - m + 1)
    return [(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds)) if t >= 0]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits) -> int:
    return _signed(sum(1 << (BITS - 1 - b) for b in bits))


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks that flip 1 to `most` of the bits."""
    return [_mask(c) for k in range(1, most + 1) for c in combinations(bits, k)]


def _keys(fp: Column, parts, probes: bool) -> Column:
    """Array of (partition, key): the partition's own bits, or those changed within the threshold."""
    made = []
    for i, bits, t in parts:
        own = fp.bitwiseAND(F.lit(_mask(bits)))
        if not probes:
            made.append(F.array(F.struct(F.lit(i).alias("part"), own.alias("key"))))
        elif t > 0:
            flips = F.array(*[F.lit(x).cast("long") for x in _flips(bits, t)])
            made.append(F.transform(flips, lambda x: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(x).alias("key"))))
    return F.concat(*made) if made else F.array().cast("array<struct<part:int,key:bigint>>")


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, distance: int = DISTANCE, m: int = PARTITIONS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all those within `distance` bits."""
    parts = fit_partitions(fps, distance, m)
    fp = F.col("fp")
    own = fps.select("fp", F.explode(_keys(fp, parts, False)).alias("k"), F.lit(0).alias("probe"))
    every = own
    if any(t > 0 for _, _, t in parts):
        every = own.unionByName(fps.select("fp", F.explode(_keys(fp, parts, True)).alias("k"), F.lit(1).alias("probe")))
    every = every.select("fp", "k.part", "k.key", "probe")
    load = every.groupBy("part", "key").agg(F.count(F.when(F.col("probe") == 0, 1)).alias("n_own"), F.count("*").alias("n")).where("n_own > 0 AND n > 1")
    live = stored(every.join(load.select("part", "key", "n_own"), ["part", "key"]), "buckets")
    cold = live.where(F.col("n_own") <= pair_limit)
    held = cold.where("probe = 0").select("part", "key", F.col("fp").alias("v"))
    pairs = cold.select("part", "key", F.col("fp").alias("u"), "probe").join(held, ["part", "key"]).where("(probe = 1 AND u <> v) OR u < v").where(_far("u", "v") <= distance).select("u", "v").distinct()
    hot = live.where(F.col("n_own") > pair_limit).select("fp").distinct()
    half = (distance + 1) // 2
    flips = F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in _flips(list(range(BITS)), half)])
    met = hot.select("fp", F.explode(flips).alias("x")).select("fp", fp.bitwiseXOR(F.col("x")).alias("hub"))
    first = met.groupBy("hub").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = met.join(first.select("hub", "v"), "hub").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars.where(_far("u", "v") <= distance).distinct())


def components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id, the smallest id reachable over links, of every row."""
    if distance % 2:
        raise ValueError("an even distance is needed: hot buckets meet at half of it")
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    root = roots(links(distinct, distance))
    of = distinct.join(root.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(of.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "fp")


def summary(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

