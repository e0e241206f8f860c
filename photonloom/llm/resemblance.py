"""Groups of documents whose word shingles resemble each other by THRESHOLD or more (Jaccard, on sets).

A SimHash of 64 bits cannot find these alone: at a resemblance of 0.8 two fingerprints differ in about 10 bits and in up to
20, and no split of 64 bits into partitions with thresholds that sum to 20 is selective. So candidates come from two
fingerprints, by the same rule that a similar pair agrees in some partition: the SimHash within `distance` bits
(simhash.links), and BANDS words of ROWS minima each, every word a partition with threshold zero. A pair at the
threshold shares a word with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996. Candidates are verified on the shingles
themselves, hashed to 32 bits. Only exact bounds on these sets drop one before: their sizes, and PARITY bits, of which bit i
tells whether an odd number of hashes ends in i; sets differ in at least as many hashes as their parities in bits.

Copies, by their words, are one node. Every member of a bucket is first held against the bucket's smallest one; pairs
whose ends are then in one group need no verifying, so a dense group costs its size, not its square. A bucket that is left
with several groups is cut into blocks of about PAIR_LIMIT members by a hash. Pairs within blocks come first, then blocks
against blocks in rounds of doubling reach, of STEP distances between blocks at most; after each round groups that met are
one. A bucket is done when it has one group or all its blocks have met, so that no pair of different groups that share a
word is left unverified.

Defined results: texts with fewer words than a shingle are one shingle; null, empty and wordless texts are copies of each
other and resemble nothing else; null ids take part and are never the smallest; rows that share id and text are decided
alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import packed, stored, unpacked
from photonloom.llm.components import roots
from photonloom.llm.simhash import DISTANCE, NO_ID, bits_of, gram_hashes, links

THRESHOLD = (4, 5)  # as a ratio of whole numbers
SHINGLE, BANDS, ROWS = 5, 20, 5
PARITY = 256
PAIR_LIMIT = 64
#: Distances between blocks that are paired in one round: bounds its rows, not the work.
STEP = 64
#: Pairs that read one document's shingles from one copy.
SHARE = 2000
#: Shingles whose minima are taken at once, so that a very long text needs no more memory.
CHUNK = 4096
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def words_of_minima(hashes: np.ndarray) -> list[int]:
    """BANDS signed 64-bit words, each a hash of its number and of ROWS minima; none without shingles."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[at:at + CHUNK, None] * _ODD + _ADD
        least = np.minimum(least, mixed.min(0))
    data = least.reshape(BANDS, ROWS).astype("<u8")
    return [int(np.uint64(xxhash.xxh64_intdigest(data[i].tobytes(), i)).astype(np.int64)) for i in range(BANDS)]


def parity_of(grams: np.ndarray) -> list[int]:
    """PARITY bits as signed 64-bit words: bit i is the parity of the number of hashes that end in i."""
    odd = np.bincount(grams & np.uint32(PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Stored: doc_id, text_key, node (a hash of the words), fp, bands, size, odd (the parity), grams (sorted 32-bit hashes) of every
    row."""
    import xxhash

    def run(batches):
        for b in batches:
            nodes, fps, bands, sizes, odd, grams = [], [], [], [], [], []
            for t in b.column(2).cast(pa.binary()):
                words = (t.as_buffer().to_pybytes() if t.is_valid else b"").lower().split()
                digests = gram_hashes(words, shingle)
                unique = np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))
                nodes.append(int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 1)).astype(np.int64)))
                fps.append(bits_of(digests))
                bands.append(words_of_minima(unique))
                own = np.unique((unique >> np.uint64(32)).astype("<u4"))
                sizes.append(len(own))
                odd.append(parity_of(own))
                grams.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(grams, pa.binary())],
                                             names=["doc_id", "text_key", "node", "fp", "bands", "size", "odd", "grams"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return stored(rows.mapInArrow(run, "doc_id bigint, text_key bigint, node bigint, fp bigint, bands array<bigint>, size int, odd array<bigint>, grams binary"), "sketches")


def _close() -> Column:
    """False only for pairs (nu, ou), (nv, ov) of sizes and parities that cannot reach the threshold: at resemblance r sets
    differ in (1 - r) / (1 + r) of the sum of their sizes."""
    num, den = THRESHOLD
    apart = sum((F.bit_count(F.col("ou")[i].bitwiseXOR(F.col("ov")[i])) for i in range(PARITY // 64)), F.lit(0))
    return (F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num) & (apart * (den + num) <= (F.col("nu") + F.col("nv")) * (den - num))


def verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The stored pairs (u, v) that resemble each other. A document that many pairs read is copied once per SHARE pairs,
    so that it is not one task's."""
    pairs = stored(pairs.select("u", "v").distinct(), "pairs")
    reads = stored(pairs.groupBy("v").agg(F.floor(F.count("*") / SHARE).cast("int").alias("copies")), "reads")
    many = reads.where("copies > 0")
    salted = pairs.join(many, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("copies", F.lit(0)) + 1).cast("int").alias("copy"))
    right = grams.join(reads, F.col("node") == F.col("v")).select("v", F.explode(F.sequence(F.lit(0), F.col("copies"))).alias("copy"), F.col("grams").alias("gv"))
    left = grams.join(pairs.select(F.col("u").alias("node")).distinct(), "node").select(F.col("node").alias("u"), F.col("grams").alias("gu"))
    num, den = THRESHOLD

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), "<u4") for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * den >= max(len(x), len(y)) * num else 0
                keep.append(both > 0 and both * den >= (len(x) + len(y) - both) * num)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = salted.join(right.hint("merge"), ["v", "copy"]).join(left.hint("merge"), "u").select("u", "v", "gu", "gv")
    return stored(both.mapInArrow(run, "u bigint, v bigint"), "resembling")


def _held_against(buckets: DataFrame, pick) -> DataFrame:
    """(u, v): each member (key, node, size, odd) and the one that `pick` takes of its bucket."""
    one = stored(buckets.groupBy("key").agg(pick(F.struct("node", "size", "odd")).alias("r")), "picked")
    return buckets.join(one.hint("merge"), "key").where("node <> r.node").select(F.col("node").alias("u"), F.col("r.node").alias("v"), F.col("size").alias("nu"), F.col("odd").alias("ou"), F.col("r.size").alias("nv"), F.col("r.odd").alias("ov")).where(_close()).select("u", "v")


def _open(buckets: DataFrame, root: DataFrame, first: int) -> DataFrame:
    """Stored: the buckets whose members are in several groups and have blocks `first` or more apart, with each member's
    root, its block and the number of blocks. Whole buckets stay or go, so a member's block never changes."""
    rooted = stored(buckets.join(root.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a <> b")
    mixed = stored(mixed.select("key", F.ceil(F.col("n") / PAIR_LIMIT).cast("int").alias("blocks")).where(F.floor(F.col("blocks") / 2) >= first), "mixed")
    return stored(rooted.join(mixed.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "open")


def _pairs(members: DataFrame, first: int, stop: int) -> DataFrame:
    """(u, v) of different groups whose blocks are `first` to `stop` - 1 apart, counted round the ring of the bucket's blocks."""
    each = members.withColumn("apart", F.explode(F.sequence(F.lit(first), F.least(F.lit(stop - 1), F.floor(F.col("blocks") / 2).cast("int")))))
    v = each.select("key", "apart", F.pmod(F.col("block") - F.col("apart"), F.col("blocks")).alias("block"), F.col("node").alias("v"), F.col("size").alias("nv"), F.col("odd").alias("ov"), F.col("root").alias("rv"))
    u = each.select("key", "apart", "block", F.col("node").alias("u"), F.col("size").alias("nu"), F.col("odd").alias("ou"), F.col("root").alias("ru"))
    return u.join(v.hint("merge"), ["key", "apart", "block"]).where("(apart > 0 OR u < v) AND ru <> rv").where(_close()).select("u", "v")


def groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_key and component_id, the smallest id of the group, of every row."""
    rows = sketches(docs, shingle)
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("size").alias("size"), F.min("odd").alias("odd"), F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "text_key")).alias("at")), "nodes")
    grams = rows.join(nodes.select("node", "at"), "node").where((F.coalesce("doc_id", F.lit(NO_ID)) == F.col("at.d")) & (F.col("text_key") == F.col("at.text_key"))).select("node", "grams").dropDuplicates(["node"])
    each = nodes.select("node", "size", "odd", F.explode("bands").alias("key"))
    shared = stored(nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    buckets = stored(each.join(shared.hint("merge"), "key").select("key", "node", "size", "odd"), "buckets")

    # By SimHash: equal fingerprints, and those within the distance, through the smallest node of each.
    of_fp = stored(nodes.where("size(bands) > 0").groupBy("fp").agg(F.min("node").alias("v")), "fingerprints")
    same = nodes.select("node", "fp").join(of_fp, "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    near = links(of_fp.select("fp"), distance).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    near = near.join(of_fp.select(F.col("fp").alias("fu"), F.col("v").alias("u")), "fu").join(of_fp.select(F.col("fp").alias("fv"), "v"), "fv").select("u", "v")
    ordered = lambda p: p.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = verified(ordered(same.unionByName(near)).unionByName(ordered(_held_against(buckets, F.min))), grams)

    # What is left: buckets with members of several groups, until all their blocks have met.
    root, first, stop = stored(roots(edges), "roots"), 0, 1
    while not (left := _open(buckets, root, first)).isEmpty():
        more = verified(ordered(_pairs(left, first, stop)), grams)
        root = stored(roots(root.select("u", F.col("root").alias("v")).unionByName(more)), "roots")
        buckets = left.select("key", "node", "size", "odd")
        first, stop = stop, min(2 * stop, stop + STEP)
    root = root.select(F.col("u").alias("node"), "root")
    of = nodes.select("node", "first_id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = stored(of, "rooted-nodes")
    lowest = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "text_key", "node").join(of.select("node", "root").join(lowest, "root").select("node", "component_id"), "node").drop("node")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The document with the smallest id of each group, all columns kept."""
    kept = groups(docs, shingle, distance).where("doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), "text_key").distinct()
    rows = packed(docs).withColumn("_doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return unpacked(rows.join(kept.hint("merge"), ["_doc", "text_key"], "left_semi"), docs.columns)
