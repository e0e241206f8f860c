"""Nearest neighbours by inner product: inverted lists, each scanned by an adaptive dimension scan.

A vector gets one more dimension, so that all have the length of the longest; the largest inner product is then the
smallest distance. A random rotation spreads a vector's length over its dimensions, so that a partial distance over the
first d of D estimates the whole; a candidate is abandoned as soon as its estimate exceeds the distance of the k-th best
so far by more than EPSILON / sqrt(d) of it, a hypothesis test that errs rarely. Lists hold rotated vectors in blocks of
columns. Survivors are scored on the original vectors in double precision.

Centroids are fitted on a bounded sample; every vector is indexed. The number of lists probed is chosen on the sample so
that they hold at least COVERAGE of the sample's true neighbours. A list of more than LIST_ROWS vectors is dealt out over
several tasks, however many copies of one vector it holds.

Defined results: vectors that are null, zero, of another dimension than the most frequent, or hold null or non-finite
components take no part, nor do rows without an id; ties go to the smaller id; equal rows count once; rows that share an
id with other vectors are separate candidates; fewer candidates than k give them all; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import stored

K = 20
#: Sample for rotation-space centroids and the number of probes; only costs and recall depend on it.
SAMPLE, SAMPLE_QUERIES, COVERAGE = 8000, 300, 0.98
LIST_ROWS, BLOCK, EPSILON = 4096, 16, 2.5
#: Distances held at once by a scan.
SCAN_CELLS = 1 << 17


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part, of the most frequent dimension."""
    ok = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    ok = ok.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    sizes = ok.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return ok.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (id, vector) once; equal ones are always dealt to the same list and part."""
    if len(np.unique(ids)) == len(ids):
        return ids, x
    rows = np.ascontiguousarray(np.column_stack([ids, (x + 0.0).view(np.int64)]))
    _, own = np.unique(rows.view([("", np.int64)] * rows.shape[1]).ravel(), return_index=True)
    return ids[own], x[own]


class Index:
    """Rotation, centroids and number of probes."""

    def __init__(self, sample: np.ndarray, longest: float, n_lists: int, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.longest = longest
        self.rotation = np.linalg.qr(rng.normal(size=(sample.shape[1] + 1,) * 2))[0]
        points = self.rotate(sample)
        centres = points[rng.permutation(len(points))[:n_lists]]
        for _ in range(8):
            near = self._nearest(points, centres, 1)[:, 0]
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            n = np.bincount(near, minlength=len(centres))
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        self.centres = centres
        self.probes = self._calibrated(sample, points, k)

    def rotate(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(1), 0))
        return np.column_stack([x, extra]) @ self.rotation

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
        d = (centres * centres).sum(1) - 2 * x @ centres.T
        if n == 1:
            return d.argmin(1)[:, None]
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def lists_of(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        return self._nearest(x, self.centres, n)

    def _calibrated(self, sample: np.ndarray, points: np.ndarray, k: int) -> int:
        """Lists to probe so that a sample's true neighbours lie in them, with COVERAGE on the average."""
        q = sample[:SAMPLE_QUERIES]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :min(k, max(1, len(sample) - 1))]
        order = self._nearest(self.rotate(q, True), self.centres, len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        need = np.take_along_axis(place, self.lists_of(points)[:, 0][best], axis=1)
        return int(np.quantile(need, COVERAGE)) + 1


def build_index(rows: DataFrame, k: int = K) -> Index | None:
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not stats["n"]:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()  # at most SAMPLE vectors
    return Index(np.array([r[0] for r in sample]), math.sqrt(stats["m"]) * (1 + 1e-12), max(1, min(int(math.sqrt(stats["n"])), len(sample) // 8, 1024)), k)


def scan(ids: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, q_rotated: np.ndarray, k: int = K):
    """(query's place, id, inner product) as three arrays, by query and nearest first: of each query the best k candidates
    of one list that no test abandons. Queries go in groups, so that a group's distances are SCAN_CELLS numbers at most."""
    dims, step = rotated.shape[1], max(1, SCAN_CELLS // max(1, len(ids)))
    blocks = [(at, np.ascontiguousarray(rotated[:, at:at + BLOCK])) for at in range(0, dims, BLOCK)]
    squares = [(block * block).sum(1) for _, block in blocks]
    head = rotated[:4 * k]
    rounding = 1e-9 * (rotated * rotated).sum(1).max(initial=0.0)
    found = []
    for first in range(0, len(q_ids), step):
        turned = q_rotated[first:first + step]
        whole = ((head[None, :, :] - turned[:, None, :]) ** 2).sum(2)
        kth = np.partition(whole, k, axis=1)[:, k] if len(head) > k else np.full(len(turned), np.inf)  # one more: the query itself may be among them
        far = np.zeros((len(turned), len(ids)))
        for (at, block), square in zip(blocks, squares):
            part, end = turned[:, at:at + BLOCK], min(at + BLOCK, dims)
            live = np.isfinite(far)
            if 4 * live.sum() > live.size:
                far += np.maximum(square[None, :] - 2 * part @ block.T + (part * part).sum(1)[:, None], 0)
            else:
                q, c = np.nonzero(live)
                far[q, c] += ((block[c] - part[q]) ** 2).sum(1)
            if end < dims:
                far[far * (dims / end) > (kth * (1 + EPSILON / math.sqrt(end)) ** 2 + rounding)[:, None]] = np.inf
        last = np.partition(far, k, axis=1)[:, k] if len(ids) > k else np.full(len(turned), np.inf)
        q, c = np.nonzero(np.isfinite(far) & (far <= (last * (1 + 1e-9) + rounding)[:, None]))
        other = ids[c] != q_ids[first + q]
        q, c = q[other] + first, c[other]
        score = (vectors[c] * queries[q]).sum(1)
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[best], ids[c[best]], score[best]))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, index: Index | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, embedding)."""
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    index = index or build_index(vectors, k)
    if index is None:
        return spark.createDataFrame([], schema)

    def listed(batches):
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(index.lists_of(index.rotate(_matrix(b.column(1))))[:, 0], pa.int32()), b.column(0), b.column(1)], names=["list", "vec_id", "embedding"])

    own = stored(vectors.mapInArrow(listed, "list int, vec_id bigint, embedding array<double>"), "lists")
    parts = {r["list"]: -(-r["n"] // LIST_ROWS) for r in own.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a number per list
    shares = np.array([parts.get(i, 0) for i in range(len(index.centres))])

    def dealt(batches):
        for b in batches:
            lists, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(shares[lists], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part, pa.int32()), b.column(1), b.column(2)], names=["list", "part", "vec_id", "embedding"])

    def routed(batches):
        for b in batches:
            if not len(b):
                continue
            lists = index.lists_of(index.rotate(_matrix(b.column(1)), True), index.probes)
            n = shares[lists]
            row, per = np.repeat(np.arange(len(b)), n.sum(1)), n.ravel()
            part = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lists.ravel(), per), pa.int32()), pa.array(part, pa.int32()), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], names=["list", "part", "vec_id", "embedding"])

    def probed(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        x, q = _matrix(candidates.column("embedding")), _matrix(asked.column("embedding"))
        x_ids, q_ids = candidates.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
        x_ids, x = _once(x_ids, x)
        if not len(candidates) or not len(asked):
            q_ids, (place, ids, score) = q_ids[:0], scan(q_ids[:0], x[:0], x[:0], q_ids[:0], q[:0], q[:0], k)
        else:
            place, ids, score = scan(x_ids, x, index.rotate(x), q_ids, q, index.rotate(q, True), k)
        near = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids)], names=["far", "vec_id"])
        return pa.table({"query_id": pa.array(q_ids), "found": pa.ListArray.from_arrays(pa.array(np.searchsorted(place, np.arange(len(q_ids) + 1)), pa.int32()), near)})

    four = "list int, part int, vec_id bigint, embedding array<double>"
    lists, asked = own.mapInArrow(dealt, four), queries.select("vec_id", "embedding").distinct().mapInArrow(routed, four)
    found = lists.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(probed, "query_id bigint, found array<struct<far:double,vec_id:bigint>>")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"))


def summary(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """The nearest of each row whose id is divisible by `every`, among all other rows."""
    rows = valid(embeddings)
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)
