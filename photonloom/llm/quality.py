"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded from its bytes: shares of character classes and
a hashed histogram of byte trigrams, projected to HIDDEN numbers. A gated attention learns from document labels alone how
much each passage counts; the score is a logistic function of the weighted passage mean. Scoring reads every passage of
every text, batch by batch; fitting takes at most SAMPLE_DOCS labelled documents of at most SAMPLE_BYTES each, in the
order of a hash of their ids, so that the driver's work and memory have a bound.

Defined results: a null or empty text is one empty passage and has a score; without labels of both values the score is
their mean, or one half; a label given twice counts by its minimum; null labels and labels of null ids count as none; an empty
table gives no rows; other columns are kept by `keep_good` and never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from photonloom.llm.common import packed, unpacked

PASSAGE, BUCKETS = 1024, 256
SAMPLE_DOCS, SAMPLE_BYTES = 6000, 1 << 16
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 24, 12, 25, 64, 5e-3, 1e-5
# Character classes by byte, as inclusive ranges.
CLASSES = {
    "lower": [(97, 122)], "upper": [(65, 90)], "digit": [(48, 57)], "space": [(32, 32)], "line": [(10, 13)], "stop": [(44, 44), (46, 46), (58, 59)],
    "shout": [(33, 33), (63, 63)], "bar": [(124, 124)], "sign": [(34, 43), (45, 45), (47, 47), (60, 62), (64, 64), (91, 96), (123, 123), (125, 126)], "wide": [(128, 255)],
}
N_FEATURES = len(CLASSES) + 3 + BUCKETS


def _class_of() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for i, ranges in enumerate(CLASSES.values()):
        for lo, hi in ranges:
            table[lo:hi + 1] = i
    return table


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text."""
    lens = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, -(-lens // PASSAGE))
    first = np.cumsum(n) - n
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum(lens) - lens
    passage = np.repeat(first, lens) + (np.arange(len(data)) - np.repeat(at, lens)) // PASSAGE
    total, k = int(n.sum()), len(CLASSES) + 1
    size = np.bincount(passage, minlength=total).astype(np.float32)
    share = np.bincount(passage * k + _class_of()[data], minlength=total * k).reshape(total, k)[:, :-1] / np.maximum(size, 1)[:, None]
    gram = np.zeros(len(data), np.int64)
    wide = data.astype(np.int64)
    if len(data) > 2:
        gram[2:] = (wide[:-2] * 7919 + wide[1:-1] * 263 + wide[2:]) * 40503 >> 7 & BUCKETS - 1
        for k in (0, 1):  # no trigram ends there, whatever text the batch has before
            gram[at[lens > k] + k] = 0
    hist = np.bincount(passage * BUCKETS + gram, minlength=total * BUCKETS).reshape(total, BUCKETS) / np.maximum(size, 1)[:, None]
    peak = -(hist * np.log(np.maximum(hist, 1e-9))).sum(1)
    return np.column_stack([share, np.log1p(size) / 7, peak / 5, hist.max(1), np.sqrt(hist)]).astype(np.float32), n


@dataclass
class Model:
    """Weights of the network, or a constant score."""

    weights: dict[str, np.ndarray] | None
    constant: float = 0.5

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _forward(self.weights, x, n)[-1] if self.weights else np.full(len(n), self.constant)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _forward(w, x, n):
    first = np.cumsum(n) - n
    seg = np.repeat(np.arange(len(n)), n)
    e = np.tanh((x - w["mean"]) / w["std"] @ w["W"] + w["b"])
    t, g = np.tanh(e @ w["V"]), _sigmoid(e @ w["U"])
    s = (t * g) @ w["w"]
    s = np.exp(s - np.maximum.reduceat(s, first)[seg])
    a = s / np.add.reduceat(s, first)[seg]
    z = np.add.reduceat(a[:, None] * e, first)
    return first, seg, e, t, g, a, z, _sigmoid(z @ w["c"] + w["d"])


def _gradients(w, x, n, y):
    first, seg, e, t, g, a, z, p = _forward(w, x, n)
    dl = (p - y) / len(y)
    dz = (dl[:, None] * w["c"])[seg]
    da = (e * dz).sum(1)
    ds = a * (da - np.add.reduceat(a * da, first)[seg])
    dtg = ds[:, None] * w["w"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    de = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - e * e)
    return {"W": ((x - w["mean"]) / w["std"]).T @ de, "b": de.sum(0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dl, "d": np.array(dl.sum())}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit by Adam on bags of passage features and their labels."""
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    w = {"mean": every.mean(0), "std": every.std(0) + 1e-2}
    for k, shape, fan in (("W", (every.shape[1], HIDDEN), every.shape[1]), ("V", (HIDDEN, ATTENTION), HIDDEN), ("U", (HIDDEN, ATTENTION), HIDDEN), ("w", (ATTENTION,), ATTENTION), ("c", (HIDDEN,), HIDDEN)):
        w[k] = rng.normal(0, fan ** -0.5, shape)
    w |= {"b": np.zeros(HIDDEN), "d": np.array(0.0)}
    m = {k: [np.zeros_like(w[k]), np.zeros_like(w[k])] for k in ("W", "b", "V", "U", "w", "c", "d")}
    step = 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), RATE * (1 - epoch / epochs)
        for i in range(0, len(y), BATCH):
            own, step = order[i:i + BATCH], step + 1
            grads = _gradients(w, np.concatenate([bags[j] for j in own]), np.array([len(bags[j]) for j in own]), y[own])
            for k, g in grads.items():
                m[k][0] = 0.9 * m[k][0] + 0.1 * g
                m[k][1] = 0.999 * m[k][1] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k][0] / (1 - 0.9 ** step) / (np.sqrt(m[k][1] / (1 - 0.999 ** step)) + 1e-8) + DECAY * w[k])
    return Model({k: np.asarray(v, np.float32) for k, v in w.items()})


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on labelled documents outside the held-out third. The ids are chosen from the labels alone."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)

    def run(batches):
        for b in batches:
            x, n = encode_passages([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            parts = np.split(x.astype(np.float16), np.cumsum(n)[:-1]) if len(n) else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "quality", "x"])

    got = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "doc_id bigint, quality int, x binary").collect()  # at most sample_docs bags of bounded size
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    return train([np.frombuffer(r["x"], np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in got], np.array([r["quality"] for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with _score, the probability of label 1."""
    def run(batches):
        for b in batches:
            x, n = encode_passages([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
            p = model.scores(x, n) if len(n) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(np.float64), pa.float64())], names=[*b.schema.names, "_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_score", DoubleType())]))


def summary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, all columns kept."""
    return unpacked(score(packed(docs), fit(docs, labels)).where("_score >= 0.5"), docs.columns)
