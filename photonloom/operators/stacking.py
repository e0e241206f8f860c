"""Search and nested validation over combination families, on second moments.

Every family but boosted trees is a linear function of an object's inputs: the members' predictions, their disagreement and a
covariate. So its fit and its error are functions of one moment matrix. A pass over the objects adds up that matrix per
repetition and cell of the nested folds, in Arrow batches; a task sends one matrix per cell, whatever it has read. What a
fold leaves out is the total less its cells, so search and nested search need no further pass. The driver holds
repetitions x cells matrices of members x targets squared, never rows.

Folds have equal size: they come from the rank in a seeded permutation. Boosted trees are fitted by Spark on the rows of each
fold's complement.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.operators.splits import shuffled_rank
from photonloom.session import cut_lineage

KINDS = ("uniform", "convex", "positive", "ridge", "trees")


@dataclass(frozen=True)
class Candidate:
    """One configuration. convex: `regularization`, `scope` (target or global); positive: `alpha`, `l1_ratio` (alpha 0: plain
    least squares); ridge and trees correct the uniform mean from `inputs` (same or all targets), with or without covariate and
    disagreement."""

    kind: str
    regularization: float = 0.0
    scope: str = "target"
    alpha: float = 0.0
    l1_ratio: float = 0.5
    inputs: str = "all"
    covariate: bool = False
    disagreement: bool = False
    depth: int = 3
    rate: float = 0.1
    iterations: int = 20

    def __post_init__(self):
        if self.kind not in KINDS or self.scope not in ("target", "global") or self.inputs not in ("same", "all"):
            raise ValueError(f"no such candidate: {self}")


def candidates_of(table: DataFrame) -> list[Candidate]:
    """The rows of a candidate table, in order of its `candidate` column; columns and cells left out keep their defaults.
    The table is a list of settings, read as a whole."""
    known = {f.name for f in fields(Candidate)}
    rows = table.orderBy("candidate").collect()
    return [Candidate(**{k: v for k, v in r.asDict().items() if k in known and v is not None}) for r in rows]


@dataclass(frozen=True)
class Layout:
    """Places in the vector of one object: 1, predictions by target and member, disagreement by target, covariate, labels by target.
    Predictions and labels are in units of the target's train scale."""

    members: tuple[str, ...]
    targets: tuple[str, ...]

    @property
    def size(self) -> int:
        return 2 + len(self.targets) * (len(self.members) + 2)

    def predictions(self, j: int) -> list[int]:
        m = len(self.members)
        return list(range(1 + j * m, 1 + (j + 1) * m))

    def disagreement(self, j: int) -> int:
        return 1 + len(self.targets) * len(self.members) + j

    @property
    def covariate(self) -> int:
        return 1 + len(self.targets) * (len(self.members) + 1)

    def label(self, j: int) -> int:
        return self.covariate + 1 + j

    def inputs(self, c: Candidate, j: int) -> list[int]:
        of = [j] if c.inputs == "same" else range(len(self.targets))
        return ([i for t in of for i in self.predictions(t)] + ([self.covariate] if c.covariate else []) + ([self.disagreement(t) for t in of] if c.disagreement else []))


# --- fits on moments --------------------------------------------------------------------------------------------------------
def positive_solution(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """argmin 0.5 b'Qb - c'b over b >= 0, by an active set: exact after finitely many steps, or an error."""
    b, free = np.zeros(len(c)), np.zeros(len(c), bool)
    slack = 1e-12 * max(1.0, float(np.abs(c).max(initial=0.0)))
    for _ in range(50 * (len(c) + 1)):
        gain = np.where(free, -np.inf, c - q @ b)
        if gain.max(initial=-np.inf) <= slack:
            return b
        free[int(np.argmax(gain))] = True
        while True:
            at = np.flatnonzero(free)
            s = np.zeros(len(c))
            s[at] = np.linalg.lstsq(q[np.ix_(at, at)], c[at], rcond=None)[0]
            low = at[s[at] <= 0]
            if not len(low):
                break
            step = min(b[i] / (b[i] - s[i]) if b[i] > s[i] else 0.0 for i in low)
            b = b + step * (s - b)
            free &= b > 1e-15
            b[~free] = 0.0
            if not free.any():
                break
        b = np.where(free, s, 0.0)
    raise RuntimeError("active set did not end: the moments are degenerate")


def simplex_solution(gram: np.ndarray, regularization: float = 0.0) -> np.ndarray:
    """argmin w'Gw + reg |w - 1/M|^2 over the simplex, for any number of members: an active set from the best vertex."""
    m = len(gram)
    q, c = gram + regularization * np.eye(m), np.full(m, regularization / m)
    free = np.zeros(m, bool)
    free[int(np.argmin(np.diag(q) - 2 * c))] = True
    w = free.astype(float)
    for _ in range(50 * (m + 1)):
        at = np.flatnonzero(free)
        k = len(at)
        kkt = np.block([[q[np.ix_(at, at)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
        s = np.zeros(m)
        s[at] = np.linalg.lstsq(kkt, np.append(c[at], 1.0), rcond=None)[0][:k]
        low = at[s[at] < 0]
        if len(low):
            step = min(w[i] / (w[i] - s[i]) if w[i] > s[i] else 0.0 for i in low)
            w = w + step * (s - w)
            drop = low[np.argmin(w[low])]
            free[drop], w[drop] = False, 0.0
            continue
        w = s
        slope = q @ w - c
        level = float(slope[at].mean())
        worst = np.where(free, np.inf, slope - level)
        if worst.min() >= -1e-12 * max(1.0, abs(level)):
            return w / w.sum()
        free[int(np.argmin(worst))] = True
    raise RuntimeError("active set did not end: the Gram matrix is degenerate")


def _centred(s: np.ndarray, a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    n = s[0, 0]
    return s[np.ix_(a, b)] / n - np.outer(s[0, a], s[0, b]) / n ** 2


def fitted(c: Candidate, s: np.ndarray, lay: Layout) -> np.ndarray:
    """(targets, size): the prediction of each target as a linear function of an object's vector."""
    w, n, m = np.zeros((len(lay.targets), lay.size)), s[0, 0], len(lay.members)
    if c.kind == "convex":
        grams = []
        for j in range(len(lay.targets)):
            r = np.zeros((m, lay.size))
            r[np.arange(m), lay.predictions(j)], r[:, lay.label(j)] = 1, -1
            grams.append(r @ s @ r.T / n)
        if c.scope == "global":
            grams = [sum(grams) / len(grams)] * len(grams)
    for j in range(len(lay.targets)):
        own = lay.predictions(j)
        if c.kind == "convex":
            w[j, own] = simplex_solution(grams[j], c.regularization)
        elif c.kind == "positive":
            q, xy = _centred(s, own, own), _centred(s, own, [lay.label(j)])[:, 0]
            b = positive_solution(q + c.alpha * (1 - c.l1_ratio) * np.eye(m), xy - c.alpha * c.l1_ratio)
            w[j, own], w[j, 0] = b, (s[0, lay.label(j)] - b @ s[0, own]) / n
        else:
            w[j, own] = 1 / m
        if c.kind == "ridge":
            x = lay.inputs(c, j)
            rest = -w[j]
            rest[lay.label(j)] += 1  # what the uniform mean leaves
            mean, cov = s[0, x] / n, _centred(s, x, x)
            std = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-12
            xr = (s[x] @ rest / n - mean * (s[0] @ rest) / n) / std
            b = np.linalg.solve(cov / np.outer(std, std) + c.alpha / n * np.eye(len(x)), xr) / std
            w[j, x] += b
            w[j, 0] += s[0] @ rest / n - b @ mean
    return w


def squared_error(w: np.ndarray, s: np.ndarray, lay: Layout) -> np.ndarray:
    """Sum of squared errors by target of predictions w on objects with moments s."""
    e = w.copy()
    e[np.arange(len(lay.targets)), [lay.label(j) for j in range(len(lay.targets))]] -= 1
    return np.einsum("ji,ik,jk->j", e, s, e)


# --- the pass over the objects ------------------------------------------------------------------------------------------------
def object_vectors(df: DataFrame, obj: str, lay: Layout, sigma: dict[str, float], covariate: str, *keep: str) -> DataFrame:
    """(obj, keep..., x): one vector per object that has every prediction, label and the covariate; from rows
    (obj, family, target, y, pred)."""
    def cell(value: str, target: str, member: str | None = None):
        hit = F.col("target") == target if member is None else (F.col("target") == target) & (F.col("family") == member)
        return (F.max(F.when(hit, F.col(value))) / sigma[target])

    named = {f"p_{j}_{i}": cell("pred", t, m) for j, t in enumerate(lay.targets) for i, m in enumerate(lay.members)}
    labels = {f"y_{j}": cell("y", t) for j, t in enumerate(lay.targets)}
    wide = df.groupBy(obj, *keep).agg(F.max(F.col(covariate).cast("double")).alias("_z"), *[c.alias(k) for k, c in {**named, **labels}.items()])
    return _assembled(wide, obj, lay, *keep)


def run_vectors(wide: DataFrame, obj: str, lay: Layout, sigma: dict[str, float], covariate: str, runs: Sequence[tuple[str, int]], *keep: str, digits: int = 6) -> DataFrame:
    """As `object_vectors`, from the rows of prediction files (obj, family, seed, y_<target>, pred_<target>) in one aggregate, so that the rows
    of an object that lie in one partition are one before the shuffle. An object needs every (family, seed) of `runs`; a member's
    prediction is the mean over its runs, rounded."""
    run = F.lit(0)
    for i, (family, seed) in enumerate(runs):
        run = F.when((F.col("family") == family) & (F.col("seed") == seed), 1 << i).otherwise(run)
    named = {f"p_{j}_{i}": F.round(F.avg(F.when(F.col("family") == m, F.col(f"pred_{t}"))), digits) / sigma[t] for j, t in enumerate(lay.targets) for i, m in enumerate(lay.members)}
    labels = {f"y_{j}": F.max(f"y_{t}") / sigma[t] for j, t in enumerate(lay.targets)}
    rows = wide.groupBy(obj, *keep).agg(F.bit_or(run).alias("_runs"), F.max(F.col(covariate).cast("double")).alias("_z"), *[c.alias(k) for k, c in {**named, **labels}.items()])
    return _assembled(rows.where(F.col("_runs") == (1 << len(runs)) - 1), obj, lay, *keep)


def _assembled(wide: DataFrame, obj: str, lay: Layout, *keep: str) -> DataFrame:
    """(obj, keep..., x) from columns p_<target>_<member>, y_<target> and _z, where none is null."""
    named = [f"p_{j}_{i}" for j in range(len(lay.targets)) for i in range(len(lay.members))]
    labels = [f"y_{j}" for j in range(len(lay.targets))]
    spread = []
    for j in range(len(lay.targets)):
        own = [F.col(f"p_{j}_{i}") for i in range(len(lay.members))]
        mean = sum(own[1:], own[0]) / len(own)
        squares = [(p - mean) * (p - mean) for p in own]
        spread.append(F.sqrt(sum(squares[1:], squares[0]) / len(own)))
    x = F.array(F.lit(1.0), *[F.col(k) for k in named], *spread, F.col("_z"), *[F.col(k) for k in labels])
    return wide.where(" AND ".join(f"{k} IS NOT NULL" for k in [*named, *labels, "_z"])).select(obj, *keep, x.alias("x"))


def fold_cells(vectors: DataFrame, obj: str, outer: int, inner: int, repetitions: int, seed: int) -> DataFrame:
    """Adds `cells`: per repetition outer fold x `inner` + inner fold, both of equal size. One fold needs no order."""
    if outer * inner == 1:
        return vectors.withColumn("cells", F.array_repeat(F.lit(0), repetitions))
    ids = vectors.select(obj, F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))
    ranked = shuffled_rank(ids, obj, ["repetition"], seed, F.col("repetition"))
    cell = ((F.col("rank0") % outer) * inner + F.floor(F.col("rank0") / outer) % inner).cast("int")
    cells = ranked.groupBy(obj).agg(F.array_sort(F.collect_list(F.struct("repetition", cell.alias("cell")))).alias("c")).select(obj, F.col("c.cell").alias("cells"))
    return vectors.join(cells, obj)


def moment_cells(vectors: DataFrame, lay: Layout) -> dict[tuple[int, int], np.ndarray]:
    """Moment matrices by (repetition, cell)."""
    size = lay.size

    def add_up(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, size)
            cells = np.asarray(b.column(1).flatten(), np.int64).reshape(b.num_rows, -1)
            for rep in range(cells.shape[1]):
                for cell in np.unique(cells[:, rep]).tolist():
                    own = x[cells[:, rep] == cell]
                    key = (rep, cell)
                    sums[key] = sums[key] + own.T @ own if key in sums else own.T @ own
        for (rep, cell), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int32()), pa.array([cell], pa.int32()), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], names=["rep", "cell", "s"])

    parts = vectors.select("x", "cells").mapInArrow(add_up, "rep int, cell int, s array<double>")
    added = parts.select("rep", "cell", F.posexplode("s").alias("k", "v")).groupBy("rep", "cell", "k").agg(F.sum("v").alias("v"))
    rows = added.groupBy("rep", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]).alias("s")).collect()
    return {(r.rep, r.cell): np.array(r.s).reshape(size, size) for r in rows}


@dataclass
class Moments:
    """Moment matrices of nested folds of equal size, and what search and validation make of them."""

    cells: dict[tuple[int, int], np.ndarray]
    layout: Layout
    outer: int
    inner: int

    @classmethod
    def of(cls, vectors: DataFrame, obj: str, lay: Layout, outer: int, inner: int = 1, repetitions: int = 1, seed: int = 0) -> "Moments":
        read_again = outer * inner > 1  # the folds are ranked on the rows before they are added to them
        return cls(moment_cells(fold_cells(cut_lineage(vectors) if read_again else vectors, obj, outer, inner, repetitions, seed), lay), lay, outer, inner)

    @classmethod
    def by_value(cls, vectors: DataFrame, lay: Layout, column: str, values: Sequence[str]) -> "Moments":
        """A cell per value of a column, in the order of `values`, instead of folds; rows with another value are left out."""
        cell = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)).cast("int") - 1
        return cls(moment_cells(vectors.withColumn("cells", F.array(cell)).where("cells[0] >= 0"), lay), lay, len(values), 1)

    @property
    def repetitions(self) -> list[int]:
        return sorted({r for r, _ in self.cells})

    def sum(self, keep: Callable[[int, int, int], bool]) -> np.ndarray:
        return sum((s for (r, c), s in self.cells.items() if keep(r, c // self.inner, c % self.inner)), np.zeros((self.layout.size,) * 2))

    def out_of_fold(self, c: Candidate, rep: int = 0) -> float:
        """The criterion of predictions of each fold by the fit to all others."""
        total = self.sum(lambda r, o, i: r == rep)
        error = np.zeros(len(self.layout.targets))
        for f in range(self.outer):
            own = self.sum(lambda r, o, i: r == rep and o == f)
            error += squared_error(fitted(c, total - own, self.layout), own, self.layout)
        return float(error.mean() / total[0, 0])

    def search(self, candidates: Sequence[Candidate], rep: int = 0) -> list[dict]:
        """The criterion of every candidate."""
        return [{"candidate": k, "criterion": self.out_of_fold(c, rep)} for k, c in enumerate(candidates)]

    def nested(self, candidates: Sequence[Candidate]) -> list[dict]:
        """Per repetition and outer fold the candidate that an inner search over the other folds picks, and its error on
        the fold that the search never saw."""
        out = []
        for rep in self.repetitions:
            for f in range(self.outer):
                rest = self.sum(lambda r, o, i: r == rep and o != f)
                held = self.sum(lambda r, o, i: r == rep and o == f)
                inner = [self.sum(lambda r, o, i, k=k: r == rep and o != f and i == k) for k in range(self.inner)]
                scores = [float(sum(squared_error(fitted(c, rest - s, self.layout), s, self.layout) for s in inner).mean() / rest[0, 0]) for c in candidates]
                best = int(np.argmin(scores))
                error = squared_error(fitted(candidates[best], rest, self.layout), held, self.layout)
                out.append({"repetition": rep, "outer_fold": f, "candidate": best, "inner_criterion": scores[best], "n": int(round(held[0, 0])), "criterion": float(error.mean() / held[0, 0])})
        return out

    def without_member(self, c: Candidate) -> list[dict]:
        """The criterion of a fit to all objects when each member is left out, and what is lost by it."""
        s, lay = self.sum(lambda r, o, i: r == 0), self.layout
        full = float(squared_error(fitted(c, s, lay), s, lay).mean() / s[0, 0])
        out = []
        for k, m in enumerate(lay.members):
            less = Layout(tuple(x for x in lay.members if x != m), lay.targets)
            gone = {lay.predictions(j)[k] for j in range(len(lay.targets))}
            at = [i for i in range(lay.size) if i not in gone]
            sub = s[np.ix_(at, at)]
            value = float(squared_error(fitted(c, sub, less), sub, less).mean() / s[0, 0])
            out.append({"removed": m, "criterion": value, "lost": value - full})
        return out


def nested_summary(rows: Sequence[dict]) -> list[dict]:
    """The criterion of each repetition's out-of-fold predictions, then their mean and sample deviation."""
    reps = sorted({r["repetition"] for r in rows})
    values = [sum(r["criterion"] * r["n"] for r in rows if r["repetition"] == k) / sum(r["n"] for r in rows if r["repetition"] == k) for k in reps]
    std = float(np.std(values, ddof=1)) if len(values) > 1 else None
    return [{"repetition": k, "criterion": v, "mean": float(np.mean(values)), "std": std} for k, v in zip(reps, values)]


def errors_by_value(m: Moments, w: np.ndarray, sigma: dict[str, float], values: Sequence[str]) -> list[tuple[str, str, int, float]]:
    """(value, target, n, rmse) of the predictions of a fit's weights on the rows of each value, in the targets' own units."""
    out = []
    for (_, cell), s in sorted(m.cells.items()):
        n = float(s[0, 0])
        mse = np.maximum(squared_error(w, s, m.layout), 0) / n
        out += [(values[cell], t, int(round(n)), float(np.sqrt(mse[j]) * sigma[t])) for j, t in enumerate(m.layout.targets)]
    return out


# --- predictions, and the family that is fitted on rows --------------------------------------------------------------------------
def predicted(vectors: DataFrame, w: np.ndarray, lay: Layout, sigma: dict[str, float], *keep: str) -> DataFrame:
    """(keep..., target, y, pred) in the target's own units, from a fit's weights."""
    def dot(row: np.ndarray):
        terms = [F.col("x")[i] * float(v) for i, v in enumerate(row) if v]
        return sum(terms[1:], terms[0])

    cells = F.array(*[F.struct(F.lit(t).alias("target"), (F.col("x")[lay.label(j)] * sigma[t]).alias("y"), (dot(w[j]) * sigma[t]).alias("pred")) for j, t in enumerate(lay.targets)])
    return vectors.select(*keep, F.explode(cells).alias("s")).select(*keep, "s.*")


def tree_predictions(vectors: DataFrame, fit_rows: str, c: Candidate, lay: Layout, sigma: dict[str, float], *keep: str) -> DataFrame:
    """(keep..., target, y, pred): the uniform mean of all rows, corrected per target by boosted trees fitted to `fit_rows`."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    out, d = None, cut_lineage(vectors)
    for j, t in enumerate(lay.targets):
        own = [F.col("x")[i] for i in lay.predictions(j)]
        base, y = sum(own[1:], own[0]) / len(own), F.col("x")[lay.label(j)]
        rows = d.select("*", base.alias("_base"), (y - base).alias("_rest"), array_to_vector(F.array(*[F.col("x")[i] for i in lay.inputs(c, j)])).alias("_in"))
        model = GBTRegressor(featuresCol="_in", labelCol="_rest", maxDepth=c.depth, stepSize=c.rate, maxIter=c.iterations, minInstancesPerNode=30, seed=0).fit(rows.where(fit_rows))
        part = model.transform(rows).select(*keep, F.lit(t).alias("target"), (F.col("x")[lay.label(j)] * sigma[t]).alias("y"), ((F.col("_base") + F.col("prediction")) * sigma[t]).alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def tree_search(vectors: DataFrame, obj: str, candidates: Sequence[Candidate], lay: Layout, sigma: dict[str, float], k: int, seed: int = 0) -> list[dict]:
    """E07/E08 for boosted trees: the same folds and criterion, a fit of each target to the rows outside each fold."""
    d = cut_lineage(fold_cells(vectors, obj, k, 1, 1, seed).withColumn("_fold", F.col("cells")[0]))
    scale = F.element_at(F.create_map(*[F.lit(x) for t in lay.targets for x in (t, float(sigma[t]))]), F.col("target"))
    e, out = (F.col("pred") - F.col("y")) / scale, []
    for number, c in enumerate(candidates):
        parts = [tree_predictions(d, f"_fold <> {f}", c, lay, sigma, "_fold").where(f"_fold = {f}").agg(F.sum(e * e).alias("e"), F.count("*").alias("n")).first() for f in range(k)]
        out.append({"candidate": number, "criterion": sum(p.e for p in parts) / sum(p.n for p in parts)})
    return out
