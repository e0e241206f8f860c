"""Scalers and regression on feature tables (M01-M10). Fits are single aggregates; transforms are column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StandardScaler:
    """(x - mean) / population std per column, fitted on the rows given to `fit`."""

    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> "StandardScaler":
        row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
        return cls({c: row[f"m_{c}"] for c in columns}, {c: row[f"s_{c}"] for c in columns})

    def forward(self, c: str) -> Column:
        return (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c])

    def inverse(self, z: Column, c: str) -> Column:
        return z * F.lit(self.std[c]) + F.lit(self.mean[c])

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": self.forward(c) for c in self.mean})


# --- M01 skew-driven transform --------------------------------------------------------------------------------------------
LAMBDA_MAX = 3.0


@dataclass(frozen=True)
class SkewTransform:
    """Per column none, log10, Box-Cox or Yeo-Johnson, chosen by the skewness of the train rows."""

    method: dict[str, str]
    lam: dict[str, float]
    report: list[dict] = field(default_factory=list)

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str], threshold: float = 1.0, lambda_max: float = LAMBDA_MAX) -> "SkewTransform":
        from photonloom.functions.scalars import box_cox, clipped_log10, finite, yeo_johnson

        cells = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("v")) for c in columns])
        long = train.select(F.explode(cells).alias("s")).select("s.column", "s.v").where("v IS NOT NULL")
        base = {r["column"]: r for r in long.groupBy("column").agg(
            F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        # An indicator has at most two values: nothing lies strictly between the extremes.
        ends = {c: (r["lo"], r["hi"]) for c, r in base.items()}
        between = F.lit(False)
        for c, (lo, hi) in ends.items():
            between = between | ((F.col("column") == c) & (F.col("v") > lo) & (F.col("v") < hi))
        varied = {r[0] for r in long.where(between).groupBy("column").agg(F.count("*")).collect()}
        todo = [c for c in columns if c in base and c in varied and abs(base[c]["skew"]) > threshold]
        positive = [c for c in todo if base[c]["lo"] > 0]
        lam = cls._maximum_likelihood(long, todo, set(positive), lambda_max) if todo else {}
        after = {}
        if todo:
            of = lambda f, cs: F.skewness(F.when(F.col("column").isin(list(cs)), f))
            lam_col = F.element_at(F.create_map(*[F.lit(x) for c in todo for x in (c, lam[c])]), F.col("column"))
            power = F.when(F.col("column").isin(positive), box_cox("v", F.col("lam"))).otherwise(yeo_johnson("v", F.col("lam")))
            rows = (long.where(F.col("column").isin(todo)).withColumn("lam", lam_col).groupBy("column")
                    .agg(of(clipped_log10("v"), positive).alias("log"), F.skewness(power).alias("power")).collect())
            after = {r["column"]: r for r in rows}
        method, kept, report = {}, {}, []
        for c in columns:
            m, l, s = "none", None, base[c]["skew"] if c in base else None
            if c in todo:
                a = after[c]
                if c in positive and abs(a["log"]) <= abs(a["power"]):
                    m, s = "log10", a["log"]
                else:
                    m, l, s = ("box-cox" if c in positive else "yeo-johnson"), lam[c], a["power"]
            method[c] = m
            if l is not None:
                kept[c] = l
            report.append({"column": c, "skew_before": base[c]["skew"] if c in base else None, "kurtosis_before": base[c]["kurt"] if c in base else None,
                           "method": m, "lam": l, "lam_limited": l is not None and abs(l) >= lambda_max, "skew_after": s})
        return cls(method, kept, report)

    @staticmethod
    def _maximum_likelihood(long: DataFrame, columns: Sequence[str], positive: set[str], limit: float) -> dict[str, float]:
        """Profile likelihood on a grid of lambdas, refined around each column's best: three passes, a few hundred sums each."""
        from photonloom.functions.scalars import box_cox, yeo_johnson

        d = long.where(F.col("column").isin(list(columns)))
        centre, step, width = {c: 0.0 for c in columns}, 0.25, int(limit / 0.25)
        for _ in range(3):
            grids = F.create_map(*[x for c in columns for x in (
                F.lit(c), F.array(*[F.lit(float(max(-limit, min(limit, centre[c] + step * k)))) for k in range(-width, width + 1)]))])
            g = d.withColumn("lam", F.explode(F.array_distinct(F.element_at(grids, F.col("column")))))
            is_pos = F.col("column").isin(list(positive))
            x = F.when(is_pos, box_cox("v", F.col("lam"))).otherwise(yeo_johnson("v", F.col("lam")))
            jac = F.when(is_pos, F.ln(F.greatest("v", F.lit(1e-12)))).otherwise(F.signum("v") * F.log1p(F.abs("v")))
            ll = (g.groupBy("column", "lam").agg((-F.count("*") / 2 * F.ln(F.var_pop(x)) + (F.col("lam") - 1) * F.sum(jac)).alias("ll"))
                  .groupBy("column").agg(F.max_by("lam", "ll").alias("lam")))
            centre = {r["column"]: r["lam"] for r in ll.collect()}
            width, step = 5, step / 5
        return centre

    def transform(self, df: DataFrame) -> DataFrame:
        from photonloom.functions.scalars import box_cox, clipped_log10, finite, yeo_johnson

        out = {}
        for c, m in self.method.items():
            v = finite(c)
            out[c] = finite({"none": lambda: v, "log10": lambda: clipped_log10(v), "box-cox": lambda: box_cox(v, self.lam[c]),
                             "yeo-johnson": lambda: yeo_johnson(v, self.lam[c])}[m]())
        return df.withColumns({c: F.when(finite(c).isNotNull(), e) for c, e in out.items()})


# --- linear models on Spark ML ----------------------------------------------------------------------------------------------
def ridge(train: DataFrame, features: str, label: str, alpha: float):
    """Spark ML rescales the penalty by the spread of the label, hence the factor; the normal solver is one aggregation of
    the moments."""
    from pyspark.ml.regression import LinearRegression

    n, spread = train.agg(F.count("*"), F.stddev_pop(label)).first()
    return LinearRegression(featuresCol=features, labelCol=label, solver="normal", elasticNetParam=0.0, standardization=False,
                            regParam=alpha / n * spread).fit(train)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


class VectorScores:
    """Standardize a vector, project on principal components, standardize the scores, append a standardized scalar; population
    deviations throughout. Rows whose vector or scalar is missing, of another length or not finite do not enter the fit and
    get no scores. Components are those of greatest variance; their largest loading is positive. A dimension without
    spread is centred only, and a component without variance scores zero."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, train: DataFrame, column: str, width: int, scalar: str | None = None) -> "VectorScores":
        """One pass over the rows; only the moments, whose size is set by `width`, reach the driver."""
        if not 0 < self.k <= width:
            raise ValueError(f"{self.k} components of {width} dimensions")
        self.column, self.scalar, self.width = column, scalar, width
        extra = width + (scalar is not None)
        n, mean, comoment = vector_moments(train, [column] + ([scalar] if scalar else []), extra)
        if n == 0:
            raise ValueError("no complete row to fit on")
        spread = np.sqrt(np.diag(comoment) / n)
        scale = np.where(spread > 1e-12 * np.maximum(1.0, np.abs(mean)), spread, np.inf)
        correlation = comoment[:width, :width] / n / np.outer(scale[:width], scale[:width])
        values, axes = np.linalg.eigh(correlation)
        values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
        self.n, self.mean, self.std = n, mean, np.where(np.isfinite(scale), scale, 1.0)
        self.components, self.variance = axes[:, :self.k], values[:self.k]
        self.explained = self.variance / values.sum() if values.sum() > 0 else self.variance
        return self

    def transform(self, df: DataFrame, out: str = "scores") -> DataFrame:
        """An array of k scores, then the scalar; a projection of Arrow batches, without a shuffle."""
        width, dims = self.width, self.width + (self.scalar is not None)
        root = np.sqrt(self.variance)
        turn = self.components / self.std[:width, None] / np.where(root > 1e-9, root, np.inf)
        mean, std = self.mean, self.std

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            rows = [None] * len(x)
            held = np.flatnonzero(x.notna().to_numpy())
            if len(held):
                m = np.stack(x.iloc[held].to_numpy()).astype(float)
                scores = np.hstack([(m[:, :width] - mean[:width]) @ turn, (m[:, width:] - mean[width:]) / std[width:]])
                for i, r in zip(held, scores):
                    rows[i] = r
            return pd.Series(rows, dtype=object)

        return df.withColumn(out, project(complete_vector([self.column] + ([self.scalar] if self.scalar else []), dims)))


def complete_vector(columns: Sequence[str], width: int) -> Column:
    """A vector column and scalar columns behind it as one array of doubles; NULL unless all `width` numbers are there and finite."""
    v = F.concat(F.transform(F.col(columns[0]), lambda x: x.cast("double")), *[F.array(F.col(c).cast("double")) for c in columns[1:]])
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(v) == width) & ~bad, v)


#: Side of the blocks in which moments of pairs travel: 512 KB each.
MOMENT_BLOCK = 256


def vector_moments(df: DataFrame, columns: Sequence[str], width: int, partials: int = 1024) -> tuple[int, "np.ndarray", "np.ndarray"]:
    """Number of complete rows, mean and sums of products of deviations of a vector, exact in one pass.

    A task keeps the moments of its rows, merges each Arrow batch into them as a matrix product and sends the upper triangle in blocks
    with its count and means; a second stage merges blocks as they stream in. At most `partials` tasks send, so what is
    shuffled and what memory is needed depend on `width` alone. Deviations are from each part's own mean: nothing cancels."""
    edges = list(range(0, width, MOMENT_BLOCK)) + [width]
    spans = list(zip(edges[:-1], edges[1:]))
    schema = "i int, j int, n long, mean array<double>, block array<double>"

    def merged(a, b):
        if a is None or b[0] == 0:
            return b if a is None else a
        n = a[0] + b[0]
        d = b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + a[0] * b[0] / n * d[0][:, None] * d[1][None, :]

    def gathered(batches):
        held = {}
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, width))
            if not len(x):
                continue
            mean = x.mean(axis=0)
            dev = x - mean
            for i, (a, b) in enumerate(spans):
                for j, (c, d) in enumerate(spans[i:], i):
                    held[i, j] = merged(held.get((i, j)), (len(x), _Pair(mean[a:b], mean[c:d]), dev[:, a:b].T @ dev[:, c:d]))
        for (i, j), (n, m, block) in held.items():
            yield pd.DataFrame({"i": [i], "j": [j], "n": [n], "mean": [np.concatenate([m[0], m[1]])], "block": [block.ravel()]})

    def reduced(batches):
        held = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                (a, b), (c, d) = spans[r.i], spans[r.j]
                m = np.asarray(r.mean)
                part = (r.n, _Pair(m[:b - a], m[b - a:]), np.asarray(r.block).reshape(b - a, d - c))
                held[r.i, r.j] = merged(held.get((r.i, r.j)), part)
        for (i, j), (n, m, block) in held.items():
            yield pd.DataFrame({"i": [i], "j": [j], "n": [n], "mean": [np.concatenate([m[0], m[1]])], "block": [block.ravel()]})

    rows = df.select(complete_vector(columns, width).alias("v")).where("v IS NOT NULL").coalesce(partials)
    blocks = rows.mapInPandas(gathered, schema).repartition(len(spans) * (len(spans) + 1) // 2, "i", "j").mapInPandas(reduced, schema)
    n, mean, total = 0, np.zeros(width), np.zeros((width, width))
    for r in blocks.toLocalIterator():
        (a, b), (c, d) = spans[r["i"]], spans[r["j"]]
        n, total[a:b, c:d] = r["n"], np.asarray(r["block"]).reshape(b - a, d - c)
        total[c:d, a:b] = total[a:b, c:d].T
        mean[a:b] = r["mean"][:b - a]
    return n, mean, total


class _Pair(tuple):
    """Means of the rows and of the columns of a block, with the arithmetic of a vector."""

    def __new__(cls, rows, columns):
        return super().__new__(cls, (rows, columns))

    def __add__(self, o):
        return _Pair(self[0] + o[0], self[1] + o[1])

    def __sub__(self, o):
        return _Pair(self[0] - o[0], self[1] - o[1])

    def __mul__(self, k):
        return _Pair(self[0] * k, self[1] * k)


def cross_fitted(df: DataFrame, features: str, label: str, obj: str, split: str, k: int, alpha: float, seed: int) -> DataFrame:
    """Out-of-fold estimate for the train rows, full-train model for the rest, with the origin of each estimate."""
    from photonloom.operators.splits import folds

    train = df.where(F.col(split) == "Train")
    part = folds(train.select(obj), obj, k, seed, 1).drop("repetition")
    tagged = train.join(part, obj)
    out = None
    for f in range(k):
        m = ridge(tagged.where(F.col("fold") != f), features, label, alpha)
        p = m.transform(tagged.where(F.col("fold") == f)).select(obj, split, F.col("prediction").alias("estimate"), F.lit("out of fold").alias("origin"))
        out = p if out is None else out.unionByName(p)
    full = ridge(train, features, label, alpha).transform(df.where(F.col(split) != "Train"))
    return out.unionByName(full.select(obj, split, F.col("prediction").alias("estimate"), F.lit("full train model").alias("origin")))
