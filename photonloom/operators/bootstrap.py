"""Bootstrap without resampled rows.

An object has a Poisson(1) number of copies in each replicate, a function of its id and the replicate's number: two words of one
digest per object, w0 + replicate * w1 mixed to 32 bits. A task turns each Arrow batch into a matrix of copies (rows x replicates) and
multiplies it with the columns, so what leaves a task is one row per (group, replicate), whatever it has read, and
no row is ever repeated. All models and targets of an object share its draws (paired resampling).

The median and the MAD of each replicate are found exactly in the same way: of the rows below a bracket around the sample's
own median, and of the rows whose deviation is below a bracket around its MAD, only the weights are needed, which are such
products; the rows inside the brackets, in the order of the square root of a group, are ordered per replicate in a few tasks, each for a
share of the replicates, values that many rows share as one. Columns of one row share its copies, which are made once. The
brackets come from mergeable quantile sketches, and are widened until every replicate's rank falls inside.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.functions.draws import POISSON_CDF, hash32, key_text
from photonloom.session import cut_lineage, kept_rows, small

#: Fixed value: odd multiplier of the mixing step.
MIX = 73244475
EDGES = np.array([int(np.ceil(e * 4294967296.0)) for e in POISSON_CDF], np.uint32)
#: Rows times replicates that a task holds at once.
MATRIX_CELLS = 2_000_000
#: The same for copies that are counted and dropped: they stay in a core's cache.
CACHE_CELLS = 250_000
#: Rows of one value within a bracket that a task sends singly; more are sent as one row with their weight in every replicate.
HOT_VALUE = 100
#: Rows within brackets that a task gathers before it sends them.
GATHERED = 250_000
#: Tasks that order a bracket's rows, each for its share of the replicates.
SHARES = 8


def copies(w0: np.ndarray, w1: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """(rows, replicates): how often a replicate holds a row, as bytes."""
    x = w1.astype(np.uint32)[:, None] * replicates.astype(np.uint32)[None, :]
    x += w0.astype(np.uint32)[:, None]
    y = x >> 16
    x ^= y
    x *= np.uint32(MIX)
    np.right_shift(x, 16, out=y)
    x ^= y
    n, hit, most = np.zeros(x.shape, np.uint8), np.empty(x.shape, bool), x.max(initial=0)
    for e in EDGES[EDGES <= most]:
        np.greater_equal(x, e, out=hit)
        n += hit.view(np.uint8)
    return n


def with_words(df: DataFrame, obj: str, seed: int) -> DataFrame:
    text = key_text(F.col(obj), seed)
    return df.withColumn("_w0", hash32(text, 0)).withColumn("_w1", hash32(text, 1))


def _groups(columns: list[pa.Array]) -> tuple[list[tuple], np.ndarray]:
    """Distinct key tuples of a batch and each row's number among them."""
    n, code = len(columns[0]) if columns else 0, None
    for c in columns:
        d = c.dictionary_encode()
        own = np.asarray(d.indices.fill_null(-1)) + 1
        code = own if code is None else code * (len(d.dictionary) + 1) + own
    found, first, number = np.unique(code if code is not None else np.zeros(n, np.int64), return_index=True, return_inverse=True)
    return [tuple(c[int(i)].as_py() for c in columns) for i in first], number


def replicate_sums(df: DataFrame, obj: str, keys: Sequence[str], columns: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """(keys, rep, n, and per column its weighted sum and n_column, the weight of its values that are not null)."""
    keys, columns = list(keys), list(columns)
    rows = with_words(df.select(obj, *[F.col(k) for k in keys], *[F.col(c).cast("double").alias(c) for c in columns]), obj, seed)
    rows = rows.select(*keys, "_w0", "_w1", *columns)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([*[(k, to_arrow_type(df.schema[k].dataType)) for k in keys], ("rep", pa.int32()), ("n", pa.float64()), *[(n, pa.float64()) for c in columns for n in (c, f"n_{c}")]])
    reps, width = np.arange(n_boot), 1 + 2 * len(columns)

    def add_up(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            names, number = _groups([b.column(i) for i in range(len(keys))]) if keys else ([()], np.zeros(b.num_rows, np.int64))
            w0, w1 = (np.asarray(b.column(len(keys) + i), np.int64) for i in (0, 1))
            x = np.ones((b.num_rows, width))
            for i in range(len(columns)):
                v = b.column(len(keys) + 2 + i).to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(v)
                x[:, 1 + 2 * i], x[:, 2 + 2 * i] = np.where(known, v, 0.0), known
            for g, name in enumerate(names):
                at = np.flatnonzero(number == g)
                own = sums.setdefault(name, np.zeros((n_boot, width)))
                step = max(1, CACHE_CELLS // n_boot)
                for i in range(0, len(at), step):
                    part = at[i:i + step]
                    own += copies(w0[part], w1[part], reps).T.astype(float) @ x[part]
        for name, own in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * n_boot, schema.field(i).type) for i, v in enumerate(name)], pa.array(reps, pa.int32()), *[pa.array(own[:, i]) for i in range(width)]], schema=schema)

    types = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], "rep int", "n double", *[f"`{n}` double" for c in columns for n in (c, f"n_{c}")]])
    return rows.mapInArrow(add_up, types).groupBy(*keys, "rep").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for c in columns for n in (c, f"n_{c}")])


def replicate_means(df: DataFrame, obj: str, keys: Sequence[str], columns: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """(keys, rep, column...): weighted mean of each column in each replicate."""
    s = replicate_sums(df, obj, keys, columns, n_boot, seed)
    return s.select(*keys, "rep", *[(F.col(c) / F.nullif(F.col(f"n_{c}"), F.lit(0.0))).alias(c) for c in columns])


def _left(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _same(a, b, keys, "left")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; b's keys go."""
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(b, on, how).drop(*[f"_k_{k}" for k in keys])


def _brackets(rows: DataFrame, keys: Sequence[str], value: Column, width: float) -> DataFrame:
    """(keys, lo, hi) of one column."""
    return _all_brackets(rows, keys, [value], width).withColumnsRenamed({"lo0": "lo", "hi0": "hi"})


def _all_brackets(rows: DataFrame, keys: Sequence[str], values: Sequence[Column], width: float) -> DataFrame:
    """(keys, lo0, hi0, lo1...): sample quantiles around the median of each column, `width` standard errors of its rank to either side, by
    the group's size rounded down to a power of two."""
    size = [F.floor(F.log2(F.count(v))).cast("int").alias(f"_p{i}") for i, v in enumerate(values)]
    sizes = rows.groupBy(*keys).agg(*size)
    found = sizes.select(F.explode(F.array(*[f"_p{i}" for i in range(len(values))])).alias("_p")).where("_p IS NOT NULL").distinct()
    powers = sorted(r[0] for r in found.collect())
    probs = [max(0.0, min(1.0, 0.5 + s * width / (2 * 2 ** (p / 2)))) for p in powers for s in (-1, 1)]
    q = rows.groupBy(*keys).agg(*[F.percentile_approx(v, probs or [0.5], 100_000).alias(f"_q{i}") for i, v in enumerate(values)], *size)
    at = F.create_map(*[F.lit(x) for i, p in enumerate(powers or [0]) for x in (p, i)])
    of = lambda i, side: F.get(f"_q{i}", 2 * F.element_at(at, F.col(f"_p{i}")) + side)
    return q.select(*keys, *[of(i, side).alias(f"{n}{i}") for i in range(len(values)) for side, n in ((0, "lo"), (1, "hi"))])


def replicate_nmad(df: DataFrame, obj: str, keys: Sequence[str], value: str, n_boot: int, seed: int, width: float = 8.0) -> DataFrame:
    """(keys, rep, med, nmad): median and 1.4826 MAD of each replicate's rows, exactly."""
    return replicate_nmads(df, obj, keys, [value], n_boot, seed, width).drop("column")


def replicate_nmads(df: DataFrame, obj: str, keys: Sequence[str], columns: Sequence[str], n_boot: int, seed: int, width: float = 8.0) -> DataFrame:
    """(keys, column, rep, med, nmad) of several columns. The columns of a row share its draws, which are made once for all of them. The
    driver reads a row of brackets per group."""
    keys, columns = list(keys), list(columns)
    values = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    base = kept_rows(with_words(df.select(obj, *keys, *values), obj, seed).select(*keys, "_w0", "_w1", *[f"v{i}" for i in range(len(columns))]))
    while True:
        out = cut_lineage(_nmads_within(base, keys, len(columns), n_boot, width))
        if not out.where("NOT inside").limit(1).count():
            name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("column"))
            return out.withColumn("column", name).drop("inside")
        width *= 4


def _sum_vectors(schema: pa.Schema):
    """The rows of a group as one, lists added up by place."""
    def add(rows: pa.Table) -> pa.Table:
        out = []
        for f in schema:
            c = rows.column(f.name)
            if not pa.types.is_list(f.type):
                out.append(c.slice(0, 1).combine_chunks())
            elif c.null_count:
                out.append(pa.nulls(1, f.type))
            else:
                out.append(pa.array([np.asarray(c.combine_chunks().flatten()).reshape(len(c), -1).sum(0)], f.type))
        return pa.Table.from_arrays(out, schema=schema)

    return add


def _nmads_within(base: DataFrame, keys: list[str], width_of: int, n_boot: int, width: float) -> DataFrame:
    """(keys, column number, rep, med, nmad, inside): inside tells whether the brackets of this width hold the replicate's ranks."""
    from pyspark.sql.pandas.types import to_arrow_type

    numbers = range(width_of)
    b = small(_all_brackets(base, keys, [F.col(f"v{i}") for i in numbers], width))
    near = _same(base, b, keys)
    e = _all_brackets(near, keys, [F.abs(F.col(f"v{i}") - (F.col(f"lo{i}") + F.col(f"hi{i}")) / 2) for i in numbers], width)
    e = e.withColumnsRenamed({f"{n}{i}": f"d{n}{i}" for n in ("lo", "hi") for i in numbers})
    edges: dict[tuple, list] = {}
    for r in _same(b, e, keys).collect():
        own = edges[tuple(r[k] for k in keys)] = []
        for i in numbers:
            lo, hi, dlo, dhi = (r[f"{n}{i}"] for n in ("lo", "hi", "dlo", "dhi"))
            # A replicate's median lies in [lo, hi], so its deviations differ from those about mid by at most half the bracket. Rows
            # that are sure deviate by less than `least`, rows left out by more than `most`.
            own.append(None if lo is None else (lo, hi, (lo + hi) / 2, (hi - lo) / 2, dlo - (hi - lo) / 2, (dhi + (hi - lo) / 2) * (1 + 1e-9)))

    def marks(v, edge):
        """Whether a value is below the median's bracket, surely nearer than the MAD's, inside either."""
        lo, hi, mid, half, least, most = edge
        dev = np.abs(v - mid)
        sure = dev + half < least
        return v < lo, sure, (v >= lo) & (v <= hi), ~sure & (dev - half <= most)

    kinds = [(k, to_arrow_type(base.schema[k].dataType)) for k in keys]
    named = [f"`{k}` {base.schema[k].dataType.simpleString()}" for k in keys]
    vector = pa.list_(pa.float64())
    schema = pa.schema([*kinds, ("column", pa.int32()), ("v", pa.float64()), ("w0", pa.int64()), ("w1", pa.int64()), ("w", vector), ("low", vector), ("sure", vector)])
    reps, step = np.arange(n_boot), max(1, CACHE_CELLS // n_boot)

    def weights(w0, w1):
        return sum((copies(w0[i:i + step], w1[i:i + step], reps).sum(0, dtype=np.int64) for i in range(0, len(w0), step)), np.zeros(n_boot, np.int64))

    def rows_of(name, i, n, **given):
        return pa.RecordBatch.from_arrays([*[pa.array([v] * n, t) for v, (_, t) in zip(name, kinds)], pa.array(np.full(n, i), pa.int32()),
                                           *[pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in list(schema)[len(keys) + 1:]]], schema=schema)

    def gathered(held):
        """What a task has gathered within the brackets: values of many rows with their weights, the others singly."""
        for (name, i), parts in held.items():
            v, w0, w1 = (np.concatenate(x) for x in zip(*parts))
            value, number, count = np.unique(v, return_inverse=True, return_counts=True)
            single = count[number] <= HOT_VALUE
            if single.any():
                yield rows_of(name, i, int(single.sum()), v=v[single], w0=w0[single], w1=w1[single])
            for j in np.flatnonzero(count > HOT_VALUE):
                at = number == j
                yield rows_of(name, i, 1, v=[value[j]], w=[weights(w0[at], w1[at])])

    def count(batches):
        sums: dict[tuple, np.ndarray] = {}
        held, n_held = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names, number = _groups([batch.column(i) for i in range(len(keys))]) if keys else ([()], np.zeros(batch.num_rows, np.int64))
            w0, w1 = (np.asarray(batch.column(len(keys) + i), np.int64) for i in (0, 1))
            columns = [batch.column(len(keys) + 2 + i) for i in numbers]
            known = [np.asarray(c.is_valid()) for c in columns]
            columns = [c.to_numpy(zero_copy_only=False) for c in columns]
            for g, name in enumerate(names):
                at = np.flatnonzero(number == g)
                x = np.zeros((len(at), 3 * width_of), np.float32)
                for i in numbers:
                    if edges[name][i] is None:
                        continue
                    v, is_known = columns[i][at], known[i][at]
                    low, sure, mid, far = marks(v, edges[name][i])
                    x[:, 3 * i], x[:, 3 * i + 1], x[:, 3 * i + 2] = is_known, low & is_known, sure & is_known
                    inside = np.flatnonzero(is_known & (mid | far))
                    if len(inside):
                        held.setdefault((name, i), []).append((v[inside], w0[at[inside]], w1[at[inside]]))
                        n_held += len(inside)
                own = sums.setdefault(name, np.zeros((n_boot, 3 * width_of)))
                for i in range(0, len(at), step):  # sums of a step are whole numbers below 2^24
                    own += copies(w0[at[i:i + step]], w1[at[i:i + step]], reps).T.astype(np.float32) @ x[i:i + step]
            if n_held > GATHERED:
                yield from gathered(held)
                held, n_held = {}, 0
        yield from gathered(held)
        for name, own in sums.items():
            for i in numbers:
                if edges[name][i] is not None:
                    yield rows_of(name, i, 1, w=[own[:, 3 * i]], low=[own[:, 3 * i + 1]], sure=[own[:, 3 * i + 2]])

    lists = "w array<double>, low array<double>, sure array<double>"
    found = cut_lineage(base.mapInArrow(count, ", ".join([*named, "`column` int, v double, w0 bigint, w1 bigint", lists])))
    group = [*keys, "column"]
    whole = found.where("w IS NOT NULL").select(*group, "v", "w", "low", "sure")
    summed = pa.schema([*kinds, ("column", pa.int32()), ("v", pa.float64()), ("w", vector), ("low", vector), ("sure", vector)])
    whole = whole.groupBy(*group, "v").applyInArrow(_sum_vectors(summed), ", ".join([*named, "`column` int, v double", lists]))
    whole = whole.groupBy(*group).agg(F.collect_list(F.struct("v", "w", "low", "sure")).alias("h"))
    single = found.where("w0 IS NOT NULL").groupBy(*group).agg(F.collect_list(F.struct("v", "w0", "w1")).alias("m"))
    both = _left(whole, single, group).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    both = both.select(*group, "share", "m", "h").repartition(*group, "share")
    result = pa.schema([*kinds, ("column", pa.int32()), ("rep", pa.int32()), ("med", pa.float64()), ("nmad", pa.float64()), ("inside", pa.bool_())])

    def at_rank(upto, values, n, below):
        """Mean of the two middle values of n, from running weights of sorted values; whether both are here; and the two."""
        inside, two = n > 0, []
        for side in (np.floor((n - 1) / 2), np.ceil((n - 1) / 2)):
            place = int(np.searchsorted(upto, side - below, side="right"))
            inside = inside and side >= below and place < len(values)
            two.append(values[min(place, len(values) - 1)])
        return (two[0] + two[1]) / 2, inside, two

    def select(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                row = {name: batch.column(i)[j] for i, name in enumerate(batch.schema.names)}
                name, share = tuple(row[k].as_py() for k in keys), row["share"].as_py()
                edge, chosen = edges[name][row["column"].as_py()], reps[share * n_boot // SHARES:(share + 1) * n_boot // SHARES]
                h, m = row["h"].as_py(), row["m"].values
                n, low, sure = next([np.asarray(x[k], float)[chosen] for k in ("w", "low", "sure")] for x in h if x["v"] is None)
                h = [x for x in h if x["v"] is not None]
                v, w0, w1 = (np.zeros(0, t) if m is None else m.field(k).to_numpy(zero_copy_only=False) for k, t in (("v", float), ("w0", np.int64), ("w1", np.int64)))
                value = np.concatenate([v, [x["v"] for x in h]])
                shared = np.array([np.asarray(x["w"], float)[chosen] for x in h]).reshape(len(h), len(chosen))
                order = np.argsort(value, kind="stable")
                value = value[order]
                _, _, mid, far = marks(value, edge)
                med, nmad, inside = np.zeros(len(chosen)), np.zeros(len(chosen)), np.zeros(len(chosen), bool)
                some = max(1, MATRIX_CELLS // max(1, len(value)))
                for r in range(0, len(chosen), some) if mid.any() and far.any() else ():
                    c = np.concatenate([copies(w0, w1, chosen[r:r + some]), shared[:, r:r + some]])[order].T
                    upto, outer, ok = np.cumsum(c[:, mid], 1), np.ascontiguousarray(c[:, far]), np.zeros(len(c), bool)
                    for k in range(len(c)):
                        med[r + k], ok[k], _ = at_rank(upto[k], value[mid], n[r + k], low[r + k])
                    # Replicates of one median share the order of the deviations.
                    for centre in np.unique(med[r:r + some]):
                        dv = np.abs(value[far] - centre)
                        rank = np.argsort(dv, kind="stable")
                        dv = dv[rank]
                        for k in np.flatnonzero(med[r:r + some] == centre):
                            mad, ok2, two = at_rank(np.cumsum(outer[k][rank]), dv, n[r + k], sure[r + k])
                            nmad[r + k], inside[r + k] = 1.4826 * mad, ok[k] and ok2 and two[0] >= edge[4] and two[1] <= edge[5]
                none = n == 0
                yield pa.RecordBatch.from_arrays([*[pa.array([x] * len(chosen), t) for x, (_, t) in zip(name, kinds)], pa.array(np.full(len(chosen), row["column"].as_py()), pa.int32()),
                                                  pa.array(chosen, pa.int32()), pa.array(med, mask=none), pa.array(nmad, mask=none), pa.array(inside | none)], schema=result)

    return both.mapInArrow(select, ", ".join([*named, "`column` int, rep int, med double, nmad double, inside boolean"]))
