"""Exact nearest-neighbour join with pruning by the triangle inequality.

A bounded sample of reference rows serves as pivots. Each reference row belongs to the cell of its nearest pivot; a cell with
many rows is cut into blocks by the distance to the pivot, and a block that is still too large, as for many equal rows, by
a hash. What is known of a block is its pivot, number of rows and range of distances: a table of at most MAX_BLOCKS + MAX_PIVOTS rows.

Round one joins each query to one block of its own cell, which bounds the distance of its k-th neighbour; where the block has too
few rows, the ranges of all blocks give a bound. Round two sends the query to those other blocks only that the bound
cannot rule out: by the range of distances to the pivot, and by the plane between the block's pivot and the query's own.
TILE_BLOCKS consecutive blocks are a tile: a query goes once to a tile, with a bit for each block it has to see there. Both rounds cogroup
a slice of queries with one tile, so no task holds more than these, whatever the size of the table, and a query keeps k candidates
per tile. On data with structure a query visits a few blocks; on data without, where all pairs have to be met, a vector moves once per
tile and not once per block. The result is exact on any data.

Rows with a null vector take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.functions.draws import hash32, key_text
from photonloom.operators.cohort import top_n
from photonloom.session import cut_lineage, small

#: Rows of a block.
BLOCK_ROWS = 4_000
#: Blocks of a tile (bits of a number), and of rows of a slice of queries that meets it.
TILE_BLOCKS, SLICE_BLOCKS = 16, 8
#: Rows of queries and tiles that a task sends at once.
VISIT_ROWS = 20_000
MAX_PIVOTS, MAX_BLOCKS = 4_096, 65_536
#: Numbers in a matrix of distances that a task holds at once.
MATRIX_CELLS = 4_000_000
#: Rounding error allowed for in bounds, relative to the numbers compared.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0.0)


def pivots_of(reference: DataFrame, obj: str, vector: str, n: int) -> np.ndarray:
    """n reference vectors in the order of a hash; equal ones count once."""
    rows = reference.orderBy(hash32(key_text(F.col(obj), "pivot")), obj).limit(n).select(F.col(vector).cast("array<double>").alias("v")).collect()
    return np.unique(np.array([r.v for r in rows], float), axis=0) if rows else np.zeros((0, 1))


def _celled(df: DataFrame, obj: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, d): nearest pivot and distance to it."""
    def assign(batches):
        for b in batches:
            v = _matrix(b.column(1))
            cell, d = np.zeros(len(v), np.int32), np.zeros(len(v))
            step = max(1, MATRIX_CELLS // len(pivots))
            for i in range(0, len(v), step):
                cell[i:i + step] = _squares(v[i:i + step], pivots).argmin(1)
                d[i:i + step] = np.sqrt(((v[i:i + step] - pivots[cell[i:i + step]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d)], names=[*b.schema.names, "cell", "d"])

    kind = df.schema[obj].dataType.simpleString()
    rest = [c for c in df.columns if c not in (obj, vector)]
    held = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.where(F.col(vector).isNotNull()).select(F.col(obj).alias("id"), F.col(vector).cast(held).alias("v"), *rest)
    more = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(assign, f"id {kind}, v {held}{more}, cell int, d double")


def blocks_of(cells: DataFrame, block_rows: int) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The rows with their block's number, and the table of blocks: cell, n, lo, hi (distances to the pivot)."""
    span = cells.groupBy("cell").agg(F.count("*").alias("_n"), F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    bins = F.ceil(F.col("_n") / block_rows)
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(bins - 1, F.floor((F.col("d") - F.col("_lo")) / width))).otherwise(F.lit(0)).cast("int")
    binned = cells.join(F.broadcast(span), "cell").withColumn("bin", at).drop("_n", "_lo", "_hi")
    counts = binned.groupBy("cell", "bin").agg(F.count("*").alias("_n"))
    split = binned.join(counts, ["cell", "bin"]).withColumn("part", F.pmod(hash32(key_text(F.col("id"), "part")), F.ceil(F.col("_n") / block_rows)).cast("int")).drop("_n")
    split = cut_lineage(split)
    table = split.groupBy("cell", "bin", "part").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).orderBy("cell", "bin", "part").collect()
    number = cells.sparkSession.createDataFrame([(r["cell"], r["bin"], r["part"], i) for i, r in enumerate(table)], "cell int, bin int, part int, block int")
    known = {c: np.array([r[c] for r in table], float if c in ("lo", "hi") else np.int64) for c in ("cell", "n", "lo", "hi")}
    return split.join(F.broadcast(number), ["cell", "bin", "part"]).drop("cell", "bin", "part", "d"), known


def _visits(queries: DataFrame, pivots: np.ndarray, known: dict[str, np.ndarray], first: bool, k: int) -> DataFrame:
    """The blocks that queries have to see: in round one (id, v, cell, d, block, tile, seen, bound), in round two with the bound of round
    one the others (id, v, tile, seen, bound). `seen` has a bit for each block of the tile."""
    gaps = np.sqrt(_squares(pivots, pivots))
    of, n, lo, hi = (known[c] for c in ("cell", "n", "lo", "hi"))
    tiles = -(-len(of) // TILE_BLOCKS)
    bits = 1 << np.arange(TILE_BLOCKS, dtype=np.int64)

    def look(batches):
        for b in batches:
            v, cell, d = _matrix(b.column(1)), np.asarray(b.column(2), np.int64), np.asarray(b.column(3), float)
            step = max(1, min(MATRIX_CELLS // max(len(of), len(pivots)), len(v) if first else VISIT_ROWS // tiles))
            for i in range(0, len(v), step):
                q, own = v[i:i + step], cell[i:i + step]
                to_pivots = np.sqrt(_squares(q, pivots))
                to_pivots[np.arange(len(q)), own] = d[i:i + step]
                reach = to_pivots[:, of]
                part = b.slice(i, len(q))
                if first:
                    away = np.where(of[None, :] == own[:, None], np.maximum(lo - reach, reach - hi), np.inf)
                    block = away.argmin(1).astype(np.int32)
                    far = reach + hi  # every row of the block is at most that far
                    order = np.argsort(far, axis=1)
                    enough = np.argmax(np.cumsum(n[order], axis=1) > k, axis=1)
                    bound = np.where(n.sum() > k, far[np.arange(len(q)), order[np.arange(len(q)), enough]], np.inf)
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(block), pa.array(block // TILE_BLOCKS), pa.array(bits[block % TILE_BLOCKS]), pa.array(bound)],
                                                     names=["id", "v", "cell", "d", "block", "tile", "seen", "bound"])
                else:
                    bound = np.asarray(part.column(4), float)
                    slack = SLACK * (1 + to_pivots.max())
                    near = (reach >= lo - (bound + slack)[:, None]) & (reach <= hi + (bound + slack)[:, None])
                    # Rows of another cell lie beyond the plane halfway between the two pivots.
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (to_pivots ** 2 - (d[i:i + step] ** 2)[:, None]) / (2 * gaps[own])
                    plane[np.arange(len(q)), own] = 0
                    near &= np.nan_to_num(plane, nan=0.0, posinf=0.0)[:, of] <= (bound + slack)[:, None]
                    near[np.arange(len(q)), np.asarray(part.column(5))] = False
                    seen = np.pad(near, ((0, 0), (0, tiles * TILE_BLOCKS - len(of)))).reshape(len(q), tiles, TILE_BLOCKS) @ bits
                    which, tile = np.nonzero(seen)
                    taken = pa.array(which)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(taken), part.column(1).take(taken), pa.array(tile.astype(np.int32)), pa.array(seen[which, tile]), part.column(4).take(taken)],
                                                     names=["id", "v", "tile", "seen", "bound"])

    kind, held = (queries.schema[c].dataType.simpleString() for c in ("id", "v"))
    if first:
        return queries.select("id", "v", "cell", "d").mapInArrow(look, f"id {kind}, v {held}, cell int, d double, block int, tile int, seen bigint, bound double")
    return queries.select("id", "v", "cell", "d", "bound", "block").mapInArrow(look, f"id {kind}, v {held}, tile int, seen bigint, bound double")


def _met(visits: DataFrame, blocks: DataFrame, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """(id, neighbour, distance, payload): the k nearest of each query in each tile it visits, within its bound."""
    # A tile of many queries is met by so many slices of them that all cores have work.
    n, cores = F.count("*"), visits.sparkSession.sparkContext.defaultParallelism
    slices = F.greatest(F.ceil(n / (SLICE_BLOCKS * block_rows)), F.least(F.ceil(n / block_rows), F.lit(cores))).cast("int")
    counts = small(visits.groupBy("tile").agg(slices.alias("slices")))
    q = visits.join(counts, "tile").withColumn("slice", F.pmod(hash32(key_text(F.col("id"), "slice")), F.col("slices")).cast("int")).select("tile", "slice", "id", "v", "seen", "bound")
    r = blocks.withColumn("tile", F.floor(F.col("block") / TILE_BLOCKS).cast("int")).join(counts, "tile").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    r = r.select("tile", "slice", "block", "id", "v", "payload")
    kind = visits.schema["id"].dataType.simpleString()
    schema = pa.schema([("id", _arrow(visits, "id")), ("neighbour", _arrow(blocks, "id")), ("distance", pa.float64()), ("payload", pa.float64())])

    def near_pairs(q, rough_q, limit, r, rough_r, least, error):
        """(row of q, row of r, distance) of all pairs whose rough square is within the limit, or of more than the `least` nearest rows of
        r where these are many."""
        rough = rough_q @ rough_r.T
        hit = rough <= limit[:, None]
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 20 * least)
        if len(many) and least < len(r):
            far = np.partition(rough[many], least - 1, axis=1)[:, least - 1]
            hit[many] = rough[many] <= np.nextafter(np.minimum(limit[many], far + 2 * error), np.inf, dtype=rough.dtype)[:, None]
        i, j = np.divmod(np.flatnonzero(hit), len(r))
        exact, step = np.empty(len(i)), max(1, MATRIX_CELLS // q.shape[1])
        for x in range(0, len(i), step):
            exact[x:x + step] = np.sqrt(((r[j[x:x + step]] - q[i[x:x + step]]) ** 2).sum(1))
        return i, j, exact

    def nearest_of(which, at, distance):
        """The k nearest of each query, ties by the order of ids."""
        order = np.lexsort((at, distance, which))
        which, at, distance = which[order], at[order], distance[order]
        start = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        kept = np.arange(len(which)) - np.repeat(start, np.diff(np.r_[start, len(which)])) < k
        return which[kept], at[kept], distance[kept]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by("id")
        qid, rid, payload = a.column("id").combine_chunks(), b.column("id").combine_chunks(), b.column("payload").combine_chunks()
        qv, bound, seen = _matrix(a.column("v").combine_chunks()), a.column("bound").to_numpy(), a.column("seen").to_numpy()
        # A row's place is that of the first row with its id; a query's is -1 if its id is not here.
        own, place = (np.asarray(pc.fill_null(pc.index_in(x, value_set=rid), -1)) for x in (qid, rid))
        least = k + (int(np.unique(place, return_counts=True)[1].max()) if exclude_self else 0)
        rv, block, parts = _matrix(b.column("v").combine_chunks()), b.column("block").to_numpy(), []
        # Rough squares of distances, less the query's own square, are one product of shorter numbers about the tile's centre; what they can be
        # off by is added to the limit, and pairs within it are measured exactly.
        centre = rv.mean(0)
        q, r = qv - centre, rv - centre
        q2, r2 = (q * q).sum(1), (r * r).sum(1)
        kind_of = np.float32 if q2.max() + r2.max() < 1e30 else np.float64
        error = 2 * np.finfo(kind_of).eps * (rv.shape[1] + 8) * (q2.max() + 2 * r2.max()) + SLACK * SLACK
        limit = np.nextafter(((bound * (1 + SLACK)) ** 2 + error - q2).astype(kind_of), np.inf, dtype=kind_of)
        rough_q = np.concatenate([q, np.ones((len(q), 1))], axis=1).astype(kind_of)
        rough_r = np.concatenate([-2 * r, r2[:, None]], axis=1).astype(kind_of)
        members = {x: np.flatnonzero(block == x) for x in np.unique(block)}
        members = {x: (at, rv[at], rough_r[at]) for x, at in members.items()}
        del rv, q, r, rough_r
        step = max(1, MATRIX_CELLS // max(len(at) for at, _, _ in members.values()))
        for i in range(0, len(qv), step):
            found = []
            for x, (at, v, rough_v) in members.items():
                chosen = i + np.flatnonzero(seen[i:i + step] >> (x % TILE_BLOCKS) & 1)
                if len(chosen):
                    which, which_r, distance = near_pairs(qv[chosen], rough_q[chosen], limit[chosen], v, rough_v, least, error)
                    which, which_r = chosen[which], at[which_r]
                    other = place[which_r] != own[which] if exclude_self else np.ones(len(which), bool)
                    found.append((which[other], which_r[other], distance[other]))
            if found and any(len(x[0]) for x in found):
                parts.append(nearest_of(*(np.concatenate(x) for x in zip(*found))))
        if not parts:
            return schema.empty_table()
        which, at, distance = (np.concatenate(x) for x in zip(*parts))
        return pa.Table.from_arrays([qid.take(pa.array(which)), rid.take(pa.array(at)), pa.array(distance), payload.take(pa.array(at))], schema=schema)

    return q.groupBy("tile", "slice").cogroup(r.groupBy("tile", "slice")).applyInArrow(meet, f"id {kind}, neighbour {blocks.schema['id'].dataType.simpleString()}, distance double, payload double")


def _arrow(df: DataFrame, c: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[c].dataType)


def nearest(queries: DataFrame, reference: DataFrame, obj: str, vector: str, payload: str, k: int, exclude_self: bool = False,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(obj, neighbour, distance, payload, position): Euclidean, ties by neighbour id."""
    found, _ = nearest_with_visits(queries, reference, obj, vector, payload, k, exclude_self, block_rows)
    return found


def nearest_with_visits(queries: DataFrame, reference: DataFrame, obj: str, vector: str, payload: str, k: int, exclude_self: bool = False,
                        block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The neighbours, and the (query, block) rows of round two that the pruning has left."""
    ref = reference.where(F.col(vector).isNotNull()).select(obj, vector, F.col(payload).cast("double").alias("payload"))
    n = ref.count()
    pivots = pivots_of(ref, obj, vector, min(MAX_PIVOTS, max(1, -(-n // block_rows))))
    kind = queries.schema[obj].dataType.simpleString()
    if not n:
        none = queries.sparkSession.createDataFrame([], f"{obj} {kind}, neighbour {kind}, distance double, {payload} double, position int")
        return none, none
    rows = max(block_rows, -(-n // MAX_BLOCKS))
    blocks, known = blocks_of(cut_lineage(_celled(ref, obj, vector, pivots)), rows)
    own = cut_lineage(_visits(_celled(queries.select(obj, vector), obj, vector, pivots), pivots, known, True, k))
    near = cut_lineage(_met(own, blocks, k, exclude_self, rows))
    kth = near.groupBy("id").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
    bounded = own.join(kth, "id", "left").withColumn("bound", F.when(F.col("_n") >= k, F.least("bound", "_far")).otherwise(F.col("bound")))
    visits = cut_lineage(_visits(bounded, pivots, known, False, k))
    cand = near.unionByName(_met(visits, blocks, k, exclude_self, rows)).toDF(obj, "neighbour", "distance", payload)
    bits = F.filter(F.sequence(F.lit(0), F.lit(TILE_BLOCKS - 1)), lambda i: F.getbit("seen", i) == 1)
    met = visits.select("id", F.explode(F.transform(bits, lambda i: F.col("tile") * TILE_BLOCKS + i)).alias("block"))
    return top_n(cand, [obj], k, F.col("distance"), F.col("neighbour")), met


def weighted_neighbour_mean(neighbours: DataFrame, obj: str, payload: str) -> DataFrame:
    """Inverse-distance mean; when some neighbours lie at distance zero only those count, equally."""
    zero = F.col("distance") == 0
    return (neighbours.groupBy(obj).agg(
        F.count("*").alias("n"), F.avg(F.when(zero, F.col(payload))).alias("_exact"),
        (F.sum(F.when(~zero, F.col(payload) / F.col("distance"))) / F.sum(F.when(~zero, 1 / F.col("distance")))).alias("_inverse"))
        .select(obj, "n", F.coalesce("_exact", "_inverse").alias("pred")))
