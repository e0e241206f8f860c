"""Best-fit packing of documents into sequences of a fixed number of tokens, by large-item matching.

A document of at most `capacity` tokens is one piece; a longer one is cut so that all pieces but the first are full.
A packing is decided on the number of pieces of each length, a table of at most `capacity` rows, whatever the input:
pieces over a third of the capacity are matched, the largest with the largest that fits, at most two in a sequence;
smaller ones, longest first, go to the tightest gap that holds them, and open sequences only when no gap does. The plan
says for each length which ranks go where; a document's rank among its length is a task's offset plus its rank within the
task, so that no length, however common, is gathered in one place.

Defined results: a null or empty text is the end id alone; rows that share an id are separate documents; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import stored
from photonloom.llm.tokens import Encoder

CAPACITY, END_ID = 1024, 2
#: Sequences of one full piece have numbers of their own: this bit, the task and a counter.
FULL_BIT, TASK_SHIFT = 1 << 62, 36
_PIECES = "doc_id bigint, n_tokens bigint, first int, part int, rank bigint, full_base bigint, crcs array<bigint>, ids array<int>"


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """Places of pieces by length: rows (first rank, first sequence, pieces of this length per sequence, offset), and
    the number of sequences. A group of sequences that are filled alike is one entry, so the work depends on the number
    of lengths and not of pieces."""
    left, places, n_seq = dict(counts), defaultdict(list), 0
    given: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)

    def put(length: int, first: int, n: int, per: int, offset: int) -> None:
        places[length].append((given[length], first, per, offset))
        given[length] += n

    def open_group(n: int) -> int:
        nonlocal n_seq
        n_seq += n
        return n_seq - n

    large = sorted((x for x in left if 3 * x > capacity and left[x]), reverse=True)
    for a in large:
        partners = [b for b in large if b <= min(a, capacity - a)]
        while left[a]:
            b = next((b for b in partners if left[b] > (b == a)), None)
            if b is None:
                n = left[a]
                first = open_group(n)
                put(a, first, n, 1, 0)
                gaps[capacity - a].append((first, n))
            elif b == a:
                n = left[a] // 2
                first = open_group(n)
                put(a, first, 2 * n, 2, 0)
                gaps[capacity - 2 * a].append((first, n))
                left[a] -= n
            else:
                n = min(left[a], left[b])
                first = open_group(n)
                put(a, first, n, 1, 0)
                put(b, first, n, 1, a)
                gaps[capacity - a - b].append((first, n))
                left[b] -= n
            left[a] -= n
    gaps.pop(0, None)
    open_gaps = sorted(gaps)

    def give_back(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, n))

    for s in sorted((x for x in left if 3 * x <= capacity and left[x]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(open_gaps, s)
            if at == len(open_gaps):  # no gap holds it: sequences of this length only
                per = capacity // s
                n = max(1, left[s] // per)
                gap, first = capacity, open_group(n)
            else:
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
                per = gap // s
            filled = min(n, left[s] // per)
            if filled:
                put(s, first, filled * per, per, capacity - gap)
                left[s] -= filled * per
                give_back(gap - per * s, first, filled)
            rest = n - filled
            if rest and left[s]:  # fewer than `per` pieces remain
                k = left[s]
                put(s, first + filled, k, k, capacity - gap)
                left[s] = 0
                give_back(gap - k * s, first + filled, 1)
                give_back(gap, first + filled + 1, rest - 1)
            elif rest:
                give_back(gap, first + filled, rest)
    return {k: np.array(v, np.int64) for k, v in places.items()}, n_seq


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One stored row per document: its number of tokens, the first piece's length, the row's task and rank among that
    length in the task, the checksum of each piece, and the ids unless they are not wanted."""
    def cut(batches):
        encoder, part = Encoder.get(vocabulary), TaskContext.get().partitionId()
        seen, full = np.zeros(capacity + 1, np.int64), 0
        for b in batches:
            ids, lens = encoder.encode(b.column(1))
            flat = np.insert(ids, np.cumsum(lens), end_id).astype("<u4")
            lens = lens + 1
            ends = np.cumsum(lens)
            first = (lens - 1) % capacity + 1
            n_full = (lens - first) // capacity
            order = np.argsort(first, kind="stable")
            grouped = first[order]
            rank = np.empty(len(lens), np.int64)
            rank[order] = seen[grouped] + np.arange(len(lens)) - np.searchsorted(grouped, grouped)
            seen += np.bincount(first, minlength=capacity + 1)
            base = full + np.cumsum(n_full) - n_full
            full += int(n_full.sum())
            data, crcs = memoryview(np.ascontiguousarray(flat)).cast("B"), []
            for a, f, k in zip((ends - lens).tolist(), first.tolist(), n_full.tolist()):
                bounds = [a, *range(a + f, a + f + k * capacity + 1, capacity)]
                crcs.extend(zlib.crc32(data[4 * x:4 * y]) for x, y in zip(bounds, bounds[1:]))
            lists = lambda values, n, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, kind))
            kept = lists(flat.astype(np.int32), lens, pa.int32()) if with_ids else pa.nulls(len(lens), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int64()), pa.array(first, pa.int32()), pa.array(np.full(len(lens), part), pa.int32()), pa.array(rank, pa.int64()), pa.array(base, pa.int64()),
                                              lists(np.array(crcs, np.int64), n_full + 1, pa.int64()), kept], names=["doc_id", "n_tokens", "first", "part", "rank", "full_base", "crcs", "ids"])

    return stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, _PIECES), "pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the document's row (part, first, rank)."""
    tasks = pieces.groupBy("first", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("first").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(tasks.select("first", "part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "ranks")
    counts = {r["first"]: r["n"] for r in bases.groupBy("first").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = plan_packing(counts, capacity)

    def assign(batches):
        for b in batches:
            doc, n, first, part, rank, full_base, crcs, before = (b.column(i) for i in range(8))
            n, first, part, rank, full_base, before = (x.to_numpy() for x in (n, first, part, rank, full_base, before))
            seq, offset, at = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), rank + before
            for length in np.unique(first):
                own, rows = np.flatnonzero(first == length), plan[int(length)]
                row = rows[np.searchsorted(rows[:, 0], at[own], "right") - 1]
                k = at[own] - row[:, 0]
                seq[own], offset[own] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * length
            n_pieces = np.diff(crcs.offsets.to_numpy())
            of = np.repeat(np.arange(len(n)), n_pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            full = piece > 0
            own_seq = FULL_BIT + (part[of].astype(np.int64) << TASK_SHIFT) + full_base[of] + piece - 1
            yield pa.RecordBatch.from_arrays([
                doc.take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(np.where(full, first[of] + (piece - 1) * capacity, 0), pa.int64()), pa.array(np.where(full, capacity, first[of]), pa.int64()),
                crcs.flatten(), pa.array(np.where(full, own_seq, seq[of]), pa.int64()), pa.array(np.where(full, 0, offset[of]), pa.int64()), pa.array(part[of], pa.int32()), pa.array(first[of], pa.int32()), pa.array(rank[of], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part", "first", "rank"])

    rows = pieces.select("doc_id", "n_tokens", "first", "part", "rank", "full_base", "crcs").join(bases.drop("_n"), ["first", "part"])
    rows = rows.select("doc_id", "n_tokens", "first", "part", "rank", "full_base", "crcs", "_before")
    return rows.mapInArrow(assign, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, part int, first int, rank bigint")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents in their order."""
    own = placed.join(pieces.select("part", "first", "rank", "ids"), ["part", "first", "rank"]).select("sequence_id", F.struct("offset", "doc_id", "piece", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("p"))
    return own.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
