"""Repeated passages: windows of `window` words that also start earlier in the corpus, found by super-k-mers.

A window's minimiser is the smallest hash among its runs of GRAM words. Consecutive windows with one minimiser form a
super-k-mer, which travels once, as its words in one string, to the bucket of its minimiser; equal windows have equal
minimisers and meet there. A bucket sorts its windows by a hash of their words, compares the words of equal hashes and
keeps the earliest; all others are removed. Words are compared themselves, so the result is exact.

A task sends each distinct string once: a copy within the task that is later than the first by (doc_id, start) is a repeat
of it, whatever the other tasks hold, so its words are reported at once, dealt by document and not by minimiser. A passage
that a third of all documents share so arrives in its bucket a few times per task, not once per document. The number of
buckets follows the bytes of text, and the windows of a hot minimiser, one with more text than a bucket should have, travel
singly, each to the bucket of its own hash: equal windows still meet, and a phrase that many documents have between different
words is dealt over all buckets. Hot ones are counted on a sample of about SAMPLE_BYTES; only costs depend on it.

Defined results: a null text has no words; windows compare by (doc_id, start), null ids first; rows that share id and
text stay alike; rows that share an id only are separate documents of equal rank; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import doc_key, stored

WINDOW, GRAM = 20, 4
#: Text bytes that a task cuts at once, and text bytes per bucket: bounds on memory, not on the work.
FLUSH_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: Text bytes in which hot minimisers are counted, in the order of a hash, and the fewest runs that make one hot.
SAMPLE_BYTES, LEAST_RUNS = 64 << 20, 32
NO_ID = -(1 << 63)
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SENT = "bucket int, docs binary, text_keys binary, starts binary, counts binary, strings binary"
_SPANS = "_doc bigint, text_key bigint, start int, end int"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _words(data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a buffer that ends in white space, each followed by one space; where each begins there, and where it
    began in the buffer."""
    white = (data == 32) | (data >= 9) & (data <= 13)
    after = np.empty(len(data), bool)
    after[0] = False
    np.logical_not(white[:-1], out=after[1:])
    begin = np.flatnonzero(~white & ~after)
    plain = np.where(white, np.uint8(32), data)[~white | after]
    return plain.tobytes(), np.concatenate([[0], np.flatnonzero(plain == 32) + 1])[:-1] if len(begin) else np.zeros(0, np.int64), begin


def _coded(plain: bytes, begin: np.ndarray) -> pa.DictionaryArray:
    """Words numbered by their bytes."""
    offsets = np.append(begin, len(plain)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(plain)]).dictionary_encode()


def _rolled(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values, by doubling."""
    out, size, have = None, 0, values
    width, power = 1, _ODD
    while True:
        if n & width:
            if out is None:
                out, size = have, width
            else:
                m = len(values) - size - width + 1
                out, size = have[:m] + out[width:width + m] * power, size + width
        width *= 2
        if width > n:
            return out
        m = len(values) - width + 1
        half = width // 2
        have = have[:m] + have[half:half + m] * power
        power = power * power


def _lowest(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n values."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:len(values) - (n - width)], values[n - width:]) if n > width else values


def _windows(texts: list[bytes], window: int, gram: int):
    """The words of some texts (bytes, where each begins), the text of each, their hashes and, for each window, its minimiser
    and whether it lies in one text and is the first of a run with one minimiser there; none without windows."""
    import xxhash

    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    plain, begin, where = _words(data)
    if len(begin) < window:
        return None
    of = np.searchsorted(at, where, "right") - 1
    coded = _coded(plain, begin)
    own = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
    with np.errstate(over="ignore"):
        least = _lowest(_mix(_rolled(own, gram)), window - gram + 1)
    n = len(begin) - window + 1
    valid = of[:n] == of[window - 1:]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (least[1:n] == least[:n - 1]))
    return plain, begin, of, own, least, valid, new


def _cut(docs: list[tuple[int, int, bytes]], n_buckets: int, window: int, gram: int, hot: np.ndarray):
    """Rows to send for some documents (id, text key, text)."""
    import zstandard

    docs.sort(key=lambda d: d[:2])
    if (made := _windows([d[2] for d in docs], window, gram)) is None:
        return
    plain, begin, of, own, least, valid, new = made
    n = len(valid)
    single, to = np.isin(least, hot), least
    if single.any():
        new |= valid & single
        with np.errstate(over="ignore"):
            to = np.where(single, _mix(_rolled(own, window)), least)
    first = np.flatnonzero(new)
    if not len(first):
        return
    stop = np.append(first[1:], n)
    upto = np.concatenate([[0], np.cumsum(valid)])
    count = upto[stop] - upto[first]
    bucket = (to[first] % np.uint64(n_buckets)).astype(np.int64)
    doc_first = np.searchsorted(of, np.arange(len(docs)), "left")
    ids, keys = np.array([d[0] for d in docs], np.int64)[of[first]], np.array([d[1] for d in docs], np.int64)[of[first]]
    start = (first - doc_first[of[first]]).astype(np.int32)
    order = np.lexsort((keys, start, ids, bucket))  # within a bucket in corpus order
    first, count, bucket, ids, keys, start = (x[order] for x in (first, count, bucket, ids, keys, start))
    a, z = begin[first].tolist(), (np.append(begin, len(plain))[first + count + window - 1] - 1).tolist()
    count = count.astype(np.int32)
    packer, later = zstandard.ZstdCompressor(level=3), []
    bounds = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for lo, hi in zip(bounds, [*bounds[1:], len(bucket)]):
        strings = [plain[x:y] for x, y in zip(a[lo:hi], z[lo:hi])]
        which = np.arange(lo, hi)
        if len(set(strings)) < len(strings):
            seen: dict[bytes, int] = {}
            lead = np.array([seen.setdefault(s, i) for i, s in enumerate(strings)]) + lo
            equal = (ids[which] == ids[lead]) & (start[which] == start[lead])  # of equal rank: no repeat of the first
            if not equal.all():
                later.append(which[~equal])
            twin = np.zeros(len(which), bool)
            twin[1:] = (lead[1:] == lead[:-1]) & (keys[lo + 1:hi] == keys[lo:hi - 1])
            which = which[equal & ~twin]  # rows that share id and text send it once
            strings = [strings[i - lo] for i in which.tolist()]
        yield int(bucket[lo]), ids[which].tobytes(), keys[which].tobytes(), start[which].tobytes(), count[which].tobytes(), packer.compress(b"\n".join(strings))
    if later:  # repeats within the task: dealt by document, without strings
        which = np.concatenate(later)
        which = which[np.lexsort((start[which], keys[which], ids[which]))]
        d, k, s = ids[which], keys[which], start[which]
        alike = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
        which = which[np.append(True, ~(alike & (s[1:] == s[:-1])))]  # rows that share id and text report once
        d, k, s, c = ids[which], keys[which], start[which], count[which]
        head = np.flatnonzero(np.append(True, ~((d[1:] == d[:-1]) & (k[1:] == k[:-1]) & (s[1:] == s[:-1] + c[:-1]))))
        which = which[head]
        count[which] = np.add.reduceat(c, head)  # runs of windows that follow one another are one
        goal = (keys[which].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
        for b in np.unique(goal).tolist():
            w = which[goal == b]
            yield int(b), ids[w].tobytes(), keys[w].tobytes(), start[w].tobytes(), count[w].tobytes(), None


def hot_minimisers(docs: DataFrame, n_buckets: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Minimisers that begin more runs of windows than a bucket should get, counted on a sample: fewer than n_buckets."""
    per_million = min(1_000_000, -(-SAMPLE_BYTES * 1_000_000 // (n_buckets * BUCKET_BYTES)))

    def run(batches):
        for b in batches:
            if (made := _windows([t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()], window, gram)) is not None:
                keys, n = np.unique(made[4][made[6]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["least", "n"])

    part = docs.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1_000_000)) < per_million)
    runs = part.select("text").mapInArrow(run, "least bigint, n bigint").groupBy("least").agg(F.sum("n").alias("n"))
    rows = stored(runs.groupBy(F.when(F.col("n") >= LEAST_RUNS, F.col("least")).alias("least")).agg(F.sum("n").alias("n")), "runs")  # null: all others
    every = rows.agg(F.sum("n")).first()[0] or 0
    rows = rows.where("least IS NOT NULL").where(F.col("n") * n_buckets > every).select("least").collect()  # fewer than n_buckets numbers
    return np.array(sorted(r[0] for r in rows), np.int64).view(np.uint64)


def super_kmers(docs: DataFrame, n_buckets: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Packed super-k-mers by bucket."""
    hot = hot_minimisers(docs, n_buckets, window, gram)

    def rows(made):
        cols = list(zip(*made))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "docs", "text_keys", "starts", "counts", "strings"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                held.append((NO_ID if i is None else i, k, t or b""))
                size += len(held[-1][2])
                if size >= FLUSH_BYTES:
                    if made := list(_cut(held, n_buckets, window, gram, hot)):
                        yield rows(made)
                    held, size = [], 0
        if held and (made := list(_cut(held, n_buckets, window, gram, hot))):
            yield rows(made)

    return docs.select(*doc_key(), "text").mapInArrow(run, _SENT)


def _earliest(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For windows beginning at `at`, in corpus order: the index of the first window with the same words."""
    with np.errstate(over="ignore"):
        h = _mix(_rolled(_mix(ids.astype(np.uint64) * _ODD + np.uint64(1)), window))[at]
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    head = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    first = np.empty(len(at), np.int64)
    first[order] = lead
    other = np.flatnonzero(first != np.arange(len(at)))
    differ = np.zeros(len(other), bool)
    for j in range(window):
        differ |= ids[at[other] + j] != ids[at[first[other]] + j]
    if differ.any():  # two word sequences with one hash: by their words
        groups = np.unique(first[other[differ]])
        seen: dict[tuple, int] = {}
        for i in np.flatnonzero(np.isin(first, groups)).tolist():
            words = tuple(ids[at[i]:at[i] + window].tolist())
            first[i] = seen.setdefault((int(first[i]), words), i)
    return first


def _repeats(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """Spans of words to remove that one bucket shows."""
    import zstandard

    unpacker, out = zstandard.ZstdDecompressor(), []
    columns = [c.to_pylist() for c in (table.column(n) for n in ("docs", "text_keys", "starts", "counts", "strings"))]
    parts, strings = [], []
    for docs, keys, starts, counts, packed in zip(*columns):
        row = np.stack([np.frombuffer(docs, np.int64), np.frombuffer(keys, np.int64), np.frombuffer(starts, np.int32).astype(np.int64), np.frombuffer(counts, np.int32).astype(np.int64)])
        if packed is None:
            out.append(np.stack([row[0], row[1], row[2], row[2] + row[3] + window - 1]))
        else:
            parts.append(row)
            strings.extend(unpacker.decompress(packed).split(b"\n"))
    if parts:
        doc, key, start, count = np.concatenate(parts, axis=1)
        order = np.lexsort((key, start, doc))
        doc, key, start, count = doc[order], key[order], start[order], count[order]
        plain = b" ".join([strings[i] for i in order.tolist()]) + b" "
        begin = np.concatenate([[0], np.flatnonzero(np.frombuffer(plain, np.uint8) == 32) + 1])[:-1]
        ids = _coded(plain, begin).indices.to_numpy()
        upto = np.cumsum(count)
        of = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(of)) - np.repeat(upto - count, count)
        size = count + window - 1
        at = (np.cumsum(size) - size)[of] + within
        first = _earliest(ids, at, window)
        d, p = doc[of], start[of] + within
        later = (d != d[first]) | (p != p[first])
        edge = np.diff(np.concatenate([[0], later.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        breaks = np.flatnonzero(later[1:] & later[:-1] & (of[1:] != of[:-1]))
        lo, hi = np.sort(np.concatenate([lo, breaks + 1])), np.sort(np.concatenate([hi, breaks]))
        out.append(np.stack([d[lo], key[of[lo]], p[lo], p[hi] + window]))
    d, k, a, z = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    return pa.table({"_doc": pa.array(d, pa.int64()), "text_key": pa.array(k, pa.int64()), "start": pa.array(a, pa.int32()), "end": pa.array(z, pa.int32())})


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_doc, text_key, spans): the word ranges of each document that repeat earlier ones, as (start, end) in any order."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(16, int(total) // BUCKET_BYTES)
    spans = super_kmers(docs, n_buckets, window, gram).groupBy("bucket").applyInArrow(lambda t: _repeats(t, window), _SPANS)
    return spans.groupBy("_doc", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, z in sorted(spans):
        out += words[at:a] if a > at else []
        at = max(at, z)
    return out + words[at:]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by single spaces) of every document."""
    def run(batches):
        for b in batches:
            got = defaultdict(list)
            for t, a, z in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = (t or b"").split()
                left = _kept(words, list(zip(a, z))) if a else words
                got["n_words"].append(len(words))
                got["n_removed"].append(len(words) - len(left))
                got["kept"].append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got["n_words"], pa.int64()), pa.array(got["n_removed"], pa.int64()), pa.array(got["kept"], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.select(*doc_key(), "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"))
    joined = rows.join(repeated_spans(docs, window, gram), ["_doc", "text_key"], "left")
    return joined.select("doc_id", "text", "spans.start", "spans.end").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def summary(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
