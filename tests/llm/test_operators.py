"""Operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from photonloom.llm import decontaminate, lines, neighbours, orc_tokens, packing, pii, quality, sharding, simhash, substrings, tokens
from photonloom.llm.common import prefix_sums, stored, tokenizer_path
from photonloom.llm.components import roots
from photonloom.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_prefix_sums(spark):
    values = [random.Random(1).randrange(100) for _ in range(700)]
    got = spark.createDataFrame([(values,), ([],), ([5],)], "v array<bigint>").select(prefix_sums(pytest.importorskip("pyspark.sql.functions").col("v"), 16)).collect()
    assert [r[0] for r in got] == [[sum(values[:i]) for i in range(700)], [], [0]]


# --- personal data
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if not i % 2 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    found = sorted((m.start(), o, m.end(), k) for o, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if ok(k, m.group(0)))
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in found)


def test_pii_base_spans(spark, docs, texts):
    odd = ["a@b.c_d@e.f", "x@@y.z a@b..c.d é@q.w", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-9999 +12 +1 2 3 4 5 6 7 8 9", "日本 a.b%c+d-e@x-y.z1 😀 10.0.0.1", "5" * 50_000 + " " + "a" * 50_000, "+1" + " " * 30_000 + "2"]
    rows = [*texts.items(), *((10_000 + i, t) for i, t in enumerate(odd))]
    for r in pii.summary(frame(spark, rows)).collect():
        want = base_spans(dict(rows)[r.doc_id])
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in BASE)
        assert base == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_pii_added_spans(spark):
    rows = [(1, "my IBAN is GB82 WEST 1234 5698 7654 32 ok"), (2, "code GB82 WEST 1234 5698 7654 33"), (3, "social security 078-05-1120"), (4, "part 078-05-1120"), (5, "DE89370400440532013000")]
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in pii.summary(frame(spark, rows)).collect()}
    assert "iban" in got[1] and "iban" not in got[2] and "ssn" in got[3] and "ssn" not in got[4] and "iban" in got[5]
    assert pii.redact(pii.find_spans(frame(spark, [(1, "mail a@b.co now")]))).first().text == "mail [email] now"


def test_pii_spans_end_where_they_should(spark):
    uk, de = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    rows = [(1, f"{uk} BIC WESTGB2L"), (2, f"{uk} 00 2024"), (3, f"{uk} {de} X"), (4, "123-45-6789 is my social security number"), (5, f"no {uk[:-1]}3 BIC"), (6, "part 123-45-6789 of it"), (7, f"{uk} and so on")]
    got = {r.doc_id: r.spans for r in pii.summary(frame(spark, rows)).collect()}
    own = {i: [s for s in v.split(",") if s.split(":")[0] in ("iban", "ssn")] for i, v in got.items()}
    assert own == {1: ["iban:0:27"], 2: ["iban:0:27"], 3: ["iban:0:27", "iban:28:50"], 4: ["ssn:0:11"], 5: [], 6: [], 7: ["iban:0:27"]}


# --- tokens, packing, files
ODD = ["a  b", "  lead", "trail ", "x \n y", "a\tb c", "", "<|endoftext|> hi", "a\n\nb c\n d", "don't 's 'S  x", "a\0 b\0c", "\n", " ", "日本 語 é ü", "a  b", "a b", "w\r\n next", None, "ab\u0085 c", "Ċ Ġ x", "12abc $%&***word", "é x", " x", "x\n"]


def test_encoder_equals_the_tokenizer(plain, texts):
    every = [*ODD, *list(texts.values())[:60]]
    flat, n = Encoder(tokenizer_path()).encode(pa.array(every))
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(every):
        assert flat[at[i]:at[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_plan_packing_is_whole_and_tight():
    rng = random.Random(3)
    for trial in range(30):
        cap = rng.choice([8, 30, 100, 1024])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(1, 400))]
        counts = collections.Counter(lengths)
        places, n_seq = packing.plan_packing(counts, cap)
        used = collections.defaultdict(list)
        for length, n in counts.items():
            rows = places[length]
            for rank in range(n):
                r = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                k = rank - r[0]
                used[r[1] + k // r[2]].append((r[3] + k % r[2] * length, length))
        assert len(used) == n_seq
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= cap
        assert n_seq <= 11 / 9 * max(-(-sum(lengths) // cap), sum(2 * x > cap for x in lengths)) + 1


def test_packing_round_trip(spark, docs, texts, plain):
    pieces = packing.cut_documents(docs, tokenizer_path())
    placed = stored(packing.place(pieces), "placed")
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    cut = collections.defaultdict(list)
    for r in sorted(placed.collect(), key=lambda r: (r.doc_id, r.piece)):
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        cut[r.doc_id] += own
    assert cut == ids
    full = {r.sequence_id: r.ids for r in packing.sequences(pieces, placed).collect()}
    assert all(len(x) <= 1024 for x in full.values()) and sum(map(len, full.values())) == sum(map(len, ids.values()))
    for r in placed.collect():
        assert full[r.sequence_id][r.offset:r.offset + r.length] == ids[r.doc_id][r.start:r.start + r.length]


def test_orc_round_trip(spark, docs, texts, plain, tmp_path):
    path = orc_tokens.write_orc(docs, str(tmp_path / "ids"), tokenizer_path())
    start = 0
    for r in sorted(orc_tokens.read_orc(spark, path).collect(), key=lambda r: r.doc_id):
        want = [*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert list(r.ids) == want and r.start == start and r.n_tokens == len(want)
        start += len(want)


# --- sharding
def test_shards_are_near_equal_and_gapless(docs):
    got = sharding.shard_documents(docs, 5, 256).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) - min(size.values()) <= 0.02 * sum(size.values())
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_rebalance_for_a_new_shard_moves_few_slots(docs):
    rows = stored(sharding.slotted(docs, 256), "rows")
    loads, both = sharding.balanced_map(rows, 4, 256)
    newest = both.where("version = 2")
    moved = newest.join(sharding.rebalance(newest, loads, 5).withColumnRenamed("shard", "to").drop("version"), "virtual_slot").where("shard <> to").collect()
    assert moved and len(moved) < 0.5 * 256 and sum(r.to == 4 for r in moved) > 0.7 * len(moved)  # a few even out the old shards


# --- quality
def test_quality_on_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    got = quality.summary(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, n, y = rng.normal(size=(7, 5)), np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])
    w = {"mean": np.zeros(5), "std": np.ones(5), "W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array(0.1)}
    loss = lambda v: -np.mean(y * np.log(p := quality._forward(v, x, n)[-1]) + (1 - y) * np.log(1 - p))
    for k, g in quality._gradients(w, x, n, y).items():
        at = tuple(0 for _ in g.shape)
        up, down = w[k].copy(), w[k].copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        assert abs((loss(w | {k: up}) - loss(w | {k: down})) / 2e-6 - g[at]) < 1e-6


def test_features_do_not_depend_on_the_row_before():
    texts = [b"", b"a", b"bc", b"some words of a text", b"x" * 3000]
    every, n = quality.encode_passages([b"zz before", *texts])
    apart = [quality.encode_passages([t])[0] for t in texts]
    assert np.array_equal(every[n[0]:], np.concatenate(apart))


# --- near duplicates
def brute_components(fps, distance=2):
    ids, parent = sorted(fps), {}
    def find(i):
        while parent.get(i, i) != i:
            i = parent[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [200, 1])
def test_simhash_components(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (2, 3, limit))
    rows = [*texts.items(), (9001, "One two"), (9002, "ONE  two"), (9003, ""), (9004, " \n")]
    want = {}
    for i, t in rows:
        w = t.encode().lower().split()
        grams = [b" ".join(g) for g in zip(w, w[1:], w[2:])] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if len(h) < 2000 else simhash.fingerprint(w) % (1 << 64)
    roots_of = brute_components(want)
    for r in simhash.summary(frame(spark, rows)).collect():
        assert (r.fingerprint, r.component_id) == (f"{want[r.doc_id]:016x}", roots_of[r.doc_id])


@pytest.mark.parametrize("limit", [200, 3])
def test_links_reach_across_a_chain(spark, limit):
    rng = random.Random(5)
    fps = [rng.getrandbits(63)]
    for _ in range(60):
        fps.append(fps[-1] ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    fps += [rng.getrandbits(63) for _ in range(100)]
    want = brute_components({f: f for f in fps})
    table = spark.createDataFrame([(f,) for f in set(fps)], "fp bigint")
    root = {r.u: r.root for r in roots(simhash.links(table, pair_limit=limit)).collect()}
    assert {f: root.get(f, f) for f in fps} == {f: want[f] for f in fps}


def test_thresholds_follow_the_general_pigeonhole():
    assert sum(simhash.allocate([[0, 9, 50, 90], [0, 1, 2, 90], [0, 9, 60, 90]], 0)) == 0
    assert simhash.allocate([[0, 900, 5000], [0, 1, 2], [0, 9, 60]], 0) == [-1, 1, 0]


# --- repeated passages
def brute_repeats(rows, k):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = t.encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            x = tuple(w[p:p + k])
            if x in seen:
                gone[p:p + k] = [True] * k
            seen.add(x)
        kept = [a for a, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_repeated_passages(spark, texts, monkeypatch):
    rng = random.Random(2)
    few = [(7000 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(200)))) for i in range(40)]
    rows = [*texts.items(), *few]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.summary(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows, 20)


def test_a_hot_minimiser_is_dealt_over_all_buckets(spark):
    """A phrase with a low hash between different words: its windows are all different, and no bucket takes them all."""
    rng = random.Random(4)
    with np.errstate(over="ignore"):
        phrase = min(([f"p{rng.randrange(10 ** 6)}" for _ in range(4)] for _ in range(3000)), key=lambda p: substrings._mix(substrings._rolled(np.array([xxhash.xxh64_intdigest(w + " ") for w in p], np.uint64), 4))[0])
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    rows = [(i, " ".join([*(word() for _ in range(30)), *phrase, *(word() for _ in range(30))])) for i in range(600)]
    rows += [(1000 + i, "x " * (i % 3) + " ".join(rows[i][1].split()[15:50])) for i in range(50)]
    load = collections.Counter()
    for r in substrings.super_kmers(frame(spark, rows), 16).collect():
        load[r.bucket] += int(np.frombuffer(r.counts, np.int32).sum())
    assert max(load.values()) < 2 * sum(load.values()) / 16
    for parts in (1, 5):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.summary(frame(spark, rows).repartition(parts)).collect()}
        assert got == brute_repeats(rows, 20)


def test_hash_collisions_are_resolved_by_words(monkeypatch):
    monkeypatch.setattr(substrings, "_rolled", lambda v, n: np.zeros(len(v) - n + 1, np.uint64))
    ids = np.array([1, 2, 3, 1, 2, 3, 9, 1, 2, 4], np.int32)
    assert substrings._earliest(ids, np.arange(8), 3).tolist() == [0, 1, 2, 0, 4, 5, 6, 7]


# --- lines
def test_near_lines(spark):
    base = "the quick brown fox jumps over the lazy dog again"
    w = base.split()
    rows = [(1, base), (2, base.upper() + "\nshort line"), (3, " ".join([*w[:2], "red", *w[3:]])), (4, " ".join(w[1:])), (5, " ".join([*w, "more"])), (6, " ".join([*w[:4], "new", *w[4:]])),
            (7, " ".join([*w[:2], "red", "cat", *w[4:]])), (8, " ".join([w[1], w[0], *w[2:]])), (9, "short lime"), (10, " short \t LINE ")]
    got = {r.doc_id: (r.n_dropped, r.n_near) for r in lines.summary(frame(spark, rows)).collect()}
    # 7 is one word from 3, and 8 is line 4 with a word more
    assert got == {1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (1, 1), 5: (1, 1), 6: (1, 1), 7: (1, 1), 8: (1, 1), 9: (0, 0), 10: (1, 0)}


# --- neighbours
def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    got = collections.defaultdict(dict)
    for r in neighbours.summary(table).collect():
        assert r.score == float((rows[r.query_id] * rows[r.vec_id]).sum())
        got[r.query_id][r.rank] = r.vec_id
    hit = 0
    for q in got:
        best = sorted((i for i in rows if i != q), key=lambda i: (-float((rows[q] * rows[i]).sum()), i))[:20]
        hit += len(set(best) & set(got[q].values()))
        assert sorted(got[q]) == list(range(1, 21))
    assert hit >= 0.9 * 20 * len(got) and set(got) == {i for i in rows if i % 20 == 0}


# --- benchmark
def brute_hits(rows, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(len(w) - min(k, len(w)) + 1 if w else 0):
            windows[tuple(w[p:p + k])].add(i)
    out = {}
    for i, t in rows:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    got |= windows[tuple(w[p:p + n])]
        out[i] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark, docs, texts):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bench += [(500, "Été à la É"), (501, "zz"), (502, "one one one one one one one one one one one"), (503, "a b")]
    rows = [*texts.items(), (8001, "x été, À la É zz"), (8002, "ÉTÉ à la é"), (8003, "one " * 30), (8004, "b a b zz! ZZ"), (8005, bench[0][1].upper())]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.summary(frame(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert got == brute_hits(rows, bench)


def test_contamination_of_rows_of_one_id_and_text(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = frame(spark, [(1, text), (1, text), (None, text), (None, text), (None, text), (2, text), (3, "clean")])
    bench = spark.createDataFrame([(1, " ".join(text.split()[5:15])), (2, "word20 word21"), (3, "word29")], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in decontaminate.summary(docs, bench).collect())
    assert got == [(0, 13, 3)] * 3 + [(1, 13, 3)] * 2 + [(2, 13, 3), (3, 0, 0)]
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [3]


def test_proximity(spark):
    docs, bench = frame(spark, [(1, "alpha x beta y gamma"), (2, "gamma alpha " + "x " * 30 + "beta")]), spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    windows = decontaminate.item_windows(bench)
    terms = windows.selectExpr("explode(words) word").distinct().selectExpr("word", "xxhash64(word) term")
    got = decontaminate.near(decontaminate.build_index(docs, terms), windows, terms, 8).collect()
    assert {r.doc_id for r in got} == {1}


def test_encoder_in_parts_equals_the_tokenizer(plain, texts, monkeypatch):
    """Neither the cut of a batch nor what a worker forgets changes the ids."""
    monkeypatch.setattr(tokens, "TEXTS", 7)
    monkeypatch.setattr(tokens, "MAX_WORDS", 50)
    monkeypatch.setattr(tokens, "MAX_PIECES", 50)
    every = [*ODD, *list(texts.values())[:60]]
    flat, n = Encoder(tokenizer_path()).encode(pa.array(every).slice(1))
    assert flat.tolist() == [i for t in every[1:] for i in plain.encode(t or "", add_special_tokens=False).ids] and len(n) == len(every) - 1
    assert [len(x) for x in Encoder(tokenizer_path()).encode(pa.array([], pa.string()))] == [0, 0]


def test_encoder_cuts_where_letters_end(plain):
    """A word is known once, whatever stands behind it, and the cuts change no id."""
    e = Encoder(tokenizer_path())
    e.encode(pa.array(["alpha alpha, alpha. alpha!! alpha&&& alpha7 alpha's alpha.\nalpha été été, été.\nété"]))
    assert {w.decode() for w in e.words.number if "alpha" in w.decode() or "été" in w.decode()} == {"alpha", " alpha", " été", "été"}
    rng, some = random.Random(8), ["a", "Zb", "é", "ß", "ǅ", "ɏ", "ʰ", "×", "÷", "́", "日", "'", "'s", "'ll", ".", "!!", "&&&", "-", "_", "7", "12", "²", "\n", "\r", "\t", "\0", "\x1c", "\x7f", " ", " ", "\u00a0", "\u0085", "\u2028", "<|endoftext|>"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(6000)]
    flat, n = e.encode(pa.array(texts))
    ends = np.cumsum(n)
    for text, ids in zip(texts, np.split(flat, ends[:-1])):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_an_encoding_worker_stays_small():
    """A worker that has met 600,000 words keeps less than 200 MB of them, in use or freed: it is reused and waits beside the JVM's own stages."""
    run = """
import random, re, sys
import pyarrow as pa
from photonloom.llm.common import tokenizer_path
from photonloom.llm.tokens import Encoder
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
e, rng = Encoder.get(tokenizer_path()), random.Random(5)
e.encode(pa.array(["one two"]))
before = held()
for _ in range(6):
    e.encode(pa.array([" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(100)) for _ in range(1000)]))
print(held() - before)
"""
    got = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(got.stdout) < 200
