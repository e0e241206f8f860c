"""Importance resampling, conversation repair and token counts against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from photonloom.llm import conversations, resampling, token_counts
from photonloom.llm.common import tokenizer_path

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# --- importance resampling
def test_checksums_of_spans_of_every_length():
    r = random.Random(3)
    data = np.frombuffer(r.randbytes(600_000), np.uint8)
    length = np.array([0, 1, 63, 64, 65, 127, 128, 129, 4096, 4097, 70_001, 590_000] + [r.randrange(400) for _ in range(300)])
    begin = np.array([r.randrange(len(data) - n + 1) for n in length])
    want = [zlib.crc32(data[b:b + n].tobytes()) for b, n in zip(begin, length)]
    assert resampling.Checksums().of(data, begin, length).tolist() == want


def brute_resample(docs, target, buckets=10_000, max_words=1, least=20, percent=10, seed=2024):
    def features(text):
        w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(able[:len(able) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("max_words", [1, 3])
def test_resampling_matches_brute_force(spark, max_words):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, None), (-2, ""), (-3, "É" * 300 + " x"), (-4, "a" * 100_000), (None, "no id " * 20), (-5, " ".join(["The", "the", "THE"] * 5000))]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [None, ""]
    frame = docs_frame(spark, docs).withColumns({c: F.lit(1) for c in ("bucket", "_part", "_row", "weight", "rank", "side")})
    got = resampling.resample(frame, spark.createDataFrame([(x, 1) for x in target], "text string, side int"), max_words=max_words, percent=30)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == brute_resample(docs, target, max_words=max_words, percent=30)


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    rows = [(7, "w " * 30)] * 40 + [(8, "other " * 25)] * 20
    got = resampling.resample(docs_frame(spark, rows).repartition(7), spark.createDataFrame([("w",)], "text string"), percent=50).collect()
    assert sorted(r.rank for r in got if r["rank"]) == list(range(1, 31)) and len({r.score for r in got}) == 2
    assert min(r.score for r in got if r["rank"]) >= max(r.score for r in got if not r["rank"])
    none = docs_frame(spark, [])
    assert resampling.resample(none, spark.createDataFrame([("w",)], "text string")).count() == 0
    assert resampling.resample(docs_frame(spark, rows), spark.createDataFrame([], "text string")).count() == 60


# --- conversation repair
def brute_audit(rows):
    """Cheapest edits by trying all strings of one conversation: rows of (role, must_go, cut)."""
    best = None

    def go(i, roles, audit, cost):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        text = "".join(r[0] for r in roles)
        if not re.fullmatch(r"s?(ua)*u?", text):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", text):
            best = min(best or (cost, audit, roles), (cost, audit, roles))
        if audit[-2:] != "II":
            for r in ("user", "assistant"):
                go(i, [*roles, r], audit + "I", cost + 3)
        if i < len(rows):
            role, gone, cut = rows[i]
            go(i + 1, roles, audit + "D", cost + 4)
            if not gone:
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, [*roles, role], audit + "K", cost + 3 * cut)
                for r in ("user", "assistant"):
                    go(i + 1, [*roles, r], audit + "R", cost + 3 + 3 * cut)

    go(0, [], "", 0)
    return best


def test_audit_is_the_least_of_all_edit_strings():
    r = random.Random(5)
    kinds = list(itertools.product(("system", "user", "assistant", "tool"), (False, True), (False, True)))
    for _ in range(250):
        rows = [r.choice(kinds) for _ in range(r.randrange(1, 6))]
        run = conversations.Repair(("c", False))
        for k, (role, gone, cut) in enumerate(rows):
            run.add(k, role, "" if gone else f"t{k}" + "." * (not cut), conversations.BLANK if gone else conversations.TRUNCATED if cut else 0)
        got = run.end()
        cost, audit, roles = brute_audit(rows)
        assert (got[7], got[8]) == (cost, audit), rows


def brute_conversation(rows):
    """Faults, edits and digest of the damaged rows of one conversation, through the brute-force audit."""
    seen, facts, faults = set(), [], [0, 0, 0]
    for turn, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults["bdt".index(fault)] += 1
        facts.append((role, fault in ("b", "d") and fault != "", fault == "t"))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, roles = brute_audit(facts) if rows else (0, "", [])
    texts, at = [], 0
    for letter in audit:
        if letter == "I":
            texts.append("")
        else:
            if letter != "D":
                texts.append(rows[at][2])
            at += 1
    whole = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts))
    return gaps, *faults, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()


def damage(rows):
    """By conversation, its rows after damage in order of turn, nulls first."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        s = lambda x: " " if x is None else x
        kind, role, text = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20, s(role), s(text)
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for k, v in out.items()}


ODD = [(900, 0, None, None), (900, None, "user", "No turn."), (900, 5, "user", "  \t"), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hm"), (None, 2, "assistant", "Hm"), (901, 3, "", "x."), (901, 4, "Tool", "é日本."), (902, 0, "user", "y" * 100_000 + "!"),
       (903, 1, "user", "Same."), (903, 2, "user", "Same."), (903, 3, "user", "Same.")]


def test_repair_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + ODD
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("x") for c in ("key", "fault", "gone", "_h1", "kind", "copy", "audit")})
    got = {r[0]: tuple(r)[1:] for r in conversations.summary(frame).collect()}
    want = {k: brute_conversation(v) for k, v in damage(rows).items()}
    assert got == want


def test_repaired_rows_give_the_digest(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + ODD
    hurt = conversations.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    texts = {}
    for r in sorted(conversations.repaired_rows(hurt).collect(), key=lambda r: r.place):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in conversations.repair(hurt).collect():
        assert hashlib.sha256("\n".join(texts.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_giant_conversation_spills_and_crosses_batches(spark):
    r = random.Random(8)
    rows = [(1, i, r.choice(["user", "assistant", "system"]), r.choice(["", "a.", "b", f"turn {i}."]), False) for i in range(9000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, gone boolean")
    wide, = conversations.repair(frame).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        narrow, = conversations.repair(frame, spill_bytes=400).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert wide == narrow and len(wide.audit.replace("I", "")) == 9000


def test_repair_of_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.summary(empty).count() == 0 and conversations.repaired_rows(conversations.damaged(empty)).count() == 0


# --- token counts
TEXTS = [None, "", "word " * 3000, "x" * 5000, " " * 4000, "a\n\n  b" * 900, "don't " * 800, "日本語 テキスト。" * 500, "<|endoftext|>" * 200, "tail<|endoftext|> and <|endof text|>" * 150, "we're'll " * 700, "1234567890" * 400, "　 \t" * 900 + "end", "é\U0001F600 " * 700]


def library_counts(texts, name):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 10), (200, 40), (64, 64), (1000, 30)])
def test_counts_match_the_library(spark, chunk, overlap):
    r = random.Random(chunk)
    texts = TEXTS + ["".join(r.choice(["a", " ", "  ", "\n", "é", "'", "s", "'re", "7", "!", "<|endoftext|>", "<|", "|>", "日", "word "]) for _ in range(r.randrange(600))) for _ in range(40)]
    rows = docs_frame(spark, list(enumerate(texts)) + [(3, texts[3]), (None, texts[3])]).withColumns({c: F.lit(1) for c in ("row", "first", "n_tokens", "body", "at")})
    got = token_counts.count_tokens(rows, tokenizer_path(), chunk, overlap).collect()
    want = list(zip(range(len(texts)), [len((x or "").encode()) for x in texts], library_counts(texts, "byte_bpe_50k.json")))
    assert sorted(map(tuple, got), key=str) == sorted(want + [want[3], (None, *want[3][1:])], key=str)


def test_counts_of_other_vocabularies_and_empty_table(spark):
    import sentencepiece

    texts = ["Hello  World", "", None, "x " * 500, "naïve <s> café"]
    rows = docs_frame(spark, list(enumerate(texts)))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, tokenizer_path("word_bpe_49k.json"), 50, 10).collect()}
    assert [got[i] for i in range(5)] == library_counts(texts, "word_bpe_49k.json")
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert [got[i] for i in range(5)] == [len(model.encode(x or "")) for x in texts]
    assert token_counts.count_tokens(docs_frame(spark, []), tokenizer_path()).count() == 0


def test_whole_table_matches_the_library(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in token_counts.summary(spark.read.parquet(f"{DATA}/documents.parquet"), tokenizer_path()).collect()}
    assert got == dict(zip([r.doc_id for r in rows], library_counts([r.text for r in rows], "byte_bpe_50k.json")))
