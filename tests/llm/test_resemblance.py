"""Groups by resemblance against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from photonloom.llm import resemblance


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def _expected(rows):
    sets = [(d, _shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(d):
        return d if root[d] == d else find(root[d])

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in sets}


def _corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [None, "", " \n", "One two", "one  TWO", "one two three", "é é é é é"]
    for size, variants in ((40, 60), (120, 60), (400, 10)):
        base = [word() for _ in range(size)]
        for k in range(variants):
            own = list(base)
            for _ in range(rng.randrange(1 + size // 25)):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own if k % 9 else base))
    texts += [" ".join(word() for _ in range(60)) for _ in range(40)]
    return list(enumerate(texts))


@pytest.mark.parametrize("limit", [64, 4])
def test_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(resemblance, "PAIR_LIMIT", limit)
    monkeypatch.setattr(resemblance, "SHARE", 5)
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in resemblance.groups(docs).collect()} == _expected(rows)


def test_one_of_each_keeps_columns_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text, "a"), (7, text.upper(), "b"), (None, text, "c"), (None, "alone", "d"), (8, text + " x", "e"), (9, None, None), (10, "", "f")], "doc_id bigint, text string, node string")
    kept = resemblance.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.node or "") for r in kept.collect()) == [(-1, "d"), (3, "a"), (9, "")]


def test_repeats_in_a_line_do_not_hide_a_link(spark):
    rng = random.Random(43)
    words = [f"w{rng.randrange(4000)}" for _ in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[:6] * 50))]
    prints = [resemblance.bits_of(resemblance.gram_hashes(t.encode().split(), 5)) for _, t in rows]
    assert ((prints[0] ^ prints[1]) % (1 << 64)).bit_count() > 26 and set(_expected(rows).values()) == {1}
    got = resemblance.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == _expected(rows)


@pytest.mark.parametrize("limit", [64, 8])
def test_links_within_one_large_bucket(spark, monkeypatch, limit):
    """All texts share one word of minima and no other, as a large family of near copies may."""
    rows = [(i, t) for i, t in _corpus() if t and len(t.split()) > 2]
    alone = resemblance.sketches
    monkeypatch.setattr(resemblance, "sketches", lambda *a: alone(*a).withColumn("bands", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(resemblance, "PAIR_LIMIT", limit)
    got = resemblance.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == _expected(rows)
