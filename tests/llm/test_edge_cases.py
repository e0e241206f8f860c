"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

import corpus_pipeline
from photonloom.llm import decontaminate, lines, neighbours, orc_tokens, packing, pii, quality, sharding, simhash, substrings
from photonloom.llm.common import tokenizer_path

DOCS = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
CLASHES = ("_doc", "text_key", "_row", "_score", "fp", "gone", "line", "pos", "kept")
LONG = "x" * 60_000
PASSAGE = " ".join(f"word{i}" for i in range(40))


def odd_rows():
    return [
        (None, "no id here", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, LONG, "en", "s", 1), (4, PASSAGE, "en", "s", 1), (5, PASSAGE, None, None, None),
        (5, PASSAGE, None, None, None), (6, PASSAGE + " tail", "en", "s", 1), (7, "  \n\n \t ", "en", "s", 1), (8, "a " * 5000, "en", "s", 1), (9, "é ü\n日本 語", "xx", "s", 1), (9, "same id, other text", "xx", "s", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None), (6, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "Tail"), (4, "Tail"), (None, "other TEXT")], "item_id bigint, text string")


SUMMARIES = {
    "pii": lambda d, la, b: pii.summary(d), "sharding": lambda d, la, b: sharding.shard_documents(d, 3, 64), "quality": lambda d, la, b: quality.summary(d, la), "simhash": lambda d, la, b: simhash.summary(d),
    "substrings": lambda d, la, b: substrings.summary(d), "orc": lambda d, la, b: orc_tokens.summary(d, tokenizer_path()), "lines": lambda d, la, b: lines.summary(d), "decontaminate": lambda d, la, b: decontaminate.summary(d, b),
}


@pytest.mark.parametrize("name", SUMMARIES)
def test_one_row_per_row(name, odd, labels, benchmark):
    clash = odd.select("*", *[odd.n_chars.alias(c) for c in CLASHES])
    assert SUMMARIES[name](clash, labels, benchmark).count() == len(odd_rows())


@pytest.mark.parametrize("name", SUMMARIES)
def test_empty_table(name, empty, labels, benchmark):
    assert SUMMARIES[name](empty, labels, benchmark).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(name, stage, odd, empty, labels, benchmark, spark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = odd.select("*", *[odd.n_chars.alias(c) for c in CLASHES])
    out = stage(spark, clash, str(tmp_path))
    assert out.dtypes == clash.dtypes
    assert 0 < out.count() <= len(odd_rows())
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_packing_of_odd_rows(odd, empty):
    rows = packing.place(packing.cut_documents(odd, tokenizer_path())).collect()
    assert sum(r.piece == 0 for r in rows) == len(odd_rows())
    assert all(r.start == 0 and r.length == 1 and r.ids_crc32 == zlib.crc32((2).to_bytes(4, "little")) for r in rows if r.doc_id in (1, 2))
    assert packing.place(packing.cut_documents(empty, tokenizer_path())).count() == 0


def test_repeated_passage_ties(odd):
    got = {}
    for r in substrings.summary(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[4] == [(40, 0)]  # the first
    assert got[5] == [(40, 40), (40, 40)]  # rows alike, both later than 4
    assert got[6] == [(41, 40)]
    assert got[8] == [(5000, 4999)]  # one run of a word: every window but the first repeats, and they cover all words but one


def test_rows_of_one_id_and_text_do_not_remove_each_other(spark):
    twins = spark.createDataFrame([(1, PASSAGE, "", "", 0)] * 2, DOCS)
    assert [r.n_removed for r in substrings.summary(twins).collect()] == [0, 0]
    assert [r.n_dropped for r in lines.summary(twins).collect()] == [0, 0]


@pytest.mark.parametrize("parts", [1, 9])
def test_rows_of_one_id_in_one_task(spark, parts):
    """Rows that share id and text, or an id and a passage at one place, are of equal rank, however they are dealt."""
    rows = [(3, PASSAGE), (3, PASSAGE), (None, "n " + PASSAGE), (None, "n " + PASSAGE), (7, PASSAGE + " of another end"), (7, PASSAGE), (2, "x y " + PASSAGE), (2, "z " + PASSAGE), (1, " ".join(f"other{i}" for i in range(30)))]
    for rows, want in ((rows[:2], [(3, 0)] * 2), (rows[4:6], [(7, 0)] * 2), (rows[6:8], [(2, 0), (2, 40)]), (rows, [(0, 0)] * 2 + [(1, 0)] + [(2, 40)] * 2 + [(3, 40)] * 2 + [(7, 40)] * 2)):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9).coalesce(parts)
        assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.summary(docs).collect()) == want


def test_lines_of_odd_rows(odd):
    got = {}
    for r in lines.summary(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].n_lines == 0 and got[1][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.n_dropped for r in got[5]] == [1, 1] and got[7][0].n_dropped == 0
    assert got[6][0].n_near == 1  # a word longer than the line of document 4


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0]
    rows = [Row(vec_id=i, embedding=v) for i, v in ((0, same), (1, same), (2, same), (2, same), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [None, 1.0]), (8, [1.0]), (None, same), (20, [-1.0, 0.0]))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, neighbours.summary(table).collect()))
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0), (20, 3, 2, -1.0)]
    assert neighbours.summary(table.limit(0)).count() == 0
