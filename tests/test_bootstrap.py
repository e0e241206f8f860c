"""Replicates against rows that are really repeated."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.operators import bootstrap as B

N_BOOT = 60


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    v = np.round(rng.standard_t(3, size=3000), 2)
    v[:900] = 0.25  # a value that many rows share
    return [(i, "a" if i % 3 else None, None if i == 17 else float(x), float(x) ** 2) for i, x in enumerate(v)] + [(5000, "tiny", 1.5, 1.0), (5001, "tiny", -2.0, 1.0)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "obj long, k string, v double, s double").repartition(6)


@pytest.fixture(scope="module")
def drawn(spark, frame):
    w = {r["obj"]: (r["_w0"], r["_w1"]) for r in B.with_words(frame, "obj", 5).collect()}
    return lambda obj: B.copies(*(np.array([x]) for x in w[obj]), np.arange(N_BOOT))[0].astype(int)


def repeated(rows, drawn, k, rep, column):
    return np.repeat([r[column] for r in rows if r[1] == k and r[column] is not None], [drawn(r[0])[rep] for r in rows if r[1] == k and r[column] is not None])


def test_copies_are_poisson_and_differ_between_replicates(spark):
    w = B.with_words(spark.range(4000).withColumnRenamed("id", "obj"), "obj", 1).collect()
    c = B.copies(np.array([r["_w0"] for r in w]), np.array([r["_w1"] for r in w]), np.arange(300))
    assert c.mean() == pytest.approx(1, abs=0.01) and c.var() == pytest.approx(1, abs=0.02) and (c == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    between = np.corrcoef(c.T)[np.triu_indices(300, 1)]
    assert abs(between.mean()) < 0.003 and between.std() == pytest.approx(1 / np.sqrt(4000), rel=0.1)


def test_means_equal_those_of_repeated_rows(frame, rows, drawn):
    got = {(r.k, r.rep): r for r in B.replicate_means(frame, "obj", ["k"], ["v", "s"], N_BOOT, 5).collect()}
    assert len(got) == 3 * N_BOOT
    for k in ("a", None):
        for rep in (0, 31, 59):
            assert got[k, rep].v == pytest.approx(repeated(rows, drawn, k, rep, 2).mean()) and got[k, rep].s == pytest.approx(repeated(rows, drawn, k, rep, 3).mean())


@pytest.mark.parametrize("width", [8.0, 0.3])
def test_median_and_mad_of_every_replicate(frame, rows, drawn, width, monkeypatch):
    monkeypatch.setattr(B, "HOT_VALUE", 100)
    got = {(r.k, r.rep): r for r in B.replicate_nmad(frame, "obj", ["k"], "v", N_BOOT, 5, width).collect()}
    for k in ("a", None, "tiny"):
        for rep in range(N_BOOT):
            x = repeated(rows, drawn, k, rep, 2)
            if not len(x):
                assert got[k, rep].med is None and got[k, rep].nmad is None
                continue
            assert got[k, rep].med == pytest.approx(np.median(x), abs=1e-12), (k, rep)
            assert got[k, rep].nmad == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))), abs=1e-12), (k, rep)


def test_few_rows_reach_the_ordering_task(spark):
    """The rows within the brackets grow as the square root of the group."""
    df = spark.range(40_000).select(F.col("id").alias("obj"), F.randn(3).alias("v"))
    b = B._brackets(df, [], F.col("v"), 8.0).first()
    assert df.where(F.col("v").between(b.lo, b.hi)).count() < 0.05 * 40_000


def test_columns_of_a_row_share_its_draws(spark, rows, drawn):
    """one pass over the rows for all columns; missing values, values of many rows and a column without any."""
    df = spark.createDataFrame([(i, v, None if i % 4 == 0 else float(i % 5), None) for i, k, v, _ in rows if k == "a"], "obj long, v double, w double, z double").repartition(3)
    got = {(r["column"], r.rep): r for r in B.replicate_nmads(df, "obj", [], ["v", "w", "z"], N_BOOT, 5).collect()}
    assert len(got) == 2 * N_BOOT
    held = df.collect()
    for c in "vw":
        for rep in (0, 7, 31, 59):
            some = [r for r in held if r[c] is not None]
            x = np.repeat([r[c] for r in some], [drawn(r.obj)[rep] for r in some])
            assert got[c, rep].med == np.median(x) and got[c, rep].nmad == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))), abs=1e-12)
