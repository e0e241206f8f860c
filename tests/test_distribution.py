import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.operators import distribution as D

PROBS = {"p10": 0.1, "p50": 0.5, "p84": 0.84}


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(np.round(x, 1)), float(y)) for x, y in rng.normal(size=(400, 2))]  # many ties
    rows += [("b", 2.0, float(i)) for i in range(300)] + [("b", float(i), 1.0) for i in range(20)]  # a hot value
    rows += [("c", 5.0, 1.0)]
    return rows, spark.createDataFrame(rows, "k string, x double, y double")


def test_order_statistics_agree_with_numpy(data):
    rows, df = data
    q = {r["k"]: r for r in D.quantiles(df, ["k"], "x", PROBS).collect()}
    m = {r["k"]: r for r in D.median_and_mad(df, ["k"], "x").collect()}
    for k in "abc":
        v = np.array([x for kk, x, _ in rows if kk == k])
        for n, p in PROBS.items():
            assert q[k][n] == pytest.approx(np.quantile(v, p))
        nmad = 1.4826 * np.median(np.abs(v - np.median(v)))
        assert m[k]["med"] == pytest.approx(np.median(v)) and m[k]["nmad"] == pytest.approx(nmad)
        assert m[k]["outlier_frac"] == pytest.approx(np.mean(np.abs(v - np.median(v)) > 3 * nmad))


def test_spearman_and_ks(data):
    rows, df = data
    s = {r["k"]: r["spearman"] for r in D.spearman(df.where("k = 'a'"), ["k"], "x", "y").collect()}
    a = np.array([(x, y) for kk, x, y in rows if kk == "a"])
    assert s["a"] == pytest.approx(np.corrcoef(ranks(a[:, 0]), ranks(a[:, 1]))[0, 1])
    ks = D.ks_statistic(df.where("k <> 'c'").withColumn("g", F.lit("g")), ["g"], F.col("k") == "a", "x").first()
    one, two = (np.array([x for kk, x, _ in rows if kk == k]) for k in "ab")
    want = max(abs((one <= v).mean() - (two <= v).mean()) for v in np.concatenate([one, two]))
    assert ks["ks"] == pytest.approx(want) and (ks["n1"], ks["n2"]) == (len(one), len(two))


def test_global_rank_is_a_permutation(data):
    rows, df = data
    d = df.withColumn("i", F.monotonically_increasing_id())
    got = D.global_rank(d, ["k"], ["x", "i"]).where("k = 'b'").orderBy("rank0").collect()
    assert [r["rank0"] for r in got] == list(range(len(got)))
    assert all(a["x"] <= b["x"] for a, b in zip(got, got[1:]))


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 5), ("a", 9.0, 2)], "k string, v double, w int")
    assert D.quantiles(df, ["k"], "v", {"m": 0.5}, weight="w").first()["m"] == np.median([1, 2, 2, 2, 2, 2, 9, 9])


def test_missed_brackets_are_widened_and_null_groups_kept(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(None if i % 4 else "a", float(x)) for i, x in enumerate(rng.normal(size=5000))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    monkeypatch.setattr(D, "SKETCH", 10)  # a sketch off by a tenth of the group
    cut, tries = D._condensed, []
    monkeypatch.setattr(D, "_condensed", lambda d, keys, probs, spread: (tries.append(spread), cut(d, keys, probs, spread * 1e-3 if len(tries) == 1 else spread))[1])
    got = {r["k"]: r for r in D.quantiles(df, ["k"], "x", PROBS).collect()}
    for k in ("a", None):
        for n, p in PROBS.items():
            assert got[k][n] == pytest.approx(np.quantile([x for kk, x in rows if kk == k], p))
    assert len(tries) >= 1


def test_condensed_table_is_small(spark):
    d = spark.range(200_000).select(F.lit("g").alias("k"), F.rand(1).alias("_x"))
    t = D._condensed(d, ["k"], {"a": 0.5, "b": 0.9}, 1.0)
    assert t.count() < 500 and t.agg(F.sum("_n_at")).first()[0] == 200_000


def test_rows_read_several_times_are_stored_once_in_columns(spark, monkeypatch):
    """residuals were written three times, as whole rows, and every pass read all their columns."""
    from photonloom import session
    from photonloom.operators import distribution, metrics

    stored = []
    for module in (metrics, distribution):
        monkeypatch.setattr(module, "kept_rows", lambda df: stored.append(session.kept_rows(df)) or stored[-1])
    df = spark.range(1000).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS k", "double(id % 7) AS y", "double(id % 11) AS pred")
    got = {r["k"]: r for r in metrics.regression_metrics(df, ["k"], rank=False).collect()}
    assert len(stored) == 1 and set(got) == {1, 2} and got[1]["n"] == 333
    plan = stored[0].select("r")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<r:double>" in plan
    rho = {r["k"]: r["spearman"] for r in distribution.spearman(df, ["k"], "y", "pred").collect()}
    assert set(rho) == {None, 1, 2}
