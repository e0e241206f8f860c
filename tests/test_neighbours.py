"""The pruned neighbour join against brute force, on data with and without structure."""

import numpy as np
import pytest

from photonloom.operators.neighbours import nearest, nearest_with_visits


def frame(spark, v):
    return spark.createDataFrame([(i, [float(y) for y in x], float(i % 7)) for i, x in enumerate(v)], "obj long, v array<double>, p double")


def brute(q, r, k, exclude_self):
    out = {}
    for i, x in enumerate(q):
        d = np.sqrt(((r - x) ** 2).sum(1))
        order = sorted((d[j], j) for j in range(len(r)) if not (exclude_self and i == j))[:k]
        out[i] = [(j, pytest.approx(e, abs=1e-9)) for e, j in order]
    return out


def clustered(n, seed=0, dims=4, per=40):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 200, size=(max(1, n // per), dims))[rng.integers(0, max(1, n // per), n)] + rng.normal(size=(n, dims))


@pytest.mark.parametrize("block_rows", [13, 5000])
@pytest.mark.parametrize("data", ["clustered", "noise", "copies", "line"])
def test_equals_brute_force(spark, data, block_rows):
    rng = np.random.default_rng(1)
    v = {"clustered": lambda: clustered(300), "noise": lambda: rng.normal(size=(300, 16)), "copies": lambda: np.repeat(rng.normal(size=(4, 3)), [150, 100, 40, 10], axis=0),
         "line": lambda: np.arange(300.0)[:, None]}[data]()
    got = {}
    for r in nearest(frame(spark, v), frame(spark, v), "obj", "v", "p", 5, True, block_rows).orderBy("obj", "position").collect():
        got.setdefault(r.obj, []).append((r.neighbour, r.distance))
    assert got == brute(v, v, 5, True)


def test_queries_outside_the_reference_and_too_few_rows(spark):
    v, q = clustered(60), clustered(20, 5)
    got = nearest(frame(spark, q), frame(spark, v), "obj", "v", "p", 100, False, 10).collect()
    assert len(got) == 20 * 60
    assert nearest(frame(spark, q), frame(spark, v).where("obj < 0"), "obj", "v", "p", 3).count() == 0
    assert nearest(frame(spark, q).where("obj < 0"), frame(spark, v), "obj", "v", "p", 3).count() == 0


def test_visited_blocks_grow_about_linearly(spark):
    """With four times the rows each query still sees about as many blocks."""
    per_query = {}
    for n in (1500, 6000):
        df = frame(spark, clustered(n))
        found, visits = nearest_with_visits(df, df, "obj", "v", "p", 5, True, 50)
        assert found.count() == 5 * n
        per_query[n] = visits.count() / n
    assert per_query[6000] < 1.5 * per_query[1500] + 1 and per_query[6000] < 12  # of 120 blocks


def test_rows_sent_do_not_grow_with_the_blocks(spark, monkeypatch):
    """on noise a query has to see all blocks; its vector goes once to each tile of them, and its neighbours are exact."""
    from photonloom.operators import neighbours as N

    monkeypatch.setattr(N, "VISIT_ROWS", 50, raising=False)
    v = np.random.default_rng(2).normal(size=(400, 16)).astype(np.float32).astype(float)
    df = frame(spark, v).selectExpr("obj", "CAST(v AS array<float>) AS v", "p AS payload")
    pivots = N.pivots_of(df, "obj", "v", 40)
    blocks, known = N.blocks_of(N._celled(df, "obj", "v", pivots), 10)
    own = N._visits(N._celled(df.select("obj", "v"), "obj", "v", pivots), pivots, known, True, 5)
    n_blocks, sent = len(known["n"]), N._visits(own, pivots, known, False, 5).count()
    assert n_blocks >= 40 and 400 < sent <= 400 * -(-n_blocks // 16)
    found, visits = nearest_with_visits(df.withColumnRenamed("payload", "p"), df.withColumnRenamed("payload", "p"), "obj", "v", "p", 5, True, 10)
    assert visits.count() > 400 * (n_blocks // 2) and visits.distinct().count() == visits.count()
    got = {}
    for r in found.orderBy("obj", "position").collect():
        got.setdefault(r.obj, []).append((r.neighbour, r.distance))
    assert got == brute(v, v, 5, True)
