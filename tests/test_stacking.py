"""Combination families on moments against fits to the rows themselves."""

import numpy as np
import pytest

from photonloom.operators import stacking as K

LAYOUT = K.Layout(("m1", "m2", "m3"), ("a", "b"))
SIGMA = {"a": 2.0, "b": 0.5}
CANDIDATES = [K.Candidate("uniform"), K.Candidate("convex"), K.Candidate("convex", regularization=0.3, scope="global"), K.Candidate("positive"), K.Candidate("positive", alpha=0.02, l1_ratio=0.7),
              K.Candidate("ridge", alpha=2.0, inputs="same", covariate=True), K.Candidate("ridge", alpha=0.5, inputs="all", covariate=True, disagreement=True), K.Candidate("ridge", alpha=5.0, inputs="same", disagreement=True)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 203
    z = rng.normal(size=n)
    y = {"a": 3 + rng.normal(size=n), "b": rng.normal(size=n) - z}
    p = {(t, m): y[t] + s * rng.normal(size=n) + 0.1 * z for t in "ab" for m, s in (("m1", 0.3), ("m2", 0.5), ("m3", 1.0))}
    return n, z, y, p


@pytest.fixture(scope="module")
def vectors(spark, rows):
    n, z, y, p = rows
    long = [(i, t, m, float(y[t][i]), float(p[t, m][i]), float(z[i])) for i in range(n) for t in "ab" for m in LAYOUT.members] + [(9999, "a", "m1", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(long, "obj_id long, target string, family string, y double, pred double, z double").repartition(5)
    return K.object_vectors(df, "obj_id", LAYOUT, SIGMA, "z")


def brute_fit(c, x):
    """A function from rows to predictions, fitted to the rows x."""
    def inputs(v, j):
        of = [j] if c.inputs == "same" else [0, 1]
        return np.column_stack([v[:, LAYOUT.predictions(t)] for t in of] + ([v[:, LAYOUT.covariate]] if c.covariate else []) + ([v[:, LAYOUT.disagreement(t)] for t in of] if c.disagreement else []))

    fits = []
    for j in range(2):
        own, y = x[:, LAYOUT.predictions(j)], x[:, LAYOUT.label(j)]
        if c.kind == "uniform":
            fits.append(lambda v, j=j: v[:, LAYOUT.predictions(j)].mean(1))
        elif c.kind == "convex":
            of = [0, 1] if c.scope == "global" else [j]
            cost = lambda w, of=of: np.mean([np.mean((x[:, LAYOUT.predictions(t)] @ w - x[:, LAYOUT.label(t)]) ** 2) for t in of]) + c.regularization * ((w - 1 / 3) ** 2).sum()
            fits.append(lambda v, j=j, w=descend(cost, 3, True): v[:, LAYOUT.predictions(j)] @ w)
        elif c.kind == "positive":
            a, b = own - own.mean(0), y - y.mean()
            cost = lambda w, a=a, b=b: 0.5 * np.mean((a @ w - b) ** 2) + c.alpha * (c.l1_ratio * w.sum() + 0.5 * (1 - c.l1_ratio) * (w ** 2).sum())
            fits.append(lambda v, j=j, w=descend(cost, 3, False), m=own.mean(0), b=y.mean(): b + (v[:, LAYOUT.predictions(j)] - m) @ w)
        else:
            i, rest = inputs(x, j), y - own.mean(1)
            mean, std = i.mean(0), i.std(0) + 1e-12
            s = (i - mean) / std
            w = np.linalg.solve(s.T @ s + c.alpha * np.eye(s.shape[1]), s.T @ (rest - rest.mean()))
            fits.append(lambda v, j=j, w=w, mean=mean, std=std, r=rest.mean(): v[:, LAYOUT.predictions(j)].mean(1) + r + (inputs(v, j) - mean) / std @ w)
    return lambda v: np.column_stack([f(v) for f in fits])


def descend(cost, m, simplex):
    """Pattern search from a grid: no use of the library's solver."""
    step, best = 0.25, np.full(m, 1 / m)
    moves = [np.eye(m)[i] - np.eye(m)[j] for i in range(m) for j in range(m) if i != j] + ([] if simplex else [s * np.eye(m)[i] for i in range(m) for s in (1, -1)])
    while step > 1e-9:
        tries = [w for d in moves if (w := best + step * d).min() >= 0]
        w = min(tries, key=cost, default=best)
        if cost(w) < cost(best):
            best = w
        else:
            step /= 2
    return best


def folds_of(vectors, outer, inner, repetitions):
    got = K.fold_cells(vectors, "obj_id", outer, inner, repetitions, 0).collect()
    return np.array([r.x for r in got]), np.array([r.cells for r in got])


def error(c, fit, held):
    return ((brute_fit(c, fit)(held) - held[:, [LAYOUT.label(0), LAYOUT.label(1)]]) ** 2).sum(0)


def test_vectors_leave_incomplete_objects_out(vectors, rows):
    assert vectors.count() == rows[0]


def test_out_of_fold_criterion_of_every_family(vectors):
    x, cells = folds_of(vectors, 4, 1, 1)
    assert sorted(np.bincount(cells[:, 0])) == [50, 51, 51, 51]
    found = K.Moments.of(vectors, "obj_id", LAYOUT, 4).search(CANDIDATES)
    for c, r in zip(CANDIDATES, found):
        brute = sum(error(c, x[cells[:, 0] != f], x[cells[:, 0] == f]) for f in range(4)).mean() / len(x)
        assert r["criterion"] == pytest.approx(brute, rel=1e-5), c


def test_nested_validation_never_sees_the_outer_fold(vectors):
    x, cells = folds_of(vectors, 3, 2, 2)
    some = [CANDIDATES[k] for k in (0, 3, 5)]
    got = K.Moments.of(vectors, "obj_id", LAYOUT, 3, 2, 2).nested(some)
    assert len(got) == 6
    for r in got:
        outer, inner = cells[:, r["repetition"]] // 2, cells[:, r["repetition"]] % 2
        rest = outer != r["outer_fold"]
        scores = [sum(error(c, x[rest & (inner != i)], x[rest & (inner == i)]) for i in range(2)).mean() / rest.sum() for c in some]
        assert r["candidate"] == int(np.argmin(scores)) and r["n"] == (~rest).sum()
        assert r["criterion"] == pytest.approx(error(some[r["candidate"]], x[rest], x[~rest]).mean() / (~rest).sum(), rel=1e-5)
    total = K.nested_summary(got)
    assert total[0]["mean"] == pytest.approx(np.mean([r["criterion"] for r in total])) and total[0]["std"] == pytest.approx(np.std([r["criterion"] for r in total], ddof=1))


def test_predictions_have_the_error_of_the_moments(vectors):
    s = K.Moments.of(vectors, "obj_id", LAYOUT, 1).sum(lambda r, o, i: True)
    w = K.fitted(CANDIDATES[6], s, LAYOUT)
    rows = K.predicted(vectors, w, LAYOUT, SIGMA, "obj_id").collect()
    for j, t in enumerate("ab"):
        assert sum(((r.pred - r.y) / SIGMA[t]) ** 2 for r in rows if r.target == t) == pytest.approx(K.squared_error(w, s, LAYOUT)[j])


def test_left_out_member_equals_a_fit_without_it(vectors):
    m = K.Moments.of(vectors, "obj_id", LAYOUT, 1)
    got = {r["removed"]: r for r in m.without_member(K.Candidate("convex", regularization=0.01))}
    s = m.sum(lambda r, o, i: True)
    r = np.array([s[a, b] - s[a, LAYOUT.label(0)] - s[LAYOUT.label(0), b] + s[LAYOUT.label(0), LAYOUT.label(0)] for a in (2, 3) for b in (2, 3)]).reshape(2, 2) / s[0, 0]
    w = K.simplex_solution(r, 0.01)
    assert got["m1"]["lost"] > 0 and got["m1"]["criterion"] >= (w @ r @ w) / 2


def test_tree_search_uses_the_same_folds(vectors):
    c = K.Candidate("trees", depth=2, iterations=3, covariate=True, disagreement=True)
    got, = K.tree_search(vectors, "obj_id", [c], LAYOUT, SIGMA, 2)
    cells = K.fold_cells(vectors, "obj_id", 2, 1, 1, 0).selectExpr("obj_id", "x", "cells[0] AS f")
    parts = [K.tree_predictions(cells, f"f <> {f}", c, LAYOUT, SIGMA, "f").where(f"f = {f}").collect() for f in range(2)]
    assert sum(map(len, parts)) == 2 * 203
    assert got["criterion"] == pytest.approx(np.mean([((r.pred - r.y) / SIGMA[r.target]) ** 2 for p in parts for r in p]), rel=1e-6)


def test_solutions_of_many_members_meet_their_conditions():
    rng = np.random.default_rng(7)
    for m in (1, 2, 3, 14, 25):
        r = rng.normal(size=(m, 400)) * rng.uniform(0.5, 3, size=(m, 1)) + rng.normal(size=400)
        g = r @ r.T / 400
        for reg in (0.0, 0.1, 1e6):
            w = K.simplex_solution(g, reg)
            slope = g @ w + reg * (w - 1 / m)
            assert w.min() >= 0 and w.sum() == pytest.approx(1)
            assert (slope >= slope[w > 0].max() - 1e-7 * max(1, reg)).all()
        q, c = g, rng.normal(size=m)
        b = K.positive_solution(q, c)
        assert b.min() >= 0 and (c - q @ b <= 1e-9).all() and np.abs((c - q @ b)[b > 0]).max(initial=0) < 1e-9
    assert K.simplex_solution(g, 1e6) == pytest.approx(np.full(25, 1 / 25), abs=1e-4)


def test_candidate_table(spark):
    table = spark.createDataFrame([(1, "ridge", 3.0, "same"), (0, "uniform", None, None)], "candidate int, kind string, alpha double, inputs string")
    assert K.candidates_of(table) == [K.Candidate("uniform"), K.Candidate("ridge", alpha=3.0, inputs="same")]
    with pytest.raises(ValueError):
        K.Candidate("forest")


def test_errors_of_every_value_from_one_pass(spark, vectors, rows):
    """fits and errors by split come from one reading of the rows, and equal those of the rows themselves."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    d = vectors.selectExpr("x", "CASE obj_id % 3 WHEN 0 THEN 'u' WHEN 1 THEN 'v' ELSE 'other' END AS split").mapInArrow(counted, "x array<double>, split string")
    m = K.Moments.by_value(d, LAYOUT, "split", ("v", "none", "u"))
    w = K.fitted(CANDIDATES[-2], m.sum(lambda r, o, i: o == 2), LAYOUT)
    got = K.errors_by_value(m, w, SIGMA, ("v", "none", "u"))
    assert read.value == rows[0]
    for value, rest in (("u", 0), ("v", 1)):
        x = np.array([r.x for r in vectors.where(f"obj_id % 3 = {rest}").collect()])
        e = x @ w.T - x[:, [LAYOUT.label(j) for j in range(2)]]
        want = [(value, t, len(x), pytest.approx(np.sqrt((e[:, j] ** 2).mean()) * SIGMA[t], rel=1e-9)) for j, t in enumerate("ab")]
        assert [r for r in got if r[0] == value] == want
    assert {r[0] for r in got} == {"u", "v"}
    read.value = 0
    assert K.Moments.of(vectors.select("obj_id", "x").mapInArrow(counted, "obj_id long, x array<double>"), "obj_id", LAYOUT, 1).sum(lambda r, o, i: True)[0, 0] == rows[0] == read.value


def test_vectors_of_runs_meet_before_the_shuffle(spark, rows):
    """the rows of an object become one in the partition where they lie; vectors equal those of members' means, objects that lack a run go."""
    n, z, y, p = rows
    runs = [(m, s) for m in LAYOUT.members for s in (1, 2)]
    wide = [(i, m, s, float(z[i]), *[float(y[t][i]) for t in "ab"], *[float(p[t, m][i]) + (0.25 if s == 1 else -0.25) for t in "ab"]) for i in range(n) for m, s in runs if not (i == 7 and (m, s) == ("m2", 1))]
    df = spark.createDataFrame(wide, "obj_id long, family string, seed int, z double, y_a double, y_b double, pred_a double, pred_b double").coalesce(1)
    long = [(i, t, m, float(y[t][i]), round(float(p[t, m][i]), 6), float(z[i])) for i in range(n) if i != 7 for t in "ab" for m in LAYOUT.members]
    want = {r.obj_id: r.x for r in K.object_vectors(spark.createDataFrame(long, "obj_id long, target string, family string, y double, pred double, z double"), "obj_id", LAYOUT, SIGMA, "z").collect()}
    found = K.run_vectors(df, "obj_id", LAYOUT, SIGMA, "z", runs)
    got = {r.obj_id: r.x for r in found.collect()}
    assert sorted(got) == sorted(want) and 7 not in got
    assert all(np.allclose(got[i], want[i], atol=3e-6, rtol=0) for i in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") <= 1
