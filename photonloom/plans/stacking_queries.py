"""Queries: combination families, their search and nested validation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from photonloom.operators import stacking as K
from photonloom.plans.bindings import ALIGNED_SQL, FAMILIES, MEMBERS, PRED_SQL, SCALE_SQL, TARGETS, pred_wide, with_sql
from photonloom.plans.ensemble_queries import sigma_of
from photonloom.plans.registry import Tables, query
from photonloom.plans.split_queries import h_sql

LAYOUT = K.Layout(FAMILIES, TARGETS)
SIZE, M, J = LAYOUT.size, len(FAMILIES), len(TARGETS)
OUTER, INNER, REPETITIONS = 5, 4, 3
SPLITS = ("Train", "Validation", "Test")

#: A candidate table as a user would keep it: one row per configuration.
CANDIDATE_ROWS = [{"kind": "uniform"}] + [{"kind": "convex", "regularization": r, "scope": s} for r in (0.0, 0.01, 1.0) for s in ("target", "global")] \
    + [{"kind": "positive", "alpha": a, "l1_ratio": b} for a, b in ((0.0, 0.5), (0.001, 0.5), (0.01, 0.9))] \
    + [{"kind": "ridge", "alpha": a, "inputs": i, "covariate": z, "disagreement": d} for a in (1.0, 100.0) for i, z, d in (("same", True, False), ("same", True, True), ("all", False, False), ("all", True, True))]
_FIELDS = "candidate int, kind string, regularization double, scope string, alpha double, l1_ratio double, inputs string, covariate boolean, disagreement boolean"


def candidate_table(t: Tables, rows=CANDIDATE_ROWS):
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    return t.spark.createDataFrame([tuple({"candidate": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], _FIELDS)


def vectors(t: Tables, rows: str, *keep: str):
    return of_files(t, rows, sigma_of(t), *keep)


def of_files(t: Tables, rows: str, sigma: dict[str, float], *keep: str):
    return K.run_vectors(pred_wide(t).where("y_d4000 IS NOT NULL").where(rows), "obj_id", LAYOUT, sigma, "redshift", [(f, s) for f, _, s in MEMBERS], *keep)


def moments_by_split(t: Tables):
    """The moments of every split, their sum outside the test split, and sigma: one pass, whatever is fitted and scored from them."""
    sigma = sigma_of(t)
    m = K.Moments.by_value(of_files(t, "true", sigma, "split"), LAYOUT, "split", SPLITS)
    return m, m.sum(lambda r, o, i: SPLITS[o] != "Test"), sigma


# --- the independent statement: normal equations solved by elimination, active sets by trying every support -------------------
def _cell(target: str, value: str, family: str | None = None) -> str:
    return f"(max({value}) FILTER (target = '{target}'" + (f" AND family = '{family}'" if family else "") + f") / max(sigma) FILTER (target = '{target}'))"


def _vector_sql(where: str) -> str:
    p = [_cell(t, "pred", f) for t in TARGETS for f in FAMILIES]
    own = [p[j * M:(j + 1) * M] for j in range(J)]
    spread = [f"list_stddev_pop([{', '.join(x)}])" for x in own]
    x = ["1.0", *p, *spread, "max(redshift)", *[_cell(t, "y") for t in TARGETS]]
    return f"vec AS (SELECT obj_id, split, [{', '.join(x)}]::DOUBLE[] AS x FROM family_mean JOIN scale USING (target) WHERE {where} GROUP BY obj_id, split)"


def _cells_sql(repetitions: int) -> str:
    """Moments by repetition and nested fold, as flat lists."""
    return f"""ranked AS (SELECT rep, x, row_number() OVER (PARTITION BY rep ORDER BY {h_sql('obj_id', 0, 'rep')}, obj_id) - 1 AS k FROM vec, range(0, {repetitions}) g(rep)),
cells AS (SELECT rep, k % {OUTER} AS o, (k // {OUTER}) % {INNER} AS i, a, b, sum(x[a] * x[b]) AS v FROM ranked, range(1, {SIZE + 1}) p(a), range(1, {SIZE + 1}) q(b) GROUP BY ALL)"""


def _flat(source: str) -> str:
    return f"list(v ORDER BY a, b) AS s FROM ({source}) GROUP BY"


def _candidates_sql(rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    full = [{"regularization": 0.0, "scope": "target", "alpha": 0.0, "l1_ratio": 0.5, "inputs": "all", "covariate": False, "disagreement": False, **r, "candidate": i} for i, r in enumerate(rows)]
    return f"cand({', '.join(names)}) AS (VALUES " + ", ".join("(" + ", ".join(lit(r[n]) for n in names) + ")" for r in full) + ")"


def _s(a: int, b: int) -> str:
    return f"s[{a * SIZE + b + 1}]"


def _cov(a: int, b: int) -> str:
    return f"({_s(a, b)} / s[1] - {_s(0, a)} * {_s(0, b)} / (s[1] * s[1]))"


def _gram(j: int, a: int, b: int) -> str:
    y = LAYOUT.label(j)
    return f"(({_s(a, b)} - {_s(a, y)} - {_s(y, b)} + {_s(y, y)}) / s[1])"


def _systems() -> str:
    """One row per linear system: what it belongs to, its support, matrix with right-hand side."""
    out = []
    for j in range(J):
        own = LAYOUT.predictions(j)
        y = LAYOUT.label(j)
        for size in range(1, M + 1):
            for at in combinations(own, size):
                for scope in ("target", "global"):
                    gram = lambda a, b, j=j, scope=scope, own=own: _gram(j, a, b) if scope == "target" else "(" + " + ".join(_gram(k, LAYOUT.predictions(k)[own.index(a)], LAYOUT.predictions(k)[own.index(b)]) for k in range(J)) + f") / {J}"
                    rows = ["[" + ", ".join([f"{gram(a, b)}" + (" + regularization" if a == b else "") for b in at] + ["1", f"regularization / {M}"]) + "]" for a in at]
                    rows.append("[" + ", ".join(["1"] * size + ["0", "1"]) + "]")
                    out.append(f"SELECT id, candidate, {j} AS j, {list(at)} AS support, {size + 1} AS n, [{', '.join(rows)}]::DOUBLE[][] AS a FROM fits, cand WHERE kind = 'convex' AND scope = '{scope}'")
                rows = ["[" + ", ".join([_cov(a, b) + (" + alpha * (1 - l1_ratio)" if a == b else "") for b in at] + [f"{_cov(a, y)} - alpha * l1_ratio"]) + "]" for a in at]
                out.append(f"SELECT id, candidate, {j}, {list(at)}, {size}, [{', '.join(rows)}]::DOUBLE[][] FROM fits, cand WHERE kind = 'positive'")
        for inputs, z, d in (("same", True, False), ("same", True, True), ("all", False, False), ("all", True, True)):
            x = LAYOUT.inputs(K.Candidate("ridge", inputs=inputs, covariate=z, disagreement=d), j)
            std = lambda a: f"(sqrt({_cov(a, a)}) + 1e-12)"
            right = lambda a, own=own, y=y: f"({_cov(a, y)} - (" + " + ".join(_cov(a, p) for p in own) + f") / {M}) / {std(a)}"
            rows = ["[" + ", ".join([f"{_cov(a, b)} / ({std(a)} * {std(b)})" + (" + alpha / s[1]" if a == b else "") for b in x] + [right(a)]) + "]" for a in x]
            out.append(f"SELECT id, candidate, {j}, {x}, {len(x)}, [{', '.join(rows)}]::DOUBLE[][] FROM fits, cand WHERE kind = 'ridge' AND inputs = '{inputs}' AND covariate = {z} AND disagreement = {d}")
    return "systems AS (" + "\n UNION ALL ".join(out) + ")"


def _weights_sql() -> str:
    """(id, candidate, j, w): the fitted linear functions, from `fits` (id, s) and `cand`."""
    own = lambda j: LAYOUT.predictions(j)
    gram_of = "CASE j " + " ".join(f"WHEN {j} THEN {own(j)[0]}" for j in range(J)) + " END"
    full = f"list_transform(range(0, {SIZE}), lambda i: coalesce(b[list_position(support, i)], 0))"
    value = "list_sum(list_transform(range(1, {n} + 1), lambda r: u[r] * list_sum(list_transform(range(1, {n} + 1), lambda c: u[c] * {q}))))"
    centred = f"(s[(r - 1) * {SIZE} + c] / s[1] - s[r] * s[c] / (s[1] * s[1]))"
    label = f"({LAYOUT.label(0) + 1} + j)"
    return f"""{_systems()},
steps AS (SELECT id, candidate, j, support, n, 1 AS k, a FROM systems UNION ALL
  SELECT id, candidate, j, support, n, k + 1, list_transform(a, lambda row, r: CASE WHEN r = k THEN list_transform(row, lambda v: v / a[k][k]) ELSE list_transform(row, lambda v, c: v - row[k] * a[k][c] / a[k][k]) END) FROM steps WHERE k <= n),
solved AS (SELECT id, candidate, j, support, list_transform(a, lambda row: row[n + 1])[1:len(support)] AS b FROM steps WHERE k = n + 1
  UNION ALL SELECT id, candidate, j, [], [] FROM fits, cand, range(0, {J}) g(j) WHERE kind = 'positive'),
spread AS (SELECT id, candidate, j, kind, scope, regularization, alpha, l1_ratio, s, {full} AS u FROM solved JOIN fits USING (id) JOIN cand USING (candidate) WHERE kind = 'ridge' OR len(b) = 0 OR list_min(b) >= 0),
valued AS (SELECT *, CASE kind WHEN 'ridge' THEN 0
  WHEN 'positive' THEN 0.5 * {value.format(n=SIZE, q=centred)} - list_sum(list_transform(range(1, {SIZE} + 1), lambda r: u[r] * (s[(r - 1) * {SIZE} + {label}] / s[1] - s[r] * s[{label}] / (s[1] * s[1])))) + alpha * l1_ratio * list_sum(u) + 0.5 * alpha * (1 - l1_ratio) * list_sum(list_transform(u, lambda v: v * v))
  ELSE list_sum(list_transform(range(0, CASE scope WHEN 'global' THEN {J} ELSE 1 END), lambda t: list_sum(list_transform(range(1, {M} + 1), lambda r: list_sum(list_transform(range(1, {M} + 1), lambda c: u[{gram_of} + r] * u[{gram_of} + c] *
    (s[(CASE scope WHEN 'global' THEN 1 + t * {M} ELSE {gram_of} END + r - 1) * {SIZE} + CASE scope WHEN 'global' THEN 1 + t * {M} ELSE {gram_of} END + c]
     - s[(CASE scope WHEN 'global' THEN 1 + t * {M} ELSE {gram_of} END + r - 1) * {SIZE} + {LAYOUT.label(0)} + 1 + CASE scope WHEN 'global' THEN t ELSE j END]
     - s[(CASE scope WHEN 'global' THEN 1 + t * {M} ELSE {gram_of} END + c - 1) * {SIZE} + {LAYOUT.label(0)} + 1 + CASE scope WHEN 'global' THEN t ELSE j END]) / s[1]))))))
    / CASE scope WHEN 'global' THEN {J} ELSE 1 END + regularization * list_sum(list_transform(u, lambda v: CASE WHEN v <> 0 THEN v * v - 2 * v / {M} ELSE 0 END)) END AS value FROM spread),
picked AS (SELECT id, candidate, j, kind, s, arg_min(u, value) AS u FROM valued GROUP BY id, candidate, j, kind, s
  UNION ALL SELECT id, candidate, j, kind, s, list_transform(range(0, {SIZE}), lambda i: 0.0) FROM fits, cand, range(0, {J}) g(j) WHERE kind = 'uniform'),
descaled AS (SELECT id, candidate, j, kind, s, CASE kind WHEN 'ridge' THEN list_transform(u, lambda v, i: CASE WHEN v = 0 THEN 0 ELSE v / (sqrt(s[(i - 1) * {SIZE} + i] / s[1] - s[i] * s[i] / (s[1] * s[1])) + 1e-12) END) ELSE u END AS u FROM picked),
based AS (SELECT id, candidate, j, kind, s, list_transform(u, lambda v, i: v + CASE WHEN kind IN ('uniform', 'ridge') AND i - 2 >= j * {M} AND i - 2 < (j + 1) * {M} THEN 1.0 / {M} ELSE 0 END) AS u FROM descaled),
weights AS (SELECT id, candidate, j, list_transform(u, lambda v, i: CASE WHEN i = 1 AND kind IN ('positive', 'ridge') THEN (s[{label}] - list_sum(list_transform(u, lambda w, q: w * s[q]))) / s[1] ELSE v END) AS w FROM based)"""


_ERROR = f"list_transform(w, lambda v, i: v - CASE WHEN i = {LAYOUT.label(0) + 1} + j THEN 1 ELSE 0 END)"
_SSE = f"list_sum(list_transform(range(1, {SIZE + 1}), lambda r: e[r] * list_sum(list_transform(range(1, {SIZE + 1}), lambda c: e[c] * h[(r - 1) * {SIZE} + c]))))"


def _errors_sql() -> str:
    """(id, candidate, sse, n): squared errors, mean over the targets, on the held-out moments `held` (id, h)."""
    return f"errors AS (SELECT id, candidate, avg({_SSE}) AS sse, max(h[1]) AS n FROM (SELECT id, candidate, {_ERROR} AS e FROM weights) JOIN held USING (id) GROUP BY id, candidate)"


def _recursive(*ctes: str, body: str) -> str:
    return with_sql(*ctes, body=body).replace("WITH", "WITH RECURSIVE", 1)


SOURCE = [PRED_SQL, ALIGNED_SQL, SCALE_SQL]

E05_ROWS = [{"kind": "positive", "alpha": 0.0}, {"kind": "positive", "alpha": 0.01, "l1_ratio": 0.5}]
_FIT_ALL = "fits AS (SELECT 1 AS id, " + _flat(f"SELECT a, b, sum(x[a] * x[b]) AS v FROM vec, range(1, {SIZE + 1}) p(a), range(1, {SIZE + 1}) q(b) WHERE split <> 'Test' GROUP BY a, b") + " ALL)"
_APPLIED = f"""applied AS (SELECT candidate, split, j, count(*) AS n, avg(pow(list_sum(list_transform(w, lambda v, i: v * x[i])) - x[{LAYOUT.label(0) + 1} + j], 2)) AS mse FROM vec, weights GROUP BY ALL),
names(j, target, sigma) AS (SELECT CASE target """ + " ".join(f"WHEN '{t}' THEN {j}" for j, t in enumerate(TARGETS)) + " END, target, sigma FROM scale)"


@query("e05_positive_stacking", _recursive(*SOURCE, _vector_sql("true"), _FIT_ALL, _candidates_sql(E05_ROWS), _weights_sql(), _APPLIED, body="""
SELECT CASE candidate WHEN 0 THEN 'linear' ELSE 'elastic' END AS kind, target, split, n, round(w[1] * sigma, 5) AS intercept, """ + ", ".join(
    "round(CASE j " + " ".join(f"WHEN {j} THEN w[{LAYOUT.predictions(j)[m] + 1}]" for j in range(J)) + f" END, 5) AS {f}" for m, f in enumerate(FAMILIES)) + """, round(sqrt(mse) * sigma, 5) AS rmse
FROM applied JOIN weights USING (candidate, j) JOIN names USING (j)"""))
def _(t: Tables):
    """Non-negative linear and elastic-net stacking: coefficients, intercept, and the error of the predictions in every split."""
    m, s, sigma = moments_by_split(t)
    rows = []
    for kind, row in zip(("linear", "elastic"), E05_ROWS):
        w = K.fitted(K.Candidate(**row), s, LAYOUT)
        own = {x: (float(w[j, 0] * sigma[x]), *[float(w[j, i]) for i in LAYOUT.predictions(j)]) for j, x in enumerate(TARGETS)}
        rows += [(kind, x, split, n, *own[x], rmse) for split, x, n, rmse in K.errors_by_value(m, w, sigma, SPLITS)]
    out = t.spark.createDataFrame(rows, "kind string, target string, split string, n long, intercept double, " + ", ".join(f"{f} double" for f in (*FAMILIES, "rmse")))
    return out.select("kind", "target", "split", "n", *[F.round(c, 5).alias(c) for c in ("intercept", *FAMILIES, "rmse")])


E06_ROWS = [{"kind": "ridge", "alpha": 1.0, "inputs": i, "covariate": z, "disagreement": d} for i, z, d in (("same", True, False), ("same", True, True), ("all", False, False), ("all", True, True))]


@query("e06_residual_stacking", _recursive(*SOURCE, _vector_sql("true"), _FIT_ALL, _candidates_sql(E06_ROWS), _weights_sql(), _APPLIED, body="""
SELECT inputs, covariate, disagreement, target, split, n, round(sqrt(mse) * sigma, 5) AS rmse FROM applied JOIN cand USING (candidate) JOIN names USING (j)"""))
def _(t: Tables):
    """Ridge correction of the uniform mean from the same or all targets, with covariate and disagreement, fitted outside the test split."""
    m, s, sigma = moments_by_split(t)
    rows = [(row["inputs"], row["covariate"], row["disagreement"], x, split, n, rmse) for row in E06_ROWS
            for split, x, n, rmse in K.errors_by_value(m, K.fitted(K.Candidate(**row), s, LAYOUT), sigma, SPLITS)]
    out = t.spark.createDataFrame(rows, "inputs string, covariate boolean, disagreement boolean, target string, split string, n long, rmse double")
    return out.withColumn("rmse", F.round("rmse", 5))


@query("e06_boosted_stacking")
def _(t: Tables):
    """Boosted trees on all targets' predictions, disagreement and covariate, for every target; no SQL for tree growth."""
    c = K.Candidate("trees", covariate=True, disagreement=True, depth=3, rate=0.1, iterations=20)
    d = K.tree_predictions(vectors(t, "true", "split"), "split <> 'Test'", c, LAYOUT, sigma_of(t), "split")
    e = F.col("pred") - F.col("y")
    return d.groupBy("target", "split").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


_FOLD_FITS = """fits AS (SELECT f AS id, """ + _flat("SELECT f, a, b, sum(v) AS v FROM cells, range(0, 5) g(f) WHERE o <> f GROUP BY ALL") + """ f),
held AS (SELECT o AS id, list(v ORDER BY a, b) AS h FROM (SELECT o, a, b, sum(v) AS v FROM cells GROUP BY ALL) GROUP BY o)"""


@query("e07_out_of_fold_blend", _recursive(*SOURCE, _vector_sql("split = 'Validation'"), _cells_sql(1), _FOLD_FITS, _candidates_sql(CANDIDATE_ROWS), _weights_sql(), _errors_sql(), """
crit AS (SELECT candidate, sum(sse) / sum(n) AS criterion FROM errors GROUP BY candidate)""", body="""
SELECT candidate, kind, round(criterion, 6) AS criterion, candidate = (SELECT arg_min(candidate, criterion) FROM crit) AS best FROM crit JOIN cand USING (candidate)"""))
def _(t: Tables):
    """Out-of-fold criterion of every row of a candidate table; the best is flagged."""
    table = candidate_table(t)
    m = K.Moments.of(vectors(t, "split = 'Validation'"), "obj_id", LAYOUT, OUTER, INNER)
    found = m.search(K.candidates_of(table))
    best = min(found, key=lambda r: r["criterion"])
    scores = t.spark.createDataFrame([(r["candidate"], round(r["criterion"], 6), r is best) for r in found], "candidate int, criterion double, best boolean")
    return table.select("candidate", "kind").join(scores, "candidate")


_NESTED_FITS = f"""splits AS (SELECT rep, o, i FROM range(0, {REPETITIONS}) a(rep), range(0, {OUTER}) b(o), range(-1, {INNER}) c(i)),
fits AS (SELECT (rep * {OUTER} + o) * {INNER + 1} + i + 1 AS id, """ + _flat("SELECT p.rep, p.o, p.i, a, b, sum(v) AS v FROM splits p JOIN cells c ON c.rep = p.rep AND c.o <> p.o AND c.i <> p.i GROUP BY ALL") + f""" rep, o, i),
held AS (SELECT (rep * {OUTER} + o) * {INNER + 1} + i + 1 AS id, list(v ORDER BY a, b) AS h FROM (
  SELECT p.rep, p.o, p.i, a, b, sum(v) AS v FROM splits p JOIN cells c ON c.rep = p.rep AND CASE WHEN p.i = -1 THEN c.o = p.o ELSE c.o <> p.o AND c.i = p.i END GROUP BY ALL) GROUP BY rep, o, i)"""
NESTED_ROWS = CANDIDATE_ROWS
_NESTED = [*SOURCE, _vector_sql("split = 'Validation'"), _cells_sql(REPETITIONS), _NESTED_FITS, _candidates_sql(NESTED_ROWS), _weights_sql(), _errors_sql(), f"""
scored AS (SELECT id // {(INNER + 1) * OUTER} AS repetition, (id // {INNER + 1}) % {OUTER} AS outer_fold, candidate, sum(sse) / sum(n) AS inner_criterion FROM errors WHERE id % {INNER + 1} > 0 GROUP BY ALL),
chosen AS (SELECT repetition, outer_fold, arg_min(candidate, inner_criterion) AS candidate, min(inner_criterion) AS inner_criterion FROM scored GROUP BY ALL),
nested AS (SELECT c.repetition, c.outer_fold, c.candidate, c.inner_criterion, e.n, e.sse FROM chosen c JOIN errors e ON e.id = (c.repetition * {OUTER} + c.outer_fold) * {INNER + 1} AND e.candidate = c.candidate)"""]


def nested_rows(t: Tables) -> list[dict]:
    m = K.Moments.of(vectors(t, "split = 'Validation'"), "obj_id", LAYOUT, OUTER, INNER, REPETITIONS)
    return m.nested(K.candidates_of(candidate_table(t, NESTED_ROWS)))


@query("e09_nested_validation", _recursive(*_NESTED, body="""
SELECT repetition::INT AS repetition, outer_fold::INT AS outer_fold, candidate, round(inner_criterion, 6) AS inner_criterion, n::INT AS n, round(sse / n, 6) AS criterion FROM nested"""))
def _(t: Tables):
    rows = [{**r, "inner_criterion": round(r["inner_criterion"], 6), "criterion": round(r["criterion"], 6)} for r in nested_rows(t)]
    return t.spark.createDataFrame(rows, "repetition int, outer_fold int, candidate int, inner_criterion double, n int, criterion double")


@query("e09_nested_summary", _recursive(*_NESTED, "per AS (SELECT repetition, sum(sse) / sum(n) AS criterion FROM nested GROUP BY repetition)", body="""
SELECT repetition::INT AS repetition, round(criterion, 6) AS criterion, round(avg(criterion) OVER (), 6) AS mean, round(stddev_samp(criterion) OVER (), 6) AS std FROM per"""))
def _(t: Tables):
    """Criterion of each repetition's out-of-fold predictions, mean and deviation over the repetitions."""
    rows = [{k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()} for r in K.nested_summary(nested_rows(t))]
    return t.spark.createDataFrame(rows, "repetition int, criterion double, mean double, std double")


def _without_sql() -> str:
    """Pairs of three members have a closed form: the weight of the first, clipped to [0, 1]."""
    parts = []
    for gone in range(M):
        a, b = [k for k in range(M) if k != gone]
        for j in range(J):
            p = LAYOUT.predictions(j)
            ga, gb, gab = _gram(j, p[a], p[a]), _gram(j, p[b], p[b]), _gram(j, p[a], p[b])
            parts.append(f"SELECT '{FAMILIES[gone]}' AS removed, {ga} AS ga, {gb} AS gb, {gab} AS gab FROM fits")
    full = " UNION ALL ".join(f"SELECT {j} AS j, candidate, w FROM weights WHERE j = {j}" for j in range(J))
    return f"""pairs AS ({' UNION ALL '.join(parts)}),
clipped AS (SELECT removed, ga, gb, gab, least(1, greatest(0, ((gb + 0.01) - gab) / (ga + gb - 2 * gab + 0.02))) AS w FROM pairs),
less AS (SELECT removed, avg(w * w * ga + (1 - w) * (1 - w) * gb + 2 * w * (1 - w) * gab) AS criterion FROM clipped GROUP BY removed),
held AS (SELECT id, s AS h FROM fits),
whole AS (SELECT avg({_SSE}) / max(h[1]) AS criterion FROM (SELECT id, {_ERROR} AS e FROM ({full}) CROSS JOIN (SELECT id FROM fits)) JOIN held USING (id))"""


@query("a48_without_member", _recursive(*SOURCE, _vector_sql("true"), _FIT_ALL, _candidates_sql([{"kind": "convex", "regularization": 0.01}]), _weights_sql(), _without_sql(), body="""
SELECT removed, round(less.criterion, 6) AS criterion, round(less.criterion - whole.criterion, 6) AS lost FROM less, whole"""))
def _(t: Tables):
    """Criterion lost when each family is removed."""
    m = K.Moments.of(vectors(t, "split <> 'Test'"), "obj_id", LAYOUT, 1)
    rows = [(r["removed"], round(r["criterion"], 6), round(r["lost"], 6)) for r in m.without_member(K.Candidate("convex", regularization=0.01))]
    return t.spark.createDataFrame(rows, "removed string, criterion double, lost double")
