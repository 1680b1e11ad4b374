"""Regression, spatial models, distributions and Shapley values against NumPy and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from odweave.functions import distributions as D
from odweave.operators import elimination, learning, permutations, selection, spatial
from odweave.operators import regression as R


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(5)
    n = 100
    x = r.normal(size=(n, 2)) * [1, 30] + [0, 500]
    y = 2 + 1.5 * x[:, 0] - 0.02 * x[:, 1] + r.normal(size=n) * (1 + np.abs(x[:, 0]))
    rows = [(i, i % 10, i // 10, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    return spark.createDataFrame(rows, "area long, x long, y long, t double, a double, b double"), x, y


def test_line_is_recovered(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (3.0, 1.0, 1.0), (5.0, 2.0, 2.0), (7.0, 3.0, 2.0)], "y double, x double, z double")
    f = R.fit_ols(df, "y", ["x"])
    assert f.metrics()["rmse"] < 1e-7 and f.beta[1] == pytest.approx(2)


def test_ols_and_hc3(frame):
    df, x, y = frame
    f = R.fit_ols(df, "t", ["a", "b"])
    X = np.column_stack([np.ones(len(x)), x])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e = y - X @ b
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    hc3 = inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv
    assert np.allclose(f.beta, b) and np.allclose(np.diag(f.robust), np.diag(hc3)) and np.allclose(np.diag(f.cov), np.diag(inv * (e @ e) / (len(y) - 3)))
    assert f.mae == pytest.approx(np.abs(e).mean())
    d = R.diagnostics(f)
    g = np.linalg.lstsq(X, e * e, rcond=None)[0]
    assert d["breusch_pagan"] == pytest.approx(len(y) * (1 - ((e * e - X @ g) ** 2).sum() / ((e * e - (e * e).mean()) ** 2).sum()), rel=1e-6)
    assert d["max_abs_studentised"] == pytest.approx(np.abs(e / np.sqrt(e @ e / (len(y) - 3) * (1 - h))).max())


def weights_matrix(n=100):
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if i != j and abs(i % 10 - j % 10) <= 1 and abs(i // 10 - j // 10) <= 1:
                w[i, j] = 1
    return w / w.sum(1, keepdims=True)


def test_sar_sem_and_lm_tests_against_dense(frame):
    df, x, y = frame
    w = spatial.row_standardised(spatial.lattice_edges(df))
    W = weights_matrix()
    X = np.column_stack([np.ones(len(x)), x])

    def ll(kind, r):
        A = np.eye(100) - r * W
        yy, xx = A @ y, X if kind == "SAR" else A @ X
        b = np.linalg.lstsq(xx, yy, rcond=None)[0]
        s2 = ((yy - xx @ b) ** 2).mean()
        return -50 * (math.log(2 * math.pi) + math.log(s2) + 1) + np.linalg.slogdet(A)[1]

    grid = np.linspace(-0.95, 0.95, 3801)
    for kind, fit in (("SAR", R.fit_sar), ("SEM", R.fit_sem)):
        f = fit(df.select("area", "t", "a", "b"), w, "area", "t", ["a", "b"])
        best = max(grid, key=lambda r: ll(kind, r))
        assert f.spatial == pytest.approx(best, abs=1e-3)
        assert f.log_likelihood == pytest.approx(ll(kind, f.spatial), abs=1e-6)
        h = 1e-3
        curve = (ll(kind, f.spatial + h) - 2 * ll(kind, f.spatial) + ll(kind, f.spatial - h)) / h**2
        assert f.spatial_se == pytest.approx(1 / math.sqrt(-curve), rel=1e-4) and f.k == 5
        assert abs(ll(kind, f.spatial + 1e-6) - ll(kind, f.spatial - 1e-6)) < 1e-8  # the slope at the optimum is 0
        A = np.eye(100) - f.spatial * W
        yy, xx = A @ y, X if kind == "SAR" else A @ X
        b = np.linalg.lstsq(xx, yy, rcond=None)[0]
        assert f.beta == pytest.approx(b, rel=1e-7)
        assert f.se == pytest.approx(np.sqrt(np.diag(((yy - xx @ b) ** 2).mean() * np.linalg.inv(xx.T @ xx))), rel=1e-6)
    ols = R.fit_ols(df.select("area", "t", "a", "b"), "t", ["a", "b"])
    t = R.lm_tests(ols, w, "area")
    e = y - X @ ols.beta
    tr = np.trace(W.T @ W + W @ W)
    s2 = e @ e / 100
    assert t["LM-error"][0] == pytest.approx((e @ W @ e / s2) ** 2 / tr)
    M = np.eye(100) - X @ np.linalg.inv(X.T @ X) @ X.T
    v = W @ X @ ols.beta
    assert t["LM-lag"][0] == pytest.approx((e @ W @ y / s2) ** 2 / (v @ M @ v / s2 + tr))
    assert t["LM-SARMA"][2] == 2


def test_log_determinant_by_elimination(frame, monkeypatch):
    df, _, _ = frame
    w = spatial.row_standardised(spatial.lattice_edges(df))
    W = weights_matrix()
    exact = R.log_determinant(w, 100)
    assert exact(0.5) == pytest.approx(np.linalg.slogdet(np.eye(100) - 0.5 * W)[1])
    assert elimination.log_determinants(w, np.array([-0.9, 0.3, 0.95]), dense=12) == pytest.approx([np.linalg.slogdet(np.eye(100) - r * W)[1] for r in (-0.9, 0.3, 0.95)], abs=1e-9)
    monkeypatch.setattr(R, "EXACT_EIGENVALUES", 10)
    other = R.log_determinant(w, 100)
    for r in (-0.95, -0.2, 0.0, 0.61, 0.95):
        assert other(r) == pytest.approx(exact(r), abs=1e-5) and abs(other(r) - exact(r)) <= other.error(r) + 1e-12
        assert other.slope(r) == pytest.approx(exact.slope(r), rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("width", [10, 30])
def test_elimination_takes_few_rounds(spark, monkeypatch, width):
    """Most nodes of a map whose ids follow it go in a round of blocks; the driver gets sums of logarithms only."""
    n = 1200
    w = spatial.row_standardised(spatial.lattice_edges(spark.range(n).select(F.col("id").alias("area"), (F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))))
    S = np.zeros((n, n))
    for r in w.collect():
        S[r["i"], r["j"]] = r["w"]
    rounds, by_blocks = [], elimination._by_blocks
    monkeypatch.setattr(elimination, "_by_blocks", lambda *a: rounds.append(by_blocks(*a)) or rounds[-1])
    monkeypatch.setattr(elimination, "_chosen", lambda *a: pytest.fail("a round without blocks"))
    got = elimination.log_determinants(w, np.array([-0.9, 0.3, 0.95]))
    assert len(rounds) <= 6 and got == pytest.approx([np.log(1 - r * np.linalg.eigvals(S).real).sum() for r in (-0.9, 0.3, 0.95)], abs=1e-8)


def test_fits_share_one_log_determinant(frame, monkeypatch):
    df, _, _ = frame
    w = spatial.row_standardised(spatial.lattice_edges(df))
    alone = [f(df, w, "area", "t", ["a", "b"]) for f in (R.fit_sar, R.fit_sem)]
    made, own = [], R.log_determinant
    monkeypatch.setattr(R, "log_determinant", lambda *a: made.append(1) or own(*a))
    both = R.fit_spatial(df, w, "area", "t", ["a", "b"])
    assert len(made) == 1 and [f.kind for f in both] == ["SAR", "SEM"]
    assert [x for f in both for x in (f.spatial, f.log_likelihood)] == pytest.approx([x for f in alone for x in (f.spatial, f.log_likelihood)])


def test_spatial_models_with_an_island_and_a_large_mean(spark):
    """A row without neighbours, and a response far from 0, as in tables of logarithms."""
    rng = np.random.default_rng(7)
    W = np.zeros((30, 30))
    for i in range(28):  # a ring of 29 rows, the last row alone
        W[i, i + 1] = W[i + 1, i] = 1
    W[0, 28] = W[28, 0] = 1
    edges = spark.createDataFrame([(i, j, 0.5) for i in range(30) for j in range(30) if W[i, j]], "i long, j long, w double")
    W /= 2
    x = rng.normal(size=30)
    y = 300 + 0.02 * (x + rng.normal(size=30))
    df = spark.createDataFrame([(i, float(y[i]), float(x[i])) for i in range(30)], "k long, y double, x double")
    X = np.column_stack([np.ones(30), x])
    for kind, fit in (("SAR", R.fit_sar), ("SEM", R.fit_sem)):
        f = fit(df, edges, "k", "y", ["x"])

        def ll(r, kind=kind):
            A = np.eye(30) - r * W
            yy, xx = A @ y, X if kind == "SAR" else A @ X
            res = yy - xx @ np.linalg.lstsq(xx, yy, rcond=None)[0]
            return -15 * (math.log(2 * math.pi) + math.log((res**2).mean()) + 1) + np.linalg.slogdet(A)[1]

        assert f.log_likelihood == pytest.approx(ll(f.spatial), abs=1e-6)
        h = f.spatial_se / 20  # a large mean and an island make the peak of the lag model very narrow
        assert f.spatial_se == pytest.approx(h / math.sqrt(2 * ll(f.spatial) - ll(f.spatial + h) - ll(f.spatial - h)), rel=5e-3)


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 3)) * [1e-3, 1.0, 1e6] + [0, 5, 1e7]
    df = spark.createDataFrame(v.tolist(), "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    first = R.cross_products(df.repartition(1), cols)
    assert first == pytest.approx(v.T @ v, rel=1e-12)
    for n in (4, 211):
        assert (R.cross_products(df.repartition(n, "b"), cols) == first).all()
        assert R.fit_ols(df.repartition(n, "b"), "c", ["a", "b"]).beta.tolist() == R.fit_ols(df.repartition(1), "c", ["a", "b"]).beta.tolist()


def test_path_graph_models_converge(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 0.5), (2, 3, 0.5), (3, 2, 0.5), (3, 4, 0.5), (4, 3, 1.0)], "i long, j long, w double")
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 1.0), (3, 2.7, 2.0), (4, 4.2, 3.0)], "k long, y double, x double")
    for fit in (R.fit_sar, R.fit_sem):
        f = fit(df, edges, "k", "y", ["x"], (-0.5, 0.5))
        assert math.isfinite(f.aic) and f.inference(spark).columns == ["term", "estimate", "std_error", "z", "p"]


def test_queen_boxes(spark):
    box = lambda a: [(float(x), float(y)) for x, y in ((a, 0), (a + 1, 0), (a + 1, 1), (a, 1))]
    p = spark.createDataFrame([("A", box(0)), ("B", box(1)), ("C", box(2))], "area string, ring array<struct<x:double,y:double>>")
    e = sorted(map(tuple, spatial.polygon_edges(p).collect()))
    assert e == [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")]
    pts = spark.createDataFrame([(0.5, 0.5), (1.0, 0.5), (9.0, 9.0)], "x double, y double")
    assert sorted(map(str, (r["area"] for r in spatial.points_in_polygons(pts, p, 1.0).collect()))) == ["A", "None", "None"]


def test_distributions():
    assert D.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert D.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert D.chi2_upper(5.991464547, 2) == pytest.approx(0.05, abs=1e-8)
    assert D.f_upper(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert D.t_quantile(0.05, 10) == pytest.approx(2.228138852, abs=1e-6)


def test_shapley_adds_up_and_matches_brute_force():
    t = learning.Tree([0, 1, -1, -1, -1], [0.5, 0.5, 0, 0, 0], [1, 2, -1, -1, -1], [4, 3, -1, -1, -1], [0, 0, 1.0, 2.0, 5.0], [10, 6, 4, 2, 4])
    x = np.array([[0.0, 1.0], [1.0, 0.0], [0.0, 0.0]])
    s = learning.shapley([t], [1.0], x)
    assert np.allclose(s.sum(1), [2.0, 5.0, 1.0])
    base = (4 * 1 + 2 * 2 + 4 * 5) / 10
    assert np.allclose(s[:, 2], base)
    only0 = (4 * 1 + 2 * 2) / 6
    only1 = (6 * 2 + 4 * 5) / 10
    assert s[0, 0] == pytest.approx(((only0 - base) + (2 - only1)) / 2)


def test_shapes_are_those_of_shap_values(spark):
    from odweave.plans import model_queries as M
    from odweave.plans import views as V
    from tests.conftest import SF

    got = {r["feature"]: r for r in M.shape_summary(spark, SF).collect()}
    assert set(got) == set(M.X)
    t = V.model_frame(spark, SF).select("area", *M.X).join(M.shap_values(spark, SF), "area").toPandas()
    for c in M.X:
        x, y, r = t[c].to_numpy(), t[f"shap_{c}"].to_numpy(), got[c]
        if y.std() > 1e-4:
            assert r["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-3)
        assert [r["value_p05"], r["value_p50"], r["value_p95"]] == pytest.approx(np.percentile(y, [5, 50, 95]), abs=1e-5)


def test_shape_of_a_step_is_a_threshold(spark):
    from odweave.operators import shapes

    df = spark.createDataFrame([(float(i), -0.5 - 0.01 * (i % 7) if i < 200 else 0.5 + 0.01 * (i % 5)) for i in range(400)], "f double, s double")
    r = shapes.shape_table(df, {"f": "s"}).first()
    assert r["shape"] == "threshold" and r["n"] == 400 and r["pearson_p"] < 1e-6


def test_shapes_by_both_rule_tables(spark):
    """Known curves, side by side as features of one table."""
    from odweave.operators import shapes

    x = np.arange(600) / 600
    curves = {"flat": 0.01 * x, "line": 2 * x - 3, "wave": np.sin(14 * x), "bend": -1 / (x + 0.05), "fades": np.minimum(x, 0.35) * 3 - 3, "constant": 0 * x}
    noise = np.random.default_rng(1).normal(size=600) * 0.8
    curves["noisy"] = 2 * x - 8 + noise
    rows = [(float(x[i]), *(float(c[i]) for c in curves.values())) for i in range(600)]
    df = spark.createDataFrame(rows, "x double, " + ", ".join(f"{k} double" for k in curves))
    for c in curves:
        df = df.withColumn(f"x_{c}", F.col("x"))
    long = {r["feature"][2:]: r for r in shapes.shape_table(df, {f"x_{c}": c for c in curves}).collect()}
    assert [long[k]["shape"] for k in ("flat", "line", "wave", "bend", "constant")] == ["weak / unclear", "monotonic nonlinear", "weak / unclear", "monotonic nonlinear", "weak / unclear"]
    assert long["noisy"]["shape"] in ("approximately linear", "non-monotonic") and long["constant"]["pearson"] is None
    assert long["line"]["spearman"] == pytest.approx(1.0) and long["noisy"]["pearson"] == pytest.approx(np.corrcoef(x, curves["noisy"])[0, 1])
    short = {r["feature"][2:]: r["shape"] for r in shapes.shape_table(df, {f"x_{c}": c for c in curves}, rules=shapes.SHORT_RULES).collect()}
    assert short["noisy"] == "approximately linear" and short["line"] == "monotonic nonlinear"


def test_folds_are_the_best_of_many_starts(spark):
    r = np.random.default_rng(2)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [5, 5]], float)
    points = np.concatenate([c + r.normal(size=(30, 2)) for c in centres])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "area long, x double, y double")
    fold = {q["area"]: q["fold"] for q in learning.kmeans_folds(df, 5, 20).collect()}
    groups = [{fold[i] for i in range(30 * k, 30 * k + 30)} for k in range(5)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 5 and fold[0] == 0 and groups[3] == {4}


def test_runs_of_k_means_give_one_row_a_task(spark):
    points = np.random.default_rng(3).normal(size=(500, 2))
    centres = np.random.default_rng(4).normal(size=(6, 3, 2))
    df = spark.createDataFrame(points.tolist(), "x double, y double").repartition(4)
    rows = df.mapInArrow(learning._run_sums(centres), "a array<double>").collect()
    assert len(rows) <= 4
    got = np.sum([r["a"] for r in rows], 0).reshape(6, 3, 4)
    for run in range(6):
        d = ((points[:, None] - centres[run]) ** 2).sum(2)
        for c in range(3):
            own = d.argmin(1) == c
            assert got[run, c] == pytest.approx([own.sum(), *points[own].sum(0), d[own, c].sum()])


def test_permutation_importance_is_one_program(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(80, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(3 * a)) for i, (a, b) in enumerate(x)], "area long, a double, b double, y double")
    m = learning.fit_model(learning.assembled(df, ["a", "b"]), learning.boosted_trees(5), "y")
    t = {q["feature"]: q for q in learning.permutation_importance(m, df, ["a", "b"], "y", "area", 4).collect()}
    assert t["a"]["rank"] == 1 and t["a"]["mean"] > 0.5 and abs(t["b"]["mean"]) < 0.05
    places = spark.range(80).withColumnRenamed("id", "x").withColumn("at", F.col("x")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(8))))
    from_ = {(q["r"], q["at"]): q["x"] for q in permutations.permuted(places, "x", 80, 8).collect()}
    pred = lambda d: np.array([q["_p"] for q in m.transform(learning.assembled(d, ["a", "b"])).orderBy("area").collect()])
    y, r2 = 3 * x[:, 0], lambda p: 1 - ((3 * x[:, 0] - p) ** 2).sum() / ((3 * x[:, 0] - (3 * x[:, 0]).mean()) ** 2).sum()
    drops = []
    for k in range(4):
        order = [from_[k + 1, i] for i in range(80)]
        mixed = spark.createDataFrame([(i, float(x[order[i], 0]), float(x[i, 1]), float(y[i])) for i in range(80)], "area long, a double, b double, y double")
        drops.append(r2(pred(df)) - r2(pred(mixed)))
    assert t["a"]["mean"] == pytest.approx(np.mean(drops)) and t["a"]["sd"] == pytest.approx(np.std(drops))


def test_permutation_importance_stores_no_row_for_a_repeat(spark, monkeypatch):
    """F16: values meet the rows in blocks of places (five here); what is stored is one row for each area, or for each feature and repeat."""
    r = np.random.default_rng(8)
    n, x = 300, r.normal(size=(300, 2))
    y = 3 * x[:, 0] + x[:, 1]
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "area long, a double, b double, y double").repartition(7)
    m = learning.fit_model(learning.assembled(df, ["a", "b"]), learning.boosted_trees(3), "y")
    sizes = []
    for module in (learning, permutations):
        monkeypatch.setattr(module, "stored", lambda d, *a, real=module.stored: [t := real(d, *a), sizes.append(t.count())][0])
    t = {q["feature"]: q for q in learning.permutation_importance(m, df, ["a", "b"], "y", "area", 3).collect()}
    assert sizes and max(sizes) <= n
    here = np.concatenate([x, *(np.where(np.arange(2) == k // 3, x[permutations.permuted_arrays(np.arange(n), n, np.array([k + 1]))[0]], x) for k in range(6))])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(here)], "i long, a double, b double")
    p = np.array([q["_p"] for q in m.transform(learning.assembled(rows, ["a", "b"])).orderBy("i").collect()]).reshape(7, n)
    r2 = 1 - ((y - p) ** 2).sum(1) / ((y - y.mean()) ** 2).sum()
    for f, drops in (("a", r2[0] - r2[1:4]), ("b", r2[0] - r2[4:])):
        assert t[f]["mean"] == pytest.approx(drops.mean()) and t[f]["sd"] == pytest.approx(drops.std())


def test_ranks_and_adjusted_p_values_by_ranges(spark):
    from odweave.operators import stats

    r = np.random.default_rng(6)
    p = np.round(r.uniform(size=500), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(500, None)], "k long, p double")
    got = {q["k"]: q["r"] for q in stats.average_rank(df, "p", "r").collect()}
    assert got[500] is None and all(got[i] == (p < v).sum() + ((p == v).sum() + 1) / 2 for i, v in enumerate(p))
    adjusted = {q["k"]: q["p_adjusted"] for q in stats.bh_adjust(df.where("k < 500"), "p", "k", piece=64).collect()}
    order = sorted(range(500), key=lambda i: (p[i], i))
    low = 1.0
    for n in range(500, 0, -1):
        low = min(low, p[order[n - 1]] * 500 / n)
        assert adjusted[order[n - 1]] == pytest.approx(low)


def test_held_out_comparison(frame):
    df, _, _ = frame
    t, fitted = learning.compare_held_out(learning.strip_folds(df), ["a", "b"], "t", {"small": learning.boosted_trees(2), "forest": learning.random_forest(3, 3)})
    rows = {q["model"]: q for q in t.collect()}
    assert set(fitted) == {"small", "forest"} and rows["OLS"]["cv_r2"] is None and rows["OLS"]["best"] is None
    assert rows["OLS"]["n_test"] == 20 and sum(bool(q["best"]) for q in rows.values()) == 1
    top = max(("small", "forest"), key=lambda k: rows[k]["test_r2"])
    assert rows[top]["best"]


def test_permutation_queries_run_999(spark):
    from odweave.plans import model_queries as M
    from odweave.plans import spatial_queries as Q
    from tests.conftest import SF

    for query in (Q.moran_permutation, M.residual_moran):
        assert query(spark, SF).first()["permutations"] == 999


@pytest.mark.parametrize("n", [1, 2, 9, 257])
def test_permutations_are_bijections(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "x").withColumn("at", F.col("x")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(40))))
    there = permutations.permuted(rows, "x", n, 40)
    got = {}
    for r in there.collect():
        got.setdefault(r["r"], {})[r["at"]] = r["x"]
    assert all(sorted(p.values()) == list(range(n)) for p in got.values())
    back = permutations.permuted(there, "x", n, 40, inverse=True).collect()
    assert all(r["x"] == r["at"] for r in back)
    if n == 257:  # places are as even as chance, and permutations differ
        assert len({tuple(sorted(p.items())) for p in got.values()}) == 40
        ends = np.array([[p[i] for i in range(n)] for p in got.values()])
        assert abs(np.corrcoef(ends[:, :-1].ravel(), ends[:, 1:].ravel())[0, 1]) < 0.05 and abs(ends[:, 3].mean() - 128) < 40


@pytest.mark.parametrize("inverse", [False, True])
def test_permutations_of_arrays_are_those_of_rows(spark, inverse):
    n, reps = 1000, 12
    rows = spark.range(n).withColumnRenamed("id", "x").withColumn("at", F.col("x")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    want = np.zeros((reps, n), int)
    for r in permutations.permuted(rows, "x", n, reps, inverse).collect():
        want[r["r"] - 1, r["at"]] = r["x"]
    assert (permutations.permuted_arrays(np.arange(n), n, np.arange(1, reps + 1), inverse) == want).all()


def test_permuted_moran_sends_values_not_arrays(spark, monkeypatch):
    """Blocks of 16 places: edges within and between them.  Only areas at a block's border have an array, and no row is an area's in one permutation."""
    n, reps = 100, 30
    monkeypatch.setattr(spatial, "PLACES", 16)
    kept, own = {}, spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name: kept.setdefault(name, own(df, name)))
    monkeypatch.setattr(spatial, "release", lambda *a: None)
    v = np.random.default_rng(8).normal(size=n)
    df = spark.createDataFrame([(i, float(v[i]), i % 5, i // 5) for i in range(n)], "area long, v double, x long, y long")
    w = spatial.row_standardised(spatial.lattice_edges(df))
    got = spatial.moran_permutation(df, w, "area", "v", reps).first()
    z = (v - v.mean()) / v.std()
    W = np.zeros((n, n))
    for r in w.collect():
        W[r["i"], r["j"]] = r["w"]
    sims = [z[p] @ W @ z[p] / W.sum() for p in permutations.permuted_arrays(np.arange(n), n, np.arange(1, reps + 1))]
    i = z @ W @ z / W.sum()
    assert (got["moran_i"], got["mean_simulated"], got["sd_simulated"]) == pytest.approx((i, np.mean(sims), np.std(sims)))
    assert got["larger"] == sum(s >= i for s in sims) and got["permutations"] == reps
    assert max(t.count() for t in kept.values()) < n * reps and kept["arrays"].where("k IS NOT NULL").count() < n


def test_local_p_values_against_drawn_neighbours(spark):
    """A lattice with one hub: the first ids of every permutation, other than the area's own, stand for its neighbours."""
    n, reps = 60, 25
    rng = np.random.default_rng(1)
    z = rng.normal(size=n)
    near = {i: {(i - 1) % n, (i + 1) % n} for i in range(n - 1)} | {n - 1: set()}
    near[0] = set(range(1, 45))  # edges need not be symmetric for this test
    local = spark.createDataFrame([(i, float(z[i]), float(np.mean([z[j] for j in near[i]]) if near[i] else 0), len(near[i])) for i in range(n)], "area long, z double, lag_z double, neighbours int")
    got = {r["area"]: r["p_sim"] for r in spatial.local_p_values(local, "area", reps).collect()}
    places = spark.range(n).withColumnRenamed("id", "x").withColumn("at", F.col("x")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    order = {}
    for r in permutations.permuted(places, "x", n, reps).collect():
        order.setdefault(r["r"], {})[r["at"]] = r["x"]
    for i in range(n):
        d = len(near[i])
        if not d:
            assert got[i] == 1.0
            continue
        sims = [z[i] * np.mean([z[j] for j in (p[k] for k in range(n)) if j != i][:d]) for p in order.values()]
        larger = sum(s >= z[i] * np.mean([z[j] for j in near[i]]) - 1e-12 for s in sims)
        assert got[i] == (min(larger, reps - larger) + 1) / (reps + 1)


def test_quantiles_by_ranges(spark, monkeypatch):
    """Ties, one value, heavy tails, infinite ranges and few rows, with bins so small that ranges are narrowed many times."""
    monkeypatch.setattr(selection, "BINS", 4)
    monkeypatch.setattr(selection, "FEW", 5)
    rng = np.random.default_rng(4)
    columns = {
        "normal": rng.normal(size=501), "ties": rng.integers(0, 4, 400).astype(float), "same": np.full(300, 2.5), "tail": np.exp(rng.normal(size=300) * 20), "wide": np.array([-1.7e308, 0.0, 1.7e308, 1.0, 2.0, 3.0, 4.0, 5.0]), "one": np.array([7.0]),
        "a:b": rng.normal(size=40), "negative": -np.exp(rng.normal(size=200)),
    }
    long = spark.createDataFrame([(g, float(v)) for g, x in columns.items() for v in x], "g string, v double").repartition(5)
    p = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = selection.quantiles(long, p)
    assert set(got) == set(columns)
    for g, x in columns.items():
        assert got[g] == pytest.approx(np.quantile(x / 2, p) * 2, rel=1e-12), g
    assert selection.quantiles(long.limit(0), p) == {}


def test_areas_of_the_same_records_are_in_one_class(spark, tmp_path):
    """Nine copies of each of seven areas, their records in different orders: the edges fall on ties."""
    from datetime import datetime

    from odweave.plans import spatial_queries as Q

    rng = np.random.default_rng(9)
    rows = []
    for a in range(7):
        values = np.round(rng.uniform(0, 500, 40), 2)
        rows += [(7 * c + a, float(v)) for c in range(9) for v in rng.permutation(values)]
    df = spark.createDataFrame(rows, "user_id long, value double").repartition(3)
    df.select(F.monotonically_increasing_id().alias("event_id"), F.lit(datetime(2024, 1, 1)).alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", F.lit('{"k": 1}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    classes = {}
    for r in Q.quantile_classes(spark, str(tmp_path)).collect():
        classes.setdefault(r["area"] % 7, set()).add(r["class"])
    assert len(classes) == 7 and all(len(c) == 1 for c in classes.values())
