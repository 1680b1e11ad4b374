"""Second-order boosting against a plain NumPy version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from odweave.operators import boosting as B


def plain_tree(x, g, take, cols, s, n_bins):
    """Leaf values of all rows, and whether anything was split."""
    def grow(inside, level):
        G, H = g[inside & take].sum(), (inside & take).sum()
        best = None
        for f in cols if level < s.depth else []:
            for b in range(n_bins[f] - 1):
                left = inside & take & (x[:, f] <= b)
                gl, hl = g[left].sum(), left.sum()
                if hl < s.least or H - hl < s.least:
                    continue
                gain = gl**2 / (hl + s.l2) + (G - gl) ** 2 / (H - hl + s.l2) - G**2 / (H + s.l2)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, b)
        if best is None:
            return np.where(inside, -s.rate * G / (H + s.l2), 0.0)
        _, f, b = best
        return grow(inside & (x[:, f] <= b), level + 1) + grow(inside & (x[:, f] > b), level + 1)

    return grow(np.ones(len(x), bool), 0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    n = 240
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), np.full(n, 3.0)])
    y = np.sin(2 * x[:, 0]) + 0.5 * (x[:, 1] == 2) + 0.1 * rng.normal(size=n) + 40
    fold = rng.integers(0, 3, n)
    df = spark.createDataFrame([(i, int(fold[i]), float(y[i]), *map(float, x[i])) for i in range(n)], "id long, fold int, y double, a double, b double, c double")
    return df, x, y, fold


def test_models_of_all_folds_against_numpy(table):
    df, x, y, fold = table
    s = B.Settings(rounds=7, depth=3, rate=0.3, l2=1.5, rows=1.0, columns=0.67, bins=8)
    models = B.fit(df, ["a", "b", "c"], "y", s, "fold")
    assert set(models) == {0, 1, 2} and all(len(m.trees) == 7 for m in models.values()) and models[0].edges[2] == []
    edges = models[0].edges
    bins = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    for k, m in models.items():
        rng = np.random.default_rng(s.seed)
        take = fold != k
        p = np.full(len(y), y[take].mean())
        for _ in range(s.rounds):
            cols = sorted(rng.choice(3, 2, replace=False).tolist())
            p = p + plain_tree(bins, p - y, take, cols, s, [len(e) + 1 for e in edges])
        got = {r["id"]: r["p"] for r in df.select("id", m.prediction().alias("p")).collect()}
        assert [got[i] for i in range(len(y))] == pytest.approx(p.tolist(), abs=1e-9)
    cv = {r["fold"]: r for r in B.cross_validated(df, ["a", "b", "c"], "y", "fold", s).collect()}
    assert sum(r["n"] for r in cv.values()) == len(y) and all(0 < r["r2"] < 1 for r in cv.values())


def test_row_samples_do_not_depend_on_partitions(table):
    df, _, y, _ = table
    s = B.Settings(rounds=3, bins=16)
    one = B.fit(df.repartition(1), ["a", "b"], "y", s, key="id")[None]
    many = B.fit(df.repartition(7, "b"), ["a", "b"], "y", s, key="id")[None]
    assert one.trees == many.trees and one.base == many.base
    with pytest.raises(ValueError):
        B.fit(df, ["a"], "y", s)
    still = B.fit(df.withColumn("y", F.lit(2.0)), ["a", "b"], "y", B.Settings(rounds=2, rows=1.0))[None]
    assert df.select(still.prediction().alias("p")).distinct().collect()[0]["p"] == 2.0
