"""Second-order gradient boosting of squared loss over quantile bins, with L2 shrinkage of leaves, row and column samples a tree.

Rows never leave the cluster: a level of a tree is one aggregate of gradient sums and counts by (model, node, feature, bin), some
thousand rows whatever the data, from which the driver picks the splits.  Several models (one for each left-out fold) grow side by
side in the same aggregates.  Gradients are whole multiples of 2**-k, so sums, and with them the trees, are the same for any order of rows.

Rows with a null response or predictor are an error of the caller's (use complete cases).  A feature with one value is never split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.operators import exact, selection
from odweave.storage import release, stored

#: Trees after which predictions are written, so that expressions stay short.
STORE_EVERY = 5


@dataclass(frozen=True)
class Settings:
    rounds: int = 500
    depth: int = 3
    rate: float = 0.05
    l2: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    least: int = 1
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Splits by node (the root is 1, the children of i are 2 i and 2 i + 1): node -> (feature, bin); leaves: node -> value."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def walk(self, bin_of, at: int = 1):  # noqa: ANN001, ANN201
        """The node that a row reaches, as a column of node numbers and one of leaf values."""
        if at not in self.splits:
            return F.lit(at), F.lit(float(self.leaves.get(at, 0.0)))
        f, cut = self.splits[at]
        (a, x), (b, y) = self.walk(bin_of, 2 * at), self.walk(bin_of, 2 * at + 1)
        left = bin_of(f) <= cut
        return F.when(left, a).otherwise(b), F.when(left, x).otherwise(y)


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]

    def prediction(self) -> Column:
        """bin <= cut where the value is at most the cut's edge."""
        total = F.lit(self.base)
        for t in self.trees:
            total = total + self._value(t, 1)
        return total

    def _value(self, t: Tree, at: int) -> Column:
        if at not in t.splits:
            return F.lit(float(t.leaves.get(at, 0.0)))
        f, cut = t.splits[at]
        return F.when(F.col(self.features[f]) <= self.edges[f][cut], self._value(t, 2 * at)).otherwise(self._value(t, 2 * at + 1))


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Per feature the inner quantiles, distinct and below the largest value."""
    q = selection.quantiles(selection.long_values(df, {f: F.col(f) for f in features}), [i / bins for i in range(1, bins)] + [1.0])
    return [sorted({x for x in q[f][:-1] if x < q[f][-1]}) if f in q else [] for f in features]


def _split(hist: dict[tuple[int, int], tuple[int, int]], features: list[int], n_bins: list[int], total: tuple[int, int], unit: float, s: Settings) -> tuple[float, int, int, int, int] | None:
    """(gain, feature, bin, gradient and rows on the left) of the best split of a node; ties to the first feature and bin."""
    best, score = None, lambda g, h: (g * unit) ** 2 / (h + s.l2)
    for f in features:
        g = h = 0
        for b in range(n_bins[f] - 1):
            dg, dh = hist.get((f, b), (0, 0))
            g, h = g + dg, h + dh
            if h < s.least or total[1] - h < s.least:
                continue
            gain = score(g, h) + score(total[0] - g, total[1] - h) - score(*total)
            if gain > 1e-12 * (1 + score(*total)) and (best is None or gain > best[0]):
                best = (gain, f, b, g, h)
    return best


def fit(df: DataFrame, features: list[str], response: str, settings: Settings = Settings(), fold: str | None = None, key: str | None = None) -> dict[int | None, Model]:  # noqa: B008
    """A model of all rows (under None), or with ``fold`` one for each of its values, fitted without the rows of that fold.  ``key`` (a column that
    tells rows apart) is needed for row samples."""
    s = settings
    if s.rows < 1 and key is None:
        raise ValueError("row samples need a key")
    rng = np.random.default_rng(s.seed)
    names: list[int | None] = [None] if fold is None else sorted(r[0] for r in df.select(fold).distinct().collect())
    edges = bin_edges(df, features, s.bins)
    n_bins = [len(e) + 1 for e in edges]
    data = stored(df.select((F.xxhash64(key) if key else F.lit(0).cast("long")).alias("key"), F.col(response).cast("double").alias("y"), (F.col(fold) if fold else F.lit(None).cast("int")).alias("fold"), _bins(features, edges).alias("bins")), "boost")
    models = []
    for name in names:
        n, mean, _ = exact.moments(data.where(F.col("fold") != name) if fold else data, ["y"])
        models.append(Model(features, edges, mean["y"], []))
    n, bounds = exact.column_bounds(data, {"y": F.col("y")})
    reach = exact.power_above(max(1e-300, 4 * max(abs(x - m.base) for x in bounds["y"] for m in models)))
    unit = reach / 2.0 ** (61 - max(n, 1).bit_length())
    state = stored(data.withColumn("p", F.array(*(F.lit(m.base) for m in models))), "boost")
    release(data)
    waiting: list[list[Tree]] = []
    for r in range(s.rounds):
        drawn = sorted(rng.choice(len(features), max(1, round(s.columns * len(features))), replace=False).tolist())
        taken = F.pmod(F.xxhash64("key", F.lit(s.seed * 1_000_003 + r)), F.lit(1 << 20)) < int(s.rows * (1 << 20)) if s.rows < 1 else F.lit(True)
        rows = state.where(taken).withColumn("p", _advanced(waiting, len(models)))
        trees = [Tree() for _ in models]
        totals: dict[tuple[int, int], tuple[int, int]] = {}
        for level in range(s.depth):
            each = F.array(*(F.struct(F.lit(m).alias("m"), t.walk(lambda f: F.get("bins", F.lit(f)))[0].alias("node"), F.rint((F.get("p", F.lit(m)) - F.col("y")) / unit).cast("long").alias("g"), (F.col("fold") != names[m] if fold else F.lit(True)).alias("in")) for m, t in enumerate(trees)))
            spread = rows.select("bins", F.explode(each).alias("e")).where("e.in").select("e.m", "e.node", "e.g", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.get("bins", F.lit(f)).alias("b")) for f in drawn))).alias("x"))
            hist: dict[tuple[int, int], dict] = {}
            for h in spread.where(F.col("node") >= 1 << level).groupBy("m", "node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.count("*").alias("h")).collect():
                hist.setdefault((h["m"], h["node"]), {})[h["f"], h["b"]] = (h["g"], h["h"])
            for (m, node), cells in sorted(hist.items()):
                own = [v for (f, _), v in cells.items() if f == drawn[0]]
                total = totals.setdefault((m, node), (sum(v[0] for v in own), sum(v[1] for v in own)))
                if best := _split(cells, drawn, n_bins, total, unit, s):
                    _, f, b, g, c = best
                    trees[m].splits[node] = (f, b)
                    totals[m, 2 * node], totals[m, 2 * node + 1] = (g, c), (total[0] - g, total[1] - c)
        for (m, node), (g, c) in totals.items():
            if node not in trees[m].splits:
                trees[m].leaves[node] = -s.rate * g * unit / (c + s.l2)
        for m, t in zip(models, trees, strict=True):
            m.trees.append(t)
        waiting.append(trees)
        if len(waiting) == STORE_EVERY and r + 1 < s.rounds:
            new = stored(state.withColumn("p", _advanced(waiting, len(models))), "boost")
            release(state)
            state, waiting = new, []
    release(state)
    return dict(zip(names, models, strict=True))


def _bins(features: list[str], edges: list[list[float]]) -> Column:
    """The bin of each feature: the number of its edges below the value."""
    return F.array(*(F.size(F.filter(F.array(*map(F.lit, e)).cast("array<double>"), _below(f))) for f, e in zip(features, edges, strict=True)))


def _below(feature: str):  # noqa: ANN202
    return lambda x: x < F.col(feature)


def _advanced(waiting: list[list[Tree]], k: int) -> Column:
    """Predictions of the k models after the trees that are not yet written."""
    return F.array(*(sum((trees[m].walk(lambda f: F.get("bins", F.lit(f)))[1] for trees in waiting), F.get("p", F.lit(m))) for m in range(k)))


def cross_validated(df: DataFrame, features: list[str], response: str, fold: str, settings: Settings, key: str | None = None) -> DataFrame:
    """One row a left-out fold: fold, n, r2, rmse, mae, of the model without it."""
    models = fit(df, features, response, settings, fold, key)
    p = F.lit(None).cast("double")
    for name, m in models.items():
        p = F.when(F.col(fold) == name, m.prediction()).otherwise(p)
    rows = stored(df.select(F.col(fold).cast("int").alias("fold"), F.col(response).cast("double").alias("a"), p.alias("p")), "folds")
    ssr = F.sum((F.col("a") - F.col("p")) * (F.col("a") - F.col("p")))
    return rows.groupBy("fold").agg(F.count("*").alias("n"), (1 - ssr / (F.var_pop("a") * F.count("*"))).alias("r2"), F.sqrt(ssr / F.count("*")).alias("rmse"), F.avg(F.abs(F.col("a") - F.col("p"))).alias("mae"))
