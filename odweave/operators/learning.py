"""Spatially blocked tree models, permutation importance and exact Shapley values."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.operators import boosting
from odweave.operators.grouping import numbered
from odweave.operators.permutations import PRIME, permuted_arrays
from odweave.operators.regression import fit_ols, regression_metrics
from odweave.operators.spatial import CHUNK, PLACES, _spread
from odweave.storage import release, scratch_dir, stored

# Fixed value: the seed of folds and models.
SEED = 20260722
#: Numbers that a block of permuted rows may hold (32 MB).
CELLS = 1 << 22


def folds_from_centres(assigned: DataFrame, centres: list[tuple[int, float, float]]) -> DataFrame:
    """Relabels clusters 0.. by the sum of their centre's coordinates."""
    order = {c: i for i, (c, x, y) in enumerate(sorted(centres, key=lambda t: (t[1] + t[2], t[0])))}
    label = F.create_map(*(F.lit(v) for kv in order.items() for v in kv))
    return assigned.withColumn("fold", label[F.col("_cluster")]).drop("_cluster")


def _seeds(points: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """k-means++ centres of a sample."""
    chosen = [points[r.integers(len(points))]]
    near = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        p = near / near.sum() if near.sum() > 0 else None
        chosen.append(points[r.choice(len(points), p=p)])
        near = np.minimum(near, ((points - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _run_sums(centres: np.ndarray):  # noqa: ANN202
    """Of a task's points: for each run and its clusters the number of nearest points, their coordinates' sums, and that of squared distances."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, k, _ = centres.shape
        total = np.zeros((starts * k, 4))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x, y = (batch.column(c).slice(at, 4096).to_numpy() for c in ("x", "y"))
                distances = (x[:, None, None] - centres[None, :, :, 0]) ** 2 + (y[:, None, None] - centres[None, :, :, 1]) ** 2
                near = distances.argmin(2)
                d = np.take_along_axis(distances, near[:, :, None], 2)[:, :, 0]
                slot = (near + np.arange(starts) * k).ravel()
                for m, v in enumerate((np.ones(len(x)), x, y, d)):
                    total[:, m] += np.bincount(slot, (v if v.ndim == 2 else np.repeat(v[:, None], starts, 1)).ravel(), starts * k)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["a"])

    return sums


def kmeans_folds(areas: DataFrame, k: int = 5, starts: int = 50, seed: int = SEED, rounds: int = 100, sample: int = 10_000) -> DataFrame:
    """areas (x, y) with fold: the best of many k-means runs on the coordinates.  All runs go side by side: a round is one aggregate
    that gives each run's new centres.  First centres come from a sample of the points by their hash."""
    points = areas.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    some = np.array([(r["x"], r["y"]) for r in points.orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample).collect()], float)
    if not len(some):
        return areas.withColumn("fold", F.lit(None).cast("int"))
    r = np.random.default_rng(seed)
    centres = np.stack([_seeds(some, k, r) for _ in range(starts)])

    def nearest(run: np.ndarray) -> Column:
        """The cluster of a point."""
        distance = lambda i, c: F.struct((F.pow(F.col("x").cast("double") - float(c[0]), 2) + F.pow(F.col("y").cast("double") - float(c[1]), 2)).alias("d"), F.lit(i).alias("c"))
        return F.array_min(F.array(*(distance(i, c) for i, c in enumerate(run))))["c"]

    points = stored(points, "points")
    for _ in range(rounds):
        rows = points.mapInArrow(_run_sums(centres), "a array<double>").select(F.posexplode("a").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros(starts * k * 4)
        for s in rows:  # a number for each run, cluster and moment
            sums[s["at"]] = s["v"]
        n, x, y, d = np.moveaxis(sums.reshape(starts, k, 4), 2, 0)
        cost, new = d.sum(1), centres.copy()
        new[n > 0] = np.stack([x[n > 0] / n[n > 0], y[n > 0] / n[n > 0]], 1)
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-12:
            break
    release(points)
    best = centres[int(cost.argmin())]
    out = areas.withColumn("_cluster", nearest(best))
    return folds_from_centres(out, [(i, float(c[0]), float(c[1])) for i, c in enumerate(best)])


def strip_folds(areas: DataFrame, k: int = 5) -> DataFrame:
    """Folds as strips of equal width along x (deterministic, for lattices)."""
    m = areas.agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    width = (F.col("_b") - F.col("_a") + 1) / k
    return areas.crossJoin(F.broadcast(m)).withColumn("fold", F.least(F.floor((F.col("x") - F.col("_a")) / width), F.lit(k - 1)).cast("int")).drop("_a", "_b")


def random_forest(trees: int = 500, depth: int = 30, seed: int = SEED) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="_v", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)


def boosted_trees(rounds: int = 500, depth: int = 3, rate: float = 0.05, share: float = 0.8, seed: int = SEED) -> GBTRegressor:
    return GBTRegressor(featuresCol="_v", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_v").transform(df)


def fit_model(train: DataFrame, estimator, response: str):  # noqa: ANN001, ANN201
    return estimator.copy({estimator.labelCol: response, estimator.predictionCol: "_p"}).fit(train)


def score_model(model, data: DataFrame, response: str) -> dict[str, float]:  # noqa: ANN001
    return regression_metrics(model.transform(data), response, "_p").first().asDict()


def cross_validate(df: DataFrame, estimator, features: list[str], response: str, fold: str = "fold") -> DataFrame:  # noqa: ANN001
    """One row a left-out fold: its metrics.  Every fold is left out once, the held-out test fold too.  Folds are fitted at the same time."""
    data = stored(assembled(df, features).select("_v", response, fold), "folds")
    names = sorted(r[0] for r in data.select(fold).distinct().collect())

    def one(f: int) -> tuple:
        m = score_model(fit_model(data.where(F.col(fold) != f), estimator, response), data.where(F.col(fold) == f), response)
        return int(f), int(m["n"]), m["r2"], m["rmse"], m["mae"]

    with ThreadPoolExecutor(max_workers=len(names) or 1) as pool:
        rows = list(pool.map(one, names))
    release(data)
    return df.sparkSession.createDataFrame(rows, "fold int, n long, r2 double, rmse double, mae double")


def _dealt_features(n: int, k: int, repeats: int, block: int):  # noqa: ANN202
    """Of batches of (_k, x0, x1, ...): for each block of places, where the permutations of each of the k features put its values."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                at = part.column("_k").to_numpy()
                place = np.concatenate([permuted_arrays(at, n, f * repeats + np.arange(1, repeats + 1), inverse=True) for f in range(k)]).ravel()
                r = np.repeat(np.arange(k * repeats, dtype=np.int32), len(at))
                v = np.concatenate([np.tile(part.column(f"x{f}").to_numpy(), repeats) for f in range(k)])
                by = np.argsort(place // block, kind="stable")
                place, r, v = place[by], r[by], v[by]
                blocks, first = np.unique(place // block, return_index=True)
                ends = [*first[1:], len(place)]
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(blocks), cut(r), cut((place % block).astype(np.int32)), cut(v)], names=["b", "r", "at", "v"])

    return deal


def _mixed_rows(k: int, repeats: int, block: int):  # noqa: ANN202
    """A block's rows (_k, a, x0, x1, ...) once for each permutation r, with the values that it deals them."""

    def mix(values: pa.Table, rows: pa.Table) -> pa.Table:
        at = rows.column("_k").to_numpy() % block
        new = np.zeros((k * repeats, block))
        for r, place, v in zip(*(values.column(c).to_pylist() for c in ("r", "at", "v")), strict=True):
            new[np.frombuffer(r, np.int32), np.frombuffer(place, np.int32)] = np.frombuffer(v)
        new = new[:, at]
        columns = []
        for f in range(k):
            x = np.tile(rows.column(f"x{f}").to_numpy(), (k * repeats, 1))
            x[f * repeats : (f + 1) * repeats] = new[f * repeats : (f + 1) * repeats]
            columns.append(pa.array(x.ravel()))
        a = pa.concat_arrays(rows.column("a").chunks * (k * repeats))
        return pa.Table.from_arrays([pa.array(np.repeat(np.arange(1, k * repeats + 1, dtype=np.int32), len(at))), a, *columns], names=["r", "a", *(f"x{f}" for f in range(k))])

    return mix


def permutation_importance(model, df: DataFrame, features: list[str], response: str, key: str, repeats: int = 30) -> DataFrame:  # noqa: ANN001
    """(feature, mean, sd, rank) of the drop of R2 when a feature's values are dealt anew: repeat r of the f-th feature gives each row the value of the
    row whose rank in key order is its own rank under permutation f * repeats + r + 1.  All features and repeats are one program without a sort: values
    are sent, packed, to the blocks of places where the permutations put them, and meet the blocks' rows there."""
    base, k = score_model(model, assembled(df, features), response)["r2"], len(features)
    kind = "feature string, mean double, sd double, rank int"
    if not k:
        return df.sparkSession.createDataFrame([], kind)
    x = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    rows = numbered(df.select(F.col(key).alias("_key"), F.col(response).cast("double").alias("a"), *x), [F.col("_key")], "_k")
    rows = stored(rows.withColumn("_k", F.col("_k") - 1).drop("_key"), "numbered")
    n = rows.count()
    if n >= PRIME:
        raise ValueError(f"{n} places; at most {PRIME - 1}")
    block = max(1, min(PLACES, max(64, n // 64), CELLS // (k * repeats * (k + 2))))
    dealt = _spread(rows.drop("a"), n, "_k").mapInArrow(_dealt_features(n, k, repeats, block), "b long, r binary, at binary, v binary")
    own = rows.withColumn("b", F.floor(F.col("_k") / block))
    mixed = dealt.groupBy("b").cogroup(own.groupBy("b")).applyInArrow(_mixed_rows(k, repeats, block), "r int, a double, " + ", ".join(f"x{i} double" for i in range(k)))
    e = model.transform(assembled(mixed, [f"x{i}" for i in range(k)]))
    a, p = F.col("a"), F.col("_p")
    r2 = 1 - F.sum((a - p) * (a - p)) / (F.var_pop(a) * F.count("*"))
    drops = stored(e.groupBy("r").agg((F.lit(base) - r2).alias("drop")), "drops")  # a row for each feature and repeat
    release(rows)
    feature = F.get(F.array(*map(F.lit, features)), F.floor((F.col("r") - 1) / repeats).cast("int"))
    out = drops.groupBy(feature.alias("feature")).agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("sd"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "feature")))  # one row a feature


def compare_held_out(df: DataFrame, features: list[str], response: str, estimators: dict, fold: str = "fold", test_fold: int = 0, key: str | None = None) -> tuple[DataFrame, dict]:
    """(table, fitted models): OLS and tree models on the same held-out fold - model, n_train, n_test, cv_r2 (mean over all folds, null for
    OLS), test_r2, rmse, mae, best (of the tree models the one with the largest test R2).  An estimator is one of pyspark.ml or a boosting.Settings, whose row
    samples need a key."""
    train, test = df.where(F.col(fold) != test_fold), df.where(F.col(fold) == test_fold)
    n_train = train.count()
    ols = fit_ols(train, response, features)
    m = regression_metrics(test.withColumn("_p", ols.fitted()), response, "_p").first()
    rows, fitted = [("OLS", n_train, m["n"], None, m["r2"], m["rmse"], m["mae"])], {}
    for name, estimator in estimators.items():
        if isinstance(estimator, boosting.Settings):
            cv = boosting.cross_validated(df, features, response, fold, estimator, key).agg(F.avg("r2")).first()[0]
            fitted[name] = boosting.fit(train, features, response, estimator, key=key)[None]
            m = regression_metrics(test.withColumn("_p", fitted[name].prediction()), response, "_p").first()
            rows.append((name, n_train, int(m["n"]), cv, m["r2"], m["rmse"], m["mae"]))
            continue
        cv = cross_validate(df, estimator, features, response, fold).agg(F.avg("r2")).first()[0]
        fitted[name] = fit_model(assembled(train, features), estimator, response)
        m = score_model(fitted[name], assembled(test, features), response)
        rows.append((name, n_train, int(m["n"]), cv, m["r2"], m["rmse"], m["mae"]))
    best = max(rows[1:], key=lambda r: r[4])[0] if len(rows) > 1 else None
    out = [(*r, (r[0] == best) if r[0] in fitted else None) for r in rows]
    return df.sparkSession.createDataFrame(out, "model string, n_train long, n_test long, cv_r2 double, test_r2 double, rmse double, mae double, best boolean"), fitted


# --- Shapley values -------------------------------------------------------------------------


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)


def read_trees(model, spark) -> tuple[list[Tree], list[float]]:  # noqa: ANN001
    """A fitted ensemble's trees with node covers, and their weights, from its saved form (as large as the model, not the data)."""
    import uuid

    path = f"{scratch_dir(spark)}/odweave/model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    trees: dict[int, Tree] = {}
    for r in rows:
        t = trees.setdefault(r["treeID"], Tree())
        leaf = r["leftChild"] < 0
        t.feature.append(-1 if leaf else r["split"]["featureIndex"])
        t.cut.append(0.0 if leaf else r["split"]["leftCategoriesOrThreshold"][0])
        t.left.append(r["leftChild"])
        t.right.append(r["rightChild"])
        t.value.append(r["prediction"])
        t.cover.append(float(r["rawCount"]))
    weights = list(model.treeWeights)
    if model.__class__.__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    return [trees[k] for k in sorted(trees)], weights


def coalition_values(tree: Tree, x: np.ndarray, k: int) -> np.ndarray:
    """[rows, 2**k] expectations of a tree for every coalition: known features follow the row, others split by cover."""
    masks = np.arange(1 << k)

    def node(i: int) -> np.ndarray:
        f = tree.feature[i]
        if f < 0:
            return np.full((len(x), 1), tree.value[i])
        a, b = node(tree.left[i]), node(tree.right[i])
        p = tree.cover[tree.left[i]] / (tree.cover[tree.left[i]] + tree.cover[tree.right[i]])
        goes = (x[:, f] <= tree.cut[i])[:, None]
        known = (masks >> f & 1).astype(bool)[None]
        return np.where(known, np.where(goes, a, b), p * a + (1 - p) * b)

    return np.broadcast_to(node(0), (len(x), 1 << k))


def shapley(trees: list[Tree], weights: list[float], x: np.ndarray) -> np.ndarray:
    """[rows, k + 1]: the exact Shapley value of each feature, and the expectation without any."""
    from math import factorial

    k = x.shape[1]
    v = sum(w * coalition_values(t, x, k) for t, w in zip(trees, weights, strict=True))
    masks = np.arange(1 << k)
    size = np.array([bin(m).count("1") for m in masks])
    weight = np.array([factorial(s) * factorial(k - s - 1) / factorial(k) if s < k else 0.0 for s in size])
    out = np.zeros((len(x), k + 1))
    for f in range(k):
        without = masks[(masks >> f & 1) == 0]
        out[:, f] = ((v[:, without | 1 << f] - v[:, without]) * weight[without]).sum(1)
    out[:, k] = v[:, 0]
    return out


def shap_values(model, df: DataFrame, features: list[str], key: str) -> DataFrame:  # noqa: ANN001
    """(key, shap_<feature>..., expected) of every row; they add up to the prediction."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_trees(model, spark))  # as large as the model
    names = [f"shap_{f}" for f in features] + ["expected"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, weights = shared.value
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                s = shapley(trees, weights, part[features].to_numpy(float))
                yield pd.DataFrame({key: part[key].to_numpy(), **{n: s[:, i] for i, n in enumerate(names)}})

    kind = dict(df.dtypes)[key]
    return df.select(key, *features).mapInPandas(step, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))
