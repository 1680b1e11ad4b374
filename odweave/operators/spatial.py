"""Contiguity graphs, spatial lag, Moran statistics, local clusters and point-in-polygon.

A weights graph is an edge table (i, j, w).  Permutations are arithmetic on ranks (see permutations), so results are the same in SQL, and do not
depend on a random generator or on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import selection
from odweave.operators.grouping import components, numbered
from odweave.operators.permutations import PRIME, permuted, permuted_arrays
from odweave.storage import release, stored

#: Places of a block of permuted values (16 MB under 999 permutations); areas and permutations whose places are reckoned at a time.
PLACES, CHUNK, REPEATS = 2048, 2048, 64


# --- contiguity -----------------------------------------------------------------------------


def lattice_edges(areas: DataFrame, key: str = "area") -> DataFrame:
    """(i, j) of unit squares at (x, y) that share a side or corner: eight offsets a cell and an equi-join."""
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    near = areas.select(F.col(key).alias("i"), "x", "y", F.explode(offsets).alias("o")).select("i", (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"))
    return near.join(areas.select(F.col(key).alias("j"), "x", "y"), ["x", "y"]).select("i", "j")


def polygon_edges(polygons: DataFrame, key: str = "area", ring: str = "ring") -> DataFrame:
    """(i, j) of polygons that share a vertex: an equi-self-join on vertices.  ring: array of (x, y)."""
    v = polygons.select(F.col(key).alias("i"), F.explode(ring).alias("v")).select("i", F.col("v.x").alias("x"), F.col("v.y").alias("y")).distinct()
    return v.join(v.withColumnRenamed("i", "j"), ["x", "y"]).where("i != j").select("i", "j").distinct()


def row_standardised(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", (F.lit(1.0) / F.count("*").over(Window.partitionBy("i"))).alias("w"))


def degrees(areas: DataFrame, edges: DataFrame, key: str = "area") -> DataFrame:
    return areas.select(F.col(key).alias("i")).join(edges.groupBy("i").agg(F.count("*").alias("degree")), "i", "left").fillna(0, ["degree"])


def weights_diagnostics(areas: DataFrame, edges: DataFrame, key: str = "area") -> DataFrame:
    """One row: areas, islands, components, and the least, largest, mean and median degree."""
    d = degrees(areas, edges, key).agg(
        F.count("*").alias("n"), F.count_if(F.col("degree") == 0).alias("islands"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"), F.median("degree").alias("median_degree")
    )
    c = component_labels(areas, edges, key).agg(F.count_distinct("component").alias("components"))
    return d.crossJoin(F.broadcast(c))  # one row each


def component_labels(areas: DataFrame, edges: DataFrame, key: str = "area") -> DataFrame:
    """(area, component): the smallest area that can be reached."""
    found = components(edges.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return areas.select(F.col(key).alias("node")).join(found, "node", "left").select(F.col("node").alias(key), F.coalesce("component", "node").alias("component"))


def subset_weights(edges: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Edges among kept areas, standardised anew, so that dropped rows leave no weight behind."""
    k = keep.select(F.col(key).alias("i")).distinct()
    return row_standardised(edges.select("i", "j").join(k, "i", "left_semi").join(k.withColumnRenamed("i", "j"), "j", "left_semi"))


# --- lag and global Moran -------------------------------------------------------------------


def lag(values: DataFrame, weights: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """values with lag_<column> of each column; an area without neighbours has lag 0."""
    side = values.select(F.col(key).alias("j"), *(F.col(c).alias(f"_v_{c}") for c in columns))
    sums = weights.join(side, "j").groupBy("i").agg(*(F.sum(F.col("w") * F.col(f"_v_{c}")).alias(f"lag_{c}") for c in columns))
    return values.join(sums.withColumnRenamed("i", key), key, "left").fillna(0.0, [f"lag_{c}" for c in columns])


def standardised(values: DataFrame, column: str, name: str = "z") -> DataFrame:
    """z-scores with the population deviation; the moments are one row, broadcast."""
    m = values.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return values.crossJoin(F.broadcast(m)).withColumn(name, S.safe_ratio(F.col(column) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def moran(values: DataFrame, weights: DataFrame, key: str, column: str) -> DataFrame:
    """One row: n, I, E, variance under normality, and its z-score."""
    z = lag(standardised(values, column).select(key, "z"), weights, key, ["z"])
    i = z.agg(F.count("*").cast("double").alias("n"), F.sum(F.col("z") * F.col("lag_z")).alias("zl"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    both = weights.select("i", "j", "w").union(weights.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    s1 = both.groupBy("i", "j").agg(F.sum("w").alias("t")).agg((F.sum(F.col("t") * F.col("t")) / 2).alias("s1"))
    out_in = weights.select(F.col("i").alias("k"), "w").union(weights.select(F.col("j").alias("k"), "w"))
    s2 = out_in.groupBy("k").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    s0 = weights.agg(F.sum("w").alias("s0"))
    r = i.crossJoin(F.broadcast(s0)).crossJoin(F.broadcast(s1)).crossJoin(F.broadcast(s2))  # four single rows
    n, e = F.col("n"), -1 / (F.col("n") - 1)
    var = (n * n * F.col("s1") - n * F.col("s2") + 3 * F.col("s0") * F.col("s0")) / ((n * n - 1) * F.col("s0") * F.col("s0")) - e * e
    r = r.select(n.cast("long").alias("n"), (n / F.col("s0") * F.col("zl") / F.col("zz")).alias("moran_i"), e.alias("expected_i"), var.alias("variance"))
    return r.withColumn("z_norm", (F.col("moran_i") - F.col("expected_i")) / F.sqrt("variance"))


def _spread(rows: DataFrame, n: int, k: str) -> DataFrame:
    """n rows in as many parts as their permutations are worth: none has more than CHUNK rows or so."""
    parts = max(n // CHUNK, min(n // 128, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))) + 1
    return rows.repartition(parts, k)


def _dealt(n: int, permutations: int, block: int):  # noqa: ANN202
    """Of batches of (k, z): for each block of places, where the permutations 0 (no change), 1, ... put each value."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["b", "r", "at", "z"]
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                k, z = part.column("k").to_numpy(), part.column("z").to_numpy()
                r = np.arange(permutations + 1)
                place = np.concatenate([permuted_arrays(k, n, r[low : low + REPEATS], inverse=True) for low in range(0, len(r), REPEATS)])
                place[0] = k
                place, r = place.ravel(), np.repeat(r.astype(np.int32), len(k))
                by = np.argsort((place // block).astype(np.int32), kind="stable")
                place, r, v = place[by], r[by], np.tile(z, permutations + 1)[by]
                at, first = np.unique(place // block, return_index=True)
                ends = [*first[1:], len(place)]
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(at), cut(r), cut((place % block).astype(np.int32)), cut(v)], names=names)

    return deal


def _block_sums(permutations: int, block: int):  # noqa: ANN202
    """Of a block's values under all permutations and its edges: the sums over edges inside it (a row without k), and the values of its
    places that have edges to others."""

    def sums(values: pa.Table, edges: pa.Table) -> pa.Table:
        a = np.zeros((block, permutations + 1))
        for r, at, z in zip(*(values.column(c).to_pylist() for c in ("r", "at", "z")), strict=True):
            a[np.frombuffer(at, np.int32), np.frombuffer(r, np.int32)] = np.frombuffer(z)
        i, j, w = (edges.column(c).to_numpy() for c in ("ki", "kj", "w"))
        first = values.column("b")[0].as_py() * block
        inside = (i >= first) & (i < first + block) & (j >= first) & (j < first + block)
        total = np.zeros(permutations + 1)
        for e in np.array_split(np.flatnonzero(inside), inside.sum() // 1024 + 1):
            total += (a[i[e] - first] * a[j[e] - first] * w[e][:, None]).sum(0)
        ends = np.concatenate([i[~inside], j[~inside]])
        ends = np.unique(ends[(ends >= first) & (ends < first + block)])
        rows = np.concatenate([total[None], a[ends - first]])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, permutations + 1, dtype=np.int32)), pa.array(rows.ravel()))
        return pa.Table.from_arrays([pa.array([None, *ends.tolist()], pa.int64()), lists], names=["k", "a"])

    return sums


def _pair_sums(permutations: int):  # noqa: ANN202
    """The sum of w a b over a task's pairs, entry by entry."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(permutations + 1)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                a, b = (part.column(c).flatten().to_numpy().reshape(-1, permutations + 1) for c in "ab")
                total += (a * b * part.column("w").to_numpy()[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["a"])

    return sums


def moran_permutation(values: DataFrame, weights: DataFrame, key: str, column: str, permutations: int = 99) -> DataFrame:
    """Global Moran's I with a permutation p-value: permutation r gives the k-th id, in key order, the value of the permuted k.  Values are
    sent, packed, to the blocks of places where the permutations put them: one exchange of areas x permutations.  Edges within a block are summed
    there; the others meet arrays of the areas at the blocks' borders."""
    z = stored(numbered(standardised(values, column).select(key, "z"), [F.col(key)], "k").withColumn("k", F.col("k") - 1), "numbered")
    n, block = z.count(), PLACES
    if n >= PRIME:
        raise ValueError(f"{n} places; at most {PRIME - 1}")
    place = z.select(key, "k")
    edges = stored(weights.join(place.toDF("i", "ki"), "i").join(place.toDF("j", "kj"), "j").select("ki", "kj", "w", F.floor(F.col("ki") / block).alias("b"), F.floor(F.col("kj") / block).alias("bj")), "edges")
    dealt = _spread(z.select("k", "z"), n, "k").mapInArrow(_dealt(n, permutations, block), "b long, r binary, at binary, z binary")
    both = edges.select("b", "ki", "kj", "w").union(edges.where("b != bj").select("bj", "ki", "kj", "w"))  # an edge between blocks shows both its ends
    rows = stored(dealt.groupBy("b").cogroup(both.groupBy("b")).applyInArrow(_block_sums(permutations, block), "k long, a array<double>"), "arrays")
    ends = rows.where("k IS NOT NULL")
    pairs = edges.where("b != bj").join(ends.toDF("ki", "a"), "ki").join(ends.toDF("kj", "b_"), "kj").select("a", F.col("b_").alias("b"), "w")
    each = rows.where("k IS NULL").select("a").union(pairs.mapInArrow(_pair_sums(permutations), "a array<double>")).select(F.posexplode("a").alias("r", "c"))
    totals = z.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz")).crossJoin(F.broadcast(edges.agg(F.sum("w").alias("s0"))))
    stats = each.groupBy("r").agg(F.sum("c").alias("c")).crossJoin(F.broadcast(totals)).select("r", (F.col("n") / F.col("s0") * F.col("c") / F.col("zz")).alias("i"))
    stats = stored(stats, "permuted")  # one row a permutation
    release(z, edges, rows)
    one = stats.where("r = 0").select(F.col("i").alias("moran_i"))
    s = stats.where("r > 0").crossJoin(F.broadcast(one))
    t = s.groupBy("moran_i").agg(F.count_if(F.col("i") >= F.col("moran_i") - 1e-12).alias("larger"), F.count("*").alias("permutations"), F.avg("i").alias("mean_simulated"), F.stddev_pop("i").alias("sd_simulated"))
    few = F.least(F.col("larger"), F.col("permutations") - F.col("larger"))
    return t.select("moran_i", "larger", "permutations", "mean_simulated", "sd_simulated", ((few + 1) / (F.col("permutations") + 1)).alias("p_sim"), S.safe_ratio(F.col("moran_i") - F.col("mean_simulated"), F.col("sd_simulated")).alias("z_sim"))


# --- local Moran ----------------------------------------------------------------------------


def local_moran(values: DataFrame, weights: DataFrame, key: str, column: str) -> DataFrame:
    """(key, value, z, lag_z, local_i, quadrant, neighbours)."""
    z = lag(standardised(values.select(key, F.col(column).alias("value")), "value"), weights, key, ["z"])
    m = z.agg((F.sum(F.col("z") * F.col("z")) / (F.count("*") - 1)).alias("_m2"))
    d = weights.groupBy("i").agg(F.count("*").alias("neighbours")).withColumnRenamed("i", key)
    r = z.crossJoin(F.broadcast(m)).withColumns({"local_i": F.col("z") * F.col("lag_z") / F.col("_m2"), "quadrant": S.quadrant(F.col("z"), F.col("lag_z"))}).drop("_m2")
    return r.join(d, key, "left").fillna(0, ["neighbours"])


def local_p_values(local: DataFrame, key: str, permutations: int = 99) -> DataFrame:
    """local with p_sim of conditional permutations: with area i fixed, its d neighbours' values are those of the first d ids other than
    i in permutation r's order.

    Their sum is that of the first d ids, or, if i is among them, of the first d + 1 less i's own value.  So permutations need their sums at
    the degrees that occur only, and an area its place in each; the work is areas x permutations, whatever the degrees."""
    rows = stored(numbered(local, [F.col(key)], "_k").withColumn("_k", F.col("_k") - 1), "numbered")
    n, most = rows.agg(F.count("*"), F.coalesce(F.max("neighbours"), F.lit(0))).first()
    spark = local.sparkSession
    places = spark.range(min(n, most + 1)).withColumnRenamed("id", "_place").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    if not n:
        return local.withColumn("p_sim", F.lit(1.0))
    drawn = permuted(places.withColumn("_k", F.col("_place")), "_k", n, permutations)
    heads = drawn.join(rows.select("_k", "z"), "_k")
    so_far = F.sum("z").over(Window.partitionBy("r").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))  # the largest degree's rows
    degrees = rows.select(F.col("neighbours").cast("long").alias("d")).where("d > 0").distinct()
    sums = heads.select("r", (F.col("_place") + 1).alias("m"), so_far.alias("s"))
    first = sums.join(degrees, F.col("m") == F.col("d")).select("r", "d", F.col("s").alias("_own"))
    more = sums.join(degrees, F.col("m") == F.col("d") + 1).select("r", "d", F.col("s").alias("_more"))
    at = stored(first.join(more, ["r", "d"], "left"), "sums")
    known = sorted((r["r"], r["d"], r["_own"], r["_more"]) for r in at.collect())  # a row for each permutation and degree that occurs
    number = {d: c for c, d in enumerate(sorted({d for _, d, _, _ in known}))}
    own, more = np.zeros((permutations, len(number))), np.full((permutations, len(number)), np.nan)
    for r, d, a, b in known:
        own[r - 1, number[d]], more[r - 1, number[d]] = a, np.nan if b is None else b
    release(drawn, at)
    counted = stored(_spread(rows.select(*local.columns, "_k"), n, "_k").mapInArrow(_larger(n, permutations, own, more, number), rows.select(*local.columns).withColumn("_larger", F.lit(None).cast("long")).schema), "p_values")
    release(rows)
    few = F.least(F.col("_larger"), F.lit(permutations) - F.col("_larger"))
    return counted.withColumn("p_sim", F.coalesce((few + 1) / F.lit(permutations + 1.0), F.lit(1.0))).drop("_larger")


def _larger(n: int, permutations: int, own: np.ndarray, more: np.ndarray, number: dict[int, int]):  # noqa: ANN202
    """Rows with the number of permutations whose local statistic is not below the row's (null without neighbours)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, z, lag, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_k", "z", "lag_z", "neighbours"))
            out = np.zeros(len(k), np.int64)
            for start in range(0, len(k), CHUNK):
                part = slice(start, start + CHUNK)
                at = np.flatnonzero(d[part] > 0) + start
                column = np.array([number[v] for v in d[at]], int)
                for low in range(0, permutations, REPEATS):
                    r = np.arange(low, min(low + REPEATS, permutations))
                    place = permuted_arrays(k[at], n, r + 1, inverse=True)
                    s = np.where(place < d[at], more[r][:, column] - z[at], own[r][:, column])
                    out[at] += (s / d[at] * z[at] >= z[at] * lag[at] - 1e-12).sum(0)
            kept = [c for c in batch.schema.names if c != "_k"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, mask=d <= 0)], names=[*kept, "_larger"])

    return count


def lisa(values: DataFrame, weights: DataFrame, key: str, column: str, permutations: int = 99, alpha: float = 0.05) -> DataFrame:
    r = local_p_values(local_moran(values, weights, key, column), key, permutations)
    sig = F.col("p_sim") < alpha
    return r.withColumns({"significant": sig, "cluster": S.cluster(F.col("quadrant"), sig), "p_bin": S.significance_bin(F.col("p_sim"))})


def lisa_summary(table: DataFrame) -> DataFrame:
    """Per cluster (all five, those without areas too): count, shares, and means and medians."""
    spark = table.sparkSession
    dim = spark.createDataFrame([(c, i) for i, c in enumerate(S.CLUSTERS)], "cluster string, category_rank int")
    g = table.groupBy("cluster").agg(F.count("*").alias("areas"), F.avg("value").alias("mean_value"), F.avg("local_i").alias("mean_local_i"))
    each = F.explode(F.array(*(F.struct(F.concat("cluster", F.lit(f":{c}")).alias("g"), F.col(c).cast("double").alias("v")) for c in ("value", "p_sim"))))
    q = selection.quantiles(table.select(each.alias("r")).select("r.*").where("v IS NOT NULL"), [0.5])
    middles = [(c, *(q.get(f"{c}:{x}", [None])[0] for x in ("value", "p_sim"))) for c in S.CLUSTERS]
    g = g.join(F.broadcast(spark.createDataFrame(middles, "cluster string, median_value double, median_p double")), "cluster")
    all_ = table.agg(F.count("*").alias("_n"), F.count_if("significant").alias("_s"))
    r = F.broadcast(dim).join(g, "cluster", "left").fillna(0, ["areas"]).crossJoin(F.broadcast(all_))
    of_sig = F.when(F.col("cluster") != S.CLUSTERS[4], F.coalesce(S.safe_ratio(F.col("areas") * 100, F.col("_s")), F.lit(0.0)))
    return r.select("cluster", "category_rank", "areas", (F.col("areas") / F.col("_n") * 100).alias("pct_all"), of_sig.alias("pct_significant"), "mean_value", "median_value", "mean_local_i", "median_p")


def lisa_top(table: DataFrame, key: str, most: int = 20) -> DataFrame:
    w = Window.partitionBy("cluster").orderBy("p_sim", F.desc(F.abs("local_i")), F.desc("value"), key)
    return table.where("significant").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two LISA tables side by side with their hotspot class."""
    j = a.select(key, F.col("cluster").alias("first")).join(b.select(key, F.col("cluster").alias("second")), key)
    return j.withColumn("hotspot", S.hotspot_class(F.col("first"), F.col("second")))


def overlap_metrics(table: DataFrame) -> DataFrame:
    hot, cold = S.CLUSTERS[0], S.CLUSTERS[1]
    c = lambda x: F.count_if(x).alias
    a, b = F.col("first"), F.col("second")
    r = table.agg(
        F.count("*").alias("areas"), c((a == hot) & (b == hot))("both_high_high"), c((a == cold) & (b == cold))("both_low_low"), c((a == hot) & (b != hot))("first_hot_only"),
        c((a != hot) & (b == hot))("second_hot_only"), c((a == hot) != (b == hot))("differing_hot"), c(a == b)("same_cluster"),
    )
    names = r.columns
    return r.select(*(F.col(x).cast("double").alias(x) for x in names)).unpivot(["areas"], names[1:], "metric", "value").select("metric", "value", S.safe_ratio(F.col("value") * 100, F.col("areas")).alias("pct"))


# --- geometry -------------------------------------------------------------------------------


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    n = F.size(ring)
    i = F.sequence(F.lit(0), n - 1)
    at = lambda k: F.get(ring, k % n)
    return F.abs(F.aggregate(i, F.lit(0.0), lambda s, k: s + at(k)["x"] * at(k + 1)["y"] - at(k + 1)["x"] * at(k)["y"])) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Centroid of the area within the ring; of a ring without area the mean of its vertices."""
    n = F.size(ring)
    i = F.sequence(F.lit(0), n - 1)
    at = lambda k: F.get(ring, k % n)
    # relative to the first vertex, so that large coordinates lose no digits
    x = lambda k: at(k)["x"] - at(F.lit(0))["x"]
    y = lambda k: at(k)["y"] - at(F.lit(0))["y"]
    cross = lambda k: x(k) * y(k + 1) - x(k + 1) * y(k)
    twice = F.aggregate(i, F.lit(0.0), lambda s, k: s + cross(k))
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, v: s + v[f]) / n
    part = lambda c: F.aggregate(i, F.lit(0.0), lambda s, k: s + (c(k) + c(k + 1)) * cross(k))
    centre = lambda c, f: F.coalesce(at(F.lit(0))[f] + F.try_divide(part(c), 3 * twice), mean(f))
    return centre(x, "x"), centre(y, "y")


def ring_bounds(ring: Column) -> Column:
    """(min_x, min_y, max_x, max_y) of a ring."""
    side = lambda f, g: g(F.transform(ring, lambda v: v[f]))
    return F.struct(side("x", F.array_min).alias("min_x"), side("y", F.array_min).alias("min_y"), side("x", F.array_max).alias("max_x"), side("y", F.array_max).alias("max_y"))


def ring_is_empty(ring: Column) -> Column:
    return F.coalesce(F.size(ring) == 0, F.lit(True))


def ring_is_valid(ring: Column) -> Column:
    """Three different vertices at least, an area, finite numbers, and no two sides that cross (sides may touch at their ends)."""
    n = F.size(ring)
    at = lambda k: F.get(ring, k % n)
    ks = F.sequence(F.lit(0), n - 1)

    def turn(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def cross(i: Column, j: Column) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)

    finite = F.forall(ring, lambda v: S.finite(v["x"]).isNotNull() & S.finite(v["y"]).isNotNull())
    crossed = F.exists(ks, lambda i: F.exists(ks, lambda j: (j > i) & cross(i, j)))
    return F.coalesce((F.size(F.array_distinct(ring)) >= 3) & finite & (ring_area(ring) > 0) & ~crossed, F.lit(False))


def boundary(polygons: DataFrame, by: list[str], ring: str = "ring") -> DataFrame:
    """(by..., ax, ay, bx, by_): sides of the union of each group's polygons, which share whole sides: a side that two of them have is
    inside.  The dissolve of a lattice or of a seamless set of areas."""
    n = F.size(ring)
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_sort(F.array(F.get(ring, k), F.get(ring, (k + 1) % n))))
    s = polygons.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s").agg(F.count("*").alias("n")).where("n = 1")
    return s.select(*by, F.col("s")[0]["x"].alias("ax"), F.col("s")[0]["y"].alias("ay"), F.col("s")[1]["x"].alias("bx"), F.col("s")[1]["y"].alias("by_"))


def dissolve(polygons: DataFrame, by: list[str], ring: str = "ring") -> DataFrame:
    """(by..., areas, size, perimeter, min_x, min_y, max_x, max_y) of the union of each group's polygons."""
    b = ring_bounds(F.col(ring))
    g = polygons.withColumn("_b", b).groupBy(*by).agg(
        F.count("*").alias("areas"), F.sum(ring_area(F.col(ring))).alias("size"), F.min("_b.min_x").alias("min_x"), F.min("_b.min_y").alias("min_y"), F.max("_b.max_x").alias("max_x"), F.max("_b.max_y").alias("max_y")
    )
    length = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by_"), 2))
    p = boundary(polygons, by, ring).groupBy(*by).agg(F.sum(length).alias("perimeter"))
    return g.join(p, by, "left")


def attach_geometry(polygons: DataFrame, table: DataFrame, key: str = "area", how: str = "left", ring: str = "ring") -> DataFrame:
    """Polygons with a table's columns, one to one by key: of indicators, local clusters, overlap classes or residuals."""
    from odweave.operators.quality import one_to_one

    return one_to_one(polygons.select(key, ring), table, key, how)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting; strictly inside only, points on an edge are outside."""
    n = F.size(ring)
    at = lambda k: F.get(ring, k % n)
    ks = F.sequence(F.lit(0), n - 1)
    def crosses(k: Column) -> Column:
        a, b = at(k), at(k + 1)
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"])
    def touches(k: Column) -> Column:
        a, b = at(k), at(k + 1)
        turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        box = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return (F.abs(turn) < 1e-12) & box
    odd = F.size(F.filter(ks, lambda k: F.coalesce(crosses(k), F.lit(False)))) % 2 == 1
    return odd & ~F.exists(ks, touches)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, key: str = "area", ring: str = "ring") -> DataFrame:
    """points (x, y) left-joined with the polygons that contain them.  Every grid cell of side ``cell`` has the list of the polygons
    whose boxes touch it; a point meets its cell's list (an equi-join), then the exact test.  A point in several polygons gives several
    rows, one in none gives one; repeated points stay repeated."""
    box = lambda f, g: g(F.transform(F.col(ring), lambda v: v[f]))
    span = lambda f: F.sequence(F.floor(box(f, F.array_min) / cell), F.floor(box(f, F.array_max) / cell))
    tiles = polygons.select(key, ring, F.explode(span("x")).alias("_cx")).withColumn("_cy", F.explode(span("y")))
    lists = tiles.groupBy("_cx", "_cy").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(ring).alias("r"))).alias("_near"))
    p = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    held = F.transform(F.filter("_near", lambda s: inside(F.col("x"), F.col("y"), s["r"])), lambda s: s["k"])
    return p.join(lists, ["_cx", "_cy"], "left").withColumn(key, F.explode_outer(held)).drop("_cx", "_cy", "_near")
