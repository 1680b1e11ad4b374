"""ln |I - rho S| of a large sparse symmetric matrix S, for many rho at once, by elimination in parallel rounds.

Nodes in the order of their ids are dealt to blocks of BLOCK.  A round eliminates, block by block, the nodes whose neighbours are all in their own
block: the logarithms of their pivots are summed, and the block's other nodes get the Schur complement, which no other block changes.  Where
ids follow the map, most nodes go in a round, and a few rounds do.

Where less than SHARE of the nodes are inside blocks, a round eliminates nodes that have fewer neighbours than any of their neighbours (ties by a hash, so that the nodes of a round are never
neighbours): the pivots' logarithms are summed, and every pair of neighbours of an eliminated node gets its update.  Rows are (i, j, one entry
for each rho), so a round is a few joins of edges and all rho share its structure.  Planar contiguity keeps few neighbours a
node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.operators.grouping import numbered
from odweave.storage import release, stored

#: Nodes of a block, of which the last are one (8 MB of entries for 64 rho; WIDER times as many nodes, 134 MB, where ids follow a wider map); the
#: least share of nodes inside blocks for a round of blocks.
BLOCK, WIDER, SHARE = 128, 4, 0.25


def _sum(column: str, width: int) -> Column:
    """Sum of arrays in a group, in the order of their keys, so that it is the same for any order of rows."""
    listed = F.array_sort(F.collect_list(F.struct("by", column)))
    return F.aggregate(listed, F.array_repeat(F.lit(0.0), width), lambda s, x: F.zip_with(s, x[column], lambda a, b: a + b))


def _chosen(edges: DataFrame, turn: int) -> DataFrame:
    """(v): nodes that come before all their neighbours by (degree, hash, node)."""
    both = edges.select(F.col("i").alias("v"), F.col("j").alias("u")).union(edges.select(F.col("j").alias("v"), F.col("i").alias("u")))
    own = both.groupBy("v").agg(F.count("*").alias("degree")).select("v", F.struct("degree", F.xxhash64("v", F.lit(turn)).alias("h"), "v").alias("key"))
    least = both.join(own.toDF("u", "other"), "u").groupBy("v").agg(F.min("other").alias("other"))
    return own.join(least, "v").where(F.col("key") < F.col("other")).select("v")


def _schur(k: int):  # noqa: ANN202
    """Of one block's entries (i, j, a; i = j on the diagonal) and the marks of its outer nodes: the entries between outer nodes after the others are
    eliminated, and a row without i with the sums of the pivots' logarithms."""

    def eliminate(table: pa.Table) -> pa.Table:
        i, j = table.column("i").combine_chunks(), table.column("j").combine_chunks()
        own = np.flatnonzero(table.column("own").to_numpy())
        ids, outer = i.take(pa.array(own)), table.column("outer").to_numpy()[own]
        order = np.argsort(outer, kind="stable")  # inner nodes first
        ids, inner = ids.take(pa.array(order)), int((~outer).sum())
        index = {v: at for at, v in enumerate(ids.to_pylist())}
        x, y = (np.array([index[v] for v in c.to_pylist()]) for c in (i, j))
        a = np.zeros((k, len(ids), len(ids)))
        a[:, x, y] = a[:, y, x] = table.column("a").combine_chunks().flatten().to_numpy().reshape(-1, k).T
        low = np.linalg.cholesky(a[:, :inner, :inner])
        logs = 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
        side = np.linalg.solve(low, a[:, :inner, inner:])
        rest = a[:, inner:, inner:] - side.transpose(0, 2, 1) @ side
        r, c = np.triu_indices(len(ids) - inner)
        used = (r == c) | (rest[:, r, c] != 0).any(0)
        r, c = r[used], c[used]
        values = np.concatenate([logs[None], rest[:, r, c].T])
        none = pa.nulls(1, ids.type)
        columns = [pa.concat_arrays([none, ids.take(pa.array(inner + t))]) for t in (r, c)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, k, dtype=np.int32)), pa.array(values.ravel()))
        return pa.Table.from_arrays([*columns, lists], names=["i", "j", "a"])

    return eliminate


def _by_blocks(edges: DataFrame, diagonal: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame, np.ndarray] | None:
    """Edges, diagonal and logarithms after a round of blocks; None where too few nodes are inside them."""
    place = stored(numbered(diagonal.select("i"), [F.col("i")], "_k").select(F.col("i").alias("v"), F.floor((F.col("_k") - 1) / block).alias("b")), "blocks")
    placed = edges.join(place.toDF("i", "bi"), "i").join(place.toDF("j", "bj"), "j")
    placed = stored(placed.select("i", "j", "a", "bi", "bj"), "placed")
    far = placed.where("bi != bj")
    ends = stored(far.select("i").union(far.select("j")).distinct(), "outer")
    if ends.count() > (1 - SHARE) * diagonal.count():
        release(place, placed, ends)
        return None
    own = diagonal.join(place.withColumnRenamed("v", "i"), "i").join(ends.withColumn("outer", F.lit(True)), "i", "left")
    own = own.select("b", "i", F.col("i").alias("j"), F.col("d").alias("a"), F.lit(True).alias("own"), F.coalesce("outer", F.lit(False)).alias("outer"))
    near = placed.where("bi = bj").select(F.col("bi").alias("b"), "i", "j", "a", F.lit(False).alias("own"), F.lit(False).alias("outer"))
    out = edges.select("i", "j", "a")
    rows = own.unionByName(near).groupBy("b").applyInArrow(_schur(k), out.schema)
    rows = stored(rows, "schur")
    sums = rows.where("i IS NULL").select(F.posexplode("a").alias("r", "x")).groupBy("r").agg(F.sum("x").alias("x")).collect()
    logs = np.zeros(k)
    for r in sums:
        logs[r["r"]] = r["x"]
    new_edges = stored(far.select("i", "j", "a").union(rows.where("i != j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "a")), "edges")
    new_diagonal = stored(rows.where("i = j").select("i", F.col("a").alias("d")), "diagonal")
    release(place, placed, ends, rows)
    return new_edges, new_diagonal, logs


def log_determinants(weights: DataFrame, rhos: np.ndarray, dense: int = 0, block: int = BLOCK) -> np.ndarray:
    """ln |I - rho S| for each rho, where S has sqrt(w_ij w_ji) for the weights (i, j, w), each with its reverse: for row-standardised
    symmetric contiguity that is ln |I - rho W|, and |rho| < 1 makes all pivots positive.  The last
    ``dense`` nodes are one matrix a rho on the driver (none by default)."""
    k = len(rhos)
    back = weights.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("v"))
    entry = F.transform(F.array(*(F.lit(float(r)) for r in rhos)), lambda r: -r * F.sqrt(F.col("w") * F.col("v")))
    edges = stored(weights.join(back, ["i", "j"]).where("i < j").select("i", "j", entry.alias("a")), "edges")
    diagonal = stored(weights.select("i").distinct().select("i", F.array_repeat(F.lit(1.0), k).alias("d")), "diagonal")
    total, turn = np.zeros(k), 0
    while diagonal.count() > dense:
        after = _by_blocks(edges, diagonal, k, block) or _by_blocks(edges, diagonal, k, WIDER * block)
        if after:
            release(edges, diagonal)
            edges, diagonal, logs = after
            total += logs
            continue
        chosen = stored(_chosen(edges, turn), "chosen")
        if not chosen.limit(1).count():  # only nodes without neighbours are left
            break
        pivots = diagonal.join(chosen.withColumnRenamed("v", "i"), "i", "left_semi")
        logs = pivots.select(F.posexplode(F.transform("d", lambda x: F.log(x))).alias("r", "x")).groupBy("r").agg(F.sum("x").alias("x"))
        for r in logs.collect():
            total[r["r"]] += r["x"]
        to = edges.join(chosen.withColumnRenamed("v", "i"), "i").select(F.col("i").alias("v"), F.col("j").alias("n"), "a")
        to = stored(to.union(edges.join(chosen.withColumnRenamed("v", "j"), "j").select(F.col("j").alias("v"), F.col("i").alias("n"), "a")), "links")
        pairs = to.select("v", F.col("n").alias("i"), F.col("a").alias("x")).join(to.select("v", F.col("n").alias("j"), F.col("a").alias("y")), "v").where("i <= j").join(pivots.withColumnRenamed("i", "v"), "v")
        part = F.transform(F.arrays_zip("x", "y", "d"), lambda t: -t["x"] * t["y"] / t["d"])
        pairs = stored(pairs.select("i", "j", F.col("v").alias("by"), part.alias("a")), "updates")
        rest = edges.join(chosen.withColumnRenamed("v", "i"), "i", "left_anti").join(chosen.withColumnRenamed("v", "j"), "j", "left_anti")
        left = rest.select("i", "j", F.lit(None).cast(dict(pairs.dtypes)["by"]).alias("by"), "a").unionByName(pairs.where("i < j"))
        new_edges = stored(left.groupBy("i", "j").agg(_sum("a", k).alias("a")), "edges")
        left = diagonal.join(chosen.withColumnRenamed("v", "i"), "i", "left_anti").select("i", F.lit(None).cast(dict(pairs.dtypes)["by"]).alias("by"), F.col("d").alias("a"))
        left = left.unionByName(pairs.where("i = j").select("i", "by", "a"))
        new_diagonal = stored(left.groupBy("i").agg(_sum("a", k).alias("d")), "diagonal")
        release(edges, diagonal, chosen, to, pairs)
        edges, diagonal, turn = new_edges, new_diagonal, turn + 1
    alone = diagonal.join(edges.select("i").union(edges.select("j")).distinct(), "i", "left_anti")
    for r in alone.select(F.posexplode(F.transform("d", lambda x: F.log(x))).alias("r", "x")).groupBy("r").agg(F.sum("x").alias("x")).collect():
        total[r["r"]] += r["x"]
    rows, ends = edges.collect(), diagonal.join(alone, "i", "left_anti").collect()
    release(edges, diagonal)
    place = {r["i"]: m for m, r in enumerate(ends)}
    x, y = (np.array([place[r[c]] for r in rows], int) for c in "ij")
    values, pivots = np.array([r["a"] for r in rows]).reshape(-1, k), np.array([r["d"] for r in ends]).reshape(-1, k)
    for m in range(k if ends else 0):
        a = np.diag(pivots[:, m])
        a[x, y] = a[y, x] = values[:, m]
        total[m] += np.linalg.slogdet(a)[1]
    return total
