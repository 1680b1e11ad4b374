"""Approximate nearest neighbours with a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots (cosine) in order.  Every distinct vector is indexed once, with the
``k`` + 1 least ids that hold it.  Vectors are dealt into blocks; within a block every pivot has an inverted file of (vector, rank
of the pivot in the vector's permutation).  A query adds up, over the files of its own pivots, how well the ranks agree, which
orders the vectors by Spearman's footrule (pivots outside a prefix count as rank PREFIX).  The best ``SHARE`` of a block
(``LEAST`` vectors at least; at the same distance those with the smaller id) are compared exactly, in double precision; a query's
best of all blocks are its result.

Pivots are vectors of a bounded sample (``SAMPLE`` distinct vectors by their hash) that are far from each other: in order of the
sample one is left out if its cosine with a pivot is above 0.6; if too few remain the limit is raised.  Everything is indexed.

A task is one block of vectors and one block of equal queries: its memory does not depend on the sizes of the tables.  Queries
with the same vector are searched once, and their answer is joined back to them.

Defined cases: rows whose vec_id or vector is null, whose vector is zero, empty or holds null or non-finite
components, or has another length than most rows, take no part; rows with the query's own vec_id
are not its candidates; a vec_id with several vectors is one candidate, by its nearest vector, and one query, by the least vector
(compared component by component); repeated rows count once; ties go to the smaller vec_id; fewer candidates than k give them all;
no rows give an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm.common import bound_batches, join_group, release, stored

#: Pivots, pivots of a vector's permutation, vectors that pivots are chosen from.
PIVOTS, PREFIX, SAMPLE = 256, 128, 2048
#: Of a block's distinct vectors the share that is compared exactly, and the number at least.
SHARE, LEAST = 0.05, 100
#: Vectors and queries of a task at most, and bytes of a block of vectors.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_BYTES = 16384, 1024, 1 << 26

OUT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(vec_id, v, asks): the rows that take part; a component of -0.0 is 0.0."""
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    return rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, exactly, so that no product overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """At most count of the sample's unit vectors, in its order, far from each other."""
    chosen: list[int] = []
    for limit in (0.6, 0.8, 0.95, 2.0):
        for i in range(len(sample)):
            if len(chosen) >= count:
                break
            if i not in chosen and (not chosen or (sample[chosen] @ sample[i]).max() <= limit):
                chosen.append(i)
    return sample[chosen]


def permutations(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each unit vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k]


class Block:
    """Vectors with an inverted file for each pivot."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, k: int):
        self.n, self.k, self.pivots = len(x), min(k, len(pivots)), pivots
        flat = permutations(x, pivots, self.k).ravel()
        order = np.argsort(flat, kind="stable")
        edge = np.searchsorted(flat[order], np.arange(len(pivots) + 1))
        self.rows = [(order[a:b] // self.k).astype(np.int32) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        self.gain = [(self.k - order[a:b] % self.k).astype(np.int32) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def nearest(self, permutation: np.ndarray, count: int) -> np.ndarray:
        """The vectors with the least footrule distance to a permutation, the first ones of those at the same distance.
        The distance is k(k+1) minus twice the sum, over shared pivots, of k minus the larger rank."""
        agree = np.zeros(self.n, np.int64)
        for rank, p in enumerate(permutation):  # a vector is at most once in a file
            agree[self.rows[p]] += np.minimum(self.gain[p], self.k - rank)
        order = np.arange(self.n) - agree * self.n
        return np.argpartition(order, count - 1)[:count] if count < self.n else np.arange(self.n)


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, share: float = SHARE, pivots: int = PIVOTS, prefix: int = PREFIX, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row where is_query holds."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors, is_query)
    size = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if size is None:
        return spark.createDataFrame([], OUT)
    dim = size["dim"]
    key = [F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(7)).alias("g")]  # 128 bits stand for a vector
    rows = stored(rows.where(F.size("v") == dim).groupBy("vec_id", "v").agg(F.max("asks").alias("asks")), "vectors")
    # each distinct vector with its least ids: a task passes on no more than k + 1 rows of a vector
    least = Window.partitionBy("v").orderBy("vec_id")
    few = rows.select("v", "vec_id", F.row_number().over(least).alias("r")).where(F.col("r") <= k + 1)
    index = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(*key, "v", "ids"), "index")
    queries = rows.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    queries = stored(queries.select("query_id", *key, "v"), "queries")
    asked = queries.groupBy("h", "g").agg(F.min("v").alias("v"), F.count("*").alias("n"))
    sample = index.orderBy(F.xxhash64("h", F.lit(11)), "g").limit(SAMPLE).select("v").collect()
    shared = spark.sparkContext.broadcast(spread_pivots(unit(np.array([r["v"] for r in sample], float)), pivots))
    n, parts = index.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * dim), max(1024, -(-n // parts))))
    blocks, query_blocks = -(-n // block_rows), max(1, -(-asked.count() // block_queries))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = index.select(F.pmod("h", F.lit(blocks)).cast("int").alias("block"), every(query_blocks).alias("queries"), F.col("v"), "ids")
    right = asked.select(every(blocks).alias("block"), F.pmod(F.xxhash64("h"), F.lit(query_blocks)).cast("int").alias("queries"), "h", "g", "v")

    def meet(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            ids = x["ids"].to_list()
            order = np.argsort([i[0] for i in ids], kind="stable")
            ids = [ids[i] for i in order]
            raw = scaled(np.array(x["v"].to_list(), float)[order])
            asks = scaled(np.array(q["v"].to_list(), float))
            norms, lengths = np.sqrt((raw * raw).sum(1)), np.sqrt((asks * asks).sum(1))
            block = Block(raw / norms[:, None], shared.value, prefix)
            count = min(block.n, max(LEAST, -(-int(share * 1000) * block.n // 1000)))
            perms = permutations(asks / lengths[:, None], shared.value, block.k)
            for h, g, v, length, perm in zip(q["h"], q["g"], asks, lengths, perms, strict=True):
                near = np.sort(block.nearest(perm, count))
                cos = (raw[near] * v).sum(1) / (norms[near] * length)
                best = np.lexsort((near, -cos))[: 2 * (k + 1)]
                last = cos[best[min(len(best), k + 1) - 1]]
                some = np.flatnonzero(cos >= last)  # with all that tie with the last
                found = sorted((-c, int(i)) for c, r in zip(cos[some], near[some], strict=True) for i in ids[r])
                best_of: dict[int, float] = {}
                for c, i in found:
                    if len(best_of) > k:
                        break
                    best_of.setdefault(i, -c)
                out += [(h, g, i, c) for i, c in best_of.items()]
        return pd.DataFrame(out, columns=["h", "g", "vec_id", "score"])

    met = left.groupBy("block", "queries").cogroup(right.groupBy("block", "queries")).applyInPandas(meet, "h long, g long, vec_id long, score double")
    top = Window.partitionBy("h", "g").orderBy(F.desc("score"), "vec_id")
    best = met.groupBy("h", "g", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    answers = best.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    answers = stored(answers.join(asked.select("h", "g", "n"), ["h", "g"]), "answers")
    release(index, rows)
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    own = join_group(queries.select("query_id", "h", "g"), answers, ["h", "g"], "n")
    return own.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
