"""Group statistics back to rows, global row numbers, and connected components, without hot tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.storage import release, stored

#: Groups that a hot-key broadcast may hold at most (each has at least 1/HOT_GROUPS of the rows).
HOT_GROUPS = 1024


def join_group(rows: DataFrame, stats: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows inner-joined with stats (one row a group, a stored table; ``size`` has the group's
    number of rows) on keys.  Groups with more than 1/1024 of all rows number under 1024, so they
    are broadcast and their rows stay where they are; only the rest shuffles."""
    total = stats.agg(F.sum(size)).first()[0] or 0
    least = max(1000, total // HOT_GROUPS + 1)
    hot = stats.where(F.col(size) >= least)
    if not hot.limit(1).count():
        return rows.join(stats, keys)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(stats.where(F.col(size) < least), keys)
    return near.unionByName(far)


def running_sum(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of a value over all rows before them in an order (0 for the first).  Rows are dealt by ranges and cumulated
    within each; only the ranges' totals are cumulated in one task (one row a range)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.withColumn("_rs_v", value).repartitionByRange(parts, *order).withColumn("_rs_p", F.spark_partition_id()), "ranges")
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("_rs_p").agg(F.sum("_rs_v").alias("_rs_t")).withColumn("_rs_before", so_far("_rs_t", Window.orderBy("_rs_p"))).drop("_rs_t")
    own = so_far("_rs_v", Window.partitionBy("_rs_p").orderBy(*order))
    return dealt.withColumn("_rs_own", own).join(F.broadcast(totals), "_rs_p").withColumn(name, F.col("_rs_before") + F.col("_rs_own")).drop("_rs_p", "_rs_v", "_rs_own", "_rs_before")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their global number from 1 in an order, by ranges."""
    return running_sum(rows, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges.  Alternating
    large-star and small-star steps; every step is a shuffle on a node and is stored.  A hub of a
    large component is a key with many rows, of which only (node, least neighbour) pairs pass on:
    minima are pre-aggregated before the shuffle and joined back without a skewed task."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "cc")
    while True:
        # large star: every neighbour above u is linked with u's least neighbour (or u)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "cc-m")
        large = join_group(both, m, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "cc-l")
        # small star: every neighbour below u, and u, is linked with the least of them
        m2 = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-m")
        small = join_group(large, m2, ["u"], "n")
        new = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m2.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "cc")
        stars = new.select("v").intersect(new.select("u")).limit(1).count() == 0
        release(e, m, large, m2)
        e = new
        if stars:  # every edge leads from a node to a root
            return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
