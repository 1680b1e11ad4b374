"""Exact quantiles of many groups at once, by narrowing ranges: no task gathers a group.

Every pass counts the values of each open range in BINS parts and keeps the parts that hold an asked rank; ranges of at most FEW
values are sorted.  A part is narrowed to its least and largest value, which are in different parts of the next pass, so each pass makes progress; n values
take about log(n / FEW) / log(BINS) passes.  What comes to the driver is a row for each asked rank.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from odweave.storage import release, stored

BINS, FEW = 1024, 2048


def long_values(df: DataFrame, columns: dict) -> DataFrame:  # noqa: ANN001
    """(g, v): the values of the given columns, each under its name; nulls left out."""
    rows = F.array(*(F.struct(F.lit(k).alias("g"), c.cast("double").alias("v")) for k, c in columns.items()))
    return df.select(F.explode(rows).alias("r")).select("r.*").where("v IS NOT NULL")


def _order_statistics(long: DataFrame, asked: dict[str, tuple[int, float, float, list[int]]]) -> dict[tuple[str, int], float]:
    """The values of the asked ranks (from 0) of each group, given its size, least and largest value."""
    spark, out = long.sparkSession, {}
    ranges = [(g, low, high, 0, n, ranks) for g, (n, low, high, ranks) in asked.items() if n]
    while ranges:
        for g, low, high, _, _, ranks in ranges:
            if low == high:
                out |= {(g, r): low for r in ranks}
        rows = [(i, *x) for i, x in enumerate(x for x in ranges if x[1] < x[2])]
        if not rows:
            break
        table = spark.createDataFrame(rows, "id int, g string, low double, high double, base long, n long, ranks array<long>")
        inside = long.join(F.broadcast(table), "g").where("v BETWEEN low AND high")  # a row for each asked rank at most
        few = inside.where(F.col("n") <= FEW).groupBy("id", "g", "base", "ranks").agg(F.array_sort(F.collect_list("v")).alias("s"))
        for r in few.select("g", "ranks", F.transform("ranks", lambda x: F.get("s", (x - F.col("base")).cast("int"))).alias("values")).collect():
            out |= {(r["g"], k): v for k, v in zip(r["ranks"], r["values"], strict=True)}
        if all(x[5] <= FEW for x in rows):
            break
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1))
        parts = inside.where(F.col("n") > FEW).groupBy("id", "g", "base", "ranks", part.alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("base")  # BINS rows
        parts = parts.withColumn("before", before).withColumn("held", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m"))))
        ranges = [(r["g"], r["a"], r["b"], r["before"], r["m"], r["held"]) for r in parts.where(F.size("held") > 0).collect()]
    return out


def quantiles(long: DataFrame, probabilities: list[float]) -> dict[str, list[float]]:
    """Of each group g of (g, v) its quantiles, linear between neighbours.  Values must not be null or NaN; groups are few (columns, bins)."""
    own = "Exchange" in long._jdf.queryExecution().executedPlan().toString()
    long = stored(long.select("g", "v"), "values") if own else long.select("g", "v")  # read several times
    sizes = {r["g"]: (r["n"], r["a"], r["b"]) for r in long.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    ranks = {g: sorted({f(p * (n - 1)) for p in probabilities for f in (math.floor, math.ceil)}) for g, (n, _, _) in sizes.items()}
    at = _order_statistics(long, {g: (*sizes[g], ranks[g]) for g in sizes})
    if own:
        release(long)

    def value(g: str, p: float) -> float:
        h = p * (sizes[g][0] - 1)
        low, high = math.floor(h), math.ceil(h)
        return at[g, low] if low == high else (high - h) * at[g, low] + (h - low) * at[g, high]

    return {g: [value(g, p) for p in probabilities] for g in sizes}
