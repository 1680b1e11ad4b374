"""Descriptives, outliers, quantile classes, ranks and correlations."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import selection
from odweave.operators.grouping import join_group, numbered, running_sum
from odweave.storage import stored


def descriptives(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column over finite values: count, mean, median, sd, min, max, bias-corrected skewness and excess kurtosis, zeros,
    missing.  Exact medians are selected by ranges, all else is one aggregate."""
    medians = selection.quantiles(selection.long_values(df, {c: S.finite(F.col(c)) for c in columns}), [0.5])
    aggs = []
    for c in columns:
        y = S.finite(F.col(c))
        aggs.append(F.struct(
            F.lit(c).alias("variable"), F.count(y).alias("n"), F.avg(y).alias("mean"), F.lit(medians.get(c, [None])[0]).cast("double").alias("median"), F.stddev_samp(y).alias("sd"), F.min(y).alias("min"),
            F.max(y).alias("max"), F.skewness(y).alias("g1"), F.kurtosis(y).alias("g2"), F.count_if(y == 0).alias("zeros"), F.count_if(y.isNull()).alias("missing"),
        ))
    r = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    n = F.col("n").cast("double")
    skew = S.safe_ratio(F.col("g1") * F.sqrt(n * (n - 1)), n - 2)
    kurt = S.safe_ratio((n - 1) * ((n + 1) * F.col("g2") + 6), (n - 2) * (n - 3))
    return r.select("variable", "n", "mean", "median", "sd", "min", "max", F.when(n > 2, skew).alias("skewness"), F.when(n > 3, kurt).alias("kurtosis"), "zeros", "missing")


def screening(desc: DataFrame, skew: float = 2, kurt: float = 10) -> DataFrame:
    """Heavy-tailed columns with a transform to try."""
    strong = (F.abs("skewness") >= skew) | (F.col("kurtosis") >= kurt)
    return desc.where(strong).select("variable", "skewness", "kurtosis", F.when(F.col("min") >= 0, "log1p").otherwise("none").alias("recommendation"))


def iqr_outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Values strictly beyond the quartiles by factor x IQR.  Quartiles are selected by ranges, counts are one aggregate."""
    q = selection.quantiles(selection.long_values(df, {c: S.finite(F.col(c)) for c in columns}), [0.25, 0.75])
    rows = []
    for c in columns:
        lo, hi = q.get(c, (None, None))
        d = (hi - lo) * factor if c in q else 0.0
        y = S.finite(F.col(c))
        rows.append(F.struct(F.lit(c).alias("variable"), F.lit(lo).cast("double").alias("q1"), F.lit(hi).cast("double").alias("q3"), F.count_if((y < (lo or 0) - d) | (y > (hi or 0) + d)).alias("outliers")))
    return df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def quantile_edges(df: DataFrame, column: str, k: int) -> list[float]:
    edges = selection.quantiles(selection.long_values(df, {column: F.col(column)}), [i / k for i in range(k + 1)])
    return sorted(set(edges.get(column, [])))


def quantile_class(c: Column, edges: list[float]) -> Column:
    """1-based class by value edges: right-closed, the first also closed on the left; equal values stay together."""
    if len(edges) < 2:
        return F.when(c.isNotNull(), 1)
    out = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, 0, -1):
        out = F.when(c <= edges[i], i).otherwise(out)
    return F.when(c.isNotNull(), out)


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the average rank of a column (null for null).  Distinct values are counted and cumulated by ranges; frequent values'
    ranks are broadcast, so a column with few values has no hot task."""
    known = df.where(F.col(column).isNotNull())
    counts = running_sum(known.groupBy(column).agg(F.count("*").alias("_n")), [F.col(column)], F.col("_n"), "_before")
    ranks = stored(counts.select(column, "_n", (F.col("_before") + (F.col("_n") + 1) / 2).alias(name)), "ranks")
    return join_group(known, ranks, [column], "_n").select(*df.columns, name).unionByName(df.where(F.col(column).isNull()).withColumn(name, F.lit(None).cast("double")))


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, correlation), both triangles and the diagonal, from one aggregate (after ranking, for spearman)."""
    names = dict(zip(columns, columns, strict=True))
    if method == "spearman":
        for c in columns:
            df = average_rank(df, c, f"_rank_{c}")
            names[c] = f"_rank_{c}"
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(names[a], names[b]).alias("correlation")) for a, b in combinations(columns, 2)]
    half = df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("r")).select("r.*")
    spark = df.sparkSession
    same = spark.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, correlation double")
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "correlation")).unionByName(same)


def high_correlations(matrix: DataFrame, least: float = 0.8) -> DataFrame:
    return matrix.where((F.col("a") < F.col("b")) & (F.abs("correlation") >= least)).orderBy(F.desc(F.abs("correlation")), "a", "b")


def correlation_array(df: DataFrame, columns: list[str]) -> np.ndarray:
    r = correlation_matrix(df, columns).collect()
    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for x in r:
        m[at[x["a"]], at[x["b"]]] = x["correlation"]
    return m


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    m = correlation_array(df, columns)
    v = np.diag(np.linalg.inv(m)) if columns else []
    rows = [(c, float(x), float(1 / x)) for c, x in zip(columns, v, strict=True)]
    return df.sparkSession.createDataFrame(rows, "variable string, vif double, tolerance double").withColumn("status", S.vif_status(F.col("vif")))


def condition_number(df: DataFrame, columns: list[str]) -> float:
    """Of the standardised columns: the root of the ratio of extreme eigenvalues of their correlation matrix."""
    e = np.linalg.eigvalsh(correlation_array(df, columns))
    return float(np.sqrt(e[-1] / e[0])) if e[0] > 0 else float("inf")


def bh_adjust(df: DataFrame, p: str, key: str, name: str = "p_adjusted", partition: list[str] | None = None, piece: int = 1 << 16) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each partition.  By default all rows are one test family: they are numbered by
    ranges, and the least raw value from a row on is that of its piece of ranks and of the least of the pieces after it."""
    if partition:
        rank = F.row_number().over(Window.partitionBy(*partition).orderBy(p, key))
        n = F.count("*").over(Window.partitionBy(*partition))
        down = Window.partitionBy(*partition).orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
        r = df.withColumn("_rank", rank).withColumn("_raw", F.col(p) * n / F.col("_rank"))
        return r.withColumn(name, F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_rank", "_raw")
    r = stored(numbered(df, [F.col(p), F.col(key)], "_rank").withColumn("_piece", F.floor((F.col("_rank") - 1) / piece)), "tests")
    n = r.count()
    r = r.withColumn("_raw", F.col(p) * F.lit(n) / F.col("_rank"))
    later = Window.orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)
    after = r.groupBy("_piece").agg(F.min("_raw").alias("_m")).select("_piece", F.min("_m").over(later).alias("_after"))  # one row a piece
    own = F.min("_raw").over(Window.partitionBy("_piece").orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    return r.withColumn("_own", own).join(F.broadcast(after), "_piece").withColumn(name, F.least("_own", "_after", F.lit(1.0))).drop("_rank", "_piece", "_raw", "_own", "_after")


def binned_profile(df: DataFrame, feature: str, value: str, bins: int = 20) -> DataFrame:
    """Per quantile bin of a feature (equal values together): size, range, middle and spread of feature and value."""
    edges = quantile_edges(df, feature, bins)
    x = df.withColumn("bin", quantile_class(F.col(feature), edges)).where("bin IS NOT NULL")
    g = x.groupBy("bin").agg(
        F.count("*").alias("n"), F.min(feature).alias("min_feature"), F.max(feature).alias("max_feature"), F.avg(feature).alias("mean_feature"), F.avg(value).alias("mean_value"),
    )
    return with_middles(g, x.select(F.col("bin").cast("string").alias("g"), F.col(feature).alias("x"), F.col(value).alias("value")), F.col("bin").cast("string"))


def with_middles(groups: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """groups with median_feature, median_value, p25_value and p75_value of the rows (g, x, value) of each; key is a group's g."""
    long = rows.select(F.explode(F.array(*(F.struct(F.concat("g", F.lit(f":{c}")).alias("g"), F.col(c).cast("double").alias("v")) for c in ("x", "value")))).alias("r")).select("r.*").where("v IS NOT NULL")
    q = selection.quantiles(long, [0.25, 0.5, 0.75])
    none = [None] * 3
    table = [(g, q.get(f"{g}:x", none)[1], *q.get(f"{g}:value", none)) for g in {k.rsplit(":", 1)[0] for k in q}]
    table = groups.sparkSession.createDataFrame(table, "_g string, median_feature double, p25_value double, median_value double, p75_value double")
    return groups.withColumn("_g", key).join(F.broadcast(table), "_g", "left").drop("_g")  # one row a group


def profile_slopes(profile: DataFrame) -> DataFrame:
    """Change of the mean value from each bin to the next."""
    return profile.select("bin", (F.lead("mean_value").over(Window.orderBy("bin")) - F.col("mean_value")).alias("slope")).where("slope IS NOT NULL")


def delta_vs_baseline(df: DataFrame, name: str, baseline: str, columns: list[str]) -> DataFrame:
    """df with each column's difference from the baseline row's (a one-row broadcast)."""
    base = df.where(F.col(name) == baseline).limit(1).select(*(F.col(c).alias(f"_b_{c}") for c in columns))
    return df.crossJoin(F.broadcast(base)).select(*df.columns, *((F.col(c) - F.col(f"_b_{c}")).alias(f"delta_{c}") for c in columns))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    """Rank within groups (first come in the given order), optionally the first ``most`` only."""
    r = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return r.where(F.col(name) <= most) if most else r
