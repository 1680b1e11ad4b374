"""Shapes of a value (such as a SHAP value) over a feature: profiles by quantile bins, their measures, and labels by rule tables.

All features are one table (feature, x, value), so nothing loops over features or collects a profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.operators import selection, stats
from odweave.operators.grouping import running_sum

# Labels, thresholds and order of the two rule tables.  A rule holds if all its conditions do; the first that holds
# labels the shape, the last label is that of no rule.
UNCLEAR, MONOTONIC, THRESHOLD = "weak / unclear", "monotonic nonlinear", "threshold"
LINEAR, SATURATION, TURNING = "approximately linear", "saturation / diminishing returns", "non-monotonic"
RULES = (
    (UNCLEAR, ("spread", "<", 0.30)),
    (UNCLEAR, ("rank", "<", 0.30)),
    (MONOTONIC, ("rank", ">=", 0.90), ("steady", ">=", 0.80)),
    (THRESHOLD, ("lifts", ">=", 1), ("rank", ">=", 0.55)),
    (MONOTONIC, ("rank", ">=", 0.75), ("steady", ">=", 0.80)),
    (TURNING, ("turns", ">=", 2)),
    (LINEAR, ("rank", ">=", 0.55), ("line", ">=", 0.50), ("gap", "<", 0.15)),
    (SATURATION, ("rank", ">=", 0.45), ("turns", "<", 1), ("fade", "<", 0.55)),
    (MONOTONIC, ("rank", ">=", 0.45), ("turns", "<", 1)),
    (THRESHOLD, ("turns", "<", 2), ("turns", ">=", 1)),
)
#: The shorter table, which the rerun with normalised entropy has.
SHORT_RULES = (
    *RULES[:4],
    (LINEAR, ("rank", ">=", 0.55), ("gap", "<", 0.15)),
    (MONOTONIC, ("rank", ">=", 0.45)),
)
#: Least slope that counts as a step, as such and as a share of the deviation of the bins' means.
LEAST_STEP, STEP_SHARE = 0.02, 0.08


def labelled(rules: tuple) -> Column:
    """The label by a rule table, over columns of the measures' names."""
    test = {"<": lambda c, v: c < v, ">=": lambda c, v: c >= v}
    out = F.lit(UNCLEAR)
    for label, *conditions in reversed(rules):
        holds = F.lit(True)
        for measure, sign, bound in conditions:
            holds = holds & F.coalesce(test[sign](F.col(measure), F.lit(float(bound))), F.lit(False))
        out = F.when(holds, label).otherwise(out)
    return out


def long_form(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """(feature, x, value) of the columns feature -> value."""
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.col(v).cast("double").alias("value")) for f, v in pairs.items()))
    return df.select(F.explode(rows).alias("r")).select("r.*").where("x IS NOT NULL AND value IS NOT NULL")


def _feature_quantiles(rows: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """(feature, q): quantiles of a column, one row a feature."""
    q = selection.quantiles(rows.select(F.col("feature").alias("g"), F.col(column).alias("v")), probabilities)
    return rows.sparkSession.createDataFrame(list(q.items()), "feature string, q array<double>")


def profiles(rows: DataFrame, bins: int = 20) -> DataFrame:
    """Per feature and quantile bin (equal values together): size, range, middle and spread of x and value."""
    edges = _feature_quantiles(rows, "x", [i / bins for i in range(bins + 1)]).select("feature", F.array_distinct("q").alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = rows.join(F.broadcast(edges), "feature").withColumn("bin", 1 + F.size(F.filter(inner, lambda e: e < F.col("x"))))  # one row a feature
    g = binned.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.min("x").alias("min_feature"), F.max("x").alias("max_feature"), F.avg("x").alias("mean_feature"), F.avg("value").alias("mean_value"))
    key = F.concat_ws(":", "feature", "bin")
    return stats.with_middles(g, binned.select(key.alias("g"), "x", "value"), key)


def group_ranks(rows: DataFrame, by: str, column: str, name: str) -> DataFrame:
    """rows with the average rank of a column within its group.  Distinct values are counted and cumulated by ranges over all groups;
    a group's ranks begin at its least cumulated count."""
    counts = rows.groupBy(by, column).agg(F.count("*").alias("_n"))
    sums = running_sum(counts, [F.col(by), F.col(column)], F.col("_n"), "_before")
    first = sums.groupBy(by).agg(F.min("_before").alias("_first"))
    ranks = sums.join(first, by).select(by, column, (F.col("_before") - F.col("_first") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, [by, column])


def correlations(rows: DataFrame) -> DataFrame:
    """Per feature: n, Pearson's and Spearman's correlation of x and value (null where one is constant)."""
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    ranked = group_ranks(group_ranks(rows, "feature", "x", "_a"), "feature", "value", "_b")
    keep = lambda c: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
    return ranked.groupBy("feature").agg(F.count("*").alias("n"), keep(corr("x", "value")).alias("pearson"), keep(corr("_a", "_b")).alias("spearman"))


def measures(rows: DataFrame, bins: int = 20) -> DataFrame:
    """Per feature: correlations, percentiles, and what the rule tables ask of its profile: rank, line, gap (absolute correlations and
    their distance), spread (95th less 5th percentile), steady (share of steps in the direction of the rank correlation), lifts (the
    profile rises from below 0 to stay above it), turns (changes of direction), fade (later steps in relation to earlier ones)."""
    p = rows.groupBy("feature").agg(F.min("x").alias("feature_min"), F.max("x").alias("feature_max"), F.avg(F.abs("value")).alias("mean_abs_value"))
    of_x, of_value = _feature_quantiles(rows, "x", [0.5]), _feature_quantiles(rows, "value", [0.05, 0.5, 0.95])
    p = p.join(of_x.select("feature", F.get("q", F.lit(0)).alias("feature_median")), "feature")
    p = p.join(of_value.select("feature", *(F.get("q", F.lit(i)).alias(f"value_{n}") for i, n in enumerate(("p05", "p50", "p95")))), "feature")
    m = profiles(rows, bins).groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("bin", "mean_value"))).alias("_p"), F.stddev_pop("mean_value").alias("_sd"))
    m = m.withColumn("_m", F.transform("_p", lambda s: s["mean_value"])).withColumn("_least", F.greatest(F.lit(LEAST_STEP), F.col("_sd") * STEP_SHARE))
    steps = F.transform(F.slice("_m", 2, F.greatest(F.size("_m") - 1, F.lit(0))), lambda v, i: v - F.get("_m", i))
    m = m.withColumn("_d", steps).withColumn("_s", F.transform(F.filter("_d", lambda d: F.abs(d) > F.col("_least")), F.signum))
    turns = F.size(F.filter(F.transform("_s", lambda s, i: (i > 0) & (s != F.get("_s", i - 1))), lambda t: t))
    first = F.array_position(F.transform("_m", lambda v: v > 0), True).cast("int")
    stays = F.forall(F.slice("_m", F.greatest(first, F.lit(1)), F.size("_m")), lambda v: v > -F.col("_least"))
    half = F.greatest(F.lit(1), F.floor(F.size("_d") / 2).cast("int"))
    mean_abs = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v)), F.size(a))
    early, late = F.slice("_d", 1, half), F.slice("_d", half + 1, F.size("_d"))
    t = m.join(correlations(rows), "feature").join(p, "feature")
    along = F.size(F.filter("_d", lambda d: F.signum(d) == F.signum("spearman")))
    t = t.withColumns({
        "rank": F.abs("spearman"), "line": F.abs("pearson"), "spread": F.col("value_p95") - F.col("value_p05"), "turns": turns.cast("double"), "steady": F.coalesce(F.try_divide(along, F.size("_d")), F.lit(0.0)),
        "lifts": ((F.array_min("_m") < 0) & (F.array_max("_m") > 0) & (first > 0) & stays).cast("double"), "fade": F.try_divide(mean_abs(late), mean_abs(early)),
    })
    # a feature or value without variation has no rank: that is weak
    t = t.withColumn("rank", F.coalesce("rank", F.lit(0.0))).withColumn("gap", F.abs(F.col("rank") - F.col("line")))
    return t.drop("_p", "_sd", "_m", "_least", "_d", "_s")


def shape_table(df: DataFrame, pairs: dict[str, str], bins: int = 20, rules: tuple = RULES) -> DataFrame:
    """One row a feature: its shape, both correlations with p-values, and percentiles.  pairs: feature -> column of its values."""
    from odweave.functions.distributions import t_two_sided

    m = measures(long_form(df, pairs), bins).withColumn("shape", labelled(rules))
    rows = m.select("feature", "shape", "n", "pearson", "spearman", "feature_min", "feature_median", "feature_max", "value_p05", "value_p50", "value_p95", "mean_abs_value").collect()  # one a feature

    def p(r: float | None, n: int) -> float | None:
        return None if r is None else 0.0 if abs(r) >= 1 else t_two_sided(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2)

    order = {f: i for i, f in enumerate(pairs)}
    out = [(r["feature"], r["shape"], r["n"], r["pearson"], p(r["pearson"], r["n"]), r["spearman"], p(r["spearman"], r["n"]), *r[5:]) for r in sorted(rows, key=lambda r: order[r["feature"]])]
    kind = "feature string, shape string, n long, pearson double, pearson_p double, spearman double, spearman_p double, feature_min double, feature_median double, feature_max double, value_p05 double, value_p50 double, value_p95 double, mean_abs_value double"
    return df.sparkSession.createDataFrame(out, kind)
