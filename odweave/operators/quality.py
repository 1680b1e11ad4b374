"""Quality tables: counters, join coverage, numeric profiles, invariants, gates and validated joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import selection


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def long_form(row: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """A one-row table as (metric, value string)."""
    return row.select(*(F.col(c).cast("string").alias(c) for c in row.columns)).unpivot([], row.columns, name, value)


def duplicates(keys: list[str]) -> Column:
    """Rows beyond the first of each key; keys with nulls are keys."""
    return F.count("*") - F.count_distinct(F.struct(*keys))


def scan_counters(records: DataFrame) -> DataFrame:
    """QA counters over a scan, in one aggregate (the distinct pairs are a second shuffle)."""
    c = ["dest", "origin", "day", "modality", "users", "signals"]
    return records.agg(
        F.count("*").alias("rows"), F.sum(sum((F.col(x).isNull().cast("long") for x in c[1:]), F.col(c[0]).isNull().cast("long"))).alias("missing_values"),
        F.count_if(F.col("users") < 0).alias("negative_users"), F.count_if(F.col("signals") < 0).alias("negative_signals"),
        F.count_if(F.col("modality") != "ALL").alias("modality_mismatches"), F.count_if(F.col("valid")).alias("valid_origin_rows"), F.count_if(~F.col("valid")).alias("invalid_origin_rows"),
        F.count_if(F.col("in_scope")).alias("in_scope_origin_rows"), F.sum("users").alias("total_users"), F.sum("signals").alias("total_signals"),
        duplicates(["dest", "origin", "day"]).alias("duplicate_rows"),
    )


def join_coverage(base: DataFrame, source: DataFrame, key: str, pattern: str | None = None) -> DataFrame:
    """How a source's keys meet a base table's: one row."""
    b = base.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_base", F.lit(1))
    s = source.groupBy(key).agg(F.count("*").alias("_n"))
    j = b.join(s.withColumn("_source", F.lit(1)), key, "full")
    has = F.col("_source").isNotNull() & F.col(key).isNotNull()
    wanted = F.col("_base").isNotNull()
    form = S.matches(F.col(key).cast("string"), pattern) if pattern else F.lit(True)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    return j.agg(
        n(F.col("_source").isNotNull()).alias("rows"), F.count_if(has).alias("unique_keys"), F.count_if(has & wanted).alias("matched"),
        F.count_if(wanted & ~has).alias("unmatched_base"), F.count_if(has & ~wanted).alias("extra_source"), F.coalesce(F.sum(F.when(has, F.col("_n") - 1)), F.lit(0)).cast("long").alias("duplicate_rows"),
        n(F.col("_source").isNotNull() & F.col(key).isNull()).alias("missing_keys"), n(has & form).alias("valid_format_rows"),
    )


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, statistic...) for each column: medians are selected by ranges, all else is one aggregate."""
    medians = selection.quantiles(selection.long_values(df, {c: S.finite(F.col(c)) for c in columns}), [0.5])
    aggs = []
    for c in columns:
        x, y = F.col(c).cast("double"), S.finite(F.col(c))
        aggs.append(F.struct(
            F.lit(c).alias("variable"), F.count(x).alias("non_null"), F.count_if(x.isNull()).alias("missing"), F.count_if(F.abs(x) == float("inf")).alias("infinite"),
            F.count_if(y < 0).alias("negative"), F.count_if(y == 0).alias("zero"), F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"),
            F.lit(medians.get(c, [None])[0]).cast("double").alias("median"), F.stddev_samp(y).alias("sd"),
        ))
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def profile_long(profile: DataFrame, warn_negative: tuple[str, ...] = ("net_flow",)) -> DataFrame:
    """numeric_profile() as (variable, metric, value, status); negatives warn where they may occur, and fail elsewhere."""
    names = profile.columns[1:]
    long = profile.select("variable", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["variable"], list(names), "metric", "value")
    bad = F.col("metric").isin("missing", "infinite", "negative") & (F.col("value") > 0)
    soft = (F.col("metric") == "negative") & F.col("variable").isin(*warn_negative)
    return long.withColumn("status", F.when(bad & soft, "warn").when(bad, "fail").otherwise("pass"))


def invariants(df: DataFrame, checks: Mapping[str, Column], differences: Mapping[str, tuple[Column, Column]], tolerance: float = 1e-6) -> DataFrame:
    """(check_name, value, status): checks must hold on every row, differences stay within tolerance.  One aggregate."""
    aggs = [F.struct(F.lit(k).alias("check_name"), F.count_if(~F.coalesce(c, F.lit(False))).cast("double").alias("value"), F.lit(0.0).alias("allowed")) for k, c in checks.items()]
    aggs += [F.struct(F.lit(k).alias("check_name"), F.coalesce(F.max(F.abs(a - b)), F.lit(0.0)).alias("value"), F.lit(tolerance).alias("allowed")) for k, (a, b) in differences.items()]
    rows = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return rows.select("check_name", "value", S.status(F.col("value") <= F.col("allowed")).alias("status"))


def status_counts(qa: DataFrame) -> DataFrame:
    return qa.groupBy("status").agg(F.count("*").alias("n"))


def gate(qa: DataFrame, name: str = "quality gate") -> DataFrame:
    """qa, or an error that lists what failed."""
    failed = [r[0] for r in qa.where("status = 'fail'").select(qa.columns[0]).limit(20).collect()]
    if failed:
        raise ValueError(f"{name} failed: {', '.join(map(str, failed))}")
    return qa


def unique_on(df: DataFrame, key: str, what: str) -> DataFrame:
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: key {key} = {twice[0][0]!r} repeats")
    return df


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join whose key is checked to be unique on both sides."""
    return unique_on(left, key, "left").join(unique_on(right, key, "right"), key, how)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in order: a maximum of structs, aggregated before the shuffle, not a window."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def upsert(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """log with rows of the same key replaced; columns that either lacks are null."""
    return log.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def update_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as finite doubles; rows without all of them go."""
    return df.withColumns({c: S.finite(F.col(c)) for c in columns}).dropna(subset=columns)


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at most one value (minimum equal to maximum)."""
    r = df.agg(*(F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns)).first()
    return [c for c in columns if r[c]]


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in exclude]


def table_differences(old: DataFrame, new: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(key, column, old, new, abs_diff, within) of two versions of a table."""
    j = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns)).join(new.select(key, *(F.col(c).alias(f"_n_{c}") for c in columns)), key, "full")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_o_{c}").cast("double").alias("old"), F.col(f"_n_{c}").cast("double").alias("new")) for c in columns))
    r = j.select(key, F.explode(rows).alias("r")).select(key, "r.*").withColumn("abs_diff", F.abs(F.col("old") - F.col("new")))
    return r.withColumn("within", F.coalesce(F.col("abs_diff") <= tolerance, F.col("old").isNull() & F.col("new").isNull()))
