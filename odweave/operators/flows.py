"""Origin-destination records to per-area indicators.

Records have dest, origin, day, users, signals and the flags in_scope and valid of the origin, and origin_area where the
origin is in scope.  Sums of groups without a value are 0; rows with a null key do not form groups.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.functions import scalars as S


def calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """(day, is_weekend) of every day from first to last."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return days.withColumn("is_weekend", S.is_weekend(F.col("day")))


def attach_lookup(records: DataFrame, lookup: DataFrame, key: str, prefix: str) -> DataFrame:
    """records left-joined with a lookup (key, valid, in_scope, area) on column ``key``; missing flags are false."""
    side = lookup.select(F.col("key").alias(key), *(F.col(c).alias(f"{prefix}_{c}") for c in ("valid", "in_scope", "area")))
    flags = {f"{prefix}_{c}": F.coalesce(F.col(f"{prefix}_{c}"), F.lit(False)) for c in ("valid", "in_scope")}
    return records.join(side, key, "left").withColumns(flags)


def extend_lookup(codes: DataFrame, known: DataFrame, place) -> DataFrame:  # noqa: ANN001
    """The lookup with codes that it lacks: only unseen distinct codes are placed."""
    fresh = codes.select("key").where("key IS NOT NULL").distinct().join(known, "key", "left_anti")
    return known.unionByName(place(fresh))


def daily_destination(records: DataFrame) -> DataFrame:
    typed = records.where("dest IS NOT NULL").withColumns({"is_weekend": S.is_weekend(F.col("day")), "origin_class": S.origin_class(F.col("in_scope"), F.col("valid"))})
    return typed.groupBy("day", "dest", "is_weekend", "origin_class").agg(F.coalesce(F.sum("users"), F.lit(0.0)).alias("users"), F.coalesce(F.sum("signals"), F.lit(0.0)).alias("signals"))


def daily_components(records: DataFrame) -> DataFrame:
    """By day, destination and raw origin, valid origins only."""
    return records.where("valid AND dest IS NOT NULL").groupBy("day", "dest", "origin").agg(F.sum("users").alias("users"), F.sum("signals").alias("signals"))


def daily_origin(records: DataFrame) -> DataFrame:
    """Outflow by day and origin area: origin in scope, destination any valid cell."""
    return records.where("in_scope AND origin_area IS NOT NULL AND dest IS NOT NULL").groupBy("day", "origin_area").agg(F.sum("users").alias("users"), F.sum("signals").alias("signals"))


def total_by(daily: DataFrame, key: str, name: str) -> DataFrame:
    return daily.groupBy(key).agg(F.sum("users").alias(name))


def entropy(components: DataFrame, by: str = "dest", origin: str = "origin") -> DataFrame:
    """Shannon entropy (nats) of origin shares over positive flows, the number of origins, and the total.

    With T = sum u and shares u / T, the entropy is ln T - sum(u ln u) / T: one shuffle on (by, origin), one on by,
    and no join back of totals."""
    flows = components.groupBy(by, origin).agg(F.sum("users").alias("u")).where("u > 0")
    g = flows.groupBy(by).agg(F.sum("u").alias("t"), F.sum(F.col("u") * F.ln("u")).alias("s"), F.count("*").alias("unique_origins"))
    return g.select(by, (F.ln("t") - F.col("s") / F.col("t")).alias("flow_entropy"), "unique_origins", F.col("t").alias("entropy_denominator"))


def origin_shares(components: DataFrame) -> DataFrame:
    """Share of each origin in its destination's positive flow."""
    flows = components.groupBy("dest", "origin").agg(F.sum("users").alias("users")).where("users > 0")
    return flows.withColumn("share", F.col("users") / F.sum("users").over(Window.partitionBy("dest")))


def class_pivot(dest: DataFrame) -> DataFrame:
    """Flow by origin class, one column a class, 0 where there is none."""
    wide = dest.groupBy("dest").pivot("origin_class", list(S.ORIGIN_CLASSES)).agg(F.sum("users"))
    return wide.fillna(0.0, list(S.ORIGIN_CLASSES)).withColumnsRenamed({c: f"{c}_flow" for c in S.ORIGIN_CLASSES})


def coverage(days: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: expected and observed days, their ratio, weekdays and weekend days seen, missing days joined by |."""
    e = expected.join(days.select("day", F.lit(True).alias("seen")).distinct(), "day", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    r = e.agg(
        F.count("*").alias("expected_days"), F.count_if("seen").alias("observed_days"),
        F.count_if(F.col("seen") & ~F.col("is_weekend")).alias("observed_weekdays"), F.count_if(F.col("seen") & F.col("is_weekend")).alias("observed_weekend_days"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("seen"), F.date_format("day", "yyyy-MM-dd")))), "|").alias("missing_dates"),
    )
    return r.withColumns({"coverage_ratio": S.safe_ratio(F.col("observed_days"), F.col("expected_days")), "provisional_flag": F.col("observed_days") < F.col("expected_days")})


def monthly_indicators(areas: DataFrame, records: DataFrame, expected: DataFrame) -> DataFrame:
    """The indicator table, one row an area, 27 columns.

    All sums by destination - in total, on weekdays, at weekends and by origin class - are conditional sums of one aggregate;
    entropy and outflow are one each; areas is joined with three results, each of area size."""
    when = lambda c: F.sum(F.when(c, F.col("users")))
    klass = S.origin_class(F.col("in_scope"), F.col("valid"))
    weekend = S.is_weekend(F.col("day"))
    inflow = records.where("dest IS NOT NULL").groupBy(F.col("dest").alias("area")).agg(
        F.sum("users").alias("mobility_inflow_total"), when(~weekend).alias("weekday_inflow_total"), when(weekend).alias("weekend_inflow_total"),
        *(when(klass == c).alias(f"{c}_flow") for c in S.ORIGIN_CLASSES),
    )
    mixed = entropy(records.where("valid AND dest IS NOT NULL")).withColumnRenamed("dest", "area")
    outflow = total_by(records.where("in_scope AND origin_area IS NOT NULL AND dest IS NOT NULL"), "origin_area", "mobility_outflow_total").withColumnRenamed("origin_area", "area")
    zero = ["mobility_inflow_total", "weekday_inflow_total", "weekend_inflow_total", "flow_entropy", "unique_origins", "entropy_denominator", "mobility_outflow_total", *(f"{c}_flow" for c in S.ORIGIN_CLASSES)]
    t = areas.select("area").join(inflow, "area", "left").join(mixed, "area", "left").join(outflow, "area", "left").fillna(0, zero)
    c = F.broadcast(coverage(records.select("day"), expected))  # one row
    t = t.crossJoin(c)
    col = F.col
    t = t.withColumns({
        "mobility_inflow_mean_daily": S.safe_ratio(col("mobility_inflow_total"), col("observed_days")),
        "weekday_mean_daily_inflow": S.safe_ratio(col("weekday_inflow_total"), col("observed_weekdays")),
        "weekend_mean_daily_inflow": S.safe_ratio(col("weekend_inflow_total"), col("observed_weekend_days")),
        "net_flow": col("mobility_inflow_total") - col("mobility_outflow_total"),
        "other_origin_share": S.share(col("other_origin_flow"), col("mobility_inflow_total")),
        "valid_origin_flow_share": S.share(col("entropy_denominator"), col("mobility_inflow_total")),
        "external_origin_share": S.share(col("valid_external_origin_flow"), col("mobility_inflow_total")),
    })
    t = t.withColumns({"weekday_weekend_ratio": S.safe_ratio(col("weekday_mean_daily_inflow"), col("weekend_mean_daily_inflow")), "weekday_weekend_zero_denominator": F.coalesce(col("weekend_mean_daily_inflow") == 0, F.lit(False))})
    return t.select(*INDICATORS)


# The columns of the indicator table in their order.
INDICATORS = (
    "area", "observed_days", "expected_days", "coverage_ratio", "observed_weekdays", "observed_weekend_days", "missing_dates", "provisional_flag",
    "mobility_inflow_total", "mobility_inflow_mean_daily", "flow_entropy", "weekday_inflow_total", "weekend_inflow_total", "weekday_mean_daily_inflow",
    "weekend_mean_daily_inflow", "weekday_weekend_ratio", "weekday_weekend_zero_denominator", "unique_origins", "mobility_outflow_total", "net_flow",
    "in_scope_origin_flow", "valid_external_origin_flow", "other_origin_flow", "other_origin_share", "valid_origin_flow_share", "external_origin_share",
    "entropy_denominator",
)


def weekend_reconciliation(records: DataFrame, indicators: DataFrame) -> DataFrame:
    """Weekend inflow summed in two stages against the indicator table: areas, totals, correlation, largest difference."""
    daily = records.where(S.is_weekend(F.col("day")) & F.col("dest").isNotNull()).groupBy("day", "dest").agg(F.sum("users").alias("users"))
    two = daily.groupBy(F.col("dest").alias("area")).agg(F.sum("users").alias("weekend_inflow"))
    j = indicators.select("area", "weekend_inflow_total").join(two, "area", "left").fillna(0.0, ["weekend_inflow"])
    return j.agg(F.count("*").alias("areas"), F.sum("weekend_inflow").alias("total"), F.corr("weekend_inflow", "weekend_inflow_total").alias("correlation"), F.max(F.abs(F.col("weekend_inflow") - F.col("weekend_inflow_total"))).alias("max_abs_diff"))
