"""Composite stages: census, incremental daily processing, monthly indicators, master table, verification."""

from __future__ import annotations

import platform
import sys
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import flows, quality, spatial
from odweave.sources import files
from odweave.sources.daily_cache import DailyCache
from odweave.storage import stored

AREA_CODE = r"^E010\d{5}$"
MODES = ("validation", "provisional", "final")


def census_population(raw: DataFrame, geography: DataFrame, key: str = "code", expected_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(population table, quality table).  raw: name, code, population as text with footers; geography: code, square_metres."""
    rows = raw.withColumn(key, S.standard_key(F.col(key))).where(S.matches(F.col(key), AREA_CODE)).select(key, "name", S.finite(F.col("population")).cast("long").alias("population"))
    table = quality.one_to_one(geography.select(key, "square_metres"), rows, key)
    table = table.withColumns({"area_km2": F.col("square_metres") / 1e6, "density_km2": S.density(F.col("population"), F.col("square_metres"))})
    cover = quality.long_form(quality.join_coverage(geography, rows, key, AREA_CODE)).withColumn("status", F.when(F.col("metric").isin("unmatched_base", "duplicate_rows", "missing_keys") & (F.col("value").cast("long") > 0), "fail").otherwise("pass"))
    if expected_rows is not None:
        n = table.agg(F.count("*").cast("string").alias("value")).select(F.lit("output_rows").alias("metric"), "value", S.status(F.col("value") == str(expected_rows)).alias("status"))
        cover = cover.unionByName(n)
    return table, cover


def map_records(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """File records with destination and origin mapped by a cell lookup (key, valid, in_scope, area), in scope of a destination only."""
    r = records.select(
        F.col("CODE").alias("code"), F.col("ORIGIN_CODE").alias("origin"), F.to_date("DAY").alias("day"), F.col("MOVEMENT_MODALITY").alias("modality"), F.col("EXTRAPOLATED_NUMBER_OF_USERS").alias("users"), F.col("EXTRAPOLATED_NUMBER_OF_SIGNALS").alias("signals")
    )
    r = flows.attach_lookup(flows.attach_lookup(r, lookup, "code", "dest"), lookup, "origin", "origin")
    scope = r.where("dest_valid").withColumns({"dest": F.when(F.col("dest_in_scope"), F.col("dest_area")), "in_scope": F.col("origin_in_scope"), "valid": F.col("origin_valid")})
    return scope.withColumn("outside", F.col("dest").isNull())


#: Tables of the daily cache.
CACHED = ("destination", "origin", "components")


def process_days(spark: SparkSession, wanted: DataFrame, records: DataFrame, log: DataFrame, version: str, folder: str, success: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Processes the days whose cached result is not valid - all of them in one program - and gives the new log.

    wanted: date, source_signature, schema_signature.  A day is valid if the log has its success and the cache has its rows.  Three partial tables are
    staged by day; a day is successful when its counters show no missing or negative values and the staged users equal the source's.  Successful days
    are committed at once; of the others the cache keeps what it had."""
    cache = DailyCache(spark, folder, CACHED)
    seen = cache.version()
    there = spark.createDataFrame([(d,) for d in cache.valid_days()], "date string")
    known = log.join(F.broadcast(there), "date", "left_semi")  # one row a day
    todo = files.days_to_process(wanted, known, version)
    dated = records.withColumn("date", F.date_format("day", "yyyy-MM-dd")).join(F.broadcast(todo.select("date")), "date", "left_semi")  # at most the expected days
    day = lambda df: df.withColumn("date", F.date_format("day", "yyyy-MM-dd")).drop("day")
    run = cache.stage({"destination": day(flows.daily_destination(dated)), "origin": day(flows.daily_origin(dated)), "components": day(flows.daily_components(dated))})
    c = dated.groupBy("date").agg(
        F.count("*").alias("rows"), F.count_if(F.col("users").isNull() | F.col("signals").isNull()).alias("missing_values"), F.count_if(F.col("users") < 0).alias("negative_users"), F.count_if(F.col("signals") < 0).alias("negative_signals"),
        (F.count("*") - F.count_distinct(F.struct("dest", "origin"))).alias("duplicate_od_records"), F.coalesce(F.sum(F.when(F.col("dest").isNotNull(), F.col("users"))), F.lit(0.0)).alias("source_users"),
    )
    days = [r["date"] for r in todo.select("date").distinct().collect()]
    staged = cache.read_run("destination", {run: days})
    written = spark.createDataFrame([], "date string, written_users double") if staged is None else staged.groupBy("date").agg(F.sum("users").alias("written_users"))
    r = todo.join(c, "date", "left").join(written, "date", "left").withColumn("reconciliation_abs_diff", F.abs(F.coalesce("source_users", F.lit(0.0)) - F.coalesce("written_users", F.lit(0.0))))
    ok = (F.coalesce("missing_values", F.lit(1)) == 0) & (F.col("negative_users") == 0) & (F.col("negative_signals") == 0) & (F.col("reconciliation_abs_diff") <= 1e-6)
    r = r.withColumns({"success": F.coalesce(ok, F.lit(False)).cast("string"), "processing_version": F.lit(version), "cache_status": F.lit("processed")})
    r = stored(r, "days")  # one row a day; the log outlives the records
    if done := [x["date"] for x in r.where("success = 'true'").select("date").collect()]:
        cache.commit(run, done, seen)
    kept = log.withColumn("cache_status", F.lit("cached")) if "cache_status" in log.columns else log
    return quality.upsert(kept, success(r) if success else r, "date")


def run_monthly(spark: SparkSession, mode: str, areas: DataFrame, records: DataFrame, first: date, last: date) -> DataFrame:
    """The indicator table.  validation: the first observed day; provisional: whatever days there are; final: every day, or an error."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    expected = flows.calendar(spark, first, last)
    if mode == "validation":
        one = records.agg(F.min("day").alias("d")).first()["d"]
        records = records.where(F.col("day") == F.lit(one))
    elif mode == "final":
        missing = [str(r["day"]) for r in expected.join(records.select("day").distinct(), "day", "left_anti").orderBy("day").limit(62).collect()]
        if missing:
            raise ValueError(f"days without data: {', '.join(missing)}")
    return flows.monthly_indicators(areas, records, expected)


def build_master(base: DataFrame, sources: dict[str, tuple[DataFrame, dict[str, str]]], key: str, mobility: str = "mobility") -> tuple[DataFrame, DataFrame]:
    """(master table, quality table).  base left-joined one to one with every source, of which the given columns are taken under new
    names; the mobility source's days decide the coverage status."""
    table, quality_rows = base, None
    for name, (df, columns) in sources.items():
        df = quality.require_columns(df, [key, *columns]).select(S.standard_key(F.col(key)).alias(key), *(F.col(a).alias(b) for a, b in columns.items()))
        cover = quality.long_form(quality.join_coverage(base, df, key)).select(F.lit(name).alias("source"), "metric", "value")
        quality_rows = cover if quality_rows is None else quality_rows.unionByName(cover)
        table = quality.one_to_one(table, df, key)
    days = ("mobility_processed_days", "mobility_expected_days", "mobility_provisional_flag")
    if mobility in sources and all(c in table.columns for c in days):
        table = table.withColumn("mobility_coverage_status", S.coverage_status(*(F.col(c) for c in days)))
    bad = F.col("metric").isin("unmatched_base", "duplicate_rows", "missing_keys") & (F.col("value").cast("long") > 0)
    return table, quality_rows.withColumn("status", F.when(bad, "fail").otherwise("pass"))


def column_dictionary(df: DataFrame, notes: dict[str, str]) -> DataFrame:
    """(column, type, note) of every column; a column without a note is an error."""
    lacking = [c for c in df.columns if c not in notes]
    if lacking:
        raise ValueError(f"columns without a note: {', '.join(lacking)}")
    return df.sparkSession.createDataFrame([(c, t, notes[c]) for c, t in df.dtypes], "column string, type string, note string")


def only_candidate(candidates: list[str]) -> str | None:
    """The one provisional table there is, if any; two are an error."""
    if len(candidates) > 1:
        raise ValueError(f"several provisional tables: {', '.join(sorted(candidates))}")
    return candidates[0] if candidates else None


def check_spatial_input(areas: DataFrame, key: str, ring: str, required: list[str], rows: int | None = None) -> DataFrame:
    """(check_name, value, status): key, geometry and value checks of a table before spatial statistics, in one aggregate."""
    quality.require_columns(areas, [key, ring, *required])
    bad_values = [F.count_if(S.finite(F.col(c)).isNull()) for c in required]
    r = areas.agg(
        F.count("*").alias("rows"), (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"), F.count_if(F.col(key).isNull()).alias("missing_keys"), F.count_if(F.col(ring).isNull() | (F.size(ring) < 3)).alias("missing_geometry"),
        F.count_if(F.coalesce(spatial.ring_area(F.col(ring)) <= 0, F.lit(True))).alias("invalid_geometry"), (sum(bad_values[1:], bad_values[0]) if bad_values else F.lit(0)).alias("missing_or_infinite_values"),
    )
    long = quality.long_form(r, "check_name")
    want = F.when(F.col("check_name") == "rows", F.col("value") == str(rows) if rows is not None else F.lit(True)).otherwise(F.col("value") == "0")
    return long.withColumn("status", S.status(want))


def verify_lisa(table: DataFrame, rows: int) -> DataFrame:
    """(check_name, value, status) of a LISA table: finite statistics, p in (0, 1], a known cluster in every row, all rows there."""
    checks = {"finite_statistics": S.finite(F.col("local_i")).isNotNull(), "p_between_0_and_1": (F.col("p_sim") > 0) & (F.col("p_sim") <= 1), "known_cluster": F.col("cluster").isin(*S.CLUSTERS)}
    n = table.agg((F.count("*") - F.lit(rows)).cast("double").alias("value")).select(F.lit("row_count_difference").alias("check_name"), "value", S.status(F.col("value") == 0).alias("status"))
    return quality.invariants(table, checks, {}).unionByName(n)


def reconcile_counts(df: DataFrame, column: str, stored: dict[int, int]) -> None:
    """Raises where the group sizes of a column are not those stored."""
    got = {r[column]: r["count"] for r in df.groupBy(column).count().collect()}
    if got != stored:
        raise ValueError(f"{column}: found {got}, stored {stored}")


def environment(spark: SparkSession) -> dict[str, str]:
    import numpy
    import pandas
    import pyarrow

    return {"python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}


# --- quality of the indicator and master tables -----------------------------------------------


def _checks(table: DataFrame, rows: list[tuple]) -> DataFrame:
    """(metric, value, text, status) of a one-row table: rows of (metric, number or text column, passes, status where it does not)."""

    def of(name: str, v: Column, ok: Column, bad: str, is_text: bool) -> Column:
        number, text = (F.lit(None), v) if is_text else (v, F.lit(None))
        return F.struct(F.lit(name).alias("metric"), number.cast("double").alias("value"), text.cast("string").alias("text"), F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise(bad).alias("status"))

    return table.select(F.explode(F.array(*(of(*r) for r in rows))).alias("r")).select("r.*")


def indicator_qa(indicators: DataFrame, manifest: DataFrame, log: DataFrame, expected: DataFrame, expected_files: int, expected_areas: int, tolerance: float = 1e-6, key: str = "area") -> DataFrame:
    """(metric, value, text, status): the 26 checks of the indicator table, of the manifest (date, valid, exists, movement_modality) and of
    the daily log (date, duplicate_od_records, missing_values, negative_users, negative_signals, reconciliation_abs_diff, cache_status,
    total_users).  expected: day.  Three aggregates of one row each, and the missing days."""
    c, zero = F.col, lambda x: F.coalesce(x, F.lit(0))
    valid, there = S.truthy(c("valid")), S.truthy(c("exists"))
    m = manifest.agg(
        F.count_if(valid).alias("files"), F.count_if(there & ~valid).alias("excluded"), F.array_join(F.sort_array(F.collect_set(F.when(valid, c("movement_modality")))), "|").alias("modalities"),
        (F.count_if(valid) - F.count_distinct(F.when(valid, c("date")))).alias("twice"),
    )
    seen = manifest.where(valid).select(F.to_date("date").alias("day")).distinct()
    gone = expected.select("day").join(seen, "day", "left_anti").agg(F.array_join(F.sort_array(F.collect_list(F.date_format("day", "yyyy-MM-dd"))), "|").alias("missing"))
    d = log.agg(
        F.count("*").alias("days"), *(zero(F.sum(x)).alias(x) for x in ("duplicate_od_records", "missing_values", "negative_users", "negative_signals")), F.max("reconciliation_abs_diff").alias("reconciliation"),
        F.count_if(c("cache_status") == "cached").alias("cached"), F.count_if(c("cache_status") == "processed").alias("processed"), F.max("total_users").alias("most_users"), F.min("total_users").alias("least_users"),
    )
    i = indicators.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(c("mobility_inflow_total") < 0).alias("negative_in"), F.count_if(c("mobility_outflow_total") < 0).alias("negative_out"), F.min("flow_entropy").alias("entropy"),
        F.count_if("weekday_weekend_zero_denominator").alias("zero_wwr"), F.max("mobility_inflow_total").alias("most_in"), F.min("mobility_inflow_total").alias("least_in"),
        S.safe_ratio(F.sum("other_origin_flow"), F.sum("mobility_inflow_total")).alias("other_share"), S.safe_ratio(F.sum("entropy_denominator"), F.sum("mobility_inflow_total")).alias("valid_share"),
    )
    one = m.crossJoin(F.broadcast(gone)).crossJoin(F.broadcast(d)).crossJoin(F.broadcast(i))  # four single rows
    yes = F.lit(True)
    # The names of the checks, their order and what they mean when they do not hold.
    return _checks(one, [
        ("valid_source_file_count", c("files"), c("files") == expected_files, "warn", False),
        ("missing_dates", c("missing"), c("missing") == "", "warn", True),
        ("excluded_file_count", c("excluded"), yes, "pass", False),
        ("movement_modality_values_valid_files", c("modalities"), yes, "pass", True),
        ("duplicated_valid_dates", c("twice"), c("twice") == 0, "fail", False),
        ("daily_duplicate_od_rows_total", c("duplicate_od_records"), c("duplicate_od_records") == 0, "warn", False),
        ("daily_missing_values_total", c("missing_values"), c("missing_values") == 0, "fail", False),
        ("daily_negative_users_total", c("negative_users"), c("negative_users") == 0, "fail", False),
        ("daily_negative_signals_total", c("negative_signals"), c("negative_signals") == 0, "fail", False),
        ("max_daily_aggregation_reconciliation_abs_diff", c("reconciliation"), c("reconciliation") <= tolerance, "fail", False),
        ("output_lsoa_rows", c("rows"), c("rows") == expected_areas, "fail", False),
        ("unique_lsoa_codes", c("keys"), c("keys") == expected_areas, "fail", False),
        ("duplicate_lsoa_codes", c("rows") - c("keys"), c("rows") == c("keys"), "fail", False),
        ("negative_inflow_rows", c("negative_in"), yes, "pass", False),
        ("negative_outflow_rows", c("negative_out"), yes, "pass", False),
        ("entropy_min", c("entropy"), c("entropy") >= -1e-9, "fail", False),
        ("zero_wwr_denominator_rows", c("zero_wwr"), yes, "pass", False),
        ("processed_date_count", c("days"), c("days") == expected_files, "fail", False),
        ("cached_day_count", c("cached"), yes, "pass", False),
        ("newly_processed_day_count", c("processed"), yes, "pass", False),
        ("max_daily_users_after_destination_filter", c("most_users"), yes, "pass", False),
        ("min_daily_users_after_destination_filter", c("least_users"), yes, "pass", False),
        ("max_mobility_inflow_total", c("most_in"), yes, "pass", False),
        ("min_mobility_inflow_total", c("least_in"), yes, "pass", False),
        ("other_origin_flow_share_total", c("other_share"), yes, "pass", False),
        ("valid_origin_flow_share_total", c("valid_share"), yes, "pass", False),
    ])


# Columns of the master table that must not be negative, and quotients that must agree (check, column, numerator, denominator).
NON_NEGATIVE = (
    "mobility_inflow_total", "mobility_inflow_mean_daily", "flow_entropy", "weekday_inflow_total", "weekend_inflow_total", "unique_origins", "amenity_poi_count", "retail_poi_count", "amenity_poi_density_km2",
    "retail_poi_density_km2", "population_density_km2", "employees_count",
)
RATIOS = (
    ("mobility_inflow_mean_daily_equals_total_div_31", "mobility_inflow_mean_daily", "mobility_inflow_total", "mobility_expected_days"),
    ("weekday_inflow_mean_daily_equals_total_div_weekdays", "weekday_inflow_mean_daily", "weekday_inflow_total", "mobility_weekday_count"),
    ("weekend_inflow_mean_daily_equals_total_div_weekends", "weekend_inflow_mean_daily", "weekend_inflow_total", "mobility_weekend_count"),
    ("weekday_weekend_ratio_equals_weekday_over_weekend", "weekday_weekend_ratio", "weekday_inflow_mean_daily", "weekend_inflow_mean_daily"),
    ("population_density_km2_equals_population_over_area", "population_density_km2", "population", "area_km2"),
)


def master_qa(master: DataFrame, key: str, pattern: str, expected_rows: int, variables: list[str], ring: str | None = None, tolerance: float = 1e-6, final: str = "final_complete") -> DataFrame:
    """(metric, value, text, status) of a master table, from one aggregate: key and geometry checks, 14 logical checks (value 1 if they hold
    on every row) and 5 relationships (the largest difference, within the tolerance)."""
    c = F.col
    quality.require_columns(master, [key, *NON_NEGATIVE, *variables, "weekday_weekend_ratio", "mobility_coverage_status"])
    none = F.lit(True)
    for v in variables:
        none = none & c(v).isNull()
    holds = {f"{v}_nonnegative": c(v) >= 0 for v in NON_NEGATIVE}
    holds |= {"weekday_weekend_ratio_finite": S.finite(c("weekday_weekend_ratio")).isNotNull(), "mobility_coverage_status_final": c("mobility_coverage_status") == final}
    code = c(key).cast("string")
    shape = [F.count(ring).alias("geometries"), F.count_if(~spatial.ring_is_valid(c(ring))).alias("invalid"), F.count_if(spatial.ring_is_empty(c(ring))).alias("empty")] if ring else []
    one = master.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), (F.count(key) - F.count_distinct(key)).alias("repeated"), F.count_if(c(key).isNull()).alias("without"), F.count_if(S.matches(code, pattern)).alias("format"), F.count_if(none).alias("unmatched"), *shape,
        *(F.count_if(~F.coalesce(x, F.lit(False))).alias(f"_{n}") for n, x in holds.items()), *(F.max(F.abs(c(a) - S.safe_ratio(c(b), c(d)))).alias(f"_{n}") for n, a, b, d in RATIOS),
    )
    yes = F.lit(True)
    rows = [
        ("output_row_count", c("rows"), c("rows") == expected_rows, "fail", False), ("unique_keys", c("keys"), c("keys") == expected_rows, "fail", False), ("duplicate_keys", c("repeated"), yes, "pass", False), ("missing_keys", c("without"), yes, "pass", False),
        ("valid_key_format_count", c("format"), c("format") == expected_rows, "fail", False), ("unmatched_areas", c("unmatched"), yes, "pass", False),
    ]
    if ring:
        rows += [("geometry_count", c("geometries"), c("geometries") == expected_rows, "fail", False), ("invalid_geometry_count", c("invalid"), c("invalid") == 0, "fail", False), ("empty_geometry_count", c("empty"), c("empty") == 0, "fail", False)]
    rows += [(n, (c(f"_{n}") == 0).cast("int"), c(f"_{n}") == 0, "fail", False) for n in holds]
    rows += [(n, c(f"_{n}"), c(f"_{n}") <= tolerance, "fail", False) for n, *_ in RATIOS]
    return _checks(one, rows)


def daily_cache_qa(daily: DataFrame, areas: int) -> DataFrame:
    """Per day of the destination partials: rows, destinations, users, destinations that are missing."""
    g = daily.groupBy("day", "is_weekend").agg(F.count("*").alias("rows"), F.count_distinct("dest").alias("destinations"), F.sum("users").alias("users"))
    return g.withColumn("missing_destinations", F.lit(areas) - F.col("destinations"))


def weekend_days(daily: DataFrame, expected: int = 9) -> list[str]:
    """The weekend days of a cache; another number than expected is an error."""
    days = [str(r["day"]) for r in daily.where("is_weekend").select("day").distinct().orderBy("day").limit(expected + 1).collect()]
    if len(days) != expected:
        raise ValueError(f"{len(days)} or more weekend days ({', '.join(days)}), {expected} expected")
    return days
