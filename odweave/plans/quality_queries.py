"""Queries of the indicator and master tables' checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import flows
from odweave.plans import stages
from odweave.plans import views as V
from odweave.plans.flow_queries import _MONTHLY as MONTHLY
from odweave.plans.registry import query

_FILES = """files AS (SELECT day, count(*) AS n, extract(day FROM day) % 7 <> 3 AS valid FROM od GROUP BY day),
fl AS (SELECT day, valid FROM files UNION ALL SELECT day, true FROM files WHERE extract(day FROM day) = 12),
lg AS (SELECT day, count(*) - count(DISTINCT dest * 1000000 + origin) AS dup, count(*) FILTER (users IS NULL) AS miss, count(*) FILTER (users < 0) AS neg, count(*) FILTER (signals < 0) AS negs, sum(users) AS total,
  CASE WHEN extract(day FROM day) < 10 THEN 'cached' ELSE 'processed' END AS status FROM od WHERE extract(day FROM day) % 7 <> 3 GROUP BY day)"""
_QA = (
    ("valid_source_file_count", "(SELECT count(*) FROM fl WHERE valid)", "= 31", "warn"),
    ("excluded_file_count", "(SELECT count(*) FROM fl WHERE NOT valid)", "", "pass"),
    ("duplicated_valid_dates", "(SELECT count(*) - count(DISTINCT day) FROM fl WHERE valid)", "= 0", "fail"),
    ("daily_duplicate_od_rows_total", "(SELECT sum(dup) FROM lg)", "= 0", "warn"),
    ("daily_missing_values_total", "(SELECT sum(miss) FROM lg)", "= 0", "fail"),
    ("daily_negative_users_total", "(SELECT sum(neg) FROM lg)", "= 0", "fail"),
    ("daily_negative_signals_total", "(SELECT sum(negs) FROM lg)", "= 0", "fail"),
    ("max_daily_aggregation_reconciliation_abs_diff", "(SELECT max(abs(total - u)) FROM lg JOIN (SELECT day, sum(users) AS u FROM od GROUP BY day) USING (day))", "<= 1e-6", "fail"),
    ("output_lsoa_rows", "(SELECT count(*) FROM m)", "= 15", "fail"),
    ("unique_lsoa_codes", "(SELECT count(DISTINCT area) FROM m)", "= 15", "fail"),
    ("duplicate_lsoa_codes", "(SELECT count(*) - count(DISTINCT area) FROM m)", "= 0", "fail"),
    ("negative_inflow_rows", "(SELECT count(*) FILTER (mobility_inflow_total < 0) FROM m)", "", "pass"),
    ("negative_outflow_rows", "(SELECT count(*) FILTER (mobility_outflow_total < 0) FROM m)", "", "pass"),
    ("entropy_min", "(SELECT min(flow_entropy) FROM m)", ">= -1e-9", "fail"),
    ("zero_wwr_denominator_rows", "(SELECT count(*) FILTER (weekend_inflow_total = 0) FROM m)", "", "pass"),
    ("processed_date_count", "(SELECT count(*) FROM lg)", "= 31", "fail"),
    ("cached_day_count", "(SELECT count(*) FILTER (status = 'cached') FROM lg)", "", "pass"),
    ("newly_processed_day_count", "(SELECT count(*) FILTER (status = 'processed') FROM lg)", "", "pass"),
    ("max_daily_users_after_destination_filter", "(SELECT max(total) FROM lg)", "", "pass"),
    ("min_daily_users_after_destination_filter", "(SELECT min(total) FROM lg)", "", "pass"),
    ("max_mobility_inflow_total", "(SELECT max(mobility_inflow_total) FROM m)", "", "pass"),
    ("min_mobility_inflow_total", "(SELECT min(mobility_inflow_total) FROM m)", "", "pass"),
    ("other_origin_flow_share_total", "(SELECT sum(other_origin_flow) / sum(mobility_inflow_total) FROM m)", "", "pass"),
    ("valid_origin_flow_share_total", "(SELECT sum(entropy_denominator) / sum(mobility_inflow_total) FROM m)", "", "pass"),
)


def _row(name: str, value: str, ok: str, bad: str) -> str:
    status = f"CASE WHEN v {ok} THEN 'pass' ELSE '{bad}' END" if ok else "'pass'"
    return f"SELECT '{name}' AS metric, round(v, 4) + 0.0 AS value, NULL::VARCHAR AS text, {status} AS status FROM (SELECT {value}::DOUBLE AS v)"


_MISSING = """UNION ALL SELECT 'missing_dates', NULL, t, CASE WHEN t = '' THEN 'pass' ELSE 'warn' END
FROM (SELECT coalesce(string_agg(strftime(day, '%Y-%m-%d'), '|' ORDER BY day), '') AS t FROM calendar WHERE day NOT IN (SELECT day FROM fl WHERE valid))
UNION ALL SELECT 'movement_modality_values_valid_files', NULL, 'ALL', 'pass'"""


@query(MONTHLY + ", " + _FILES + "\n" + "\nUNION ALL ".join(_row(*r) for r in _QA) + "\n" + _MISSING)
def indicator_qa(spark, sf):
    """The 26 checks of the indicator table; of the days every seventh has no valid file, and one has two."""
    r = V.records(spark, sf)
    day = F.dayofmonth("day")
    files = r.groupBy("day").agg(F.count("*").alias("n")).select("day", F.date_format("day", "yyyy-MM-dd").alias("date"), (day % 7 != 3).alias("valid"))
    files = files.unionByName(files.where(day == 12).withColumn("valid", F.lit(True))).withColumns({"exists": F.lit("True"), "movement_modality": F.lit("ALL")})
    used = r.where(day % 7 != 3)
    totals = used.groupBy("day", "dest").agg(F.sum("users").alias("u")).groupBy("day").agg(F.sum("u").alias("written"))
    log = used.groupBy("day").agg(
        (F.count("*") - F.count_distinct("dest", "origin")).alias("duplicate_od_records"), F.count_if(F.col("users").isNull()).alias("missing_values"), F.count_if(F.col("users") < 0).alias("negative_users"),
        F.count_if(F.col("signals") < 0).alias("negative_signals"), F.sum("users").alias("total_users"),
    )
    log = log.join(totals, "day").withColumns({"reconciliation_abs_diff": F.abs(F.col("total_users") - F.col("written")), "cache_status": F.when(F.dayofmonth("day") < 10, "cached").otherwise("processed")})
    m = flows.monthly_indicators(V.areas(spark, sf), r, V.expected(spark))
    return V.rounded(stages.indicator_qa(m, files, log, V.expected(spark), 31, 15), 4)


_MASTER = """, mm AS (SELECT area, mobility_inflow_total, mobility_inflow_total / observed_days AS mobility_inflow_mean_daily, flow_entropy, weekday_inflow_total, weekend_inflow_total, unique_origins,
weekday_inflow_total / observed_weekdays AS weekday_inflow_mean_daily, weekend_inflow_total / observed_weekend_days AS weekend_inflow_mean_daily,
(weekday_inflow_total / observed_weekdays) / nullif(weekend_inflow_total / observed_weekend_days, 0) AS weekday_weekend_ratio, observed_weekdays, observed_weekend_days, expected_days,
CASE WHEN observed_days = expected_days AND NOT provisional_flag THEN 'final_complete' ELSE 'not_final_complete' END AS mobility_coverage_status,
1 + area % 7 AS area_km2, 1000 + 13 * area AS population, area % 5 AS amenity_poi_count, area % 3 - 1 AS retail_poi_count, 10 * area AS employees_count FROM m),
ms AS (SELECT *, population / area_km2::DOUBLE AS population_density_km2, amenity_poi_count / area_km2::DOUBLE AS amenity_poi_density_km2, retail_poi_count / area_km2::DOUBLE AS retail_poi_density_km2 FROM mm)"""


def _all_hold(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS metric, (count(*) FILTER (NOT coalesce({condition}, false)) = 0)::INT::DOUBLE AS v, 1.0::DOUBLE AS least, 1.0::DOUBLE AS most FROM ms"


def _agrees(name: str, a: str, b: str, c: str) -> str:
    return f"SELECT '{name}', max(abs({a} - {b} / nullif({c}::DOUBLE, 0))), -1, 1e-6 FROM ms"


def _number(name: str, value: str, least: str = "-1e99", most: str = "1e99") -> str:
    return f"SELECT '{name}', ({value})::DOUBLE, {least}, {most} FROM ms"


_MASTER_ROWS = [
    *(_all_hold(f"{c}_nonnegative", f"{c} >= 0") for c in stages.NON_NEGATIVE),
    _all_hold("weekday_weekend_ratio_finite", "NOT isinf(weekday_weekend_ratio)"), _all_hold("mobility_coverage_status_final", "mobility_coverage_status = 'final_complete'"),
    _agrees("mobility_inflow_mean_daily_equals_total_div_31", "mobility_inflow_mean_daily", "mobility_inflow_total", "expected_days"),
    _agrees("weekday_inflow_mean_daily_equals_total_div_weekdays", "weekday_inflow_mean_daily", "weekday_inflow_total", "observed_weekdays"),
    _agrees("weekend_inflow_mean_daily_equals_total_div_weekends", "weekend_inflow_mean_daily", "weekend_inflow_total", "observed_weekend_days"),
    _agrees("weekday_weekend_ratio_equals_weekday_over_weekend", "weekday_weekend_ratio", "weekday_inflow_mean_daily", "weekend_inflow_mean_daily"),
    _agrees("population_density_km2_equals_population_over_area", "population_density_km2", "population", "area_km2"),
    _number("output_row_count", "count(*)", "15", "15"), _number("unique_keys", "count(DISTINCT area)", "15", "15"), _number("duplicate_keys", "count(area) - count(DISTINCT area)"),
    _number("missing_keys", "count(*) FILTER (area IS NULL)"), _number("valid_key_format_count", r"count(*) FILTER (regexp_matches(area::VARCHAR, '^\d{1,2}$'))", "15", "15"),
    _number("unmatched_areas", "count(*) FILTER (mobility_inflow_total IS NULL AND employees_count IS NULL)"),
    _number("geometry_count", "count(*) FILTER (area % 15 >= 0)", "15", "15"), _number("invalid_geometry_count", "count(*) FILTER (area % 4 = 3)", "0", "0"), _number("empty_geometry_count", "count(*) FILTER (area % 4 = 3)", "0", "0"),
]


@query(MONTHLY + _MASTER + "\nSELECT metric, round(v, 4) + 0.0 AS value, NULL::VARCHAR AS text, CASE WHEN v BETWEEN least AND most THEN 'pass' ELSE 'fail' END AS status FROM (" + "\nUNION ALL ".join(_MASTER_ROWS) + ")")
def master_qa(spark, sf):
    """Key, geometry, 14 logical and 5 relationship checks of a master table, of which some fail; every fourth ring is empty."""
    m = flows.monthly_indicators(V.areas(spark, sf), V.records(spark, sf), V.expected(spark)).withColumnsRenamed({
        "weekday_mean_daily_inflow": "weekday_inflow_mean_daily", "weekend_mean_daily_inflow": "weekend_inflow_mean_daily", "observed_weekdays": "mobility_weekday_count",
        "observed_weekend_days": "mobility_weekend_count", "expected_days": "mobility_expected_days",
    })
    a = F.col("area")
    status = S.coverage_status(F.col("observed_days"), F.col("mobility_expected_days"), F.col("provisional_flag"))
    m = m.withColumns({"mobility_coverage_status": status, "area_km2": 1 + a % 7, "population": 1000 + 13 * a, "amenity_poi_count": a % 5, "retail_poi_count": a % 3 - 1, "employees_count": 10 * a})
    m = m.withColumns({f"{c}_density_km2": F.col(s) / F.col("area_km2") for c, s in (("population", "population"), ("amenity_poi", "amenity_poi_count"), ("retail_poi", "retail_poi_count"))})
    corner = lambda x, y: F.struct((a % 15 + x).cast("double").alias("x"), (F.floor(a / 15) + y).cast("double").alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    m = m.withColumn("ring", F.when(a % 4 == 3, F.slice(ring, 1, 0)).otherwise(ring))
    return V.rounded(stages.master_qa(m, "area", r"^\d{1,2}$", 15, ["mobility_inflow_total", "employees_count"], "ring"), 4)


@query(
    MONTHLY
    + ", dd AS (SELECT day, is_weekend, count(*) AS rows, count(DISTINCT dest) AS destinations, sum(u) AS users FROM (SELECT day, dest, is_weekend, origin_class, sum(users) AS u FROM od GROUP BY ALL) GROUP BY ALL)\n"
    + "SELECT strftime(day, '%Y-%m-%d') AS day, is_weekend, rows, destinations, round(users, 4) AS users, (SELECT count(*) FROM areas) - destinations AS missing_destinations FROM dd"
)
def daily_cache_qa(spark, sf):
    daily = flows.daily_destination(V.records(spark, sf))
    return V.dated(V.rounded(stages.daily_cache_qa(daily, V.areas(spark, sf).count()), 4))
