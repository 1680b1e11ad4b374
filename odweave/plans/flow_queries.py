"""Queries of scans, flows, indicators and quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import flows, quality, stats
from odweave.plans import views as V
from odweave.plans.registry import query
from odweave.sources import files

OD, CAL = V.OD, V.CALENDAR


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


@query(_with(OD, CAL) + """SELECT strftime(c.day, '%Y-%m-%d') AS date, count(o.day) AS row_count, count(o.day) > 0 AS "exists", CASE WHEN count(o.day) > 0 THEN 'validated' ELSE 'missing' END AS processing_status,
CASE WHEN count(o.day) > 0 THEN '' ELSE 'missing_required_all_tracks_file' END AS exclusion_reason FROM calendar c LEFT JOIN od o ON o.day = c.day GROUP BY c.day""")
def manifest_calendar(spark, sf):
    seen = V.records(spark, sf).groupBy("day").agg(F.count("*").alias("row_count"))
    r = V.expected(spark).join(seen, "day", "left").fillna(0, ["row_count"]).withColumn("exists", F.col("row_count") > 0)
    return r.select(F.date_format("day", "yyyy-MM-dd").alias("date"), "row_count", "exists", F.when(F.col("exists"), "validated").otherwise("missing").alias("processing_status"), F.when(F.col("exists"), "").otherwise("missing_required_all_tracks_file").alias("exclusion_reason"))


_NAMES = """names AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'Audience_Profiles_Destination_' || strftime(o_orderdate, '%Y-%m-%d') || '_loco_all_tracks.tsv'
 WHEN 1 THEN 'Audience_Profiles_Destination_' || strftime(o_orderdate, '%Y-%m-%d') || '_loco_all_tracks_0-24.tsv' WHEN 2 THEN 'Audience_Profiles_Destination_' || strftime(o_orderdate, '%Y-%m-%d') || '_loco_pedestrian_tracks.tsv'
 WHEN 3 THEN 'Audience_Profiles_Destination_' || strftime(o_orderdate, '%Y-%m-%d') || '_x.tsv' ELSE 'notes.txt' END AS filename FROM orders)"""


@query(_with(_NAMES) + """SELECT file_type, candidate, exclusion, count(*) AS files, count(DISTINCT date) AS dates FROM (SELECT nullif(regexp_extract(filename, 'Audience_Profiles_Destination_(\\d{4}-\\d{2}-\\d{2})', 1), '') AS date,
CASE WHEN filename LIKE '%\\_all\\_tracks.tsv' ESCAPE '\\' THEN 'daily_loco_all_tracks' WHEN filename LIKE '%0-24.tsv' THEN 'hourly_0_24' WHEN filename LIKE '%pedestrian%' THEN 'pedestrian_tracks' WHEN filename LIKE '%.tsv' THEN 'unexpected_tsv' ELSE 'other' END AS file_type,
filename LIKE '%\\_all\\_tracks.tsv' ESCAPE '\\' AS candidate,
CASE WHEN filename LIKE '%\\_all\\_tracks.tsv' ESCAPE '\\' THEN '' WHEN filename LIKE '%0-24.tsv' THEN 'excluded_hourly_0_24' WHEN filename LIKE '%pedestrian%' THEN 'excluded_pedestrian_tracks' WHEN filename LIKE '%.tsv' THEN 'unexpected_filename_pattern' ELSE 'other' END AS exclusion
FROM names) GROUP BY ALL""")
def file_classifier(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = lambda tail: F.concat(F.lit("Audience_Profiles_Destination_"), day, F.lit(tail))
    k = F.col("o_orderkey") % 5
    n = F.when(k == 0, name("_loco_all_tracks.tsv")).when(k == 1, name("_loco_all_tracks_0-24.tsv")).when(k == 2, name("_loco_pedestrian_tracks.tsv")).when(k == 3, name("_x.tsv")).otherwise("notes.txt")
    t = V.table(spark, sf, "orders").select(n.alias("filename"))
    return t.withColumns(files.classify_name(F.col("filename"))).groupBy("file_type", "candidate", "exclusion").agg(F.count("*").alias("files"), F.count_distinct("date").alias("dates"))


_COVERAGE = """cov AS (SELECT count(*) AS expected_days, count(s.day) AS observed_days, count(CASE WHEN NOT c.is_weekend THEN s.day END) AS observed_weekdays, count(CASE WHEN c.is_weekend THEN s.day END) AS observed_weekend_days,
coalesce(string_agg(CASE WHEN s.day IS NULL THEN strftime(c.day, '%Y-%m-%d') END, '|' ORDER BY c.day), '') AS missing_dates, count(s.day)::DOUBLE / count(*) AS coverage_ratio, count(s.day) < count(*) AS provisional_flag
FROM calendar c LEFT JOIN (SELECT DISTINCT day FROM od) s ON s.day = c.day)"""


@query(_with(OD, CAL, _COVERAGE) + "SELECT expected_days, observed_days, observed_weekdays, observed_weekend_days, missing_dates, round(coverage_ratio, 6) AS coverage_ratio, provisional_flag, CASE WHEN provisional_flag THEN 'not_final_complete' ELSE 'final_complete' END AS status FROM cov")
def coverage_summary(spark, sf):
    c = flows.coverage(V.records(spark, sf), V.expected(spark))
    return V.rounded(c.withColumn("status", S.coverage_status(F.col("observed_days"), F.col("expected_days"), F.col("provisional_flag"))))


@query(_with(OD) + "SELECT strftime(day, '%Y-%m-%d') AS day, dest, is_weekend, origin_class, round(sum(users), 6) AS users, sum(signals) AS signals FROM od GROUP BY ALL")
def daily_destination_agg(spark, sf):
    return V.dated(V.rounded(flows.daily_destination(V.records(spark, sf))))


@query(_with(OD) + "SELECT strftime(day, '%Y-%m-%d') AS day, origin::BIGINT AS origin_area, round(sum(users), 6) AS users, sum(signals) AS signals FROM od WHERE in_scope GROUP BY ALL")
def daily_origin_agg(spark, sf):
    return V.dated(V.rounded(flows.daily_origin(V.records(spark, sf))))


@query(_with(OD) + "SELECT strftime(day, '%Y-%m-%d') AS day, dest, origin, round(sum(users), 6) AS users, sum(signals) AS signals FROM od WHERE valid GROUP BY ALL")
def od_components(spark, sf):
    return V.dated(V.rounded(flows.daily_components(V.records(spark, sf))))


@query("SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, props FROM events)) AS duplicate_rows FROM events")
def duplicate_od_count(spark, sf):
    return V.records(spark, sf).agg(F.count("*").alias("rows"), quality.duplicates(["dest", "origin"]).alias("duplicate_rows"))


@query(_with(OD) + """SELECT count(*) AS rows, sum((dest IS NULL)::INT + (origin IS NULL)::INT + (day IS NULL)::INT + (modality IS NULL)::INT + (users IS NULL)::INT + (signals IS NULL)::INT)::BIGINT AS missing_values,
count(*) FILTER (users < 0) AS negative_users, count(*) FILTER (signals < 0) AS negative_signals, count(*) FILTER (modality <> 'ALL') AS modality_mismatches, count(*) FILTER (valid) AS valid_origin_rows, count(*) FILTER (NOT valid) AS invalid_origin_rows,
count(*) FILTER (in_scope) AS in_scope_origin_rows, round(sum(users), 4) AS total_users, sum(signals) AS total_signals, count(*) - (SELECT count(*) FROM (SELECT DISTINCT dest, origin, day FROM od)) AS duplicate_rows FROM od""")
def scan_qa_counters(spark, sf):
    return V.rounded(quality.scan_counters(V.records(spark, sf)), 4)


@query(_with(OD) + "SELECT dest AS area, round(sum(users), 6) AS inflow FROM od GROUP BY dest")
def inflow_total(spark, sf):
    return V.rounded(flows.total_by(V.records(spark, sf).withColumnRenamed("dest", "area"), "area", "inflow"))


_RATIO = "wk AS (SELECT dest AS area, sum(CASE WHEN NOT is_weekend THEN users END) AS weekday, sum(CASE WHEN is_weekend THEN users END) AS weekend FROM od GROUP BY dest)"


@query(_with(OD, CAL, _COVERAGE, _RATIO) + """SELECT area, round(coalesce(weekday, 0) / observed_weekdays, 6) AS weekday_mean_daily_inflow, round(coalesce(weekend, 0) / observed_weekend_days, 6) AS weekend_mean_daily_inflow,
round((coalesce(weekday, 0) / observed_weekdays) / nullif(coalesce(weekend, 0) / observed_weekend_days, 0), 6) AS weekday_weekend_ratio, coalesce(weekend, 0) = 0 AS weekday_weekend_zero_denominator FROM wk, cov""")
def weekday_weekend_ratio(spark, sf):
    m = flows.monthly_indicators(V.areas(spark, sf), V.records(spark, sf), V.expected(spark))
    return V.rounded(m.select("area", "weekday_mean_daily_inflow", "weekend_mean_daily_inflow", "weekday_weekend_ratio", "weekday_weekend_zero_denominator"))


_ENTROPY = """ent AS (SELECT dest, -sum(u / t * ln(u / t)) AS flow_entropy, count(*) AS unique_origins, max(t) AS entropy_denominator FROM
(SELECT dest, origin, u, sum(u) OVER (PARTITION BY dest) AS t FROM (SELECT dest, origin, sum(users) AS u FROM od WHERE valid GROUP BY ALL) WHERE u > 0) GROUP BY dest)"""


@query(_with(OD, _ENTROPY) + "SELECT dest, round(flow_entropy, 6) AS flow_entropy, unique_origins, round(entropy_denominator, 6) AS entropy_denominator FROM ent")
def flow_entropy(spark, sf):
    return V.rounded(flows.entropy(V.records(spark, sf).where("valid")))


@query(_with(OD, _ENTROPY) + "SELECT dest, round(flow_entropy, 6) AS flow_entropy, unique_origins, round(CASE WHEN unique_origins > 1 THEN flow_entropy / ln(unique_origins) END, 6) AS normalised_entropy FROM ent")
def normalized_entropy(spark, sf):
    e = flows.entropy(V.records(spark, sf).where("valid"))
    return V.rounded(e.select("dest", "flow_entropy", "unique_origins", S.normalised_entropy(F.col("flow_entropy"), F.col("unique_origins")).alias("normalised_entropy")))


_PIVOT = "pv AS (SELECT dest, coalesce(sum(users) FILTER (origin_class = 'in_scope_origin'), 0) AS in_scope_origin_flow, coalesce(sum(users) FILTER (origin_class = 'valid_external_origin'), 0) AS valid_external_origin_flow, coalesce(sum(users) FILTER (origin_class = 'other_origin'), 0) AS other_origin_flow FROM od GROUP BY dest)"


@query(_with(OD, _PIVOT) + "SELECT dest, round(in_scope_origin_flow, 6) AS in_scope_origin_flow, round(valid_external_origin_flow, 6) AS valid_external_origin_flow, round(other_origin_flow, 6) AS other_origin_flow FROM pv")
def origin_class_pivot(spark, sf):
    return V.rounded(flows.class_pivot(flows.daily_destination(V.records(spark, sf))))


@query(_with(OD) + "SELECT dest, origin, round(users, 6) AS users, round(users / sum(users) OVER (PARTITION BY dest), 8) AS share FROM (SELECT dest, origin, sum(users) AS users FROM od WHERE valid GROUP BY ALL) WHERE users > 0")
def origin_shares(spark, sf):
    s = flows.origin_shares(flows.daily_components(V.records(spark, sf)))
    return s.select("dest", "origin", F.round("users", 6).alias("users"), F.round("share", 8).alias("share"))


_NET = "outf AS (SELECT origin::BIGINT AS area, sum(users) AS outflow FROM od WHERE in_scope GROUP BY origin)"


@query(_with(OD, V.AREAS, V.INFLOW, _NET) + "SELECT area, round(inflow, 6) AS inflow, round(coalesce(outflow, 0), 6) AS outflow, round(inflow - coalesce(outflow, 0), 6) AS net_flow FROM inflow LEFT JOIN outf USING (area)")
def net_flow(spark, sf):
    m = flows.monthly_indicators(V.areas(spark, sf), V.records(spark, sf), V.expected(spark))
    return V.rounded(m.select("area", F.col("mobility_inflow_total").alias("inflow"), F.col("mobility_outflow_total").alias("outflow"), "net_flow"))


_MONTHLY = _with(OD, CAL, V.AREAS, _COVERAGE, _RATIO, _ENTROPY, _PIVOT, _NET) + """, m AS (SELECT a.area, c.*, coalesce(i.inflow, 0) AS mobility_inflow_total, coalesce(e.flow_entropy, 0) AS flow_entropy, coalesce(e.unique_origins, 0) AS unique_origins, coalesce(e.entropy_denominator, 0) AS entropy_denominator,
coalesce(w.weekday, 0) AS weekday_inflow_total, coalesce(w.weekend, 0) AS weekend_inflow_total, coalesce(o.outflow, 0) AS mobility_outflow_total, coalesce(p.in_scope_origin_flow, 0) AS in_scope_origin_flow, coalesce(p.valid_external_origin_flow, 0) AS valid_external_origin_flow,
coalesce(p.other_origin_flow, 0) AS other_origin_flow FROM areas a CROSS JOIN cov c LEFT JOIN (SELECT dest, sum(users) AS inflow FROM od GROUP BY dest) i ON i.dest = a.area LEFT JOIN ent e ON e.dest = a.area LEFT JOIN wk w ON w.area = a.area LEFT JOIN outf o ON o.area = a.area LEFT JOIN pv p ON p.dest = a.area) """
_R6 = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query(_MONTHLY + "SELECT area, observed_days, expected_days, round(coverage_ratio, 6) AS coverage_ratio, observed_weekdays, observed_weekend_days, missing_dates, provisional_flag, unique_origins, " + _R6("mobility_inflow_total", "flow_entropy", "weekday_inflow_total", "weekend_inflow_total", "mobility_outflow_total", "in_scope_origin_flow", "valid_external_origin_flow", "other_origin_flow", "entropy_denominator") + """,
round(mobility_inflow_total / observed_days, 6) AS mobility_inflow_mean_daily, round(weekday_inflow_total / observed_weekdays, 6) AS weekday_mean_daily_inflow, round(weekend_inflow_total / observed_weekend_days, 6) AS weekend_mean_daily_inflow,
round((weekday_inflow_total / observed_weekdays) / nullif(weekend_inflow_total / observed_weekend_days, 0), 6) AS weekday_weekend_ratio, weekend_inflow_total = 0 AS weekday_weekend_zero_denominator,
round(mobility_inflow_total - mobility_outflow_total, 6) AS net_flow, round(coalesce(other_origin_flow / nullif(mobility_inflow_total, 0), 0), 6) AS other_origin_share, round(coalesce(entropy_denominator / nullif(mobility_inflow_total, 0), 0), 6) AS valid_origin_flow_share,
round(coalesce(valid_external_origin_flow / nullif(mobility_inflow_total, 0), 0), 6) AS external_origin_share FROM m""")
def monthly_indicators(spark, sf):
    return V.rounded(flows.monthly_indicators(V.areas(spark, sf), V.records(spark, sf), V.expected(spark)))


_TWICE = (
    "one AS (SELECT area, coalesce(sum(users) FILTER (is_weekend), 0) AS w FROM areas LEFT JOIN od ON dest = area GROUP BY area)",
    "two AS (SELECT dest, sum(u) AS v FROM (SELECT dest, day, sum(users) AS u FROM od WHERE is_weekend GROUP BY ALL) GROUP BY dest)",
)


@query(_with(OD, V.AREAS, *_TWICE) + "SELECT count(*) AS areas, round(sum(coalesce(v, 0)), 4) AS total, round(corr(coalesce(v, 0), w), 4) AS correlation, round(max(abs(coalesce(v, 0) - w)), 4) AS max_abs_diff FROM one LEFT JOIN two ON dest = area")
def weekend_inflow_reconcile(spark, sf):
    m = flows.monthly_indicators(V.areas(spark, sf), V.records(spark, sf), V.expected(spark))
    return V.rounded(flows.weekend_reconciliation(V.records(spark, sf), m), 4)


@query("""WITH b AS (SELECT DISTINCT c_custkey AS k FROM customer), o AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN o_custkey + 1000000 ELSE o_custkey END AS k FROM orders),
s AS (SELECT k, count(*) AS n FROM o WHERE k IS NOT NULL GROUP BY 1), j AS (SELECT coalesce(b.k, s.k) AS k, b.k IS NOT NULL AS inb, s.n FROM b FULL JOIN s ON b.k = s.k)
SELECT (SELECT count(*) FROM o) AS rows, count(n) AS unique_keys, count(*) FILTER (inb AND n IS NOT NULL) AS matched, count(*) FILTER (inb AND n IS NULL) AS unmatched_base, count(*) FILTER (NOT inb) AS extra_source, sum(n - 1)::BIGINT AS duplicate_rows, (SELECT count(*) FROM o WHERE k IS NULL) AS missing_keys,
coalesce(sum(n) FILTER (regexp_matches(k::VARCHAR, '^\\d{1,3}$')), 0)::BIGINT AS valid_format_rows FROM j""")
def join_coverage(spark, sf):
    base = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    n = F.col("o_orderkey") % 10  # some keys are missing, some unknown
    k = F.when(n == 0, None).when(n == 1, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    return quality.join_coverage(base, V.table(spark, sf, "orders").select(k.alias("k")), "k", r"^\d{1,3}$")


_NUM = ["c_acctbal", "c_nationkey"]
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS non_null, count(*) - count({c}) AS missing, 0::BIGINT AS infinite, count(*) FILTER ({c} < 0) AS negative, count(*) FILTER ({c} = 0) AS zero, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean, median({c})::DOUBLE AS median, stddev_samp({c}) AS sd FROM customer" for c in _NUM)


@query(f"""WITH p AS ({_PROFILE}), l AS (UNPIVOT (SELECT variable, non_null::DOUBLE AS non_null, missing::DOUBLE AS missing, infinite::DOUBLE AS infinite, negative::DOUBLE AS negative, zero::DOUBLE AS zero, min, max, mean, median, sd FROM p) ON COLUMNS(* EXCLUDE variable) INTO NAME metric VALUE value)
SELECT variable, metric, round(value, 4) AS value, CASE WHEN metric = 'negative' AND value > 0 THEN 'warn' ELSE 'pass' END AS status FROM l""")
def numeric_qa_long(spark, sf):
    return V.rounded(quality.profile_long(quality.numeric_profile(V.table(spark, sf, "customer"), _NUM), ("c_acctbal",)), 4)


_INVARIANTS = """, v AS (SELECT count(*) FILTER (NOT mobility_inflow_total >= 0)::DOUBLE AS inflow_not_negative,
count(*) FILTER (NOT (flow_entropy >= -1e-9 AND flow_entropy <= ln(greatest(unique_origins, 1)) + 1e-9))::DOUBLE AS entropy_within_bound, count(*) FILTER (NOT weekend_inflow_total > 50)::DOUBLE AS busy_weekend,
max(abs(in_scope_origin_flow + valid_external_origin_flow + other_origin_flow - mobility_inflow_total)) AS classes_add_up, max(abs(weekday_inflow_total + weekend_inflow_total - mobility_inflow_total)) AS days_add_up,
max(abs((mobility_inflow_total - mobility_outflow_total) + mobility_outflow_total - mobility_inflow_total)) AS net_is_in_less_out, max(abs(weekday_inflow_total - weekend_inflow_total)) AS days_alike FROM m)
SELECT check_name, round(value, 4) AS value, CASE WHEN value <= CASE WHEN check_name IN ('inflow_not_negative', 'entropy_within_bound', 'busy_weekend') THEN 0 ELSE 1e-6 END THEN 'pass' ELSE 'fail' END AS status
FROM (UNPIVOT v ON inflow_not_negative, entropy_within_bound, classes_add_up, days_add_up, net_is_in_less_out, busy_weekend, days_alike INTO NAME check_name VALUE value)"""


@query(_MONTHLY + _INVARIANTS)
def invariant_checks(spark, sf):
    m = flows.monthly_indicators(V.areas(spark, sf), V.records(spark, sf), V.expected(spark))
    c = F.col
    checks = {"inflow_not_negative": c("mobility_inflow_total") >= 0, "entropy_within_bound": (c("flow_entropy") >= -1e-9) & (c("flow_entropy") <= F.ln(F.greatest(c("unique_origins"), F.lit(1))) + 1e-9)}
    checks["busy_weekend"] = c("weekend_inflow_total") > 50  # checks that may fail, too
    pairs = {"classes_add_up": (c("in_scope_origin_flow") + c("valid_external_origin_flow") + c("other_origin_flow"), c("mobility_inflow_total")), "days_add_up": (c("weekday_inflow_total") + c("weekend_inflow_total"), c("mobility_inflow_total")), "net_is_in_less_out": (c("net_flow") + c("mobility_outflow_total"), c("mobility_inflow_total"))}
    pairs["days_alike"] = (c("weekday_inflow_total"), c("weekend_inflow_total"))
    return V.rounded(quality.invariants(m, checks, pairs), 4)


@query("""SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name, coalesce(l.lines, 0) AS lines, round(coalesce(l.revenue, 0), 4) AS revenue, l.lines IS NOT NULL AS has_lines FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT l_suppkey, count(*) AS lines, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1) l ON l.l_suppkey = s.s_suppkey""")
def master_join(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    lines = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.sum("l_extendedprice").alias("revenue"))
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    m = quality.one_to_one(t("supplier"), lines, "s_suppkey").join(quality.unique_on(place, "s_nationkey", "places"), "s_nationkey", "left")
    return V.rounded(m.select("s_suppkey", "s_name", "n_name", "r_name", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.col("lines").isNotNull().alias("has_lines")), 4)


@query(_with(OD) + """, log AS (SELECT day, count(*) AS rows FROM od GROUP BY day), new AS (SELECT day, count(*) * 2 AS rows, 'rerun' AS note FROM od WHERE day >= DATE '2024-01-25' GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS day, rows, NULL AS note FROM log WHERE day NOT IN (SELECT day FROM new) UNION ALL SELECT strftime(day, '%Y-%m-%d'), rows, note FROM new""")
def log_upsert(spark, sf):
    r = V.records(spark, sf)
    new = r.where("day >= DATE '2024-01-25'").groupBy("day").agg((F.count("*") * 2).alias("rows")).withColumn("note", F.lit("rerun"))
    return V.dated(quality.upsert(r.groupBy("day").agg(F.count("*").alias("rows")), new, "day"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def keep_last_dedup(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return quality.keep_last(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT regexp_replace(s_name || ' 012A', '\\s+\\d{3}[A-Z]$', '') AS borough, s_suppkey FROM supplier")
def borough_extract(spark, sf):
    return V.table(spark, sf, "supplier").select(S.borough(F.concat("s_name", F.lit(" 012A"))).alias("borough"), "s_suppkey")


@query("""WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer) SELECT 'both' AS part, count(*) AS keys FROM (SELECT k FROM k INTERSECT SELECT k FROM c) UNION ALL
SELECT 'only_base', count(*) FROM (SELECT k FROM c EXCEPT SELECT k FROM k) UNION ALL SELECT 'only_source', count(*) FROM (SELECT k FROM k EXCEPT SELECT k FROM c)""")
def key_set_operations(spark, sf):
    s = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    part = lambda name, df: df.agg(F.count("*").alias("keys")).select(F.lit(name).alias("part"), "keys")
    return part("both", s.intersect(b)).unionByName(part("only_base", b.subtract(s))).unionByName(part("only_source", s.subtract(b)))


@query("SELECT c_mktsegment AS segment, count(*) AS n, strftime(max(o_orderdate), '%Y-%m') AS last_month, sha256(concat_ws('|', c_mktsegment, count(*)::VARCHAR)) AS signature, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS states FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def scalar_functions(spark, sf):
    j = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("last_month"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "|").alias("states"))
    return g.withColumn("signature", S.signature(F.col("segment"), F.col("n")))


@query("""SELECT model, round(v, 4) AS v, round(v - first_value(v) OVER (ORDER BY CASE model WHEN 'R' THEN 0 ELSE 1 END), 4) AS delta_v FROM (SELECT l_returnflag AS model, avg(l_quantity) AS v FROM lineitem GROUP BY 1)""")
def delta_vs_baseline(spark, sf):
    m = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_quantity").alias("v"))
    return V.rounded(stats.delta_vs_baseline(m, "model", "R", ["v"]), 4)
