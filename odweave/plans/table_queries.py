"""Queries of joins, keys, folds, geometry joins and small table operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import flows, quality, spatial, stats
from odweave.operators import regression as R
from odweave.plans import sql_models as Q
from odweave.plans import stages
from odweave.plans import views as V
from odweave.plans.flow_queries import _with
from odweave.plans.registry import query
from odweave.sources import files

FR, Y, X = V.FRAME, "log_revenue", V.PREDICTORS


def _rings(spark, sf):
    """Unit squares of the areas."""
    a = V.areas(spark, sf)
    corner = lambda x, y: F.struct((F.col("x") + x).cast("double").alias("x"), (F.col("y") + y).cast("double").alias("y"))
    return a.select("area", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


def _frame_rings(frame):
    corner = lambda x, y: F.struct((F.col("x") + x).cast("double").alias("x"), (F.col("y") + y).cast("double").alias("y"))
    return frame.select("area", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


@query(_with(V.OD, V.AREAS, "few AS (SELECT dest, sum(users) AS inflow FROM od WHERE dest % 3 <> 0 GROUP BY dest)") + "SELECT area, x + 0.5::DOUBLE AS cx, y + 0.5::DOUBLE AS cy, round(inflow, 6) AS inflow FROM areas LEFT JOIN few ON dest = area")
def geometry_indicators(spark, sf):
    """Geometry with an indicator that some areas lack."""
    t = flows.total_by(V.records(spark, sf).where("dest % 3 != 0").withColumnRenamed("dest", "area"), "area", "inflow")
    g = spatial.attach_geometry(_rings(spark, sf), t)
    x, y = spatial.ring_centroid(F.col("ring"))
    return V.rounded(g.select("area", x.alias("cx"), y.alias("cy"), "inflow"))


_LAGGED = "lagged AS (SELECT z.area, z.z, coalesce(sum(w.w * n.z), 0) AS lag_z FROM z LEFT JOIN weights w ON w.i = z.area LEFT JOIN z n ON n.area = w.j GROUP BY ALL)"
_SPATIAL = (V.OD, V.AREAS, V.EDGES, V.INFLOW, V.ZINFLOW, _LAGGED)


@query(_with(*_SPATIAL) + "SELECT area, x::DOUBLE AS min_x, y::DOUBLE AS min_y, round(z * lag_z / (SELECT sum(z * z) / (count(*) - 1) FROM z), 6) AS local_i FROM areas JOIN lagged USING (area)")
def geometry_lisa(spark, sf):
    """Geometry with local Moran statistics."""
    t = spatial.local_moran(V.inflow(spark, sf), V.weights(spark, sf), "area", "inflow")
    g = spatial.attach_geometry(_rings(spark, sf), t)
    b = spatial.ring_bounds(F.col("ring"))
    return V.rounded(g.select("area", b["min_x"].alias("min_x"), b["min_y"].alias("min_y"), "local_i"))


@query(_with(*_SPATIAL) + "SELECT area, 1.0::DOUBLE AS size, CASE WHEN z > 0.5 AND lag_z > 0.1 THEN 'Both HH' WHEN z > 0.5 THEN 'First HH only' WHEN lag_z > 0.1 THEN 'Second HH only' ELSE 'Non-significant' END AS hotspot FROM areas JOIN lagged USING (area) WHERE area % 4 <> 1")
def geometry_overlap(spark, sf):
    """Geometry with hotspot classes: only areas that have both."""
    t = spatial.lag(spatial.standardised(V.inflow(spark, sf), "inflow").select("area", "z"), V.weights(spark, sf), "area", ["z"]).where("area % 4 != 1")
    hot = lambda c, b: F.when(F.col(c) > b, "High-High").otherwise("Not Significant")
    o = spatial.overlap(t.select("area", hot("z", 0.5).alias("cluster")), t.select("area", hot("lag_z", 0.1).alias("cluster")), "area")
    g = spatial.attach_geometry(_rings(spark, sf), o, how="inner")
    return V.rounded(g.select("area", spatial.ring_area(F.col("ring")).alias("size"), "hotspot"))


@query(_with(FR, *Q.orthogonal("fit", "frame", Y, X)) + "SELECT area, x::DOUBLE AS min_x, y::DOUBLE AS min_y, round(e, 6) + 0.0 AS residual FROM fit")
def geometry_residuals(spark, sf):
    """Geometry with the residuals of the model."""
    f = V.model_frame(spark, sf)
    fit = R.fit_ols(f, Y, X)
    g = spatial.attach_geometry(_frame_rings(f), fit.data.select("area", fit.residual().alias("residual")))
    b = spatial.ring_bounds(F.col("ring"))
    return V.rounded(g.select("area", b["min_x"].alias("min_x"), b["min_y"].alias("min_y"), "residual"))


@query(_with(FR, *Q.orthogonal("fit", "frame", Y, X)) + "SELECT area, " + ", ".join(f"round({c}, 6) AS {c}" for c in X) + ", round(fit, 6) AS fitted FROM fit")
def features_predictions(spark, sf):
    """Features beside a second table of the same rows: joined by key, one to one, never by position."""
    f = V.model_frame(spark, sf)
    fit = R.fit_ols(f, Y, X)
    return V.rounded(quality.one_to_one(f.select("area", *X), fit.data.select("area", fit.fitted().alias("fitted")), "area", "inner"))


_FOLDED = "folded AS (SELECT *, least((x - (SELECT min(x) FROM frame)) * 5 // (SELECT max(x) - min(x) + 1 FROM frame), 4) AS fold FROM frame)"


@query(_with(FR, _FOLDED) + "SELECT fold::INT AS fold, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS areas, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(log_revenue), 6) AS mean_response FROM folded GROUP BY ALL")
def fold_summary(spark, sf):
    """The master table with its folds, joined one to one; counts and centres by fold."""
    from odweave.operators import learning

    f = V.model_frame(spark, sf)
    j = quality.one_to_one(f, learning.strip_folds(f).select("area", "fold"), "area").withColumn("part", S.partition_label(F.col("fold")))
    return V.rounded(j.groupBy("fold", "part").agg(F.count("*").alias("areas"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.avg(Y).alias("mean_response")))


_KEYS = "k AS (SELECT s_suppkey, '  ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE '' END AS raw, CASE s_suppkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN 'no' END AS flag, s_acctbal, 1e6 * (s_suppkey % 3) AS m2 FROM supplier)"


@query(_with(_KEYS) + "SELECT s_suppkey, trim(raw) AS key, regexp_matches(trim(raw), '[02468]$') AS formed, coalesce(lower(flag) IN ('true', '1'), false) AS flag, round(s_acctbal / nullif(m2 / 1e6, 0), 6) AS density, abs(s_acctbal - round(s_acctbal, 1)) <= 1e-8 + 1e-5 * abs(round(s_acctbal, 1)) AS near FROM k")
def key_cleaning(spark, sf):
    """Keys trimmed and tested by a pattern, flags as text, densities that may be undefined, numbers that are nearly alike."""
    i = F.col("s_suppkey")
    t = V.table(spark, sf, "supplier").withColumns({"raw": F.concat(F.lit("  "), "s_name", F.when(i % 2 == 0, " ").otherwise("")), "f": F.when(i % 4 == 0, "True").when(i % 4 == 1, "1").when(i % 4 == 2, "no"), "m2": 1e6 * (i % 3)})
    key = S.standard_key(F.col("raw"))
    return V.rounded(t.select("s_suppkey", key.alias("key"), S.matches(key, "[02468]$").alias("formed"), S.truthy(F.col("f")).alias("flag"), S.density(F.col("s_acctbal"), F.col("m2")).alias("density"), S.close_to(F.col("s_acctbal"), F.round("s_acctbal", 1)).alias("near")))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'provisional' ELSE 'source' END AS status FROM orders")
def source_status(spark, sf):
    path = F.when(F.col("o_orderstatus") == "F", "out/Final_31days.csv").when(F.col("o_orderstatus") == "P", "out/PROVISIONAL_28days.csv").otherwise("in/raw.tsv")
    return V.table(spark, sf, "orders").select("o_orderkey", S.source_status(path).alias("status"))


@query("SELECT column_name FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AND column_name NOT IN ('l_orderkey', 'l_linenumber')")
def numeric_columns(spark, sf):
    t = V.table(spark, sf, "lineitem")
    return spark.createDataFrame([(c,) for c in quality.numeric_columns(t, ("l_orderkey", "l_linenumber"))], "column_name string")


@query(
    _with(FR) + " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS min, round(max({c}), 6) AS max, min({c}) = max({c}) AS constant FROM frame" for c in [Y, *X])
)
def feature_summary(spark, sf):
    """What a model is given: response and features, with the gate that no feature is constant or missing."""
    f = V.model_frame(spark, sf)
    p = quality.numeric_profile(f, [Y, *X])
    t = p.select("variable", F.col("non_null").alias("n"), "missing", "mean", "sd", "min", "max", (F.col("min") == F.col("max")).alias("constant"))
    quality.gate(t.select(F.col("variable").alias("metric"), S.status((F.col("missing") == 0) & ~F.col("constant")).alias("status")), "features")
    return V.rounded(t)


_BETAS = " UNION ALL ".join(f"SELECT '{x}' AS term, estimate * (SELECT stddev_pop({x}) / stddev_pop({Y}) FROM frame) AS b FROM sb_{x}_c" for x in X)


@query(_with(FR, *(c for x in X for c in Q.coefficient(f"sb_{x}", "frame", Y, x, [o for o in X if o != x]))) + f"SELECT term, round(b, 6) + 0.0 AS std_beta FROM ({_BETAS})")
def standardised_betas(spark, sf):
    return V.rounded(R.fit_ols(V.model_frame(spark, sf), Y, X).coefficients(spark).where("term != 'const'").select("term", "std_beta"))


_LOGGED = "logged AS (SELECT area, log_revenue, " + ", ".join(f"ln(1 + {c}) AS {c}" for c in X) + " FROM frame)"
_IMPORTANCE = " UNION ALL ".join(f"SELECT '{m}' AS model, '{x}' AS feature, abs(estimate * (SELECT stddev_pop({x}) / stddev_pop({Y}) FROM {t})) AS importance FROM i{m}_{x}_c" for m, t in (("raw", "frame"), ("logged", "logged")) for x in X)


@query(
    _with(FR, _LOGGED, *(c for m, t in (("raw", "frame"), ("logged", "logged")) for x in X for c in Q.coefficient(f"i{m}_{x}", t, Y, x, [o for o in X if o != x])))
    + f"SELECT model, feature, round(importance, 6) AS importance, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM ({_IMPORTANCE})"
)
def importance_rank(spark, sf):
    """Features of two models ranked by their absolute standardised coefficients."""
    f = V.model_frame(spark, sf)
    t = None
    for name, df in (("raw", f), ("logged", f.withColumns({c: F.log1p(c) for c in X}))):
        c = R.fit_ols(df, Y, X).coefficients(spark).where("term != 'const'").select(F.lit(name).alias("model"), F.col("term").alias("feature"), F.abs("std_beta").alias("importance"))
        t = c if t is None else t.unionByName(c)
    return V.rounded(stats.ranked(t, ["model"], [F.desc("importance"), F.col("feature")]))


@query(_with(FR) + "SELECT round(sqrt((1 + abs(r)) / (1 - abs(r))), 6) AS condition_number FROM (SELECT corr(quantity, lines) AS r FROM frame)")
def condition_number(spark, sf):
    n = stats.condition_number(V.model_frame(spark, sf), ["quantity", "lines"])
    return V.rounded(spark.createDataFrame([(n,)], "condition_number double"))


@query("SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, props FROM events)) AS duplicate_rows FROM events")
def duplicate_row_hashes(spark, sf):
    """Repeated pairs by a 64-bit hash of the row."""
    t = V.table(spark, sf, "events").select(S.row_hash(F.col("user_id"), F.col("props")).alias("h"))
    return t.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("h")).alias("duplicate_rows"))


_CENSUS = """geo AS (SELECT 'E010' || lpad(c_custkey::VARCHAR, 5, '0') AS code, 1e6 * (1 + c_custkey % 3) AS m2 FROM customer WHERE c_custkey < 100000),
raw AS (SELECT 'E010' || lpad(c_custkey::VARCHAR, 5, '0') AS code, 1000 + c_custkey AS population FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey < 100000)"""


@query(_with(_CENSUS) + "SELECT code, population, m2 / 1e6 AS area_km2, round(population / (m2 / 1e6), 6) AS density_km2 FROM geo LEFT JOIN raw USING (code)")
def census_population(spark, sf):
    """Population by area from text with footers, joined one to one with the geography."""
    k = F.col("c_custkey")
    c = V.table(spark, sf, "customer").where(k < 100000).withColumn("code", F.concat(F.lit("E010"), F.lpad(k.cast("string"), 5, "0")))
    raw = c.where(k % 10 != 0).select(F.col("c_name").alias("name"), F.concat(F.lit(" "), "code").alias("code"), (1000 + k).cast("string").alias("population"))
    raw = raw.unionByName(spark.createDataFrame([("Note: estimates are rounded", None, None)], "name string, code string, population string"))
    t, _ = stages.census_population(raw, c.select("code", (1e6 * (1 + k % 3)).alias("square_metres")))
    return V.rounded(t.select("code", "population", "area_km2", "density_km2"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_acctbal < 0 THEN 'reset' ELSE s_name END AS s_name FROM supplier")
def predicate_update(spark, sf):
    t = V.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_name")
    return quality.update_where(t, F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0), "s_name": F.lit("reset")})


@query(
    _with("lk AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 90)", "r AS (SELECT event_id, user_id % 100 AS d, CAST(json_extract_string(props, '$.k') AS INTEGER) AS o FROM events)")
    + "SELECT event_id, a.k IS NOT NULL AS dest_valid, coalesce(a.k < 60, false) AS dest_in_scope, CASE WHEN a.k < 60 THEN a.k // 2 END AS dest_area, b.k IS NOT NULL AS origin_valid, coalesce(b.k < 60, false) AS origin_in_scope FROM r LEFT JOIN lk a ON a.k = d LEFT JOIN lk b ON b.k = o"
)
def mapped_flows(spark, sf):
    """Destination and origin mapped by a lookup; flags are false where it has no row."""
    e = V.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    lookup = e.select(k.alias("key")).where("key < 90").distinct()
    lookup = lookup.select("key", F.lit(True).alias("valid"), (F.col("key") < 60).alias("in_scope"), F.when(F.col("key") < 60, F.floor(F.col("key") / 2)).alias("area"))
    r = e.select("event_id", (F.col("user_id") % 100).cast("int").alias("code"), k.alias("origin"))
    j = flows.attach_lookup(flows.attach_lookup(r, lookup, "code", "dest"), lookup, "origin", "origin")
    return j.select("event_id", "dest_valid", "dest_in_scope", "dest_area", "origin_valid", "origin_in_scope")


@query(_with("lg AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, max(event_id) % 4 AS s FROM events GROUP BY 1)") + "SELECT date FROM lg WHERE s IN (0, 1)")
def successful_days(spark, sf):
    """Days whose log says so, as text in several forms."""
    g = V.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg((F.max("event_id") % 4).alias("s"))
    return files.successful_days(g.withColumn("success", F.when(F.col("s") == 0, "True").when(F.col("s") == 1, "1").when(F.col("s") == 2, "False")))


@query(_with("lg AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)") + "SELECT strftime(day, '%Y-%m-%d') AS date, 's' || n AS source_signature, 'h' AS schema_signature FROM lg WHERE NOT (extract(day FROM day) % 3 = 0 AND extract(day FROM day) < 20)")
def days_to_process(spark, sf):
    """Days without a valid cache: of another version, or with another signature."""
    g = V.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    wanted = g.select(F.date_format("day", "yyyy-MM-dd").alias("date"), F.concat(F.lit("s"), F.col("n").cast("string")).alias("source_signature"), F.lit("h").alias("schema_signature"))
    d = F.dayofmonth(F.to_date("date"))
    log = wanted.where(d % 3 == 0).withColumns({"processing_version": F.when(d < 20, "v1").otherwise("v0"), "success": F.lit("true")})
    changed = wanted.where(d % 3 == 1).withColumns({"source_signature": F.lit("other"), "processing_version": F.lit("v1"), "success": F.lit("true")})
    return files.days_to_process(wanted, log.unionByName(changed), "v1")


@query(_with("c AS (SELECT o_custkey AS area, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL)") + "SELECT area, status, n, count(*) OVER (PARTITION BY status) AS peers FROM c WHERE area IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def scoped_orders(spark, sf):
    """Rows whose key another table has (a semi-join), with group sizes joined back."""
    from odweave.operators.grouping import join_group
    from odweave.storage import stored

    c = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("area"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    keep = V.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("area"))
    c = stored(c.join(keep, "area", "left_semi"), "scoped")
    return join_group(c, stored(c.groupBy("status").agg(F.count("*").alias("peers")), "peers"), ["status"], "peers").select("area", "status", "n", "peers")
