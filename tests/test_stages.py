"""Composite stages on small tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from odweave.operators import spatial
from odweave.plans import stages, views
from odweave.sources.daily_cache import DailyCache
from tests.conftest import SF


def test_census(spark):
    raw = spark.createDataFrame([("A 001A", " E01000001 ", "120"), ("B 001B", "E01000002", "80"), ("footer", None, None)], "name string, code string, population string")
    geo = spark.createDataFrame([("E01000001", 2e6), ("E01000002", 1e6)], "code string, square_metres double")
    t, qa = stages.census_population(raw, geo, expected_rows=2)
    assert {r["code"]: r["density_km2"] for r in t.collect()} == {"E01000001": 60.0, "E01000002": 80.0}
    assert qa.where("status = 'fail'").count() == 0


def test_map_and_process_days(spark, tmp_path):
    rows = [("c1", "c1", 1, d, 1, 2024, "ALL", u, u) for d, u in (("2024-01-01", 2.0), ("2024-01-02", 3.0))] + [("c1", "other", 1, "2024-01-02", 1, 2024, "ALL", 1.0, 1.0), ("c9", "c1", 1, "2024-01-02", 1, 2024, "ALL", 7.0, 7.0)]
    from odweave.sources.files import FLOW_SCHEMA

    lookup = spark.createDataFrame([("c1", True, True, 5), ("c9", True, False, None)], "key string, valid boolean, in_scope boolean, area long")
    r = stages.map_records(spark.createDataFrame(rows, FLOW_SCHEMA), lookup).withColumn("origin_area", F.col("origin_area"))
    wanted = spark.createDataFrame([("2024-01-01", "s", "h"), ("2024-01-02", "s", "h")], "date string, source_signature string, schema_signature string")
    log = spark.createDataFrame([("2024-01-01", "s", "h", "v1", "true")], "date string, source_signature string, schema_signature string, processing_version string, success string")
    new = {x["date"]: x for x in stages.process_days(spark, wanted, r, log, "v1", str(tmp_path)).collect()}
    assert new["2024-01-02"]["success"] == "true" and new["2024-01-02"]["source_users"] == 4.0
    assert new["2024-01-01"]["rows"] == 1  # the log has its success, but the cache has no rows of it
    cache = DailyCache(spark, str(tmp_path), stages.CACHED)
    assert cache.valid_days() == ["2024-01-01", "2024-01-02"] and cache.version() == 1
    log = spark.createDataFrame([(d, "s", "h", "v1", "true") for d in new], log.schema)
    again = {x["date"]: x for x in stages.process_days(spark, wanted, r, log, "v1", str(tmp_path)).collect()}
    assert again["2024-01-01"]["cache_status"] != "processed" and again["2024-01-02"]["cache_status"] != "processed" and cache.version() == 1
    next(tmp_path.glob("origin/run=*/date=2024-01-02/*.parquet")).unlink()  # a lost file makes its day invalid, and only that
    assert cache.valid_days() == ["2024-01-01"]
    third = {x["date"]: x for x in stages.process_days(spark, wanted, r, log, "v1", str(tmp_path)).collect()}
    assert third["2024-01-02"]["cache_status"] == "processed" and cache.valid_days() == ["2024-01-01", "2024-01-02"]
    bad = r.withColumn("users", F.when(F.date_format("day", "dd") == "02", F.lit(-1.0)).otherwise(F.col("users")))
    failed = {x["date"]: x for x in stages.process_days(spark, wanted, bad, log, "v2", str(tmp_path)).collect()}
    assert failed["2024-01-02"]["success"] == "false" and failed["2024-01-01"]["success"] == "true"
    assert cache.read("destination", ["2024-01-02"]).agg(F.sum("users")).first()[0] == 4.0  # the old day is still there


def test_cache_commits_all_tables_or_none(spark, tmp_path):
    cache = DailyCache(spark, str(tmp_path), ("a", "b"))
    frame = lambda v: spark.createDataFrame([("2024-01-01", v), ("2024-01-03", v)], "date string, v int")
    assert cache.valid_days() == [] and cache.read("a") is None
    first = cache.stage({"a": frame(1), "b": frame(1).limit(0)})
    assert cache.read("a") is None
    cache.commit(first, ["2024-01-01", "2024-01-03"])
    with pytest.raises(ValueError):
        cache.stage({"a": frame(2)})

    broken = frame(2).select("date", F.udf(lambda v: 1 // 0, "int")("v").alias("v"))
    with pytest.raises(Exception, match="ZeroDivision"):  # dies between two tables
        cache.stage({"a": frame(2), "b": broken})
    assert {r["v"] for r in cache.read("a").collect()} == {1} and cache.valid_days() == ["2024-01-01", "2024-01-03"]
    one, two = (cache.stage({"a": frame(v), "b": frame(v)}) for v in (3, 4))
    cache.commit(one, ["2024-01-03"], seen=1)
    with pytest.raises(RuntimeError, match="committed"):
        cache.commit(two, ["2024-01-03"], seen=1)
    assert {(r["date"], r["v"]) for r in cache.read("a").collect()} == {("2024-01-01", 1), ("2024-01-03", 3)}
    cache.vacuum()
    assert cache.valid_days() == ["2024-01-01", "2024-01-03"] and len(list(tmp_path.glob("a/run=*"))) == 2


def test_run_modes(spark):
    a, r = views.areas(spark, SF), views.records(spark, SF)
    assert stages.run_monthly(spark, "provisional", a, r, views.FIRST, views.LAST).first()["observed_days"] == 30
    assert stages.run_monthly(spark, "validation", a, r, views.FIRST, views.LAST).first()["observed_days"] == 1
    assert stages.run_monthly(spark, "final", a, r, views.FIRST, date(2024, 1, 30)).first()["provisional_flag"] is False
    with pytest.raises(ValueError, match="2024-01-31"):
        stages.run_monthly(spark, "final", a, r, views.FIRST, views.LAST)


def test_master_and_checks(spark):
    base = spark.createDataFrame([("a",), ("b",)], "code string")
    mob = spark.createDataFrame([("a", 31, 31, False, 1.0), ("b", 30, 31, True, 2.0)], "code string, observed int, expected int, provisional boolean, inflow double")
    t, qa = stages.build_master(base, {"mobility": (mob, {"observed": "mobility_processed_days", "expected": "mobility_expected_days", "provisional": "mobility_provisional_flag", "inflow": "inflow"})}, "code")
    assert {r["code"]: r["mobility_coverage_status"] for r in t.collect()} == {"a": "final_complete", "b": "not_final_complete"}
    assert qa.where("status = 'fail'").count() == 0
    assert stages.column_dictionary(base, {"code": "key"}).count() == 1
    with pytest.raises(ValueError):
        stages.column_dictionary(base, {})
    with pytest.raises(ValueError):
        stages.only_candidate(["x", "y"])
    stages.reconcile_counts(t, "mobility_processed_days", {31: 1, 30: 1})
    sq = spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], 1.0)], "code string, ring array<struct<x:double,y:double>>, v double")
    assert stages.check_spatial_input(sq, "code", "ring", ["v"], 1).where("status = 'fail'").count() == 0
    v, w = views.inflow(spark, SF), views.weights(spark, SF)
    lisa = spatial.lisa(v, w, "area", "inflow", 19)
    assert stages.verify_lisa(lisa, v.count()).where("status = 'fail'").count() == 0
    assert "spark" in stages.environment(spark)
