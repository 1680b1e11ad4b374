"""Flow files, manifests, caches, documents and the stream."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import flows, quality
from odweave.sources import files, sinks
from odweave.streaming import ingest

HEAD = "\t".join(files.FLOW_SCHEMA.names)


def flow(day, rows, modality="ALL"):
    y, m, _ = day.split("-")
    return "\n".join([HEAD, *(f"{a}\t{b}\t1\t{day}\t{m}\t{y}\t{modality}\t{u}\t{u}" for a, b, u in rows)]) + "\n"


def test_manifest(spark, tmp_path):
    n = "Audience_Profiles_Destination_{}_loco_{}.tsv"
    (tmp_path / n.format("2024-01-01", "all_tracks")).write_text(flow("2024-01-01", [("a", "b", 1.0), ("a", "c", 2.0)]))
    (tmp_path / n.format("2024-01-02", "all_tracks")).write_text(flow("2024-01-02", [("a", "b", 1.0)], "WALK"))
    (tmp_path / n.format("2024-01-02", "pedestrian_tracks")).write_text(flow("2024-01-02", [("a", "b", 1.0)]))
    (tmp_path / "notes.txt").write_text("x")
    listed = files.list_files(spark, str(tmp_path))
    tsv = f"{tmp_path}/*all_tracks.tsv"
    scans = files.scan_files(files.read_flows(spark, tsv), files.headers(spark, tsv))
    m = {(r["date"], r["file_type"]): r for r in files.manifest(listed, scans, flows.calendar(spark, date(2024, 1, 1), date(2024, 1, 3))).collect()}
    assert m["2024-01-01", "daily_loco_all_tracks"]["valid"] and m["2024-01-01", "daily_loco_all_tracks"]["row_count"] == 2
    assert m["2024-01-02", "daily_loco_all_tracks"]["exclusion_reason"] == "movement_modality_not_all"
    assert m["2024-01-02", "pedestrian_tracks"]["processing_status"] == "excluded"
    assert {k[0] for k in m if k[1].startswith("expected")} == {"2024-01-02", "2024-01-03"}
    assert len(m) == 5


def test_headed_csv_and_metadata(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿\"title\"\n\"Unit\",\"Persons\"\n" + "\n" * 5 + '"area","code","2021"\n"Camden 001A","E01000001",12\nfooter\n', encoding="utf-8")
    df = files.read_headed_csv(spark, str(p), 7, ["name", "code", "n"])
    assert df.where(S.matches(F.col("code"), r"^E010\d{5}$")).count() == 1
    assert files.metadata_value(spark, str(p), "Unit") == "Persons"
    assert files.exactly_one(spark, f"{tmp_path}/*.csv").endswith("t.csv")
    (tmp_path / "u.csv").write_text("x")
    with pytest.raises(ValueError):
        files.exactly_one(spark, f"{tmp_path}/*.csv")


def test_daily_cache(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, v int")
    path = str(tmp_path / "cache")
    files.write_daily(d, path)
    files.write_daily(spark.createDataFrame([("2024-01-02", 5)], "date string, v int"), path)
    assert sorted(r["v"] for r in files.read_daily(spark, path, ["2024-01-01", "2024-01-02", "2024-01-09"]).collect()) == [1, 5]
    assert files.read_daily(spark, str(tmp_path / "none"), ["x"], d.schema).count() == 0
    log = spark.createDataFrame([("2024-01-01", "s", "h", "v1", "True"), ("2024-01-02", "s", "h", "v0", "True")], "date string, source_signature string, schema_signature string, processing_version string, success string")
    assert [r["date"] for r in files.days_to_process(log.select("date", "source_signature", "schema_signature"), log, "v1").collect()] == ["2024-01-02"]


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.5), ("c|d", None)], "k string, v double")
    assert "| a_b | 1.500 |" in sinks.markdown(df) and r"a\_b" in sinks.latex(df)
    sinks.write_json({"a": 1}, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": 1} and files.read_json(spark, str(tmp_path / "j.json")).first()["a"] == 1
    sinks.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_gates_and_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    with pytest.raises(ValueError):
        quality.one_to_one(a, a.union(a), "k")
    with pytest.raises(ValueError):
        quality.gate(spark.createDataFrame([("m", "fail")], "metric string, status string"))
    with pytest.raises(ValueError):
        quality.require_columns(a, ["z"])


def test_cell_ids(spark):
    d = spark.createDataFrame([("8928308280fffff",), ("8928308280ffff0",), ("other",), (None,)], "c string")
    r = d.select(S.cell_is_valid(F.col("c")).alias("v"), S.cell_resolution(F.col("c")).alias("r")).collect()
    assert [x["v"] for x in r] == [True, False, False, False] and r[0]["r"] == 9


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, day in enumerate(("2024-01-01", "2024-01-06", "2024-01-20")):
        (src / f"{i}.tsv").write_text(flow(day, [("a", "b", 1.0), ("a", "b", 1.0), ("a", "c", 2.0)]))
    q = ingest.write_stream(ingest.daily_inflow(ingest.stream_flows(spark, str(src), 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r["date"]: (r["users"], r["is_weekend"]) for r in files.read_daily(spark, str(tmp_path / "out"), ["2024-01-01", "2024-01-06"]).select("date", "users", "is_weekend").withColumn("date", F.col("date").cast("string")).collect()}
    assert got == {"2024-01-01": (3.0, False), "2024-01-06": (3.0, True)}
