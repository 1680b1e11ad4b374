"""Geometry sources, the national grid, settings and the command line."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from odweave import cli, config
from odweave.functions import geodesy
from odweave.operators import spatial
from odweave.sources import files, geo

KIND = f"code string, v double, ring {geo.RING}"


def test_geopackage_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    rows = [("a", 1.5, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), ("b", None, [(5.0, 5.0), (6.0, 5.0), (5.0, 7.0)]), ("c", 0.0, None)]
    geo.write_geopackage(spark.createDataFrame(rows, KIND), path, "areas")
    got = {r["code"]: r for r in geo.read_geopackage(spark, path, "areas", "code string, v double").collect()}
    assert [tuple(v) for v in got["a"]["ring"]] == rows[0][2] and got["b"]["v"] is None and got["c"]["ring"] is None and got["a"]["srs"] == 27700
    geo.write_geopackage(spark.createDataFrame(rows[:1], KIND), path, "other", srs=3857)
    with pytest.raises(Exception, match="unknown reference system"):
        geo.read_geopackage(spark, path, "other", "code string").collect()
    assert geo.read_geopackage(spark, path, "other", "code string", to_grid=False).first()["srs"] == 3857


def test_multi_polygons_and_dimensions():
    ring = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    two = struct.pack("<BII", 1, 6, 2) + geo.polygon_wkb(ring) + geo.polygon_wkb([(x + 5, y) for x, y in ring])
    assert geo.parse_wkb(two) == [ring, [(5.0, 0.0), (6.0, 0.0), (5.0, 1.0)]]
    high = struct.pack(">BIII", 0, 1003, 1, 4) + struct.pack(">12d", *(c for x, y in [*ring, ring[0]] for c in (x, y, 9.0)))
    assert geo.parse_wkb(high) == [ring] and geo.parse_wkb(geo.polygon_wkb([])) == []
    with pytest.raises(ValueError):
        geo.parse_wkb(struct.pack("<BI2d", 1, 1, 0, 0))


def test_national_grid(spark):
    """The Ordnance Survey's worked example, and a known place on the other datum."""
    lat, lon = math.radians(52 + 39 / 60 + 27.2531 / 3600), math.radians(1 + 43 / 60 + 4.5177 / 3600)
    r = spark.range(1).select(geodesy.project(F.lit(lat), F.lit(lon)).alias("g")).first()["g"]
    assert r["x"] == pytest.approx(651409.903, abs=0.01) and r["y"] == pytest.approx(313177.270, abs=0.01)
    # a bridge at about 530,300 east, 179,650 north
    r = spark.range(1).select(geodesy.national_grid(F.lit(51.50100), F.lit(-0.12460)).alias("g")).first()["g"]
    assert abs(r["x"] - 530300) < 100 and abs(r["y"] - 179650) < 150


def test_rings(spark):
    bow = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]
    ell = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
    rows = [("bow", 0.0, bow), ("ell", 0.0, ell), ("line", 0.0, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), ("empty", 0.0, []), ("none", 0.0, None)]
    x, y = spatial.ring_centroid(F.col("ring"))
    t = spark.createDataFrame(rows, KIND).select("code", spatial.ring_is_valid(F.col("ring")).alias("ok"), spatial.ring_is_empty(F.col("ring")).alias("e"), x.alias("x"), y.alias("y"))
    got = {r["code"]: r for r in t.where("code != 'empty' AND code != 'none'").collect()}
    assert [got[k]["ok"] for k in ("bow", "ell", "line")] == [False, True, False]
    assert got["ell"]["x"] == pytest.approx((3 * 1.5 + 2 * 0.5) / 5) and got["line"]["x"] == pytest.approx(1.0)
    assert {r["code"]: (r["ok"], r["e"]) for r in t.select("code", "ok", "e").where("code IN ('empty', 'none')").collect()} == {"empty": (False, True), "none": (False, True)}


def test_repeated_points(spark):
    p = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0), (0.5, 0.5), (0.5, 0.5), (None, 1.0)], "x double, y double")
    a = spark.createDataFrame([("a", 0.0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], KIND)
    assert sorted(str(r["code"]) for r in spatial.points_in_polygons(p, a, 1.0, "code").collect()) == ["None", "None", "None", "a", "a"]


def test_csv_lookup_and_partitions(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,v\n 007 ,1.5\n008,2\n")
    t = files.read_csv(spark, str(tmp_path / "t.csv"), "code")
    assert [r["code"] for r in t.orderBy("v").collect()] == ["007", "008"] and dict(t.dtypes)["v"] == "double"
    assert files.read_or_empty(spark, str(tmp_path / "none")).columns[0] == "h3_code" and files.read_or_empty(spark, str(tmp_path / "none")).count() == 0
    d = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, v int")
    files.write_daily(d, str(tmp_path / "cache"))
    assert {r["date"]: r["v"] for r in files.read_partitions(spark, f"{tmp_path}/cache/date=*/*.parquet").collect()} == {"2024-01-01": 1, "2024-01-02": 2}
    (tmp_path / "u.csv").write_bytes((tmp_path / "t.csv").read_bytes())
    assert files.same_bytes(spark, str(tmp_path / "t.csv"), str(tmp_path / "u.csv"))
    (tmp_path / "u.csv").write_text("x")
    assert not files.same_bytes(spark, str(tmp_path / "t.csv"), str(tmp_path / "u.csv"))


def test_settings(tmp_path):
    s = config.Settings(inputs={"population": "p.csv"})
    s.models.trees = 20
    s.write(str(tmp_path / "s.json"))
    assert config.Settings.read(str(tmp_path / "s.json")) == s
    (tmp_path / "t.json").write_text('{"esda": {"permutation": 9}}')
    with pytest.raises(ValueError, match="settings.esda: unknown permutation"):
        config.Settings.read(str(tmp_path / "t.json"))


def test_command_line(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.normal(size=(36, 2))
    y = 1 + x @ [2.0, -1.0] + r.normal(size=36)
    (tmp_path / "d.csv").write_text("k,y,a,b\n" + "\n".join(f"{i},{y[i]},{x[i, 0]},{x[i, 1]}" for i in range(36)) + "\n")
    (tmp_path / "e.csv").write_text("i,j\n" + "\n".join(f"{i},{j}" for i in range(36) for j in range(36) if i != j and abs(i % 6 - j % 6) <= 1 and abs(i // 6 - j // 6) <= 1) + "\n")
    out = str(tmp_path / "out")
    assert cli.main(["ols", "--input-csv", str(tmp_path / "d.csv"), "--response", "y", "--baseline-predictors", "a", "--enhanced-predictors", "a", "b", "--output-dir", out]) == 0
    d = json.loads((tmp_path / "out/ols_diagnostics.json").read_text())
    assert d["enhanced_metrics"]["r2"] > d["baseline_metrics"]["r2"] and d["maximum_vif"] >= 1
    assert cli.main(["spatial", "--input-csv", str(tmp_path / "d.csv"), "--edges-csv", str(tmp_path / "e.csv"), "--key", "k", "--response", "y", "--predictors", "a", "b", "--output-dir", out]) == 0
    assert {r["model"] for r in files.read_csv(spark, f"{out}/spatial_model_comparison").collect()} == {"OLS", "SAR", "SEM"}
    with pytest.raises(SystemExit):
        cli.main(["indicators", "--mode", "validation", "--records", out, "--areas", out, "--first", "2024-01-01", "--last", "2024-01-02", "--output-dir", out])
