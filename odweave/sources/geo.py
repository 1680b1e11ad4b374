"""GeoPackage layers and well-known binary geometry as arrays of vertices.

A polygon is its outer ring, an array of (x, y) without the closing vertex; a multi-polygon gives one row a part.  Holes are not kept.
A GeoPackage is one SQLite file: a file is read by one task, several files by several.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.functions.geodesy import ring_to_grid

RING = "array<struct<x:double,y:double>>"
#: Rows that a layer written by the driver may have.
MOST_ROWS = 100_000
#: Reference systems whose coordinates are longitude and latitude, and the national grid.
GEOGRAPHIC, GRID = 4326, 27700


def parse_wkb(raw: bytes) -> list[list[tuple[float, float]]]:
    """The outer rings of a polygon or multi-polygon (two coordinates a vertex at least; others are dropped)."""

    def one(at: int) -> tuple[list[list[tuple[float, float]]], int]:
        order = "<" if raw[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", raw, at + 1)
        at += 5
        if code & 0x20000000:  # a reference system within
            at += 4
        kind, extra = (code & 0xFFFF) % 1000, ((code & 0xFFFF) // 1000 in (1, 2)) + 2 * ((code & 0xFFFF) // 1000 == 3) + bool(code & 0x80000000) + bool(code & 0x40000000)
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        if kind == 6:
            out = []
            for _ in range(n):
                rings, at = one(at)
                out += rings
            return out, at
        if kind != 3:
            raise ValueError(f"geometry type {kind} is no polygon")
        out, size = [], 2 + extra
        for k in range(n):
            (m,) = struct.unpack_from(order + "I", raw, at)
            v = struct.unpack_from(f"{order}{m * size}d", raw, at + 4)
            at += 4 + 8 * m * size
            ring = list(zip(v[::size], v[1::size], strict=True))
            if k == 0:
                out.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
        return out, at

    return one(0)[0]


def polygon_wkb(ring: list[tuple[float, float]]) -> bytes:
    closed = [*ring, ring[0]] if ring else []
    flat = [c for v in closed for c in v]
    return struct.pack("<BII", 1, 3, 1 if closed else 0) + (struct.pack(f"<I{len(flat)}d", len(closed), *flat) if closed else b"")


def read_geopackage(spark: SparkSession, path: str, layer: str, columns: str, to_grid: bool = True) -> DataFrame:
    """A layer's columns (given as a schema) with part, ring and srs.  Coordinates in degrees are projected to the national grid if
    ``to_grid``; another reference system than these two is an error."""
    names = [f.name for f in spark.createDataFrame([], columns).schema.fields]
    schema = f"{columns}, part int, ring {RING}, srs int"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for raw in rb["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(raw.as_py())
                column, srs = con.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                rows = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in [*names, column])} FROM \"{layer}\"")
                out = []
                for *values, blob in rows:
                    head = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] if blob else 0
                    rings = parse_wkb(blob[head:]) if blob else [None]
                    for part, ring in enumerate(rings or [[]]):
                        out.append({**dict(zip(names, values, strict=True)), "part": part, "ring": None if ring is None else [{"x": x, "y": y} for x, y in ring], "srs": srs})
                con.close()
                yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark.createDataFrame([], schema).schema)
    t = spark.read.format("binaryFile").load(path).select("content").mapInArrow(step, schema)
    if not to_grid:
        return t
    known = F.when(F.col("srs") == GEOGRAPHIC, ring_to_grid(F.col("ring"))).when(F.col("srs") == GRID, F.col("ring"))
    checked = F.when(F.col("srs").isin(GEOGRAPHIC, GRID), known).otherwise(F.raise_error(F.concat(F.lit("unknown reference system "), F.col("srs").cast("string"))).cast(RING))
    return t.withColumn("ring", checked).withColumn("srs", F.lit(GRID))


def write_geopackage(df: DataFrame, path: str, layer: str, ring: str = "ring", srs: int = GRID) -> None:
    """Writes a table with a ring column as a layer of a local file (added to a file that is there).  A document for people, so its
    rows are limited; large tables stay Parquet."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a layer has at most {MOST_ROWS} rows")
    names = [c for c in df.columns if c != ring]
    kinds = {"string": "TEXT", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "FLOAT"}
    types = [kinds.get(dict(df.dtypes)[c], "INTEGER") for c in names]
    con = sqlite3.connect(Path(path))
    with con:
        con.execute("PRAGMA application_id = 1196444487")
        con.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
        con.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
        con.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        con.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT, PRIMARY KEY (table_name, column_name))")
        con.execute(f'DROP TABLE IF EXISTS "{layer}"')
        con.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB{"".join(f", {chr(34)}{c}{chr(34)} {t}" for c, t in zip(names, types, strict=True))})')
        head = b"GP\x00\x01" + struct.pack("<i", srs)
        for r in rows:
            blob = None if r[ring] is None else head + polygon_wkb([(v["x"], v["y"]) for v in r[ring]])
            con.execute(f'INSERT INTO "{layer}" (geom{"".join(f", {chr(34)}{c}{chr(34)}" for c in names)}) VALUES ({", ".join("?" * (len(names) + 1))})', (blob, *(r[c] for c in names)))
        xs, ys = ([v[k] for r in rows if r[ring] for v in r[ring]] for k in ("x", "y"))
        box = (min(xs), min(ys), max(xs), max(ys)) if xs else (None,) * 4
        con.execute("INSERT OR REPLACE INTO gpkg_contents VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *box, srs))
        con.execute("INSERT OR REPLACE INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srs))
    con.close()
