"""The sample tables seen as origin-destination records, areas and a per-area model frame; each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import exact, flows, spatial

WIDTH = 15
FIRST, LAST = date(2024, 1, 1), date(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flow records: origins below 60 are in scope, below 90 valid; the rest are no cells."""
    e = table(spark, sf_dir, "events")
    origin = F.get_json_object("props", "$.k").cast("int")
    r = e.select(F.col("user_id").alias("dest"), origin.alias("origin"), F.to_date("ts").alias("day"), F.col("value").alias("users"), F.lit(1.0).alias("signals"), F.col("event_type").alias("modality"))
    return r.withColumns({"in_scope": F.col("origin") < 60, "valid": F.col("origin") < 90, "origin_area": F.when(F.col("origin") < 60, F.col("origin").cast("long"))})


OD = """od AS (SELECT user_id AS dest, CAST(json_extract_string(props, '$.k') AS INTEGER) AS origin, CAST(ts AS DATE) AS day, value AS users, 1.0::DOUBLE AS signals, event_type AS modality,
  CAST(json_extract_string(props, '$.k') AS INTEGER) < 60 AS in_scope, CAST(json_extract_string(props, '$.k') AS INTEGER) < 90 AS valid, isodow(CAST(ts AS DATE)) >= 6 AS is_weekend,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 60 THEN 'in_scope_origin' WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 90 THEN 'valid_external_origin' ELSE 'other_origin' END AS origin_class FROM events)"""


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit square an area, on a lattice 15 wide."""
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("area")).distinct()
    return a.withColumns({"x": F.col("area") % WIDTH, "y": F.floor(F.col("area") / WIDTH)})


AREAS = "areas AS (SELECT DISTINCT user_id AS area, user_id % 15 AS x, user_id // 15 AS y FROM events)"
EDGES = """edges AS (SELECT a.area AS i, b.area AS j FROM areas a, areas b WHERE abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.area <> b.area),
weights AS (SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM edges)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.row_standardised(spatial.lattice_edges(areas(spark, sf_dir)))


def expected(spark: SparkSession) -> DataFrame:
    return flows.calendar(spark, FIRST, LAST)


CALENDAR = "calendar AS (SELECT CAST(d AS DATE) AS day, isodow(CAST(d AS DATE)) >= 6 AS is_weekend FROM unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS t(d))"


def inflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with their inflow, of which no digit depends on the order of rows: areas of the same records are tied."""
    return areas(spark, sf_dir).join(exact.grouped_sums(records(spark, sf_dir).withColumnRenamed("dest", "area"), ["area"], "users", "inflow"), "area", "left").fillna(0.0, ["inflow"])


INFLOW = "inflow AS (SELECT area, coalesce(sum(users), 0) AS inflow FROM areas LEFT JOIN od ON od.dest = areas.area GROUP BY area)"
ZINFLOW = "z AS (SELECT area, inflow, (inflow - avg(inflow) OVER ()) / stddev_pop(inflow) OVER () AS z FROM inflow)"


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier: log revenue, mean quantity, mean discount, mean tax, return share, and days between first and last; on a lattice."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("area")).agg(
        F.log1p(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("log_revenue"), F.avg("l_quantity").alias("quantity"), (F.avg("l_discount") * 100).alias("discount"),
        (F.avg("l_tax") * 100).alias("tax"), (F.avg((F.col("l_returnflag") == "R").cast("double")) * 10).alias("returns"), F.count("*").cast("double").alias("lines"),
    )
    return g.withColumns({"x": (F.col("area") - 1) % 10, "y": F.floor((F.col("area") - 1) / 10)})


FRAME = """frame AS (SELECT l_suppkey AS area, ln(1 + sum(l_extendedprice * (1 - l_discount))) AS log_revenue, avg(l_quantity) AS quantity, avg(l_discount) * 100 AS discount, avg(l_tax) * 100 AS tax,
  avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) * 10 AS returns, count(*)::DOUBLE AS lines, (l_suppkey - 1) % 10 AS x, floor((l_suppkey - 1) / 10)::BIGINT AS y FROM lineitem GROUP BY l_suppkey)"""
PREDICTORS = ["quantity", "discount", "tax", "returns", "lines"]


def frame_weights(frame: DataFrame) -> DataFrame:
    return spatial.row_standardised(spatial.lattice_edges(frame))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def keyed(df: DataFrame) -> DataFrame:
    """df with a text key, for the operators that clean keys."""
    return df.withColumn("code", S.standard_key(F.col("area")))


def dated(df: DataFrame) -> DataFrame:
    """Dates as text."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, t in df.dtypes if t == "date"})
