"""Flow files, their manifest, metadata-headed CSV, JSON, and cached daily partitions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odweave.functions import scalars as S

# The columns of a flow file in their order, and the forms of file names.
FLOW_SCHEMA = T.StructType([
    T.StructField("CODE", T.StringType()), T.StructField("ORIGIN_CODE", T.StringType()), T.StructField("DAY_TYPE", T.LongType()), T.StructField("DAY", T.StringType()),
    T.StructField("MONTH", T.LongType()), T.StructField("YEAR", T.LongType()), T.StructField("MOVEMENT_MODALITY", T.StringType()),
    T.StructField("EXTRAPOLATED_NUMBER_OF_USERS", T.DoubleType()), T.StructField("EXTRAPOLATED_NUMBER_OF_SIGNALS", T.DoubleType()),
])

#: (pattern with the date as its group, type, used, why not), the first match counts.  The type of tables of another form
#: (unexpected_tsv) and of any other file (other) are this engine's own names.
FILE_KINDS = (
    (r"^Audience_Profiles_Destination_(\d{4}-\d{2}-\d{2})_loco_all_tracks\.tsv$", "daily_loco_all_tracks", True, ""),
    (r"^Audience_Profiles_Destination_(\d{4}-\d{2}-\d{2})_loco_all_tracks_0-24\.tsv$", "hourly_0_24", False, "excluded_hourly_0_24"),
    (r"^Audience_Profiles_Destination_(\d{4}-\d{2}-\d{2})_loco_pedestrian_tracks\.tsv$", "pedestrian_tracks", False, "excluded_pedestrian_tracks"),
    (r"^Audience_Profiles_Destination_(\d{4}-\d{2}-\d{2}).*\.tsv$", "unexpected_tsv", False, "unexpected_filename_pattern"),
)


def classify_name(name: Column) -> dict[str, Column]:
    """date, file_type, candidate and exclusion of a file name."""
    date, kind, used, why = F.lit(None).cast("string"), F.lit("other"), F.lit(False), F.lit("other")
    for pattern, k, u, w in reversed(FILE_KINDS):
        hit = name.rlike(pattern)
        date = F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(date)
        kind, used, why = F.when(hit, k).otherwise(kind), F.when(hit, F.lit(u)).otherwise(used), F.when(hit, w).otherwise(why)
    return {"date": date, "file_type": kind, "candidate": used, "exclusion": why}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, size, modified, date, file_type, candidate, exclusion) of a folder's files, without their content."""
    f = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return f.withColumns(classify_name(F.col("filename"))).withColumn("source_signature", S.signature(F.col("filename"), F.col("size"), F.col("modified")))


def read_flows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Typed flow records with the file they come from; columns that are not used are not parsed."""
    return spark.read.schema(FLOW_SCHEMA).option("sep", "\t").option("header", True).csv(paths).withColumn("filename", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(filename, header) - the first line of each file."""
    t = spark.read.text(paths).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return t.where("start = 0").groupBy("filename").agg(F.min_by("value", "line").alias("header"))


def scan_files(records: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Per file: rows, distinct modalities and days (sorted, joined by |), and how its header compares."""
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "|")
    r = records.groupBy("filename").agg(F.count("*").alias("row_count"), text("MOVEMENT_MODALITY").alias("movement_modality"), text("DAY").alias("day_values"))
    if heads is None:
        return r
    wanted = F.array(*(F.lit(c) for c in FLOW_SCHEMA.names))
    cols = F.split("header", "\t")
    h = heads.select(
        "filename", "header", (cols == wanted).alias("column_order_valid"), F.array_join(F.array_except(wanted, cols), "|").alias("missing_fields"), F.array_join(F.array_except(cols, wanted), "|").alias("extra_fields"),
        F.sha2(F.array_join(cols, "|"), 256).alias("schema_signature"),
    )
    return h.join(r, "filename", "left").withColumn("schema_valid", F.col("column_order_valid") & (F.col("missing_fields") == ""))


def manifest(files: DataFrame, scans: DataFrame, expected: DataFrame) -> DataFrame:
    """One row a file, and one for each expected day without a valid file.  A file is valid if its schema is, its only modality is ALL
    and its only day is its date; several valid files of a day are all invalid."""
    f = files.where("date IS NOT NULL").join(scans, "filename", "left")
    bad = F.concat_ws(
        "|", F.when(~F.coalesce("schema_valid", F.lit(False)), "invalid_schema"), F.when(~F.coalesce(F.col("movement_modality") == "ALL", F.lit(False)), "movement_modality_not_all"),
        F.when(~F.coalesce(F.col("day_values") == F.col("date"), F.lit(False)), "file_date_day_field_mismatch"),
    )
    f = f.withColumn("exclusion_reason", F.when(F.col("candidate"), bad).otherwise(F.col("exclusion"))).withColumn("valid", F.col("candidate") & (F.col("exclusion_reason") == ""))
    twice = F.col("valid") & (F.sum(F.col("valid").cast("int")).over(Window.partitionBy("date")) > 1)
    f = f.withColumns({"exclusion_reason": F.when(twice, "duplicate_valid_daily_file_for_date").otherwise(F.col("exclusion_reason")), "valid": F.col("valid") & ~twice, "_ever": F.col("valid")})
    f = f.withColumns({"exists": F.lit(True), "processing_status": F.when(F.col("valid"), "validated").otherwise("excluded")})
    gone = expected.select(F.date_format("day", "yyyy-MM-dd").alias("date")).join(f.where("_ever").select("date"), "date", "left_anti")
    gone = gone.withColumns({"file_type": F.lit("expected_daily_loco_all_tracks"), "exists": F.lit(False), "valid": F.lit(False), "exclusion_reason": F.lit("missing_required_all_tracks_file"), "processing_status": F.lit("missing")})
    return f.drop("_ever", "candidate", "exclusion").unionByName(gone, allowMissingColumns=True)


def read_headed_csv(spark: SparkSession, path: str, skip: int, names: list[str]) -> DataFrame:
    """A CSV whose data follow ``skip`` lines of notes and one header line; a byte order mark is dropped; short lines (footers) have
    null columns.  Lines are numbered within the file by their place, which the text source keeps."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("line", "value"))
    rows = t.where((F.col("line") > skip) & (F.trim("value") != ""))
    parsed = F.from_csv("value", ", ".join(f"`{n}` string" for n in names))
    return rows.select(parsed.alias("r")).select("r.*")


def metadata_value(spark: SparkSession, path: str, key: str, lines: int = 8) -> str | None:
    """The value of a quoted ``"key","value"`` or ``key: value`` line among the first lines."""
    t = spark.read.text(path).limit(lines)
    import re

    k = re.escape(key)
    r = t.select(F.regexp_extract("value", rf'^"?{k}"?\s*[:,]\s*"?([^"]*)"?', 1).alias("v")).where("v != ''").first()
    return r["v"] if r else None


def exactly_one(spark: SparkSession, pattern: str) -> str:
    """The one file that matches a glob; none or several is an error."""
    found = [r[0] for r in spark.read.format("binaryFile").load(pattern).select("path").limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} or more files match {pattern}; exactly one is needed")
    return found[0]


def read_csv(spark: SparkSession, path: str, key: str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV with a header line; types are inferred unless a schema is given; the key, which stays text, is trimmed."""
    reader = spark.read.option("header", True)
    if schema:
        t = reader.schema(schema).csv(path)
    else:
        t = reader.option("inferSchema", True).csv(path)
        if key and dict(t.dtypes)[key] != "string":  # a key with leading zeros is text
            names = ", ".join(f"`{c}` {'string' if c == key else kind}" for c, kind in t.dtypes)
            t = reader.schema(names).csv(path)
    return t.withColumn(key, S.standard_key(F.col(key))) if key else t


#: The lookup of cells: its columns when there is none yet.
CELL_LOOKUP = "h3_code string, is_valid_h3 boolean, h3_resolution int, lat double, lon double, lsoa21cd string, in_london boolean"


def read_or_empty(spark: SparkSession, path: str, schema: str = CELL_LOOKUP) -> DataFrame:
    """A stored table, or an empty one of the given columns where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_partitions(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """All Parquet files that match a glob such as ``cache/date=*/destination*.parquet``, with the day of their folder."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(pattern).withColumn("date", F.regexp_extract(F.col("_metadata.file_path"), r"date=([^/]+)/", 1))


def content_signature(spark: SparkSession, path: str) -> DataFrame:
    """(path, signature): SHA-256 of each file's bytes, on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("signature"))


def same_bytes(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two files (such as a table and its published copy) are equal byte by byte."""
    found = [r["signature"] for p in (a, b) for r in content_signature(spark, p).collect()]
    return len(found) == 2 and found[0] == found[1]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


# --- cached daily partitions ----------------------------------------------------------------


def write_daily(df: DataFrame, path: str, column: str = "date") -> None:
    """Hive layout by day; only the days in df are replaced."""
    df.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_daily(spark: SparkSession, path: str, days: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The given days of a cache (partition pruning); days that it lacks are skipped, a missing cache is empty if a schema is given."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path).where(F.col("date").isin(days))
    except AnalysisException as e:
        if schema is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def days_to_process(wanted: DataFrame, log: DataFrame, version: str) -> DataFrame:
    """Days whose cache is not valid: no successful log row of this version with the same source and schema signatures."""
    ok = log.where((F.col("processing_version") == version) & S.truthy(F.col("success"))).select("date", "source_signature", "schema_signature")
    return wanted.join(ok, ["date", "source_signature", "schema_signature"], "left_anti")


def successful_days(log: DataFrame) -> DataFrame:
    return log.where(S.truthy(F.col("success"))).select("date").distinct().orderBy("date")
