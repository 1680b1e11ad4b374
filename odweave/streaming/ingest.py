"""Streaming ingestion of flow records: late data within a watermark, duplicates dropped, daily sums per destination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from odweave.functions import scalars as S
from odweave.sources.files import FLOW_SCHEMA, write_daily

FLOW_KEY = ["CODE", "ORIGIN_CODE", "DAY"]


def stream_flows(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(FLOW_SCHEMA).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def daily_inflow(flows: DataFrame, late: str = "2 days") -> DataFrame:
    """Users by destination and day; a record that repeats its key within the watermark counts once."""
    t = flows.withColumn("time", F.to_timestamp("DAY")).withWatermark("time", late).dropDuplicates([*FLOW_KEY, "time"])
    g = t.groupBy(F.window("time", "1 day"), F.col("CODE").alias("dest")).agg(F.sum("EXTRAPOLATED_NUMBER_OF_USERS").alias("users"), F.count("*").alias("records"))
    day = F.to_date("window.start")
    return g.select(F.date_format(day, "yyyy-MM-dd").alias("date"), "dest", S.is_weekend(day).alias("is_weekend"), "users", "records")


def write_stream(daily: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch replaces the days that it finishes."""
    w = daily.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write_daily(df, path))
    return (w.trigger(availableNow=True) if once else w).start()
