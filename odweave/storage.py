"""Scratch tables in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.  Unset in local mode: /tmp/checkpoints;
    unset on a cluster: an error, as a machine-local folder would lose data with its machine."""
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file:///tmp/checkpoints"
    return where.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """Writes df as Parquet in the shared scratch folder and reads it back: lineage ends here, and
    the rows survive the loss of any executor.  Columns made by Python keep random bytes, so the
    codec is a fast one."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/odweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Deletes the scratch tables that the given frames (made by stored) read."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/odweave/" in path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
