"""A cache of several tables by day that is never half written.

Every run writes its days of all tables to folders of their own, which nothing reads yet.  A commit is one new manifest - (date, table,
run, rows, digest) of every valid day - that is written aside and renamed to the next number: a run that dies before leaves
the old days, and of two commits at once one fails.  A digest is the sum of the hashes of a day's rows, so it does not depend on files or
order; a day is valid while what is there has the manifest's rows and digest in all tables.

Folders may be on any file system whose rename of a folder is atomic (HDFS, local).  Days are few (a row each in the driver); their rows are not
collected.  Runs that no manifest needs stay until ``vacuum``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "date string, table string, run string, rows long, digest string"


class DailyCache:
    def __init__(self, spark: SparkSession, folder: str, tables: tuple[str, ...]):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables

    def _path(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        p, fs = self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """Number of the last commit, 0 before the first."""
        return max([0, *(int(n[1:]) for n in self._names("_manifest") if re.fullmatch(r"v\d+", n))])

    def manifest(self, version: int | None = None) -> list[tuple[str, str, str, int, str]]:
        v = self.version() if version is None else version
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/_manifest/v{v}").collect()] if v else []

    def stage(self, frames: dict[str, DataFrame]) -> str:
        """Writes the frames (all tables, each with a string column date) aside, and gives the run's name for commit()."""
        if set(frames) != set(self.tables):
            raise ValueError(f"tables {sorted(frames)}, not {sorted(self.tables)}")
        run = uuid.uuid4().hex
        for name, df in frames.items():
            df.repartition("date").write.partitionBy("date").parquet(f"{self.folder}/{name}/run={run}")
        return run

    def commit(self, run: str, days: list[str], seen: int | None = None) -> int:
        """The staged days become the valid ones, all at once; other days stay.  ``seen``: the version that the caller has read (the last, if none): a
        commit on top of another one is an error.  The new version's number."""
        seen = self.version() if seen is None else seen
        found = {(d, t): (n, h) for t in self.tables for d, n, h in self._digests(t, {run: days})}
        rows = [r for r in self.manifest(seen) if r[0] not in set(days)] + [(d, t, run, *found.get((d, t), (0, "0"))) for d in days for t in self.tables]
        aside, fs = self._path(f"_manifest/aside-{run}")
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(str(aside))
        to, _ = self._path(f"_manifest/v{seen + 1}")
        if fs.exists(to) or not fs.rename(aside, to):
            raise RuntimeError(f"another run has committed version {seen + 1}")
        return seen + 1

    def read_run(self, table: str, runs: dict[str, list[str]]) -> DataFrame | None:
        """The given days of runs of a table; None where none of them has rows."""
        paths = [f"{self.folder}/{table}/run={run}/date={d}" for run, days in runs.items() if (there := {n.removeprefix("date=") for n in self._names(f"{table}/run={run}")}) for d in days if d in there]
        if not paths:
            return None
        df = self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*paths).drop("run")
        return df.withColumn("date", F.col("date").cast("string"))

    def _runs(self, table: str, days: list[str] | None = None) -> dict[str, list[str]]:
        runs: dict[str, list[str]] = {}
        for d, t, run, n, _ in self.manifest():
            if t == table and n and (days is None or d in days):
                runs.setdefault(run, []).append(d)
        return runs

    def read(self, table: str, days: list[str] | None = None) -> DataFrame | None:
        """The committed days of a table (only those asked for); None where none has rows."""
        return self.read_run(table, self._runs(table, days))

    def _digests(self, table: str, runs: dict[str, list[str]]) -> list[tuple[str, int, str]]:
        df = self.read_run(table, runs)
        if df is None:
            return []
        h = F.xxhash64(*(F.col(c) for c in sorted(df.columns))).cast("decimal(20,0)")
        return [tuple(r) for r in df.groupBy("date").agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("digest")).collect()]

    def valid_days(self) -> list[str]:
        """The committed days whose rows are all there, in all tables."""
        there = {(d, t): (n, h) for t in self.tables for d, n, h in self._digests(t, self._runs(t))}
        wrong = {d for d, t, _, n, h in self.manifest() if there.get((d, t), (0, "0")) != (n, h)}
        return sorted({r[0] for r in self.manifest()} - wrong)

    def vacuum(self) -> None:
        """Deletes the runs that the last manifest does not name.  Not while another run stages."""
        used = {r[2] for r in self.manifest()}
        for t in self.tables:
            for n in self._names(t):
                if n.removeprefix("run=") not in used:
                    p, fs = self._path(f"{t}/{n}")
                    fs.delete(p, True)
