"""Substring dedup with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words.  A word goes if a window that covers it also starts in a document
with a smaller doc_id.

Index.  Of the hashes of a window's runs of WINDOW // 2 + 1 words the least is its fingerprint: equal windows
have equal fingerprints, and neighbouring windows mostly share theirs, so a text has about one fingerprint
every 13 words.  A batch of documents becomes an immutable run of (fingerprint, doc_id), a table bucketed and sorted by
fingerprint; it is merge-joined with the runs of the documents before it (no exchange: all runs have the same buckets),
which gives the fingerprints that occur in several documents; runs of a level are compacted into one of the next.
Rows of frequent fingerprints (under ``HOT_GROUPS`` a run) stay as they come, in a table beside it, so no bucket is hot.

Increments.  An index with a path outlives its session: its runs also hold the window hashes of every fingerprint, so a
new batch is judged by the runs alone, without the old texts.  Documents of batches before count as smaller
whatever their doc_id.  ``dedup`` answers for a batch, ``commit`` publishes its runs in a new manifest; an aborted
batch leaves the manifest before it, whose runs are deleted by the next commit only.

Verification.  Windows whose fingerprint was hit are compared themselves: by 96 bits of two independent
hashes of their words, over all documents, keeping the smallest doc_id of each.  Window hashes travel
as sorted arrays (see common.packed_exchange); a batch sends each distinct window once, so a passage that a third of
all documents hold is one entry a batch.  The set of hit fingerprints is broadcast as a bitmap of at most
``MAX_BITS`` bits, where false positives cost only comparisons; when there are too many for it, each document gets
its own list by a join.  Nothing is capped: the result is exact up to 96-bit collisions.

Defined cases: null and empty texts, and those with fewer words than a window, keep all (an empty text's digest is
that of the empty string); a null doc_id counts as larger than any; rows that repeat a doc_id do not remove each
other's words; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm.common import (
    _BASES,
    NULL_ID,
    PACKED,
    bound_batches,
    bucket_bounds,
    by_batch,
    expand,
    expand_sorted,
    gram_hashes,
    ids_of,
    mix,
    pack,
    packed_batch,
    packed_exchange,
    parts_of,
    release,
    repeatable,
    scratch_dir,
    squeeze,
    squeeze_sorted,
    stored,
    text_chunks,
    text_size,
    word_hashes,
)

WINDOW = 50
MAX_BITS, BITS_PER_KEY = 1 << 27, 12
#: Windows of a batch of the packed exchange, about, and of a bucket.
BATCH_WINDOWS, BUCKET_WINDOWS = 500_000, 1_000_000
#: A fingerprint with more than 1/HOT_GROUPS of a run's rows (and LEAST_HOT) is frequent; slots that counts are taken in first.
HOT_GROUPS, LEAST_HOT, SLOTS = 1024, 1000, 1 << 16
#: What stands for a document of an earlier batch: it sorts before every doc_id.
EARLIER = np.iinfo(np.int64).min
#: The 96 bits of a window.
WINDOW_BITS = np.dtype([("a", "<u8"), ("b", "<u4")])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    size, out = 1, x
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1]) if size < w else out


def window_prints(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of each window's first word, its text's row, its fingerprint)."""
    k = window // 2 + 1
    if len(words) < window:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    prints = sliding_min(gram_hashes(words, k), window - k + 1)
    edge = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)[: len(prints)]
    inside = np.arange(len(prints)) + window <= edge[row]
    at = np.flatnonzero(inside)
    return at, row[at], prints[at]


def window_bits(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (64 and 32 bits) of the windows that start at the given words."""
    return gram_hashes(words, window, _BASES[0])[at], (gram_hashes(mix(words), window, _BASES[1])[at] >> np.uint64(32)).astype(np.uint32)


def fingerprints(docs: DataFrame, window: int = WINDOW, with_windows: bool = False) -> DataFrame:
    """(fp, doc_id): the distinct fingerprints of neighbouring windows of each document; with_windows adds the hashes of
    the neighbouring windows that share the fingerprint (WINDOW_BITS each)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids = ids_of(rb["doc_id"])
            for i, _, data, off in text_chunks(rb["text"]):
                words, counts = word_hashes(data, off, lower=False)
                at, row, fp = window_prints(words, counts, window)
                if len(fp):
                    new = np.ones(len(fp), bool)
                    new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
                    out = [pa.array(fp[new].view(np.int64)), pa.array(ids[i + row[new]])]
                    if with_windows:
                        bits = np.empty(len(at), WINDOW_BITS)
                        bits["a"], bits["b"] = window_bits(words, at, window)
                        edge = np.append(np.flatnonzero(new), len(at)).astype(np.int32) * WINDOW_BITS.itemsize
                        out.append(pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(bits)]))
                    yield pa.record_batch(out, ["fp", "doc_id", "windows"][: len(out)])

    return docs.select("doc_id", "text").mapInArrow(step, "fp long, doc_id long" + (", windows binary" if with_windows else ""))


@dataclass
class Run:
    """An immutable run: its number of rows, the folder of the rows sorted by fp in buckets, that of the rows of frequent fps, and
    these fps (fewer than HOT_GROUPS)."""

    size: int
    cold: str
    hot: str | None
    frequent: list[int]

    def count(self) -> int:
        return self.size


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of buckets with one file know their order, so merge joins of runs need no sort."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class FingerprintIndex:
    """Runs with their levels, in the scratch folder or, where a path is given, in that folder with a manifest."""

    def __init__(self, path: str | None = None, window: int = WINDOW):
        self.path, self.window = path and path.rstrip("/"), window
        self.runs: list[tuple[int, Run]] = []
        self.buckets = self.serial = 0
        self.stale: list[Run] = []
        self._tables: dict[str, str] = {}

    # --- storage

    @classmethod
    def open(cls, spark: SparkSession, path: str, window: int = WINDOW) -> FingerprintIndex:
        """The index of a folder at its last commit; an empty one where nothing was committed."""
        index = cls(path, window)
        versions = [int(p.getPath().getParent().getName().split("-")[1]) for p in index._fs(spark)[0].globStatus(index._hadoop(spark, f"{index.path}/manifest-*/_SUCCESS")) or ()]
        if versions:
            index.serial = max(versions)
            m = json.loads(spark.read.text(f"{index.path}/manifest-{index.serial}").first()[0])
            if m["window"] != window:
                raise ValueError(f"the index has windows of {m['window']} words, not {window}")
            index.buckets, index.runs = m["buckets"], [(k, Run(**r)) for k, r in m["runs"]]
        return index

    def commit(self, spark: SparkSession) -> None:
        """Publishes the runs of the batches since the last commit, then deletes those that were compacted."""
        if self.path:
            m = json.dumps({"window": self.window, "buckets": self.buckets, "runs": [(k, asdict(r)) for k, r in self.runs]})
            spark.createDataFrame([(m,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.serial}")
        self._delete(spark, self.stale)
        self.stale = []

    def drop(self, spark: SparkSession) -> None:
        """Deletes all runs."""
        self._delete(spark, [*self.stale, *(r for _, r in self.runs)])
        self.runs, self.stale = [], []

    @staticmethod
    def _hadoop(spark: SparkSession, path: str):  # noqa: ANN205
        return spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, spark: SparkSession, path: str | None = None) -> tuple:
        p = self._hadoop(spark, path or self.path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, spark: SparkSession, runs: list[Run]) -> None:
        for folder in [f for r in runs for f in (r.cold, r.hot) if f]:
            if folder in self._tables:
                spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(folder)}")
            fs, p = self._fs(spark, folder)
            fs.delete(p, True)

    def _cold(self, spark: SparkSession, run: Run) -> DataFrame:
        """The sorted rows of a run, as a bucketed table of the session."""
        if run.cold not in self._tables:
            name = f"odweave_run_{uuid.uuid4().hex}"
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(run.cold).schema)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{run.cold}'")
            self._tables[run.cold] = name
        return spark.table(self._tables[run.cold])

    def _rows(self, spark: SparkSession, run: Run) -> DataFrame:
        cold = self._cold(spark, run)
        return cold.unionByName(spark.read.schema(cold.schema).parquet(run.hot)) if run.hot else cold

    def _run(self, rows: DataFrame) -> Run:
        spark, size = rows.sparkSession, rows.count()
        self.buckets = self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        frequent = _frequent(rows, size)
        name, root = f"odweave_run_{uuid.uuid4().hex}", self.path or f"{scratch_dir(spark)}/odweave"
        run = Run(size, f"{root}/run-{name[-32:]}", f"{root}/hot-{name[-32:]}" if frequent else None, frequent)
        hot = F.col("fp").isin(frequent)
        cold = (rows.where(~hot) if frequent else rows).repartition(self.buckets, "fp").sortWithinPartitions("fp")
        cold.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", run.cold).option("compression", "lz4").format("parquet").saveAsTable(name)
        self._tables[run.cold] = name
        if frequent:
            rows.where(hot).write.option("compression", "lz4").parquet(run.hot)
        return run

    # --- the log-structured part

    def compact(self, spark: SparkSession | None = None) -> None:
        """Merges runs of the same level until every level has one at most."""
        spark = spark or SparkSession.getActiveSession()
        while True:
            levels = [k for k, _ in self.runs]
            twice = next((k for k in levels if levels.count(k) > 1), None)
            if twice is None:
                return
            old = [r for k, r in self.runs if k == twice]
            merged = self._rows(spark, old[0])
            for r in old[1:]:
                merged = merged.unionByName(self._rows(spark, r))
            self.runs = [(k, r) for k, r in self.runs if k != twice] + [(twice + 1, self._run(merged))]
            if self.path:
                self.stale += old  # the last manifest names them
            else:
                self._delete(spark, old)

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of (fp, doc_id) as a run.  Gives, stored, the fingerprints of the batch that another document,
        of the batch or of an earlier one, has too."""
        spark = batch.sparkSession
        self.compact(spark)
        new = self._run(batch)
        cold = self._cold(spark, new).select("fp", "doc_id")
        several = lambda rows: rows.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("fp")
        hits = several(cold)
        if new.hot:
            hits = hits.unionByName(several(spark.read.parquet(new.hot).select("fp", "doc_id")))
        for _, old in self.runs:
            before = self._cold(spark, old).select("fp")
            hits = hits.unionByName(before.join(cold.select("fp").hint("merge"), "fp", "left_semi"))
            if new.frequent:
                hits = hits.unionByName(before.where(F.col("fp").isin(new.frequent)))
            if old.frequent:
                hits = hits.unionByName(cold.select("fp").where(F.col("fp").isin(old.frequent)))
            both = sorted(set(new.frequent) & set(old.frequent))
            if both:
                hits = hits.unionByName(spark.createDataFrame([(f,) for f in both], "fp long"))
        self.runs.append((0, new))
        with _sorted_buckets(spark):
            return stored(hits.distinct(), "hits")

    def _earlier(self, hits: DataFrame) -> DataFrame:
        """Stored, the windows of hit fingerprints in batches before the present one: from the runs, whose buckets stay where they are."""
        spark, out = hits.sparkSession, None
        for _, run in self.runs:
            got = self._cold(spark, run).where(F.col("serial") < self.serial).join(hits.hint("merge"), "fp", "left_semi")
            if run.hot:
                among = [r["fp"] for r in hits.where(F.col("fp").isin(run.frequent)).collect()]
                got = got.unionByName(spark.read.parquet(run.hot).where((F.col("serial") < self.serial) & F.col("fp").isin(among)))
            out = got if out is None else out.unionByName(got)
        with _sorted_buckets(spark):
            return stored(out.select("windows"), "earlier")

    def dedup(self, docs: DataFrame, batches: int = 4, keep_text: bool = True) -> DataFrame:
        """dedup() of a batch of documents against each other and against all batches before.  With a path the answer holds
        while the batch is not committed twice: write it, then commit()."""
        spark = docs.sparkSession
        bound_batches(spark)
        kept = self.path is not None
        history = bool(self.runs)
        self.serial += 1
        prints = fingerprints(docs, self.window, kept)
        if kept:
            prints = prints.withColumn("serial", F.lit(self.serial))
        cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
        number = F.lit(0)
        for c in cuts:
            number = number + (F.col("doc_id") > c).cast("int")
        prints, hits = stored(prints.withColumn("batch", number), "prints"), None
        for i in range(len(cuts) + 1):
            got = self.add(prints.where(F.col("batch") == i).drop("batch"))
            hits = got if hits is None else hits.unionByName(got)
        hits = stored(hits.distinct(), "hits")
        count = hits.count()
        release(prints)
        return _compare(docs, hits, count, self.window, keep_text, self._earlier(hits) if kept and history and count else None)


def _frequent(rows: DataFrame, size: int) -> list[int]:
    """The fingerprints (fewer than HOT_GROUPS) with a large share of the rows.  Counts of SLOTS slots leave few candidates; this decides
    where rows are kept, never what is found."""
    least = max(LEAST_HOT, size // HOT_GROUPS + 1)
    slot = F.pmod("fp", F.lit(SLOTS))
    slots = [r["s"] for r in rows.groupBy(slot.alias("s")).count().where(F.col("count") >= least).select("s").collect()]
    return sorted(r["fp"] for r in rows.where(slot.isin(slots)).groupBy("fp").count().where(F.col("count") >= least).select("fp").collect()) if slots else []


def hit_bitmap(hits: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """Bloom bitmap (two positions a fingerprint); at most MAX_BITS bits are collected."""
    bits = min(MAX_BITS, 1 << max(15, (BITS_PER_KEY * max(count, 1) - 1).bit_length()))
    slots = hits.select(F.explode(F.array(F.pmod("fp", F.lit(bits)), F.pmod(F.shiftrightunsigned("fp", 32), F.lit(bits)))).alias("p")).select((F.col("p") + 1).alias("p"))
    rows = slots.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[: bits // 8]
    return bits, out


def _in_bitmap(fp: np.ndarray, bits: int, bitmap: np.ndarray) -> np.ndarray:
    out = np.ones(len(fp), bool)
    for p in (fp & np.uint64(bits - 1), (fp >> np.uint64(32)) & np.uint64(bits - 1)):
        out &= (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _least_owner(slices: list[bytes]) -> list[bytes]:
    """Of every window of a bucket the smallest doc_id, answered in each slice's order."""
    parts = [_unpack(s) for s in slices]
    a, b, d = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((d, b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.empty(len(a), np.int64)
    least[order] = d[order][first][np.cumsum(first) - 1]
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [squeeze(x) for x in np.split(least, cuts)]


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, d = parts_of(raw)
    return expand_sorted(a), expand(b), expand(d)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


#: Ends the names of exchange batches that come from the runs of the index.
FROM_RUNS = "-earlier"
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _compare(docs: DataFrame, hits: DataFrame, count: int, window: int, keep_text: bool, earlier: DataFrame | None = None) -> DataFrame:
    """Verifies hit windows and removes what an earlier document, or one of the earlier windows, has."""
    spark = docs.sparkSession
    _, size = text_size(docs)
    n_buckets = n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // 4 // BUCKET_WINDOWS)
    shared = None
    if count * BITS_PER_KEY <= 2 * MAX_BITS:
        shared = spark.sparkContext.broadcast(hit_bitmap(hits, count))
        source = docs.select("doc_id", "text")
    else:
        own = fingerprints(docs, window).join(hits, "fp", "left_semi").groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
        source = docs.select(F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("doc_id"), "text").join(own, "doc_id", "left")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: dict[str, list] = {}
        number = 0

        def reset() -> None:
            held.update(done=[], ids=[], texts=[], per=[], starts=[], a=[], b=[], d=[], n=[0])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            a, b, d = (np.concatenate(held[x]) if held[x] else np.zeros(0, t) for x, t in (("a", np.uint64), ("b", np.uint32), ("d", np.int64)))
            order = np.lexsort((d, b, a))
            a, b, d = a[order], b[order], d[order]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            key = np.empty(len(a), np.int32)
            key[order] = np.cumsum(first) - 1
            a, b, d = a[first], b[first], d[first]
            z = zstandard.ZstdCompressor(level=1)
            starts = np.concatenate(held["starts"]) if held["starts"] else np.zeros(0, np.int32)
            lens = np.array([len(t) for t in held["texts"]], np.int64)
            done = "\n".join(held["done"]).encode()
            state = pack(
                z.compress(done), squeeze(np.array(held["ids"], np.int64)), squeeze(lens), z.compress(b"".join(held["texts"])),
                squeeze(np.array(held["per"], np.int64)), squeeze(np.diff(starts, prepend=np.int32(0)).astype(np.int32)), squeeze(key),
            )
            name = f"{task}-{number}-{hashlib.md5(done + str(held['ids']).encode()).hexdigest()[:12]}"
            number += 1
            yield packed_batch([(name, -1, 0, state, None)])
            edge = bucket_bounds(a, n_buckets)
            for i, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if y > x:
                    yield packed_batch([(name, i, 0, None, pack(squeeze_sorted(a[x:y]), squeeze(b[x:y]), squeeze(d[x:y])))])
            reset()

        reset()
        for rb in batches:
            ids = ids_of(rb["doc_id"])
            own = rb["fps"] if shared is None else None
            for i, j, data, off in text_chunks(rb["text"]):
                words, counts = word_hashes(data, off, lower=False)
                at, row, fp = window_prints(words, counts, window)
                if shared is not None:
                    hit = _in_bitmap(fp, *shared.value)
                else:
                    hit = np.zeros(len(fp), bool)
                    for r in np.unique(row):
                        mine = own[i + int(r)].as_py()
                        if mine:
                            some = row == r
                            hit[some] = np.isin(fp[some], np.array(mine, np.int64).view(np.uint64))
                at, row = at[hit], row[hit]
                edge = np.concatenate(([0], np.cumsum(counts)))
                raw = data.tobytes()
                per = np.bincount(row, minlength=j - i)
                if len(at):
                    a, b = window_bits(words, at, window)
                    held["a"].append(a)
                    held["b"].append(b)
                    held["d"].append(ids[i + row])
                    held["starts"].append((at - edge[row]).astype(np.int32))
                    held["n"][0] += len(at)
                for r in range(j - i):
                    text = raw[off[r] : off[r + 1]]
                    if per[r]:
                        held["ids"].append(int(ids[i + r]))
                        held["texts"].append(text)
                        held["per"].append(int(per[r]))
                    else:
                        w = text.split()
                        held["done"].append(f"{ids[i + r]} {len(w)} {_digest(w)}")
                        if keep_text:
                            held["done"][-1] += " " + b" ".join(w).decode()
                if held["n"][0] >= BATCH_WINDOWS:
                    yield from flush()
        if held["done"] or held["ids"]:
            yield from flush()

    def send_earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            bits = np.unique(np.concatenate([np.frombuffer(x, WINDOW_BITS) for x in held]))
            edge = bucket_bounds(bits["a"], n_buckets)
            for i, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if y > x:
                    payload = pack(squeeze_sorted(bits["a"][x:y]), squeeze(bits["b"][x:y]), squeeze(np.full(y - x, EARLIER)))
                    yield packed_batch([(f"{task}-{number}{FROM_RUNS}", i, 0, None, payload)])

        for rb in batches:
            for x in rb["windows"]:
                held.append(x.as_py())
                size += len(held[-1]) // WINDOW_BITS.itemsize
                if size >= BATCH_WINDOWS:
                    yield from flush()
                    number, held, size = number + 1, [], 0
        if size:
            yield from flush()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for name, states, answers in by_batch(batches):
            if name.endswith(FROM_RUNS):
                continue  # windows of the index ask nothing
            if len(states) != 1:
                raise RuntimeError(f"batch {name} met {len(states)} states")  # cannot happen: see repeatable()
            done, ids, lens, texts, per, starts, key = parts_of(states[0])
            out: list[tuple] = []
            for line in filter(None, z.decompress(done).decode().split("\n")):
                f = line.split(" ", 3)
                out.append((int(f[0]), int(f[1]), 0, f[2], (f[3] if len(f) > 3 else "") if keep_text else None))
            ids, lens, per, key = expand(ids), expand(lens), expand(per), expand(key)
            starts = np.cumsum(expand(starts), dtype=np.int64)
            least = np.concatenate([expand(x) for x in answers]) if answers else np.zeros(0, np.int64)
            texts = z.decompress(texts)
            t0 = w0 = 0
            for doc, size, n in zip(ids, lens, per, strict=True):
                words = texts[t0 : t0 + size].split()
                gone = starts[w0 : w0 + n][least[key[w0 : w0 + n]] < doc]
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = [w for w, k in zip(words, keep, strict=True) if k] if len(gone) else words
                out.append((int(doc), len(words), len(words) - len(kept), _digest(kept), b" ".join(kept).decode() if keep_text else None))
                t0, w0 = t0 + int(size), w0 + int(n)
            for k in range(0, len(out), 4096):
                c = list(zip(*out[k : k + 4096], strict=True))
                d = np.array(c[0], np.int64)
                yield pa.record_batch([pa.array(d, mask=d == NULL_ID), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    sent = repeatable(source).mapInArrow(send, PACKED)
    if earlier is not None:
        sent = sent.unionByName(earlier.mapInArrow(send_earlier, PACKED))
    return packed_exchange(sent, n_buckets, _least_owner, n_parts).mapInArrow(finish, SCHEMA)


def dedup(docs: DataFrame, window: int = WINDOW, batches: int = 4, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; kept is the text that is left, its words
    joined by one space (null unless keep_text).  The documents enter the index in ``batches`` batches in order of doc_id."""
    index = FingerprintIndex(None, window)
    out = index.dedup(docs, batches, keep_text)
    index.drop(docs.sparkSession)  # the answer reads documents and hits alone
    return out


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return dedup(docs, window, keep_text=False).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
own AS (SELECT k, min(doc_id) AS o FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN own USING (k), unnest(range(i, i + 50)) AS t(p) WHERE o < doc_id),
words AS (SELECT w.doc_id, t.p, ws[t.p] AS word, g.p IS NOT NULL AS out FROM w CROSS JOIN unnest(range(1, len(ws) + 1)) AS t(p) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = t.p)
SELECT w.doc_id, len(any_value(w.ws))::BIGINT AS n_words, count(*) FILTER (out) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (NOT out), '')) AS kept_sha256
FROM w LEFT JOIN words x ON x.doc_id = w.doc_id GROUP BY w.doc_id
"""
