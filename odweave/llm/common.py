"""What several operators share: batch kernels over Arrow text, scratch tables,
skew-safe joins of group statistics, connected components and packed exchanges.

Words are ``[^\\x20\\x09-\\x0D]+``.  A word is identified by a 64-bit hash: a
random-table polynomial over its UTF-8 bytes, followed by a mixing step.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.operators.grouping import components, join_group
from odweave.storage import release, scratch_dir, stored

__all__ = ["components", "join_group", "release", "scratch_dir", "stored"]

#: Bytes of text that one kernel call works on at a time (a longer text is one call).
CHUNK_BYTES = 1 << 18
#: Id that stands for a null doc_id inside kernels: it sorts after every real id.
NULL_ID = np.iinfo(np.int64).max

_DELIM = np.zeros(256, bool)
_DELIM[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240131)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for reuse."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        row = np.full(size, base & (2**64 - 1), np.uint64)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts) of an Arrow string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    if not len(arr) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(arr: pa.Array, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of at most ``rows`` whole texts of about CHUNK_BYTES."""
    data, off = text_bytes(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, side="right")) - 1), n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of words of each text)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    gap = _DELIM[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | first[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each text)."""
    starts, ends, counts = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    values = _TABLE[_LOWER[data] if lower else data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse(_BASE), len(data))[starts]), counts


def gram_hashes(words: np.ndarray, k: int, base: int = _BASES[0]) -> np.ndarray:
    """Hashes of all runs of k consecutive words (runs that cross a text boundary included)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 6:
        out = words[:n].copy()
        for j in range(1, k):
            out = out * np.uint64(base) + words[j : n + j]
        return mix(out)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(inverse(base), n))


def ids_of(col: pa.Array) -> np.ndarray:
    """int64 ids, null as NULL_ID."""
    col = col.cast(pa.int64())
    return (col.fill_null(int(NULL_ID)) if col.null_count else col).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def fold_of(doc_id: int | None, n: int) -> int:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def fold_column(n: int, name: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: Bytes of an Arrow batch between the JVM and Python, unless the session sets its own bound.
BATCH_BYTES = "2m"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the memory of Arrow batches on both sides, however long the texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def repeatable(docs: DataFrame) -> DataFrame:
    """docs, whose tasks give the same rows in the same order when an executor is lost and they run again: true of scans, so an
    input with an exchange in its plan is written first."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return stored(docs, "input") if "Exchange" in plan else docs


# --- membership by bitmap ------------------------------------------------------------------

#: Bound of a broadcast bitmap: 16 MB.
MAX_BITS = 1 << 27


def bitmap_filter(rows: DataFrame, column: str, keys: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose column may be among the keys (one column, not null; keep=False: those whose is not for certain), without a shuffle of rows: a Bloom bitmap of the
    keys, of MAX_BITS bits at most whatever their number, is broadcast.  Rows that are not among them and pass are few while keys number under
    MAX_BITS / 8; a join that decides must follow."""
    count = keys.count()
    bits = min(MAX_BITS, 1 << max(15, (16 * max(count, 1) - 1).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)) + 1
    hit = keys.select(slot(keys.columns[0]).alias("s"))
    bitmap = stored(hit.groupBy(F.bitmap_bucket_number("s").alias("_bf_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bf_m")), "bitmap")
    names = rows.columns
    rows = rows.withColumns({"_bf_b": F.bitmap_bucket_number(slot(column)), "_bf_p": F.bitmap_bit_position(slot(column))}).join(F.broadcast(bitmap), "_bf_b", "inner" if keep else "left")
    byte = F.conv(F.hex(F.substring(F.col("_bf_m"), (F.col("_bf_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    among = F.getbit(byte, (F.col("_bf_p") % 8).cast("int")) == 1
    return rows.where(among if keep else ~F.coalesce(among, F.lit(False))).select(*names)


# --- packed exchange ------------------------------------------------------------------------
#
# Hundreds of millions of small keys cost far less as a few thousand sorted arrays than as rows.
# A batch (a few million keys of consecutive rows of one task) sends its distinct keys, cut by
# the leading bits into buckets; a bucket's reducer merges the arrays of all batches and answers
# each batch in its own key order; the batch's state, which went along, meets the answers.

PACKED = "batch string, bucket int, part int, state binary, payload binary"


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as byte planes, compressed."""
    import zstandard

    width = a.dtype.itemsize
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width)
    return zstandard.ZstdCompressor(level=1).compress(a.dtype.str.encode().ljust(4) + np.ascontiguousarray(raw.T).tobytes())


def expand(b: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    kind = np.dtype(raw[:4].decode().strip())
    planes = np.frombuffer(raw, np.uint8, offset=4)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """A sorted uint64 array: differences have fewer random bytes."""
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b), dtype=np.uint64)


def pack(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return head + b"".join(parts)


def parts_of(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    size = np.frombuffer(raw, np.int64, n, 8)
    edge = 8 * (n + 1) + np.concatenate(([0], np.cumsum(size)))
    return [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Positions that cut sorted uint64 keys into n buckets of equal key ranges."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def packed_exchange(
    sent: DataFrame, n_buckets: int, reduce: Callable[[list[bytes]], list[bytes]], n_parts: int
) -> DataFrame:
    """sent: PACKED rows; bucket -1 carries a batch's state, the others its slices; batch begins with its task's and its own
    number.  Gives the
    state rows unchanged and for every slice reduce()'s answer as payload, dealt by batch and
    sorted by (batch, bucket)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, bytes]] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                for (batch, bucket, _), out in zip(held, reduce([h[2] for h in held]), strict=True):
                    yield packed_batch([(batch, bucket, 0, None, out)])
            held.clear()

        for rb in batches:
            for i in range(rb.num_rows):
                bucket = rb["bucket"][i].as_py()
                if bucket < 0:
                    yield rb.slice(i, 1)
                    continue
                if bucket != now:
                    yield from flush()
                    now = bucket
                held.append((rb["batch"][i].as_py(), bucket, rb["payload"][i].as_py()))
        yield from flush()

    answers = by_bucket(sent, n_parts).sortWithinPartitions("bucket").mapInArrow(step, PACKED)
    task, number = (F.split_part("batch", F.lit("-"), F.lit(i)).cast("long") for i in (1, 2))
    place = F.pmod(task + number * F.lit(int(0.618 * n_parts) + 1), F.lit(n_parts)).cast("int")  # a task's batches apart
    return answers.repartitionById(n_parts, place).sortWithinPartitions("batch", "bucket", "part")


def by_bucket(sent: DataFrame, n_parts: int) -> DataFrame:
    """PACKED rows with each bucket in a partition of its own (for at most n_parts buckets), states spread over all."""
    spread = F.pmod(F.xxhash64("batch", "payload"), F.lit(n_parts)).cast("int")
    return sent.repartitionById(n_parts, F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(spread))


PACKED_ARROW = pa.schema([("batch", pa.string()), ("bucket", pa.int32()), ("part", pa.int32()), ("state", pa.binary()), ("payload", pa.binary())])


def packed_batch(rows: list[tuple[str, int, int, bytes | None, bytes | None]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows), PACKED_ARROW, strict=True)], schema=PACKED_ARROW)


def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], list[bytes]]]:
    """(batch, its states, its answers in bucket order) of packed_exchange()'s rows."""
    now, states, answers = None, [], []
    for rb in batches:
        for i in range(rb.num_rows):
            name = rb["batch"][i].as_py()
            if name != now:
                if now is not None:
                    yield now, states, answers
                now, states, answers = name, [], []
            if rb["bucket"][i].as_py() < 0:
                states.append(rb["state"][i].as_py())
            else:
                answers.append(rb["payload"][i].as_py())
    if now is not None:
        yield now, states, answers


def text_size(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text) in one pass without Python."""
    r = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return r["n"], r["b"] or 0
