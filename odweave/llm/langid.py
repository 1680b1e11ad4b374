"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (1 to 3 bytes of the lower-cased text, other than letters
read as spaces), TF-IDF weighted and normalised.  Inverse document frequencies come from all learning rows.
Each language has several centroids, found by spherical k-means over a bounded sample of its rows
(``FIT_PER_LANG``).  The language of the centroid with the largest cosine wins.  A text is rejected if that
cosine is far below what the language's own texts show: thresholds are calibrated on sample rows that the
centroids of a first fit have not seen, by language and length (``MARGIN`` of their smallest cosine); then the
centroids are fitted on all sample rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows whose lang is
null are predicted but not learned from; repeated rows count each; without learning rows every text is
``und``; an empty table gives an empty result; texts are read whole; only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import bound_batches, expand, fold_column, squeeze, text_chunks

DIM = 4096
ORDERS = (1, 2, 3)
#: Rows of a language that centroids are fitted on at most, and centroids of a language.
FIT_PER_LANG, CENTROIDS = 500, 4
#: A text is rejected below this share of the smallest cosine of held-out sample texts of its length class.
MARGIN = 0.7
#: Sample texts that a length class needs for a threshold of its own, and what a class with fewer takes of the next one's.
SHOWN, EASE = 10, 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def lowered(col: pa.Array) -> pa.Array:
    return pa.array([(x.as_py() or "").lower() for x in col], pa.large_string())


def vectors(col: pa.Array, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, n-gram counts [rows, DIM] as float32, letters and spaces of each)."""
    for i, j, data, off in text_chunks(lowered(col), rows):
        n = j - i
        counts = np.zeros(n * DIM, np.int64)
        size = np.diff(off)
        if len(data):
            b = _CLEAN[data].astype(np.uint32)
            base = np.repeat(np.arange(n, dtype=np.int64) * DIM, size)
            h = np.zeros(len(b), np.uint32)
            left = np.repeat(off[1:], size) - np.arange(len(b))  # bytes to the end of the text
            for k in ORDERS:
                m = len(b) - k + 1
                if m <= 0:
                    break
                h = h[:m] * np.uint32(0x01000193) + b[k - 1 :] + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
                slot = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(20)).astype(np.int64) + base[:m]
                if k > 1:
                    slot = slot[left[:m] >= k]
                counts += np.bincount(slot, minlength=n * DIM)
        yield i, j, counts.reshape(n, DIM).astype(np.float32), size


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


def length_class(size: np.ndarray) -> np.ndarray:
    """0 .. 7, by powers of two from 32 bytes."""
    return np.clip(np.log2(np.maximum(size, 1)).astype(int) - 4, 0, 7)


class Model:
    """Centroids [k, DIM] with their languages, idf, and the least cosine by language and length class."""

    def __init__(self, idf: np.ndarray, langs: list[str], counts: np.ndarray, size: np.ndarray):
        """counts [rows, DIM] and size (bytes) of the sample texts, langs theirs."""
        self.idf = idf.astype(np.float32)
        self.names = sorted(set(langs))
        lang = np.array(langs, object)
        x = weighted(counts, self.idf)
        own = np.searchsorted(self.names, lang) if len(x) else np.zeros(0, int)
        rank = np.zeros(len(x), int)  # the place of a row among those of its language
        for k in range(len(self.names)):
            rank[own == k] = np.arange((own == k).sum())
        self._centres(x, own, rank % 2 == 0)
        held = rank % 2 == 1
        self.least = np.zeros((len(self.names), 8))
        cos = self.cosines(x)[np.arange(len(x)), own] if len(x) else np.zeros(0)
        cls = length_class(size)
        for k in range(len(self.names)):
            floor = 1.0
            for c in range(7, -1, -1):  # shorter texts are further away: never stricter than for longer ones
                some = held & (own == k) & (cls == c)
                floor = min([floor, *cos[some].tolist()]) if some.sum() >= SHOWN else min([floor * EASE, *cos[some].tolist()])
                self.least[k, c] = MARGIN * floor
        self._centres(x, own, np.ones(len(x), bool))

    def _centres(self, x: np.ndarray, own: np.ndarray, used: np.ndarray) -> None:
        """Several centroids of each language from the used rows (of a language with one row: that row)."""
        found = [kmeans(x[(own == k) & (used | ((own == k).sum() == 1))], CENTROIDS) for k in range(len(self.names))]
        self.owner = np.repeat(np.arange(len(found)), [len(c) for c in found])
        self.centroids = np.concatenate(found) if found else np.zeros((0, DIM), np.float32)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """The largest cosine with a centroid of each language."""
        all_ = x @ self.centroids.T
        return np.stack([all_[:, self.owner == k].max(1) for k in range(len(self.names))], 1)

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        langs, scores, rejected = [], [], []
        has = np.array([bool(_LETTER.search(t.as_py() or "")) for t in col], bool)
        for i, j, counts, size in vectors(col):
            if not self.names:
                langs += [UNKNOWN] * (j - i)
                scores.append(np.zeros(j - i))
                rejected.append(np.ones(j - i, bool))
                continue
            cos = self.cosines(weighted(counts, self.idf))
            best = cos.argmax(1)
            top = np.clip(cos[np.arange(j - i), best], 0.0, 1.0)
            far = top < self.least[best, length_class(size)]
            langs += [self.names[b] if h else UNKNOWN for b, h in zip(best, has[i:j], strict=True)]
            scores.append(np.where(has[i:j], top, 0.0))
            rejected.append(far | ~has[i:j])
        return langs, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(rejected) if rejected else np.zeros(0, bool)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds are spread by farthest-first from the row nearest the mean."""
    if not len(x):
        return np.zeros((0, DIM), np.float32)
    mean = x.mean(0)
    seeds = [int((x @ mean).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        # the median of the farther half rather than the farthest: not an outlier
        order = np.argsort(near)
        seeds.append(int(order[len(order) // 8]))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for i in range(len(c)):
            if (own == i).any():
                m = x[own == i].sum(0)
                c[i] = m / max(float(np.sqrt((m * m).sum())), 1e-12)
    return c


def inverse_frequencies(learn: DataFrame) -> np.ndarray:
    """Smoothed idf of every slot over all rows: each task sums its own, DIM rows a task are shuffled."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIM, np.int64), 0
        for rb in batches:
            for i, j, counts, _ in vectors(rb["text"]):
                total += (counts > 0).sum(0)
                rows += j - i
        if rows:
            yield pa.record_batch([pa.array(np.arange(DIM + 1)), pa.array(np.append(total, rows))], ["slot", "n"])

    got = learn.select("text").mapInArrow(step, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1)
    for r in got:
        df[r["slot"]] = r["n"]
    return np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1


def fit(docs: DataFrame, learn: Column | None = None, per_lang: int = FIT_PER_LANG) -> Model:
    """The model learned from the rows of docs where ``learn`` holds (by default all) and lang is not null."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    pick = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.lit(0.0)
    for name, n in counts.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, per_lang / n))).otherwise(rate)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, c, size in vectors(rb["text"]):
                yield pa.record_batch([rb["lang"].slice(i, j - i), pa.array(size), pa.array([squeeze(r.astype(np.uint32)) for r in c], pa.binary())], ["lang", "size", "counts"])

    # the driver gets the counts of the sample's texts, a few KB each, whatever their length
    sample = rows.where(pick < rate).limit(2 * per_lang * max(1, len(counts))).mapInArrow(step, "lang string, size long, counts binary")
    sample = sorted((r["lang"], r["size"], bytes(r["counts"])) for r in sample.collect())
    x = np.stack([expand(s[2]) for s in sample]).astype(np.float32) if sample else np.zeros((0, DIM), np.float32)
    return Model(inverse_frequencies(rows), [s[0] for s in sample], x, np.array([s[1] for s in sample], np.int64))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            langs, scores, rejected = shared.value.predict(rb["text"])
            yield pa.record_batch([rb["doc_id"].cast(pa.int64()), rb["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text", (held_out if held_out is not None else F.lit(False)).alias("held_out")).mapInArrow(step, SCHEMA)


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Predictions of all rows by a model learned from the rows whose crc32(doc_id) mod 4 is not 2."""
    held = fold_column(4) == 2
    return predict(docs, fit(docs, ~held), held)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without the rows whose language is rejected.  Only the texts go to Python, one boolean each comes back; the rows
    stay in the JVM."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.arrow_udf("boolean")
    def identified(text: pa.Array) -> pa.Array:
        return pa.array(~shared.value.predict(text)[2], pa.bool_())

    return docs.where(identified("text"))
