"""Language-model scoring by deleted interpolation.

A token's probability mixes maximum-likelihood estimates of the bigram, of the unigram, and the uniform distribution over
the vocabulary and one unknown token:

    P(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1)

The weights depend on the frequency bucket of the context v (powers of two; contexts never seen are a bucket, where
l2 = 0).  They are learned by expectation-maximisation on deleted counts: a share of the learning documents is held
out, the estimates come from the others, and the weights maximise the likelihood of the held-out tokens.  Those events
enter as exact counts over classes of eighths of an octave of their estimates, a table of bounded size.  The final
counts are those of all learning documents.

Nothing of the model is broadcast or collected except totals and weights.  Counts travel as sorted arrays (see
common.packed_exchange): every batch sends its distinct tokens and bigrams once and gets their corpus counts back.

Defined cases: a null text is an empty text, whose only token is the end; a null doc_id is hashed as empty text; repeated rows
count each; without learning documents N = V = 0 and all scores are 0 (of one unknown token, which is certain); an empty table gives an empty result; texts are read whole;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import (
    NULL_ID,
    PACKED,
    bound_batches,
    bucket_bounds,
    by_batch,
    expand,
    expand_sorted,
    fold_of,
    ids_of,
    mix,
    pack,
    packed_batch,
    packed_exchange,
    parts_of,
    repeatable,
    squeeze,
    squeeze_sorted,
    stored,
    text_chunks,
    text_size,
    word_hashes,
)

#: Tokens of a batch, and distinct keys of a bucket, about.
BATCH_TOKENS, BUCKET_KEYS = 2_000_000, 1_500_000
#: Of the learning documents, those whose crc32 // 7 mod HELD is 3 are held out for the weights.
FOLD, HELD = 7, 8
END, START = np.uint64(0x51AB3C0D9E7F1122), np.uint64(0x1F83D9ABFB41BD6B)
BUCKETS = 26
STEPS = 8
_P2, _P1 = 512, 512


def is_learning(doc_id: int | None) -> bool:
    return fold_of(doc_id, FOLD) != 2


def is_deleted(doc_id: int | None) -> bool:
    return is_learning(doc_id) and fold_of(doc_id, FOLD * HELD) // FOLD == 3


def token_key(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(0x6A09E667F3BCC908))


START_KEY = token_key(np.array([START]))[0]


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """56 bits; the lowest byte is 0, so that it takes no room when keys travel."""
    return mix(v * np.uint64(0x9FB21C651E98DF25) + w) & ~np.uint64(0xFF)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then 1 + floor(log2 count)."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), 0).clip(0, BUCKETS - 1)


def _before(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each, START at the beginning of a text."""
    v = np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[np.cumsum(n) - n] = START
    return v


def _send(n_buckets: int):  # noqa: ANN202
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        ids_held, n_held, tokens_held, waiting = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, n, tokens = np.concatenate(ids_held), np.concatenate(n_held), np.concatenate(tokens_held)
            learn = np.array([is_learning(None if i == NULL_ID else i) for i in ids.tolist()])
            gone = np.array([is_deleted(None if i == NULL_ID else i) for i in ids.tolist()])
            of_learn, of_gone = np.repeat(learn, n), np.repeat(gone, n)
            words, at, often = np.unique(tokens, return_inverse=True, return_counts=True)
            rank = np.argsort(-often, kind="stable")
            place = np.empty(len(rank), np.int32)
            place[rank] = np.arange(len(rank), dtype=np.int32)
            name = f"{task}-{number}-{hashlib.md5(ids.tobytes()).hexdigest()[:12]}"
            number += 1
            yield packed_batch([(name, -1, 0, pack(squeeze(ids), squeeze(n), squeeze(place[at]), squeeze(words[rank])), None)])
            keys = np.append(token_key(words), START_KEY)
            c = np.append(np.bincount(at, of_learn, len(words)), learn.sum()).astype(np.uint32)
            d = np.append(np.bincount(at, of_gone, len(words)), gone.sum()).astype(np.uint32)
            order = np.argsort(keys)
            keys, c, d = keys[order], c[order], d[order]
            two, at = np.unique(bigram_key(_before(tokens, n), tokens), return_inverse=True)
            c2 = np.bincount(at[of_learn], minlength=len(two)).astype(np.uint32)
            d2 = np.bincount(at[of_gone], minlength=len(two)).astype(np.uint32)
            e1, e2 = bucket_bounds(keys, n_buckets), bucket_bounds(two, n_buckets)
            for i in range(n_buckets):
                a, b = slice(e1[i], e1[i + 1]), slice(e2[i], e2[i + 1])
                yield packed_batch([(name, i, 0, None, pack(squeeze_sorted(keys[a]), squeeze(c[a]), squeeze(d[a]), squeeze_sorted(two[b]), squeeze(c2[b]), squeeze(d2[b])))])

        for rb in batches:
            ids = ids_of(rb["doc_id"])
            for i, j, data, off in text_chunks(rb["text"]):
                words, counts = word_hashes(data, off, lower=True)
                tokens = np.full(len(words) + j - i, END, np.uint64)
                tokens[np.arange(len(words)) + np.repeat(np.arange(j - i), counts)] = words
                ids_held.append(ids[i:j])
                n_held.append((counts + 1).astype(np.int64))
                tokens_held.append(tokens)
                waiting += len(tokens)
                if waiting >= BATCH_TOKENS:
                    yield from flush()
                    ids_held, n_held, tokens_held, waiting = [], [], [], 0
        if ids_held:
            yield from flush()

    return step


def _totals(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys with their two sums, and both sums in each part's order."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    c, d = (np.bincount(at, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2))
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return keys, np.split(c[at], cuts), np.split(d[at], cuts), c, d


def _reduce(slices: list[bytes]) -> list[bytes]:
    raw = [parts_of(s) for s in slices]
    keys, c, d, call, dall = _totals([(expand_sorted(r[0]), expand(r[1]), expand(r[2])) for r in raw])
    real = keys != START_KEY
    known = [int((call[real] > 0).sum()), int(call[real].sum()), int((call - dall)[real].sum())]
    _, c2, d2, _, _ = _totals([(expand_sorted(r[3]), expand(r[4]), expand(r[5])) for r in raw])
    small = lambda x: squeeze(x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x)
    return [pack(np.array(known if i == 0 else [0, 0, 0], np.int64).tobytes(), *(small(x[i]) for x in (c, d, c2, d2))) for i in range(len(slices))]


COUNTED = "batch string, types long, tokens long, kept_tokens long, data binary, classes array<int>, events array<long>"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: token counts of its texts, and the classes of its deleted events."""
    for name, states, answers in by_batch(batches):
        if len(states) != 1:
            raise RuntimeError(f"batch {name} met {len(states)} states")  # cannot happen: see repeatable()
        ids, n, place, words = (expand(x) for x in parts_of(states[0]))
        raw = [parts_of(a) for a in answers]
        known = np.sum([np.frombuffer(r[0], np.int64) for r in raw], 0)
        c, d, c2, d2 = (np.concatenate([expand(r[i]).astype(np.int64) for r in raw]) for i in (1, 2, 3, 4))
        order = np.argsort(np.append(token_key(words), START_KEY))
        one, less = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        one[order], less[order] = c, c - d
        tokens = words[place]
        _, at = np.unique(bigram_key(_before(tokens, n), tokens), return_inverse=True)
        two = c2[at]
        # the events of deleted documents, under the counts of the other learning documents
        gone = np.repeat(np.array([is_deleted(None if i == NULL_ID else i) for i in ids.tolist()]), n)
        first = np.cumsum(n) - n
        before = np.empty(len(place), np.int64)
        before[1:] = place[:-1]
        before[first] = len(words)
        w, v, pair = less[place[gone]], less[before[gone]], (c2 - d2)[at][gone]
        k2 = np.where(pair > 0, 1 + np.round(STEPS * np.log2(np.maximum(v, 1) / np.maximum(pair, 1))), 0).clip(0, _P2 - 1).astype(np.int64)
        k1 = np.where(w > 0, 1 + np.round(STEPS * np.log2(np.maximum(w, 1))), 0).clip(0, _P1 - 1).astype(np.int64)
        code, events = np.unique((bucket_of(v) * _P2 + k2) * _P1 + k1, return_counts=True)
        data = pack(squeeze(ids), squeeze(n), squeeze(place), squeeze(one), squeeze(two.astype(np.uint32) if two.max() < 1 << 32 else two))
        yield pa.record_batch(
            [pa.array([name]), *(pa.array([int(x)]) for x in known), pa.array([data], pa.binary()), pa.array([code.tolist()], pa.list_(pa.int32())), pa.array([events.tolist()], pa.list_(pa.int64()))],
            ["batch", "types", "tokens", "kept_tokens", "data", "classes", "events"],
        )


def learn_weights(classes: np.ndarray, events: np.ndarray, kept_tokens: int, types: int, rounds: int = 60) -> np.ndarray:
    """[BUCKETS, 3] weights of bigram, unigram and uniform estimates, by expectation-maximisation.  Each bucket starts from, and
    keeps ten events' worth of, the weights of all buckets together."""
    if not types:  # nothing was learned: all weight is on the uniform distribution
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    bucket, k2, k1 = classes // (_P1 * _P2), classes // _P1 % _P2, classes % _P1
    p = np.stack([np.where(k2 > 0, 2.0 ** (-(k2 - 1) / STEPS), 0), np.where(k1 > 0, 2.0 ** ((k1 - 1) / STEPS) / max(kept_tokens, 1), 0), np.full(len(classes), 1 / (types + 1))], 1)
    n = events.astype(float)
    pooled = np.array([0.4, 0.4, 0.2])
    for _ in range(rounds if len(n) else 0):
        r = p * pooled
        r *= (n / r.sum(1))[:, None]
        pooled = (r.sum(0) + 0.1) / (n.sum() + 0.3)
    out = np.tile(pooled, (BUCKETS, 1))
    for b in range(BUCKETS):
        own = bucket == b
        prior = pooled if b else np.array([0, pooled[1], pooled[2]]) / (pooled[1] + pooled[2])
        w = prior
        for _ in range(rounds if own.any() else 0):
            r = p[own] * w
            r *= (n[own] / np.maximum(r.sum(1), 1e-300))[:, None]
            w = (r.sum(0) + 10 * prior) / (n[own].sum() + 10)
        out[b] = w if b else np.array([0, w[1], w[2]]) / (w[1] + w[2])
    return out


@dataclass
class Counted:
    """A corpus with its counts: a stored table of batches, totals, and the weights."""

    batches: DataFrame
    tokens: int
    types: int
    weights: np.ndarray


def count(docs: DataFrame) -> Counted:
    spark = docs.sparkSession
    bound_batches(spark)
    docs = repeatable(docs.select("doc_id", "text"))
    _, size = text_size(docs)
    n_buckets = n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 10 // BUCKET_KEYS)
    sent = docs.select("doc_id", "text").mapInArrow(_send(n_buckets), PACKED)
    table = stored(packed_exchange(sent, n_buckets, _reduce, n_parts).mapInArrow(_assemble, COUNTED), "counted")
    t = table.agg(F.sum("types").alias("v"), F.sum("tokens").alias("n"), F.sum("kept_tokens").alias("k")).first()
    v, n, k = (int(t[x] or 0) for x in "vnk")
    pairs = table.select(F.explode(F.arrays_zip("classes", "events")).alias("x")).groupBy(F.col("x.classes").alias("c")).agg(F.sum("x.events").alias("e")).toPandas()
    return Counted(table, n, v, learn_weights(pairs["c"].to_numpy(np.int64), pairs["e"].to_numpy(np.int64), k, v))


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(counted: Counted) -> DataFrame:
    """One row per document: add-one unigram base_score and the interpolated model's score, log10."""
    total, types, weights = counted.tokens, counted.types, counted.weights

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for raw in rb["data"]:
                ids, n, place, one, two = (expand(x) for x in parts_of(raw.as_py()))
                first = np.cumsum(n) - n
                before = np.empty(len(place), np.int64)
                before[1:] = place[:-1]
                before[first] = len(one) - 1
                c1, cv = one[place], one[before]
                l = weights[bucket_of(cv)]  # noqa: E741
                p = l[:, 0] * two / np.maximum(cv, 1) + l[:, 1] * c1 / max(total, 1) + l[:, 2] / (types + 1)
                base = np.log10((c1 + 1) / (total + types + 1))
                held = [not is_learning(None if i == NULL_ID else i) for i in ids.tolist()]
                yield pa.record_batch(
                    [pa.array(ids, mask=ids == NULL_ID), pa.array(held), pa.array(n), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), first)), pa.array(np.full(len(n), total, np.int64)),
                     pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counted.batches.select("data").mapInArrow(step, SCHEMA)


def score(docs: DataFrame) -> DataFrame:
    return scores(count(docs))
