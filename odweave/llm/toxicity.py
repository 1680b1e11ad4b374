"""Toxicity by noisy-channel deobfuscation.

1. A character language model (trigrams of letters, interpolated) is counted over all words of all learning
   texts.
2. Tokens that look disguised - digits or symbols among letters, letters spaced out or joined by marks, runs
   of one letter - become lattices: each symbol may be any letter it stands for, a mark nothing, a run one or
   two letters.  Viterbi finds the likeliest plain word under channel costs and the language model.
3. The restored text is scored: hashed character 4- to 6-grams of its words, those that tell the labels
   apart, weighed by logistic regression over a bounded sample of labelled rows (``FIT_DOCS``).  Executors count and
   extract the features; the driver gets those chosen (``MAX_FEATURES``) and one bitmap a row, never texts.

Restoring a text takes time in proportion to its length.

Defined cases: null and empty texts score like a text without any known feature; rows without a label, or with a
null one, are scored but not learned from; if doc_id repeats in labels its largest label counts; repeated rows are
scored each; with no label to learn from, or only label 0, every score is next to 0 (1 / (1 + e**30)), with only
label 1 next to 1; an empty table gives an empty result; texts are read whole; only doc_id and text are read of documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import bound_batches, fold_column, mix, release, stored, text_chunks

#: Labelled rows that the classifier is fitted on at most (half of each label), features it keeps at most, and their
#: ridge penalty.
FIT_DOCS, MAX_FEATURES, L2 = 6000, 1024, 0.3
BITS = 20
ORDERS = (4, 5, 6)

# The letters that digits and symbols stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
WILD = "*#"
_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SYM = "".join(re.escape(c) for c in STANDS_FOR) + re.escape(WILD)
_SINGLES = re.compile(rf"(?<!\w)[A-Za-z{_SYM}](?:([ .\-_·])[A-Za-z{_SYM}](?!\w)){{2,}}")
#: A disguised token, and places that one of its run of non-spaces must have at or after the token's start.
_TOKEN = re.compile(rf"(?<![^\s\"'(])[A-Za-z{_SYM}]{{2,39}}[A-Za-z0-9@$](?=[\s.,;:?\"')!]|$)")
_SPOT = re.compile(rf"(?=[A-Za-z][{_SYM}][A-Za-z0-9@$]|(?<![^\s\"'(])[{_SYM}][A-Za-z])")
_JOINED = re.compile(r"(?<!\w)[A-Za-z](?:([.\-_*·])[A-Za-z](?!\w)){2,}|(?<![^\s])[A-Za-z]{1,3}(?:[._·*][A-Za-z]{1,3}){2,}(?!\w)")
_THRICE = re.compile(r"([A-Za-z])\1\1")
#: Masks of a token that are guessed; in one with more they count as nothing.
MOST_WILD = 8
_MASKED = re.compile(r"(?<!\w)[A-Za-z]+[*#]{1,3}[A-Za-z]+(?!\w)")


class CharModel:
    """Trigram model of a word's letters: 26 letters, 0 the edge."""

    def __init__(self, tri: np.ndarray):
        tri = tri.reshape(27, 27, 27).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + 27)
        p2 = (bi + 27 * p1) / (bi.sum(1, keepdims=True) + 27)
        p3 = (tri + 27 * p2[None]) / (tri.sum(2, keepdims=True) + 27)
        self.logp = np.log(p3).tolist()

    def viterbi(self, slots: list[list[tuple[str, float]]]) -> str:
        """The likeliest word of a lattice: each slot has (letters, cost) choices; "" is nothing."""
        logp = self.logp
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # score, (letters, link to the one before)
        for slot in slots:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, link) in states.items():
                for letters, cost in slot:
                    s, x, y = score - cost, a, b
                    for c in letters:
                        k = ord(c) - 96
                        s += logp[x][y][k]
                        x, y = y, k
                    if (x, y) not in new or s > new[x, y][0]:
                        new[x, y] = (s, (letters, link))
            states = new
        link = max((s + logp[a][b][0], -a, -b, link) for (a, b), (s, link) in states.items())[3] if states else None
        out = []
        while link:
            out.append(link[0])
            link = link[1]
        return "".join(reversed(out))


#: Channel costs (nats): a plain letter is right; a symbol stands for a letter; a mark is dropped; of a run one or two letters stay.
_SUBSTITUTE, _DROP, _WILD_COST = 0.5, 0.1, 1.0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    slots: list[list[tuple[str, float]]] = []
    i, s = 0, token.lower()
    guess = sum(s.count(c) for c in WILD) <= MOST_WILD
    while i < len(s):
        c, j = s[i], i
        while j < len(s) and s[j] == c:
            j += 1
        n = j - i
        if "a" <= c <= "z":
            if n <= 1:
                slots.append([(c, 0.0)])
            elif n == 2:
                slots.append([(c * 2, 0.0), (c, 1.0)])
            else:
                slots.append([(c, 0.0), (c * 2, 0.5)])
        elif c in STANDS_FOR:
            for _ in range(min(n, 2)):
                slots.append([(x, _SUBSTITUTE) for x in STANDS_FOR[c]])
        elif c in WILD:
            for _ in range(min(n, 2)):
                slots.append([(chr(97 + k), _WILD_COST) for k in range(26) if guess] + [("", _DROP + 2.0)])
        i = j
    return slots


def _space(text: str, at: int, step: int, end: int) -> int:
    """Where the run of non-spaces at ``at`` ends in a direction (not beyond end)."""
    while at != end and not text[at].isspace():
        at += step
    return at


class Restorer:
    def __init__(self, model: CharModel):
        plain = lambda token: model.viterbi(lattice(token))
        often = lru_cache(200_000)(plain)
        self.decode = lambda token: often(token) if len(token) <= 64 else plain(token)

    def _leet(self, text: str) -> str:
        """Tokens with symbols among letters, in the runs of non-spaces that have such a place."""
        spots = [m.start() for m in _SPOT.finditer(text)]
        out, at, i = [], 0, 0
        while i < len(spots):
            begin, end = _space(text, spots[i], -1, at - 1) + 1, _space(text, spots[i], 1, len(text))
            while i + 1 < len(spots) and spots[i + 1] < end:
                i += 1
            for m in _TOKEN.finditer(text, begin, end):
                if m.start() > spots[i]:
                    break
                out += [text[at : m.start()], f" {self.decode(m[0])} "]
                at = m.end()
            i += 1
        return "".join([*out, text[at:]])

    def _runs(self, text: str) -> str:
        """Words with a letter three times in a row."""
        out, at = [], 0
        m = _THRICE.search(text)
        while m:
            a, b = m.span()
            while a > at and (text[a - 1].isalnum() or text[a - 1] == "_"):
                a -= 1
            while b < len(text) and (text[b].isalnum() or text[b] == "_"):
                b += 1
            word = text[a:b]
            out += [text[at:a], self.decode(word) if word.isascii() and word.isalpha() else word]
            at = b
            m = _THRICE.search(text, at)
        return "".join([*out, text[at:]])

    def restore(self, text: str) -> str:
        """The text, lower-cased, with disguised tokens decoded."""
        one = lambda m: f" {self.decode(m[0])} " if any(c in _ALPHA for c in m[0]) else m[0]
        text = _SINGLES.sub(one, text)
        text = _JOINED.sub(one, text)
        text = _MASKED.sub(one, text)
        return self._runs(self._leet(text)).lower()


def _codes(chars: str) -> np.ndarray:
    """Whether a character, by its code in ``disguised``, is one of chars."""
    table = np.zeros(256, bool)
    table[[_CODE_OF.get(c, ord(c)) for c in chars]] = True
    return table


#: Codes of characters beyond ASCII: symbols, the middle dot, any other; and of the edge between two texts.
_SIGN, _DOT, _OTHER, _EDGE = 128, 129, 130, 131
_CODE_OF = {"€": _SIGN, "£": _SIGN, "¡": _SIGN, "·": _DOT}
_LETTERS, _WILDS = _codes(_ALPHA), _codes(WILD)
_SYMBOLS = _codes("".join(STANDS_FOR) + WILD)
_WORD = _codes(_ALPHA + "0123456789_")
_LAST = _codes(_ALPHA + "0123456789@$")
_GAPS, _MARKS = _codes(" .-_·"), _codes(".-_*·")
_START = _codes(" \t\n\v\f\r\x1c\x1d\x1e\x1f\"'(")
_START[[_OTHER, _EDGE]] = True  # others may be spaces


def disguised(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts that may have a disguised token (a superset of those the patterns match): for each pattern, a run of
    characters that every match of it has."""
    if len(off) < 2:
        return np.zeros(0, bool)
    if len(data) and data.max() >= 128:
        lead = (data & 0xC0) != 0x80
        at, pad = np.flatnonzero(lead), np.concatenate((data, np.zeros(2, np.uint8)))
        one, two, three = pad[at], pad[at + 1], pad[at + 2]
        code = np.where(one < 128, one, _OTHER).astype(np.uint8)
        code[(one == 0xC2) & ((two == 0xA3) | (two == 0xA1)) | (one == 0xE2) & (two == 0x82) & (three == 0xAC)] = _SIGN
        code[(one == 0xC2) & (two == 0xB7)] = _DOT
        off = np.concatenate(([0], np.cumsum(lead)))[off]
    else:
        code = data
    n = len(code) + len(off) - 1
    edge = np.full(7, _EDGE, np.uint8)
    code = np.concatenate((edge[:1], np.insert(code, off[:-1], edge[0]), edge))
    letter, symbol, mark, wild = (t[code] for t in (_LETTERS, _SYMBOLS, _MARKS, _WILDS))
    gap, word, any_ = _GAPS[code], _WORD[code], letter | symbol
    at = lambda m, k: m[k + 1 : k + 1 + n]
    hint = at(any_, 0) & at(gap, 1) & at(any_, 2) & at(gap, 3) & at(any_, 4) & ~at(word, -1) & ~at(word, 5)  # _SINGLES
    joined = at(letter, 0) & at(mark, 1) & at(letter, 2)  # _JOINED
    hint |= joined & (at(mark, 3) & at(letter, 4) | at(letter, 3) & (at(mark, 4) & at(letter, 5) | at(letter, 4) & at(mark, 5) & at(letter, 6)))
    masked = at(letter, 0) & at(wild, 1)  # _MASKED
    hint |= masked & (at(letter, 2) | at(wild, 2) & (at(letter, 3) | at(wild, 3) & at(letter, 4)))
    hint |= at(letter, 0) & at(symbol, 1) & at(_LAST[code], 2) | at(_START[code], -1) & at(symbol, 0) & at(letter, 1)  # _SPOT
    hint |= at(letter, 0) & (at(code, 0) == at(code, 1)) & (at(code, 0) == at(code, 2))  # _THRICE
    return np.logical_or.reduceat(hint, off[:-1] + np.arange(len(off) - 1))


def restored(texts: list[str] | pa.Array, restorer: Restorer) -> pa.Array:
    """The texts lower-cased, deobfuscated where they need it, with a space at either end."""
    col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    out = []
    for i, j, data, off in text_chunks(col):
        flags = disguised(data, off)
        for k in range(i, j):
            t = col[k].as_py() or ""
            out.append(f" {restorer.restore(t) if flags[k - i] else t.lower()} ")
    return pa.array(out, pa.large_string())


# --- character language model over all learning texts ---------------------------------------

_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)


def char_model(texts: DataFrame) -> CharModel:
    """Trigram counts of the ASCII letters of all words; each task sends 27**3 sums."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for rb in batches:
            for _, _, data, off in text_chunks(rb["text"]):
                c = _CODE[data]
                first = np.zeros(len(c) + 1, bool)
                first[off] = True
                a = np.concatenate(([0, 0], c))[: len(c)]
                b = np.concatenate(([0], c))[: len(c)]
                b[first[:-1]] = 0
                a[first[:-1] | (b == 0)] = 0
                total += np.bincount((a * 27 + b) * 27 + c, minlength=27**3)
        total[0] = 0
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(total[k])], ["k", "n"])

    tri = np.zeros(27**3, np.int64)
    for r in texts.select("text").mapInArrow(step, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        tri[r["k"]] = r["n"]
    return CharModel(tri)


# --- features and classifier ----------------------------------------------------------------

_WORDLIKE = np.full(256, 32, np.uint8)
_WORDLIKE[97:123] = np.arange(97, 123)
_WORDLIKE[128:] = np.arange(128, 256)


def grams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each n-gram, its slot of 2**BITS): word edges are spaces."""
    for i, j, data, off in text_chunks(col):
        b = _WORDLIKE[data].astype(np.uint64)
        row = np.repeat(np.arange(j - i), np.diff(off))
        h, rows, slots = np.zeros(len(b), np.uint64), [], []
        gap = b == 32
        inner = np.zeros(len(b), bool)  # a space within, other than first or last
        for k in range(1, max(ORDERS) + 1):
            m = len(b) - k + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + b[k - 1 :]
            inner = inner[:m]
            if k > 2:
                inner = inner | gap[k - 2 : k - 2 + m]
            if k in ORDERS:
                good = ~inner & (row[:m] == row[k - 1 :])
                slots.append((mix(h[good] + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
                rows.append(row[:m][good])
        yield i, j, np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(slots) if slots else np.zeros(0, np.int64)


class Model:
    """The character model, the slots that are features, their weights, and the bias for the labels' own proportion."""

    def __init__(self, chars: CharModel, slots: list[int], x: np.ndarray, labels: np.ndarray, share: float):
        """x [rows, features]: which feature a sample row has."""
        self.chars = chars
        self.feature = feature_table(slots)
        self.weights, self.bias = np.zeros(len(slots)), -30.0
        if not 0 < share < 1:
            self.bias = 30.0 if share else -30.0
            return
        n1, n0 = labels.sum(), len(labels) - labels.sum()
        x = np.concatenate((x.astype(np.float32), np.ones((len(x), 1), np.float32)), 1)
        w = np.zeros(x.shape[1], np.float32)
        w[-1] = math.log(n1 / n0)
        ridge = np.full(len(w), L2, np.float32)
        ridge[-1] = 1e-3
        for _ in range(12):  # Newton steps of ridge logistic regression
            e = 1 / (1 + np.exp(-np.clip(x @ w, -15, 15)))
            step = np.linalg.solve((x * (e * (1 - e))[:, None]).T @ x + np.diag(ridge), x.T @ (e - labels).astype(np.float32) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-3:
                break
        w, c = w[:-1].astype(float), float(w[-1])
        self.weights = w
        self.bias = float(c - math.log(n1 / n0) + math.log(share / (1 - share)))

    def score(self, col: pa.Array, restorer: Restorer) -> np.ndarray:
        m = np.full(len(col), self.bias)
        for k in range(0, len(col), 512):
            part = col.slice(k, 512)
            for i, j, rows, slots in grams(restored(part, restorer)):
                f = self.feature[slots]
                hit = f >= 0
                n = max(1, len(self.weights))
                pair = np.unique(rows[hit] * n + f[hit])
                m[k + i : k + j] += np.bincount(pair // n, self.weights[pair % n], j - i) if len(pair) else 0.0
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def feature_table(slots: list[int]) -> np.ndarray:
    """Slot -> number of the feature, -1 if it is none."""
    out = np.full(1 << BITS, -1, np.int32)
    out[np.array(slots, np.int64)] = np.arange(len(slots))
    return out


def choose_features(sample: DataFrame, chars: CharModel, n1: int, n0: int) -> list[int]:
    """The slots whose share among rows of label 1 exceeds that of label 0 most (z over 3, five rows at least)."""
    shared = sample.sparkSession.sparkContext.broadcast(chars)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        a, b = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for rb in batches:
            label = rb["toxic"].to_numpy(zero_copy_only=False) != 0
            for k in range(0, rb.num_rows, 128):
                for i, _, rows, slots in grams(restored(rb["text"].slice(k, 128), restorer)):
                    pair = np.unique(rows << BITS | slots)
                    one, slot = label[k + i + (pair >> BITS)], pair & ((1 << BITS) - 1)
                    a += np.bincount(slot[one], minlength=1 << BITS).astype(np.int32)
                    b += np.bincount(slot[~one], minlength=1 << BITS).astype(np.int32)
        seen = np.flatnonzero(a)
        yield pa.record_batch([pa.array(seen), pa.array(a[seen].astype(np.int64)), pa.array(b[seen].astype(np.int64))], ["slot", "a", "b"])

    counts = sample.select("text", "toxic").mapInArrow(step, "slot long, a long, b long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p = (F.col("a") + F.col("b")) / float(n1 + n0)
    z = (F.col("a") / float(n1) - F.col("b") / float(n0)) / F.sqrt(F.greatest(p * (1 - p) * (1 / n1 + 1 / n0), F.lit(1e-9)))
    best = counts.where("a >= 5").withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "slot").limit(MAX_FEATURES)
    return [r["slot"] for r in best.select("slot").collect()]


def sample_rows(sample: DataFrame, chars: CharModel, slots: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(which features each sample row has, its label), in order of doc_id."""
    shared = sample.sparkSession.sparkContext.broadcast((chars, slots))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, slots = shared.value
        restorer, feature = Restorer(chars), feature_table(slots)
        for rb in batches:
            x = np.zeros((rb.num_rows, len(slots)), bool)
            for k in range(0, rb.num_rows, 128):
                for i, _, rows, at in grams(restored(rb["text"].slice(k, 128), restorer)):
                    f = feature[at]
                    x[k + i + rows[f >= 0], f[f >= 0]] = True
            yield pa.record_batch([rb["doc_id"], rb["toxic"], pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["doc_id", "toxic", "x"])

    got = sorted((r["doc_id"], r["toxic"], bytes(r["x"])) for r in sample.mapInArrow(step, "doc_id long, toxic int, x binary").collect())
    x = np.unpackbits(np.array([np.frombuffer(g[2], np.uint8) for g in got]).reshape(len(got), -1), axis=1)[:, : len(slots)]
    return x, np.array([g[1] for g in got], np.int64)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_docs: int = FIT_DOCS) -> Model:
    """The model learned from the labelled rows of docs where ``learn`` holds; characters are counted over all
    texts where it holds."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = (marks.where(learn) if learn is not None else marks).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    pick = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") == 1, F.lit(fit_docs / 2 / max(n1, 1))).otherwise(F.lit(fit_docs / 2 / max(n0, 1)))
    chosen = marks.where(pick < rate).limit(2 * fit_docs)  # about fit_docs ids: a bounded broadcast
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # of rows that repeat a doc_id the one with the least text
    sample = stored(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(parts), "labelled")
    got = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n1 / (n1 + n0) if len(got) == 2 else float(bool(n1) and not n0)
    chars = char_model(rows)
    slots = choose_features(sample, chars, got[1], got[0]) if len(got) == 2 else []
    x, y = sample_rows(sample, chars, slots) if len(got) == 2 else (np.zeros((0, 0)), np.zeros(0, np.int64))
    release(sample)
    return Model(chars, slots, x, y, share)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value.chars)
        for rb in batches:
            p = shared.value.score(rb["text"], restorer)
            yield pa.record_batch([rb["doc_id"].cast(pa.int64()), rb["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (held_out if held_out is not None else F.lit(False)).alias("held_out")).mapInArrow(step, SCHEMA)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows by a model that learns from the rows whose crc32(doc_id) mod 5 is not 0."""
    held = fold_column(5) == 0
    return score(docs, fit(docs, labels, ~held), held)
