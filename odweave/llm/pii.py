"""Personal data by candidate gradient boosting.

1. Base spans: four anchored patterns with validity checks (email, ip, card, phone); they always stay.
2. High-recall generators propose further, overlapping spans: written-out or bracketed email addresses, and every run of a
   few digit groups without the base patterns' marks, each under every kind it may be.
3. Boosted trees score a span by its format (digit counts, separators, checksums) and its context.
   Labels are distant: in a bounded sample of documents, validated base spans - as they are and rewritten
   the way people disguise them - are positive; the generators' other spans and broken copies of base
   spans (failed checksum, octet over 255, wrong digit count, price, date and version shapes) are negative.
4. Scores are calibrated on the half not fitted on; each kind gets the lowest threshold whose held-out
   precision reaches ``precision``.  Selected spans that overlap no base span and no better span are added.

Defined cases: null and empty texts have no spans; texts of any length are read whole, in linear time;
repeated rows are scored each; an empty table gives an empty result; a sample without base spans gives a
model that adds nothing; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.boosting import BoostedTrees, platt
from odweave.llm.common import bound_batches

KINDS = ("email", "ip", "card", "phone")
#: Documents that the model is fitted on at most, about, and training rows that a document gives at most.
FIT_DOCS, MOST_ROWS = 4000, 64

# Fixed patterns of the base spans.  The local part of an email is walked back from its "@", and digit
# runs are entered at their first digit only, so that no text takes quadratic time.
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ENDING = re.compile(r"[^A-Za-z](?:com|org|net|edu|gov|info|io|co|eu|uk|us|de|fr|es|it|nl)$", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Per kind the leftmost non-overlapping matches that pass their check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        last, pos = 0, text.find("@")
        while pos >= 0:
            start = pos
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            m = _HOST.match(text, pos) if start < pos else None
            if m:
                out["email"].append((start, m.end()))
                last = m.end()
            pos = text.find("@", m.end() if m else pos + 1)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = digits_of(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# --- candidates -----------------------------------------------------------------------------

_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}|[ ]at[ ]", re.I)
_DOT = r"(?:\.|\(dot\)|\[dot\]|\{dot\}|[ ]dot[ ])"
_ENDING = re.compile(r"[^A-Za-z](?:com|org|net|edu|gov|info|io|co|eu|uk|us|de|fr|es|it|nl)$", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AFTER = re.compile(rf"[ ]?[A-Za-z0-9-]{{1,63}}(?:[ ]?{_DOT}[ ]?[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)
_DIGITS = re.compile(r"[0-9]+")
#: What may stand between the groups of a number.
_BETWEEN = re.compile(r"[ ().\-/\[\]]{1,3}")
_DEFANGED = re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![A-Za-z0-9])")
_CUES = {
    "email": re.compile(r"mail|contact|write|reach", re.I), "ip": re.compile(r"\bip\b|addr|host|server|login", re.I),
    "card": re.compile(r"card|visa|credit|pay|account", re.I), "phone": re.compile(r"phone|tel|call|fax|mobile|cell", re.I),
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data, under every kind that they may be; they may overlap: every run of neighbouring digit groups of up to 24
    digits is one.  The part of an address before its sign is taken whole, however long."""
    out = []
    for at in _AT.finditer(text):
        end = at.start() - (at.start() > 0 and text[at.start() - 1] == " ")
        start = end
        while start and text[start - 1] in _LOCAL:
            start -= 1
        after = start < end and _AFTER.match(text, at.end())
        if after:
            out.append(("email", start, after.end()))
    if not _DIGIT.search(text):
        return out
    groups = [m.span() for m in _DIGITS.finditer(text)]
    joined = [bool(_BETWEEN.fullmatch(text, a[1], b[0])) for a, b in zip(groups, groups[1:], strict=False)]
    inside = [(a and text[a - 1].isalnum()) or (a > 1 and text[a - 1] in "+." and text[a - 2].isalnum()) for a, _ in groups]
    ends = [b < len(text) and text[b].isalnum() for _, b in groups]
    for i, (a, b) in enumerate(groups):
        if inside[i]:
            continue
        n, j = b - a, i
        while True:
            if 7 <= n <= 24 and not ends[j]:
                start = a - (a > 0 and text[a - 1] == "(" and ")" in text[a : groups[j][1]])
                if n <= 15:
                    out.append(("phone", start, groups[j][1]))
                if n >= 13:
                    out.append(("card", start, groups[j][1]))
            if n > 24 or j == len(joined) or not joined[j]:
                break
            j += 1
            n += groups[j][1] - groups[j][0]
    if "[.]" in text or "(.)" in text:
        out += [("ip", *m.span()) for m in _DEFANGED.finditer(text)]
    return out


class Taken:
    """Intervals that no further span may overlap, in order."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)  # the first that ends beyond a
        return i == len(self.starts) or self.starts[i] >= b

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    d = digits_of(s)
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    parts = _DIGITS.findall(s)
    groups = [len(g) for g in parts] or [0]
    octets = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return [
        float(KINDS.index(kind)), len(s), len(d), len(groups), max(groups), min(groups), groups[0], groups[-1],
        s.count(" "), s.count("-"), s.count("."), s.count("("), s.count("/"), s.count("["),
        float(luhn(d)) if d else 0.0, float(octets), float(d[:1] in ("3", "4", "5", "6")),
        float(bool(re.search(r"at", s, re.I)) and not d[:1].isdigit()), float(len(re.findall(r"dot", s, re.I))),
        float(bool(_CUES[kind].search(before))), float(sum(bool(c.search(before)) for c in _CUES.values())),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(before[-1:] in "$€£#"),
        float(bool(re.match(r"(19|20)\d\d[-/.]", s))), float(sum(len(g) == 3 for g in parts)), float(sum(len(g) == 4 for g in parts)),
        float(bool(re.search(r"[0-9][ ().\-/\[\]]{1,3}$", before))), float(bool(re.match(r"[ ().\-/\[\]]{1,3}[0-9]", after))), float("/" in s or "  " in s), float(bool(re.search(r"[(\[{]at[)\]}]", s, re.I))), float(bool(_ENDING.search(s))),
    ]


def _another(kind: str, r: np.random.Generator) -> str:
    """A made-up span of a kind, so that the model does not learn the habits of one table's names and numbers."""
    num = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    word = lambda low, high: "".join(chr(97 + x) for x in r.integers(0, 26, r.integers(low, high)))
    if kind == "email":
        local = word(2, 10) + ["", ".", "_", "-"][r.integers(4)] + word(1, 9) + (num(2) if r.integers(3) == 0 else "")
        return f"{local}@{word(3, 12)}{'.' + word(2, 8) if r.integers(4) == 0 else ''}.{['com', 'org', 'net', 'de', 'fr', 'edu', word(2, 4)][r.integers(7)]}"
    if kind == "ip":
        return ".".join(str(int(x)) for x in r.integers(0, 256, 4))
    if kind == "card":
        d = "3456"[r.integers(4)] + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))
    return f"+{r.integers(1, 99)}{num(10)}"


def _disguised(kind: str, s: str, r: np.random.Generator) -> str:
    """The span as people rewrite it so that the base pattern fails."""
    if kind == "email":
        at = ["(at)", " (at) ", " at ", "[at]", " [at] ", "{at}"][r.integers(6)]
        dot = [" dot ", "[dot]", "(dot)", " (dot) ", ".", "."][r.integers(4 if at == " at " else 6)]
        local, host = s.split("@", 1)
        return local + at + host.replace(".", dot)
    if kind == "ip":
        return s.replace(".", ["[.]", "(.)"][r.integers(2)])
    d = digits_of(s)
    if kind == "card":
        sep, size = [".", "/", "  "][r.integers(3)], [4, 4, 4, 2][r.integers(4)]
        return sep.join(d[i : i + size] for i in range(0, len(d), size))
    local = d[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"00{d[:-10]} {local}"][r.integers(4)]


def _broken(kind: str, s: str, r: np.random.Generator) -> str:
    """A near miss: same look, not personal data."""
    num = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    if kind == "email":
        return ["seen at home", "at noon dot point", f"meet at {num(2)}.{num(2)}"][r.integers(3)]
    if kind == "ip":
        return "[.]".join(str(int(x)) for x in r.integers(256, 999, 4)) if r.integers(2) else f"{num(1)}.{num(2)}.{num(4)}.{num(2)}"
    if kind == "card":
        d = digits_of(s)
        bad = d[:-1] + str((int(d[-1]) + 1 + int(r.integers(8))) % 10)
        return [bad, f"{bad[:4]}.{bad[4:8]}.{bad[8:12]}.{bad[12:]}", num(13), num(21)][r.integers(4)]
    return [f"20{num(2)}-{num(2)}-{num(2)}", f"{num(3)} {num(3)} {num(3)} {num(3)}", num(8), f"{num(1)}.{num(6)}", f"{num(5)}-{num(3)}-{num(6)}", f"20{num(2)}/{num(2)}/{num(2)} {num(2)}"][r.integers(6)]


def labelled(text: str, doc_id: int) -> Iterator[tuple[list[float], int]]:
    """Training rows that one text gives."""
    r = np.random.default_rng(abs(doc_id) + 1)
    base = base_spans(text)
    taken = {(k, *s) for k in KINDS for s in base[k]}
    spots = Taken(s for k in KINDS for s in base[k])
    for kind, a, b in candidates(text):
        if (kind, a, b) in taken:
            yield features(text, kind, a, b), 1
        elif spots.free(a, b):
            yield features(text, kind, a, b), 0
    for kind, a, b in sorted(taken):
        for label, make in ((1, _disguised), (1, _disguised), (0, _broken), (0, _broken)):
            new = make(kind, text[a:b] if r.integers(2) else _another(kind, r), r)
            around = text[max(0, a - 60) : a] + new + text[b : b + 40]
            at = min(a, 60)
            for k, x, y in candidates(around):
                if x < at + len(new) and at < y:
                    right = label and k == kind and x <= at + 1 and y >= at + len(new) - 1
                    yield features(around, k, x, y), int(right)


class Model:
    def __init__(self, rows: np.ndarray, labels: np.ndarray, precision: float):
        self.thresholds = dict.fromkeys(KINDS, 2.0)
        self.trees = None
        if len(labels) < 50 or labels.min() == labels.max():
            return
        half = np.arange(len(labels)) % 2 == 0
        self.trees = BoostedTrees().fit(rows[half], labels[half])
        held = ~half
        self.scale = platt(m := self.trees.margin(rows[held]), labels[held])
        p = 1 / (1 + np.exp(-(self.scale[0] * m + self.scale[1])))
        for i, kind in enumerate(KINDS):
            own = rows[held][:, 0] == i
            order = np.argsort(-p[own])
            y, q = labels[held][own][order], p[own][order]
            right = np.cumsum(y) / np.arange(1, len(y) + 1)
            good = np.flatnonzero((right >= precision) & (np.cumsum(y) >= 10))
            if len(good):
                self.thresholds[kind] = max(0.5, float(q[good[-1]]))

    def added(self, text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
        if self.trees is None:
            return []
        taken = Taken(s for k in KINDS for s in base[k])
        free = [c for c in candidates(text) if taken.free(c[1], c[2])]
        if not free:
            return []
        m = self.trees.margin(np.array([features(text, *c) for c in free]))
        p = 1 / (1 + np.exp(-(self.scale[0] * m + self.scale[1])))
        out: list[tuple[str, int, int]] = []
        # the likeliest first; of equally likely ones the longer, then the first
        for i in sorted(range(len(free)), key=lambda i: (-p[i], free[i][1] - free[i][2], free[i][1])):
            kind, a, b = free[i]
            if p[i] >= self.thresholds[kind] and taken.free(a, b):
                taken.add(a, b)
                out.append(free[i])
        return out


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, precision: float = 0.98) -> Model:
    """The model, from about fit_docs documents chosen by a hash of their ids (2 fit_docs at most)."""
    bound_batches(docs.sparkSession)
    every = max(1, docs.count() // fit_docs)
    sample = docs.select("doc_id", "text").where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0) & F.col("text").isNotNull())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, out = [], []
            for i, t in zip(rb["doc_id"].to_pylist(), rb["text"].to_pylist(), strict=True):
                for x, y in itertools.islice(labelled(t, i or 0), MOST_ROWS):
                    ids.append(i or 0)
                    out.append([*x, float(y)])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "x"])

    got = sample.limit(2 * fit_docs).mapInArrow(rows, "doc_id long, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable") if len(got) else got
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, 33))
    order = np.lexsort(x.T) if len(x) else []
    return Model(x[order][:, :-1], x[order][:, -1], precision)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, n_spans long, base_sha256 string, spans string"


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs: counts of the base spans by kind, n_added, n_spans (all kinds), base_sha256 and spans (all,
    as kind:start:end by kind, then start; code points, end exclusive)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rb in batches:
            counts, hashes, spans = [], [], []
            for t in rb["text"]:
                t = t.as_py() or ""
                base = base_spans(t)
                flat = [(k, *s) for k in KINDS for s in base[k]]
                more = m.added(t, base)
                counts.append([*(len(base[k]) for k in KINDS), len(more), len(flat) + len(more)])
                hashes.append(hashlib.sha256(spans_text(flat).encode()).hexdigest())
                spans.append(spans_text(flat + more))
            c = np.array(counts, np.int64).reshape(-1, 6)
            yield pa.record_batch([rb["doc_id"].cast(pa.int64()), *(pa.array(c[:, i]) for i in range(6)), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "n_spans", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(step, SCHEMA)


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[{}]") -> DataFrame:
    """docs with every found span of text replaced by its kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        spans = sorted([(a, b, k) for k in KINDS for a, b in base[k]] + [(a, b, k) for k, a, b in shared.value.added(t, base)])
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [t[at:a], mark.format(k.upper())]
            at = max(at, b)
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def cleaned(s):  # noqa: ANN001, ANN202
        return s.map(clean, na_action="ignore")

    return docs.withColumn("text", cleaned("text"))
