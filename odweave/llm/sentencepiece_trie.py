"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words (runs of the space mark and what follows) of a batch are sorted, which lists
a trie of them depth-first; forward states of the common prefix with the word before are kept, so each
trie node is computed once.  The state of a prefix is its best last piece and the forward score of the
pieces up to it: the best score of a prefix before plus the piece's own; of equal scores the longer piece wins.

Model files are of two kinds.  Unigram models are decoded by that recurrence alone.  The file used here is of the BPE kind,
whose encoder merges by score; the best sum of scores gives other pieces for many words (README has the
figure).  For this kind a piece may follow another only if the two, merged together, stay as they are.  With that
transition constraint one path at most survives to every prefix, so the first piece that may follow is the best, and the
path is what the model's own encoder gives.

Characters without a piece become byte pieces.  Decoding gathers the bytes of the pieces.

Defined cases: null and empty texts have no ids and decode to the empty text; texts and words of any length
are encoded whole; a literal space mark in a text reads as a space when decoded, as in the library (such a
text is the only kind that does not round-trip); repeated rows are encoded each; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from odweave.llm.common import bound_batches

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose ids a worker remembers between batches (bounded memory; never changes a result).
REMEMBER = 100_000
#: Pairs of neighbouring pieces that a worker remembers (bounded memory; never changes a result).
MOST_PAIRS = 300_000
#: Text that is encoded at a time.
CHUNK_CHARS = 1_000_000

_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Stands between words while Arrow splits them; texts that have it, or halves of surrogate pairs, are split in Python.
_CUT = "\x01"
_LONE = re.compile("[\ud800-\udfff]")
_UNKNOWN = -1
_LOADED: dict[tuple[str, str], "Pieces"] = {}


def _split(t: str) -> str | None:
    """The marked words of a text, with _CUT between them (an empty one between two cuts has no pieces); null for an empty text."""
    if not t:
        return None
    if "  " in t or t[0] == " " or MARK in t:  # several marks in a row stay in one word
        return _CUT.join(_SEGMENT.findall(MARK + t.replace(" ", MARK)))
    t = MARK + t.replace(" ", _CUT + MARK)
    return t.replace("\n", f"{_CUT}\n{_CUT}") if "\n" in t else t


def _segments(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct marked words, the place of every word of all texts among them, number of words of each text)."""
    if not any(t and (_CUT in t or not t.isascii() and _LONE.search(t)) for t in texts):
        words = pc.split_pattern(pa.array([_split(t) for t in texts], pa.large_string()), _CUT)
        code = words.flatten().dictionary_encode()
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return code.dictionary.to_pylist(), code.indices.to_numpy().astype(np.int64), counts
    per = [_SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    at: dict[str, int] = {}
    index = np.array([at.setdefault(w, len(at)) for x in per for w in x], np.int64)
    return list(at), index, np.array([len(x) for x in per], np.int64)


class Pieces:
    """The pieces of a model with their scores; ``bytes_`` has the ids of byte pieces, ``hidden`` ids that texts never give."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_: dict[int, int], hidden: frozenset[int] = frozenset(), kind: str = "bpe"):
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"a model is of the kind bpe or unigram, not {kind}")
        n = len(pieces)
        self.piece, self.score, self.constrained = pieces, scores, kind == "bpe"
        plain = [i for i in range(n) if i not in hidden and i not in bytes_.values()]
        self.ids = {self.piece[i]: i for i in plain}
        self.unknown_score = min(scores, default=0.0) - 10.0  # of a character without a piece
        self.byte = [bytes_.get(b, 0) for b in range(256)]
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = self.piece[i].replace(MARK, " ").encode()
        for b, i in bytes_.items():
            self.bytes[i] = bytes([b])
        # A cut before a mark that follows another character, and around a line end, is never merged over.
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("this model has pieces that span words")
        # Pieces that their own encoding splits are never given; those left, by their last three characters.
        if self.constrained:
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [i]}
        # (size, id, or None where the characters before decide) of the pieces that end in three characters, longer ones first
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.pairs_of = {p: ((2, i),) for p, i in self.ids.items() if len(p) == 2}
        self.lengths = {e: (*((n, self.ids[e] if n == 3 else None) for n in sorted(v, reverse=True)), *self.pairs_of.get(e[1:], ())) for e, v in ends.items()}
        self.follows: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.pairs = 0
        self.known: dict[str, list[int]] = {}
        lens = np.array([len(b) for b in self.bytes], np.int64)
        self.len, self.off = lens, np.concatenate(([0], np.cumsum(lens)))[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    @classmethod
    def from_file(cls, model: str = DEFAULT_MODEL, kind: str = "bpe") -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        bytes_ = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        hidden = frozenset(i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        return cls(pieces, [sp.get_score(i) for i in range(n)], bytes_, hidden, kind)

    def merge(self, s: str) -> list[int]:
        """Greedy merging of a short string: the pair whose union has the best score, leftmost first."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return [self.ids.get(p, _UNKNOWN) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether pieces a and b, encoded together, stay as they are; remembered for a bounded number of pairs."""
        if self.pairs >= MOST_PAIRS:
            self.follows.clear()
            self.pairs = 0
        self.pairs += 1
        r = self.follows[a][b] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return r

    def viterbi(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words, in sorted order."""
        last, start, total = [_UNKNOWN], [0], [0.0]  # of the prefix of each length: last piece, where it starts, forward score
        extend = self._only_path if self.constrained else self._best_path
        before = ""
        for w in sorted(words):
            n, k = len(w), 0
            top = min(n, len(before))
            while k < top and w[k] == before[k]:
                k += 1
            del last[k + 1 :], start[k + 1 :], total[k + 1 :]
            extend(w, k, last, start, total)
            out: list[int] = []
            j = n
            while j:
                if last[j] < 0:
                    out.extend(self.byte[b] for b in reversed(w[j - 1].encode("utf-8", "surrogatepass")))
                else:
                    out.append(last[j])
                j = start[j]
            out.reverse()
            before = w
            yield w, out

    def _best_path(self, w: str, known: int, last: list[int], start: list[int], total: list[float]) -> None:
        """States of the prefixes of w longer than ``known``: the largest forward score."""
        ids, score = self.ids.get, self.score
        for j in range(known + 1, len(w) + 1):
            best = top = None
            for size, t in (j > 2 and self.lengths.get(w[j - 3 : j])) or self.pairs_of.get(w[j - 2 : j], ()) if j > 1 else ():
                i = j - size
                if i < 0 or t is None and (t := ids(w[i:j])) is None:
                    continue
                if best is None or total[i] + score[t] > top:
                    best, at, top = t, i, total[i] + score[t]
            t = ids(w[j - 1], _UNKNOWN)  # the character's own piece
            own = total[j - 1] + (score[t] if t >= 0 else self.unknown_score)
            if best is None or own > top:
                best, at, top = t, j - 1, own
            last.append(best)
            start.append(at)
            total.append(top)

    def _only_path(self, w: str, known: int, last: list[int], start: list[int], total: list[float]) -> None:
        """The same where pieces must stay as they are beside each other: at most one path survives, whatever its score."""
        ids, lengths, pairs, follows = self.ids.get, self.lengths.get, self.pairs_of.get, self.follows
        for j in range(known + 1, len(w) + 1):
            for size, t in (j > 2 and lengths(w[j - 3 : j])) or pairs(w[j - 2 : j], ()) if j > 1 else ():
                i = j - size
                if i < 0 or t is None and (t := ids(w[i:j])) is None:
                    continue
                if (a := last[i]) >= 0:
                    if (r := follows[a].get(t)) is None:
                        r = self.may_follow(a, t)
                    if not r:
                        continue
                last.append(t)
                start.append(i)
                break
            else:
                last.append(ids(w[j - 1], _UNKNOWN))
                start.append(j - 1)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text).  Millions of lists are made and no cycles, so Python's
        cycle collector rests meanwhile."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        distinct, index, counts = _segments(texts)
        known = self.known
        got = dict(self.viterbi([w for w in distinct if w not in known]))
        lists = [got[w] if w in got else known[w] for w in distinct]
        known.update(itertools.islice(got.items(), max(0, REMEMBER - len(known))))
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(lens.sum()))
        off = np.cumsum(lens) - lens
        size = lens[index]
        sums = np.concatenate(([0], np.cumsum(size)))
        edge = np.concatenate(([0], np.cumsum(counts)))
        return flat[_gather(off[index], size)], np.diff(sums[edge])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of encode()'s ids: the bytes of the pieces without the first mark."""
        size = self.len[ids]
        raw = self.flat[_gather(self.off[ids], size)].tobytes()
        edge = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]


def loaded(model: str = DEFAULT_MODEL, kind: str = "bpe") -> Pieces:
    """The pieces of a model file, read once in each worker."""
    if (model, kind) not in _LOADED:
        _LOADED[model, kind] = Pieces.from_file(model, kind)
    return _LOADED[model, kind]


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. and so on."""
    n = int(size.sum())
    if not n:
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    return np.arange(n) + np.repeat(start - first, size)


SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, kind: str = "bpe") -> DataFrame:
    """One row per row of docs: its ids and their number, SHA-256 of the ids (int32, little-endian) and of the
    decoded text, and whether decoding gives the text back."""
    bound_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model, kind)

        def block(doc_ids: list, texts: list[str | None]) -> pa.RecordBatch:
            ids, counts = pieces.encode(texts)
            back = pieces.decode(ids, counts)
            edge = np.concatenate(([0], np.cumsum(counts)))
            rows = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
            raw, sha = memoryview(ids.astype("<i4").tobytes()), hashlib.sha256
            return pa.record_batch(
                [pa.array(doc_ids, pa.int64()), pa.array(counts), rows,
                 pa.array([sha(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]),
                 pa.array([sha(b.encode("utf-8", "replace")).hexdigest() for b in back]), pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)])],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip"],
            )

        for rb in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(rb["doc_id"], rb["text"], strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK_CHARS:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield block(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(step, SCHEMA)


def decode(tokens: DataFrame, model: str = DEFAULT_MODEL, kind: str = "bpe") -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give the empty text."""
    bound_batches(tokens.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model, kind)
        for rb in batches:
            lists = [x or [] for x in rb["ids"].to_pylist()]
            counts = np.array([len(x) for x in lists], np.int64)
            flat = np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum()))
            yield pa.record_batch([rb["doc_id"].cast(pa.int64()), pa.array(pieces.decode(flat, counts), pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(step, "doc_id long, text string")
