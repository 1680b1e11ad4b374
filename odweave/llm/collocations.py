"""Phrase collocations: candidates from sketch upper bounds, counted exactly by Aho-Corasick automata.

1. Texts are cut into shards (batches of about BATCH_WORDS words of one task).  Every shard hashes its words and phrases of up to
   LONGEST words into a sketch of 2**40 slots and sends its slots and their counts, dealt by ranges of slots.  The sum of a slot is an
   upper bound of the count of each phrase in it, and every shard is told which of its slots reach LEAST.
2. The phrases of a shard whose bound reaches LEAST are its candidates.  They compile into an automaton, each between delimiters
   (" w1 w2 "), so that only whole words match and neighbours may share a delimiter.  It scans the shard's text, in which pieces are
   set apart, and counts all matches, overlapping ones too.
3. Counts are summed over shards, and phrases below LEAST go.  A candidate has the same bound in every shard, so no occurrence of
   a phrase that stays is missed, whatever shares its slot.

An automaton has the candidates of one shard, so its size does not grow with the corpus, and scans the words that candidates cover; nothing is broadcast or collected.
Single words, which are parts of phrases only, are counted by their 64-bit hashes in a shard.

Scores are whole numbers of decimals of 38 digits: exact to counts of 10**12.

Defined cases: a null text is an empty text and adds nothing; a null lang is ``und`` (and is one language with rows that have
that very lang); doc_id is not read, rows that repeat count each; languages without a phrase that reaches LEAST have no row; an empty table
gives an empty result; texts are read whole, and one of any length stays in one shard; ties of scores go by count, then by phrase in UTF-8
byte order, so ranks are unique; only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm import common as C
from odweave.llm.common import PACKED, bound_batches, bucket_bounds, by_batch, expand, expand_sorted, pack, packed_batch, packed_exchange, parts_of, repeatable, squeeze, squeeze_sorted, stored, text_size

#: Words of a shard, and keys of a bucket of the sketch, about.
BATCH_WORDS, BUCKET_KEYS = 1_000_000, 2_000_000
#: Longest phrase, least count, best phrases of a language; a longer phrase that has this percentage of a shorter one's count hides it.
LONGEST, LEAST, TOP, HIDES = 3, 10, 2000, 50
UND, SALTS = "und", 32
_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _PIECE.copy()
_GAP[[0x20, 0x09]] = True
#: Slots are the leading 40 bits of a hash.
_SLOT = ~np.uint64((1 << 24) - 1)


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[bytes, int]:
    """(the words of texts, lower-cased, each with a blank after it, and a line feed as a word of its own after each piece; number of words)."""
    gap = _GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(~gap & (np.append(True, gap[:-1]) | edge[:-1]))
    if not len(starts):
        return b"", 0
    ends = np.flatnonzero(~gap & (np.append(gap[1:], True) | edge[1:])) + 1
    piece = np.cumsum(_PIECE[data])[starts] + np.searchsorted(off, starts, side="right")
    last = np.append(piece[1:] != piece[:-1], True)
    size = ends - starts
    room = size + np.where(last, 3, 1)
    at = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)] = C._LOWER[data[~gap]]
    out[(at + size + 1)[last]] = 10
    return out.tobytes(), len(starts)


def grams(text: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a normalised text: starts and ends of its words, and for phrases of 1, 2 .. words the positions of their first words and
    their 64-bit hashes, which depend on the language."""
    data = np.frombuffer(text, np.uint8)
    blank = data == 32
    ends = np.flatnonzero(blank)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    words = C.mix(_hashes(data, starts, ends) ^ _lang_hash(lang))
    broken = data[starts] == 10
    out = []
    for k in range(1, LONGEST + 1):
        n = max(len(words) - k + 1, 0)
        whole = np.flatnonzero(~np.any([broken[j : n + j] for j in range(k)], 0)) if n else np.zeros(0, np.int64)
        g = words[:n].copy()
        for j in range(1, k):
            g = g * np.uint64(0xD6E8FEB86659FD93) + words[j : n + j]
        out.append((whole, C.mix(g[whole] + np.uint64(k))))
    return starts, ends, out


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each word, some CHUNK_BYTES at a time."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + C.CHUNK_BYTES)))
        part, a, b = data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(C._TABLE[part] * C.powers(C._BASE, len(part)), out=sums[1:])
        out[i:j] = (sums[b] - sums[a]) * C.powers(C.inverse(C._BASE), len(part) + 1)[a]
        i = j
    return C.mix(out)


def _lang_hash(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode(), np.uint8)
    return np.bitwise_xor.reduce(C._TABLE[data] * C.powers(C._BASE, len(data) + 1)[1:], initial=np.uint64(len(data)))


def _send(n_buckets: int):  # noqa: ANN202
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            name = f"{task}-{number}"
            number += 1
            texts = {lang: b"".join(parts) for lang, parts in sorted(held.items())}
            held.clear()
            squeezed = zstandard.ZstdCompressor(level=1)
            yield packed_batch([(name, -1, 0, pack(*(x for lang, t in texts.items() for x in (lang.encode(), squeezed.compress(t)))), None)])
            slots, counts = np.unique(np.concatenate([h for lang, t in texts.items() for _, h in grams(t, lang)[2]]) & _SLOT, return_counts=True)
            edges = bucket_bounds(slots, n_buckets)
            for i in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[i], edges[i + 1])
                yield packed_batch([(name, i, 0, None, pack(squeeze_sorted(slots[part]), squeeze(counts[part].astype(np.uint32))))])

        for rb in batches:
            langs = rb["lang"].fill_null(UND)
            for lang in pc.unique(langs).to_pylist():
                for _, _, data, off in C.text_chunks(rb["text"].filter(pc.equal(langs, lang))):
                    text, n = normalised(data, off)
                    if n:
                        held.setdefault(lang, []).append(text)
                        waiting += n
                    if waiting >= BATCH_WORDS:
                        yield from flush()
                        waiting = 0
        if held:
            yield from flush()

    return step


def _bounds(least: int):  # noqa: ANN202
    def reduce(slices: list[bytes]) -> list[bytes]:
        """Which slots of each slice reach ``least``."""
        raw = [parts_of(s) for s in slices]
        slots = [expand_sorted(r[0]) for r in raw]
        distinct, at = np.unique(np.concatenate(slots), return_inverse=True)
        reach = np.bincount(at, np.concatenate([expand(r[1]) for r in raw]), len(distinct)) >= least
        return [pack(np.array([len(s)], np.int64).tobytes(), squeeze(np.packbits(x))) for s, x in zip(slots, np.split(reach[at], np.cumsum([len(s) for s in slots])[:-1]), strict=True)]

    return reduce


COUNTS = "lang string, k int, phrase string, f long"


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order, by sorting."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def matches(text: bytes, phrases: list[bytes]) -> np.ndarray:
    """How often each of the phrases (each between blanks) is in a text, overlapping matches included."""
    import ahocorasick

    if not phrases:  # an automaton of none cannot be made
        return np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    for i, phrase in sorted(enumerate(phrases), key=itemgetter(1)):  # neighbours share their nodes
        automaton.add_word(phrase.decode(), i)
    automaton.make_automaton()
    found = np.fromiter(map(itemgetter(1), automaton.iter(text.decode())), np.int64)
    return np.bincount(found, minlength=len(phrases))


def covered(text: bytes, starts: np.ndarray, ends: np.ndarray, cover: np.ndarray) -> bytes:
    """The covered words of a text; a line feed stands for each run of others."""
    data = np.frombuffer(text, np.uint8).copy()
    kept = np.repeat(cover, ends - starts + 1)
    run = np.flatnonzero(~cover & np.append(True, cover[:-1]))
    data[starts[run]] = 10
    kept[starts[run]] = kept[ends[run]] = True
    return b" " + data[kept].tobytes()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard and language: number of words (k = 0), and the counts of its candidates.  Single words are counted by their hashes."""
    import zstandard

    for name, states, answers in by_batch(batches):
        if len(states) != 1:
            raise RuntimeError(f"shard {name} met {len(states)} states")  # cannot happen: see repeatable()
        raw = parts_of(states[0])
        texts = [(raw[i].decode(), zstandard.ZstdDecompressor().decompress(raw[i + 1])) for i in range(0, len(raw), 2)]
        reach = [(int(np.frombuffer(n, np.int64)[0]), expand(bits)) for n, bits in map(parts_of, answers)]
        reach = np.concatenate([np.unpackbits(bits, count=n).astype(bool) for n, bits in reach])
        every = [grams(t, lang) for lang, t in texts]
        slots = distinct(np.concatenate([h for _, _, g in every for _, h in g]) & _SLOT)
        if len(slots) != len(reach):
            raise RuntimeError(f"shard {name} met answers for other slots")
        slots = slots[reach]
        for (lang, text), (starts, ends, by_length) in zip(texts, every, strict=True):
            phrases, lengths, f = [], [], []
            cover = np.zeros(len(starts), bool)
            for k, (first, h) in enumerate(by_length, 1):
                place = np.searchsorted(slots, h & _SLOT).clip(max=max(len(slots) - 1, 0))
                hit = np.flatnonzero(slots[place] == h & _SLOT) if len(slots) else np.zeros(0, np.int64)
                _, one, often = np.unique(h[hit], return_index=True, return_counts=True)
                one = first[hit[one]]
                phrases += [text[a:b] for a, b in zip(starts[one].tolist(), ends[one + k - 1].tolist(), strict=True)]
                lengths += [k] * len(one)
                if k == 1:
                    f = often.tolist()
                else:
                    for j in range(k):
                        cover[first[hit] + j] = True
            f += matches(covered(text, starts, ends, cover), [b" " + p + b" " for p in phrases[len(f) :]]).tolist()
            names = [None, *(p.decode() for p in phrases)]
            yield pa.record_batch([pa.array([lang] * len(names)), pa.array([0, *lengths], pa.int32()), pa.array(names, pa.string()), pa.array([len(by_length[0][0]), *f], pa.int64())], ["lang", "k", "phrase", "f"])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, f): exact counts of the phrases of 1 to LONGEST words that are found ``least`` times or more, and under k = 0 and a null phrase the
    number of words of each language.  A stored table."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = repeatable(docs.select("text", "lang"))
    _, size = text_size(docs)
    n_buckets = n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (5 * BUCKET_KEYS))
    found = packed_exchange(docs.mapInArrow(_send(n_buckets), PACKED), n_buckets, _bounds(least), n_parts).mapInArrow(_scan, COUNTS)
    return stored(found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= least)), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of all phrases of two words and more, at their lowest-scoring cut (ties to the shortest first part)."""
    parts = counts.where("k > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    cuts = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("rest"))
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r")}
    score = F.call_function("div", wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)"), wide["l"] * wide["r"])
    best = cuts.select("lang", "phrase", "k", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("s")).groupBy("lang", "phrase", "k", "a").agg(F.min("s").alias("s"))
    return best.select("lang", "phrase", "k", "a", "s.l", "s.r", "s.score")


def hidden(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longest): of the phrases inside longer ones, the largest count of a longer one."""
    w, n = F.split("phrase", " "), F.col("k")
    longer = counts.where("k > 2").select("lang", "f", w.alias("w"), n.alias("n"), F.explode(F.sequence(F.lit(2), n - 1)).alias("m"))
    inner = longer.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("i"))
    return inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("longest"))


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """Each language's ``top`` phrases by score, count and phrase: (lang, rank, phrase, a, l, r, n, score).  The best of SALTS parts of
    a language are found before they meet, so a task has SALTS * top rows of a language at most."""
    counts = phrase_counts(docs, least)
    rows = scored(counts).join(hidden(counts), ["lang", "phrase"], "left").where(f"longest IS NULL OR 100 * longest < {HIDES} * a")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")




SQL = rf"""
WITH p AS (SELECT coalesce(lang, '{UND}') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM g) GROUP BY lang, k, phrase),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= {LEAST}),
parts AS (SELECT lang, k, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS head, array_to_string(ws[cut + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
cuts AS (SELECT p.*, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, array_to_string(ws[i : i + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < {HIDES} * a),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
