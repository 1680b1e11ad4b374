"""The ten operators against brute force, public libraries and held-out rows, with the defined edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odweave.llm import common, deleted_interpolation, exact_dedup, langid, mixing, neighbours, ngram_join, pii, queries, sentencepiece_trie, substring, toxicity
from tests.conftest import SF, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _c string, sum long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long, repeated and tied rows, with extra columns."""
    long = " ".join(f"w{i % 977} x{i * 7919 % 1013}" for i in range(30000))
    base = " ".join(f"term{i * i % 211}" for i in range(90))
    rows = [
        (1, None, "en", None, 0, "a", 1), (2, "", "en", "s", 0, "b", 2), (3, "  \n\t ", None, "s", 4, None, None), (4, long, "en", "t", 1, "c", 4), (5, long, "en", "t", 1, "c", 5),
        (6, base, "fr", "s", 1, "d", 6), (7, base + " end", "fr", None, 1, "d", 7), (7, base + " end", "fr", None, 1, "d", 7), (8, "One two", "de", "t", 7, "e", 8), (9, "one TWO", "de", "t", 7, "e", 9),
        (10, "+1 (582) 555-1234 a@b.co 1.2.3.4, 4111 1111 1111 1111, 999.1.1.1", "en", "t", 1, "f", 10), (None, "one two", None, None, None, None, None), (11, "日本語 ▁ x" * 3, "ja", "u", 2, "g", 11),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# --- 1 ---------------------------------------------------------------------------------------


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return {k: [m.span() for m in re.finditer(p, t) if good[k](m[0])] for k, p in pats.items()}


@settings(max_examples=1500, deadline=None)
@given(st.text("ab1.@ -+()9205", max_size=60))
def test_base_spans(t):
    assert pii.base_spans(t) == brute_spans(t)


def test_pii_query(spark, odd, docs, texts):
    got = {r["doc_id"]: r for r in queries.op1_pii(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        b = brute_spans(t or "")
        line = ",".join(f"{k}:{x}:{y}" for k in pii.KINDS for x, y in b[k])
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(b[k]) for k in pii.KINDS]
        assert set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and pii.find(odd.limit(0)).count() == 0
    assert [r["n_phone"] + r["n_email"] + r["n_ip"] + r["n_card"] for r in rows if r["doc_id"] == 10] == [4]
    assert "[EMAIL]" in pii.redact(odd).where("doc_id = 10").first()["text"]


def test_pii_long_text_is_linear():
    pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" + "+" * 1000)


def test_pii_model_adds_disguised_and_keeps_clean():
    r = np.random.default_rng(0)
    rows = []
    for i in range(400):
        n = r.integers(0, 10, 10)
        t = f"please call +1 ({n[0]}{n[1]}{n[2]}) 555-{n[3]}{n[4]}{n[5]}{n[6]} or mail ab{i}@mail{n[7]}.example.com now"
        rows += list(pii.labelled(t, i))
    x = np.array([f for f, _ in rows])
    m = pii.Model(x, np.array([y for _, y in rows]), 0.98)
    t = "mail jane.doe (at) example (dot) com today, the year 2024-05-17 was fine"
    assert [k for k, _, _ in m.added(t, pii.base_spans(t))] == ["email"]


def test_pii_takes_neighbours_apart_and_leaves_overlaps():
    """Overlapping candidates, ties, many spans in one text, in time that grows with the text."""
    r = np.random.default_rng(0)
    rows = []
    for i in range(500):
        n = "".join(str(x) for x in r.integers(0, 10, 7))
        rows += list(pii.labelled(f"please call +1 (58{n[0]}) 555-{n[1:5]} or mail ab{i}@mail{n[5]}.example.com on 2024-05-{n[5]}1 at {n[:2]}.{n[2:4]} for {n[:3]} {n[3:6]}", i))
    m = pii.Model(np.array([f for f, _ in rows]), np.array([y for _, y in rows]), 0.98)
    t = "call 582-555-1234 582-555-9876 now"
    assert sorted(t[a:b] for k, a, b in m.added(t, pii.base_spans(t)) if k == "phone") == ["582-555-1234", "582-555-9876"]
    many = "call 582-555-1234, " * 3000
    got = m.added(many, pii.base_spans(many))
    assert len(got) == 3000 and m.added(many, pii.base_spans(many)) == got
    spans = sorted((a, b) for _, a, b in got)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    taken = pii.Taken([(5, 9), (7, 12), (20, 30)])
    assert [taken.free(*s) for s in ((0, 5), (0, 6), (12, 20), (11, 13), (29, 40), (30, 31))] == [True, False, True, False, False, True]


# --- 2 and 4 ---------------------------------------------------------------------------------


def test_langid(spark, odd, duck):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = langid.held_out_predictions(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["rejected"] for r in got]) < 0.01
    o = {r["doc_id"]: r for r in langid.held_out_predictions(odd).collect()}
    assert o[1]["lang_pred"] == o[2]["lang_pred"] == o[3]["lang_pred"] == "und" and o[1]["rejected"]
    assert langid.held_out_predictions(odd.limit(0)).count() == 0
    assert langid.keep_identified(odd).columns == odd.columns


def test_language_stage_rejects_junk_and_keeps_clean_text(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    model = langid.fit(d)
    kept = langid.keep_identified(d, model).count()
    assert d.count() - kept <= 10  # texts without a letter among them
    r = np.random.default_rng(1)
    junk = ["".join(chr(c) for c in r.integers(33, 127, 400)) for _ in range(60)] + ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz   "), 400)) for _ in range(60)]
    junk += [" ".join(str(v) for v in r.integers(0, 99999, 60)) for _ in range(20)] + ["日本語の文章です。" * 20, "Это русский текст о погоде. " * 8, "0x3fa9 = {foo: bar[12]; return x->y;} " * 10]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(junk)], "doc_id long, text string")
    assert langid.keep_identified(t, model).count() <= 3


def test_language_of_the_nearest_centroid(spark, docs):
    """The prediction is the language of the largest cosine, by a plain loop over centroids."""
    import pyarrow as pa

    model = langid.fit(docs)
    some = docs.where("text IS NOT NULL").orderBy("doc_id").limit(60).collect()
    langs, scores, _ = model.predict(pa.array([r["text"] for r in some], pa.large_string()))
    for r, lang, score in zip(some, langs, scores, strict=True):
        counts = np.zeros(langid.DIM)
        for _, _, c, _ in langid.vectors(pa.array([r["text"]], pa.large_string())):
            counts = c[0].astype(float)
        v = np.log1p(counts) * model.idf
        v = v / (np.linalg.norm(v) or 1)
        cos = [float(v @ c) for c in model.centroids]
        best = int(np.argmax(cos))
        if lang != "und":
            assert lang == model.names[model.owner[best]] and score == pytest.approx(cos[best], abs=1e-4)


def test_toxicity(spark, odd):
    sf = SF.replace("0.001", "0.1")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.held_out_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    auc = np.mean([[(p > n) + (p == n) / 2 for n in neg] for p in pos])
    assert auc > 0.95 and np.mean([(r["predicted"] == 1) == (r["toxic"] == 1) for r in got]) > 0.97
    none = labels.limit(0)
    assert all(r["predicted"] == 0 for r in toxicity.held_out_scores(odd, none).collect())
    assert toxicity.held_out_scores(odd.limit(0), labels).count() == 0
    for toxic in (0, 1):
        one = spark.createDataFrame([(i, toxic) for i in range(1, 12)] + [(None, 1 - toxic)], "doc_id long, toxic int")
        assert {r["predicted"] for r in toxicity.held_out_scores(odd, one).collect()} == {toxic}


def test_restoring_takes_linear_time():
    import time

    r = toxicity.Restorer(toxicity.CharModel(np.ones((27, 27, 27))))
    for t in ("ab" * 100_000 + "aaa", '"' * 100_000 + "a$b", "\"'(" * 40_000 + "x@y", "a * b * c " * 20_000, "a.b." * 50_000):
        began = time.time()
        r.restore(t)
        assert time.time() - began < 5
    assert r.restore("* * * * 1 0 1") == "* * * * 1 0 1"


def test_deobfuscation():
    words = "stupid idiot moron pathetic worthless clown trash the and for with this that person".split()
    tri = np.zeros((27, 27, 27))
    for w in words * 50:
        s = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            tri[a, b, c] += 1
    r = toxicity.Restorer(toxicity.CharModel(tri))
    for shown, plain_ in (("m0r0n", "moron"), ("1d10t", "idiot"), ("s t u p i d", "stupid"), ("c.l.o.w.n", "clown"), ("p@thet1c", "pathetic"), ("traaaash", "trash"), ("w0rthl3$$", "worthless")):
        assert plain_ in r.restore(f"you {shown} there")
        data = np.frombuffer(f"you {shown} there".encode(), np.uint8)
        assert toxicity.disguised(data, np.array([0, len(data)]))[0]
    assert r.restore("The plain text!! stays.") == "the plain text!! stays."


def test_texts_that_restoring_changes_are_flagged():
    restorer = toxicity.Restorer(toxicity.CharModel(np.ones((27, 27, 27))))
    texts = ["s·t·u·p·i·d", "f * c k", "a £ 1", "st€pid", "you w£rd", "¡diot", "u < c k", "say ab.cde.fgh", "the s t u", "a##b", "noooo", "é s t u", "\u2003$tupid", "", "plain text"]
    r = np.random.default_rng(0)
    signs = list("aabBcst  ..--_··**#@$!|+(<€£¡0134 \"')é\n\u2003日,")
    texts += ["".join(r.choice(signs, r.integers(0, 9))) for _ in range(20000)]
    for some in (texts, [f"word {t}" for t in texts], [f"{t} word" for t in texts]):
        raw = [t.encode() for t in some]
        flags = toxicity.disguised(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))))
        changed = np.array([restorer.restore(t) != t.lower() for t in some])
        assert not [t for t, f, c in zip(some, flags, changed, strict=True) if c and not f]
        assert not flags[13:15].any()


# --- 3 ---------------------------------------------------------------------------------------


def check_scores(rows, texts):
    t = {i: [*WORD.findall(lower(x)), None] for i, x in texts}
    learn = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2
    c = collections.Counter()
    for i, x in texts:
        if learn(i):
            c.update([*WORD.findall(lower(x)), None])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = t[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(x in c for x in w), n, not learn(r["doc_id"]))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))


def test_scores(docs, odd, texts):
    rows = deleted_interpolation.score(docs).collect()
    assert len(rows) == len(texts)
    check_scores(rows, texts.items())
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    o = odd.collect()
    check_scores(deleted_interpolation.score(odd).collect(), [(r["doc_id"], r["text"]) for r in o])
    assert deleted_interpolation.score(odd.limit(0)).count() == 0


def test_model_is_a_distribution(docs, texts):
    """Summed over the vocabulary and one unknown token the interpolated probabilities are 1."""
    counted = deleted_interpolation.count(docs)
    w = counted.weights
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and (w > 0)[1:].all()


def test_scores_by_plain_counting(spark, docs):
    """Every score by dictionaries of counts and the learned weights; the weights against expectation-maximisation on single events."""
    some = docs.orderBy("doc_id").limit(120)
    counted = deleted_interpolation.count(some)
    w = counted.weights
    texts = {r["doc_id"]: [*WORD.findall(lower(r["text"])), "</s>"] for r in some.collect()}
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    learn = {i for i in texts if fold(i, 7) != 2}
    gone = {i for i in learn if fold(i, 56) // 7 == 3}

    def counts(ids):
        c, two, before = collections.Counter(), collections.Counter(), collections.Counter()
        for i in ids:
            c.update(texts[i])
            pairs = list(zip(["<s>", *texts[i][:-1]], texts[i], strict=True))
            two.update(pairs)
            before.update(v for v, _ in pairs)
        return c, two, before

    bucket = lambda n: 0 if n == 0 else min(1 + int(math.log2(n)), 25)
    c, two, before = counts(learn)
    n, v = sum(c.values()), len(c)
    for r in deleted_interpolation.scores(counted).collect():
        want = 0.0
        for a, b in zip(["<s>", *texts[r["doc_id"]][:-1]], texts[r["doc_id"]], strict=True):
            l2, l1, l0 = w[bucket(before[a])]
            want += math.log10(l2 * two[a, b] / max(before[a], 1) + l1 * c[b] / n + l0 / (v + 1))
        assert r["score"] == pytest.approx(want, rel=1e-9)
    for a in list(before)[:5]:  # a distribution over the vocabulary and one unknown token
        l2, l1, l0 = w[bucket(before[a])]
        assert sum(l2 * two[a, b] / before[a] + l1 * c[b] / n + l0 / (v + 1) for b in c) + l0 / (v + 1) == pytest.approx(1.0)
    kept, kept2, kept_before = counts(learn - gone)
    events = [(kept_before[a], kept2[a, b], kept[b]) for i in gone for a, b in zip(["<s>", *texts[i][:-1]], texts[i], strict=True)]
    p = np.array([[e[1] / max(e[0], 1), e[2] / sum(kept.values()), 1 / (v + 1)] for e in events])
    own = np.array([bucket(e[0]) for e in events])
    gain = lambda x: np.log((p * x[own]).sum(1)).sum()
    assert len(events) > 50 and gain(w) >= gain(np.tile([1 / 3, 1 / 3, 1 / 3], (26, 1))) and gain(w) >= gain(np.tile(w[1:].mean(0), (26, 1))) - 0.02 * len(events)


def test_scores_without_learning_documents(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = deleted_interpolation.score(spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")).collect()
    assert len(rows) == 3 and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)


def test_em_raises_held_out_likelihood():
    r = np.random.default_rng(1)
    classes = (r.integers(1, 10, 300) * 512 + r.integers(0, 60, 300)) * 512 + r.integers(1, 80, 300)
    events = r.integers(1, 20, 300)
    w = deleted_interpolation.learn_weights(np.unique(classes), events[: len(np.unique(classes))], 10_000, 500)
    c = np.unique(classes)
    b, k2, k1 = c // 512 // 512, c // 512 % 512, c % 512
    p = np.stack([np.where(k2 > 0, 2.0 ** (-(k2 - 1) / 8), 0), 2.0 ** ((k1 - 1) / 8) / 10_000, np.full(len(c), 1 / 501)], 1)
    ll = lambda x: (events[: len(c)] * np.log((p * x).sum(1))).sum()
    assert ll(w[b]) > ll(np.full((len(c), 3), 1 / 3))


# --- 5 and 9 ---------------------------------------------------------------------------------


def shingles(t, k):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(texts, k, percent):
    s = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if s[a] and s[b]:
                c = len(s[a] & s[b])
                if 100 * c >= percent * (len(s[a]) + len(s[b]) - c):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_join(spark, docs, texts, k, percent):
    """The table, and edited copies of one text at every rate: chains of links near the threshold."""
    r = np.random.default_rng(k)
    base = [f"q{i}" for i in range(120)]
    more = {}
    for i in range(60):
        w = list(base)
        for j in r.choice(120, int(r.integers(0, 9)), replace=False):
            w[j] = f"z{r.integers(1000)}"
        more[1000 + i] = " ".join(w[: int(r.integers(100, 121))])
    more |= {2000 + i: " ".join(f"s{j}" for j in range(i)) for i in range(14)}
    some = dict(sorted(texts.items())[:90]) | more
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(df, k, percent).collect()}
    assert got == brute_groups(some, k, percent)


def test_signatures_lose_no_pair():
    r = np.random.default_rng(7)
    for _ in range(600):
        n, p = int(r.choice([1, 2, 3, 6, 9, 14, 22, 40, 90, 250])), int(r.choice([50, 80, 85, 95]))
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        d = min(int(r.integers(0, 2 + 2 * n * (100 - p) // (100 + p))), n - 1)
        b = np.unique(np.concatenate((a[d:], r.integers(0, 2**63, int(r.integers(0, d + 1)), dtype=np.uint64))))
        a = np.unique(a)
        c = len(np.intersect1d(a, b))
        if 100 * c >= p * (len(a) + len(b) - c):
            s, o = ngram_join.signatures(np.concatenate((a, b)), np.array([len(a), len(b)]), p)
            assert set(s[o == 0].tolist()) & set(s[o == 1].tolist())


def test_join_of_large_groups(spark, monkeypatch):
    """One hub of near copies of which most are not linked with the first, and copies of one text, in several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "GROUP", 16)
    r = np.random.default_rng(3)
    base = [f"h{i}" for i in range(100)]
    texts = {}
    for i in range(70):
        w = list(base)
        for j in r.choice(100, int(r.integers(0, 4)), replace=False):
            w[j] = f"y{r.integers(10_000)}"
        texts[i] = " ".join(w)
    texts |= {100 + i: " ".join(base) for i in range(40)} | {200 + i: " ".join(base[:60]) + f" tail{i}" for i in range(5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {q["doc_id"]: (q["n_shingles"], q["component_id"]) for q in ngram_join.groups(df).collect()}
    assert got == brute_groups(texts, 4, 85)
    with pytest.raises(ValueError):
        ngram_join.groups(df, percent=40)


def test_join_odd_rows(odd):
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.groups(odd).collect()}
    assert got[5] == 4 and got[9] == 8 and got[None] == 8 and got[7] == 6 and got[1] == 1 and got[3] == 3
    assert ngram_join.groups(odd).count() == odd.count() and ngram_join.groups(odd.limit(0)).count() == 0
    kept = ngram_join.dedup(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 8, 10, 11}


def brute_windows(rows, window):
    own = {}
    big = 1 << 62
    words = [(big if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            own[key] = min(own.get(key, big), i)
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if own[tuple(w[k : k + window])] < i:
                gone[k : k + window] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((None if i == big else i, len(w), int(gone.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("window", [50, 7])
def test_substring(spark, docs, odd, window, monkeypatch):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = substring.dedup(df, window).collect()
        assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == brute_windows(rows, window)
        assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    monkeypatch.setattr(substring, "MAX_BITS", 1 << 10)  # too many hits for a bitmap: each document's own list
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = substring.dedup_digest(odd, window).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == brute_windows(rows, window)
    assert substring.dedup(odd.limit(0)).count() == 0


def test_index_compacts(spark):
    index = substring.FingerprintIndex()
    hits = []
    for b in range(4):
        df = spark.createDataFrame([(b, 10 * b), (99, 10 * b + 1), (b, 10 * b)], "fp long, doc_id long")
        hits.append(sorted(r["fp"] for r in index.add(df).collect()))
    assert hits == [[], [99], [99], [99]]
    index.compact()
    assert [k for k, _ in index.runs] == [2] and index.runs[0][1].count() == 12


def test_index_keeps_frequent_fingerprints_apart(spark, monkeypatch):
    monkeypatch.setattr(substring, "LEAST_HOT", 5)
    index = substring.FingerprintIndex()
    many = [(-7, d) for d in range(40)] + [(d, d) for d in range(20)]
    assert [r["fp"] for r in index.add(spark.createDataFrame(many, "fp long, doc_id long")).collect()] == [-7]
    assert index.runs[0][1].frequent == [-7] and index.runs[0][1].count() == 60
    assert sorted(r["fp"] for r in index.add(spark.createDataFrame([(-7, 99), (3, 99), (50, 99)], "fp long, doc_id long")).collect()) == [-7, 3]
    got = index.add(spark.createDataFrame([*((50, d) for d in range(100, 140)), (-7, 200)], "fp long, doc_id long"))
    assert sorted(r["fp"] for r in got.collect()) == [-7, 50]
    index.compact(spark)
    assert sum(r.count() for _, r in index.runs) == 104
    index.drop(spark)


def digests(rows):
    return sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in rows)


@pytest.mark.parametrize("least_hot", [1000, 3])
def test_increments_equal_one_run(spark, docs, tmp_path, monkeypatch, least_hot):
    """Two adds of a persisted index, opened anew between them, give the rows of one run; a lost batch leaves no trace."""
    monkeypatch.setattr(substring, "LEAST_HOT", least_hot)
    monkeypatch.setattr(substring, "HOT_GROUPS", 1 << 20)
    path = f"file://{tmp_path}/index"
    known = docs.where("doc_id IS NOT NULL")
    middle = known.selectExpr("percentile_approx(doc_id, 0.5) AS m").first()["m"]
    parts = [known.where(f"doc_id <= {middle}"), known.where(f"doc_id > {middle}")]
    got = []
    for part in parts:
        lost = substring.FingerprintIndex.open(spark, path)
        lost.dedup(part, batches=2, keep_text=False).count()  # never committed
        index = substring.FingerprintIndex.open(spark, path)
        got += index.dedup(part, batches=2, keep_text=False).collect()
        index.commit(spark)
    whole = digests(substring.dedup_digest(known).collect())
    assert digests(got) == whole
    assert sum(r["n_removed"] for r in substring.dedup_digest(parts[1]).collect()) < sum(r["n_removed"] for r in got if r["doc_id"] > middle)
    again = substring.FingerprintIndex.open(spark, path).dedup(parts[0], keep_text=False).collect()  # a batch met before has no new window
    assert all(r["n_removed"] == r["n_words"] for r in again if r["n_words"] >= 50)
    with pytest.raises(ValueError):
        substring.FingerprintIndex.open(spark, path, 7)


def test_runs_merge_without_exchange(spark):
    index = substring.FingerprintIndex()
    for b in range(2):
        index.add(spark.createDataFrame([(i, b) for i in range(50)], "fp long, doc_id long"))
    a, b = (index._cold(spark, r) for _, r in index.runs)
    with substring._sorted_buckets(spark):
        plan = a.select("fp").join(b.select("fp").hint("merge"), "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.drop(spark)


# --- 6, 7 and 8 ------------------------------------------------------------------------------


def test_exact(spark, duck, odd):
    got = [r.asDict() for r in queries.op6_exact_dedup(spark, SF).collect()]
    want = duck.execute(exact_dedup.SQL).df().astype(object).to_dict("records")
    cols = sorted(want[0])
    assert plain(got, cols) == plain(want, cols)
    o = {}
    for r in exact_dedup.annotate(odd).collect():
        o.setdefault(r["doc_id"], r)
    assert (o[1]["keep_id"], o[1]["group_size"], o[2]["kept"], o[4]["keep_id"], o[7]["group_size"], o[None]["kept"]) == (2, 2, True, 5, 2, True)
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [2, 3, 5, 6, 7, 8, 9, 10, 11, None]))
    clash = odd.select("doc_id", "text", *(F.col("source").alias(c) for c in ("kept", "keep_id", "group_size", "text_sha256", "bucket", "slot", "n")))
    again = exact_dedup.exact_dedup(clash)
    assert again.columns == clash.columns and sorted(map(str, again.collect())) == sorted(map(str, {r for r in clash.collect() if str(r["doc_id"]) in "2 3 5 6 7 8 9 10 11 None".split()}))
    assert exact_dedup.annotate(odd.limit(0)).count() == 0
    assert exact_dedup.annotate(odd, max_bits=1 << 15).where("group_size > 1").count() == 6


def test_neighbours(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = v.collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in queries.op7_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in [i for i in ids if i % 50 == 0]:
        at = int(np.flatnonzero(ids == q)[0])
        s = u @ u[at]
        best = sorted(((-s[j], ids[j]) for j in range(len(ids)) if j != at))[:5]
        assert len(got[q]) == 5 and all(abs(s[int(np.flatnonzero(ids == i)[0])] - c) < 1e-12 for i, c in got[q])
        hits += len({i for _, i in best} & {i for i, _ in got[q]})
    assert hits / (5 * len(got)) >= 0.9
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    r = [(x["rank"], x["vec_id"], x["score"]) for x in neighbours.search(odd, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert r == [(1, 5, 1.0), (2, 6, 1.0)]
    assert neighbours.search(odd.limit(0), F.lit(True)).count() == 0


def test_neighbours_in_many_blocks(spark):
    """Recall of one block and of 20 blocks of rows with 4 of queries; the order within a block is Spearman's footrule."""
    v = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    rows = v.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for blocks, queries_a_block in ((1, 256), (20, 10)):
        got = collections.defaultdict(set)
        for r in neighbours.search(v, F.col("vec_id") % 50 == 0, block_rows=-(-len(rows) // blocks), block_queries=queries_a_block).collect():
            got[r["query_id"]].add(r["vec_id"])
        hits = 0
        for at in np.flatnonzero(ids % 50 == 0):
            s = u @ u[at]
            s[at] = -2
            hits += len(set(ids[np.lexsort((ids, -s))[:5]].tolist()) & got[ids[at]])
        assert hits / (5 * len(got)) >= 0.9 and len(got) == 40
    block = neighbours.Block(u, neighbours.spread_pivots(u[:600], 64), 32)
    perm = neighbours.permutations(u[:1], block.pivots, block.k)[0]
    rank = np.full(len(block.pivots), block.k)
    rank[perm] = np.arange(block.k)
    all_ = neighbours.permutations(u, block.pivots, block.k)
    distance = []
    for p in all_:  # Spearman's footrule over both prefixes, pivots outside one counting as rank k
        own = np.full(len(block.pivots), block.k)
        own[p] = np.arange(block.k)
        distance.append(int(np.abs(own - rank).sum()))
    best = block.nearest(perm, 50)
    order = np.lexsort((np.arange(len(u)), distance))[:50]
    assert sorted(best.tolist()) == sorted(order.tolist())


def test_neighbours_repeated_ids(spark):
    """An id with several vectors is one candidate, by its nearest, and one query, by its least."""
    v = spark.createDataFrame([(0, [1.0, 0.0], "a"), (0, [0.0, 1.0], "a"), (1, [1.0, 0.1], "b"), (1, [0.0, 2.0], "b"), (2, [1.0, 1.0], "c"), (2, [1.0, 1.0], "c")], "vec_id long, embedding array<float>, rank string")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.search(v, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, round(0.5**0.5, 6))]


def test_neighbours_of_many_copies(spark):
    """A third of the rows hold one vector: more copies in a block than are compared exactly."""
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 16)).astype(np.float32)
    x[::3] = x[0]
    x[1] = x[0] + np.float32(0.01) * x[2]
    ids = r.permutation(4000)
    v = spark.createDataFrame([(int(i), row.tolist()) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    asked = [*sorted(int(i) for i in ids[::3])[::150], int(ids[1])]
    got = collections.defaultdict(list)
    for row in neighbours.search(v, F.col("vec_id").isin(asked)).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append(row["vec_id"])
    copies = sorted(int(i) for i in ids[::3])
    assert got == {q: [i for i in copies if i != q][:5] for q in asked}


def test_mixing(spark, docs, odd):
    for df in (docs, odd):
        rows = mixing.annotate(df, ["doc_id", "source"]).collect()
        src = collections.defaultdict(list)
        for r in rows:
            src[r["source"]].append(r)
        names = sorted(src, key=lambda s: (s is None, s or ""))
        w = {s: (i % 3) + 1 for i, s in enumerate(names)}
        size = {s: sum(r["size"] for r in src[s]) for s in names}
        level, left = 0.0, set(names)
        while True:
            level = (sum(size.values()) - sum(3 * size[s] for s in names if s not in left)) / sum(w[s] for s in left)
            over = {s for s in left if w[s] * level > 3 * size[s] + 1e-9}
            if not over:
                break
            left -= over
        for s in names:
            target = w[s] * level if s in left else 3 * size[s]
            assert src[s][0]["target"] == pytest.approx(target) and src[s][0]["source_size"] == size[s]
            taken = sum(r["taken"] for r in src[s])
            assert abs(taken - target) <= max(r["size"] for r in src[s]) / 2 + 1
            assert all(0 <= r["taken"] <= 3 * r["size"] for r in src[s])
    again = lambda: sorted(map(str, mixing.annotate(docs).collect()))
    assert again() == again() and mixing.annotate(odd.limit(0)).count() == 0
    m = mixing.mix(odd)
    assert m.columns == odd.columns


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 400))
def test_fit_budget_is_optimal_enough(hist, budget):
    l, c = np.array(list(hist)), np.array(list(hist.values()))  # noqa: E741
    t = mixing.fit_budget(l, c, budget)
    assert (t >= 0).all() and (t <= c).all()
    base = np.minimum(c, np.floor(c * min(1, budget / (l * c).sum())).astype(int))
    reach = {int((l * base).sum())}
    for x, n in zip(l, c - base, strict=True):
        reach = {r + int(x) * k for r in reach for k in range(n + 1)}
    assert abs((l * t).sum() - budget) <= min(abs(r - budget) for r in reach)  # taking back may come nearer still


def test_fit_budget_with_very_long_documents():
    for hist, budget, far in (({5_000_000: 2, 3000: 50, 7: 9}, 5_021_000, 0), ({5_000_000: 2, 3000: 50, 7: 9}, 100_013, 950), ({4_000_000: 2, 3000: 50, 7: 9}, 100_013, 950), ({5_000_000: 1}, 4_900_000, 100_000), ({5_000_000: 1}, 2_400_000, 2_400_000)):
        l, c = np.array(list(hist)), np.array(list(hist.values()))  # noqa: E741
        t = mixing.fit_budget(l, c, budget)
        assert (t >= 0).all() and (t <= c).all() and abs(int((l * t).sum()) - budget) == far


# --- 10 and pipeline -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_trie.Pieces.from_file()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("  \n\t.,theanINGtion123é日🙂　▁'\"-"), max_size=80))
def test_pieces_equal_the_library(pieces, t):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_trie.DEFAULT_MODEL)
    ids, n = pieces.encode([t, None, t])
    assert ids[: n[0]].tolist() == sp.encode(t) and n[1] == 0
    assert pieces.decode(ids, n)[0] == t.replace("▁", " ")


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t▁\x01é\ud800", max_size=30)), max_size=6))
def test_segments_are_those_of_the_pattern(texts):
    """Arrow's split and Python's give the words of the pattern; an empty word has no pieces."""
    words, index, counts = sentencepiece_trie._segments(texts)
    at = [words[i] for i in index]
    edge = np.concatenate(([0], np.cumsum(counts)))
    got = [[w for w in at[a:b] if w] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    assert got == [sentencepiece_trie._SEGMENT.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    assert len(words) == len(set(words))


def test_scores_decide_in_a_unigram_model():
    """Against the best of all segmentations; of equal scores the longer last piece."""
    import itertools

    table = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -4.0, "ab": -3.9, "bc": -5.0, "abc": -7.1, "▁a": -3.5, "▁ab": -6.5, "cab": -6.0, "aa": -4.0}
    p = sentencepiece_trie.Pieces(list(table), list(table.values()), {}, kind="unigram")

    def best(w):
        out = []
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:], strict=False)]
            if all(x in table for x in parts):
                out.append((sum(table[x] for x in parts), parts))
        return max(out, key=lambda o: o[0])[0]

    words = ["▁" + "".join(t) for n in range(1, 6) for t in itertools.product("abc", repeat=n)]
    for w, ids in p.viterbi(words):
        assert "".join(p.piece[i] for i in ids) == w and sum(table[p.piece[i]] for i in ids) == pytest.approx(best(w))
    assert [p.piece[i] for i in dict(p.viterbi(["▁aa"]))["▁aa"]] == ["▁a", "a"] and dict(p.viterbi(["aa"]))["aa"] == [list(table).index("aa")]
    with pytest.raises(ValueError):
        sentencepiece_trie.Pieces(["a"], [0.0], {}, kind="word")


def test_sentencepiece_query(spark, odd, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_trie.DEFAULT_MODEL)
    rows = queries.op10_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] and r["ids"] == sp.encode(texts[r["doc_id"]]) for r in rows)
    e = sentencepiece_trie.encode(odd)
    assert {r["doc_id"]: r["n_tokens"] for r in e.collect()}[1] == 0 and e.where("NOT round_trip").count() == 1
    back = {r["doc_id"]: r["text"] for r in sentencepiece_trie.decode(e).collect()}
    assert back[8] == "One two" and sentencepiece_trie.encode(odd.limit(0)).count() == 0


def test_pipeline(spark, odd, docs, texts):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language", "exact dedup", "near duplicates", "mixing", "tokens"]
    at = docs
    for name, stage in P.STAGES[:-1]:
        before = at
        at = common.stored(stage(spark, at, SF), "test")
        assert at.columns == docs.columns
        ids = [r["doc_id"] for r in at.select("doc_id").collect()]
        if name == "language":
            assert len(ids) >= 0.98 * before.count()
        elif name == "exact dedup":
            b = {r["doc_id"]: r["text"] for r in before.collect()}
            assert sorted(ids) == sorted({t: i for i, t in sorted(b.items())}.values())
        elif name == "near duplicates":
            g = brute_groups({r["doc_id"]: r["text"] for r in before.collect()}, 5, 80)
            assert sorted(ids) == sorted({c for _, c in g.values()})
    out = P.run(spark, SF)
    assert out.count() == at.count() and out.where("round_trip").count() == out.count()
    clash = odd.select(*docs.columns, *(F.lit(1).alias(c) for c in ("kept", "keep_id", "size", "target", "component_id", "text_sha256", "rejected")))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, clash, SF).columns == clash.columns and stage(spark, clash, SF).count() >= 1
    for _, stage in P.STAGES:
        assert stage(spark, odd.select(*docs.columns), SF).count() >= 1
        assert stage(spark, odd.select(*docs.columns).limit(0), SF).count() == 0
