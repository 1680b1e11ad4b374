"""Quality rules, name join, collocations, and near-duplicate rows against brute force, with their edge cases."""

import collections
import math
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odweave.llm import collocations, name_join, ngram_join, quality_rules, queries
from tests.conftest import SF, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def shop(duck):
    for t in ("clients", "vendors"):
        duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return duck


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_name_join", "op13_collocations"])
def test_queries_give_the_rows_of_their_sql(spark, shop, name):
    got = queries.queries()[name](spark, SF)
    want = shop.execute(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(want)
    round_ = lambda rows: [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in rows]
    assert plain(round_([r.asDict() for r in got.collect()]), cols) == plain(round_(want.astype(object).to_dict("records")), cols)


# --- 11 --------------------------------------------------------------------------------------


def plain_rules(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    repeated = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def plain_scores(docs, labels):
    """Scores of {doc_id: text} by counting, in the order of the module's docstring."""
    crc = lambda i: zlib.crc32(str(i).encode())
    code = lambda w: zlib.crc32(w.encode())
    n = quality_rules.BUCKETS

    def features(t):
        u = [code(w) for w in WORD.findall(t or "")]
        return [x % n for x in u] + [(x * 31 + y * 17 + 7) % n for x, y in zip(u, u[1:], strict=False)]

    good = {i for i, q in labels if q == 1}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in docs:
        raw.update(features(t))
        if i in good and crc(i) % quality_rules.FOLD:
            target.update(features(t))
    w = lambda b: round(1e6 * (math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))))
    return [sum(map(w, f)) / len(f) / 1e6 if (f := features(t)) and target else 0.0 for _, t in docs]


TEXTS = [
    (1, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten a b c"), (2, None), (3, ""), (4, " \t\x0b\n\n"), (5, "x" * 50_000), (6, "é ü\r日本 #$%& <b>|*\n é ü\n\né ü\n"),
    (7, "the cat sat on the mat and saw that the dog was not in the garden of the old house"), (7, "the cat sat on the mat"), (None, "the cat"), (8, "a " * 3000), (9, "plain words of a trusted kind " * 2), (10, "plain words of another trusted kind"),
]


def test_quality_rules_against_counting(spark):
    docs = spark.createDataFrame([(i, t, "k", 0.5) for i, t in TEXTS], "doc_id long, text string, score string, kept double")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 1), (9, 1, 0), (10, 1, 0), (1, 0, 0), (None, 1, 1), (99, 1, 0)], LABELS)
    got = quality_rules.annotate(docs, labels).collect()
    assert len(got) == len(TEXTS)
    want = collections.Counter((i, *plain_rules(t), round(s, 9)) for (i, t), s in zip(TEXTS, plain_scores(TEXTS, [(7, 1), (9, 1), (10, 1)]), strict=True))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert collections.Counter((r["doc_id"], *(r[c] for c in names), round(r["score"], 9)) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab \n\t#é", max_size=120), min_size=1, max_size=8))
def test_rules_on_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality_rules.with_rules(quality_rules.with_words(docs)).collect()
    for r in rows:
        assert [r[f"_qr_{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == list(plain_rules(texts[r["doc_id"]]))


def test_quality_rules_count_all_trusted_documents(spark, monkeypatch):
    """no cap on trusted documents, and none on those beyond the broadcast."""
    texts = [*TEXTS, *((i, f"w{i % 7} w{i % 5} of a text v{i}") for i in range(100, 160))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    good = [(i, 1, 0) for i, _ in texts if i is not None and i % 3 == 0 or i == 7]
    want = collections.Counter((i, round(s, 9)) for (i, _), s in zip(texts, plain_scores(texts, [g[:2] for g in good]), strict=True))
    monkeypatch.setattr(quality_rules, "TRUSTED", 2)
    for near in (100, 2):
        monkeypatch.setattr(quality_rules, "NEAR", near, raising=False)
        got = quality_rules.annotate(docs, spark.createDataFrame(good, LABELS)).collect()
        assert collections.Counter((r["doc_id"], round(r["score"], 9)) for r in got) == want
        kept = {(r["doc_id"], r["n_words"]): r["kept"] for r in got} if near == 100 else kept
    assert kept == {(r["doc_id"], r["n_words"]): r["kept"] for r in got}


def test_quality_rules_without_labels_or_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in quality_rules.annotate(docs, none).collect())
    assert quality_rules.annotate(docs.limit(0), none).count() == 0


def test_quality_rules_tell_junk_from_prose(spark):
    """On a small table: of labelled rows, nearly all good ones that pass the rules stay, nearly all bad ones go."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    r = quality_rules.annotate(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.when(~F.col("base_failed"), F.col("kept").cast("int"))).alias("k"), F.avg(F.col("kept").cast("int")).alias("all")).collect()
    by = {x["quality"]: x for x in r}
    assert by[1]["k"] > 0.98 and by[0]["all"] < 0.05


# --- 12 --------------------------------------------------------------------------------------


def plain_osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=1500, deadline=None)
@given(st.text("abé", max_size=9), st.text("abé", max_size=9), st.integers(0, 3))
def test_distance(a, b, most):
    assert name_join.alignment_distance(a, b, most) == min(plain_osa(a, b), most + 1)


def mutated(rng, name):
    for _ in range(rng.integers(0, 4)):
        i = int(rng.integers(0, len(name) + 1))
        kind = rng.integers(0, 4)
        name = name[:i] + "xyé"[rng.integers(0, 3)] + name[i:] if kind == 0 else name[:i] + name[i + 1 :] if kind == 1 else name[:i] + "q" + name[i + 1 :] if kind == 2 else name[:i] + name[i + 1 : i + 2] + name[i : i + 1] + name[i + 2 :]
    return name


@pytest.mark.parametrize("most", [1, 2])
def test_similar_names_against_all_pairs(spark, monkeypatch, most):
    """Names of all lengths, with edits of every kind, small blocks, grams that all share a slot."""
    import numpy as np

    rng = np.random.default_rng(11)
    syllables = ["an", "ber", "ko", "niez", "ström", "ley", "o", "ma", "日本"]
    left = {"".join(rng.choice(syllables, rng.integers(1, 7))) for _ in range(220)} | {"a", "ab", "ba", "x" * 400, "x" * 398 + "yx"}
    right = {mutated(rng, x) for x in sorted(left)} | {"b", "", "x" * 399}
    monkeypatch.setattr(name_join, "BLOCK", 20)
    frame = lambda names: spark.createDataFrame([(x, i) for i, x in enumerate([*sorted(names), *sorted(names)[:5], None])], "name string, n int")
    want = {(a, b, d) for a in left for b in right if b and (d := plain_osa(a, b) if abs(len(a) - len(b)) <= most and len(a) < 100 else 9 if len(a) < 100 or len(b) < 100 else name_join.alignment_distance(a, b, most)) <= most}
    got = [tuple(r) for r in name_join.similar(frame(left), frame(right), most).select("name", "rname", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {d for _, _, d in want} == set(range(most + 1))
    monkeypatch.setattr(name_join, "gram_counts", lambda *a: [0] * name_join.SLOTS)
    assert {tuple(r) for r in name_join.similar(frame(left), frame(right), most).select("name", "rname", "distance").collect()} == want
    assert name_join.similar(frame(left), frame([]), most).count() == 0


@pytest.mark.parametrize("most", [1, 2])
def test_prefix_is_the_fewest_grams_that_edits_cannot_all_spoil(spark, most):
    """By all choices of edits' places; names with repeated grams lose no pair."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    names = sorted({"".join(rng.choice([*"aab"], rng.integers(3, 13))) for _ in range(80)} | {"anna meyer", "abcdefghijklmnop", "ab" * 60})
    frame = spark.createDataFrame([(x,) for x in names], "name string")
    side, q = name_join._profiled(frame), name_join.Q
    counts, got = name_join.gram_counts(side, side), collections.defaultdict(dict)
    order = {r["g"]: (counts[r["s"]], r["g"]) for r in side.select(F.explode("grams").alias("g")).distinct().withColumn("s", name_join._slot(F.col("g"))).collect()}
    for r in name_join._prefix(side, counts, most).collect():
        got[r["name"]][(*order[r["gram"]], r["place"])] = r["gram"]
    assert set(got) == {x for x in names if len(x) >= most * (q + 1) + q}
    spoilt = lambda places: any(all(any(e <= p <= e + q for e in edits) for p in places) for edits in itertools.combinations_with_replacement(places, most))
    for name, grams in got.items():
        all_ = sorted((*order[name[i : i + q]], i) for i in range(len(name) - q + 1))
        assert sorted(grams) == all_[: len(grams)] and all(name[i : i + q] == g for (_, _, i), g in grams.items())
        places = [i for _, _, i in sorted(grams)]
        assert not spoilt(places) and spoilt(places[:-1])
    assert min(map(len, got.values())) < most * (q + 1) + 1
    want = {(a, b, d) for a in names for b in names if abs(len(a) - len(b)) <= most and (d := plain_osa(a, b)) <= most}
    assert {tuple(r) for r in name_join.similar(frame, frame, most).select("name", "rname", "distance").collect()} == want


def test_names_are_joined_without_broadcasts(spark, monkeypatch):
    """Small files, of which Spark would broadcast what an explosion makes: tens of rows a name in the driver."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(name_join, "stored", lambda df, name, f=name_join.stored: plan(df) or f(df, name))
    assert int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) > 0
    got = queries.op12_name_join(spark, SF)
    assert got.count()
    plan(got)
    assert len(plans) == 5 and sum("SortMergeJoin" in p for p in plans) == 2 and not any("Broadcast" in p for p in plans)


def test_link_counts_clients(spark):
    clients = spark.createDataFrame([(5, "anna meyer"), (3, "anna meyer"), (9, "anna meyre"), (None, "anna meyer"), (7, None), (8, "")], "client_id long, name string")
    vendors = spark.createDataFrame([(1, "anna meyer"), (2, "anna meyer"), (3, "bob"), (4, None), (None, "anna meyerxx")], "vendor_id long, name string")
    got = {(r["vendor_id"], r["distance"]): (r["n_clients"], r["first_client_id"], r["clients_crc"]) for r in name_join.link(clients, vendors).collect()}
    crc = lambda *x: sum(zlib.crc32(str(i).encode()) for i in x)
    same, near = (3, 3, crc(5, 3)), (1, 9, crc(9))
    assert got == {(1, 0): same, (1, 1): near, (2, 0): same, (2, 1): near, (None, 2): same}


def test_misspelt(spark):
    rows = [(i, n) for i, n in enumerate(["Ab", "x", "", None, "été là", "ABCDEF", "ABCDEF", "ABCDEF", "ABCDEF"])] + [(None, "keep")]
    for r in name_join.misspelt(spark.createDataFrame(rows, "vendor_id long, name string")).collect():
        n, i = dict(rows)[r["vendor_id"]], r["vendor_id"]
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if n and h % 2 == 0 and len(n) >= 2:
            p = h % (len(n) - 1)
            n = n[:p] + n[p + 1] + n[p] + n[p + 2 :]
        assert r["name"] == n


# --- 13 --------------------------------------------------------------------------------------


def plain_counts(docs):
    f = collections.defaultdict(collections.Counter)
    for t, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def plain_mine(docs, top, least):
    out = []
    for lang, f in plain_counts(docs).items():
        cand = {p: c for p, c in f.items() if " " in p and c >= least}
        rows = []
        for p, a in cand.items():
            w = p.split(" ")
            cuts = [(10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            if not any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * c >= 50 * a for q, c in cand.items()):
                rows.append((-s, -a, p.encode(), p, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        n = sum(c for p, c in f.items() if " " not in p)
        out += [(lang, i, p, -a, x, y, n, -s) for i, (s, a, _, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return set(out)


def test_collocations_against_counting(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    words = ["a", "b", "Ab", "é", "日", "x-y", "\x00", "the", "THE", "cat\x85"]
    gaps = [" ", "\t", "  ", ". ", ",", "\n", ";!", "\x0b"]
    docs = [("".join(rng.choice(words) + gaps[min(int(rng.geometric(0.6)) - 1, 7)] for _ in range(rng.integers(0, 60))), str(rng.choice(["en", "de", "und", "x"])) if rng.random() < 0.9 else None) for _ in range(120)]
    docs += [(None, "en"), ("", "en"), (" .,", None), ("solo", "zz"), ("a b a b a b " * 500, "long"), ("w" * 300_000, "long")] + [docs[0]] * 3
    monkeypatch.setattr(collocations, "BATCH_WORDS", 150)
    df = spark.createDataFrame([(i, t, lang, 1.0) for i, (t, lang) in enumerate(docs)], "phrase long, text string, lang string, score double").repartition(3)
    for top, least in ((2000, 3), (4, 2)):
        got = collocations.mine(df, top, least)
        assert {tuple(r) for r in got.collect()} == plain_mine(docs, top, least)
    assert collocations.mine(df.limit(0)).count() == 0
    counts = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(df, 1).where("k > 0").collect()}
    assert counts == {(lang, p): c for lang, f in plain_counts(docs).items() for p, c in f.items()}


def test_matches_share_delimiters():
    assert collocations.matches(b" a a a a \n a ", [b" a ", b" a a ", b" a a a ", b" aa "]).tolist() == [5, 3, 2, 0]


def test_covered_words_keep_their_neighbours_apart():
    import numpy as np

    text, n = collocations.normalised(np.frombuffer("one two three four. five six".encode(), np.uint8), np.array([0, 28]))
    starts, ends, _ = collocations.grams(text, "en")
    assert n == 6 and text == b"one two three four \n five six \n "
    keep = np.array([1, 1, 0, 1, 0, 1, 0, 0], bool)
    assert collocations.covered(text, starts, ends, keep) == b" one two \n four \n five \n "


def test_scores_pass_64_bits(spark):
    a, l, r = 9 * 10**11, 10**12, 95 * 10**10
    counts = spark.createDataFrame([("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a), ("en", 0, None, 5 * 10**12)], collocations.COUNTS)
    assert collocations.scored(counts).first()["score"] == 10**6 * a * a // (l * r)


# --- near duplicates by row ----------------------------------------------------------------------


def test_dedup_judges_each_text_of_a_doc_id(spark):
    w = " ".join(f"term{i}" for i in range(60))
    u, q, z = ("alpha beta " + " ".join(f"{c}{i}" for i in range(50)) for c in "uqz")
    rows = [(5, w, 1), (None, w, 2), (None, u, 3), (9, w + " more", 4), (9, q, 5), (7, z, 6), (7, z, 7), (None, None, 8), (11, "", 9)]
    kept = ngram_join.dedup(spark.createDataFrame(rows, "doc_id long, text string, _nj_id int"))
    assert kept.columns == ["doc_id", "text", "_nj_id"]
    assert sorted(r["_nj_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]


# --- personal data: recall of added spans -----------------------------------------------------------


def test_recall_of_disguised_personal_data_by_kind(spark):
    """Planted in prose of the sample table, in forms that the base patterns miss (two digits between dots would be base addresses); a span counts as found if it is covered."""
    import numpy as np

    from odweave.llm import pii

    rng = np.random.default_rng(21)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def card():
        d = "4" + num(14)
        return d + next(c for c in "0123456789" if pii.luhn(d + c))

    def planted(kind):
        if kind == "email":
            a, b = "".join(rng.choice(list("abcdefgh"), 6)), "".join(rng.choice(list("mnopqrst"), 7))
            return [f"{a}.{b} (at) {b}.org", f"{a} at {b} dot com", f"{a}[at]{b}[dot]net", f"{a * 12} (at) {b} (dot) org"][rng.integers(4)]
        if kind == "ip":
            return rng.choice(["[.]", "(.)"]).join(str(int(x)) for x in rng.integers(1, 255, 4))
        if kind == "card":
            d = card()
            return [".".join(d[i : i + 4] for i in range(0, 16, 4)), "/".join(d[i : i + 4] for i in range(0, 16, 4)), "  ".join(d[i : i + 4] for i in range(0, 16, 4)), "/".join(d[i : i + 2] for i in range(0, 16, 2))][rng.integers(4)]
        return [f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"][rng.integers(3)]

    base = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    prose = [r["text"] for r in base.where("length(text) > 300").orderBy("doc_id").limit(60).collect()]
    cue = {"email": "Write to ", "ip": "The server is ", "card": "Pay with card ", "phone": "Call "}
    rows, where = [], {}
    for kind in pii.KINDS:
        for i in range(60):
            text, what = prose[i][:250], planted(kind)
            head = f"{text}\n{cue[kind]}"
            key = 10_000_000 + len(rows)
            rows.append((key, f"{head}{what} today. {text}"))
            where[key] = (kind, len(head), len(head) + len(what))
    model = pii.fit(spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet"))  # a table with enough base spans to learn from
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).select("doc_id", "spans").collect()
    hits = collections.Counter()
    for r in found:
        kind, a, b = where[r["doc_id"]]
        spans = [(k, int(x), int(y)) for k, x, y in (s.split(":") for s in filter(None, r["spans"].split(",")))]
        hits[kind] += any(k == kind and x <= a and y >= b for k, x, y in spans)
    recall = {k: hits[k] / 60 for k in pii.KINDS}
    print("recall of disguised spans by kind:", recall)
    assert min(recall.values()) >= 0.9, recall


def test_candidates_have_no_caps():
    from odweave.llm import pii

    many = ".".join("4111111111111111")
    assert ("card", 0, len(many)) in pii.candidates(many)
    local = "a" * 83
    assert pii.candidates(f"x {local} (at) example.org")[0] == ("email", 2, 2 + 83 + len(" (at) example.org"))
