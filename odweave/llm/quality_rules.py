"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus, with DataFrame functions only.

Words and pairs of words hash to BUCKETS features.  Two multinomials with add-one smoothing are counted: of the raw corpus (all
documents) and of the trusted target (documents labelled as of good quality).  A document's score is the mean, over its features, of
ln p_target - ln p_raw; the terms are whole millionths, so that sums are exact in any order.  Beside it stand plain rules: few words,
or too many words in repeated windows, fail a document whatever its score.

The threshold is the score of the RARE-th part of trusted documents from below: one in FOLD of them is kept out of the counts for it.

Bounds: counts, threshold, scores and rules cover all documents and whole texts, target counts all trusted ones; BUCKETS weights are a constant
of the plan.  Up to NEAR trusted ids are broadcast and all work is row-local but for the sum of BUCKETS counts; beyond, rows that a bitmap of
at most 16 MB finds possibly trusted are exchanged by id, and the others stay where they are.

The SQL below still counts the TRUSTED documents with the least crc32 of their ids: up to TRUSTED documents labelled as good the two are the
same, beyond they differ.

Defined cases: a null text is an empty text, which has no features, score 0 and fails for its few words; rows with a null doc_id take
part and are never trusted; rows that repeat a doc_id are scored each; labels that repeat a doc_id trust it if any of them does; without
trusted documents all weights are 0 and only the rules decide; without trusted documents to calibrate on, the threshold is null and
the rules decide; an empty table gives an empty result; other columns may have any name that does not begin with ``_qr_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm.common import bitmap_filter, fold_column

#: Features; trusted documents of the SQL; one in FOLD of them calibrates; one in RARE of those may fall below the threshold.
BUCKETS, TRUSTED, FOLD, RARE = 10_000, 20_000, 5, 1_000
#: Trusted ids that are broadcast at most.
NEAR = 20_000
#: Rules: least number of words, words of a window, largest percentage of words in repeated windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30  # WINDOW: a power of two
#: Scores are compared with thresholds in steps of 1 / STEPS.
UNIT, STEPS = 1_000_000, 1_000
GAP = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), where value is evaluated once however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_words(docs: DataFrame) -> DataFrame:
    """docs with the words of each text."""
    return docs.withColumn("_qr_words", F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP), ""))


def code(word: Column) -> Column:
    return F.crc32(word.cast("binary"))


def bucket_of_pair(a: Column, b: Column) -> Column:
    """The bucket of two neighbours, from their codes."""
    return (a * 31 + b * 17 + 7) % BUCKETS


def _after(items: Column, n: int) -> Column:
    """The items without the first n."""
    return F.slice(items, F.lit(n + 1), F.size(items))


def _joined(n: int):  # noqa: ANN202
    """Of an array, the hashes of each item and the one n further (the last n are of one item only)."""
    return lambda h: F.zip_with(h, _after(h, n), lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column) -> Column:
    """Words in windows that are found twice or more.  Hashes of 2, 4 and 8 words, each of two of the former; linear but for the sort
    of the windows of texts that repeat any."""
    windows, n = words, 1
    while n < WINDOW:
        windows = _let(windows, _joined(n))
        n *= 2
    windows = _let(windows, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(0))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    by_hash = lambda w: F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
    starts = lambda w: F.array_sort(F.transform(_let(by_hash(w), twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = lambda w: F.aggregate(starts(w), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    count = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.coalesce(count, F.lit(0)).cast("long")


def with_rules(rows: DataFrame) -> DataFrame:
    """rows of with_words() with the plain counts and base_failed, under names that begin with _qr_."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns(
        {
            "_qr_n_words": F.size("_qr_words").cast("long"), "_qr_word_chars": F.length(F.array_join("_qr_words", "")).cast("long"),
            "_qr_n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
            "_qr_n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"), "_qr_n_repeat_words": repeated_words(F.col("_qr_words")),
        }
    )
    return rows.withColumn("_qr_base_failed", (F.col("_qr_n_words") < LEAST_WORDS) | (100 * F.col("_qr_n_repeat_words") > MOST_REPEATED * F.col("_qr_n_words")))


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, _qr_fit): all trusted documents, and which of them are counted."""
    return labels.where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct().withColumn("_qr_fit", fold_column(FOLD) != 0)


def _with_trust(docs: DataFrame, ids: DataFrame, all_rows: bool) -> DataFrame:
    """docs (doc_id, text) with _qr_fit of the ids (null: not among them); all_rows=False: those that are among them."""
    if ids.limit(NEAR + 1).count() <= NEAR:
        return docs.join(F.broadcast(ids), "doc_id", "left" if all_rows else "inner")
    key = F.xxhash64(F.col("doc_id").cast("string"))
    keyed, keys = docs.withColumn("_qr_key", key), ids.select(key.alias("_qr_key"))
    maybe = bitmap_filter(keyed, "_qr_key", keys).drop("_qr_key").join(ids.hint("shuffle_hash"), "doc_id", "left" if all_rows else "inner")
    return maybe.unionByName(bitmap_filter(keyed, "_qr_key", keys, keep=False).drop("_qr_key").withColumn("_qr_fit", F.lit(None).cast("boolean"))) if all_rows else maybe


def learn_weights(docs: DataFrame, labels: DataFrame) -> list[int]:
    """Of each bucket, ln p_target - ln p_raw in millionths."""
    rows = with_words(_with_trust(docs.select("doc_id", "text"), trusted(labels).where("_qr_fit"), all_rows=True))
    each = rows.select(F.inline(F.arrays_zip(F.col("_qr_words").alias("v"), _after(F.col("_qr_words"), 1).alias("w"))), F.col("_qr_fit").isNotNull().alias("t"))
    each = each.select(F.explode(F.array(code(F.col("v")) % BUCKETS, bucket_of_pair(code(F.col("v")), code(F.col("w"))))).alias("b"), "t").where("b IS NOT NULL")
    counts = each.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("t").alias("target"))
    whole = Window.partitionBy()  # BUCKETS rows
    counts = counts.withColumns({"all_raw": F.sum("raw").over(whole), "all_target": F.sum("target").over(whole)})
    ratio = lambda target, raw: F.round((F.log((target + 1) / (F.col("all_target") + BUCKETS)) - F.log((raw + 1) / (F.col("all_raw") + BUCKETS))) * UNIT).cast("long")
    known = counts.select("b", ratio(F.col("target"), F.col("raw")).alias("w"), ratio(F.lit(0), F.lit(0)).alias("unseen"), "all_target").collect()
    if not known or not known[0]["all_target"]:
        return [0] * BUCKETS
    out = [known[0]["unseen"]] * BUCKETS
    for r in known:
        out[r["b"]] = r["w"]
    return out


def with_score(rows: DataFrame, weights: list[int]) -> DataFrame:
    """rows of with_words() with the score."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    of = lambda b: F.get(table, b.cast("int"))
    terms = lambda u: F.zip_with(u, _after(u, 1), lambda a, b: of(a % BUCKETS) + F.coalesce(of(bucket_of_pair(a, b)), F.lit(0)))
    total = F.aggregate(_let(F.transform("_qr_words", code), terms), F.lit(0).cast("long"), lambda x, y: x + y)
    n = 2 * F.size("_qr_words") - 1
    return rows.withColumn("_qr_score", F.when(n > 0, total / n / UNIT).otherwise(0.0))


def threshold(docs: DataFrame, labels: DataFrame, weights: list[int]) -> float | None:
    """The least score to keep: of trusted documents that were not counted and pass the rules, one in RARE is below its step."""
    held = _with_trust(docs.select("doc_id", "text"), trusted(labels).where("NOT _qr_fit"), all_rows=False)
    steps = with_score(with_rules(with_words(held)), weights).where("NOT _qr_base_failed").groupBy(F.floor(F.col("_qr_score") * STEPS).alias("s")).agg(F.count("*").alias("n"))
    so_far = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)  # steps are a bounded number of rows
    at = steps.select("s", F.sum("n").over(so_far).alias("below"), F.sum("n").over(Window.partitionBy()).alias("all")).where(F.col("below") > F.floor(F.col("all") / RARE)).agg(F.min("s").alias("s")).first()["s"]
    return None if at is None else at / STEPS


def _judged(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None) -> DataFrame:
    source = docs if source is None else source
    weights = learn_weights(source, labels)
    least = threshold(source, labels, weights)
    verdict = F.lit(True) if least is None else F.col("_qr_score") >= F.lit(least)
    return with_score(with_rules(with_words(docs)), weights).withColumn("_qr_kept", ~F.col("_qr_base_failed") & verdict)


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def annotate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of the rules, score and verdict of every document."""
    return _judged(docs.select("doc_id", "text"), labels).select("doc_id", *(F.col(f"_qr_{c}").alias(c) for c in OUT))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose texts are kept, with all their columns."""
    return _judged(docs, labels, docs.select("doc_id", "text")).where("_qr_kept").select(*docs.columns)


#: crc32 of a list of bytes in SQL: the byte table, then one step a byte.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))"


def crc_sql(text: str, table: str = "crc") -> str:
    """SQL of the unsigned crc32 of a text, given a column with CRC_TABLE."""
    data = f"list_transform(range(1, length(hex({text})) + 1, 2), lambda i: ('0x' || substr(hex({text}), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), tab AS MATERIALIZED (SELECT {CRC_TABLE} AS crc),
w AS MATERIALIZED (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS c FROM (SELECT rid, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS v FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w))),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM win WHERE c > 1) GROUP BY rid),
base AS (SELECT rid, w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
rules AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base),
tokens AS MATERIALIZED (SELECT rid, doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
codes AS MATERIALIZED (SELECT word, {crc_sql("word")} AS u FROM (SELECT DISTINCT word FROM tokens), tab),
u AS MATERIALIZED (SELECT rid, doc_id, u, lead(u) OVER (PARTITION BY rid ORDER BY i) AS v FROM tokens JOIN codes USING (word)),
f AS MATERIALIZED (SELECT rid, doc_id, u % {BUCKETS} AS b FROM u UNION ALL SELECT rid, doc_id, (u * 31 + v * 17 + 7) % {BUCKETS} FROM u WHERE v IS NOT NULL),
good AS MATERIALIZED (SELECT doc_id, c % {FOLD} <> 0 AS fit FROM (SELECT doc_id, {crc_sql("doc_id::VARCHAR")} AS c FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), tab) ORDER BY c, doc_id LIMIT {TRUSTED}),
counts AS (SELECT b, count(*) AS raw, count(*) FILTER (fit) AS target FROM f LEFT JOIN good USING (doc_id) GROUP BY b),
sums AS (SELECT sum(raw) AS r, sum(target) AS t FROM counts),
weights AS (SELECT b, CASE WHEN t > 0 THEN round((ln((target + 1) / (t + {BUCKETS})) - ln((raw + 1) / (r + {BUCKETS}))) * {UNIT})::BIGINT ELSE 0 END AS w FROM counts, sums),
scored AS (SELECT rules.*, coalesce(s.v, 0) AS score FROM rules LEFT JOIN (SELECT rid, sum(w)::BIGINT / count(*) / {UNIT} AS v FROM f JOIN weights USING (b) GROUP BY rid) s USING (rid)),
steps AS (SELECT s, sum(count(*)) OVER (ORDER BY s) AS below, sum(count(*)) OVER () AS total FROM (SELECT floor(score * {STEPS})::BIGINT AS s FROM scored JOIN good USING (doc_id) WHERE NOT fit AND NOT base_failed) GROUP BY s),
least AS (SELECT min(s) / {STEPS} AS v FROM steps WHERE below > total // {RARE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, NOT base_failed AND (v IS NULL OR score >= v) AS kept FROM scored, least
"""
