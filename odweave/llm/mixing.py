"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words.  A source's target is its weight's share of all words, at most ``max_repeat`` times
its own size, the excess going to the others by weight.  Whole repeats of the source come first; for
the remaining budget the documents are counted by exact length, a first share of each length is taken
in proportion, and bounded-knapsack dynamic programming over the leftover counts fills the rest, to
the word where the lengths allow it.  Which documents of a length are taken follows a seeded hash.

Only counts by (source, length) meet in one task, never documents.  Ranks within a length are
sub-dealt by 256 hash buckets, so that a source and length with a third of all rows splits.  Sources are ranked by ranges.

The table of the dynamic programming has ``TABLE`` sums at most.  A budget beyond it is first brought below it by taking the longest
documents that fit.  What is then still missing or too much is mended both ways: words too many are taken back by a second
knapsack over the documents taken; where too few can be taken, one more long document is taken and the excess given back.

Defined cases: a null text or one without words has size 0 and is never taken; a null source is a
source of its own, last in order; a null doc_id is hashed like any other; repeated rows count each;
an empty table, or one without words, gives targets of 0; clashing column names are not touched
(internal ones begin with ``_mx_``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm.common import stored
from odweave.operators.grouping import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SUB_BUCKETS = 256
#: Sums that a table of the dynamic programming holds.
TABLE = 1 << 22


def subset(lengths: np.ndarray, counts: np.ndarray, target: int) -> np.ndarray:
    """How many documents of each length (longest first; at most counts) to take so that their words come as near target as
    bounded knapsack allows, the lower of two sums as near.  A target beyond the table is brought below it, longest first."""
    take = np.zeros(len(lengths), np.int64)
    left = min(target, int((lengths * counts).sum()))
    for i in range(len(lengths)):
        if left <= TABLE:
            break
        k = min(int(counts[i]), left // int(lengths[i]))
        take[i] += k
        left -= k * int(lengths[i])
    spare = counts - take
    if left <= 0 or left > TABLE or not spare.any():
        return take
    # the nearest sum is below the next document of any length; sums beyond twice the budget are never nearer than none
    most = min(2 * left, left + int(lengths[spare > 0].max()))
    reach, full = 1, (1 << (most + 1)) - 1
    first = np.full(most + 1, -1, np.int32)  # the item with which a sum is first reached
    items: list[tuple[int, int]] = []
    for i in np.flatnonzero(spare):
        have, n = min(int(spare[i]), most // int(lengths[i])), 1
        while have > 0 and not reach >> left & 1:  # counts in binary parts
            k = min(n, have)
            new = (reach << (k * int(lengths[i]))) & full & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8)
                at = np.flatnonzero(raw)
                bit, byte = np.nonzero(raw[at][None] >> np.arange(8, dtype=np.uint8)[:, None] & 1)
                first[8 * at[byte] + bit] = len(items)
                reach |= new
            items.append((i, k))
            have, n = have - k, n * 2
    low = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    high = left + (above & -above).bit_length() - 1 if above else low
    at = low if left - low <= abs(high - left) else high
    while at:
        i, k = items[first[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near ``budget``: a proportional share of every length, a
    bounded knapsack for the rest, and one over what was taken for what is too much."""
    order = np.argsort(-lengths, kind="stable")
    ls, cs = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((ls * cs).sum())
    take = np.zeros(len(ls), np.int64)
    if total and budget > 0:
        take = np.minimum(cs, np.floor(cs * min(1.0, budget / total)).astype(np.int64))
        take += subset(ls, cs - take, budget - int((ls * take).sum()))
        missing = budget - int((ls * take).sum())
        best = take
        if missing > 0:  # the shortest document that is too long, if there is one, and then back
            longer = np.flatnonzero((cs > take) & (ls > missing))
            if len(longer):
                take = take.copy()
                take[longer[-1]] += 1
        if (over := int((ls * take).sum()) - budget) > 0:
            take = take - subset(ls, take, over)
        best = min((best, take), key=lambda t: abs(int((ls * t).sum()) - budget))
        take = best
    out = np.zeros(len(ls), np.int64)
    out[order] = take
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes: (_mx_key, source, source_size, n), one row a source.  Adds target.  Water filling: each round one
    aggregate gives the level at which the sources not yet at their limit share what is left."""
    rank = F.col("_mx_rank") - 1
    w = numbered(sizes, [F.col("source").asc_nulls_last()], "_mx_rank").withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    w = stored(w.withColumn("most", F.col("source_size") * F.lit(float(max_repeat))), "sources")
    total = float(w.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        at_most = F.col("w") * F.lit(level) > F.col("most")
        r = w.agg(F.sum(F.when(at_most, F.col("most")).otherwise(0.0)), F.sum(F.when(at_most, 0.0).otherwise(F.col("w")))).first()
        new = (total - (r[0] or 0.0)) / r[1] if r[1] else level
        if new <= level or not total:
            break
        level = new
    return w.select("_mx_key", "source_size", "n", F.least(F.col("w") * F.lit(max(level, 0.0)), F.col("most")).alias("target"))


def annotate(docs: DataFrame, carry: list[str] | None = None, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Every row of docs (columns ``carry``, by default doc_id alone) with size, source_size, target,
    times (how often the mix takes it) and taken (size x times)."""
    thin = carry is None
    carry = carry or ["doc_id"]
    rows = docs.select(
        *carry,
        F.col("source").alias("_mx_source"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_mx_key"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("_mx_size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_mx_hash"),
    ).withColumn("_mx_b", F.pmod("_mx_hash", F.lit(SUB_BUCKETS)).cast("int"))
    if thin:
        rows = stored(rows, "sizes")
    counts = stored(rows.groupBy("_mx_key", "_mx_source", "_mx_size", "_mx_b").agg(F.count("*").alias("n")), "lengths")
    sizes = counts.groupBy("_mx_key", F.col("_mx_source").alias("source")).agg(F.sum(F.col("_mx_size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    targets = stored(source_targets(sizes, weights, max_repeat), "targets")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        budget = int(round(target))
        times = min(budget // size, max_repeat) if size else 0
        take = fit_budget(pdf["_mx_size"].to_numpy(), pdf["n"].to_numpy(), budget - times * size) if times < max_repeat else 0
        return pd.DataFrame({"_mx_key": pdf["_mx_key"], "_mx_size": pdf["_mx_size"], "_mx_times": times, "_mx_take": take})

    lengths = counts.where("_mx_size > 0").groupBy("_mx_key", "_mx_size").agg(F.sum("n").alias("n"))
    fitted = lengths.join(targets.drop("n"), "_mx_key").groupBy("_mx_key").applyInPandas(fit, "_mx_key string, _mx_size long, _mx_times long, _mx_take long")
    before = F.sum("n").over(Window.partitionBy("_mx_key", "_mx_size").orderBy("_mx_b").rowsBetween(Window.unboundedPreceding, -1))
    plan = counts.select("_mx_key", "_mx_size", "_mx_b", "n", F.coalesce(before, F.lit(0)).alias("_mx_before")).join(fitted, ["_mx_key", "_mx_size"], "left")
    plan = stored(plan.join(targets.drop("n"), "_mx_key").withColumnsRenamed({"source_size": "_mx_all", "target": "_mx_target"}).drop("n"), "plan")
    cell = ["_mx_key", "_mx_size", "_mx_b"]
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_mx_hash", "doc_id"))
    ranked = rows.withColumn("_mx_rank", rank).join(plan, cell)
    times = F.coalesce(F.col("_mx_times"), F.lit(0)) + (F.col("_mx_before") + F.col("_mx_rank") <= F.coalesce(F.col("_mx_take"), F.lit(0))).cast("long")
    return ranked.select(
        *carry,
        F.col("_mx_size").alias("size"), F.col("_mx_all").alias("source_size"), F.col("_mx_target").alias("target"),
        times.alias("times"), (F.col("_mx_size") * times).alias("taken"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix has them: a document taken n times is n rows, one not taken is none."""
    names = docs.columns
    inner = docs.toDF(*(f"_mx_c{i}" if c not in ("doc_id", "text", "source") else c for i, c in enumerate(names)))
    rows = annotate(inner, inner.columns, **options).where("times > 0")
    return rows.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*(F.col(c).alias(n) for c, n in zip(inner.columns, names, strict=True)))
