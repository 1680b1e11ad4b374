"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 hashes every text to two slots and keeps, as a bitmap, the slots that were hit more than
once.  A text that occurs twice has hit both of its slots twice, so a row with a slot that is not
in the bitmap is unique for certain.  Pass 2 probes the bitmap: unique rows go straight through;
only the others shuffle, by their SHA-256, which decides.

The bitmap has at most ``max_bits`` bits (2**27: 16 MB broadcast, whatever the input); beyond about
10**7 rows per 2**27 bits more rows are found possibly repeated, which costs shuffle and changes no
result.

Defined cases: a null text is an empty text; rows with a null doc_id take part, and stay only where
their whole group has none; rows that repeat a doc_id and text are each returned (both are ``kept``
if that doc_id stays); an empty table gives an empty result; other columns of the input pass through
untouched and may have any name that does not begin with ``_dd_`` (those of the result too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import join_group, stored

#: Slots for each row (a power of two is taken), and the bound of the bitmap.
BITS_PER_ROW, MAX_BITS = 16, 1 << 27


def _slots(h: Column, bits: int) -> list[Column]:
    """Positions from 1, as the bitmap functions count."""
    return [F.pmod(h, F.lit(bits)) + 1, F.pmod(F.xxhash64(h, F.lit(7)), F.lit(bits)) + 1]


def repeated_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): the slots that more than one row hit, 32768 a bitmap.  Slot counts are
    pre-aggregated before their shuffle, so a text with a third of all rows is two small counts a task."""
    hits = hashes.select(F.explode(F.array(*_slots(F.col("_dd_h"), bits))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return hits.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def _probe(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """rows with _dd_maybe: both slots of _dd_h are in the bitmap."""
    small = F.broadcast(bitmaps)
    flags = []
    for i, slot in enumerate(_slots(F.col("_dd_h"), bits)):
        b, m, p = f"_dd_b{i}", f"_dd_m{i}", f"_dd_p{i}"
        rows = rows.withColumns({b: F.bitmap_bucket_number(slot), p: F.bitmap_bit_position(slot)})
        rows = rows.join(small.select(F.col("bucket").alias(b), F.col("bitmap").alias(m)), b, "left")
        byte = F.conv(F.hex(F.substring(F.col(m), (F.col(p) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        flags.append(F.coalesce(F.getbit(byte, (F.col(p) % 8).cast("int")) == 1, F.lit(False)))
    return rows.withColumn("_dd_maybe", flags[0] & flags[1]).drop(*(f"_dd_{k}{i}" for k in "bmp" for i in (0, 1)), "_dd_h")


def annotate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs."""
    return _groups(docs.select("doc_id", "text"), ["doc_id"], max_bits, thin=True)


def _groups(docs: DataFrame, carry: list[str], max_bits: int, thin: bool) -> DataFrame:
    """The columns ``carry`` of docs, which have none of the result's names, and keep_id, group_size, kept and text_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = docs.select(F.xxhash64(text).alias("_dd_h"))
    rows = docs.count()
    bits = min(max_bits, 1 << max(15, (BITS_PER_ROW * max(rows, 1) - 1).bit_length()))
    bitmaps = stored(repeated_slots(hashes, bits), "bloom")
    probed = _probe(docs.select(*carry, F.sha2(text, 256).alias("_dd_sha"), F.xxhash64(text).alias("_dd_h")), bitmaps, bits)
    if thin:  # no texts to carry: the table is small, and the texts are read twice in all
        probed = stored(probed, "probed")
    once = probed.where(~F.col("_dd_maybe")).select(
        *carry, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_dd_sha").alias("text_sha256")
    )
    maybe = probed.where("_dd_maybe").drop("_dd_maybe")
    groups = stored(maybe.groupBy("_dd_sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    again = join_group(maybe, groups, ["_dd_sha"], "group_size").select(
        *carry, "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_dd_sha").alias("text_sha256")
    )
    return once.unionByName(again)


def exact_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the largest doc_id (of rows that repeat
    doc_id and text, one)."""
    names = docs.columns
    inner = docs.toDF(*(c if c in ("doc_id", "text") else f"_dd_c{i}" for i, c in enumerate(names)))
    rows = _groups(inner, inner.columns, max_bits, thin=False).where("kept")
    rest = rows.where("group_size > 1").dropDuplicates(["doc_id", "text_sha256"])
    return rows.where("group_size = 1").unionByName(rest).select(*inner.columns).toDF(*names)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
