"""Edit-distance name join by positional q-gram prefix filtering.

Distance is the optimal string alignment: insertions, deletions, substitutions and exchanges of two neighbours, of code points, with no
substring edited twice.  One such edit spoils at most Q + 1 of a name's q-grams, at neighbouring places (an exchange touches two code points).  A name's
prefix is the fewest of its q-grams, in an order common to all names, that ``most`` edits cannot all spoil: the places of most + 1 of them are more than Q
apart, so it has between most + 1 and most * (Q + 1) + 1.  Names within ``most`` edits share a gram of both prefixes, at places that fit: if lengths
differ by a and places by b, |b| edits or more are before the gram and |a - b| or more behind it, in all at most ``most``.  (Each prefix keeps a gram unspoilt.
Were every such gram outside the other name's prefix, each prefix would end before the other's; equal grams go by place, and what is unspoilt keeps its order.)

1. Distinct names only take part; what stands for their rows is joined later.
2. Grams are ordered rare first, by counts over both sides in SLOTS slots (an array of fixed size; grams of a slot are ordered by
   themselves, so that the order is total and any counts give right results).
3. The inverted index has a row for each gram of a left name's prefix, under (gram, length, place); a right name asks under all lengths and places that
   fit.  The join keeps pairs that pass the count filters (code points and grams that one has and the other has not, as sets of 64
   bits) and the plain edit distance, of which an exchange counts two.
4. Names with fewer grams than a prefix needs meet the names of their length bucket (lengths that differ by at most ``most``), in blocks.
5. The exact distance of each distinct pair decides.

Nothing but the SLOTS counts is collected or broadcast by this module: its joins are merge joins by hint, since Spark goes by the size of a stored file and knows
neither what it holds unpacked nor the rows that an explosion makes of it.  Keys with many rows are those of inner joins, which Spark splits.

Defined cases: null and empty names take no part; equal names are at distance 0; names of any length are compared whole; an empty side gives an
empty result; only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import release, stored
from odweave.llm.quality_rules import CRC_TABLE, crc_sql

#: Code points of a gram; slots of the gram counts; left names of a length bucket's block, about.
Q, SLOTS, BLOCK = 2, 1 << 14, 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(name: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(name, UPPER, LOWER)


def exchanged(name: Column, h: Column) -> Column:
    """The name with two neighbours exchanged, at a place given by h, where h is even and there are two."""
    n = F.length(name)
    i = (h % F.greatest(n - 1, F.lit(1))).cast("int")
    at = lambda k, m=1: F.substring(name, k, F.lit(m))
    swapped = F.concat(F.substring(name, F.lit(1), i), at(i + 2), at(i + 1), F.substring(name, i + 3, n))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(name)


def alignment_distance(a: str, b: str, most: int) -> int:
    """The optimal string alignment distance of two names, or most + 1 if it is larger."""
    if a == b:
        return 0
    far = most + 1
    if abs(len(a) - len(b)) > most:
        return far
    before: list[int] = []
    last = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row[j] = min(d, far)
        if min(row) > most:
            return far
        before, last = last, row
    return last[-1]


def _grams(name: Column) -> Column:
    """The grams of a name, in order; none if it is shorter than one."""
    n = F.length(name) - Q + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(name, i, F.lit(Q)))).otherwise(F.array().cast("array<string>"))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def _bits(items: Column) -> Column:
    """The set of items, as 64 bits."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def gram_counts(*sides: DataFrame) -> list[int]:
    """Counts of the grams of all names, by slot: SLOTS numbers."""
    each = [s.select(F.explode(_grams(F.col("name"))).alias("g")) for s in sides]
    slots = each[0].union(each[1]).groupBy(_slot(F.col("g")).alias("s")).agg(F.count("*").alias("n"))
    out = [0] * SLOTS
    for r in slots.collect():
        out[r["s"]] = r["n"]
    return out


def _profiled(names: DataFrame) -> DataFrame:
    """names (distinct) with length, grams, and their sets of code points and grams."""
    return names.select("name", F.length("name").alias("n"), _grams(F.col("name")).alias("grams")).select("name", "n", "grams", _bits(F.split("name", "")).alias("chars"), _bits(F.col("grams")).alias("gset"))


def _edits(places: Column) -> Column:
    """The fewest edits that spoil the grams at all of the places: from the first on, each spoils those up to Q further."""
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(places), zero, lambda x, p: F.when(p > x["end"], F.struct((p + Q).alias("end"), (x["n"] + 1).alias("n"))).otherwise(x), lambda x: x["n"])


def _prefix(side: DataFrame, counts: list[int], most: int) -> DataFrame:
    """A row for each gram of the prefixes, rarest first, of the names that have enough: (name, n, chars, gset, gram, place)."""
    table = F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")
    ranked = F.slice(F.sort_array(F.transform("grams", lambda g, i: F.struct(F.get(table, _slot(g)).alias("often"), g.alias("gram"), i.alias("place")))), 1, most * (Q + 1) + 1)
    rows = side.where(F.size("grams") > most * (Q + 1)).select("name", "n", "chars", "gset", ranked.alias("ranked"))
    enough = F.filter(F.sequence(F.lit(most + 1), F.lit(most * (Q + 1) + 1)), lambda k: _edits(F.slice("ranked.place", 1, k)) > most)
    rows = rows.select("name", "n", "chars", "gset", F.explode(F.slice("ranked", 1, F.get(enough, F.lit(0)))).alias("p"))
    return rows.select("name", "n", "chars", "gset", "p.gram", "p.place")


def _near(most: int) -> Column:
    """Whether a pair (columns of the left, and of the right with an r) may be within ``most`` edits: with x code points that one side has alone,
    x edits or more are no exchanges, so that the plain distance is at most 2 * most - x."""
    lack = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    x = F.greatest(lack("chars", "rchars"), lack("rchars", "chars"))
    spoilt = F.greatest(lack("gset", "rgset"), lack("rgset", "gset"))
    plain = F.pmod(F.levenshtein("name", "rname", 2 * most), F.lit(2 * most + 2))  # -1, too far, becomes the largest
    return (x <= most) & (spoilt <= most * (Q + 1)) & (plain <= 2 * most - x)


def _right(side: DataFrame) -> DataFrame:
    return side.withColumnsRenamed({c: f"r{c}" for c in ("name", "chars", "gset")})


def similar(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """(name, rname, distance) of all pairs of distinct names of left and right (each a column ``name``) within ``most`` edits.  A stored
    table."""
    sides = [stored(_profiled(s.where("name IS NOT NULL AND name <> ''").select("name").distinct()), "names") for s in (left, right)]
    counts = gram_counts(*sides)
    fits = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-most, most + 1) for b in range(-most, most + 1) if abs(b) + abs(a - b) <= most))
    asked = _right(_prefix(sides[1], counts, most)).withColumn("fit", F.explode(fits))
    asked = asked.select("rname", "rchars", "rgset", "gram", (F.col("n") + F.col("fit.a")).alias("n"), (F.col("place") + F.col("fit.b")).alias("place"))
    found = _prefix(sides[0], counts, most).join(asked.hint("merge"), ["gram", "n", "place"]).where(_near(most)).select("name", "rname")
    pairs = stored(found.unionByName(_short(*sides, most)).distinct(), "pairs")
    distance = F.pandas_udf(lambda a, b: pd.Series([alignment_distance(x, y, most) for x, y in zip(a, b, strict=True)], dtype="int32"), "int")
    out = stored(pairs.withColumn("distance", distance("name", "rname")).where(F.col("distance") <= most), "similar")
    release(*sides, pairs)
    return out


def _short(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs of which a name has too few grams for a prefix: right names ask the blocks of all length buckets that fit."""
    least = most * (Q + 1) + Q  # length from which a name has a prefix
    rows = left.where(F.col("n") < least + most)
    blocks = rows.count() // BLOCK + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)))
    asked = _right(right.where(F.col("n") < least + most).withColumnRenamed("n", "rn"))
    asked = asked.withColumn("n", F.explode(F.sequence(F.greatest(F.col("rn") - most, F.lit(1)), F.col("rn") + most))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.join(asked.hint("merge"), ["n", "block"]).where((F.least("n", "rn") < least) & _near(most)).select("name", "rname")


def link(clients: DataFrame, vendors: DataFrame, most: int = 2) -> DataFrame:
    """Per vendor and distance with a pair: (vendor_id, distance, n_clients, first_client_id, clients_crc).  clients: client_id, name; vendors: vendor_id, name; names as they are to be
    compared."""
    crc = F.crc32(F.col("client_id").cast("string").cast("binary"))
    own = clients.where("name IS NOT NULL AND name <> ''").groupBy("name").agg(F.count("*").alias("n_clients"), F.min("client_id").alias("first_client_id"), F.sum(crc).alias("clients_crc"))
    pairs = similar(clients, vendors, most)
    found = pairs.join(own.hint("merge"), "name").groupBy("rname", "distance").agg(F.sum("n_clients").alias("n_clients"), F.min("first_client_id").alias("first_client_id"), F.sum("clients_crc").alias("clients_crc"))
    return vendors.select("vendor_id", F.col("name").alias("rname")).join(found.hint("merge"), "rname").drop("rname")


def misspelt(vendors: DataFrame) -> DataFrame:
    """vendors (vendor_id, name) with the exchanges that stand for misspellings; a null id leaves the name as it is."""
    h = F.coalesce(F.crc32(F.col("vendor_id").cast("string").cast("binary")), F.lit(1))
    return vendors.select("vendor_id", exchanged(F.col("name"), h).alias("name"))


def _cell(d: int) -> str:
    """SQL of the distance of the first i code points of v and the first i + d of c, from the rows before (p, q) and the cell before (n)."""
    j = f"(i + 1 + ({d}))"
    terms = [f"p{d + 2} + (CASE WHEN v[i + 1] = c[{j}] THEN 0 ELSE 1 END)"]
    if d < 2:
        terms.append(f"p{d + 3} + 1")
    if d > -2:
        terms.append(f"n{d + 1} + 1")
    terms.append(f"CASE WHEN i > 0 AND {j} > 1 AND v[i + 1] = c[{j} - 1] AND v[i] = c[{j}] THEN q{d + 2} + 1 ELSE 99 END")
    return f"CASE WHEN {j} < 0 OR {j} > len(c) THEN 99 WHEN {j} = 0 THEN i + 1 ELSE least({', '.join(terms)}) END AS n{d + 2}"


_ROW = lambda x: ", ".join(f"{x}{k}" for k in range(5))
SQL = f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {CRC_TABLE} AS crc),
cl AS MATERIALIZED (SELECT client_id, translate(name, '{UPPER}', '{LOWER}') AS name, {crc_sql("client_id::VARCHAR")} AS crc32 FROM clients, tab WHERE name <> ''),
h AS (SELECT vendor_id, name, length(name) AS l, {crc_sql("vendor_id::VARCHAR")} AS h FROM vendors, tab WHERE name <> ''),
ve AS MATERIALIZED (SELECT vendor_id, translate(CASE WHEN h % 2 = 0 AND l >= 2 THEN substr(name, 1, h % (l - 1)) || substr(name, h % (l - 1) + 2, 1) || substr(name, h % (l - 1) + 1, 1) || substr(name, h % (l - 1) + 3) ELSE name END, '{UPPER}', '{LOWER}') AS name FROM h),
pairs AS MATERIALIZED (SELECT row_number() OVER () AS pair, v.name AS vname, c.name AS cname, string_split(v.name, '') AS v, string_split(c.name, '') AS c FROM (SELECT DISTINCT name FROM ve) v JOIN (SELECT DISTINCT name FROM cl) c ON abs(length(v.name) - length(c.name)) <= 2),
dp AS (SELECT pair, 0 AS i, 99 AS p0, 99 AS p1, 0 AS p2, 1 AS p3, 2 AS p4, 99 AS q0, 99 AS q1, 99 AS q2, 99 AS q3, 99 AS q4 FROM pairs
  UNION ALL SELECT pair, i + 1, {_ROW("n")}, {_ROW("p")} FROM (SELECT dp.*, {", ".join(_cell(d) for d in range(-2, 3))} FROM dp JOIN pairs USING (pair) WHERE i < len(v) AND least({_ROW("p")}) <= 2)),
ends AS (SELECT pair, vname, cname, CASE len(c) - len(v) WHEN -2 THEN p0 WHEN -1 THEN p1 WHEN 0 THEN p2 WHEN 1 THEN p3 ELSE p4 END AS distance FROM dp JOIN pairs USING (pair) WHERE i = len(v))
SELECT vendor_id, distance::INT AS distance, count(*) AS n_clients, min(client_id) AS first_client_id, sum(crc32)::BIGINT AS clients_crc FROM ve JOIN ends ON ve.name = vname JOIN cl ON cl.name = cname WHERE distance <= 2 GROUP BY vendor_id, distance
"""
