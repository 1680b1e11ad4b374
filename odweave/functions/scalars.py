"""Column expressions: ratios, shares, classifiers, dates, text and numeric cleaning.

Each takes Columns and gives a Column, so all of them stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed labels.
ORIGIN_CLASSES = ("in_scope_origin", "valid_external_origin", "other_origin")
CLUSTERS = ("High-High", "Low-Low", "High-Low", "Low-High", "Not Significant")
HOTSPOTS = ("Both HH", "First HH only", "Second HH only", "Non-significant")


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n.cast("double"), d)


def share(n: Column, d: Column) -> Column:
    """n / d, 0 where that is undefined."""
    return F.coalesce(safe_ratio(n, d), F.lit(0.0))


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def origin_class(in_scope: Column, valid: Column) -> Column:
    """Flags may be null (no match in the lookup), which counts as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(in_scope), ORIGIN_CLASSES[0]).when(yes(valid), ORIGIN_CLASSES[1]).otherwise(ORIGIN_CLASSES[2])


def coverage_status(processed: Column, expected: Column, provisional: Column) -> Column:
    whole = (processed == expected) & (F.round(safe_ratio(processed, expected), 12) == 1.0) & ~provisional
    return F.when(whole, "final_complete").otherwise("not_final_complete")


def quadrant(z: Column, lag: Column) -> Column:
    """1 high-high, 2 low-high, 3 low-low, 4 high-low."""
    return F.when((z > 0) & (lag > 0), 1).when((z <= 0) & (lag > 0), 2).when((z <= 0) & (lag <= 0), 3).otherwise(4)


def cluster(quad: Column, significant: Column) -> Column:
    return F.when(~significant, CLUSTERS[4]).when(quad == 1, CLUSTERS[0]).when(quad == 2, CLUSTERS[3]).when(quad == 3, CLUSTERS[1]).otherwise(CLUSTERS[2])


def significance_bin(p: Column) -> Column:
    """The first bound includes its end, the others do not."""
    return F.when(p <= 0.001, "p < 0.001").when(p < 0.01, "p < 0.01").when(p < 0.05, "p < 0.05").otherwise("Not Significant")


def hotspot_class(a: Column, b: Column) -> Column:
    hot_a, hot_b = a == CLUSTERS[0], b == CLUSTERS[0]
    return F.when(hot_a & hot_b, HOTSPOTS[0]).when(hot_a, HOTSPOTS[1]).when(hot_b, HOTSPOTS[2]).otherwise(HOTSPOTS[3])


def vif_status(v: Column) -> Column:
    return F.when(v >= 10, "high").when(v >= 5, "moderate").otherwise("low")


def partition_label(fold: Column, test_fold: int = 0) -> Column:
    return F.when(fold == test_fold, "test").otherwise("train")


def source_status(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("provisional"), "provisional").when(low.contains("final"), "final").otherwise("source")


def standard_key(c: Column) -> Column:
    return F.trim(c.cast("string"))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1"), F.lit(False))


def finite(c: Column) -> Column:
    """A number, null where it is none, not a number or infinite."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def matches(c: Column, pattern: str) -> Column:
    """rlike, with null as no match."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def density(count: Column, square_metres: Column) -> Column:
    return safe_ratio(count, square_metres / 1e6)


def normalised_entropy(h: Column, k: Column) -> Column:
    """h / ln k, null where k <= 1 (which runs that need a value for every area treat as an error)."""
    return F.when(k > 1, safe_ratio(h, F.ln(k.cast("double"))))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def borough(name: Column) -> Column:
    """An area name without its number suffix."""
    return F.regexp_replace(name, r"\s+\d{3}[A-Z]$", "")


def signature(*parts: Column) -> Column:
    """SHA-256 of the parts as text, joined by |; a null part is empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def row_hash(*parts: Column) -> Column:
    """64-bit hash of a row's columns, each with its place, so that (a, null) and (null, a) differ."""
    return F.xxhash64(*(F.struct(F.lit(i), p) for i, p in enumerate(parts)))


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def same_direction(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


def status(ok: Column, otherwise: str = "fail") -> Column:
    return F.when(ok, "pass").otherwise(otherwise)


#: Area cell ids of 15 hexadecimal digits: mode 1, a resolution, a base cell below 122 and unused digits of 7.
CELL_PATTERN = r"^8[0-9a-f]{14}$"


def cell_resolution(cell: Column) -> Column:
    """Resolution bits of a cell id; null where the id has not the form of one."""
    bits = F.conv(F.lower(cell), 16, 10).cast("decimal(20,0)").cast("long")
    return F.when(matches(F.lower(cell), CELL_PATTERN), F.shiftright(bits, 52).bitwiseAND(15).cast("int"))


def cell_is_valid(cell: Column) -> Column:
    """Form, base cell, and 7 in every digit beyond the resolution, none before."""
    bits = F.conv(F.lower(cell), 16, 10).cast("decimal(20,0)").cast("long")
    res = cell_resolution(cell)
    base = F.shiftright(bits, 45).bitwiseAND(127)
    good = F.lit(True)
    for i in range(1, 16):
        d = F.shiftright(bits, 3 * (15 - i)).bitwiseAND(7)
        good = good & F.when(res >= i, d != 7).otherwise(d == 7)
    return F.coalesce(matches(F.lower(cell), CELL_PATTERN) & (base < 122) & good, F.lit(False))
