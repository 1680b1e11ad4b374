"""Sums of doubles that do not depend on the order of rows or on partitions.

A value v with |v| <= bound is written in two whole numbers, its leading and its next BITS(n) binary digits below the bound; whole numbers
sum exactly, so any plan gives the same bits.  What is below the second number is rounded a row at a time, in the same way everywhere: with
n rows the sum is right to n * bound * 2 ** (2 * log2(n) - 123), far below what a sum of doubles leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def power_above(bound: float) -> float:
    """The least power of two that is not below the bound (1 for 0)."""
    if not bound:
        return 1.0
    m, e = math.frexp(bound)
    return math.ldexp(1.0, e - 1 if m == 0.5 else e)


def exact_sums(df: DataFrame, values: dict[str, tuple[Column, float]], n: int) -> dict[str, float]:
    """The sums of n rows' values, each given with a bound of its size.  Nulls count as 0."""
    if not values:
        return {}
    bits = 61 - max(n, 1).bit_length()
    unit = math.ldexp(1.0, bits)
    parts = []
    for name, (v, bound) in values.items():
        scaled = F.coalesce(v.cast("double"), F.lit(0.0)) * F.lit(unit / power_above(bound))
        high = F.rint(scaled)
        parts += [F.sum(high.cast("long")).alias(f"{name}_h"), F.sum(F.rint((scaled - high) * F.lit(unit)).cast("long")).alias(f"{name}_l")]
    r = df.agg(*parts).first()
    return {name: (((r[f"{name}_h"] or 0) << bits) + (r[f"{name}_l"] or 0)) / (1 << 2 * bits) * power_above(bound) for name, (_, bound) in values.items()}


def grouped_sums(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys..., name): the sum of a column in each group (null without values), the same for any order of rows: groups of the same values have the same sum."""
    v = F.col(value).cast("double")
    n, bounds = column_bounds(df, {"v": v})
    bits, power = 61 - max(n, 1).bit_length(), power_above(max(map(abs, bounds["v"])))
    unit = math.ldexp(1.0, bits)
    scaled = v * F.lit(unit / power)
    high = F.rint(scaled)
    parts = df.groupBy(*keys).agg(F.sum(high.cast("long")).alias("_h"), F.sum(F.rint((scaled - high) * F.lit(unit)).cast("long")).alias("_l"))
    return parts.select(*keys, ((F.col("_h").cast("double") + F.col("_l").cast("double") / F.lit(unit)) * F.lit(power / unit)).alias(name))


def column_bounds(df: DataFrame, columns: dict[str, Column]) -> tuple[int, dict[str, tuple[float, float]]]:
    """(rows, least and largest value of each column), 0 where it has none."""
    r = df.agg(F.count("*").alias("n"), *(f(c.cast("double")).alias(f"{k}_{s}") for k, c in columns.items() for s, f in (("min", F.min), ("max", F.max)))).first()
    return r["n"], {k: (r[f"{k}_min"] or 0.0, r[f"{k}_max"] or 0.0) for k in columns}


def moments(df: DataFrame, names: list[str]) -> tuple[int, dict[str, float], dict[str, float]]:
    """(rows, mean and population standard deviation of each column), the same for any order.  Two passes: bounds, then sums about
    the middle of each column's range."""
    n, bounds = column_bounds(df, {c: F.col(c) for c in names})
    if not n:
        return 0, dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    middle = {c: low / 2 + high / 2 for c, (low, high) in bounds.items()}
    reach = {c: max(high - middle[c], middle[c] - low) for c, (low, high) in bounds.items()}
    values = {}
    for c in names:
        u = F.col(c).cast("double") - F.lit(middle[c])
        values |= {f"{c}_s": (u, reach[c]), f"{c}_q": (u * u, reach[c] ** 2)}
    s = exact_sums(df, values, n)
    shift = {c: s[f"{c}_s"] / n for c in names}
    return n, {c: middle[c] + shift[c] for c in names}, {c: math.sqrt(max(s[f"{c}_q"] / n - shift[c] ** 2, 0.0)) for c in names}
