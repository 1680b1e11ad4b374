"""Random permutations of 0 .. n - 1 as arithmetic: no sort, no window, any place of any permutation on its own.

Permutation r is ROUNDS rounds of swap-or-not (Hoang, Morris, Rogaway 2012): round i pairs x with a_i - x (mod n), and a bit that
depends on the larger of the two and on b_i tells whether they change places.  A round is its own inverse, so the rounds backwards are the
inverse permutation.  The expressions are the same text in Spark and in other SQL: whole numbers below 2**31 whose products fit 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.storage import stored

#: Rounds; a prime below 2**31, by which all numbers are reduced.
ROUNDS, PRIME = 16, 2147483647


def _scrambled(v: str) -> str:
    for _ in range(2):
        v = f"((({v}) * ({v}) % {PRIME} * 48271 + ({v})) % {PRIME})"
    return v


def keys_sql(r: str = "r") -> str:
    """Columns a0, b0, a1, ... of permutation r (a whole number from 1)."""
    return ", ".join(f"{_scrambled(f'({r} * {2 * ROUNDS} + {2 * i + k}) * 69621 % {PRIME}')} AS {c}{i}" for i in range(ROUNDS) for k, c in enumerate("ab"))


def round_sql(i: int, x: str, n: str) -> tuple[str, str]:
    """Round i: the partner of x (as _y), then x after it."""
    v = f"(greatest({x}, _y) * 2654435 + b{i}) % {PRIME}"
    return f"(a{i} % {n} + {n} - {x}) % {n}", f"CASE WHEN {_scrambled(v)} % 2 = 1 THEN _y ELSE {x} END"


def permuted_sql(source: str, keep: str, x: str, n: str, inverse: bool = False) -> str:
    """SQL of the rows of source (columns keep, r, x and n; x from 0) with x permuted by permutation r."""
    out = f"(SELECT s.*, k.* EXCLUDE (r) FROM {source} s JOIN (SELECT r, {keys_sql()} FROM (SELECT DISTINCT r FROM {source})) k USING (r))"
    keys = ", ".join(f"{c}{i}" for i in range(ROUNDS) for c in "ab")
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        partner, after = round_sql(i, x, n)
        out = f"(SELECT {keep}, r, {n}, {keys}, {after} AS {x} FROM (SELECT *, {partner} AS _y FROM {out}))"
    return f"(SELECT {keep}, r, {x} FROM {out})"


def permuted(rows: DataFrame, x: str, n: int, permutations: int, inverse: bool = False) -> DataFrame:
    """rows (with a column r from 1 to permutations) with the whole number x, from 0 to n - 1, permuted by permutation r.  The keys of all permutations are
    a broadcast of that many rows.  A stored table: what is known of the result would be a long expression to whatever is planned above it."""
    if n >= PRIME:
        raise ValueError(f"{n} places; at most {PRIME - 1}")
    spark, names = rows.sparkSession, rows.columns
    keys = spark.range(1, permutations + 1).withColumnRenamed("id", "r").selectExpr("r", *(f"{e} AS {c}" for e, c in (k.rsplit(" AS ", 1) for k in keys_sql().split(", "))))
    out = rows.withColumn(x, F.col(x).cast("long")).join(F.broadcast(keys), "r")
    rest = [c for c in out.columns if c != x]
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        partner, after = round_sql(i, x, f"{n}L")
        out = out.selectExpr("*", f"{partner} AS _y").selectExpr(*rest, f"{after} AS {x}")
    return stored(out.select(*names), "permuted")


def _mod(v: np.ndarray) -> np.ndarray:
    """v modulo PRIME = 2**31 - 1, for 0 <= v < 2**62."""
    v = (v & PRIME) + (v >> 31)
    v = (v & PRIME) + (v >> 31)
    return np.where(v == PRIME, 0, v)


def _scrambled_array(v: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = _mod(_mod(v * v) * 48271 + v)
    return v


def permuted_arrays(x: np.ndarray, n: int, r: np.ndarray, inverse: bool = False) -> np.ndarray:
    """[len(r), len(x)]: the places x, from 0 to n - 1, under the permutations r; equal to permuted(), for use within a task."""
    r, out = r.astype(np.int64)[:, None], np.repeat(x.astype(np.int64)[None], len(r), 0)
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        a, b = (_scrambled_array((r * (2 * ROUNDS) + (2 * i + k)) * 69621 % PRIME) for k in (0, 1))
        y = a % n - out
        y += (y < 0) * n
        coin = _scrambled_array(_mod(np.maximum(out, y) * 2654435 + b))
        out = np.where(coin & 1, y, out)
    return out
