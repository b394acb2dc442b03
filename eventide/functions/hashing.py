"""Reproducible uniform numbers from integer keys.

Multiply / xor-shift / multiply hashing modulo 2**31 with plain 64-bit
integer arithmetic, so the same value comes out of Spark and of any SQL
engine (the built-in hash functions of engines differ).  Every product stays
below 2**63.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: modulus and multipliers of the hash
MOD = 2147483648
MULT1 = 2654435761
MULT2 = 2246822519


def _mix(x: Column) -> Column:
    a = F.pmod(F.pmod(x.cast("long"), F.lit(MOD)) * F.lit(MULT1), F.lit(MOD))
    a = a.bitwiseXOR(F.shiftright(a, 16))
    return F.pmod(a * F.lit(MULT2), F.lit(MOD))


def uniform(*keys: Column | str) -> Column:
    """u in [0, 1) from one or more non-negative integer keys."""
    h = None
    for k in keys:
        c = F.col(k) if isinstance(k, str) else k
        h = _mix(c) if h is None else _mix(h + c)
    return h / F.lit(float(MOD))


def _mix_sql(x: str) -> str:
    a = f"((({x}) % {MOD}) * {MULT1} % {MOD})"
    a = f"xor({a}, {a} >> 16)"
    return f"(({a}) * {MULT2} % {MOD})"


def uniform_sql(*keys: str) -> str:
    """The same function as SQL text (used by the oracle queries)."""
    h = None
    for k in keys:
        h = _mix_sql(k) if h is None else _mix_sql(f"{h} + ({k})")
    return f"(({h}) / {float(MOD)})"
