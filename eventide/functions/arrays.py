"""Fixed-size block helpers on ARRAY<INT> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def left_pad(a: Column | str, n: int, pad: int = 0) -> Column:
    """Left-pad with ``pad`` up to length ``n`` (longer arrays unchanged)."""
    a = _c(a)
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(a), F.lit(0))), a)


def head_nonpad(a: Column | str, n: int, pad: int = 0) -> Column:
    """First ``n`` elements that are not padding."""
    return F.slice(F.filter(_c(a), lambda x: x != F.lit(pad)), 1, n)


def to_text(a: Column | str, sep: str = " ") -> Column:
    """Render an array as text (stable for comparison with SQL engines)."""
    return F.array_join(F.transform(_c(a), lambda x: x.cast("string")), sep)
