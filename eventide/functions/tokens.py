"""Token namespace parsing (JVM-side expressions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def family(token: Column | str) -> Column:
    """Text before the first '.'; the whole token when there is none."""
    return F.substring_index(_c(token), ".", 1)


def suffix_int(token: Column | str) -> Column:
    """``int(token.split('.')[-1])``, NULL when the suffix is not a number."""
    return F.substring_index(_c(token), ".", -1).try_cast("int")
