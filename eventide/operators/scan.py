"""Skew-safe scans over ordered groups.

A stay (or any group) may hold a third of all rows, so no window here is
partitioned by the group key alone.  Every scan is done in two levels:

* inside a chunk (``order div fanout``) with a window over ``(group, chunk)``,
  whose partitions hold at most ``fanout`` rows, and
* across chunks, over one pre-aggregated row per ``(group, chunk)``; that table
  is ``fanout`` times smaller and is scanned the same way, recursively.

The chunk-level results are joined back on ``(group, chunk)``, a key whose
size is bounded, so the join does not skew either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_FANOUT = 4096


def levels_for(max_rows: int, fanout: int = DEFAULT_FANOUT) -> int:
    """Smallest depth (at least 2) whose chunks cover ``max_rows`` positions
    with every window holding at most ``fanout`` rows."""
    levels, cover = 2, fanout * fanout
    while cover < max_rows:
        levels, cover = levels + 1, cover * fanout
    return levels


def _cols(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def prefix_sum(df: DataFrame, group: str | Sequence[str], order: str,
               values: Sequence[str], fanout: int = DEFAULT_FANOUT,
               levels: int = 2, suffix: str = "_before") -> DataFrame:
    """Exclusive running sums of ``values`` in ``order`` within ``group``.

    ``order`` must be an integer column that is unique inside a group (a
    position).  Adds ``<value><suffix>`` columns; the first row of a group
    gets 0.
    """
    group = _cols(group)
    values = list(values)
    if levels <= 1:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(v + suffix)
                               for v in values])
    chunk = f"__chunk{levels}"
    d = df.withColumn(chunk, F.floor(F.col(order) / F.lit(fanout)).cast("long"))
    w = Window.partitionBy(*group, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = d.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(v + "__in")
                            for v in values])
    totals = d.groupBy(*group, chunk).agg(*[F.sum(v).alias(v) for v in values])
    outer = prefix_sum(totals, group, chunk, values, fanout, levels - 1, suffix="__out")
    outer = outer.select(*group, chunk, *[F.col(v + "__out") for v in values])
    out = inner.join(outer, [*group, chunk], "inner")
    return out.select(*[F.col(c) for c in df.columns],
                      *[(F.col(v + "__in") + F.col(v + "__out")).alias(v + suffix)
                        for v in values])


def rank_in_group(df: DataFrame, group: str | Sequence[str], order: str,
                  name: str = "rank0", fanout: int = DEFAULT_FANOUT,
                  levels: int = 2) -> DataFrame:
    """0-based row number by ``order`` (unique per group), without a
    group-wide window."""
    d = df.withColumn("__one", F.lit(1).cast("long"))
    r = prefix_sum(d, group, order, ["__one"], fanout, levels)
    return r.withColumnRenamed("__one_before", name).drop("__one")


def last_before(df: DataFrame, group: str | Sequence[str], order: str, value: str,
                name: str, inclusive: bool = False, fanout: int = DEFAULT_FANOUT,
                levels: int = 2) -> DataFrame:
    """Carry the last non-null ``value`` forward (LOCF) by ``order``.

    ``inclusive`` decides whether a row sees its own value.  The value is
    taken at the greatest ``order`` below (or at) the row, in two levels as
    the module docstring describes.
    """
    group = _cols(group)
    hi = 0 if inclusive else -1
    if levels <= 1:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, hi)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    chunk = f"__lchunk{levels}"
    d = df.withColumn(chunk, F.floor(F.col(order) / F.lit(fanout)).cast("long"))
    w = Window.partitionBy(*group, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, hi)
    inner = d.withColumn("__in", F.last(value, ignorenulls=True).over(w))
    # last non-null value of every chunk, then carried across chunks
    # (every chunk gets a row, NULL when it holds no value, so that the
    # carry passes through empty chunks)
    has = F.col(value).isNotNull()
    per_chunk = (d.groupBy(*group, chunk)
                 .agg(F.max_by(F.when(has, F.col(value)), F.when(has, F.col(order))).alias("__v")))
    carried = last_before(per_chunk, group, chunk, "__v", "__out", inclusive=False,
                          fanout=fanout, levels=levels - 1)
    carried = carried.select(*group, chunk, "__out")
    out = inner.join(carried, [*group, chunk], "left")
    return out.select(*[F.col(c) for c in df.columns],
                      F.coalesce(F.col("__in"), F.col("__out")).alias(name))


def at_offset(requests: DataFrame, stream: DataFrame, pos_col: str, offset: int,
              take: Sequence[str], group: str = "stay_id",
              prefix: str = "") -> DataFrame:
    """Look up stream columns at ``pos_col + offset`` of the same group.

    An equi-join on ``(group, pos)``: the key is unique, so it spreads evenly
    however large one group is.  Misses (past the end) give NULLs, which is
    the safe form of reading ``stream[idx + k]``.
    """
    right = stream.select(F.col(group).alias("__g"), F.col("pos").alias("__p"),
                          *[F.col(c).alias(prefix + c) for c in take])
    cond = (F.col(group) == F.col("__g")) & ((F.col(pos_col) + F.lit(offset)) == F.col("__p"))
    return requests.join(right, cond, "left").drop("__g", "__p")


SALTS = 16


def join_stays(rows: DataFrame, per_stay: DataFrame, group: str = "stay_id", order: str = "pos", salts: int = SALTS,
               salt: Column | None = None) -> DataFrame:
    """``rows`` joined with a table of one row a stay.  The stay's rows are dealt
    over ``salts`` keys by chunk of position (or by ``salt``, a whole number) and its one
    row is copied to each, so that a hot stay is no single key of the join."""
    salt = F.floor(F.col(order) / DEFAULT_FANOUT) if salt is None else salt
    copies = per_stay.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int")).join(copies, [group, "__salt"]).drop("__salt")


def count_before(requests: DataFrame, rows: DataFrame, at: str, name: str, group: str = "stay_id", levels: int = 2) -> DataFrame:
    """``requests`` with ``name``: the number of ``rows`` (``group, pos``; unique) of the
    group with ``pos`` below ``at``.  Requests and rows share one two-level scan,
    so no request meets more rows than a chunk holds."""
    asked = requests.select(group, F.col(at).alias("__at")).distinct().select(
        group, (F.col("__at") * 2).cast("long").alias("__o"), F.lit(0).cast("long").alias("__n"))
    given = rows.select(group, (F.col("pos") * 2 + 1).cast("long").alias("__o"), F.lit(1).cast("long").alias("__n"))
    counted = prefix_sum(asked.unionByName(given), group, "__o", ["__n"], levels=levels, suffix="_before")
    counted = counted.where(F.col("__n") == 0).select(F.col(group).alias("__g"), "__o", F.col("__n_before").alias(name))
    on = (F.col(group) == F.col("__g")) & ((F.col(at) * 2) == F.col("__o"))
    return requests.join(counted, on).drop("__g", "__o")


def overlapped(df: DataFrame, order: str, back: int, fwd: int, fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """``df`` with ``__nchunk`` (``order div fanout``) and ``__shift``: 0 for its own rows, and 1 or -1
    for copies in the next or previous chunk of the ``back`` last and ``fwd`` first rows of a chunk."""
    c = F.floor(F.col(order) / F.lit(fanout)).cast("long")
    r = F.pmod(F.col(order), F.lit(fanout))
    shifts = F.array(F.lit(0))
    if back:
        shifts = F.when(r >= fanout - back, F.array_union(shifts, F.array(F.lit(1)))).otherwise(shifts)
    if fwd:
        shifts = F.when(r < fwd, F.array_union(shifts, F.array(F.lit(-1)))).otherwise(shifts)
    d = df.select("*", F.explode(shifts).alias("__shift"))
    return d.withColumn("__nchunk", c + F.col("__shift"))


def neighbors(df: DataFrame, group: str | Sequence[str], order: str, col: str,
              offsets: Sequence[int], names: Sequence[str] | None = None,
              fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """``col`` at ``order + offset`` for each offset (lag < 0 < lead), for a
    gapless ``order`` (a stream position).

    Rows within ``max|offset|`` of a chunk edge are copied into the
    neighbouring chunk, so one window over ``(group, chunk)`` sees every
    neighbour it needs: one shuffle, bounded partitions, no join.
    """
    group = _cols(group)
    names = list(names or [f"{col}_{'m' if o < 0 else 'p'}{abs(o)}" for o in offsets])
    back = max([-o for o in offsets if o < 0] + [0])
    fwd = max([o for o in offsets if o > 0] + [0])
    d = overlapped(df, order, back, fwd, fanout)
    w = Window.partitionBy(*group, "__nchunk").orderBy(order)
    for o, n in zip(offsets, names):
        fn = F.lag(col, -o) if o < 0 else F.lead(col, o)
        d = d.withColumn(n, fn.over(w))
    return d.where(F.col("__shift") == 0).drop("__shift", "__nchunk")
