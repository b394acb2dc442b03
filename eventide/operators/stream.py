"""Ordered token stream per stay: hour spine + event tokens with positions.

Order inside a stay: ``(charttime, kind, tie-break columns, sub)``; hour tokens
have kind 0 and come before events at the same instant.  ``pos`` is 0-based
and gapless.

Positions are computed arithmetically instead of with a ``row_number`` over
the whole stay:

* an event at hour index ``hidx`` has ``hidx`` hour tokens before it;
* the event tokens before it are (tokens of the stay's earlier chunks) + (tokens of
  earlier events in the chunk).

Events are dealt once by ranges of the stream's whole order, numbered and written without
the order columns; a chunk is 4,096 of them, whatever their stay.  Then they are shuffled
once on ``(stay, chunk)``, for their positions and neighbours together, and become tokens
behind that shuffle; earlier chunks are a scan over a row for each stay and chunk.
The grid of units comes from per-second totals, a partial aggregate.
Spine tokens are neither shuffled nor written: they are made from the grid's rows on read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventide.operators.scan import DEFAULT_FANOUT, overlapped
from eventide.operators.settled import settled

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
UNIT_US = {"hour": 3_600_000_000, "day": 86_400_000_000}
SUB_US = 1_000_000  # sub-buckets of a second


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (zone independent)."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def from_epoch_us(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH))


def spine_token(unit: str, ab: Column) -> Column:
    """Token of the boundary ``ab`` (absolute unit index since the epoch)."""
    # names by index: nothing is built for each of the many spine rows
    if unit == "hour":
        return F.get(F.array(*[F.lit(f"hour.{i}") for i in range(24)]), F.pmod(ab, F.lit(24)).cast("int"))
    # 1970-01-01 was a Thursday: day index 0 -> weekday 3 (Monday = 0)
    return F.get(F.array(*[F.lit(f"day.{i}") for i in range(7)]), F.pmod(ab + F.lit(3), F.lit(7)).cast("int"))


def tie_bucket(tie: tuple[str, int] | None) -> Column:
    """Where all events of a second have one time (whole days), the first
    tie-break column divided by a width splits it in order."""
    return F.lit(0).cast("long") if tie is None else F.floor(F.col(tie[0]) / F.lit(tie[1])).cast("long")


def second_totals(ev: DataFrame, unit: str, carry: Sequence[str], tie: tuple[str, int] | None = None) -> DataFrame:
    """Event tokens per stay, second and tie bucket: a partial aggregate, skew-safe."""
    per = UNIT_US[unit] // SUB_US
    us = epoch_us("charttime")
    return (ev.select("stay_id", F.floor(us / F.lit(SUB_US)).cast("long").alias("am"), tie_bucket(tie).alias("tb"),
                      F.size("toks").cast("long").alias("ntok"), *carry)
            .groupBy("stay_id", "am", "tb").agg(F.sum("ntok").alias("c"), *[F.max(c).alias(c) for c in carry])
            .withColumn("ah", F.floor(F.col("am") / F.lit(per)).cast("long")))


BLOCK_UNITS = 24  # units under one key of a lookup


def unit_grid(mt: DataFrame, carry: Sequence[str] = ("testset",)) -> DataFrame:
    """The grid of units from a stay's first event (``ah0``) to its last (``ah1``),
    held as one row for each unit ``ah`` with event tokens (and the first): ``c``
    tokens, ``c_before`` before its boundary; the units up to ``next_ah`` (exclusive)
    have none.  So it grows with the events, not with the time between them."""
    ht = mt.where(F.col("ah").isNotNull()).groupBy("stay_id", "ah").agg(F.sum("c").alias("c"), *[F.max(c).alias(c) for c in carry])
    # one row per stay and unit: bounded by the stay's time span (not its
    # volume), so windows per stay are safe here
    stay = Window.partitionBy("stay_id")
    ht = ht.select("*", F.min("ah").over(stay).alias("ah0"), F.max("ah").over(stay).alias("ah1"))
    ht = ht.where((F.col("c") > 0) | (F.col("ah") == F.col("ah0")))
    order = stay.orderBy("ah")
    return ht.select("stay_id", "ah", "ah0", "ah1", *carry, "c", *_before_and_next(order))


def _before_and_next(order: WindowSpec) -> list[Column]:
    """``c_before`` and ``next_ah`` of a grid's rows in ``order``."""
    return [F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c_before"),
            F.coalesce(F.lead("ah").over(order), F.col("ah1") + 1).alias("next_ah")]


def stay_lengths(grid: DataFrame, name: str = "len") -> DataFrame:
    """``(stay_id, name)``: tokens of each stay's stream."""
    return grid.groupBy("stay_id").agg((F.max(F.col("c_before") + F.col("c")) + F.max(F.col("ah1") - F.col("ah0"))).alias(name))


def at_unit(requests: DataFrame, grid: DataFrame, unit: str, relative: bool = False) -> DataFrame:
    """``requests`` (left) with the grid row that covers their ``unit`` (of ``ah``, or of
    units since the stay's first): ``__gah, __gah0, __gc, __gc_before``.  Rows
    and requests meet on (stay, block of units), where a request meets a row a unit at most."""
    first = F.col("ah0") if relative else F.lit(0)
    rows = grid.select(F.col("stay_id").alias("__gs"), F.col("ah").alias("__gah"), F.col("ah0").alias("__gah0"), F.col("c").alias("__gc"),
                       F.col("c_before").alias("__gc_before"), (F.col("ah") - first).alias("__from"), (F.col("next_ah") - first).alias("__to"))
    block = lambda c: F.floor(c / F.lit(BLOCK_UNITS)).cast("long")
    rows = rows.select("*", F.explode(F.sequence(block(F.col("__from")), block(F.col("__to") - 1))).alias("__gb"))
    on = (F.col("stay_id") == F.col("__gs")) & (block(F.col(unit)) == F.col("__gb")) & (F.col(unit) >= F.col("__from")) & (F.col(unit) < F.col("__to"))
    return requests.join(rows, on, "left").drop("__gs", "__gb", "__from", "__to")


def _spine_at(unit: str, ah: Column) -> Column:
    """Spine token of the unit ``ah`` of a row's stay; NULL where the stay has none."""
    return F.when((ah > F.col("ah0")) & (ah <= F.col("ah1")), spine_token(unit, ah))


def ordered_events(ev: DataFrame, order_cols: Sequence[str] = ("row_id",)) -> DataFrame:
    """Event rows that have a time and tokens, dealt by ranges of the stream's whole order
    (stay, time, ``order_cols``), so a hot stay or day is spread like any other: ``stay_id,
    charttime, row_id, toks`` and ``at``, which grows in that order (partition in the upper
    bits, row of it in the lower 33) and stands for the order columns from here on.
    To be written once: ``at`` belongs to one run."""
    order = ["stay_id", "charttime", *order_cols]
    e = ev.where(F.col("charttime").isNotNull() & (F.size("toks") > 0)).select(*dict.fromkeys([*order, "row_id", "toks"]))
    return e.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "stay_id", "charttime", "row_id", "toks", F.monotonically_increasing_id().alias("at"))


def event_tokens(ordered: DataFrame, grid: DataFrame, unit: str = "hour", carry: Sequence[str] = ("testset",),
                 fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """Event tokens from written :func:`ordered_events` and the grid.

    Returns ``stay_id, pos, charttime, row_id, sub, token, hour_no, next1,
    next2, prev1, prev2, edge`` and the carried columns.

    The neighbours of a token in the stream are tokens of its event or of the two before and
    after, or spine tokens, which follow from the unit: events are shuffled whole, on (stay,
    chunk), once.  ``edge`` marks the first (1), second (2), last (4) and second last (8) of a unit.
    """
    carry = list(carry)
    # rows before each partition: a row a partition
    part = F.shiftright("at", 33)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settled(ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")), "ordered-before")
    x = ordered.withColumn("__part", part).join(parts, "__part").select(
        "stay_id", "charttime", "row_id", "toks", (F.col("__before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("__g"))

    # tokens of the stay before each chunk, and what the stay has: a row for a stay and chunk
    w_stay = Window.partitionBy("stay_id").orderBy("__nchunk").rowsBetween(Window.unboundedPreceding, -1)
    stays = grid.groupBy("stay_id").agg(*[F.max(c).alias(c) for c in ["ah0", "ah1", *carry]])
    chunks = (x.groupBy("stay_id", F.floor(F.col("__g") / F.lit(fanout)).cast("long").alias("__nchunk")).agg(F.sum(F.size("toks").cast("long")).alias("__c"))
              .select("stay_id", "__nchunk", F.coalesce(F.sum("__c").over(w_stay), F.lit(0)).alias("__base")).join(stays, "stay_id"))

    # event rows: one shuffle on (stay, chunk), windows and join share it and its order; what
    # follows from a row's columns is made behind it
    w = Window.partitionBy("stay_id", "__nchunk").orderBy("__g")
    own = F.when(F.col("__shift") == 0, F.size("toks").cast("long")).otherwise(F.lit(0))
    e = F.struct("toks", "ah")
    am = F.floor(epoch_us("charttime") / F.lit(SUB_US)).cast("long")
    x = overlapped(x, "__g", 2, 2, fanout).repartition("stay_id", "__nchunk").withColumn(
        "ah", F.floor(am / F.lit(UNIT_US[unit] // SUB_US)).cast("long")).select(
        "*", F.coalesce(F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__in"),
        *[F.lead(e, k).over(w).alias(f"f{k}") for k in (1, 2)], *[F.lag(e, k).over(w).alias(f"b{k}") for k in (1, 2)])
    x = x.where(F.col("__shift") == 0).join(chunks, ["stay_id", "__nchunk"]).withColumn("base", F.col("__base") + F.col("__in"))

    def token(c: str, k: int) -> Column:
        """The event's token ``k``, counted from its end if negative."""
        return F.struct(F.get(f"{c}.toks", F.lit(k) if k >= 0 else F.size(f"{c}.toks") + k).alias("t"), F.col(f"{c}.ah").alias("h"))

    around = F.concat(F.array(F.when(F.size("b1.toks") > 1, token("b1", -2)).otherwise(token("b2", -1)), token("b1", -1)),
                      F.expr("transform(toks, t -> named_struct('t', t, 'h', ah))"),
                      F.array(token("f1", 0), F.when(F.size("f1.toks") > 1, token("f1", 1)).otherwise(token("f2", 0))))
    x = x.select("stay_id", "charttime", "row_id", "ah", "ah0", "ah1", *carry, "base", around.alias("__around"), F.posexplode("toks").alias("sub", "token"))
    x = x.select("*", *[F.get("__around", F.col("sub") + 2 + k).alias(name) for name, k in (("n1", 1), ("n2", 2), ("p1", -1), ("p2", -2))])
    ah, hour_no = F.col("ah"), F.col("ah") - F.col("ah0")

    def near(c: str) -> Column:
        return F.coalesce(F.col(f"{c}.h") == ah, F.lit(False))

    def spine(k: int) -> Column:
        return _spine_at(unit, ah + k)

    next2 = F.when(near("n2"), F.col("n2.t")).when(near("n1"), spine(1)).when(F.col("n1.h") == ah + 1, F.col("n1.t")).otherwise(spine(2))
    prev2 = F.when(near("p2"), F.col("p2.t")).when(near("p1"), spine(0)).when(F.col("p1.h") == ah - 1, F.col("p1.t")).otherwise(spine(-1))
    edge = F.lit(0)
    for bit, a, b in ((1, "p1", None), (2, "p2", "p1"), (4, "n1", None), (8, "n2", "n1")):
        edge = edge + F.when(~near(a) & (near(b) if b else F.lit(True)), F.lit(bit)).otherwise(F.lit(0))
    return x.select("stay_id", (F.col("base") + F.col("sub") + hour_no).alias("pos"), "charttime", "row_id", "sub", "token", hour_no.alias("hour_no"),
                    F.when(near("n1"), F.col("n1.t")).otherwise(spine(1)).alias("next1"), next2.alias("next2"),
                    F.when(near("p1"), F.col("p1.t")).otherwise(spine(0)).alias("prev1"), prev2.alias("prev2"), edge.alias("edge"), *carry)


def spine_grid(grid: DataFrame, events: DataFrame) -> DataFrame:
    """The grid with what the spine's neighbours need: first and last two event tokens
    of each unit (``f1, f2, l1, l2``), the same of the row before (``p_``) and the first of the next.

    A unit's last token has the one before beside it, so a unit of up to two tokens has one
    event row here and a larger one two; they meet the grid's rows, bounded by the
    stay's time span as these are, in one shuffle by stay."""
    edge = lambda bits: F.col("edge").bitwiseAND(bits) > 0
    first, last = edge(1) & ~edge(4 | 8), edge(4)
    ends = events.where(first | last).select(
        "stay_id", F.col("hour_no").alias("__h"), F.when(first, F.col("token")).alias("f1"), F.when(first, F.col("next1")).alias("f2"),
        F.when(last, F.col("token")).alias("l1"), F.when(last & ~edge(1), F.col("prev1")).alias("l2"))
    rows = grid.withColumn("__h", F.col("ah") - F.col("ah0")).drop("ah", "c_before", "next_ah")  # these follow from the others
    both = rows.unionByName(ends, allowMissingColumns=True).repartition("stay_id")
    g = both.groupBy("stay_id", "__h").agg(*[F.max(c).alias(c) for c in both.columns if c not in ("stay_id", "__h")])
    g = g.withColumns({"ah": F.col("ah0") + F.col("__h"), "f1": F.coalesce("f1", F.when(F.col("c") == 1, F.col("l1")).when(F.col("c") == 2, F.col("l2"))),
                       "f2": F.coalesce("f2", F.when(F.col("c") == 2, F.col("l1")))})
    w = Window.partitionBy("stay_id").orderBy("__h")
    g = g.select("*", *_before_and_next(w), F.lead("f1").over(w).alias("n_f1"), *[F.lag(c).over(w).alias("p_" + c) for c in ("ah", "c", "l1", "l2")])
    return g.select(*grid.columns, "f1", "f2", "l1", "l2", "n_f1", "p_ah", "p_c", "p_l1", "p_l2")


def spine_rows(g: DataFrame, unit: str = "hour", carry: Sequence[str] = ("testset",)) -> DataFrame:
    """Spine tokens of a :func:`spine_grid`, one for each unit after a stay's first,
    with the same columns as event tokens: made where they are read, without a shuffle."""
    d = g.select("*", F.explode(F.sequence(F.col("ah"), F.col("next_ah") - 1)).alias("a")).where(F.col("a") > F.col("ah0"))
    a, c, own = F.col("a"), F.col("c"), F.col("a") == F.col("ah")  # rows of their own unit have event tokens

    def spine(k: int) -> Column:
        return _spine_at(unit, a + k)

    behind = F.col("p_ah") == a - 1
    next2 = (F.when(own, F.when(c > 1, F.col("f2")).otherwise(spine(1)))
             .otherwise(F.when(a + 1 == F.col("next_ah"), F.col("n_f1")).otherwise(spine(2))))
    prev1 = (F.when(own, F.when(behind, F.col("p_l1")).otherwise(spine(-1)))
             .otherwise(F.when((a - 1 == F.col("ah")) & (c > 0), F.col("l1")).otherwise(spine(-1))))
    prev2 = (F.when(own, F.when(behind, F.when(F.col("p_c") > 1, F.col("p_l2")).when(F.col("p_c") == 1, spine(-1)))
                    .otherwise(F.when((F.col("p_ah") == a - 2) & (F.col("p_c") > 0), F.col("p_l1")).otherwise(spine(-2))))
             .otherwise(F.when(a - 1 == F.col("ah"), F.when(c > 1, F.col("l2")).when(c == 1, spine(-1)))
                        .otherwise(F.when((a - 2 == F.col("ah")) & (c > 0), F.col("l1")).otherwise(spine(-2)))))
    return d.select("stay_id", (a - F.col("ah0") - 1 + F.col("c_before") + F.when(own, F.lit(0)).otherwise(c)).alias("pos"),
                    from_epoch_us(a * F.lit(UNIT_US[unit])).alias("charttime"), F.lit(0).alias("kind"),
                    F.lit(None).cast("long").alias("row_id"), F.lit(0).alias("sub"), spine_token(unit, a).alias("token"),
                    (a - F.col("ah0")).alias("hour_no"), F.when(own, F.col("f1")).otherwise(spine(1)).alias("next1"),
                    next2.alias("next2"), prev1.alias("prev1"), prev2.alias("prev2"), *carry)
