"""Cohorts and labels: nth occurrence, value after the cut, one-hot labels,
length-of-stay cohort, first-N-hours cut, last value before a cut, dose
histogram, as-of cut at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.scan import join_stays, rank_in_group


def nth_occurrences(tokens: DataFrame, targets: Sequence[str], test_only: bool = True,
                    drop_first: bool = True, levels: int = 2) -> DataFrame:
    """One example per occurrence of a target token: ``(target, stay_id, occ,
    pos, cut)`` with ``cut = pos + 1`` (the block ends with the target).

    ``drop_first`` keeps the reference's behaviour of dropping occurrence 0.
    The occurrence index is a two-level scan, not a stay-wide window.
    """
    t = tokens.where(F.col("token").isin(list(targets)))
    if test_only:
        t = t.where("testset")
    t = t.select(F.col("token").alias("target"), "stay_id", "pos", "token_id", "next1")
    t = rank_in_group(t, ["stay_id", "target"], "pos", "occ", levels=levels)
    if drop_first:
        t = t.where(F.col("occ") > 0)
    return t.withColumn("cut", F.col("pos") + 1)


def value_after(examples: DataFrame, name: str = "val_token", drop_missing: bool = True) -> DataFrame:
    """The value read right after the target: the stream carries it, so this is
    a projection.  An example at the end of its stay has none; ``dropped`` counts those."""
    r = examples.withColumnRenamed("next1", name)
    return r.where(F.col(name).isNotNull()) if drop_missing else r


def dropped(examples: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(*group, n_examples, n_dropped)``: examples, and those without a value."""
    return examples.groupBy(*group).agg(F.count("*").alias("n_examples"), F.count_if(F.col("next1").isNull()).alias("n_dropped"))


def one_hot(examples: DataFrame, value_col: str, expected: Sequence[str]) -> DataFrame:
    """Long one-hot labels: one row per expected class with ``y`` 0/1; an
    unexpected value gives all zeros (kept, as in the reference)."""
    arr = F.array(*[F.lit(t) for t in expected])
    x = examples.select("*", F.posexplode(arr).alias("cls", "cls_token"))
    return x.withColumn("y", (F.col(value_col) == F.col("cls_token")).cast("int"))


def unexpected_count(examples: DataFrame, group: Sequence[str], value_col: str,
                     expected: Sequence[str]) -> DataFrame:
    return examples.groupBy(*group).agg(
        F.count("*").alias("n_examples"),
        F.count_if(~F.col(value_col).isin(list(expected))).alias("n_unexpected"))


def los_cohort(splits: DataFrame, stay_detail: DataFrame, min_days: float) -> DataFrame:
    """Test stays whose length of stay exceeds ``min_days`` (a NULL length
    drops the stay, as the reference's WHERE on the joined side does)."""
    return (splits.where("testset").join(stay_detail, "stay_id")
            .where(F.col("los_days") > F.lit(min_days)).select("stay_id", "los_days"))


def first_n_hours(tokens: DataFrame, stays: DataFrame, n_hours: int) -> DataFrame:
    """Cut at and including the ``n_hours``-th hour token: ``(stay_id,
    cut_pos)``; stays with fewer hour tokens have no row.

    The stream carries each token's running hour count, so this is a filter
    and a join, not a scan.
    """
    h = tokens.where((F.col("kind") == 0) & (F.col("hour_no") == n_hours)) \
        .select("stay_id", F.col("pos").alias("cut_pos"), F.col("token").alias("cut_token"))
    return stays.join(h, "stay_id")


def last_value_before(tokens: DataFrame, cuts: DataFrame, item_token: str,
                      cut_col: str = "cut_pos") -> DataFrame:
    """Magnitude read after the last ``item_token`` before the cut, per stay
    (``max_by`` over positions: a partial aggregate, not a scan)."""
    items = tokens.where(F.col("token") == item_token).select("stay_id", "pos", F.when(
        F.col("next1").startswith("magnitude."), F.substring_index("next1", ".", -1).try_cast("int")).alias("mag"))
    j = join_stays(items, cuts.select("stay_id", cut_col)).where(F.col("pos") < F.col(cut_col))
    last = j.groupBy("stay_id").agg(F.max_by("mag", "pos").alias("last_mag"))
    return cuts.join(last, "stay_id", "left")


def asof_cut(requests: DataFrame, tokens: DataFrame, grid: DataFrame, seconds: DataFrame, time_col: str,
             unit: str = "hour") -> DataFrame:
    """Inclusive as-of cut: number of stream tokens with ``charttime <= t``.

    It is a sum: spine tokens and event tokens up to the boundary of t's unit (the
    grid's row), event tokens of the unit's earlier seconds (their totals: at most one
    row a second), and events of t's own second, the only rows that a request meets.
    Equal requests are answered once and given back as often as they came.
    """
    from eventide.operators.stream import SUB_US, UNIT_US, at_unit, epoch_us
    key = list(requests.columns)
    us = epoch_us(time_col)
    r = requests.groupBy(*key).agg(F.count("*").alias("__times"))
    r = r.withColumn("__us", us).withColumn("__am", F.floor(us / F.lit(SUB_US)).cast("long")) \
        .withColumn("__ah", F.floor(us / F.lit(UNIT_US[unit])).cast("long"))
    at = ["stay_id", "__ah", "__am", "__us"]
    times = r.select(*at).distinct()  # several requests may have one time
    earlier = times.join(seconds.select(F.col("stay_id").alias("__s"), F.col("ah").alias("__h"), "am", "c"),
                         (F.col("stay_id") == F.col("__s")) & (F.col("__ah") == F.col("__h")) & (F.col("am") < F.col("__am")))
    rows = tokens.where(F.col("kind") == 1).select(F.col("stay_id").alias("__s"), epoch_us("charttime").alias("__t"))
    rows = rows.withColumn("__m", F.floor(F.col("__t") / F.lit(SUB_US)).cast("long"))
    own = times.join(rows, (F.col("stay_id") == F.col("__s")) & (F.col("__am") == F.col("__m")) & (F.col("__t") <= F.col("__us")))
    inside = earlier.select(*at, "c").unionByName(own.select(*at, F.lit(1).cast("long").alias("c"))).groupBy(
        *[F.col(c).alias(c + "2") for c in at]).agg(F.sum("c").alias("__inside"))
    stays = grid.groupBy(F.col("stay_id").alias("__stay")).agg(
        F.min("ah0").alias("__first"), F.max("ah1").alias("__last"),
        (F.max(F.col("c_before") + F.col("c")) + F.max(F.col("ah1") - F.col("ah0"))).alias("__all"))
    upto = F.col("__ah") - F.col("__gah0") + F.col("__gc_before") + F.when(F.col("__ah") > F.col("__gah"), F.col("__gc")).otherwise(F.lit(0))
    got = (at_unit(r.join(stays, F.col("stay_id") == F.col("__stay"), "left"), grid, "__ah").withColumn("__upto", upto)
           .join(inside, (F.col("stay_id") == F.col("stay_id2")) & (F.col("__us") == F.col("__us2")), "left"))
    cut = (F.when(F.col("__ah") > F.col("__last"), F.col("__all"))
           .when(F.col("__ah") >= F.col("__first"), F.col("__upto") + F.coalesce("__inside", F.lit(0)))
           .otherwise(F.lit(0)))
    return got.select(*key, cut.cast("long").alias("cut"), F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")
