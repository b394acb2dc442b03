"""Scans and adapters.

Every reader names the columns it needs, so the parquet scan carries a pruned
``ReadSchema`` and filters written later are pushed into it by Catalyst.

Logical tables (the shapes the evaluation code expects):

* ``raw_events``: stay_id, charttime TIMESTAMP_NTZ, row_id, item, value, k
* ``splits``: stay_id, testset
* ``stay_detail``: stay_id, los_days
* ``shifts``: stay_id, shift_start, y
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.stream import epoch_us, from_epoch_us

# fixed values of the adapters
TEST_MODULUS = 10            # stay_id % 10 == 0 is the held-out test split
SHIFT_START_HOUR = 19        # overnight shift starts 19:00
SHIFT_HOURS = 12             # label horizon
SHIFT_LABEL_ITEM = "purchase"
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw clinical events: user = stay, event_type = item."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_id", "event_type",
                                              "value", "props"])
    return ev.select(F.col("user_id").alias("stay_id"), F.col("ts").alias("charttime"),
                     F.col("event_id").alias("row_id"), F.col("event_type").alias("item"),
                     F.col("value").cast("double").alias("value"),
                     F.get_json_object("props", "$.k").cast("int").alias("k"))


# every column of a lineitem row, used as the tie-break of the stream order
LINEITEM_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def lineitem_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second adapter: ``orders JOIN lineitem``; customer = stay, ship date =
    time, return flag = item, quantity = value.  Whole rows are the order key
    because ``(l_orderkey, l_linenumber)`` repeats."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    li = read_table(spark, sf_dir, "lineitem", LINEITEM_ORDER + ["l_shipdate"])
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("o_custkey").alias("stay_id"), F.col("l_shipdate").alias("charttime"),
                    F.col("l_linenumber").cast("long").alias("row_id"),
                    F.col("l_returnflag").alias("item"),
                    F.col("l_quantity").cast("double").alias("value"),
                    F.col("l_linenumber").cast("int").alias("k"), *LINEITEM_ORDER)


def splits(raw: DataFrame) -> DataFrame:
    """``(stay_id, testset)``: one row per stay."""
    return (raw.select("stay_id").distinct()
            .select("stay_id", in_testset("stay_id").alias("testset")))


def in_testset(stay: str) -> Column:
    """The rule that splits stays into test and training."""
    return F.pmod(stay, F.lit(TEST_MODULUS)) == 0


def stay_detail(raw: DataFrame) -> DataFrame:
    """``(stay_id, los_days)``: elapsed time from first to last event."""
    us = epoch_us("charttime")
    return (raw.groupBy("stay_id").agg(F.min(us).alias("a"), F.max(us).alias("b"))
            .select("stay_id", ((F.col("b") - F.col("a")) / F.lit(float(DAY_US))).alias("los_days")))


def shift_key(us_col) -> "F.Column":
    """Start (epoch us) of the overnight shift an instant falls in, or NULL.

    A shift runs from 19:00 for 12 hours, so an instant belongs to the shift
    of its own day from 19:00 and to the previous day's before 07:00; this
    turns the horizon range join into an equi-join on the shift start.
    """
    day = F.floor(us_col / F.lit(DAY_US)).cast("long")
    start_today = day * F.lit(DAY_US) + F.lit(SHIFT_START_HOUR * HOUR_US)
    start_prev = start_today - F.lit(DAY_US)
    return (F.when(us_col >= start_today, start_today)
            .when(us_col < start_prev + F.lit(SHIFT_HOURS * HOUR_US), start_prev))


def shifts(raw: DataFrame) -> DataFrame:
    """One overnight shift per (stay, active day) at 19:00; ``y`` = a
    ``purchase`` event inside ``[start, start + 12 h)`` of the same stay."""
    us = epoch_us("charttime")
    days = (raw.select("stay_id", (F.floor(us / F.lit(DAY_US)).cast("long") * F.lit(DAY_US)
                                   + F.lit(SHIFT_START_HOUR * HOUR_US)).alias("s_us"))
            .distinct())
    hits = (raw.where(F.col("item") == SHIFT_LABEL_ITEM)
            .select("stay_id", shift_key(us).alias("s_us"))
            .where(F.col("s_us").isNotNull())
            .groupBy("stay_id", "s_us").agg(F.lit(1).alias("y")))
    out = days.join(hits, ["stay_id", "s_us"], "left")
    return out.select("stay_id", from_epoch_us(F.col("s_us")).alias("shift_start"),
                      F.coalesce("y", F.lit(0)).cast("int").alias("y"))
