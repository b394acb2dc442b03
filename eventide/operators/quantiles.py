"""Exact per-group quantiles (linear interpolation) that survive hot groups.

``percentile`` keeps every distinct value of a group in one task, which fails
when one item holds a third of the data.  Here:

1. a mergeable sketch (``percentile_approx``, partial aggregation, bounded
   state) gives for each target quantile ``q`` a value band
   ``[approx(q - 3/accuracy), approx(q + 3/accuracy)]``; the sketch's ranks are
   off by ``n / accuracy`` at most, so the band holds both order statistics that the
   interpolation needs (ranks ``floor`` and ``ceil`` of ``q * (n - 1)``).  Groups
   of up to ``accuracy`` rows, where that margin is under a rank, take all their values;
2. one pass counts the values below each band (partial aggregate);
3. the values inside the bands collapse to ``(group, quantile, value, count)``
   by partial aggregate, so ties are one row;
4. each band is cut into ``BINS`` bins at its own sketched quantiles, the bins' counts are
   summed in order (a row a bin), and a running sum descends into the bins that hold the wanted
   ranks.  So no window spans a band: with all values of one hot group distinct, a
   band of n rows is read in windows of about ``n / BINS``.

Nothing is repeated, capped or switched by size: a band of ties is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.settled import settled

ACCURACY = 10_000
BINS = 256
SKETCH_ERROR = 0.015  # of a merged sketch's ranks, twice what its k allows for


def exact_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """Rows ``(group, qi, edge)``: the ``probs[qi]`` quantile of ``value``
    per ``group``, equal to ``quantile_cont`` / ``percentile``."""
    probs = [float(p) for p in probs]
    k = len(probs)
    vals = (df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
            .where(F.col("v").isNotNull() & ~F.isnan("v")))
    margin = 3.0 / accuracy
    sk = vals.groupBy("g").agg(
        F.count("*").alias("n"),
        F.percentile_approx("v", [max(0.0, p - margin) for p in probs], accuracy).alias("lo"),
        F.percentile_approx("v", [min(1.0, p + margin) for p in probs], accuracy).alias("hi"))
    whole = F.col("n") <= accuracy
    target = [(F.col("n") - 1).cast("double") * F.lit(p) for p in probs]
    bands = settled(sk.select("g", F.array(*[F.struct(
        F.lit(i).alias("qi"), target[i].alias("rn"),
        F.floor(target[i]).cast("long").alias("r1"), F.ceil(target[i]).cast("long").alias("r2"),
        F.when(whole, F.lit(float("-inf"))).otherwise(F.col("lo")[i]).alias("lo"),
        F.when(whole, F.lit(float("inf"))).otherwise(F.col("hi")[i]).alias("hi"))
        for i in range(k)]).alias("s")), "quantile-bands")

    # per-group arrays: one row per value, no k-fold copy
    met = vals.join(bands, "g")
    below = met.groupBy("g").agg(*[F.count_if(F.col("v") < F.col("s")[i]["lo"]).alias(f"b{i}") for i in range(k)])
    below = settled(below.select("g", F.array(*[f"b{i}" for i in range(k)]).alias("below")), "quantile-below")
    inside = F.filter("s", lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))
    inband = (met.select("g", "v", F.explode(inside).alias("b"))
              .groupBy("g", F.col("b.qi").alias("qi"), F.col("b.rn").alias("rn"), F.col("b.r1").alias("r1"),
                       F.col("b.r2").alias("r2"), "v").agg(F.count("*").alias("c")))
    inband = settled(inband, "quantile-band-values")
    cuts = inband.groupBy("g", "qi").agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], 16 * BINS).alias("cuts"))
    cuts = settled(cuts.select("g", "qi", F.array_distinct("cuts").alias("cuts")), "quantile-bins")
    binned = inband.join(cuts, ["g", "qi"]).withColumn("bin", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    # ranks before each bin: windows over at most BINS rows of a band
    over = Window.partitionBy("g", "qi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("g", "qi", "r1", "r2", "bin").agg(F.sum("c").alias("held")).join(below, "g")
    start = F.get("below", F.col("qi")) + F.coalesce(F.sum("held").over(over), F.lit(0))
    bins = bins.withColumn("start", start)

    def holds(rank: str):
        return (F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("start") + F.col("held"))

    wanted = settled(bins.where(holds("r1") | holds("r2")).select("g", "qi", "bin", "start"), "quantile-wanted")  # two bins a band
    w = Window.partitionBy("g", "qi", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.join(wanted, ["g", "qi", "bin"]).withColumn("first", F.col("start") + F.coalesce(F.sum("c").over(w), F.lit(0)))
    first = F.col("first")

    def at(rank: str):
        return F.max(F.when((first <= F.col(rank)) & (F.col(rank) < first + F.col("c")), F.col("v")))

    agg = ranked.groupBy("g", "qi", "rn", "r1", "r2").agg(at("r1").alias("v1"), at("r2").alias("v2"))
    edge = F.col("v1") + (F.col("v2") - F.col("v1")) * (F.col("rn") - F.col("r1"))
    return agg.select(F.col("g").alias(group), F.col("qi").cast("int").alias("qi"),
                      F.when(F.col("r1") == F.col("r2"), F.col("v1")).otherwise(edge).alias("edge"))


def edges_as_arrays(q: DataFrame, group: str) -> DataFrame:
    """``(group, edges ARRAY<DOUBLE>)`` ordered by quantile index."""
    return (q.groupBy(group)
            .agg(F.array_sort(F.collect_list(F.struct("qi", "edge"))).alias("s"))
            .select(group, F.transform("s", lambda x: x["edge"]).alias("edges")))


def daily_sketches(df: DataFrame, group: str, day: str, value: str, k: int = 400) -> DataFrame:
    """``(group, day, sketch, n)``: one KLL sketch an item and day, a few kB
    each, to be stored and merged for any range of days without a rescan."""
    rows = df.select(group, day, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.groupBy(group, day).agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"), F.count("*").alias("n"))


def merged_quantiles(sketches: DataFrame, group: str, probs: Sequence[float]) -> DataFrame:
    """``(group, n, qi, edge)`` of the union of the given sketches: an aggregate
    over sketches, not over values."""
    merged = sketches.groupBy(group).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    q = F.array(*[F.lit(float(p)) for p in probs])
    edges = merged.select(group, "n", F.kll_sketch_get_quantile_double("sketch", q).alias("edges"))
    return edges.select(group, "n", F.posexplode("edges").alias("qi", "edge"))
