"""Ranking metrics as grouped aggregates: AUROC (ties count one half) and
average precision (step sum over distinct thresholds), per group and macro.

Rows are first collapsed to distinct ``(group, score)`` with positive and
negative counts (partial aggregation).  The running counts the formulas need
are exclusive prefix sums in ascending score order, done in two levels: a
window inside a score bucket, and a window over per-bucket totals.  The bucket
bounds are the group's own sketched quantiles of its distinct scores, so buckets are
about equally large whatever the scores' scale; a bucket is an interval, so order and
ties are kept.

Undefined cases follow the usual library rules: AUROC is NULL when a group
has only one class; AP is 0 when it has no positive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.settled import settled

BUCKETS = 128


def _collapse(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    return (df.groupBy(*group, F.col(score).alias("s"))
            .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("cnt"))
            .withColumn("neg", F.col("cnt") - F.col("pos")))


def bucketed(d: DataFrame, group: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``bkt``: the number of the group's score quantiles below ``s``."""
    cuts = d.groupBy(*group).agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("cuts"))
    cuts = settled(cuts.select(*group, F.array_distinct("cuts").alias("cuts")), "score-cuts")
    return d.join(cuts, group).withColumn("bkt", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")


def _ascending_prefix(d: DataFrame, group: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums of pos, neg, cnt in ascending score order."""
    sums = ("pos", "neg", "cnt")
    d = bucketed(d, group)
    w = Window.partitionBy(*group, "bkt").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c + "_in") for c in sums])
    over = Window.partitionBy(*group).orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    tot = d.groupBy(*group, "bkt").agg(*[F.sum(c).alias(c) for c in sums])
    tot = tot.select(*group, "bkt", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(c + "_before") for c in sums])
    d = d.join(tot, [*group, "bkt"])
    for c in sums:
        d = d.withColumn(c + "_lt", F.col(c + "_in") + F.col(c + "_before"))
    return d


def ranking_metrics(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """``(*group, n, n_pos, auroc, ap)`` per group."""
    group = list(group)
    # one row per distinct score, settled: the scan below reads it several times
    d = _ascending_prefix(settled(_collapse(df, group, score, label), "scores"), group)
    totals = d.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("cnt").alias("N_all"))
    d = d.join(totals, group)
    tp = F.col("P") - F.col("pos_lt")           # positives with score >= s
    cnt = F.col("N_all") - F.col("cnt_lt")      # rows with score >= s
    d = d.select(*group, "P", "N_all",
                 (F.col("pos").cast("double") * (F.col("neg_lt") + F.lit(0.5) * F.col("neg"))).alias("auc_term"),
                 F.when(F.col("P") > 0, F.col("pos") / F.col("P") * tp / cnt).alias("ap_term"))
    out = d.groupBy(*group).agg(F.first("P").alias("n_pos"), F.first("N_all").alias("n"),
                                F.sum("auc_term").alias("auc_num"), F.sum("ap_term").alias("ap_sum"))
    nneg = F.col("n") - F.col("n_pos")
    auroc = F.when((F.col("n_pos") > 0) & (nneg > 0),
                   F.col("auc_num") / (F.col("n_pos").cast("double") * nneg.cast("double")))
    ap = F.when(F.col("n_pos") > 0, F.col("ap_sum")).otherwise(F.lit(0.0))
    return out.select(*group, "n", "n_pos", auroc.alias("auroc"), ap.alias("ap"))


def macro(per_class: DataFrame, group: Sequence[str], n_classes: int) -> DataFrame:
    """Macro AUROC (NULL as soon as one class is undefined or absent) and
    macro AP (absent classes count 0) over ``n_classes`` classes."""
    group = list(group)
    agg = per_class.groupBy(*group).agg(F.count("auroc").alias("__k"), F.avg("auroc").alias("__a"),
                                        F.sum(F.coalesce("ap", F.lit(0.0))).alias("__s"))
    return agg.select(*group, F.when(F.col("__k") == n_classes, F.col("__a")).alias("macro_auroc"),
                      (F.col("__s") / F.lit(float(n_classes))).alias("macro_ap"))
