"""Dose prediction (the reference's dose script).

Each drug administration in a test stay is an example: cut the stream as of
its time (inclusive), find the last drug token in the cut, read the unit at
+1 and the dose magnitude at +2, build the prompt ``stream before the drug +
[drug, unit]`` (tail block, left-padded), and score the ten magnitudes.
Metrics: macro AUROC / AP over the ten classes and the top decile alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.tokens import suffix_int
from eventide.operators import blocks, metrics, scoring
from eventide.plans import params as P
from eventide.plans.workspace import Workspace


def dose_examples(ws: Workspace, drug: str = P.DRUG) -> DataFrame:
    """``stay_id, row_id, charttime, last_pos, unit_token, dose`` per drug
    event of a test stay (events sharing a time resolve to the same last
    drug position, and the duplicates are kept, as in the reference)."""
    drugs = ws.test_tokens.where(F.col("token") == drug).select("stay_id", "row_id", "charttime", "pos", "next1", "next2")
    # the last drug token at or before t is the last one at time t itself,
    # because the example's own drug is inside the inclusive cut
    last = drugs.groupBy("stay_id", "charttime").agg(F.max_by(F.struct("pos", "next1", "next2"), "pos").alias("l"))
    ex = drugs.select("stay_id", "row_id", "charttime").join(last, ["stay_id", "charttime"])
    ex = ex.where(F.col("l.next2").startswith("magnitude."))
    voc = ws.vocab.select(F.col("token").alias("unit_token"), F.col("token_id").alias("unit_id"))
    ex = ex.select("stay_id", "row_id", "charttime", F.col("l.pos").alias("last_pos"), F.col("l.next1").alias("unit_token"),
                   suffix_int("l.next2").alias("dose"))
    return ex.join(voc, "unit_token", "left").withColumn("unit_id", F.coalesce("unit_id", F.lit(scoring.NONE)))


def dose_prompts(ws: Workspace, ex: DataFrame) -> DataFrame:
    """Prompt = tail block ending with ``[drug, unit]`` = positions up to
    ``last_pos + 1``, left-padded."""
    req = ex.withColumn("cut", F.col("last_pos") + 2)
    pb = blocks.padded_blocks(req, ws.test_tokens, ["stay_id", "row_id"], P.BLOCK)
    return pb


def dose_scores(ws: Workspace, ex: DataFrame, m: scoring.NgramModel, drug: str = P.DRUG) -> DataFrame:
    """P(magnitude.c | drug, unit) for c = 0..9, with ``y`` one-hot."""
    voc = ws.vocab.select(F.col("token").alias("__tok"), F.col("token_id").alias("__tid"))
    # the drug name rides inside the exploded rows: every id lookup is an
    # equi-join on a data column
    cls = F.array(*[F.struct(F.lit(i).alias("cls"), F.lit(f"magnitude.{i}").alias("cls_token"),
                             F.lit(drug).alias("__drug")) for i in range(10)])
    r = ex.select("*", F.explode(cls).alias("__c")).select("*", "__c.*").drop("__c")
    r = r.join(voc, F.col("__drug") == F.col("__tok"), "left") \
        .withColumn("c2", F.coalesce("__tid", F.lit(scoring.NONE))).drop("__tok", "__tid")
    r = r.join(voc, F.col("cls_token") == F.col("__tok"), "left") \
        .withColumn("target_id", F.coalesce("__tid", F.lit(scoring.NONE))).drop("__tok", "__tid")
    r = r.withColumn("c1", F.col("unit_id"))
    sc = scoring.score(r, m)
    return sc.withColumn("y", (F.col("dose") == F.col("cls")).cast("int"))


def dose_panel(ws: Workspace, drug: str = P.DRUG) -> DataFrame:
    m = ws.model
    sc = dose_scores(ws, dose_examples(ws, drug), m, drug)
    per = metrics.ranking_metrics(sc, ["cls"], "p", "y")
    # one pass over the ten per-class rows: macro (NULL if any class is
    # undefined; absent classes add 0 to AP) and the top decile alone
    one = per.agg(
        F.when(F.count("auroc") == 10, F.avg("auroc")).alias("overall_auroc"),
        (F.sum(F.coalesce("ap", F.lit(0.0))) / F.lit(10.0)).alias("overall_ap"),
        F.max(F.when(F.col("cls") == 9, F.col("auroc"))).alias("top_auroc"),
        F.max(F.when(F.col("cls") == 9, F.col("ap"))).alias("top_ap"))
    names = ["overall_auroc", "overall_ap", "top_auroc", "top_ap"]
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                                          for n in names])).alias("m"))
    return long.select(F.lit(drug).alias("target"), "m.metric", F.round("m.value", 6).alias("value"))
