"""Lab-value and culture evaluations (the reference's lab/culture scripts).

test stays -> nth occurrence of each target (cut just after it) -> value read
at +1 -> conditional next-token probability of the classes of interest from
the model fitted on the other stays -> AUROC / AP per target, in one grouped
pass for all targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import cohorts, metrics, scoring
from eventide.operators.scan import at_offset
from eventide.plans import params as P
from eventide.plans.workspace import Workspace


def examples(ws: Workspace, targets: Sequence[str]) -> DataFrame:
    """``target, stay_id, occ, pos, cut, val_token, c1, c2`` per example."""
    ex = cohorts.nth_occurrences(ws.test_tokens, targets, levels=ws.scan_levels)
    ex = cohorts.value_after(ex)
    ex = at_offset(ex, ws.test_tokens, "pos", -1, ["token_id", "pos"], prefix="prev_")
    return ex.select("target", "stay_id", "occ", "pos", "cut", "val_token",
                     F.coalesce("token_id", F.lit(scoring.NONE)).alias("c1"),
                     F.when(F.col("prev_pos").isNotNull(),
                            F.coalesce("prev_token_id", F.lit(scoring.NONE))).alias("c2"))


def class_requests(ex: DataFrame, vocab: DataFrame, classes: dict[str, str]) -> DataFrame:
    """One row per example and class of interest, with the class token id."""
    arr = F.array(*[F.struct(F.lit(k).alias("which"), F.lit(v).alias("cls_token"))
                    for k, v in classes.items()])
    r = ex.select("*", F.explode(arr).alias("__c")).select("*", "__c.*").drop("__c")
    v = vocab.select(F.col("token").alias("cls_token"), F.col("token_id").alias("target_id"))
    return r.join(v, "cls_token", "left") \
        .withColumn("target_id", F.coalesce("target_id", F.lit(scoring.NONE)))


def lab_panel(ws: Workspace, targets: Sequence[str] = P.LAB_TARGETS,
              model: scoring.NgramModel | None = None) -> DataFrame:
    """Long report ``(target, metric, value)``: low / high AUROC and AP."""
    m = model or ws.model
    ex = examples(ws, targets)
    req = class_requests(ex, ws.vocab, {"low": P.LOW, "high": P.HIGH})
    sc = scoring.score(req, m).withColumn("y", (F.col("val_token") == F.col("cls_token")).cast("int"))
    met = metrics.ranking_metrics(sc, ["target", "which"], "p", "y")
    return met.select("target", F.explode(F.array(
            F.struct(F.concat("which", F.lit("_auroc")).alias("metric"), F.col("auroc").alias("value")),
            F.struct(F.concat("which", F.lit("_ap")).alias("metric"), F.col("ap").alias("value"))))
            .alias("m")).select("target", "m.metric", F.round("m.value", 6).alias("value"))


def culture_panel(ws: Workspace, model: scoring.NgramModel | None = None) -> DataFrame:
    m = model or ws.model
    ex = examples(ws, [P.CULTURE_TARGET])
    req = class_requests(ex, ws.vocab, {"growth": P.RESULT_TOKENS[0]})
    sc = scoring.score(req, m).withColumn("y", (F.col("val_token") == F.col("cls_token")).cast("int"))
    met = metrics.ranking_metrics(sc, ["target"], "p", "y")
    return met.select("target", "n", "n_pos", F.round("auroc", 6).alias("auroc"),
                      F.round("ap", 6).alias("ap"))
