"""Overnight hand-off evaluation (the reference's hand-off script).

Shifts start at 19:00 of every active day; the label is an event of interest
in the next 12 hours.  Context = the stream as of the shift start
(inclusive).  Score = mean probability of the event token over the tokens of a
rollout of the back-off chain until twelve hour tokens, started from the last
context token (the expected value of the reference's sampled rollout).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import blocks, cohorts, metrics, scoring
from eventide.operators.scan import at_offset, count_before
from eventide.operators.settled import settled
from eventide.operators.stream import at_unit, stay_lengths
from eventide.plans import params as P
from eventide.plans.workspace import Workspace
from eventide.sources import tables


def shift_labels(ws: Workspace) -> DataFrame:
    return tables.shifts(ws.raw_only)


def shift_cuts(ws: Workspace, test_only: bool = True) -> DataFrame:
    s = shift_labels(ws)
    if test_only:
        s = s.join(ws.splits.where("testset").select("stay_id"), "stay_id")
    return cohorts.asof_cut(s, ws.test_tokens if test_only else ws.tokens, ws.grid, ws.seconds, "shift_start", ws.unit)


def shift_cohort(ws: Workspace, limit: int = P.SHIFT_LIMIT) -> DataFrame:
    """The first ``limit`` test shifts in (stay, start) order: an ordered limit
    (top-k), as the reference reads a fixed number of rows.  The limit is
    this query's feature; the evaluations below take every test shift."""
    return shift_cuts(ws).orderBy("stay_id", "shift_start").limit(limit)


def shift_context(ws: Workspace) -> DataFrame:
    """Every test shift with its context: the padded tail block of the stream
    as of the shift start.  The cuts are written once: the plan of the blocks, which
    reads them three times, holds none of the as-of joins."""
    cuts = settled(shift_cuts(ws), "shift-cuts")
    return cuts.join(blocks.padded_blocks(cuts, ws.test_tokens, ["stay_id", "shift_start"], P.BLOCK), ["stay_id", "shift_start"])


def first_time_shifts(ws: Workspace) -> DataFrame:
    """The shifts of :func:`no_prior_event` with label, cut and context."""
    return shift_context(ws).join(no_prior_event(ws), ["stay_id", "shift_start"], "left_semi")


def no_prior_event(ws: Workspace, item: str = "error", min_days: float = 1.0) -> DataFrame:
    """Test shifts of stays longer than ``min_days`` with no ``item`` event
    before the shift start (the reference's "no pressors prior"): one
    aggregate (first time per stay) and an equi-join, no range join."""
    s = shift_labels(ws).join(ws.splits.where("testset").select("stay_id"), "stay_id")
    long = ws.stay_detail.where(F.col("los_days") > min_days).select("stay_id")
    first = ws.raw_only.where(F.col("item") == item).groupBy("stay_id") \
        .agg(F.min("charttime").alias("first_t"))
    s = s.join(long, "stay_id").join(first, "stay_id", "left")
    return s.where(F.col("first_t").isNull() | (F.col("first_t") >= F.col("shift_start"))) \
        .select("stay_id", "shift_start")


def last_tokens(ws: Workspace, cohort: DataFrame) -> DataFrame:
    """``cohort`` with ``start``: the last token before the cut; order 0 (``NONE``) if
    there is none or training never saw it."""
    last = at_offset(cohort.withColumn("__lp", F.col("cut") - 1), ws.test_tokens, "__lp", 0, ["token_id"], prefix="l_")
    return last.withColumn("start", F.coalesce("l_token_id", F.lit(scoring.NONE))).drop("__lp", "l_token_id")


def horizon_scores(ws: Workspace, cohort: DataFrame, m: scoring.NgramModel | None = None) -> DataFrame:
    if m is None:
        hs = ws.horizon(P.HORIZON_TOKEN, P.HORIZON_STEPS)
    else:
        tid = ws.vocab.where(F.col("token") == P.HORIZON_TOKEN).select("token_id").first()
        hs = scoring.horizon_scores(m, ws.vocab, tid[0] if tid else -1, P.HORIZON_STEPS)
    last = last_tokens(ws, cohort)
    return last.join(hs, F.col("start") == F.col("c1"), "left").select("stay_id", "shift_start", "y", "cut", "score")


def hour_scores(ws: Workspace, cohort: DataFrame) -> DataFrame:
    """Expected outcome of the rollout until ``HORIZON_HOURS`` hour tokens."""
    hs = ws.hour_horizon(P.HORIZON_TOKEN, P.HORIZON_HOURS)
    return last_tokens(ws, cohort).join(hs, F.col("start") == F.col("c1")).select(
        "stay_id", "shift_start", "y", "cut", "expected", "first_passage", "n_tokens", "alive")


def hour_horizon(ws: Workspace, cohort: DataFrame, hours: int = P.HORIZON_HOURS,
                 token: str = P.HORIZON_TOKEN) -> DataFrame:
    """Observed continuation after the cut, stopped by hour tokens: tokens
    whose hour count since the cut is at most ``hours`` (the (hours+1)-th
    hour token and everything after it are masked, as in the reference's
    ``<=`` mask).  Where it ends follows from the grid; target tokens are counted
    by two prefix counts, at the cut and at the end, so no request reads its hours.
    """
    c = at_offset(cohort.withColumn("__lp", F.col("cut") - 1), ws.test_tokens, "__lp", 0, ["hour_no"], prefix="c_")
    c = c.withColumn("__h", F.coalesce("c_hour_no", F.lit(0)) + F.lit(hours))
    grid = ws.grid.where("testset")
    total = stay_lengths(grid, "__all").withColumnRenamed("stay_id", "__s")
    c = at_unit(c.join(total, F.col("stay_id") == F.col("__s")), grid, "__h", relative=True)
    c = c.select("stay_id", "shift_start", "cut", F.coalesce(
        F.col("__h") + F.col("__gc_before") + F.col("__gc"), F.col("__all")).alias("end"))
    hits = ws.test_tokens.where(F.col("token") == token).select("stay_id", "pos")
    c = count_before(c, hits, "cut", "__k0", levels=ws.scan_levels)
    c = count_before(c, hits, "end", "__k1", levels=ws.scan_levels)
    return c.select("stay_id", "shift_start", (F.col("end") - F.col("cut")).cast("long").alias("n_tokens"),
                    (F.col("__k1") - F.col("__k0")).cast("long").alias("n_target"))


def handoff_panel(ws: Workspace) -> DataFrame:
    # the reference's score: the target's mean probability over the tokens of the rollout
    sc = hour_scores(ws, shift_cuts(ws)).withColumn("score", F.col("expected") / F.col("n_tokens"))
    met = metrics.ranking_metrics(sc.withColumn("t", F.lit("handoff")), ["t"], "score", "y")
    return met.select(F.col("t").alias("target"), F.explode(F.array(
        F.struct(F.lit("auroc").alias("metric"), F.col("auroc").alias("value")),
        F.struct(F.lit("ap").alias("metric"), F.col("ap").alias("value")))).alias("m")) \
        .select("target", "m.metric", F.round("m.value", 6).alias("value"))
