"""Expected outcome of a rollout that ends at an hour token.

An absorbing chain over ``(last token, hours left)``: each step emits a token by
the order-1 back-off model, an hour token lowers the hours left by one, and the chain
ends when none is left.  For every start the table holds the expected number of target
tokens, the probability of at least one (first passage), and the expected number of
tokens, all by backward steps::

    v(c, h) = sum_t P(t | c) * (reward(t) + v(t, h - is_hour(t))),   v(., 0) = 0

``P`` is sparse but for its order-0 part.  That part is a state of its own (``NONE``):
a token passes to it with the order-0 weight, and it emits by order 0.  So a step is
one join on observed bigrams and two edges a token, and no table of all token pairs
is ever formed.

The mass still alive is carried along (``alive``); the steps stop when it is at most
the tolerance for every start, which bounds what further steps could add, or when it
no longer falls (no hour token can be reached).  It is reported with the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from eventide.operators.scoring import DEFAULT, NONE, NgramModel, Smoothing
from eventide.operators.settled import settled

TOLERANCE = 1e-9
STEPS_A_JOB = 5  # steps planned together; a deeper plan costs more to analyse than a small table to write


def edges(m: NgramModel, vocab: DataFrame, s: Smoothing = DEFAULT) -> DataFrame:
    """``(c, t, q)``: transitions of the chain; those to ``NONE`` emit nothing."""
    lam = s.l1 + s.l2
    ids = vocab.where(F.col("token_id") > 0).select(F.col("token_id").alias("c"))
    seen = ids.join(m.t1.withColumnRenamed("c1", "c"), "c", "left")
    bigrams = m.m1.where(F.col("c1") > 0).withColumnRenamed("c1", "c").join(m.t1.withColumnRenamed("c1", "c"), "c").select(
        "c", F.col("token_id").alias("t"), (F.lit(lam) * F.col("n1") / F.col("n1c")).alias("q"))
    down = seen.select("c", F.lit(NONE).alias("t"), F.when(F.col("n1c") > 0, F.lit(s.l0)).otherwise(F.lit(s.l0 + lam)).alias("q"))
    zero = ids.withColumnRenamed("c", "token_id").join(m.m0, "token_id", "left").select(
        F.lit(NONE).alias("c"), F.col("token_id").alias("t"),
        ((F.coalesce("n0", F.lit(0)) + F.lit(s.alpha)) / F.lit(m.total + s.alpha * m.vocab_size)).alias("q"))
    return bigrams.unionByName(down).unionByName(zero)


def hour_horizon(m: NgramModel, vocab: DataFrame, target_id: int, hours: int, s: Smoothing = DEFAULT,
                 tolerance: float = TOLERANCE, hour_prefix: str = "hour.") -> DataFrame:
    """``(c1, expected, first_passage, n_tokens, alive)`` by start token, with
    ``hours`` hour tokens to go; ``c1 = NONE`` is a start that is unknown or missing."""
    is_hour = F.col("token").startswith(hour_prefix).cast("int")
    kinds = vocab.where(F.col("token_id") > 0).select(F.col("token_id").alias("t2"), is_hour.alias("hour"))
    e = edges(m, vocab, s).join(kinds, F.col("t") == F.col("t2"), "left").select(
        "c", "t", "q", F.coalesce("hour", F.lit(0)).alias("hour"), (F.col("t") == target_id).cast("double").alias("hit"),
        (F.col("t") != NONE).cast("double").alias("emits"))
    e = settled(e, "horizon-edges")
    zero = F.lit(0.0)
    state = e.select(F.col("c").alias("k")).distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(hours))).alias("h"))
    state = state.select("k", "h", zero.alias("expected"), zero.alias("passed"), zero.alias("length"),
                         (F.col("h") > 0).cast("double").alias("alive"))
    over = state.where("h = 0")  # these never change
    left = float("inf")
    while True:
        for _ in range(STEPS_A_JOB):
            met = e.join(state, e["t"] == state["k"]).withColumn("to", F.col("h") + F.col("hour")).where(
                F.col("to").between(1, hours))
            step = met.groupBy(F.col("c").alias("k"), F.col("to").alias("h")).agg(
                F.sum(F.col("q") * (F.col("hit") + F.col("expected"))).alias("expected"),
                F.sum(F.col("q") * F.when(F.col("hit") > 0, 1.0).otherwise(F.col("passed"))).alias("passed"),
                F.sum(F.col("q") * (F.col("emits") + F.col("length"))).alias("length"),
                F.sum(F.col("q") * F.col("alive")).alias("alive"))
            state = step.unionByName(over)
        seen = Observation()  # the mass left is observed as the state is written
        state = settled(state.observe(seen, F.max("alive").alias("most"), F.sum("alive").alias("total")), "horizon-state")
        most, total = (seen.get[k] or 0.0 for k in ("most", "total"))
        if most <= tolerance or total >= left * (1 - 1e-12):
            break
        left = total
    return state.where(F.col("h") == hours).select(
        F.col("k").alias("c1"), "expected", F.col("passed").alias("first_passage"), F.col("length").alias("n_tokens"), "alive")
