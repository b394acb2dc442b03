"""Memory of a stay's history in the next-token score.

``decayed_bag`` gives, for each example, the exponentially decayed count of every token
before its cut: a token d places before the last one weighs ``2^(-d / half_life)``.
Decay is associative (two neighbouring pieces join as ``old * decay^length + new``), so
it is answered from a dyadic tree of pieces like the plain history bag: at most
log2(chunks) lookups an example, and one partial chunk row by row.  A hot stay's pieces
spread over their own keys; no window spans a stay.

``with_memory`` joins the bag with the n-gram model in log-linear form::

    p(t) = p_ngram(t)^(1 - w) * q(t)^w / Z,   q(t) = (bag(t) + alpha) / (sum of the bag + alpha * V)

Z runs over the whole vocabulary, but all tokens that neither the bag nor the context
has are alike up to their order-0 share.  So Z is one constant of the model, corrected
at the tokens that occur: work grows with what an example has seen, not with the vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.scoring import DEFAULT, NgramModel, Smoothing

CHUNK = 256


def _decay(distance: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -distance / F.lit(float(half_life)))


def decayed_bag(examples: DataFrame, tokens: DataFrame, key: Sequence[str], half_life: float, max_pos: int,
                cut_col: str = "cut", chunk: int = CHUNK) -> DataFrame:
    """``(*key, token_id, weight)`` over the tokens with ``pos < cut``; tokens
    that training never saw have id 0."""
    tk = tokens.select("stay_id", "pos", F.coalesce("token_id", F.lit(0)).alias("token_id"),
                       F.floor(F.col("pos") / chunk).cast("long").alias("chunk"))
    levels = max(1, math.ceil(math.log2(max_pos // chunk + 2)))
    ex = examples.select(*key, "stay_id", F.col(cut_col).cast("long").alias("__cut")).where(F.col("__cut") > 0)
    ex = ex.withColumn("__k", F.floor(F.col("__cut") / chunk).cast("long"))

    # a piece's weight is as of its end; it is decayed further to the cut
    end = (F.col("chunk") + 1) * chunk
    per_chunk = tk.groupBy("stay_id", "chunk", "token_id").agg(F.sum(_decay(end - 1 - F.col("pos"), half_life)).alias("w"))
    tree = per_chunk.select("stay_id", "token_id", "w", "chunk", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("lvl"))
    tree = tree.withColumn("idx", F.expr("shiftright(chunk, lvl)"))
    piece_end = (F.col("idx") + 1) * F.expr("shiftleft(1L, lvl)") * chunk
    tree = tree.groupBy("stay_id", "lvl", "idx", "token_id").agg(F.sum(F.col("w") * _decay(piece_end - end, half_life)).alias("w"))
    req = ex.select(*key, "stay_id", "__cut", "__k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("lvl"))
    req = req.where(F.expr("shiftright(__k, lvl) & 1") == 1).withColumn("idx", F.expr("shiftright(__k, lvl) - 1"))
    whole = req.join(tree, ["stay_id", "lvl", "idx"]).select(
        *key, "token_id", (F.col("w") * _decay(F.col("__cut") - piece_end, half_life)).alias("w"))

    rows = tk.select(F.col("stay_id").alias("__s"), "pos", "token_id", "chunk")
    part = ex.join(rows, (F.col("stay_id") == F.col("__s")) & (F.col("__k") == F.col("chunk")) & (F.col("pos") < F.col("__cut")))
    part = part.select(*key, "token_id", _decay(F.col("__cut") - 1 - F.col("pos"), half_life).alias("w"))
    return whole.unionByName(part).groupBy(*key, "token_id").agg(F.sum("w").alias("weight"))


def with_memory(requests: DataFrame, bag: DataFrame, m: NgramModel, key: Sequence[str], weight: float, alpha: float = 1.0,
                s: Smoothing = DEFAULT) -> DataFrame:
    """``requests`` (unique ``key``, ``c2, c1, target_id``) with ``p_plain`` and ``p_memory``."""
    key = list(key)
    w, V = float(weight), m.vocab_size
    p0_of = lambda n: (F.coalesce(n, F.lit(0)) + F.lit(s.alpha)) / F.lit(m.total + s.alpha * V)
    # sum over the vocabulary of P0^(1 - w): tokens that were counted, and the others alike
    counted = m.m0.where(F.col("token_id") > 0).agg(F.sum(F.pow(p0_of(F.col("n0")), 1 - w)), F.count("*")).first()
    rest = (s.alpha / (m.total + s.alpha * V)) ** (1 - w) if V else 0.0
    every = float(counted[0] or 0.0) + (V - counted[1]) * rest

    r = requests.select(*key, "c2", "c1", "target_id")
    r = r.join(m.t1.withColumnRenamed("c1", "__c1"), F.col("c1") == F.col("__c1"), "left").drop("__c1")
    r = r.join(m.t2.withColumnsRenamed({"c1": "__c1", "c2": "__c2"}), (F.col("c1") == F.col("__c1")) & (F.col("c2") == F.col("__c2")),
               "left").drop("__c1", "__c2")
    # weight of P0 in the context's mixture: unseen orders hand theirs down
    kappa = F.lit(s.l0) + F.when(F.col("n1c") > 0, 0.0).otherwise(s.l1) + F.when(F.col("n2c") > 0, 0.0).otherwise(s.l2)
    r = r.withColumn("__kappa", kappa)

    ids = [*key, "token_id"]
    none = F.lit(0.0)
    from_bag = bag.select(*ids, none.alias("seen"), F.col("weight").alias("bag"), F.lit(0).alias("asked"))
    one = r.join(m.m1.withColumnRenamed("c1", "__c1"), F.col("c1") == F.col("__c1")).select(
        *ids, (F.lit(s.l1) * F.col("n1") / F.col("n1c")).alias("seen"), none.alias("bag"), F.lit(0).alias("asked"))
    two = r.join(m.m2.withColumnsRenamed({"c1": "__c1", "c2": "__c2"}), (F.col("c1") == F.col("__c1")) & (F.col("c2") == F.col("__c2"))).select(
        *ids, (F.lit(s.l2) * F.col("n2") / F.col("n2c")).alias("seen"), none.alias("bag"), F.lit(0).alias("asked"))
    asked = r.select(*key, F.col("target_id").alias("token_id"), none.alias("seen"), none.alias("bag"), F.lit(1).alias("asked"))
    rows = from_bag.unionByName(one).unionByName(two).unionByName(asked).groupBy(*ids).agg(
        F.sum("seen").alias("seen"), F.sum("bag").alias("bag"), F.max("asked").alias("asked"))
    rows = rows.join(m.m0, "token_id", "left").join(r.select(*key, "__kappa"), key).withColumn("p0", p0_of(F.col("n0")))

    # one row an example: the corrections of Z, and what the asked token has
    real = F.col("token_id") > 0  # unknown tokens are outside the vocabulary
    p = F.col("__kappa") * F.col("p0") + F.col("seen")
    out = rows.groupBy(*key).agg(
        F.sum("bag").alias("__bag"), F.first("__kappa").alias("__kappa"),
        F.sum(F.when(real, F.pow("p0", F.lit(1 - w)))).alias("__gone"),
        F.sum(F.when(real, F.pow(p, F.lit(1 - w)) * F.pow(F.col("bag") + F.lit(alpha), F.lit(w)))).alias("__met"),
        F.max(F.when(F.col("asked") == 1, p)).alias("p_plain"),
        F.max(F.when(F.col("asked") == 1, F.col("bag"))).alias("__own"))
    # q's denominator is the same for all tokens and cancels
    z = F.pow(F.lit(float(alpha)), F.lit(w)) * F.pow("__kappa", F.lit(1 - w)) * (F.lit(every) - F.coalesce("__gone", none)) + F.coalesce("__met", none)
    return out.select(*key, "p_plain", (F.pow("p_plain", F.lit(1 - w)) * F.pow(F.col("__own") + F.lit(alpha), F.lit(w)) / z).alias("p_memory"))
