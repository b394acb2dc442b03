"""Fixed-size blocks: tail block before a cut, left padding, history bag,
non-overlapping training blocks, next-token labels, splits and draws.

Long form is kept as long as possible; arrays are built only per block, and a
block never has more than ``block_size`` elements.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.arrays import left_pad
from eventide.functions.hashing import uniform
from eventide.operators.scan import at_offset


def tail_rows(examples: DataFrame, tokens: DataFrame, key: Sequence[str], block: int,
              cut_col: str = "cut") -> DataFrame:
    """Tokens of the tail block ``[max(0, cut - block), cut)`` per example,
    with ``i`` = index inside the left-padded block.

    A window of ``block`` positions overlaps at most two aligned blocks, so
    each example asks for two block keys and meets the stream on an
    equi-join over ``(stay, pos div block)``: bounded, whatever the stay size.
    """
    ex = examples.select(*key, "stay_id", F.col(cut_col).alias("__cut"))
    ex = ex.select("*", F.explode(F.array_distinct(F.array(
        F.floor((F.col("__cut") - block) / block).cast("long"),
        F.floor((F.col("__cut") - 1) / block).cast("long")))).alias("__b"))
    tk = tokens.select(F.col("stay_id").alias("__s"), F.col("pos").alias("__p"),
                       F.coalesce("token_id", F.lit(0)).alias("__t"),
                       F.floor(F.col("pos") / block).cast("long").alias("__tb"))
    j = ex.join(tk, (F.col("stay_id") == F.col("__s")) & (F.col("__b") == F.col("__tb")))
    j = j.where((F.col("__p") >= F.col("__cut") - block) & (F.col("__p") < F.col("__cut")))
    return j.select(*key, "stay_id", F.col("__p").alias("pos"),
                    (F.col("__p") - (F.col("__cut") - block)).alias("i"),
                    F.col("__t").alias("token_id"))


def rows_to_block(rows: DataFrame, key: Sequence[str], block: int, order: str = "i",
                  value: str = "token_id") -> DataFrame:
    """Ordered array per example, left-padded with 0 to ``block``."""
    arr = (rows.groupBy(*key)
           .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                     F.col(value).alias("v")))).alias("__s")))
    return arr.select(*key, left_pad(F.transform("__s", lambda x: x["v"]), block).alias("block"))


def padded_blocks(examples: DataFrame, tokens: DataFrame, key: Sequence[str], block: int,
                  cut_col: str = "cut") -> DataFrame:
    rows = tail_rows(examples, tokens, key, block, cut_col)
    return examples.select(*key).join(rows_to_block(rows, key, block), list(key), "left") \
        .select(*key, F.coalesce("block", F.array_repeat(F.lit(0), block)).alias("block"))


def history_bag(examples: DataFrame, tokens: DataFrame, key: Sequence[str], block: int,
                cut_col: str = "cut", max_pos: int | None = None) -> DataFrame:
    """Counts of ``token_id`` before the block start ``s = cut - block``.

    The prefix ``[0, s)`` is split into whole chunks of ``block`` positions
    and a partial chunk.  Whole chunks are answered from per-chunk counts
    summed over a dyadic decomposition (at most log2(chunks) lookups per
    example), so no example ever reads its whole history row by row.
    """
    C = block
    tk = tokens.select("stay_id", "pos", F.coalesce("token_id", F.lit(0)).alias("token_id"))
    if max_pos is None:
        max_pos = tk.agg(F.max("pos")).first()[0] or 0
    levels = max(1, math.ceil(math.log2(max_pos // C + 2)))
    ex = examples.select(*key, "stay_id", (F.col(cut_col) - block).alias("__s")) \
        .where(F.col("__s") > 0)
    ex = ex.withColumn("__k", F.floor(F.col("__s") / C).cast("long"))

    # dyadic pieces: level b covers chunks [(idx) * 2^b, (idx + 1) * 2^b)
    per_chunk = tk.groupBy("stay_id", F.floor(F.col("pos") / C).cast("long").alias("chunk"),
                           "token_id").agg(F.count("*").alias("n"))
    pieces = per_chunk.select("stay_id", "token_id", "n",
                              F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("lvl"),
                              "chunk") \
        .withColumn("idx", F.expr("shiftright(chunk, lvl)")) \
        .groupBy("stay_id", "lvl", "idx", "token_id").agg(F.sum("n").alias("n"))
    req = ex.select(*key, "stay_id", "__k",
                    F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("lvl"))
    req = req.where(F.expr("shiftright(__k, lvl) & 1") == 1) \
        .withColumn("idx", F.expr("shiftright(__k, lvl) - 1"))
    whole = req.join(pieces, ["stay_id", "lvl", "idx"]).select(*key, "token_id", "n")

    # partial chunk: positions [k * C, s)
    tkc = tk.select(F.col("stay_id").alias("__st"), "pos", "token_id",
                    F.floor(F.col("pos") / C).cast("long").alias("__c"))
    part = ex.join(tkc, (F.col("stay_id") == F.col("__st")) & (F.col("__k") == F.col("__c"))
                   & (F.col("pos") < F.col("__s")))
    part = part.groupBy(*key, "token_id").agg(F.count("*").alias("n"))
    return whole.unionByName(part).groupBy(*key, "token_id").agg(F.sum("n").alias("n"))


def training_blocks(tokens: DataFrame, block: int) -> DataFrame:
    """Non-overlapping blocks ``b`` covering ``[b * T, (b + 1) * T)`` of each
    stay: ``(stay_id, b, x)`` with x left-padded to T, and ``y`` = x followed
    by the token after the block (0 at the end): T + 1 labels, one per
    logit position (memory slot first)."""
    tk = tokens.select("stay_id", "pos", F.coalesce("token_id", F.lit(0)).alias("token_id"),
                       "testset")
    rows = tk.withColumn("b", F.floor(F.col("pos") / block).cast("long"))
    blocks = rows.groupBy("stay_id", "b").agg(
        F.first("testset").alias("testset"),
        F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("__s"))
    blocks = blocks.select("stay_id", "b", "testset",
                           left_pad(F.transform("__s", lambda x: x["token_id"]), block).alias("x"),
                           ((F.col("b") + 1) * block).alias("__next"))
    nxt = at_offset(blocks, tk, "__next", 0, ["token_id"], prefix="n_")
    return nxt.select("stay_id", "b", "testset", "x",
                      F.concat("x", F.array(F.coalesce("n_token_id", F.lit(0)))).alias("y"))


def split_column(key_cols: Sequence[str], frac: float = 0.9) -> F.Column:
    """'train' / 'val' from a reproducible hash uniform of the keys."""
    return F.when(uniform(*key_cols) < F.lit(frac), F.lit("train")).otherwise(F.lit("val"))

