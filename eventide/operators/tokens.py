"""Tokeniser: value -> decile magnitude, event -> token emission, vocabulary.

The grammar copies the four shapes a clinical token stream uses (lab name +
magnitude, drug name + unit + magnitude, culture + result, bare event).  Which
raw item takes which shape is a parameter of the adapter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.ranking import numbered
from eventide.operators.settled import settled
from eventide.operators.quantiles import edges_as_arrays, exact_quantiles

# ---- fixed values of the token grammar -------------------------------------
NULL_TOKEN = "Null event"          # id 0, also the padding id
NULL_ID = 0
DECILE_PROBS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
N_MAGNITUDES = 10                  # magnitude.0 .. magnitude.9
GROWTH = "Growth"
NO_GROWTH = "No Growth"
KIND_PREFIX = {"lab": "lab", "med": "med", "culture": "culture", "bare": "event"}
EVENTS_ITEM_KIND = {"view": "lab", "click": "lab", "purchase": "med",
                    "error": "culture", "signup": "bare"}
UNIT_DIVISOR = 25                  # unit.u with u = k div 25
GROWTH_MIN_K = 50                  # culture grows when k >= 50
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Grammar:
    item_kind: dict = field(default_factory=lambda: dict(EVENTS_ITEM_KIND))
    default_kind: str = "bare"
    unit_divisor: int = UNIT_DIVISOR
    growth_min_k: int = GROWTH_MIN_K

    def kind(self, item: Column) -> Column:
        m = F.create_map(*[x for kv in self.item_kind.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        return F.coalesce(m[item], F.lit(self.default_kind))

    def name(self, kind: Column, item: Column) -> Column:
        pref = F.create_map(*[x for kv in KIND_PREFIX.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        return F.concat(pref[kind], F.lit("."), item)


def decile_edges(raw: DataFrame) -> DataFrame:
    """Per-item decile edges fitted on training (non-test) stays:
    ``(item, qi, edge)`` long form, qi = 0..8 for 0.1..0.9."""
    train = raw.where(~F.col("testset"))
    return exact_quantiles(train, "item", "value", DECILE_PROBS)


def magnitude(value: Column, edges: Column) -> Column:
    """Number of edges strictly below the value (0..9)."""
    return F.when(edges.isNotNull() & value.isNotNull(),
                  F.size(F.filter(edges, lambda e: e < value)))


def emit(raw: DataFrame, edges_long: DataFrame, grammar: Grammar) -> DataFrame:
    """Add ``mag`` and ``toks ARRAY<STRING>`` (the emission of each event).

    ``edges_long`` is a settled table; its array form has one row per item, so
    the planner broadcasts it while it is small and the hot item never moves.
    """
    edges = edges_as_arrays(edges_long, "item")
    e = raw.join(edges, "item", "left")
    kind = grammar.kind(F.col("item"))
    name = grammar.name(kind, F.col("item"))
    mag = magnitude(F.col("value"), F.col("edges"))
    mtok = F.concat(F.lit("magnitude."), mag.cast("string"))
    unit = F.concat(F.lit("unit."), F.floor(F.col("k") / grammar.unit_divisor).cast("string"))
    result = F.when(F.col("k") >= grammar.growth_min_k, F.lit(GROWTH)).otherwise(F.lit(NO_GROWTH))
    result = F.when(F.col("k").isNotNull(), result)
    toks = (F.when(kind == "lab", F.array(name, mtok))
            .when(kind == "med", F.array(name, unit, mtok))
            .when(kind == "culture", F.array(name, result))
            .otherwise(F.array(name)))
    # a missing value (or an item that training never saw) has no magnitude: it
    # emits no token in that place, never a NULL one
    return e.withColumn("mag", mag).withColumn("toks", F.array_compact(toks)).drop("edges")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``(token, token_id)``: id 0 is the null/padding token, the rest are
    numbered 1.. in token order.

    ``tokens`` is a one-column frame of candidate tokens; it is reduced with
    a partial aggregate first, so the global numbering runs over the distinct
    tokens only (bounded by the grammar, not by the data).
    """
    spark = tokens.sparkSession
    null = spark.range(1).select(F.lit(NULL_TOKEN).alias("token"), F.lit(NULL_ID).cast("int").alias("token_id"))
    return settled(null.unionByName(_with_ids(_distinct(tokens), 1)), "vocabulary")


def _distinct(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("token").isNotNull()).select("token").distinct()


def _with_ids(distinct: DataFrame, first: int) -> DataFrame:
    """Ids from ``first`` on in token order, from per-partition offsets."""
    return numbered(distinct, ["token"]).select("token", (F.col("rn") + F.lit(first)).cast("int").alias("token_id"))


def extend_vocabulary(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """``vocab`` with the tokens it lacks: append-only, so every old id stays.
    New tokens (an anti-join) get the ids after the stored maximum, in token order."""
    top = vocab.agg(F.max("token_id")).first()[0]
    new = _distinct(tokens).join(vocab, "token", "left_anti")
    return settled(vocab.select("token", "token_id").unionByName(_with_ids(new, (NULL_ID if top is None else top) + 1)), "vocabulary")
