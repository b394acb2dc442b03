"""Synthetic-example jobs (the reference plans them in a docstring only).

* contraindicated positions: a drug given while a lab state holds, by a table of
  rules, the state being the last value of that lab carried forward (skew-safe LOCF);
* inserting an ``error`` token after such a drug, or after a drug whose dose
  is raised to the top decile; only the inserted token carries loss weight;
* splicing a fixed response sequence (with hash jitter) after a chosen hour.

Insertions renumber the stream without a stay-wide window: a token moves by
the number of insertion anchors strictly before it, which is a carried-forward
anchor count: a two-level scan over the anchors' chunks, which the stream meets once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.hashing import uniform
from eventide.functions.tokens import suffix_int
from eventide.operators.scan import join_stays, last_before, prefix_sum
from eventide.operators.settled import settled

ERROR_TOKEN = "error"
# fixed values: (drug token, lab token, lowest lab magnitude that forbids it)
RULES = (("med.purchase", "lab.view", 8),)
# fixed values: response sequence spliced after an hour token
RESPONSE = ("lab.view", "magnitude.0", "lab.click", "magnitude.0")
JITTER = 0.3
ANCHOR_CHUNK = 512  # positions of a stay that share one row of anchors
TERMINAL = "mort"
# fixed values: further kinds of response; each ends in the terminal token
RESPONSES = (
    ("lab.view", "magnitude.0", "lab.click", "magnitude.1", TERMINAL),
    ("lab.click", "magnitude.8", "lab.view", "magnitude.0", "culture.error", "Growth", TERMINAL),
    ("lab.view", "magnitude.2", TERMINAL),
)


def contraindicated(tokens: DataFrame, rules: Sequence[tuple] = RULES, levels: int = 2) -> DataFrame:
    """``(stay_id, pos, drug, state)``: drug tokens given while the last
    value of the rule's lab (before the drug) is at least the threshold."""
    table = rule_table(tokens.sparkSession, [(drug, None, lab, lo, None) for drug, lab, lo in rules])
    return forbidden(tokens, table, levels).select("stay_id", "pos", "drug", "state")


RULE_COLUMNS = "rule int, drug string, unit string, lab string, low int, high int"
# fixed values: (drug token, unit token or any, lab token, magnitudes from .. to that forbid it)
RULE_TABLE = (
    ("med.purchase", "unit.0", "lab.view", 9, None),
    ("med.purchase", "unit.1", "lab.view", None, 0),
    ("med.purchase", "unit.2", "lab.click", 8, None),
    ("med.purchase", "unit.3", "lab.click", None, 1),
    ("med.purchase", None, "lab.view", 4, 4),
    ("culture.error", None, "lab.click", 9, None),
)


def rule_table(spark: SparkSession, rules: Sequence[tuple] = RULE_TABLE) -> DataFrame:
    """Rules as a table: a drug (and its unit, if given) is forbidden while the lab's
    last magnitude lies in ``[low, high]`` (no bound where null)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], RULE_COLUMNS)


def forbidden(tokens: DataFrame, rules: DataFrame, levels: int = 2) -> DataFrame:
    """``(stay_id, pos, rule, drug, lab, state)``: drug tokens given while a rule's lab
    state holds, ``state`` being the lab's last magnitude before the drug.

    One scan and one carry, whatever the number of rules: the stream's labs and drugs that
    any rule names are read once, a drug asks once for each distinct lab of its rules, and
    the last value is carried along (stay, lab).  Rules then meet the answers on
    (drug, lab); their bounds are a condition on that equi-join."""
    rules = settled(rules, "rules")
    # what a token does: it is a lab, or it asks for labs, or both
    roles = rules.select(F.col("lab").alias("t"), F.lit(None).cast("string").alias("asks")).unionByName(
        rules.select(F.col("drug").alias("t"), F.col("lab").alias("asks")))
    roles = settled(roles.groupBy("t").agg(F.collect_set("asks").alias("asks"), F.max(F.col("asks").isNull()).alias("is_lab")), "rule-roles")
    value = F.when(F.col("next1").startswith("magnitude."), suffix_int("next1"))
    none = F.lit(None).cast("string")
    given = F.struct(F.col("token").alias("lab"), value.alias("v"), none.alias("drug"), none.alias("unit"))
    asked = F.transform("asks", lambda lab: F.struct(lab.alias("lab"), F.lit(None).cast("int").alias("v"), F.col("token").alias("drug"),
                                                     F.col("next1").alias("unit")))
    rows = tokens.select("stay_id", "pos", "token", "next1").join(roles, F.col("token") == F.col("t")).select(
        "stay_id", "pos", F.explode(F.concat(F.when(F.col("is_lab"), F.array(given)).otherwise(F.slice(F.array(given), 1, 0)), asked)).alias("r"))
    carried = last_before(rows.select("stay_id", "pos", "r.*"), ["stay_id", "lab"], "pos", "v", "state", inclusive=False, levels=levels)
    r = rules.select("rule", F.col("drug").alias("__drug"), F.col("unit").alias("__unit"), F.col("lab").alias("__lab"), "low", "high")
    on = (F.col("drug") == F.col("__drug")) & (F.col("lab") == F.col("__lab")) & (F.col("__unit").isNull() | (F.col("unit") == F.col("__unit"))) & (
        (F.col("low").isNull() | (F.col("state") >= F.col("low"))) & (F.col("high").isNull() | (F.col("state") <= F.col("high"))))
    return carried.where(F.col("drug").isNotNull() & F.col("state").isNotNull()).join(r, on).select(
        "stay_id", "pos", "rule", "drug", "lab", "state")


def insert_after(tokens: DataFrame, anchors: DataFrame, insert_token: str = ERROR_TOKEN,
                 replace: DataFrame | None = None, levels: int = 2) -> DataFrame:
    """Insert ``insert_token`` right after every anchor ``(stay_id, pos)``.

    Returns ``(stay_id, pos, token, loss_weight)``: original tokens move by
    the number of anchors before them; inserted tokens get weight 1, all
    others 0 (the loss mask: only the last token of a synthetic example
    counts).  ``replace`` optionally swaps tokens at ``(stay_id, pos)``
    before the insertion.
    """
    a = anchors.select("stay_id", "pos").distinct()
    base = tokens.select("stay_id", "pos", "token")
    if replace is not None:
        r = replace.select("stay_id", "pos", F.col("token").alias("__new"))
        base = base.join(r, ["stay_id", "pos"], "left") \
            .select("stay_id", "pos", F.coalesce("__new", "token").alias("token"))
    # the stream meets one row a chunk: the chunk's anchors and how many lie before it
    chunk = F.floor(F.col("pos") / F.lit(ANCHOR_CHUNK)).cast("long")
    held = a.groupBy(F.col("stay_id").alias("__s"), chunk.alias("__c")).agg(F.collect_list("pos").alias("at"))
    chunks = tokens.select("stay_id", chunk.alias("chunk")).distinct()
    chunks = chunks.join(held, (F.col("stay_id") == F.col("__s")) & (F.col("chunk") == F.col("__c")), "left").select(
        "stay_id", "chunk", "at", F.coalesce(F.array_size("at"), F.lit(0)).cast("long").alias("n"))
    chunks = prefix_sum(chunks, "stay_id", "chunk", ["n"], levels=levels).where((F.col("n") > 0) | (F.col("n_before") > 0)).select(
        F.col("stay_id").alias("__s"), F.col("chunk").alias("__c"), "at", "n_before")
    counted = base.join(chunks, (F.col("stay_id") == F.col("__s")) & (chunk == F.col("__c")), "left")
    earlier = F.when(F.col("at").isNotNull(), F.size(F.filter("at", lambda x: x < F.col("pos")))).otherwise(F.lit(0))
    counted = counted.select("stay_id", "pos", "token", F.coalesce(F.array_contains("at", F.col("pos")), F.lit(False)).alias("mark"),
                             (F.coalesce("n_before", F.lit(0)) + earlier).alias("mark_before"))
    # each row gives itself and, at an anchor, the inserted token behind it
    at = F.col("pos") + F.col("mark_before")
    own = F.struct(at.alias("pos"), F.col("token").alias("token"), F.lit(0).alias("loss_weight"))
    new = F.struct((at + 1).alias("pos"), F.lit(insert_token).alias("token"), F.lit(1).alias("loss_weight"))
    return counted.select("stay_id", F.explode(F.when(F.col("mark"), F.array(own, new)).otherwise(F.array(own))).alias("r")) \
        .select("stay_id", "r.*")


def inject_error(tokens: DataFrame, rules: Sequence[tuple] = RULES, levels: int = 2) -> DataFrame:
    """Error token after the dose magnitude (+2) of every contraindicated drug."""
    c = contraindicated(tokens, rules, levels)
    return insert_after(tokens, c.select("stay_id", (F.col("pos") + 2).alias("pos")), levels=levels)


def dose_x10(tokens: DataFrame, drug: str = "med.purchase", rate: float = 0.1,
             levels: int = 2) -> DataFrame:
    """For a hash-chosen share of drug events, raise the dose to the top
    decile (the +2 token becomes ``magnitude.9``) and insert the error token."""
    d = tokens.where((F.col("token") == drug) & (uniform("stay_id", "pos") < rate)) \
        .select("stay_id", (F.col("pos") + 2).alias("pos"))
    rep = d.select("stay_id", "pos", F.lit("magnitude.9").alias("token"))
    return insert_after(tokens, d, replace=rep, levels=levels)


def splice_response(tokens: DataFrame, stays: DataFrame, seed_key: int = 6) -> DataFrame:
    """After one hash-chosen hour token of each given stay, splice the fixed
    response sequence; each magnitude is raised by one with a hash chance."""
    hours = tokens.where(F.col("kind") == 0).groupBy("stay_id").agg(F.max("hour_no").alias("H"))
    pick = stays.join(hours, "stay_id").where(F.col("H") >= 1).select(
        "stay_id", (F.lit(1) + F.floor(uniform("stay_id", F.lit(seed_key)) * F.col("H")))
        .cast("long").alias("j"))
    anchor = tokens.where(F.col("kind") == 0).join(pick, "stay_id") \
        .where(F.col("hour_no") == F.col("j")).select("stay_id", F.col("pos").alias("a"))
    n = len(RESPONSE)
    body = join_stays(tokens, anchor).select(
        "stay_id", (F.col("pos") + F.when(F.col("pos") > F.col("a"), F.lit(n)).otherwise(0)).alias("pos"),
        "token", F.lit(0).alias("loss_weight"))
    resp = anchor.select("stay_id", "a", F.posexplode(F.array(*[F.lit(t) for t in RESPONSE])).alias("i", "t"))
    bump = (uniform("stay_id", F.lit(seed_key + 1) + F.col("i")) < JITTER).cast("int")
    tok = F.when(F.col("t").startswith("magnitude."),
                 F.concat(F.lit("magnitude."), (suffix_int("t") + bump).cast("string"))).otherwise(F.col("t"))
    resp = resp.select("stay_id", (F.col("a") + 1 + F.col("i")).alias("pos"), tok.alias("token"),
                       F.lit(1).alias("loss_weight"))
    return body.unionByName(resp)


def splice_responses(tokens: DataFrame, stays: DataFrame, responses: Sequence[Sequence[str]] = RESPONSES, seed_key: int = 8) -> DataFrame:
    """``(stay_id, pos, token, loss_weight, response)``: as :func:`splice_response`, with one of
    several responses for each stay, chosen by hash, of any lengths."""
    spark = tokens.sparkSession
    kinds = settled(spark.createDataFrame([(i, list(r)) for i, r in enumerate(responses)], "response int, toks array<string>"), "responses")
    hours = tokens.where(F.col("kind") == 0).groupBy("stay_id").agg(F.max("hour_no").alias("H"))
    pick = stays.join(hours, "stay_id").where(F.col("H") >= 1).select(
        "stay_id", (F.lit(1) + F.floor(uniform("stay_id", F.lit(seed_key)) * F.col("H"))).cast("long").alias("j"),
        F.floor(uniform("stay_id", F.lit(seed_key + 1)) * len(responses)).cast("int").alias("response"))
    at = tokens.where(F.col("kind") == 0).select("stay_id", F.col("hour_no").cast("long").alias("j"), F.col("pos").alias("a"))
    anchor = settled(pick.join(at, ["stay_id", "j"]).join(kinds, "response").select("stay_id", "a", "response", "toks"), "anchors")
    body = join_stays(tokens, anchor.select("stay_id", "a", "response", F.size("toks").alias("n"))).select(
        "stay_id", (F.col("pos") + F.when(F.col("pos") > F.col("a"), F.col("n")).otherwise(0)).alias("pos"), "token",
        F.lit(0).alias("loss_weight"), "response")
    rows = anchor.select("stay_id", "a", "response", F.posexplode("toks").alias("i", "t"))
    bump = (uniform("stay_id", F.lit(seed_key + 2) + F.col("i")) < JITTER).cast("int")
    tok = F.when(F.col("t").startswith("magnitude."), F.concat(F.lit("magnitude."), (suffix_int("t") + bump).cast("string"))).otherwise(F.col("t"))
    added = rows.select("stay_id", (F.col("a") + 1 + F.col("i")).alias("pos"), tok.alias("token"), F.lit(1).alias("loss_weight"), "response")
    return body.unionByName(added)
