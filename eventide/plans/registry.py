"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (or what Spark derives from them) in full.
Computed columns carry the same names as their DuckDB twins in
``checks/oracle_sql.py``; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions import arrays as arr
from eventide.functions.arrays import to_text
from eventide.functions.hashing import uniform
from eventide.functions.tokens import family, suffix_int
from eventide.operators import augment, batch, blocks, cohorts, horizon, memory, metrics, quantiles, scoring
from eventide.operators.ranking import running_totals
from eventide.operators.scan import at_offset, join_stays, neighbors
from eventide.operators.settled import settled
from eventide.operators.stream import stay_lengths
from eventide.operators.tokens import EVENTS_ITEM_KIND, extend_vocabulary, vocabulary
from eventide.plans import dose_eval, handoff, lab_eval, overdose
from eventide.plans import params as P
from eventide.plans.workspace import Workspace
from eventide.sources.model_io import ModelStore
from eventide.streaming.tokenize import tokens_so_far

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

EVENT_TYPES = tuple(EVENTS_ITEM_KIND)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c):
    return F.round(c, 6)


def _lab_ex(ws):
    return cohorts.nth_occurrences(ws.test_tokens, P.LAB_TARGETS, levels=ws.scan_levels)


# ---- step 1: scans, tokeniser, stream ----------------------------------------

@query
def decile_edges(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return ws.edges_long.select("item", "qi", r6("edge").alias("edge"))


@query
def magnitudes(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return ws.emitted.select("stay_id", "row_id", "item", F.col("mag").cast("int").alias("mag"))


@query
def hour_spine(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return ws.tokens.where(F.col("kind") == 0).select(
        "stay_id", F.col("hour_no").cast("long").alias("hour_no"), "charttime", "token")


@query
def vocab(spark, sf_dir):
    return Workspace.get(spark, sf_dir).vocab


@query
def token_parse(spark, sf_dir):
    v = Workspace.get(spark, sf_dir).vocab
    return v.select("token", family("token").alias("family"), suffix_int("token").alias("suffix"))


@query
def unknown_tokens(spark, sf_dir):
    """Test tokens outside a vocabulary.  The training stays have every token of
    these tables, so the vocabulary here is fitted without the drug's events: its
    name and units are unknown to it."""
    ws = Workspace.get(spark, sf_dir)
    fitted = ws.tokens.where(~F.col("testset") & ~family("token").isin("med", "unit")).select("token")
    test = ws.test_tokens.select("token")
    return test.join(vocabulary(fitted), "token", "left_anti").groupBy("token").agg(F.count("*").alias("n"))


@query
def vocab_refit(spark, sf_dir):
    """A vocabulary fitted without the drug's events, then extended by the rest: old
    ids stay, new tokens come after them."""
    ws = Workspace.get(spark, sf_dir)
    train = ws.tokens.where(~F.col("testset")).select("token")
    first = vocabulary(train.where(~family("token").isin("med", "unit")))
    grown = extend_vocabulary(first, train)
    old = first.select(F.col("token").alias("t"), F.lit(True).alias("old"))
    return grown.join(old, grown["token"] == old["t"], "left").select("token", "token_id", F.col("old").isNull().alias("is_new"))


@query
def decile_sketches(spark, sf_dir):
    """Deciles from daily sketches merged over all days, beside the exact ones: ``in_bound``
    says that the sketched decile's true rank is within ``SKETCH_ERROR`` of the wanted
    one (the sketches themselves are randomised)."""
    ws = Workspace.get(spark, sf_dir)
    raw = ws.raw.where(~F.col("testset")).select("item", F.to_date("charttime").alias("day"), "value")
    daily = settled(quantiles.daily_sketches(raw, "item", "day", "value"), "daily-sketches")
    edges = settled(quantiles.merged_quantiles(daily, "item", [i / 10 for i in range(1, 10)]), "sketched-deciles")
    # true ranks: values below and up to each sketched edge, by partial aggregate
    per = edges.groupBy(F.col("item").alias("i")).agg(F.array_sort(F.collect_list(F.struct("qi", "edge"))).alias("s"))
    met = raw.where(F.col("value").isNotNull()).join(per, raw["item"] == per["i"]).groupBy("item").agg(*[
        f(cmp(F.col("value"), F.col("s")[i]["edge"])).alias(f"{k}{i}") for i in range(9)
        for k, f, cmp in (("lt", F.count_if, lambda v, e: v < e), ("le", F.count_if, lambda v, e: v <= e))])
    long = met.select(F.col("item").alias("i"), F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.col(f"lt{i}").alias("lt"), F.col(f"le{i}").alias("le"))
                                                                for i in range(9)])).alias("r")).select("i", "r.*")
    want, exact = (F.col("qi") + 1) / 10.0 * F.col("n"), ws.edges_long.select(F.col("item").alias("i2"), F.col("qi").alias("q2"), F.col("edge").alias("exact"))
    slack = F.lit(quantiles.SKETCH_ERROR) * F.col("n") + 1
    out = edges.join(long, (F.col("item") == F.col("i")) & (F.col("qi") == F.col("q"))).join(
        exact, (F.col("item") == F.col("i2")) & (F.col("qi") == F.col("q2")))
    return out.select("item", F.col("qi").cast("int").alias("qi"), "n", r6("exact").alias("edge"),
                      ((F.col("lt") <= want + slack) & (F.col("le") >= want - slack)).alias("in_bound"))


def _readable(token: str):
    """``label: value`` of a token, as the reference shows its ids."""
    return F.when(F.contains(token, F.lit(".")), F.concat(F.substring_index(token, ".", 1), F.lit(": "), F.expr(
        f"substring({token}, instr({token}, '.') + 1)"))).otherwise(F.col(token))


@query
def token_names(spark, sf_dir):
    return Workspace.get(spark, sf_dir).vocab.select("token_id", _readable("token").alias("name"))


@query
def decoded_heads(spark, sf_dir):
    """The first tokens of each test block, decoded from ids to names."""
    ws = Workspace.get(spark, sf_dir)
    names = ws.vocab.select(F.col("token_id").alias("id"), _readable("token").alias("name"))
    rows = ws.test_tokens.where(F.col("token_id") > 0).select("stay_id", F.floor(F.col("pos") / P.BLOCK).cast("long").alias("b"), "pos", "token_id")
    rows = rows.where(F.pmod("pos", F.lit(P.BLOCK)) < P.HEAD)
    rows = rows.join(names, rows["token_id"] == names["id"])
    return rows.groupBy("stay_id", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("s")).select(
        "stay_id", "b", F.array_join(F.transform("s", lambda x: x["name"]), " | ").alias("names"))


@query
def token_stream(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return ws.tokens.select("stay_id", F.col("pos").cast("long").alias("pos"), "charttime",
                            "token", "token_id", F.col("hour_no").cast("long").alias("hour_no"))


@query
def streamed_tokens(spark, sf_dir):
    """The event tokens as Structured Streaming emits them from the events folder."""
    ws = Workspace.get(spark, sf_dir)
    t = tokens_so_far(spark, sf_dir, ws.edges_long, f"{ws.folder}/streamed-{uuid.uuid4().hex}", ws.grammar)
    return t.select("stay_id", "charttime", "row_id", "sub", "token")


# ---- step 2: cohorts and labels -------------------------------------------------

@query
def occurrences_per_stay(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    # bound-parameter form of the reference's cohort SQL
    ws.tokens.createOrReplaceTempView("eventide_tokens")
    targets = [*P.LAB_TARGETS, P.CULTURE_TARGET]
    args = {f"t{i}": t for i, t in enumerate(targets)}
    marks = ", ".join(f":t{i}" for i in range(len(targets)))
    return spark.sql(
        f"SELECT token AS target, stay_id, count(*) AS n FROM eventide_tokens "
        f"WHERE testset = true AND token IN ({marks}) GROUP BY token, stay_id", args=args)


@query
def lab_examples(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return _lab_ex(ws).select("target", "stay_id", "occ", "pos", "cut")


@query
def dropped_examples(spark, sf_dir):
    """What the cohorts leave out, and count: lab draws without a value at the
    end of a stay, and long stays with fewer hours than the cut."""
    ws = Workspace.get(spark, sf_dir)
    labs = cohorts.dropped(_lab_ex(ws), ["target"])
    stays = overdose.cohort(ws).select("stay_id").join(overdose.cuts(ws).select("stay_id", "cut_pos"), "stay_id", "left")
    hours = stays.agg(F.count("*").alias("n_examples"), F.count_if(F.col("cut_pos").isNull()).alias("n_dropped"))
    return labs.unionByName(hours.select(F.lit("first_n_hours").alias("target"), "n_examples", "n_dropped"))


@query
def value_at_next(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    ex = cohorts.value_after(_lab_ex(ws))
    return ex.select("target", "stay_id", "occ", "val_token")


@query
def one_hot_labels(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    ex = cohorts.value_after(_lab_ex(ws))
    oh = cohorts.one_hot(ex, "val_token", P.MAGNITUDES)
    return oh.select("target", "stay_id", "occ", F.col("cls").cast("int").alias("cls"), "y")


@query
def unexpected_labels(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    ex = cohorts.value_after(_lab_ex(ws))
    return cohorts.unexpected_count(ex, ["target"], "val_token", P.MAGNITUDES)


@query
def culture_examples(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    ex = cohorts.value_after(cohorts.nth_occurrences(ws.test_tokens, [P.CULTURE_TARGET], levels=ws.scan_levels))
    return ex.select("stay_id", "occ", "cut", "val_token",
                     (F.col("val_token") == P.RESULT_TOKENS[0]).cast("int").alias("y"))


# ---- step 3: ranking metrics ------------------------------------------------------

def _event_scores(spark, sf_dir):
    """One-vs-rest rows: every event once per item type of the grammar
    (a fixed list), score = value, y = the event is of that type."""
    ws = Workspace.get(spark, sf_dir)
    ev = ws.table("events", ["event_type", "value"])
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    x = ev.select("event_type", "value", F.explode(types).alias("target"))
    return x.select("target", F.col("value").alias("score"),
                    (F.col("event_type") == F.col("target")).cast("int").alias("y"))


@query
def auroc_binary(spark, sf_dir):
    m = metrics.ranking_metrics(_event_scores(spark, sf_dir), ["target"], "score", "y")
    return m.select("target", "n", "n_pos", r6("auroc").alias("auroc"))


@query
def avg_precision(spark, sf_dir):
    m = metrics.ranking_metrics(_event_scores(spark, sf_dir), ["target"], "score", "y")
    return m.select("target", r6("ap").alias("ap"))


@query
def macro_metrics(spark, sf_dir):
    m = metrics.ranking_metrics(_event_scores(spark, sf_dir), ["target"], "score", "y")
    mm = metrics.macro(m.withColumn("g", F.lit(1)), ["g"], len(EVENT_TYPES))
    return mm.select(r6("macro_auroc").alias("macro_auroc"), r6("macro_ap").alias("macro_ap"))


@query
def metric_panel(spark, sf_dir):
    return lab_eval.lab_panel(Workspace.get(spark, sf_dir))


@query
def culture_eval(spark, sf_dir):
    return lab_eval.culture_panel(Workspace.get(spark, sf_dir))


# ---- step 4: conditional next-token model -----------------------------------------

@query
def ngram_counts(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    m = ws.model
    return m.long()


def _test_contexts(ws: Workspace) -> DataFrame:
    ctx = scoring.with_context(ws.test_tokens, ws.vocab)
    return ctx.withColumnRenamed("token_id", "target_id")


@query
def next_token_probs(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    m = ws.model
    req = _test_contexts(ws).select("c2", "c1", "target_id").distinct()
    return scoring.score(req, m).select("c2", "c1", F.col("target_id").alias("token_id"),
                                        r6("p").alias("p"))


def _stay_offsets(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Global row number ``rn`` over (stay_id, pos) of the test stays without a
    global sort: stay lengths come from the grid, and are summed in stay order
    inside ranges of stays, then over the ranges."""
    lens = stay_lengths(ws.grid.where("testset"))
    off = running_totals(lens, ["stay_id"], F.col("len"), "len_before").drop("len")
    return join_stays(rows, off).withColumn("rn", F.col("len_before") + F.col("pos"))


@query
def val_loss(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    m = ws.model
    sc = scoring.score(_test_contexts(ws), m)
    sc = _stay_offsets(ws, sc).withColumn("nll", -F.log("p")) \
        .withColumn("batch", F.floor(F.col("rn") / P.BATCH))
    per_batch = sc.groupBy("batch").agg(F.avg("nll").alias("b"), F.count("*").alias("k"),
                                        F.sum("nll").alias("s"))
    out = per_batch.agg(F.sum("k").alias("n"), (F.sum("s") / F.sum("k")).alias("loss_mean"),
                        F.avg("b").alias("loss_batch_mean"))
    return out.select("n", r6("loss_mean").alias("loss_mean"),
                      r6("loss_batch_mean").alias("loss_batch_mean"))


SMOOTHING_GRID = {
    "s0": scoring.Smoothing(0.1, 0.3, 0.6, 1.0),
    "s1": scoring.Smoothing(0.2, 0.3, 0.5, 1.0),
    "s2": scoring.Smoothing(0.1, 0.3, 0.6, 0.1),
    "s3": scoring.Smoothing(0.05, 0.15, 0.8, 0.5),
    "s4": scoring.Smoothing(0.3, 0.4, 0.3, 2.0),
}


def _held_out(ws: Workspace) -> tuple[scoring.NgramModel, DataFrame]:
    """The model of the training stays hashed to 'train', and the context rows
    of the others ('val')."""
    tr = ws.tokens.where(~F.col("testset"))
    tr = tr.withColumn("part", F.when(uniform("stay_id") < P.TRAIN_FRACTION, "train").otherwise("val"))
    m = scoring.fit(scoring.with_context(tr.where(F.col("part") == "train"), ws.vocab).select("token_id", "c1", "c2"), ws.vocab)
    return m, scoring.with_context(tr.where(F.col("part") == "val"), ws.vocab).withColumnRenamed("token_id", "target_id")


def _held_out_losses(ws: Workspace) -> tuple[scoring.NgramModel, dict[str, float]]:
    m, val = _held_out(ws)
    r = scoring.score_many(val, m, SMOOTHING_GRID).agg(*[F.avg(-F.log(F.col(k))).alias(k) for k in SMOOTHING_GRID]).first()
    return m, r.asDict()


@query
def interpolation_weights(spark, sf_dir):
    """The interpolation weights fitted by expectation-maximisation on the held-out
    stays, round by round, with the loss that each round's weights give."""
    m, val = _held_out(Workspace.get(spark, sf_dir))
    rows = spark.createDataFrame(scoring.fit_weights(val, m), "round int, l0 double, l1 double, l2 double, loss double")
    return rows.select("round", *[r6(c).alias(c) for c in ("l0", "l1", "l2", "loss")])


@query
def best_smoothing(spark, sf_dir):
    """Fit on training stays hashed to 'train', score the held-out 'val'
    stays under each smoothing setting in one pass, keep the best (and the
    best so far in grid order, as a checkpointing loop would)."""
    ws = Workspace.get(spark, sf_dir)
    m, val = _held_out(ws)
    sc = scoring.score_many(val, m, SMOOTHING_GRID)
    losses = sc.agg(*[F.avg(-F.log(F.col(k))).alias(k) for k in SMOOTHING_GRID])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(k).alias("config"),
                                        F.col(k).alias("val_loss"))
                               for i, k in enumerate(SMOOTHING_GRID)]))
    long = losses.select(rows.alias("r")).select("r.*")
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    best = Window.partitionBy()
    return long.select(F.col("step").cast("int").alias("step"), "config", r6("val_loss").alias("val_loss"),
                       r6(F.min("val_loss").over(w)).alias("best_so_far"),
                       (F.col("val_loss") == F.min("val_loss").over(best)).alias("is_best"))


# ---- step 5: blocks, cuts, splits -------------------------------------------------


LAB_KEY = ["target", "stay_id", "occ"]


@query
def asof_cut(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    s = handoff.shift_labels(ws).select("stay_id", "shift_start")
    return cohorts.asof_cut(s, ws.tokens, ws.grid, ws.seconds, "shift_start", ws.unit)


@query
def tail_block(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    r = blocks.tail_rows(_lab_ex(ws), ws.test_tokens, LAB_KEY, P.BLOCK)
    return r.select(*LAB_KEY, "i", "token_id")


@query
def padded_block(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    pb = blocks.padded_blocks(_lab_ex(ws), ws.test_tokens, LAB_KEY, P.BLOCK)
    return pb.select(*LAB_KEY, to_text("block").alias("block"))


@query
def history_bag(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    hb = blocks.history_bag(_lab_ex(ws), ws.test_tokens, LAB_KEY, P.BLOCK, max_pos=ws.max_stay_len)
    return hb.select(*LAB_KEY, "token_id", "n")


def _memory_scores(ws: Workspace) -> DataFrame:
    """Every lab example's value, scored by the plain model and with memory."""
    ex = cohorts.value_after(_lab_ex(ws))
    ids = ws.vocab.select(F.col("token").alias("__tok"), F.col("token_id").alias("__tid"))
    ex = ex.join(ids, F.col("val_token") == F.col("__tok"), "left").withColumn("target_id", F.coalesce("__tid", F.lit(scoring.NONE)))
    ex = ex.withColumn("c1", F.coalesce("token_id", F.lit(scoring.NONE))).withColumn("__pp", F.col("pos") - 1)
    ex = at_offset(ex, ws.test_tokens.withColumn("tid", F.coalesce("token_id", F.lit(scoring.NONE))), "__pp", 0, ["tid"], prefix="p_")
    req = settled(ex.select(*LAB_KEY, "cut", "c1", F.col("p_tid").alias("c2"), "target_id"), "memory-requests")
    bag = memory.decayed_bag(req, ws.test_tokens, LAB_KEY, P.HALF_LIFE, ws.max_stay_len)
    return memory.with_memory(req, bag, ws.model, LAB_KEY, P.MEMORY_WEIGHT)


@query
def memory_scores(spark, sf_dir):
    m = _memory_scores(Workspace.get(spark, sf_dir))
    return m.select(*LAB_KEY, r6("p_plain").alias("p_plain"), r6("p_memory").alias("p_memory"))


@query
def memory_loss(spark, sf_dir):
    """Held-out loss of the lab values, by the plain model and with the history's memory."""
    m = _memory_scores(Workspace.get(spark, sf_dir))
    loss = m.agg(F.count("*").alias("n"), *[F.avg(-F.log(c)).alias(c) for c in ("p_plain", "p_memory")])
    pairs = F.explode(F.array(F.struct(F.lit("plain").alias("model"), F.col("p_plain").alias("loss")),
                              F.struct(F.lit("memory").alias("model"), F.col("p_memory").alias("loss"))))
    return loss.select("n", pairs.alias("r")).select("r.model", "n", r6("r.loss").alias("loss"))


@query
def training_blocks(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    tb = blocks.training_blocks(ws.tokens, P.BLOCK)
    return tb.select("stay_id", "b", to_text("x").alias("x"))


@query
def next_token_labels(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    tb = blocks.training_blocks(ws.tokens, P.BLOCK)
    return tb.select("stay_id", "b", to_text("y").alias("y"), F.size("y").alias("n_labels"))


@query
def train_val_split(spark, sf_dir):
    """90/10 split by example (block), as the reference, and by stay."""
    ws = Workspace.get(spark, sf_dir)
    tb = ws.tokens.where(~F.col("testset")).select(
        "stay_id", F.floor(F.col("pos") / P.BLOCK).cast("long").alias("b")).distinct()
    return tb.select("stay_id", "b", blocks.split_column(["stay_id", "b"]).alias("by_example"),
                     blocks.split_column(["stay_id"]).alias("by_stay"))


@query
def head_nonpad(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    tb = blocks.training_blocks(ws.test_tokens, P.BLOCK)
    return tb.select("stay_id", "b", to_text(arr.head_nonpad("x", P.HEAD)).alias("head"))


@query
def append_block(spark, sf_dir):
    """Append the injected drug tokens to each lab example's tail block and
    keep the last ``BLOCK`` (left-padded)."""
    ws = Workspace.get(spark, sf_dir)
    T = P.BLOCK
    ex = _lab_ex(ws)
    rows = blocks.tail_rows(ex, ws.test_tokens, LAB_KEY, T).select(*LAB_KEY, "i", "token_id")
    add = ex.select(*LAB_KEY, F.posexplode(F.array(*[F.lit(x) for x in P.INJECTED])).alias("j", "tok"))
    v = ws.vocab.select(F.col("token").alias("tok"), F.col("token_id").alias("tid"))
    add = add.join(v, "tok", "left").select(*LAB_KEY, (F.lit(T) + F.col("j")).alias("i"),
                                            F.coalesce("tid", F.lit(0)).alias("token_id"))
    k = len(P.INJECTED)
    allr = rows.unionByName(add).withColumn("i", F.col("i") - k).where(F.col("i") >= 0)
    blk = blocks.rows_to_block(allr, LAB_KEY, T)
    return blk.select(*LAB_KEY, to_text("block").alias("block"))


@query
def draw_example(spark, sf_dir):
    """One test block drawn by a reproducible hash uniform: an arg-min
    aggregate, no global sort."""
    ws = Workspace.get(spark, sf_dir)
    keys = ws.test_tokens.select("stay_id", F.floor(F.col("pos") / P.BLOCK).cast("long").alias("b"))
    pick = keys.select(F.min_by(F.struct("stay_id", "b"), F.struct(uniform("stay_id", "b"), F.col("stay_id"), F.col("b")))
                       .alias("r")).select(F.col("r.stay_id").alias("s"), F.col("r.b").alias("k"))
    # only the drawn block is built: one row meets the stream
    t = ws.test_tokens
    drawn = t.join(F.broadcast(pick), (t["stay_id"] == F.col("s")) & (F.floor(t["pos"] / P.BLOCK) == F.col("k")))
    tb = blocks.training_blocks(drawn.drop("s", "k"), P.BLOCK)
    return tb.select("stay_id", "b", to_text(arr.head_nonpad("x", P.HEAD)).alias("head"))


# ---- step 6: dose evaluation ------------------------------------------------------

@query
def dose_examples(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    ex = dose_eval.dose_examples(ws)
    return ex.select("stay_id", "row_id", "charttime", F.col("last_pos").cast("long").alias("last_pos"),
                     "unit_token", "dose")


@query
def dose_prompt(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    ex = dose_eval.dose_examples(ws)
    pb = dose_eval.dose_prompts(ws, ex)
    return pb.join(ex.select("stay_id", "row_id", "dose"), ["stay_id", "row_id"]) \
        .select("stay_id", "row_id", to_text("block").alias("prompt"), "dose")


@query
def dose_eval_panel(spark, sf_dir):
    return dose_eval.dose_panel(Workspace.get(spark, sf_dir))


# ---- step 7: overdose evaluation ----------------------------------------------------

@query
def los_cohort(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return overdose.cohort(ws).select("stay_id", r6("los_days").alias("los_days"))


@query
def first_n_hours(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return overdose.cuts(ws).select("stay_id", F.col("cut_pos").cast("long").alias("cut_pos"), "cut_token")


@query
def last_lab_before_cut(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return overdose.last_lab(ws).select("stay_id", F.col("last_mag").cast("int").alias("last_mag"))


@query
def dose_histogram(spark, sf_dir):
    return overdose.dose_histogram(Workspace.get(spark, sf_dir))


@query
def dose_table(spark, sf_dir):
    return overdose.dose_table(Workspace.get(spark, sf_dir))


@query
def panel_forward(spark, sf_dir):
    pf = overdose.panel_forward(Workspace.get(spark, sf_dir))
    return pf.select("stay_id", "step", "lab", r6("mag_mass").alias("mag_mass"), r6("exp_mag").alias("exp_mag"), r6("none_mass").alias("none_mass"))


@query
def counterfactual_prompt(spark, sf_dir):
    return overdose.counterfactual_prompt(Workspace.get(spark, sf_dir))


@query
def panel_probe(spark, sf_dir):
    pp = overdose.panel_probe(Workspace.get(spark, sf_dir))
    return pp.select("stay_id", "lab", r6("mag_mass").alias("mag_mass"), r6("exp_mag").alias("exp_mag"),
                     F.col("argmax_mag").cast("int").alias("argmax_mag"))


@query
def magnitude_model(spark, sf_dir):
    return overdose.magnitude_model(Workspace.get(spark, sf_dir)).select(
        "item", F.col("prev_mag").cast("int").alias("prev_mag"), F.col("dose").cast("int").alias("dose"),
        F.col("mag").cast("int").alias("mag"), "n")


@query
def magnitude_probs(spark, sf_dir):
    """The magnitude model as a smoothed distribution that backs off."""
    p = overdose.magnitude_probs(Workspace.get(spark, sf_dir).magnitude_model)
    return p.select("item", F.col("prev_mag").cast("int").alias("prev_mag"), F.col("dose").cast("int").alias("dose"),
                    F.col("mag").cast("int").alias("mag"), r6("p").alias("p"))


@query
def pre_post_delta(spark, sf_dir):
    return overdose.pre_post(Workspace.get(spark, sf_dir))


# ---- step 8: hand-off evaluation ------------------------------------------------------

@query
def shift_labels(spark, sf_dir):
    return handoff.shift_labels(Workspace.get(spark, sf_dir))


@query
def shift_cohort(spark, sf_dir):
    return handoff.shift_cohort(Workspace.get(spark, sf_dir))


@query
def shift_context(spark, sf_dir):
    c = handoff.shift_context(Workspace.get(spark, sf_dir))
    return c.select("stay_id", "shift_start", "y", "cut", to_text("block").alias("block"))


@query
def no_prior_event(spark, sf_dir):
    return handoff.no_prior_event(Workspace.get(spark, sf_dir))


@query
def first_time_shifts(spark, sf_dir):
    c = handoff.first_time_shifts(Workspace.get(spark, sf_dir))
    return c.select("stay_id", "shift_start", "y", "cut", to_text("block").alias("block"))


@query
def horizon_score(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    hs = handoff.horizon_scores(ws, handoff.shift_cuts(ws))
    return hs.select("stay_id", "shift_start", r6("score").alias("score"))


@query
def horizon_hours(spark, sf_dir):
    """The expected rollout of every test shift until its twelfth hour token: number of
    target tokens, probability of one, number of tokens, and whether the
    chain's remaining mass is within the tolerance."""
    ws = Workspace.get(spark, sf_dir)
    hs = handoff.hour_scores(ws, handoff.shift_cuts(ws))
    return hs.select("stay_id", "shift_start", r6("expected").alias("expected"), r6("first_passage").alias("first_passage"),
                     r6("n_tokens").alias("n_tokens"), (F.col("alive") <= horizon.TOLERANCE).alias("ended"))


@query
def hour_horizon(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return handoff.hour_horizon(ws, handoff.shift_cuts(ws))


@query
def handoff_eval(spark, sf_dir):
    return handoff.handoff_panel(Workspace.get(spark, sf_dir))


# ---- step 9: sampling --------------------------------------------------------------

@query
def sampled_next_token(spark, sf_dir):
    """One next token per test block, drawn from the smoothed model with
    reproducible hash uniforms (context = the block's last two tokens)."""
    ws = Workspace.get(spark, sf_dir)
    tb = blocks.training_blocks(ws.test_tokens, P.BLOCK)
    req = tb.select("stay_id", "b", F.element_at("x", P.BLOCK).alias("c1"),
                    F.element_at("x", P.BLOCK - 1).alias("c2"))
    s = scoring.sample_next(req, ws.model, ws.vocab, ["stay_id", "b"])
    return s.select("stay_id", "b", F.col("part").cast("int").alias("part"), "next_token_id")


# ---- step 10: synthetic examples -------------------------------------------------------



@query
def contraindicated_positions(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return augment.contraindicated(ws.tokens, levels=ws.scan_levels).select(
        "stay_id", F.col("pos").cast("long").alias("pos"), "drug", F.col("state").cast("int").alias("state"))


@query
def forbidden_positions(spark, sf_dir):
    """Drugs given while a rule of the table forbids them."""
    ws = Workspace.get(spark, sf_dir)
    return augment.forbidden(ws.tokens, augment.rule_table(spark), levels=ws.scan_levels).select(
        "stay_id", F.col("pos").cast("long").alias("pos"), "rule", "drug", "lab", F.col("state").cast("int").alias("state"))


@query
def inject_error(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return augment.inject_error(ws.tokens, levels=ws.scan_levels).select(
        "stay_id", F.col("pos").cast("long").alias("pos"), "token", "loss_weight")


@query
def dose_x10(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return augment.dose_x10(ws.tokens, levels=ws.scan_levels).select(
        "stay_id", F.col("pos").cast("long").alias("pos"), "token", "loss_weight")


@query
def real_synth_mix(spark, sf_dir):
    """10 % of stays (hash-chosen) take the synthetic stream, the rest the
    real one; summary per stay."""
    ws = Workspace.get(spark, sf_dir)
    synth = F.col("u") < F.lit(0.1)
    real = ws.tokens.select("stay_id", "token").withColumn("u", uniform("stay_id", F.lit(5)))
    fake = augment.inject_error(ws.tokens, levels=ws.scan_levels).select("stay_id", "token") \
        .withColumn("u", uniform("stay_id", F.lit(5)))
    mix = real.where(~synth).withColumn("source", F.lit("real")) \
        .unionByName(fake.where(synth).withColumn("source", F.lit("synthetic")))
    return mix.groupBy("stay_id", "source").agg(
        F.count("*").alias("n_tokens"), F.count_if(F.col("token") == augment.ERROR_TOKEN).alias("n_error"))


@query
def masked_loss(spark, sf_dir):
    """Mean negative log-likelihood over the test stays' synthetic stream, of
    all tokens and of those that carry loss weight (the inserted ones)."""
    ws = Workspace.get(spark, sf_dir)
    t = augment.inject_error(ws.test_tokens, levels=ws.scan_levels).join(ws.vocab, "token", "left")
    t = t.select("stay_id", "pos", F.coalesce("token_id", F.lit(scoring.NONE)).alias("token_id"), "loss_weight")
    ctx = neighbors(t, "stay_id", "pos", "token_id", [-1, -2], ["c1", "c2"]).withColumnRenamed("token_id", "target_id")
    nll = -F.log("p")
    out = scoring.score(ctx, ws.model).agg(
        F.count("*").alias("n"), F.sum("loss_weight").cast("long").alias("n_weighted"), F.avg(nll).alias("loss_all"),
        (F.sum(nll * F.col("loss_weight")) / F.sum("loss_weight")).alias("loss_masked"))
    return out.select("n", "n_weighted", r6("loss_all").alias("loss_all"), r6("loss_masked").alias("loss_masked"))


@query
def saved_model(spark, sf_dir):
    """The model's counts by order, after a save to and a load from the shared folder."""
    ws = Workspace.get(spark, sf_dir)
    store = ModelStore(spark, f"{ws.folder}/saved-model")
    store.publish(store.write({"ngram": ws.model.long()}), ("ngram",), 0.0, {"block": P.BLOCK}, {"total": ws.model.total})
    tables, version = store.load()
    return tables["ngram"].groupBy("order").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_tokens")).withColumn(
        "total", F.lit(version.meta["total"]).cast("long"))


@query
def model_versions(spark, sf_dir):
    """The settings of ``best_smoothing`` saved in turn, each only if its loss is
    below all before: the versions, their losses, and which one a load gives."""
    ws = Workspace.get(spark, sf_dir)
    m, losses = _held_out_losses(ws)
    store = ModelStore(spark, f"{ws.folder}/versions-{uuid.uuid4().hex}")
    rows = []
    for step, (name, loss) in enumerate(losses.items()):
        # without held-out rows there is no loss to go by
        v = None if loss is None else store.save_if_better({"ngram": m.long()}, loss, SMOOTHING_GRID[name].__dict__,
                                                           {"step": step, "total": m.total})
        rows.append((step, name, loss, v.number if v else None))
    last = store.load()[1].number if store.versions() else 0
    out = spark.createDataFrame(rows, "step int, config string, val_loss double, version int")
    return out.select("step", "config", r6("val_loss").alias("val_loss"), "version",
                      (F.col("version").eqNullSafe(F.lit(last))).alias("loaded"))


@query
def response_splice(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    stays = ws.splits.where("testset").select("stay_id")
    return augment.splice_response(ws.test_tokens, stays).select(
        "stay_id", F.col("pos").cast("long").alias("pos"), "token", "loss_weight")


@query
def response_kinds(spark, sf_dir):
    """Test stays with one of several responses spliced in, each ending in the terminal token."""
    ws = Workspace.get(spark, sf_dir)
    stays = ws.splits.where("testset").select("stay_id")
    return augment.splice_responses(ws.test_tokens, stays).select(
        "stay_id", F.col("pos").cast("long").alias("pos"), "token", "loss_weight", "response")


# ---- step 11: external scorer hook, second adapter ------------------------------------



@query
def batch_scorer(spark, sf_dir):
    """Score of every test block: the share of its tokens that are the highest
    magnitude, by built-in array functions (``block_nll`` scores blocks by the hook
    for a model from outside)."""
    ws = Workspace.get(spark, sf_dir)
    row = ws.vocab.where(F.col("token") == P.HIGH).select("token_id").first()
    top = row[0] if row else scoring.NONE
    tb = blocks.training_blocks(ws.test_tokens, P.BLOCK)
    hits, real = F.size(F.filter("x", lambda t: t == top)), F.size(F.filter("x", lambda t: t != 0))
    return tb.select("stay_id", "b", r6(F.when(real > 0, hits / real)).alias("score"))


@query
def block_nll(spark, sf_dir):
    """Mean negative log-likelihood of every test block under the order-1 chain, by
    the batch hook (``operators.batch``): blocks go to the scorer in Arrow batches."""
    ws = Workspace.get(spark, sf_dir)
    tb = blocks.training_blocks(ws.test_tokens, P.BLOCK)
    s = batch.batch_score(tb, ["stay_id", "b"], "x", batch.chain_scorer(ws.model, scoring.DEFAULT))
    return s.select("stay_id", "b", r6("score").alias("nll"))


CHECKSUM = 1_000_003  # each term is taken modulo this, so that no long stay's sum overflows


@query
def lineitem_stream_digest(spark, sf_dir):
    """The token stream built from ``orders JOIN lineitem`` (customer = stay,
    day spine), summarised per stay with an order-sensitive checksum."""
    ws = Workspace.get(spark, sf_dir, "lineitem")
    t = ws.tokens
    return t.groupBy("stay_id").agg(
        F.count("*").alias("n_tokens"),
        F.sum(F.pmod(F.col("pos") * F.coalesce("token_id", F.lit(0)), F.lit(CHECKSUM))).alias("checksum"),
        F.count_if(F.col("kind") == 0).alias("n_spine"))


# ---- report sink ------------------------------------------------------------------

@query
def evaluation_report(spark, sf_dir):
    """All evaluation panels as one long ``(target, metric, value)`` table
    (the reference prints the same name / value rows at the end of a run)."""
    from eventide.sources.report import report, write_report
    ws = Workspace.get(spark, sf_dir)
    cult = lab_eval.culture_panel(ws).select("target", F.explode(F.array(
        F.struct(F.lit("growth_auroc").alias("metric"), F.col("auroc").alias("value")),
        F.struct(F.lit("growth_ap").alias("metric"), F.col("ap").alias("value")))).alias("m")) \
        .select("target", "m.metric", "m.value")
    path = f"{ws.folder}/report-{uuid.uuid4().hex}"
    write_report(report(lab_eval.lab_panel(ws), cult, dose_eval.dose_panel(ws), handoff.handoff_panel(ws)), path)
    return spark.read.parquet(path).orderBy("target", "metric")
