"""Overdose evaluation (the reference's medical-error script), as table jobs.

cohort (test stays, length of stay above a threshold) -> cut at and including
the N-th hour token -> last tracked-lab magnitude and dose histogram before
the cut -> counterfactual prompt (inject drug, unit, top dose, next hour) ->
panel probe (append each lab, read the magnitude distribution) -> pre / post
/ delta means that skip missing values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.arrays import to_text
from eventide.functions.tokens import suffix_int
from eventide.operators import blocks, cohorts, scoring
from eventide.operators.scan import join_stays, last_before
from eventide.operators.settled import settled
from eventide.plans import params as P
from eventide.plans.workspace import Workspace


NO_MAG = -1  # the last token is no magnitude


def cohort(ws: Workspace) -> DataFrame:
    return cohorts.los_cohort(ws.splits, ws.stay_detail, P.LOS_MIN_DAYS)


def cuts(ws: Workspace) -> DataFrame:
    """``stay_id, cut_pos, cut_token`` (the N-th hour token, inclusive)."""
    return cohorts.first_n_hours(ws.test_tokens, cohort(ws).select("stay_id"), P.N_HOURS)


def last_lab(ws: Workspace, c: DataFrame | None = None) -> DataFrame:
    c = cuts(ws) if c is None else c
    return cohorts.last_value_before(ws.test_tokens, c, P.TRACKED_LAB)


def dose_histogram(ws: Workspace, c: DataFrame | None = None, drug: str = P.DRUG) -> DataFrame:
    """``(stay_id, unit, decile, n)``: doses of the drug before the cut, by the
    units and deciles that occur (the reference's product x decile table, long)."""
    c = cuts(ws) if c is None else c
    d = ws.test_tokens.where(F.col("token") == drug).select("stay_id", "pos", "next1", "next2")
    d = join_stays(d, c.select("stay_id", "cut_pos")).where(F.col("pos") < F.col("cut_pos"))
    d = d.where(F.col("next2").startswith("magnitude."))
    return d.groupBy("stay_id", F.col("next1").alias("unit"), suffix_int("next2").alias("decile")).agg(F.count("*").alias("n"))


def _token_ids(ws: Workspace, rows: DataFrame, token_col: str, out: str) -> DataFrame:
    v = ws.vocab.select(F.col("token").alias("__tok"), F.col("token_id").alias("__tid"))
    return rows.join(v, F.col(token_col) == F.col("__tok"), "left") \
        .withColumn(out, F.coalesce("__tid", F.lit(0))).drop("__tok", "__tid")


def counterfactual_rows(ws: Workspace, c: DataFrame | None = None) -> DataFrame:
    """Rows ``(stay_id, i, token_id)`` of the prompt: the last ``BLOCK`` tokens
    of the first-N-hours stream, then drug, unit, top dose and the next hour
    token, keeping the last ``BLOCK`` (append, keep block size)."""
    c = cuts(ws) if c is None else c
    T = P.BLOCK
    ex = c.withColumn("cut", F.col("cut_pos") + 1)
    rows = blocks.tail_rows(ex, ws.test_tokens, [], T).select("stay_id", "i", "token_id")
    nxt = F.concat(F.lit("hour."), F.pmod(suffix_int("cut_token") + 1, F.lit(24)).cast("string"))
    inj = F.array(*[F.lit(x) for x in P.INJECTED], nxt)
    add = c.select("stay_id", F.posexplode(inj).alias("j", "token"))
    add = _token_ids(ws, add, "token", "token_id").select(
        "stay_id", (F.lit(T) + F.col("j")).alias("i"), "token_id")
    k = len(P.INJECTED) + 1
    allr = rows.unionByName(add).withColumn("i", F.col("i") - k).where(F.col("i") >= 0)
    return allr


def counterfactual_prompt(ws: Workspace) -> DataFrame:
    rows = counterfactual_rows(ws)
    arr = rows.groupBy("stay_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "token_id"))).alias("s"))
    return arr.select("stay_id", to_text(F.transform("s", lambda x: x["token_id"])).alias("prompt"))


def panel_probe(ws: Workspace, m: scoring.NgramModel | None = None) -> DataFrame:
    """For each lab of the panel in turn: append the lab name after the
    prompt, read P(magnitude.k | previous token, lab) for k = 0..9; report
    the magnitude mass, the expected magnitude (normalised over magnitudes)
    and the most likely magnitude, which is appended before the next lab."""
    m = m or ws.model
    state = _after_injection(ws, cuts(ws)).select("stay_id", F.col("start").alias("c2"))
    out = None
    for lab in P.PANEL:
        # the lab name rides inside the exploded rows, so both id lookups are
        # equi-joins on data columns (a literal key would plan a nested loop)
        reqs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lab).alias("lab"),
                                  F.lit(f"magnitude.{k}").alias("mtok")) for k in range(10)])
        r = state.select("stay_id", "c2", F.explode(reqs).alias("__r")).select("stay_id", "c2", "__r.*")
        r = _token_ids(ws, r, "lab", "c1")
        r = _token_ids(ws, r, "mtok", "target_id")
        sc = scoring.score(r, m)
        # written at each step: the plan of a lab holds no earlier one
        agg = settled(sc.groupBy("stay_id", "lab").agg(
            F.sum("p").alias("mag_mass"),
            (F.sum(F.col("k") * F.col("p")) / F.sum("p")).alias("exp_mag"),
            F.max_by("k", F.struct(F.col("p"), -F.col("k"))).alias("argmax_mag")), "panel-step")
        out = agg if out is None else out.unionByName(agg)
        state = _token_ids(ws, agg.select("stay_id", F.concat(F.lit("magnitude."),
                                                             F.col("argmax_mag").cast("string"))
                                          .alias("prev_token")), "prev_token", "c2") \
            .select("stay_id", "c2")
    return out


def _after_injection(ws: Workspace, c: DataFrame) -> DataFrame:
    """``(stay_id, start)``: id of the last token of each counterfactual prompt,
    the hour token after the cut's."""
    nxt = F.concat(F.lit("hour."), F.pmod(suffix_int("cut_token") + 1, F.lit(24)).cast("string"))
    return _token_ids(ws, c.select("stay_id", nxt.alias("t")), "t", "start").select("stay_id", "start")


def panel_forward(ws: Workspace, panel: Sequence[str] = P.FORWARD_PANEL, m: scoring.NgramModel | None = None) -> DataFrame:
    """The labs of a panel of any length in turn (a lab may recur), over all
    outcomes: ``(stay_id, step, lab, mag_mass, exp_mag, none_mass)``.

    After a lab's name the next token is a magnitude, which is appended, or it is not,
    and nothing is.  So before each step the last token is one of eleven: a magnitude or
    (``NO_MAG``) the lab before (the prompt's last token at first), each with a probability.
    A step passes these through P(magnitude | last token, lab) and sums:
    a forward recursion.  Stays with the same last prompt token share all of it, so a
    step's table holds eleven rows for each such token; it is written, and the next
    step's plan starts from it: joins grow with the panel's length, not its square."""
    m = m or ws.model
    stays = settled(_after_injection(ws, cuts(ws)), "panel-stays")
    # (last: 0..9 a magnitude, NO_MAG otherwise; c2: that last token's id)
    state = stays.select("start").distinct().select("start", F.col("start").alias("c2"), F.lit(NO_MAG).alias("last"), F.lit(1.0).alias("a"))
    out = None
    for step, lab in enumerate(panel):
        names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f"magnitude.{k}").alias("mtok"), F.lit(lab).alias("lab")) for k in range(10)])
        r = state.select("start", "c2", "a", F.explode(names).alias("r")).select("start", "c2", "a", "r.*")
        r = _token_ids(ws, _token_ids(ws, r, "lab", "c1"), "mtok", "target_id")
        hit = settled(scoring.score(r, m).groupBy("start", "k", F.col("c1").alias("lab_id"), F.col("target_id").alias("mag_id")).agg(
            F.sum(F.col("a") * F.col("p")).alias("a")), "panel-forward")
        per = hit.groupBy("start", "lab_id").agg(F.sum("a").alias("mag_mass"), (F.sum(F.col("k") * F.col("a")) / F.sum("a")).alias("exp_mag"))
        rows = per.select("start", F.lit(step).alias("step"), F.lit(lab).alias("lab"), "mag_mass", "exp_mag",
                          (1 - F.col("mag_mass")).alias("none_mass"))
        out = rows if out is None else out.unionByName(rows)
        state = hit.select("start", F.col("mag_id").alias("c2"), F.col("k").alias("last"), "a").unionByName(
            per.select("start", F.col("lab_id").alias("c2"), F.lit(NO_MAG).alias("last"), (1 - F.col("mag_mass")).alias("a")))
    return stays.join(out, "start").select("stay_id", "step", "lab", "mag_mass", "exp_mag", "none_mass")


def dose_table(ws: Workspace) -> DataFrame:
    """``(stay_id, unit, d0 .. d9)``: the product x decile table of every stay
    of the cohort, with its zeros, also of stays without a dose.

    Products are found in the data (the units of the vocabulary's grammar: a dimension, a
    few rows, which every stay gets as one array).  A stay's sparse counts are gathered into one
    map, at most ten entries a product, and laid out by a fold over products and deciles."""
    c = cuts(ws)
    sparse = dose_histogram(ws, c)
    units = sorted(r[0] for r in ws.tokens.where(F.col("token").startswith("unit.")).select("token").distinct().collect())
    per_stay = sparse.groupBy("stay_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("/", "unit", F.col("decile").cast("string")).alias("k"), F.col("n").alias("n")))).alias("counts"))
    dense = c.select("stay_id").join(per_stay, "stay_id", "left").select(
        "stay_id", "counts", F.explode(F.array(*map(F.lit, units)).cast("array<string>")).alias("unit"))
    cell = lambda k: F.coalesce(F.col("counts")[F.concat_ws("/", "unit", F.lit(str(k)))], F.lit(0)).cast("long")
    return dense.select("stay_id", "unit", *[cell(k).alias(f"d{k}") for k in range(10)])


def magnitude_model(ws: Workspace) -> DataFrame:
    """Counts ``(item, prev_mag, dose, mag, n)`` over training stays: the
    magnitude of a lab given the previous magnitude of the same lab and the
    last drug dose before it (carried forward, skew-safe)."""
    # labs and drugs in one scan
    t = ws.tokens.where(~F.col("testset"))
    lab = F.col("token").startswith("lab.") & F.col("next1").startswith("magnitude.")
    drug = F.col("token").startswith("med.") & F.col("next2").startswith("magnitude.")
    ev = t.where(lab | drug).select("stay_id", "pos", F.when(lab, F.col("token")).alias("item"),
                                    F.when(lab, suffix_int("next1")).alias("mag"), F.when(drug, suffix_int("next2")).alias("dose"))
    lv = ws.scan_levels
    ev = last_before(ev, "stay_id", "pos", "dose", "last_dose", inclusive=False, levels=lv)
    lab_rows = ev.where(F.col("item").isNotNull())
    lab_rows = last_before(lab_rows, ["stay_id", "item"], "pos", "mag", "prev_mag", inclusive=False,
                           levels=lv)
    return lab_rows.groupBy("item", "prev_mag", F.col("last_dose").alias("dose"), "mag") \
        .agg(F.count("*").alias("n"))


def magnitude_probs(model: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``(item, prev_mag, dose, mag, p)``: for every observed context the ten
    magnitudes with add-alpha counts, backing off to the item and dose alone::

        p(mag | item, prev, dose) = (n + 10 alpha * q(mag | item, dose)) / (N + 10 alpha)
        q(mag | item, dose)       = (n' + alpha) / (N' + 10 alpha)
    """
    ctx = ["item", "prev_mag", "dose"]
    ten = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("mag")

    def counts(by: list[str], n: str, total: str) -> DataFrame:
        return model.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("mag", "k"))).alias(n), F.sum("k").alias(total))

    model = model.groupBy(*ctx, "mag").agg(F.sum("n").alias("k"))
    wide = counts(ctx, "own", "N")
    model = model.groupBy("item", "dose", "mag").agg(F.sum("k").alias("k"))
    back = counts(["item", "dose"], "less", "M").withColumnsRenamed({"item": "i2", "dose": "d2"})
    rows = wide.join(back, (wide["item"] == back["i2"]) & wide["dose"].eqNullSafe(back["d2"])).select(*ctx, "own", "N", "less", "M", ten)
    q = (F.coalesce(F.col("less")[F.col("mag")], F.lit(0)) + alpha) / (F.col("M") + 10 * alpha)
    p = (F.coalesce(F.col("own")[F.col("mag")], F.lit(0)) + 10 * alpha * q) / (F.col("N") + 10 * alpha)
    return rows.select(*ctx, "mag", p.alias("p"))


def expected_after_dose(model: DataFrame, requests: DataFrame, item: str, dose: int,
                        alpha: float = 1.0) -> DataFrame:
    """E[mag | item, prev_mag, dose] with add-alpha over the 10 magnitudes;
    an unseen or missing previous magnitude backs off to (item, dose).

    The lookup table is dense and tiny: one row per previous magnitude 0..9
    and one (-1) for "no previous value"."""
    mm = model.where((F.col("item") == item) & (F.col("dose") == dose))
    per = mm.groupBy("prev_mag").agg(F.sum(F.col("mag") * F.col("n")).alias("s"),
                                     F.sum("n").alias("w"))
    tot = mm.agg(F.coalesce(F.sum(F.col("mag") * F.col("n")), F.lit(0)).alias("bs"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("bw"))
    keys = F.explode(F.sequence(F.lit(-1), F.lit(9))).alias("prev_mag")
    dense = tot.select(keys, "bs", "bw").join(per, "prev_mag", "left")
    mean = lambda a, b: (a + F.lit(alpha * 45.0)) / (b + F.lit(alpha * 10.0))
    dense = dense.select(F.col("prev_mag").alias("__pm"),
                         F.when(F.col("w") > 0, mean(F.col("s"), F.col("w")))
                         .otherwise(mean(F.col("bs"), F.col("bw"))).alias("post"))
    key = F.coalesce(F.col("pre").cast("int"), F.lit(-1))
    return requests.join(F.broadcast(dense), key == F.col("__pm"), "left").drop("__pm")


def pre_post(ws: Workspace) -> DataFrame:
    """Means that skip missing values: pre (last tracked lab before the cut),
    post (expected magnitude after the injected top dose), and the delta over
    stays that have both."""
    pre = last_lab(ws).select("stay_id", F.col("last_mag").cast("double").alias("pre"))
    model = ws.magnitude_model
    r = expected_after_dose(model, pre, P.TRACKED_LAB, 9)
    d = F.col("post") - F.col("pre")
    return r.agg(F.count("*").alias("n"), F.count("pre").alias("n_pre"),
                 F.count("post").alias("n_post"), F.count(d).alias("n_pairs"),
                 F.round(F.avg("pre"), 6).alias("avg_pre"), F.round(F.avg("post"), 6).alias("avg_post"),
                 F.round(F.avg(d), 6).alias("avg_delta"))
