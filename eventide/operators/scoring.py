"""Conditional next-token model by counting.

The reference's network learns P(next token | context).  On Spark the same
distribution is a grouped count over training stays:

* orders 0, 1, 2 counted in one pass with ``rollup(token, c1, c2)``;
* ``p = l2 * P2 + l1 * P1 + l0 * P0`` where ``Pk = count_k / total_k`` for a
  seen context and falls back to ``P0`` for an unseen one, and
  ``P0 = (count_0 + alpha) / (N + alpha * V)`` (add-alpha over the
  vocabulary); the mixture sums to 1 over the vocabulary for every context.

The model tables hold the observed n-grams of the vocabulary and are settled, so
the planner knows their size: while they are small, scoring is a chain of
broadcast hash joins (no shuffle of the requests), beyond that it shuffles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.hashing import uniform
from eventide.operators.ranking import running_totals
from eventide.operators.settled import settled
from eventide.operators.scan import neighbors

NONE = -1  # context slot not used
BINS = 64  # equal-width bins of [0, 1) for sampling joins


@dataclass(frozen=True)
class Smoothing:
    l0: float = 0.1
    l1: float = 0.3
    l2: float = 0.6
    alpha: float = 1.0

    def name(self) -> str:
        return f"l={self.l0:g}/{self.l1:g}/{self.l2:g},a={self.alpha:g}"


DEFAULT = Smoothing()


def with_context(tokens: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Add ``c1``, ``c2``: ids of the one and two tokens before each token.

    A stream that carries its ``prev1`` and ``prev2`` gets their ids from ``vocab``, as its
    ``token_id``; any other is shuffled to find them."""
    if vocab is not None and {"prev1", "prev2"} <= set(tokens.columns):
        t = tokens
        for k in (1, 2):
            ids = vocab.select(F.col("token").alias(f"__t{k}"), F.col("token_id").alias(f"__i{k}"))
            t = t.join(ids, F.col(f"prev{k}") == F.col(f"__t{k}"), "left").withColumn(
                f"c{k}", F.when(F.col(f"prev{k}").isNotNull(), F.coalesce(f"__i{k}", F.lit(NONE))))
        return t.select("stay_id", "pos", F.coalesce("token_id", F.lit(NONE)).alias("token_id"),
                        *[c for c in ("testset",) if c in tokens.columns], "c1", "c2")
    t = tokens.select("stay_id", "pos", F.coalesce("token_id", F.lit(NONE)).alias("token_id"),
                      *[c for c in ("testset",) if c in tokens.columns])
    return neighbors(t, "stay_id", "pos", "token_id", [-1, -2], ["c1", "c2"])


@dataclass
class NgramModel:
    m0: DataFrame   # token_id, n0
    m1: DataFrame   # c1, token_id, n1
    m2: DataFrame   # c2, c1, token_id, n2
    t1: DataFrame   # c1, n1c
    t2: DataFrame   # c2, c1, n2c
    total: int      # N, tokens counted at order 0
    vocab_size: int  # V, ids > 0

    def long(self) -> DataFrame:
        """All counts as one table ``(order, c2, c1, token_id, n)``."""
        a = self.m0.select(F.lit(0).alias("order"), F.lit(NONE).alias("c2"), F.lit(NONE).alias("c1"),
                           "token_id", F.col("n0").alias("n"))
        b = self.m1.select(F.lit(1).alias("order"), F.lit(NONE).alias("c2"), "c1", "token_id",
                           F.col("n1").alias("n"))
        c = self.m2.select(F.lit(2).alias("order"), "c2", "c1", "token_id", F.col("n2").alias("n"))
        return a.unionByName(b).unionByName(c)


def fit(ctx: DataFrame, vocab: DataFrame) -> NgramModel:
    """Count orders 0-2 over context rows (``token_id, c1, c2``)."""
    g = (ctx.rollup("token_id", "c1", "c2")
         .agg(F.count("*").alias("n"), F.grouping_id().alias("gid")))
    g = settled(g, "ngram-rollup")
    m2 = g.where((F.col("gid") == 0) & F.col("c1").isNotNull() & F.col("c2").isNotNull()) \
        .select("c2", "c1", "token_id", F.col("n").alias("n2"))
    m1 = g.where((F.col("gid") == 1) & F.col("c1").isNotNull()) \
        .select("c1", "token_id", F.col("n").alias("n1"))
    m0 = g.where(F.col("gid") == 3).select("token_id", F.col("n").alias("n0"))
    total = g.where(F.col("gid") == 7).select("n").first()
    total = int(total[0]) if total else 0
    t2 = settled(m2.groupBy("c2", "c1").agg(F.sum("n2").alias("n2c")), "ngram-t2")
    t1 = settled(m1.groupBy("c1").agg(F.sum("n1").alias("n1c")), "ngram-t1")
    v = vocab.where(F.col("token_id") > 0).count()
    return NgramModel(m0, m1, m2, t1, t2, total, v)


def fit_from_tokens(tokens: DataFrame, vocab: DataFrame) -> NgramModel:
    """Fit on the training (non-test) stays."""
    ctx = with_context(tokens.where(~F.col("testset")), vocab)
    return fit(ctx.select("token_id", "c1", "c2"), vocab)


def score(requests: DataFrame, m: NgramModel, s: Smoothing = DEFAULT, c1: str = "c1",
          c2: str = "c2", target: str = "target_id", name: str = "p") -> DataFrame:
    """Add ``name`` = P(target | c2, c1) to every request row."""
    return score_many(requests, m, {name: s}, c1, c2, target)


def score_many(requests: DataFrame, m: NgramModel, grid: dict[str, Smoothing], c1: str = "c1",
               c2: str = "c2", target: str = "target_id") -> DataFrame:
    """One probability column per smoothing setting, in one pass."""
    r = with_counts(requests, m, c1, c2, target)
    cols = {}
    for name, s in grid.items():
        p0, p1, p2 = components(m, s.alpha)
        cols[name] = F.lit(s.l2) * p2 + F.lit(s.l1) * p1 + F.lit(s.l0) * p0
    return r.withColumns(cols).drop("n0", "n1", "n1c", "n2", "n2c")


def with_counts(requests: DataFrame, m: NgramModel, c1: str = "c1", c2: str = "c2", target: str = "target_id") -> DataFrame:
    """Add the counts the three orders need: ``n0, n1, n1c, n2, n2c``."""
    return (requests
            .join(m.m0.withColumnRenamed("token_id", "__t"), F.col(target) == F.col("__t"), "left")
            .drop("__t")
            .join(m.t1.withColumnRenamed("c1", "__c1"), F.col(c1) == F.col("__c1"), "left").drop("__c1")
            .join(m.m1.withColumnsRenamed({"c1": "__c1", "token_id": "__t"}),
                  (F.col(c1) == F.col("__c1")) & (F.col(target) == F.col("__t")), "left")
            .drop("__c1", "__t")
            .join(m.t2.withColumnsRenamed({"c1": "__c1", "c2": "__c2"}),
                  (F.col(c1) == F.col("__c1")) & (F.col(c2) == F.col("__c2")), "left")
            .drop("__c1", "__c2")
            .join(m.m2.withColumnsRenamed({"c1": "__c1", "c2": "__c2", "token_id": "__t"}),
                  (F.col(c1) == F.col("__c1")) & (F.col(c2) == F.col("__c2"))
                  & (F.col(target) == F.col("__t")), "left")
            .drop("__c1", "__c2", "__t"))


def components(m: NgramModel, alpha: float) -> tuple[Column, Column, Column]:
    """P0, P1, P2 of a row of :func:`with_counts`; an unseen context falls back to P0."""
    p0 = (F.coalesce("n0", F.lit(0)) + F.lit(alpha)) / F.lit(m.total + alpha * m.vocab_size)
    p1 = F.when(F.col("n1c") > 0, F.coalesce("n1", F.lit(0)) / F.col("n1c")).otherwise(p0)
    p2 = F.when(F.col("n2c") > 0, F.coalesce("n2", F.lit(0)) / F.col("n2c")).otherwise(p0)
    return p0, p1, p2


EM_TOLERANCE = 1e-6
EM_ROUNDS = 200  # a guard against a stop that rounding would never allow


def fit_weights(held_out: DataFrame, m: NgramModel, alpha: float = 1.0, start: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3),
                tolerance: float = EM_TOLERANCE) -> list[tuple[int, float, float, float, float]]:
    """Interpolation weights by expectation-maximisation on held-out rows
    (``c2, c1, target_id``): ``(round, l0, l1, l2, loss)`` of every round, where the
    loss (mean negative log-likelihood) is that of the round's weights and
    never rises; stops when it falls by less than ``tolerance``.

    Held-out rows shrink to distinct (context, token) counts with their three
    probabilities, written once; a round is one aggregate over that table, from
    which four numbers reach the driver."""
    distinct = held_out.groupBy("c2", "c1", "target_id").agg(F.count("*").alias("k"))
    p0, p1, p2 = components(m, alpha)
    table = settled(with_counts(distinct, m).select("k", p0.alias("p0"), p1.alias("p1"), p2.alias("p2")), "held-out")
    weights, out, last = start, [], math.inf
    while len(out) < EM_ROUNDS:
        mixed = [F.lit(float(w)) * F.col(f"p{i}") for i, w in enumerate(weights)]
        p = mixed[0] + mixed[1] + mixed[2]
        r = table.agg(F.sum("k"), F.sum(-F.log(p) * F.col("k")), *[F.sum(x / p * F.col("k")) for x in mixed]).first()
        if not r[0]:
            break
        loss = r[1] / r[0]
        out.append((len(out), *weights, loss))
        if last - loss < tolerance:
            break
        weights, last = tuple(x / r[0] for x in r[2:]), loss
    return out


def sample_next(requests: DataFrame, m: NgramModel, vocab: DataFrame, key_cols: list[str],
                s: Smoothing = DEFAULT, c1: str = "c1", c2: str = "c2") -> DataFrame:
    """Draw one next token per request from the smoothed mixture, exactly,
    without listing the vocabulary per request.

    A hash uniform ``u`` picks the mixture part (order 2, 1 or 0), and a second
    uniform ``v`` inverts that part's CDF: orders 1 and 2 over their observed
    next tokens (cumulative counts per context, bounded by the vocabulary),
    order 0 over ``count + alpha`` in token-id order.  An unseen context hands
    its weight to order 0.
    """
    u = uniform(*key_cols, F.lit(1))
    v = uniform(*key_cols, F.lit(2))
    req = requests.withColumn("__u", u).withColumn("__v", v)

    def cdf(tbl: DataFrame, ctx: list[str], n: str) -> DataFrame:
        """Cumulative shares per context, each row copied to the ``BINS``
        equal-width bins of [0, 1) it overlaps: requests then meet their
        row on an equi-join (context, bin) plus a range check."""
        w = Window.partitionBy(*ctx).orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
        tot = Window.partitionBy(*ctx)
        c = tbl.select(*ctx, "token_id", (F.sum(n).over(w) / F.sum(n).over(tot)).alias("cum"),
                       ((F.sum(n).over(w) - F.col(n)) / F.sum(n).over(tot)).alias("cum0"))
        return in_bins(c)

    def in_bins(c: DataFrame) -> DataFrame:
        lo = F.floor(F.col("cum0") * BINS).cast("int")
        hi = F.least(F.floor(F.col("cum") * BINS).cast("int"), F.lit(BINS - 1))
        return c.select("*", F.explode(F.sequence(lo, F.greatest(lo, hi))).alias("bin"))

    req = req.withColumn("bin", F.floor(F.col("__v") * BINS).cast("int"))
    cdf2 = settled(cdf(m.m2, ["c2", "c1"], "n2"), "cdf2")
    cdf1 = settled(cdf(m.m1, ["c1"], "n1"), "cdf1")
    voc = vocab.where(F.col("token_id") > 0).select("token_id")
    m0 = voc.join(m.m0, "token_id", "left").select(
        "token_id", (F.coalesce("n0", F.lit(0)) + F.lit(s.alpha)).alias("w0"))
    mass = m.total + s.alpha * m.vocab_size
    before = running_totals(m0, ["token_id"], F.col("w0"), "before")
    cdf0 = settled(in_bins(before.select("token_id", ((F.col("before") + F.col("w0")) / mass).alias("cum"),
                                         (F.col("before") / mass).alias("cum0"))), "cdf0")

    req = (req.join(m.t2.withColumnsRenamed({"c1": "__c1", "c2": "__c2"}),
                    (F.col(c1) == F.col("__c1")) & (F.col(c2) == F.col("__c2")), "left")
           .drop("__c1", "__c2")
           .join(m.t1.withColumnRenamed("c1", "__c1"), F.col(c1) == F.col("__c1"), "left")
           .drop("__c1"))
    part = (F.when((F.col("__u") < s.l2) & (F.col("n2c") > 0), F.lit(2))
            .when((F.col("__u") >= s.l2) & (F.col("__u") < s.l2 + s.l1) & (F.col("n1c") > 0), F.lit(1))
            .otherwise(F.lit(0)))
    req = req.withColumn("__part", part)
    inrange = (F.col("__v") >= F.col("cum0")) & (F.col("__v") < F.col("cum"))
    j2 = req.where(F.col("__part") == 2).join(
        cdf2.withColumnsRenamed({"c1": "__c1", "c2": "__c2", "bin": "__bin"}),
        (F.col(c1) == F.col("__c1")) & (F.col(c2) == F.col("__c2"))
        & (F.col("bin") == F.col("__bin")) & inrange)
    j1 = req.where(F.col("__part") == 1).join(
        cdf1.withColumnsRenamed({"c1": "__c1", "bin": "__bin"}),
        (F.col(c1) == F.col("__c1")) & (F.col("bin") == F.col("__bin")) & inrange)
    j0 = req.where(F.col("__part") == 0).join(
        cdf0.withColumnRenamed("bin", "__bin"), (F.col("bin") == F.col("__bin")) & inrange)
    keep = [*requests.columns, "__part", "token_id"]
    out = j2.select(*keep).unionByName(j1.select(*keep)).unionByName(j0.select(*keep))
    return out.withColumnsRenamed({"__part": "part", "token_id": "next_token_id"})


def horizon_scores(m: NgramModel, vocab: DataFrame, target_id: int, steps: int,
                   s: Smoothing = DEFAULT, checkpoint_every: int = 1) -> DataFrame:
    """Mean probability of emitting ``target_id`` over the next ``steps``
    tokens, by start token: ``(c1, score)``.

    The expected value of the reference's sampled rollout (mean of the
    per-step next-token probability) under the order-1 back-off chain,
    computed backwards: ``g_s(c) = sum_t P(t | c) g_{s-1}(t)`` with
    ``g_0 = [c = target]``, ``score = mean(g_1 .. g_S)``.  ``P(t | c)`` is
    split into its sparse count part (a join on observed bigrams) and a
    rank-one part ``w(c) * P0(t)``, so no vocabulary-by-vocabulary table is
    ever formed.  Every table here has one row per vocabulary token, and one
    (id ``NONE``) for a start that is unknown or missing: it has no observed successor,
    so its steps go by order 0.
    """
    lam = s.l1 + s.l2
    ids = vocab.where(F.col("token_id") > 0).select(F.col("token_id").alias("c"))
    p0 = ids.join(m.m0.withColumnRenamed("token_id", "c"), "c", "left").select(
        "c", ((F.coalesce("n0", F.lit(0)) + F.lit(s.alpha))
              / F.lit(m.total + s.alpha * m.vocab_size)).alias("p0"))
    base = ids.join(p0, "c").join(m.t1.withColumnRenamed("c1", "c"), "c", "left")
    unseen = vocab.sparkSession.range(1).select(F.lit(NONE).alias("c"), F.lit(0.0).alias("p0"), F.lit(0).cast("long").alias("n1c"))
    base = settled(base.select("c", "p0", F.coalesce("n1c", F.lit(0)).alias("n1c")).unionByName(unseen), "horizon-base")
    state = base.select("c", "p0", "n1c", (F.col("c") == target_id).cast("double").alias("g"),
                        F.lit(0.0).alias("acc"))
    # successors of a real token only: the unseen start stays at order 0
    m1 = m.m1.where(F.col("c1") > 0).select(F.col("c1").alias("__c1"), F.col("token_id").alias("__t"), "n1")
    for step in range(1, steps + 1):
        # the state is read once per step: every row goes out as a "self"
        # row (carries acc) and as an "edge" row (joined to the observed
        # bigrams ending in it); one aggregate per context gathers both, so
        # the plan grows linearly with the steps.  The lineage is still cut
        # every ``checkpoint_every`` steps: analysing a deep plan costs more
        # than writing a vocabulary-sized table.
        # (column names are case-insensitive, so the scalar is "gsum")
        gsum = state.agg(F.sum(F.col("p0") * F.col("g"))).first()[0] or 0.0  # one number
        x = state.select("c", "p0", "n1c", "g", "acc", F.lit(float(gsum)).alias("gsum"),
                         F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"))
        j = x.join(m1, (F.col("kind") == 1) & (F.col("c") == F.col("__t")), "left")
        key = F.when(F.col("kind") == 0, F.col("c")).otherwise(F.col("__c1"))
        agg = (j.where(key.isNotNull()).groupBy(key.alias("c"))
               .agg(F.sum(F.when(F.col("kind") == 1, F.col("n1") * F.col("g"))).alias("num"),
                    F.max(F.when(F.col("kind") == 0, F.col("acc"))).alias("acc"),
                    F.max(F.when(F.col("kind") == 0, F.col("p0"))).alias("p0"),
                    F.max(F.when(F.col("kind") == 0, F.col("n1c"))).alias("n1c"),
                    F.max("gsum").alias("gsum")))
        nxt = agg
        g = (F.when(F.col("n1c") > 0, F.lit(lam) * F.coalesce("num", F.lit(0.0)) / F.col("n1c"))
             .otherwise(F.lit(lam) * F.col("gsum")) + F.lit(s.l0) * F.col("gsum"))
        state = nxt.select("c", "p0", "n1c", g.alias("g"), (F.col("acc") + g).alias("acc"))
        if checkpoint_every and step % checkpoint_every == 0 and step < steps:
            state = state.checkpoint()
    return state.select(F.col("c").alias("c1"), (F.col("acc") / F.lit(float(steps))).alias("score"))
