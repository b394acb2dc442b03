"""Soft-membership mixing with DataFrame functions only.

1. **Domains** come from the ``labels`` table: ``low`` (quality 0), else ``toxic``,
   else ``clean``.  A multinomial model of hashed words, trained on a **bounded**
   sample (at most ``LABELLED`` labelled ids by hash), predicts each document's
   posterior over the domains, so unlabelled documents belong to all of them in part.
   Words of a text are not independent, so the sum of their ratios is far too sure:
   it is divided by the root of their number and by the temperature that gives the
   labelled documents left out of training (one in ``CALIBRATION``) the least log loss.
2. **Rates.**  Document i has tokens t_i, posterior p_i and a rate r_i >= 0, at
   first ``budget``.  Projected gradient minimises the sum over domains of
   (expected tokens - target)^2 / present tokens.  Scaled by 1 / t_i (the natural
   metric, in which one repeat costs its tokens) a gradient step moves every rate by
   - p_i . move, with move = (total - target) / present.  The projection is lazy: steps add up
   in one number a domain, and the rates are the projection of their start minus that sum::

       r_i = max(0, budget - sum_d p_id * moved_d)

   so a rate that was zero comes back when the sum turns, and the fit is the one nearest to
   the start.  A step of 1 always goes down, as each row of p sums to 1; longer ones,
   scaled by how the totals answer to the rows that are not at zero, are measured in the
   same pass, and the best is taken.  A step is one aggregate of the compact table (tokens,
   posterior): a few dozen numbers reach the driver, whatever the corpus.  It ends when
   every total is within ``TOLERANCE`` of its target, or at the minimum (a slight pull of
   ``moved`` to zero, ``PULL``, makes it unique), and ``residual`` says what is left.
3. **Copies**: the rate rounded to a whole number, up with the probability of its
   fraction, by a hash of the row; expected totals stay as fitted.

Edge cases: null and empty texts have no tokens: they weigh nothing and get a rate like any
other by the prior; equal rows get equal rates; ids labelled twice count by their lowest
quality and highest toxicity; null labels count as quality 1, not toxic; without labels all documents are
``clean``; a target for a domain that has no tokens cannot be met and is left out; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import dropped, fresh, number_array, once, quoted, saved, text_hash, texts, unit_hash
from eventide.llm.rules import words

DOMAINS = ("clean", "toxic", "low")
# Share of the mixture's tokens that each domain is to have.
TARGETS = {"clean": 0.955, "toxic": 0.035, "low": 0.01}
LABELLED = 20_000
BUCKETS = 1 << 14
SMOOTHING = 0.1
TOLERANCE = 1e-4
PULL = 1e-6
CALIBRATION = 5  # one labelled id in so many calibrates and does not train
# At most 1: of few labels the held-out loss would rather flatten all memberships, and leave nothing to mix by.
TEMPERATURES = tuple(2.0 ** (i / 2) for i in range(-12, 1))


def labelled(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """At most ``bound`` ``(id, domain)`` rows, chosen by hash."""
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t"))
    domain = F.when(F.col("q") == 0, "low").when(F.col("t") == 1, "toxic").otherwise("clean")
    return one.select("id", domain.alias("domain")).orderBy(unit_hash(F.lit("labelled"), "id"), "id").limit(bound)


def buckets_of(ws: str) -> Column:
    """Bucket of each word; the last bucket is for a word that repeats the one before it."""
    return F.transform(ws, lambda w, i: F.when(w == F.get(ws, i - 1), F.lit(BUCKETS)).otherwise(
        F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))


def left_out(id_: str) -> Column:
    return unit_hash(F.lit("calibration"), id_) < 1 / CALIBRATION


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[list[float], dict[str, list[float]], float]:
    """Log prior of each domain, each domain's log-likelihood ratios to
    the first one, by bucket, and the temperature of a text's sum of them."""
    own = texts(docs).where("text is not null")
    chosen = labelled(labels, bound)  # bounded, so it may be broadcast
    rows = saved(own.join(F.broadcast(chosen), own["doc_id"] == chosen["id"]).select("id", "domain", "text"), "labelled")
    heat = temperature(rows.where(left_out("id")), *counted(rows.where(~left_out("id"))))
    model = counted(rows)
    dropped(rows)
    return *model, heat


def temperature(rows: DataFrame, prior: list[float], tables: dict[str, list[float]]) -> float:
    """Of ``TEMPERATURES`` the one with the least log loss over labelled rows; 1 without any."""
    scored = saved(sums(rows, prior, tables, "domain"), "left-out")
    at = F.array_position(F.array(*map(F.lit, DOMAINS)), F.col("domain")).cast("int") - 1
    losses = [F.sum(-F.log(F.greatest(F.get(posterior(F.col("ratios"), F.col("n_tokens"), prior, t), at), F.lit(1e-12))))
              for t in TEMPERATURES]
    found = scored.agg(*[x.alias(f"t{i}") for i, x in enumerate(losses)]).first()
    dropped(scored)
    return 1.0 if found[0] is None else min(zip(found, TEMPERATURES))[1]


def counted(rows: DataFrame) -> tuple[list[float], dict[str, list[float]]]:
    """Log priors and log-likelihood ratios of labelled rows."""
    counts = rows.select("domain", words(F.col("text")).alias("ws")).select(
        "domain", F.explode(F.concat(buckets_of("ws"), F.array(F.lit(-1)))).alias("b")).groupBy(
        "domain", "b").count().collect()  # at most 3 x (BUCKETS + 2) rows
    n = {d: [0] * (BUCKETS + 1) for d in DOMAINS}
    docs_of = dict.fromkeys(DOMAINS, 0)
    for r in counts:
        if r["b"] < 0:
            docs_of[r["domain"]] = r["count"]
        else:
            n[r["domain"]][r["b"]] = r["count"]
    total = sum(docs_of.values())
    # a domain that was never seen has no share
    prior = [math.log(docs_of[d] / total) if docs_of[d] else -math.inf for d in DOMAINS] if total else [0.0, -math.inf, -math.inf]

    def logs(of: list[int]) -> list[float]:
        mass = math.log(sum(of) + SMOOTHING * len(of))
        return [math.log(x + SMOOTHING) - mass for x in of]

    first = logs(n[DOMAINS[0]])
    return prior, {d: [a - b for a, b in zip(logs(n[d]), first)] for d in DOMAINS[1:]}


def sums(docs: DataFrame, prior: list[float], tables: dict[str, list[float]], *keep: str) -> DataFrame:
    """Columns ``keep``, ``n_tokens`` and ``ratios``: each domain's sum of log-likelihood
    ratios over a text's words (null for a domain without a share)."""
    bs = docs.select(*keep, words(F.coalesce("text", F.lit(""))).alias("ws")).select(
        *keep, F.size("ws").cast("long").alias("n_tokens"), buckets_of("ws").alias("bs"))

    def total(table: Column) -> Column:
        return F.aggregate("bs", F.lit(0.0), lambda acc, b: acc + F.get(table, b))

    ratios = [F.lit(None).cast("double") if p == -math.inf else F.lit(0.0) if d == DOMAINS[0] else total(number_array(tables[d]))
              for d, p in zip(DOMAINS, prior)]
    return bs.select(*keep, "n_tokens", F.array(*ratios).alias("ratios"))


def posterior(ratios: Column, n_tokens: Column, prior: list[float], temperature: float) -> Column:
    """The domains' probabilities from their sums of ratios over ``n_tokens`` words."""
    base = max(p for p in prior)
    logs = F.array(*[F.lit(None if p == -math.inf else p - base).cast("double") for p in prior])
    heat = temperature * F.sqrt(F.greatest(n_tokens, F.lit(1)))
    z = F.zip_with(ratios, logs, lambda r, p: r / heat + p)
    odds = once(z, lambda v: F.transform(v, lambda x: F.coalesce(F.exp(x - F.array_max(v)), F.lit(0.0))))
    return once(odds, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def memberships(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, n_tokens, p)``: tokens and posterior of each row, an array
    in the order of ``DOMAINS``."""
    prior, tables, heat = model
    own = texts(docs, id_col, text_col).withColumn("h", text_hash())
    return sums(own, prior, tables, "doc_id", "h").select("doc_id", "h", "n_tokens", posterior(F.col("ratios"), F.col("n_tokens"), prior, heat).alias("p"))


def solved(g: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination for as many unknowns as there are domains."""
    n = len(right)
    rows = [[*g[i], right[i]] for i in range(n)]
    for i in range(n):
        top = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for j in range(n):
            if j != i and rows[i][i]:
                f = rows[j][i] / rows[i][i]
                rows[j] = [x - f * y for x, y in zip(rows[j], rows[i])]
    return [r[n] / r[i] if r[i] else 0.0 for i, r in enumerate(rows)]


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0,
              tolerance: float = TOLERANCE) -> DataFrame:
    """``members`` with columns ``rate`` and ``residual``: the largest distance of
    a domain's total from its target, as a share of all tokens.  It is at most
    ``tolerance`` unless the targets can't be met; then the rates are those of
    the smallest loss."""
    k = range(len(DOMAINS))
    flat = saved(members.select("doc_id", "h", "n_tokens", *[F.col("p")[i].alias(f"p{i}") for i in k]), "members")
    pairs = [(i, j) for i in k for j in k if i <= j]

    def rate_of(moved: list[float]) -> Column:
        return F.greatest(F.lit(0.0), F.lit(float(budget)) - sum((F.col(f"p{i}") * F.lit(float(moved[i])) for i in k), F.lit(0.0)))

    def measured(tries: list[list[float]]) -> list[tuple[list[float], list[list[float]], float]]:
        """For each try: expected tokens of each domain, how they answer to a move of
        the rows that are free (rate above zero), and the tokens' squared rates: one aggregate."""
        own = flat.select("*", *[rate_of(m).alias(f"rate{n}") for n, m in enumerate(tries)])
        parts = []
        for n in range(len(tries)):
            rate = F.col(f"rate{n}")
            free = F.when(rate > 0, F.col("n_tokens")).otherwise(0)
            parts += [*[F.sum(rate * F.col("n_tokens") * F.col(f"p{i}")) for i in k],
                      *[F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs], F.sum(rate * rate * F.col("n_tokens"))]
        r = [float(x or 0.0) for x in own.agg(*[x.alias(f"x{n}") for n, x in enumerate(parts)]).first()]
        size, out = len(k) + len(pairs) + 1, []
        for n in range(len(tries)):
            x = r[n * size:(n + 1) * size]
            of = dict(zip(pairs, x[len(k):]))
            out.append((x[:len(k)], [[of[min(i, j), max(i, j)] for j in k] for i in k], x[-1]))
        return out

    moved = [0.0 for _ in k]
    (now, answer, squares), = measured([moved])
    present = [sum(row) for row in answer] if budget > 0 else [0.0 for _ in k]
    whole = sum(present)
    wanted = [targets.get(d, 0.0) for d in DOMAINS]
    live = [m > 1e-9 * whole for m in present]
    shares = sum(w for w, m in zip(wanted, live) if m)
    if not whole or not shares:
        return flat.withColumns({"rate": F.lit(float(budget)), "residual": F.lit(0.0)})
    goal = [w / shares * budget * whole if m else 0.0 for w, m in zip(wanted, live)]

    def residual(totals: list[float]) -> float:
        return max(abs(a - b) for a, b, x in zip(totals, goal, live) if x) / sum(goal)

    def height(moved: list[float], squares: float) -> float:
        """What the steps lower: its slope in ``moved`` is (goal - totals), and the pull."""
        return squares / 2 + sum(g * m + PULL / 2 * w * m * m for g, m, w, x in zip(goal, moved, present, live) if x)

    while residual(now) > tolerance:
        slope = [a - g - PULL * w * m if x else 0.0 for a, g, w, m, x in zip(now, goal, present, moved, live)]
        if max(map(abs, slope)) <= tolerance / 100 * sum(goal):  # the minimum: the targets can't be met
            break
        held = [[answer[i][j] + (PULL * present[i] + 1e-12 * whole if i == j else 0.0) for j in k] for i in k]
        scaled = solved(held, slope)
        plain = [x / w if on else 0.0 for x, w, on in zip(slope, present, live)]
        steps = [[s * x if on else 0.0 for x, on in zip(scaled, live)] for s in (1.0, 0.5, 0.2, 0.05)] + [plain]
        tries = [[m + d for m, d in zip(moved, step)] for step in steps]
        best = min(zip(tries, measured(tries)), key=lambda x: height(x[0], x[1][2]))
        if height(best[0], best[1][2]) >= height(moved, squares):  # no longer falls by rounding
            break
        moved, (now, answer, squares) = best
    return flat.withColumn("rate", rate_of(moved)).withColumn("residual", F.lit(residual(now)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0, bound: int = LABELLED) -> DataFrame:
    """``(doc_id, h, n_tokens, p_<domain>..., rate, copies, residual)`` of each row."""
    fitted = fit_rates(memberships(docs, train(docs, labels, bound)), targets, budget)
    copies = F.floor(F.col("rate") + unit_hash(F.lit("copies"), F.col("doc_id"), F.col("h"))).cast("long")
    return fitted.select("doc_id", "h", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate",
                         copies.alias("copies"), "residual")


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0) -> DataFrame:
    """``docs`` with ``rate``, ``copies`` and ``residual`` (with underscores
    appended where ``docs`` has such columns), without the rows of no copy."""
    cols = docs.columns
    outs = fresh(cols, "rate", "copies", "residual")
    d, h, *own = fresh([*cols, *outs], "d", "h", "own_rate", "own_copies", "own_residual")
    chosen = mix(docs, labels, targets, budget).where("copies > 0").select(
        F.col("doc_id").alias(d), F.col("h").alias(h), *[F.col(x).alias(y) for x, y in zip(("rate", "copies", "residual"), own)]).distinct()
    on = docs["doc_id"].eqNullSafe(F.col(d)) & (text_hash(docs["text"]) == F.col(h))
    return docs.join(chosen, on).select(*map(quoted, cols), *[F.col(x).alias(y) for x, y in zip(own, outs)])
