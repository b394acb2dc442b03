import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import mixing, registry

SF = "/root/testdata/sf0.01"


def expected(df):
    r = df.agg(*[(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) / F.sum("n_tokens")).alias(d) for d in mixing.DOMAINS]).first()
    return {d: r[d] for d in mixing.DOMAINS}


def test_targets_are_met(spark):
    out = registry.op8_mixing(spark, SF)
    assert out.count() == 1000
    assert expected(out) == pytest.approx(mixing.TARGETS, abs=1e-3)
    assert out.agg(F.max("residual")).first()[0] <= mixing.TOLERANCE
    low = out.agg(F.min("rate"), F.min("copies"), F.max(F.abs(F.col("copies") - F.col("rate")))).first()
    assert low[0] >= 0 and low[1] >= 0 and low[2] < 1
    got = out.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").groupBy("toxic").agg(
        F.avg("p_toxic"), F.avg((F.col("copies") > 0).cast("int"))).collect()
    p, kept = ({r[0]: float(r[k]) for r in got} for k in (1, 2))
    assert p[1] > 5 * p[0] and kept[0] > 0.95 and kept[1] < 0.8
    # membership is soft: a fair share of documents belongs to no domain for sure
    assert out.where("greatest(p_clean, p_toxic, p_low) < 0.99").count() > 0.1 * out.count()


def test_projected_gradient_reaches_the_minimum(spark):
    """Against a long run of the same minimisation in numpy, with targets that
    push rates to zero."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.06, 0.05, 0.04], 300)
    t = rng.integers(0, 500, 300)
    rows = [(i, i, int(t[i]), [float(x) for x in p[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, h long, n_tokens long, p array<double>")
    targets = {"clean": 0.985, "toxic": 0.005, "low": 0.01}
    got = mixing.fit_rates(df, targets, 1.0, tolerance=1e-6).orderBy("doc_id").collect()
    r, a = np.ones(300), p * t[:, None]
    m, goal = a.sum(axis=0), np.array([targets[d] for d in mixing.DOMAINS]) * t.sum()
    for _ in range(20_000):
        r = np.maximum(0, r - p @ ((a.T @ r - goal) / m))
    rate = np.array([x.rate for x in got])
    assert (rate >= 0).all() and (r == 0).any()

    def loss(x):
        return (((a.T @ x - goal) ** 2) / m).sum() / t.sum()

    assert loss(rate) <= loss(r) + 1e-6


def test_residual_of_targets_out_of_reach(spark):
    """Every document is half of both domains, so only equal shares can be met."""
    rows = [(i, i, 100, [0.5, 0.5, 0.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, h long, n_tokens long, p array<double>")
    far = mixing.fit_rates(df, {"clean": 0.8, "toxic": 0.2, "low": 0.0}).collect()
    assert {round(r.residual, 3) for r in far} == {0.3} and {round(r.rate, 3) for r in far} == {1.0}
    met = mixing.fit_rates(df, {"clean": 0.5, "toxic": 0.5, "low": 0.0}).collect()
    assert {r.residual for r in met} == {0.0}


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_posteriors_against_brute_force(spark):
    """Counts, temperature and posteriors of a small labelled table, in Python.
    Buckets are taken from the operator's own hash."""
    rng = np.random.default_rng(5)
    words = {"clean": ["fine", "good", "prose", "the"], "toxic": ["bad", "vile", "the"], "low": ["junk", "spam", "buy", "the"]}
    every = sorted({w for ws in words.values() for w in ws})
    rows, labels = [], []
    for i in range(240):
        d = mixing.DOMAINS[i % 3]
        rows.append((i, " ".join(rng.choice(words[d] if rng.random() < 0.7 else every, size=rng.integers(3, 12)))))
        labels.append((i, 0 if d == "low" else 1, int(d == "toxic")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    prior, ratios, heat = mixing.train(docs, table)
    out = {r.id for r in docs.select(F.col("doc_id").alias("id")).where(mixing.left_out("id")).collect()}
    assert 20 < len(out) < 90
    of = {r.doc_id: list(r.bs) for r in docs.withColumn("ws", mixing.words(F.col("text"))).select("doc_id", mixing.buckets_of("ws").alias("bs")).collect()}
    domain = {i: (2 if q == 0 else 1 if t else 0) for i, q, t in labels}

    def model(ids):
        n, seen = np.full((3, mixing.BUCKETS + 1), mixing.SMOOTHING), np.zeros(3)
        for i in ids:
            seen[domain[i]] += 1
            np.add.at(n[domain[i]], of[i], 1)
        return np.log(seen / seen.sum()), np.log(n / n.sum(axis=1, keepdims=True))

    def probs(ids, model, t):
        p, logs = model
        return softmax(np.array([(logs[:, of[i]] - logs[:1, of[i]]).sum(axis=1) / (t * len(of[i]) ** 0.5) + p for i in ids]))

    part = model([i for i in of if i not in out])
    loss = [sum(-np.log(x[domain[i]]) for i, x in zip(sorted(out), probs(sorted(out), part, t))) for t in mixing.TEMPERATURES]
    assert heat == mixing.TEMPERATURES[int(np.argmin(loss))]
    want = probs(sorted(of), model(of), heat)
    got = mixing.memberships(docs, (prior, ratios, heat)).orderBy("doc_id").collect()
    assert np.allclose([r.p for r in got], want, atol=1e-6)


def test_odd_rows(spark, make_docs, odd, stored):
    rows = odd + [(70, "bad bad awful junk " * 20), (71, "fine words of good prose " * 20)]
    df = make_docs(rows, clash=True)
    labels = spark.createDataFrame([(70, 0, 0), (70, 1, 0), (71, 1, 0), (7, 1, None), (8, None, 1), (None, 0, 0), (999, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    out = mixing.mix(df, labels).collect()
    assert len(out) == len(rows)
    assert all(r.rate >= 0 and abs(r.p_clean + r.p_toxic + r.p_low - 1) < 1e-9 for r in out)
    none = mixing.mix(df, labels.limit(0)).collect()
    assert all((r.p_clean, r.p_low) == (1.0, 0.0) and r.rate == pytest.approx(1.0) for r in none)
    kept = mixing.mixture(df, labels)
    assert kept.columns == [*df.columns, "rate_", "copies_", "residual_"]
    assert stored(kept).select("rate_", "copies_", "rate").where("copies_ < 1 or rate <> 'x'").count() == 0
    assert mixing.mix(make_docs([]), labels).count() == 0
    assert kept.count() == sum(r.copies > 0 for r in out)


def test_native_plan(spark):
    plan = registry.op8_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
