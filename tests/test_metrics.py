"""AUROC by pair counting and AP by a threshold sweep, on small inputs with
ties, an absent class and constant scores."""

import itertools

import numpy as np
import pandas as pd
import pytest

from eventide.operators.metrics import macro, ranking_metrics


def brute_auroc(s, y):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def brute_ap(s, y):
    P = sum(y)
    if P == 0:
        return 0.0
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        sel = [b for a, b in zip(s, y) if a >= t]
        r = sum(sel) / P
        ap += (r - prev_r) * (sum(sel) / len(sel))
        prev_r = r
    return ap


def test_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(6):
        n = int(rng.integers(5, 60))
        s = np.round(rng.random(n), 1)  # heavy ties
        y = (rng.random(n) < 0.4).astype(int)
        if g == 4:
            y[:] = 0  # absent positive class
        if g == 5:
            s[:] = 0.3  # all scores equal
        rows += [(g, float(a), int(b)) for a, b in zip(s, y)]
    pdf = pd.DataFrame(rows, columns=["g", "s", "y"])
    got = ranking_metrics(spark.createDataFrame(pdf), ["g"], "s", "y").toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        ea, ep = brute_auroc(part.s.tolist(), part.y.tolist()), brute_ap(part.s.tolist(), part.y.tolist())
        if ea is None:
            assert pd.isna(got.loc[g, "auroc"])
        else:
            assert got.loc[g, "auroc"] == pytest.approx(ea, abs=1e-12)
        assert got.loc[g, "ap"] == pytest.approx(ep, abs=1e-12)


def test_macro_absent_class_rules(spark):
    per = spark.createDataFrame([("x", 0, 0.7, 0.5), ("x", 1, None, 0.0), ("y", 0, 0.6, 0.4),
                                 ("y", 1, 0.8, 0.2)], "k string, cls int, auroc double, ap double")
    got = {r.k: r for r in macro(per, ["k"], 2).collect()}
    assert got["x"].macro_auroc is None and got["x"].macro_ap == pytest.approx(0.25)
    assert got["y"].macro_auroc == pytest.approx(0.7) and got["y"].macro_ap == pytest.approx(0.3)


def test_buckets_are_balanced_whatever_the_scale(spark):
    """Large, close scores spread over all buckets, none far above its share."""
    from pyspark.sql import functions as F

    from eventide.operators import metrics as M
    d = spark.range(20_000).selectExpr("'a' AS g", "1e6 + id / 20000 AS s")
    sizes = [r["count"] for r in M.bucketed(d, ["g"]).groupBy("bkt").count().collect()]
    assert len(sizes) >= M.BUCKETS - 1 and max(sizes) < 2 * 20_000 / M.BUCKETS
    y = d.withColumn("y", (F.col("s") > 1e6 + 0.5).cast("int"))
    assert M.ranking_metrics(y, ["g"], "s", "y").first().auroc == 1.0


def test_large_counts_do_not_overflow(spark, monkeypatch):
    """3e9 positives and as many negatives: their product is beyond a BIGINT."""
    from eventide.operators import metrics
    n = 3_000_000_000
    rows = spark.createDataFrame([("t", 0.1, 0, n), ("t", 0.2, n, n), ("t", 0.3, n, 2 * n)], "g string, s double, pos long, cnt long")
    monkeypatch.setattr(metrics, "_collapse", lambda df, *a: df.withColumn("neg", df["cnt"] - df["pos"]))
    r = metrics.ranking_metrics(rows, ["g"], "s", "y").first()
    assert r.auroc == pytest.approx(5 / 8)
