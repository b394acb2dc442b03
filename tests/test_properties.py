"""Model and tokeniser properties."""

import pytest
from pyspark.sql import functions as F

from eventide.operators import scoring


def test_every_context_sums_to_one(spark, ws):
    ids = [r.token_id for r in ws.vocab.where("token_id > 0").collect()]
    ctx = [(r.c2, r.c1) for r in ws.model.m2.select("c2", "c1").distinct().limit(5).collect()]
    ctx += [(None, ids[0]), (None, None), (-1, -1)]  # partial and unseen contexts
    rows = [(i, c2, c1, t) for i, (c2, c1) in enumerate(ctx) for t in ids]
    req = spark.createDataFrame(rows, "ctx int, c2 int, c1 int, target_id int")
    sums = scoring.score(req, ws.model).groupBy("ctx").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == len(ctx)
    for r in sums:
        assert r.s == pytest.approx(1.0, abs=1e-9)


def test_training_magnitudes_near_equal(ws):
    e = ws.emitted.where(~F.col("testset") & F.col("item").isin("view", "click", "purchase"))
    counts = e.groupBy("item", "mag").count().toPandas()
    for item, part in counts.groupby("item"):
        share = part["count"] / part["count"].sum()
        assert len(part) == 10
        assert share.min() > 0.05 and share.max() < 0.15, item
