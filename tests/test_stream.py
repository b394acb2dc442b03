"""Stream properties on sf0.001 (the reference's inline checks, as tests)."""

import pandas as pd
from pyspark.sql import functions as F

from eventide.operators import blocks
from eventide.plans import params as P


def test_positions_gapless(ws):
    s = ws.tokens.groupBy("stay_id").agg(F.count("*").alias("n"), F.max("pos").alias("mx"),
                                         F.countDistinct("pos").alias("d"), F.min("pos").alias("mn"))
    bad = s.where((F.col("n") != F.col("mx") + 1) | (F.col("d") != F.col("n")) | (F.col("mn") != 0))
    assert bad.count() == 0


def test_hour_tokens_step_by_one(ws):
    h = ws.tokens.where("kind = 0").select("stay_id", "hour_no", "token", "charttime").toPandas()
    h = h.sort_values(["stay_id", "hour_no"])
    hrs = h["token"].str.split(".").str[-1].astype(int)
    nxt = hrs.groupby(h["stay_id"]).shift(-1)
    ok = nxt.isna() | (nxt == (hrs + 1) % 24)
    assert ok.all()
    assert (h.groupby("stay_id")["hour_no"].diff().dropna() == 1).all()
    assert (h["charttime"].dt.hour == hrs).all()


def test_events_keep_time_order(ws):
    t = ws.tokens.select("stay_id", "pos", "charttime").toPandas().sort_values(["stay_id", "pos"])
    assert (t.groupby("stay_id")["charttime"].diff().dropna() >= pd.Timedelta(0)).all()


def test_training_blocks_have_block_size(ws):
    tb = blocks.training_blocks(ws.tokens, P.BLOCK)
    sizes = tb.select(F.size("x").alias("nx"), F.size("y").alias("ny")).distinct().collect()
    assert [(r.nx, r.ny) for r in sizes] == [(P.BLOCK, P.BLOCK + 1)]


def test_history_plus_block_rebuilds_prefix(ws):
    from eventide.operators import cohorts
    ex = cohorts.nth_occurrences(ws.tokens, P.LAB_TARGETS, drop_first=False)
    key = ["target", "stay_id", "occ"]
    small = 16
    hb = blocks.history_bag(ex, ws.tokens, key, small).groupBy(*key).agg(F.sum("n").alias("h"))
    tr = blocks.tail_rows(ex, ws.tokens, key, small).groupBy(*key).agg(F.count("*").alias("b"))
    j = ex.join(hb, key, "left").join(tr, key, "left").fillna(0, ["h", "b"])
    assert j.where(F.col("h") + F.col("b") != F.col("cut")).count() == 0


def test_missing_values_emit_no_null_token(spark):
    """A NULL value, a NULL k or an unseen item leaves its token out."""
    from eventide.plans.workspace import Workspace
    from eventide.sources.tables import events_raw
    raw = events_raw(spark, "/root/testdata/sf0.001")
    gone = F.pmod("row_id", F.lit(4)) == 0
    raw = raw.withColumn("value", F.when(~gone, F.col("value"))).withColumn("k", F.when(F.pmod("row_id", F.lit(8)) > 0, F.col("k")))
    ws = Workspace(spark, "/root/testdata/sf0.001", raw=raw.withColumn(
        "item", F.when(F.col("stay_id") % 10 == 0, F.concat("item", F.lit("_new"))).otherwise(F.col("item"))))
    assert ws.tokens.where(F.col("token").isNull()).count() == 0
    s = ws.tokens.groupBy("stay_id").agg(F.count("*").alias("n"), F.max("pos").alias("mx"))
    assert s.where(F.col("n") != F.col("mx") + 1).count() == 0
    ws.close()


def test_a_changed_table_gets_a_new_workspace(spark):
    import uuid

    from eventide.plans.workspace import Workspace
    from eventide.session import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(spark)}/eventide-test-tables-{uuid.uuid4().hex}"
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.write.parquet(f"{folder}/events.parquet")
    a = Workspace.get(spark, folder)
    assert Workspace.get(spark, folder) is a
    ev.limit(100).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    b = Workspace.get(spark, folder)
    assert b is not a and b.raw_only.count() == 100
    b.close()
