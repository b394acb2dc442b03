"""The streaming tokeniser emits the same event tokens as the batch one."""

import uuid

from pyspark.sql import functions as F

from eventide.streaming import tokenize as st


def test_stream_tokens_match_batch(spark, ws):
    src = st.event_source(spark, "/root/testdata/sf0.001")
    toks = st.token_rows(st.raw_from_events(src), ws.edges_long)
    name = "tok_" + uuid.uuid4().hex[:8]
    q = toks.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table(name).groupBy("token").agg(F.count("*").alias("n"))
    batch = ws.tokens.where("kind = 1").groupBy("token").agg(F.count("*").alias("n"))
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_hourly_counts_with_watermark(spark, ws):
    src = st.event_source(spark, "/root/testdata/sf0.001")
    toks = st.token_rows(st.raw_from_events(src), ws.edges_long)
    name = "hc_" + uuid.uuid4().hex[:8]
    q = st.hourly_counts(toks).writeStream.format("memory").queryName(name) \
        .outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    total = spark.table(name).agg(F.sum("n")).first()[0]
    assert total == ws.tokens.where("kind = 1").count()


def test_a_second_run_takes_only_new_files(spark, ws, tmp_path):
    import shutil
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    shutil.copyfile("/root/testdata/sf0.001/events.parquet", src / "events.parquet")
    one = st.tokens_so_far(spark, str(src), ws.edges_long, out).count()
    assert one == ws.tokens.where("kind = 1").count()
    assert st.tokens_so_far(spark, str(src), ws.edges_long, out).count() == one
    shutil.copyfile("/root/testdata/sf0.001/events.parquet", src / "events2.parquet")
    assert st.tokens_so_far(spark, str(src), ws.edges_long, out).count() == 2 * one
