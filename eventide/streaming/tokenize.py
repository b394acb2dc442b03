"""Incremental tokenisation with Structured Streaming.

The reference is batch only; this is the same tokeniser applied to events as
they arrive, for keeping the token table current:

* new event rows are read with ``readStream`` (file source);
* the decile edges fitted in batch are a static table, joined to the stream
  (stream-static join; the planner broadcasts it while it is small);
* each event is expanded into its tokens (stateless, per row);
* an event-time aggregate with a watermark counts tokens per hour, so late
  rows are accepted up to the watermark and the state is then dropped.

Positions inside a stay are not assigned here: they depend on every earlier
token of the stay and are assigned by the batch stream builder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.tokens import Grammar, emit


def event_source(spark: SparkSession, folder: str, table: str = "events",
                 max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming read of ``<folder>/<table>*.parquet`` (schema taken from the
    files already there, never inferred per batch)."""
    schema = spark.read.parquet(os.path.join(folder, f"{table}.parquet")).schema
    return (spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{table}*.parquet")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def raw_from_events(ev: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    raw = ev.select(F.col("user_id").alias("stay_id"), F.col("ts").alias("charttime"),
                    F.col("event_id").alias("row_id"), F.col("event_type").alias("item"),
                    F.col("value").cast("double").alias("value"),
                    F.get_json_object("props", "$.k").cast("int").alias("k"))
    if splits is None:
        return raw.withColumn("testset", (F.pmod("stay_id", F.lit(10)) == 0))
    return raw.join(splits, "stay_id", "left")


def token_rows(raw_stream: DataFrame, edges_long: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """``stay_id, charttime, row_id, sub, token`` for every streamed event."""
    e = emit(raw_stream, edges_long, grammar or Grammar())
    return e.select("stay_id", "charttime", "row_id", F.posexplode("toks").alias("sub", "token"))


def hourly_counts(tokens: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Tokens per (event-time hour, token), late rows accepted up to the
    watermark."""
    t = tokens.withColumn("et", F.col("charttime").cast("timestamp"))
    return (t.withWatermark("et", watermark)
            .groupBy(F.window("et", "1 hour").alias("w"), "token")
            .agg(F.count("*").alias("n")))


def tokens_so_far(spark: SparkSession, folder: str, edges_long: DataFrame, out: str, grammar: Grammar | None = None) -> DataFrame:
    """Run the stream over all files there are (``availableNow``, batch by batch) into
    Parquet under ``out`` and read it back.  Progress is kept beside the data, so
    the next call takes only new files, and a run that stops goes on where it was."""
    toks = token_rows(raw_from_events(event_source(spark, folder)), edges_long, grammar)
    (toks.writeStream.format("parquet").outputMode("append").option("checkpointLocation", os.path.join(out, "_progress"))
     .trigger(availableNow=True).start(os.path.join(out, "tokens")).awaitTermination())
    return spark.read.schema(toks.schema).parquet(os.path.join(out, "tokens"))
