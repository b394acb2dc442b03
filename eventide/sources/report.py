"""Metric report: long ``(target, metric, value)`` rows from several frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(*frames: DataFrame) -> DataFrame:
    parts = [f.select(F.col("target").cast("string"), F.col("metric").cast("string"),
                      F.col("value").cast("double")) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_report(df: DataFrame, path: str) -> None:
    df.orderBy("target", "metric").coalesce(1).write.mode("overwrite").parquet(path)
