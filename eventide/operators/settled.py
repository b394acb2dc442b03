"""Small derived tables, written once and read back.

The table goes to the cluster's checkpoint folder as Parquet, so its lineage
is cut, later plans stay small, and it survives lost executors.  The planner
then knows its size in bytes and broadcasts it in a join only while that is
under ``spark.sql.autoBroadcastJoinThreshold``; beyond it, the same join
shuffles (with AQE's skew splitting).  No caller hints.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from eventide.session import ensure_checkpoint_dir


def settled(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/eventide-settled/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
