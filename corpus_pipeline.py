"""The corpus pipeline: documents -> filtered, deduplicated, weighted mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet before the next stage reads it, so a lost executor costs tasks of
one stage only.  All stages but the last return the columns of ``documents``.

* quality_classifier: rows that the classifier rejects go;
* line_dedup: the text loses lines that an earlier document holds (the row
  stays, also if no line is left);
* simhash_dedup: one row of each group of near copies stays;
* decontaminate: rows with a benchmark window go;
* mixing: rows get a rate and a number of copies; rows of no copy go.

Defined for every input: a null text is kept null by the stages that keep it (the
classifier rejects it, as it rejects empty texts); empty tables pass through all stages
as empty tables; rows that share an id are told apart by their text, and rows that share both
are one document (one of them stays); ties go to the smallest id, then the
smallest text hash; long texts are read in pieces; ids may be of any type; further columns
travel unread, whatever they are called, and ``rate``, ``copies`` and ``residual`` get an
underscore appended where a column is called so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import decontaminate, line_dedup, mixing, quality, simhash
from eventide.llm.common import dropped, saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup_near(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mix_to_targets),
]

# SQL expresses neither the classifier nor XXH64; tests/llm holds the result
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)  # a stage's copy goes when the next one is written
    return STAGES[-1][1](spark, docs, sf_dir)
