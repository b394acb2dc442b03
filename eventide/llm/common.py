"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import ensure_checkpoint_dir

# ASCII white space [\x20\x09-\x0D]; also what bytes.split() and bytes.strip() use.
SPACES = " \t\n\x0b\x0c\r"

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
LOWER = bytes.maketrans(_UPPER, _LOWER)

# A-Z lower-cased, every other ASCII byte that is no letter or digit a space:
# what .split() leaves are the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
PLAIN_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: what follows survives lost executors without running
    ``df`` again, and ``df`` is computed once however often it is read.  The files
    stay until :func:`dropped` or :func:`release`, as a lazy result may read them.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def own_folder(spark: SparkSession) -> str:
    """The session's folder for saved tables, under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/eventide-llm/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(table: DataFrame) -> None:
    """Delete the files of a saved table that nothing reads any more; of
    any other table, nothing."""
    if path := _PATHS.pop(table, None):
        _delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all that the operators have saved in this session, once its
    results have been written or read."""
    _delete(spark, own_folder(spark))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores appended until no column is called so."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as a reference, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def bounded_sample(rows: DataFrame, n_rows: int, sample: int, salt: str) -> DataFrame:
    """About ``sample`` and at most twice as many of the distinct ``(doc_id,
    text)`` rows, the same ones however they are partitioned; some if there are any.

    Rows are chosen by a hash of both columns, so that rows that share an id or have
    none are still sampled one by one, and repeated rows count once."""
    share = min(1.0, sample / max(1, n_rows))
    while True:
        some = rows.withColumn("r", unit_hash(F.lit(salt), "doc_id", "text")).where(F.col("r") < share).dropDuplicates(
            ["doc_id", "text"]).orderBy("r", "doc_id", "text").limit(2 * sample)
        some = saved(some.drop("r"), salt)
        if share >= 1 or not some.isEmpty():
            return some
        dropped(some)
        share = min(1.0, 8 * share)  # a few texts repeated many times may all lie above the bound


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, under fixed names: further columns of the
    input, whatever they are called, never reach an operator."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def as_bytes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, body)``-shaped input for an Arrow kernel: the text as
    UTF-8 bytes, which Arrow hands over without decoding."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("body"))


def text_hash(text: str | Column = "text") -> Column:
    """Second half of a row's identity, so that rows that share an id but
    not their text stay apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def unit_hash(*cols: str | Column) -> Column:
    """A reproducible number in [0, 1) from the columns' values."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit("unit"), *cols), 11), F.lit(2**53)) / F.lit(float(2**53))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row.  Bound as a lambda's
    variable it stays so, also if Catalyst pushes a filter on the
    result below the projection and copies the expression."""
    return F.transform(F.array(value), use)[0]


def number_array(values) -> Column:
    """A constant array<double>; one string literal that Catalyst folds, so
    a table of thousands of numbers is one node of the plan."""
    return F.split(F.lit(",".join(f"{float(v):.9g}" for v in values)), ",").cast("array<double>")


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of an Arrow binary column, without a copy."""
    offs = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offs.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def spans_by_bytes(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
