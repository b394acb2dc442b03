import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

# Columns that clash with names the operators use inside.
CLASHES = ["h", "fp", "key", "n_words", "score", "kept", "spans", "ws", "body", "__h", "__d", "rate", "label", "id", "d", "own_d", "own_h",
           "copies", "residual", "own_rate", "p", "bs", "owner", "n_dropped", "n_bits", "keep", "__owner", "__n_bits", "__n_dropped",
           "__keep", "__body", "__id", "__hash", "__rate", "__copies", "r", "place", "n", "root", "odd name"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clash=False):
        """rows: (doc_id, text) or (doc_id, text, lang)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df
    return make


@pytest.fixture(scope="session")
def real(spark):
    """The whole documents of sf0.001, in Spark and as (doc_id, text, lang)."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text, r.lang) for r in df.collect()]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


ODD = [
    (None, None), (1, None), (2, ""), (3, "   \n\t\n "), (4, "word"), (5, "two words"), (6, "é ß ñ 😀 ü x"),
    (7, "same text of several words here"), (8, "same text of several words here"), (8, "same text of several words here"),
    (9, "x" * 50_000), (10, "a b " * 20_000), (None, "same text of several words here"), (11, "\x00\x01 \x7f~"),
]


@pytest.fixture
def stored(tmp_path, spark):
    """A table written as Parquet and read again, as the pipeline does."""
    def store(df):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)
    return store


@pytest.fixture(scope="session")
def odd():
    return list(ODD)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def text_maker():
    return prose
