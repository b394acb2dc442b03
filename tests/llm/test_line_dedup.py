import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from checks.compare import normalize
from eventide.llm import line_dedup as ld
from eventide.llm import oracle, registry

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    def key(line):
        return line.strip(SPACE).translate(LOWER)

    big = float("inf")
    owners = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            owners.setdefault(key(line), set()).add(big if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(owners[key(x)]) == (big if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def run(df, **kw):
    got = ld.apply_bitmaps(df, ld.line_bitmaps(df, **kw))
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got.collect())


def test_query_against_sql(spark):
    got = registry.op5_line_dedup(spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert normalize(got) == normalize(con.execute(oracle.ORACLE["op5_line_dedup"]).df())


def test_hot_line_over_many_partitions(make_docs, text_maker):
    rows = [(i, "\n".join(["The SAME line everywhere", f"own line {i:06d}", "  the same LINE everywhere\t", "short", text_maker(i % 7, 6)]))
            for i in range(900)]
    df = make_docs(rows)
    want = brute(rows)
    for n in (1, 7, 40):
        assert run(df, partitions=n) == want
    # the hot hash is not one partition's
    own = ld.texts(df).select(ld.owner_key(F.col("doc_id"), "bigint").alias("owner"), ld.text_hash().alias("h"), "text")
    dealt = ld.line_hashes(own, 10).repartitionByRange(20, "key", "owner", "place").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 3 * sum(r["count"] for r in dealt) / 20


def test_odd_rows(make_docs, odd):
    rows = odd + [(20, "same text of several words here\nSAME TEXT of several words here  \n\n\nñandúñandú1\ntail"), (21, "ñandúñandú1\nñandúñand1\ntail"),
                  (22, "ñandúñand1"), (23, "x\n" * 3000), (24, "repeated in one doc only\n" * 3), (8, "another text of the same id")]
    df = make_docs(rows, clash=True)
    assert run(df, partitions=3) == brute(rows)
    assert run(make_docs([])) == []


def test_ids_of_other_types(spark):
    def keep(ids, kind):
        df = spark.createDataFrame([(i, f"a line of all documents\nown line of number {k}") for k, i in enumerate(ids)], f"doc_id {kind}, text string")
        return [r.doc_id for r in ld.dedup_lines(df).collect() if "all documents" in r.text]

    assert keep(["b", "a10", "a9", None], "string") == ["a10"]
    assert keep([2**63 - 1, None], "long") == [2**63 - 1]
    assert keep([5, -3, -2**63, 2**63 - 1], "long") == [-2**63]
    assert keep([3, -1, 2], "int") == [-1]


def test_texts_of_the_stage(make_docs, odd):
    rows = odd + [(30, "keep this line of mine\nsame text of several words here")]
    df = make_docs(rows, clash=True)
    out = ld.dedup_lines(df)
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    got = out.collect()
    assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in got) == sorted(r[3] for r in brute(rows))
    changed = next(r for r in got if r.doc_id == 30)
    assert (changed.text, changed.n_chars) == ("keep this line of mine", 22)
    assert sum(r.text is None for r in got) == sum(t is None for _, t in rows)


def test_bitmap_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 8, 9, 1000):
        gone = np.flatnonzero(rng.random(n) < 0.3)
        bits = ld.keep_bits(ld.bitmap(n, gone), n)
        assert (np.flatnonzero(~bits) == gone).all() and len(bits) == n
    assert len(ld.bitmap(100_000, np.arange(50_000))) < 200
