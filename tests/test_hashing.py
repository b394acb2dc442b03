import duckdb

from eventide.functions.hashing import uniform, uniform_sql


def test_uniform_same_in_spark_and_sql(spark):
    df = spark.range(0, 500).selectExpr("id AS a", "id * 7 + 3 AS b")
    got = [r.u for r in df.select(uniform("a", "b").alias("u")).orderBy("a").collect()]
    con = duckdb.connect()
    exp = [r[0] for r in con.execute(
        f"SELECT {uniform_sql('a', 'b')} FROM (SELECT range AS a, range * 7 + 3 AS b FROM range(500)) ORDER BY a"
    ).fetchall()]
    assert got == exp
    assert 0.4 < sum(got) / len(got) < 0.6
