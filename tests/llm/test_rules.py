import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from eventide.llm import registry, rules

SF = "/root/testdata/sf0.001"


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(text):
    text = text or ""
    ws = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    covered = {j for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(ws)
    return (n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def buckets(text):
    ws = split(text)

    def h(word, seed):
        return xxhash.xxh64_intdigest(word.encode(), seed & (2**64 - 1))

    return [h(w, 42) & rules.BUCKETS - 1 for w in ws] + [h(b, h(a, 42)) & rules.BUCKETS - 1 for a, b in zip(ws, ws[1:])]


def row(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_whole_table_against_brute_force(spark, real, labels):
    got = {r.doc_id: r for r in registry.op9_quality_rules(spark, SF).collect()}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    raw, target = Counter(), Counter()
    for i, t, _ in real[1]:
        raw.update(buckets(t))
        if i in good:
            target.update(buckets(t))
    table = rules.ratios(real[0], labels)
    import math
    n_raw, n_target = sum(raw.values()) + rules.BUCKETS, sum(target.values()) + rules.BUCKETS
    for b in range(0, rules.BUCKETS, 97):
        assert abs(table[b] - (math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw))) < 1e-6
    assert len(got) == len(real[1])
    for i, t, _ in real[1]:
        assert row(got[i]) == brute(t)
        bs = buckets(t)
        score = sum(table[b] for b in bs) / len(bs) if bs else 0.0
        assert abs(got[i].score - score) < 1e-6
        assert got[i].kept == (not got[i].base_failed and got[i].score >= rules.THRESHOLD)


def test_keeps_good_and_catches_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op9_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    share = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def test_odd_rows(spark, make_docs, odd, labels):
    rows = odd + [(40, "a b c a b c"), (41, "a b c x a b c y b c x"), (42, "one\ntwo\none\n\n\n one\n"), (43, "z z z z z"), (44, "### <a> | $5 & 10% *")]
    df = make_docs(rows, clash=True)
    got = rules.judge(rules.measure(df, None)).collect()
    assert sorted(map(row, got)) == sorted(brute(t) for _, t in rows)
    assert len(rules.apply_rules(df, labels.limit(0)).collect()) == len(rows)
    assert rules.apply_rules(make_docs([]), labels).count() == 0
    twice = spark.createDataFrame([(40, 1, None), (40, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert rules.trusted_ids(twice).count() == 1


def test_every_good_label_counts(spark, make_docs):
    n = 20_500
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert rules.trusted_ids(labels).count() == n
    # texts of the whole labelled set: target and raw are the same, so no bucket differs
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id) AS text")
    assert max(map(abs, rules.ratios(docs, labels))) < 1e-12


def shuffled(df):
    """Rows that the exchanges of a collected table have written."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name == "ReusedExchangeExec":
            return 0
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_texts_without_trust_are_not_shuffled(spark, monkeypatch):
    """Also where no table is small enough to be broadcast by the planner."""
    n = 5_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 3) AS text").union(
        spark.sql("SELECT CAST(NULL AS BIGINT), 'w1 w2'"))
    good = spark.range(0, n, 50).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").union(spark.sql("SELECT NULL, 1, 0"))
    seen = []
    monkeypatch.setattr(rules, "marked", lambda *a, f=rules.marked: seen.append(f(*a)) or seen[-1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = rules.ratios(docs, good)
        assert shuffled(seen[-1]) < n / 10  # 100 trusted texts, their ids and places
        assert [r.good for r in seen[-1].collect()].count(True) == 100 and seen[-1].count() == n + 1
        monkeypatch.setattr(rules, "SIEVE", 64)  # nearly every id goes through: the join decides
        assert rules.ratios(docs, good) == table
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # ids of another type, ids that repeat, and no trusted ids at all
    narrow = good.selectExpr("CAST(doc_id AS INT) AS doc_id", "quality", "toxic")
    assert rules.ratios(docs, narrow.union(narrow)) == table
    assert rules.ratios(docs, good.limit(0)) is None


def test_native_plan(spark):
    plan = registry.op9_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_windows_whose_hashes_collide(spark, make_docs, text_maker, monkeypatch):
    """With four bits of the hash, most windows share one with others; equal ones are still found."""
    rows = [(i, text_maker(i % 5, 40 + 7 * i, vocabulary=6)) for i in range(20)] + [(50, "a b c x y z a b c q a b c"), (51, None), (52, "a b c a b c a")]
    want = sorted(brute(t)[4] for _, t in rows)
    for bits in (-1, 15 << 40, 0):
        monkeypatch.setattr(rules, "HASHED", bits)
        got = rules.measure(make_docs(rows), None)
        assert sorted(r.n_repeat_words for r in got.collect()) == want
