import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import quality, registry

SF = "/root/testdata/sf0.01"


def test_against_labels(spark):
    got = registry.op4_quality_classifier(spark, SF)
    assert got.count() == 1000
    share = {r.quality: r.kept for r in got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    n, good = 40_000, rng.random(40_000) < 0.7
    v = np.zeros((n, len(quality.VOTES)), np.int64)
    rates = np.linspace(0.3, 0.8, len(quality.VOTES))
    for k, (_, _, _, vote, _) in enumerate(quality.VOTES):
        right = good if vote == 1 else ~good
        v[:, k] = np.where(rng.random(n) < np.where(right, rates[k], 0.02), vote, 0)
    pattern = quality.pattern_of(v)
    p, c = np.unique(pattern, return_counts=True)
    assert (quality.votes_of(p) == v[np.unique(pattern, return_index=True)[1]]).all()
    post, table, share = quality.em(p, c)
    of = dict(zip(p.tolist(), post))
    said = np.array([of[x] for x in pattern.tolist()]) >= 0.5
    assert abs(share - 0.7) < 0.03 and (said == good).mean() > 0.95
    for k, (_, _, _, vote, _) in enumerate(quality.VOTES):
        assert abs(table[k, 0 if vote == 1 else 1, vote] - rates[k]) < 0.05


def test_statistics_against_brute_force(real):
    import pyarrow as pa
    bodies = [t.encode() for _, t, _ in real[1]] + [b"", b" ", b"a", b"A!! A!! b#", b"x" * 5000]
    offs, data = quality.buffers(pa.array(bodies, pa.binary()))
    w = quality.Words(offs, data)
    s = w.stats()
    for i, b in enumerate(bodies):
        ws = b.split()
        assert s["words"][i] == len(ws)
        if ws:
            assert s["repeats"][i] == pytest.approx(sum(x == y for x, y in zip(ws, ws[1:])) / len(ws))
            assert s["distinct"][i] == pytest.approx(len(set(ws)) / len(ws))
            assert s["bare"][i] == pytest.approx(sum(not any(chr(c).isalpha() and c < 128 or c > 127 for c in x) for x in ws) / len(ws))


def arrays(*bodies):
    import pyarrow as pa
    return list(quality.runs(pa.array(list(bodies), pa.binary())))


def test_a_word_of_megabytes_is_counted():
    body = b"Tail " + b"a" * 2_500_000 + b"B!9 end"
    (w,) = arrays(body)
    s = w.stats()
    assert isinstance(w, quality.LongText) and w.count[0] == 3
    (part,) = [p for p in w.parts() if p.kinds.sum() > 10**6]
    assert part.kinds[0, [quality.LOWERS, quality.UPPERS, quality.BANGS, quality.DIGITS]].tolist() == [2_500_000, 1, 1, 1]
    assert s["mean"][0] == pytest.approx(len(body.replace(b" ", b"")) / 3)


def test_pieces_of_a_long_text_say_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    ws = [b"alpha", b"Beta", b"GAMMA!", b"x9.", b"caf\xc3\xa9", b"#", b"a" * 40]
    body = b" ".join(ws[k] for k in rng.integers(0, len(ws), 400)) + b"\n  " + b"z" * 95
    weights = rng.normal(size=quality.BUCKETS)
    (whole,) = arrays(body)
    want = whole.stats(), whole.weighed(weights), whole.bucket_counts()[0]
    for piece in (1, 13, 50, 1000):
        monkeypatch.setattr(quality, "PIECE", piece)
        (w,) = arrays(body)
        assert isinstance(w, quality.LongText)
        got = w.stats()
        assert all(got[k][0] == pytest.approx(want[0][k][0]) for k in got)
        assert w.weighed(weights)[0] == pytest.approx(want[1][0])
        assert (w.bucket_counts()[0][0] == want[2][0]).all() and (w.bucket_counts()[0][1] == want[2][1]).all()


def test_features_against_brute_force():
    """Hashes, shapes and buckets of two texts, word by word in Python integers."""
    ALL, R, GOLD = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def brute(body):
        out, before = {}, None
        for w in body.split():
            h = sum((c + 1) * pow(R, i, 1 << 64) for i, c in enumerate(w)) & ALL
            h ^= h >> 31
            n = {k: sum(f(c) for c in w) for k, f in {
                "low": lambda c: 97 <= c < 123, "up": lambda c: 65 <= c < 91, "digit": lambda c: 48 <= c < 58, "high": lambda c: c >= 128,
                "stop": lambda c: chr(c) in ".,;:?'\"()-", "bang": lambda c: c == 33}.items()}
            n["odd"] = sum(c >= 33 for c in w) - sum(n.values())
            letters = n["low"] + n["up"] + n["high"]
            shape = ((letters == 0) + 2 * (2 * n["up"] > letters) + 4 * (n["odd"] > 0) + 8 * (n["bang"] > 0)
                     + 16 * (before is not None and before[0] == h) + 32 * (n["stop"] > 0) + 64 * (n["digit"] > 0) + 128 * min(len(w) // 4, 7))
            joined = (h + before[0] * R) & ALL if before else h
            both = shape + (before[1] + 1) * 4096 if before else shape
            for salt, x in enumerate((h, joined, shape, both), 1):
                x = (x * GOLD + salt * R) & ALL
                k = (((x ^ (x >> 29)) * GOLD) & ALL) >> 49
                out[k] = out.get(k, 0) + 1
            before = (h, shape)
        return out

    texts = [b"The quick, brown FOX! jumps 12 times 12 times times", b"x", "caf\u00e9 na\u00efve #tag A-B (end).".encode(), b""]
    (w,) = arrays(*texts)
    for body, (buckets, n) in zip(texts, w.bucket_counts()):
        assert dict(zip(buckets.tolist(), n.tolist())) == brute(body)


def test_a_row_scores_the_same_whatever_stands_beside_it(make_docs, text_maker):
    scorer = quality.Scorer(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.1)
    texts = [text_maker(i, 30) for i in range(12)]
    alone = [quality.scores(make_docs([(i, t)]).coalesce(1), scorer).first().score for i, t in enumerate(texts[:4])]
    both = {r.doc_id: r.score for r in quality.scores(make_docs(list(enumerate(texts))).coalesce(1), scorer).collect()}
    assert [both[i] for i in range(4)] == pytest.approx(alone)


@pytest.mark.parametrize("one_id", [None, 7])
def test_rows_that_share_an_id_are_sampled_by_their_texts(spark, one_id):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    normal = {r.text for r in docs.join(quality.classify(docs, sample=400).where("kept"), "doc_id").collect()}
    same = docs.withColumn("doc_id", F.lit(one_id).cast("long"))
    kept = {r.text for r in quality.keep_good(same, sample=400).collect()}
    assert len(kept ^ normal) < 0.02 * docs.count()


def test_scorer_from_repeated_rows_and_of_few(make_docs, text_maker):
    docs = make_docs([(1, text_maker(1, 60))] * 5000 + [(2, "!!! ### $$$ " * 20)])
    scorer, found = quality.fit(docs, sample=3)
    assert scorer is not None and found["share"] is not None
    assert quality.fit(make_docs([]))[0] is None


def test_odd_rows(make_docs, odd):
    df = make_docs(odd, clash=True)
    got = quality.classify(df).collect()
    assert len(got) == len(odd)
    empty = [r for r in got if r.n_words == 0]
    assert empty and not any(r.kept for r in empty)
    assert all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert quality.classify(make_docs([])).count() == 0 and quality.keep_good(make_docs([])).count() == 0


def test_keep_good_equals_classify(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.keep_good(docs).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.classify(docs).where("kept").collect()}
    assert quality.keep_good(docs).schema == docs.schema
