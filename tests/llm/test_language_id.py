import zlib

import numpy as np
from pyspark.sql import functions as F

from eventide.llm import language_id as lid
from eventide.llm import registry


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    rows = got.select("doc_id", "held_out", "lang_pred", "score", "lang").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_learns_only_from_labelled_rows_not_held_out(spark, make_docs, text_maker):
    rows = [(i, text_maker(i % 2, 60), "xx" if i % 2 else "yy") for i in range(40)] + [(100, "unlabelled " * 9, None)]
    sample = lid.sample(make_docs(rows)).collect()
    allowed = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert len(sample) == len(allowed)
    net = lid.fit(make_docs(rows), steps=60)
    a = lid.predict(make_docs(rows), net).collect()
    b = lid.predict(make_docs([(i, t, "zz") for i, t, _ in rows]), net).collect()
    assert [r.lang_pred for r in a] == [r.lang_pred for r in b]
    assert {r.lang_pred for r in a} <= {"xx", "yy"}


def test_odd_rows(make_docs, odd, text_maker):
    rows = odd + [(20 + i, text_maker(i % 2, 40), "xx" if i % 2 else "yy") for i in range(12)] + [(50, "12 + 34 = 46 !"), (51, "ß"), (52, "x² → ²³"), (53, "²³ ½ _ ٣")]
    df = make_docs([(*r[:2], None) if len(r) == 2 else r for r in rows], clash=True)
    net = lid.fit(df, steps=20)
    got = lid.predict(df, net).collect()
    assert len(got) == len(rows)
    und = sorted((r.doc_id is None, r.doc_id) for r in got if r.lang_pred == "und")
    want = sorted((i is None, i) for i, t, *_ in rows if t is None or not any(c.isalpha() for c in t))
    assert und == want
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    none = lid.identify_languages(make_docs([(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert lid.identify_languages(make_docs([])).count() == 0


def test_pair_tables_equal_the_filters():
    net = lid.ByteConv(["a", "b"]).ready()
    x = np.random.default_rng(1).integers(0, 256, (5, lid.LENGTH)).astype(np.uint8)
    h = np.maximum(net.pooled(x)[0], 0) @ net.p["w"] + net.p["c"]
    h = h - np.log(np.exp(h).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probs(x), h, atol=1e-4)


def test_gradients_against_differences():
    net = lid.ByteConv(["a", "b", "c"])
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 123, (6, 40)).astype(np.uint8), rng.integers(0, 3, 6)

    def loss():
        h = np.maximum(net.pooled(x)[0], 0) @ net.p["w"] + net.p["c"]
        h = h - h.max(axis=1, keepdims=True)
        return -(h - np.log(np.exp(h).sum(axis=1, keepdims=True)))[np.arange(6), y].mean()

    g = net.gradients(x, y)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    for name, v in net.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        down = loss()
        v[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3


def test_sample_is_bounded(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = {r.lang: r["count"] for r in lid.sample(df, 20).groupBy("lang").count().collect()}
    assert set(n.values()) == {20}
    assert df.select(F.countDistinct("lang")).first()[0] == len(n)


def test_scores_against_every_window_by_hand(make_docs, odd, text_maker):
    net = lid.ByteConv(["a", "b", "c"])
    rng = np.random.default_rng(9)
    for v in net.p.values():
        v += rng.normal(size=v.shape).astype(np.float32) * 0.2
    rows = [r for r in odd if r[1] is not None and len(r[1]) < 20_000] + [(60 + i, text_maker(i, 30 * i + 1)) for i in range(12)]
    import pickle
    got = lid.predict(make_docs(rows), pickle.dumps(net)).collect()
    want = []
    for _, t in rows:
        if not any(map(str.isalpha, t)):
            want.append(("und", 0.0))
            continue
        body, total = t.encode().lower(), np.zeros(3)
        for at in range(0, len(body), lid.LENGTH):
            x = body[at:at + lid.LENGTH]
            padded = np.frombuffer(x.ljust(lid.LENGTH), np.uint8)
            top = [max(sum(net.p[f"t{w}"][k][padded[i + k], f] for k in range(w)) for i in range(lid.LENGTH - w + 1))
                   for w in lid.WIDTHS for f in range(lid.FILTERS)]
            z = np.maximum(np.array(top) + net.p["b"], 0) @ net.p["w"] + net.p["c"]
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(x)
        total /= len(body)
        want.append(("abc"[int(total.argmax())], float(total.max())))
    assert sorted((r.lang_pred, round(r.score, 3)) for r in got) == sorted((k, round(s, 3)) for k, s in want)


def test_every_language_is_learned_and_repeated_rows_do_not_hide_one(spark, make_docs, text_maker):
    rows = [(i, text_maker(1000 + i % 250, 40, 30), f"l{i % 250:03}") for i in range(1500)]
    rows += [(0, "always the same row", "same")] * 3000
    df = make_docs(rows)
    langs = {r.lang for r in lid.sample(df, 10).collect()}
    assert langs == {x for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(langs) > 240 and "same" in langs
    net = lid.fit(df, per_lang=10, steps=40)
    import pickle
    assert pickle.loads(net).langs == sorted(langs)
