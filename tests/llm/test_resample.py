import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from eventide.llm import registry, resample

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def feats(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return ws, [zlib.crc32(" ".join(ws[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def brute(docs, target):
    """docs: (doc_id, text); sorted by what the draw sorts by."""
    of = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for _, _, bs in of for b in bs), Counter(b for x in target for b in feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for i, ws, bs in of:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in bs)
        rows.append((i, len(ws), len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = able[:5 * len(able) // 100]
    out = [(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in able[len(drawn):]]
    return sorted((out + [(*r, None) for r in rows if r[1] < 20]), key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_whole_table_against_brute_force(spark, real):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = registry.op11_resample(spark, SF)
    assert {"doc_id", "n_features", "weight", "score", "rank"} <= set(got.columns)
    assert {dict(got.dtypes)[c] for c in ("n_features", "weight", "score", "rank")} == {"bigint"}
    assert rows(got) == brute([(i, t) for i, t, _ in real[1]], target)


def test_odd_rows_ties_and_clashing_columns(make_docs, odd, text_maker):
    docs = odd + [(100 + i % 40, text_maker(i % 7, 60)) for i in range(80)] + [(None, text_maker(1, 60))] * 3
    target = [text_maker(99, 40), None, ""]
    got = resample.resample(make_docs(docs, clash=True), make_docs([(i, t) for i, t in enumerate(target)], clash=True))
    assert rows(got) == brute(docs, target)


@pytest.mark.parametrize("docs,target", [([], []), ([(1, "a b c")], []), ([], [(1, "a b")])])
def test_empty_tables(make_docs, docs, target):
    got = resample.resample(make_docs(docs), make_docs(target))
    assert rows(got) == brute(docs, [t for _, t in target])


def test_string_ids(spark, text_maker):
    docs = spark.createDataFrame([(f"d{i:03}", text_maker(i, 30)) for i in range(100)], "doc_id string, text string")
    got = resample.resample(docs, docs)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4, 5]


def test_head_changes_no_state(text_maker):
    ws = text_maker(3, 500).encode().split() + [b"\xc3\xa9t\xc3\xa9", b"x" * 5000]
    direct = [zlib.crc32(b" ".join(ws[i:i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]
    pairs = list(zip(ws, ws[1:]))
    for words, some in (([], []), (sorted(set(ws[::2])), sorted(set(pairs[::3]))), (sorted(set(ws)), sorted(set(pairs)))):
        got = resample.feature_states(ws, 0, resample.build_head(words, some))
        assert got.tolist() == direct


def test_pieces_of_a_long_text_give_every_feature_once(monkeypatch, text_maker):
    text = text_maker(5, 3000).encode()
    whole = Counter(zlib.crc32(b" ".join(text.split()[i:i + k])) for k in (1, 2, 3) for i in range(3000 - k + 1))
    monkeypatch.setattr(resample, "PIECE", 7)
    head = resample.build_head([], [])
    got = Counter()
    for ws, carried in resample.crossing(text):
        got.update(resample.feature_states(ws, carried, head).tolist())
    assert got == whole


def test_frequent_finds_every_heavy_word_and_pair(make_docs, monkeypatch):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "of", f"w{rng.randint(0, 10**6)}"]) for _ in range(300))) for i in range(50)]
    monkeypatch.setattr(resample, "HEAD", 64)
    words, pairs = resample.frequent(resample.as_bytes(resample.texts(make_docs(docs))))
    assert words == [b"of", b"the"]
    assert set(pairs) == {(a, b) for a in words for b in words}


def test_counts_of_a_stream_and_what_is_forgotten(monkeypatch, text_maker):
    texts = [text_maker(i, 200).encode() for i in range(30)] + [b"", None, b"one"]
    ws = [t.split() for t in texts if t]
    own = resample.Frequent()
    monkeypatch.setattr(resample, "HEAD", 10**9)
    monkeypatch.setattr(resample, "BUFFER", 333)
    monkeypatch.setattr(resample, "PIECE", 50)
    for t in texts:
        own.add(t)
    got = {(a, b): n for a, b, n in own.rows()}
    assert got.pop((None, None)) == sum(map(len, ws))
    assert got == Counter((w, None) for x in ws for w in x) + Counter(p for x in ws for p in zip(x, x[1:]))
    few = resample.Frequent()
    monkeypatch.setattr(resample, "COUNTERS", 40)
    for k in range(3000):
        few.add(b"the cat saw %d the cat" % k)
    got = {(a, b): n for a, b, n in few.rows()}
    assert got[b"the", None] == got[b"cat", None] == got[b"the", b"cat"] == 6000 and len(got) < 200
