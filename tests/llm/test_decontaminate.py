import hashlib
import random
import re

import duckdb

from checks.compare import normalize
from eventide.llm import decontaminate as dc
from eventide.llm import oracle, registry

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window=10):
    out = []
    for i, text in rows:
        ws, hit, found = words(text), set(), set()
        for item, t in items:
            it = words(t)
            n = min(window, len(it))
            if item is None or not n:
                continue
            for k in range(len(it) - n + 1):
                for a in range(len(ws) - n + 1):
                    if ws[a:a + n] == it[k:k + n]:
                        hit.update(range(a, a + n))
                        found.add(item)
        names = ",".join(sorted(map(str, found)))
        out.append((str(i), len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def run(df, bench, **kw):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in dc.report(dc.find_contamination(df, bench, **kw)).collect())


def test_query_against_sql(spark):
    got = registry.op6_decontaminate(spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert normalize(got) == normalize(con.execute(oracle.ORACLE["op6_decontaminate"]).df())


def cases():
    rng = random.Random(4)
    small = "a b c d é".split()  # few words: windows overlap and repeat
    items = [(k, " ".join(rng.choice(small) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 9, 10, 11, 14, 30, 4])]
    items += [(100, None), (101, ""), (None, "a b"), (102, "!!! ..."), (103, items[8][1]), (100, "d d d d")]
    rows = [(1000 + k, " ".join(rng.choice(small) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    rows += [(1050, "X-" + items[8][1].upper() + ", " + items[7][1])]
    return rows, items


def test_small_alphabet_blocks_and_pieces(spark, make_docs, odd, monkeypatch):
    rows, items = cases()
    rows += odd
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([r for r in rows if len(r[1] or "") < 1000], items, 4)
    df = make_docs([r for r in rows if len(r[1] or "") < 1000], clash=True)
    assert run(df, bench, window=4) == want
    # a benchmark beyond the block bound: same result, block by block
    assert run(df, bench, window=4, block_windows=10) == want
    monkeypatch.setattr(dc, "PIECE", 7)
    searches = dc.compiled([(k, (t or "").encode()) for k, t in items if k is not None], 4)
    for i, text in rows[:40]:
        n, spans, _ = dc.scan_text(text.encode(), searches, 3)
        assert [str(i), n, sum(b - a for a, b in spans)] == [*next(w for w in want if w[0] == str(i))[:3]]


def test_stage_and_empty_tables(spark, make_docs, odd):
    bench = spark.createDataFrame([(1, "same text of several words here")], "item_id long, text string")
    df = make_docs(odd, clash=True)
    out = dc.decontaminate(df, bench)
    assert out.columns == df.columns
    assert out.count() == sum("same text of several" not in (t or "") for _, t in odd)
    assert dc.decontaminate(df, bench.limit(0)).count() == len(odd)
    assert run(make_docs([]), bench) == []


def test_shift_table_skips():
    s = dc.Search(10, {tuple(f"w{i}".encode() for i in range(10)): [0]})
    assert s.shift[(b"w8", b"w9")] == 0 and s.shift[(b"w0", b"w1")] == 8 and s.jump == 9
    text = [b"x"] * 1000 + [f"w{i}".encode() for i in range(10)]
    assert [e for e, _ in s.find(text)] == [1010]
