import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventide.llm import registry, simhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text, size=3):
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    sh = [" ".join(ws[i:i + size]) for i in range(len(ws) - size + 1)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, radius=2):
    """label by smallest index over all pairs."""
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark, real):
    rows = sorted(real[1], key=lambda r: r[0])
    fps = [brute_fp(t) for _, t, _ in rows]
    want = {rows[i][0]: (f"{fps[i]:016x}", rows[c][0]) for i, c in enumerate(brute_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op7_simhash_dedup(spark, SF).collect()}
    assert got == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [4, 4096])
@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_of_a_hot_cluster(spark, radius, bucket):
    """Chains, a dense ball and strangers; small buckets force the second split."""
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    at = rng.getrandbits(64)
    for _ in range(40):
        at ^= sum(1 << b for b in rng.sample(range(64), 2))
        fps.add(at)
    fps = sorted(fps, key=signed)
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, radius, bucket)).collect()}
    want = brute_components(fps, radius)
    assert [got.get(signed(x), signed(x)) for x in fps] == [signed(fps[c]) for c in want]


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, 700).astype(np.uint64)
    for i in range(1, 700, 3):  # near copies of the one before
        fp[i] = fp[i - 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = simhash._lanes(np.ascontiguousarray(bits.T))
    for s in (1, 2, 63, 64, 65, 200):
        valid = np.zeros(700, np.uint8)
        valid[:-s] = 1
        for radius in (0, 1, 2, 3):
            hit = simhash.within(planes, simhash._lanes(valid), s, radius)
            got = np.unpackbits(hit.view(np.uint8), bitorder="little")[:700].astype(bool)
            want = np.zeros(700, bool)
            want[:-s] = [bin(int(a ^ b)).count("1") <= radius for a, b in zip(fp[:-s], fp[s:])]
            assert (got == want).all()


def test_odd_rows(make_docs, odd, text_maker):
    rows = odd + [(60, text_maker(1, 300)), (61, text_maker(1, 300)), (62, text_maker(1, 300).upper()), (63, text_maker(2, 300))]
    df = make_docs(rows, clash=True)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [brute_fp(t) for _, t in rows]
    root = brute_components(fps)
    least = {}
    for (i, _), c in zip(rows, root):
        least[c] = i if least.get(c) is None else min(least[c], i if i is not None else least[c])
    want = sorted((str(i), f"{f:016x}", str(least[c])) for (i, _), f, c in zip(rows, fps, root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.report(simhash.near_duplicates(df)).collect()) == want
    kept = simhash.dedup_near(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(root))
    assert simhash.near_duplicates(make_docs([])).count() == 0 and simhash.dedup_near(make_docs([])).count() == 0


def test_large_group_of_copies(make_docs, text_maker):
    rows = [(i, text_maker(9, 80)) for i in range(400)] + [(1000 + i, text_maker(100 + i, 80)) for i in range(50)]
    got = simhash.near_duplicates(make_docs(rows)).groupBy("component_id").count().orderBy(F.desc("count")).first()
    assert (got.component_id, got["count"]) == (0, 400)


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=4)


def test_a_hot_fingerprint_is_dealt_over_keys(spark, make_docs, text_maker, monkeypatch):
    rows = [(i, "one text that most rows share with each other") for i in range(600)] + [(1000 + i, text_maker(i, 20)) for i in range(200)]
    df = make_docs(rows)
    monkeypatch.setattr(simhash, "HOT", 2)
    got = simhash.near_duplicates(df)
    want = {i: 0 if i < 600 else i for i, _ in rows}
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" in plan
    monkeypatch.setattr(simhash, "HOT", 0)  # none is hot
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
