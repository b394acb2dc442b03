"""Decayed history and the log-linear score against dense sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import memory, scoring

KEY = ["stay_id", "cut"]


def naive_bag(rows, cuts, half_life):
    out = {}
    for s, cut in cuts:
        for t_stay, pos, tid in rows:
            if t_stay == s and pos < cut:
                out[s, cut, tid] = out.get((s, cut, tid), 0.0) + 2.0 ** (-(cut - 1 - pos) / half_life)
    return out


@pytest.mark.parametrize("half_life,chunk", [(3.0, 4), (50.0, 16), (1e9, 8)])
def test_bag_equals_the_plain_sum(spark, half_life, chunk):
    rng = np.random.default_rng(1)
    rows = [(s, p, int(rng.integers(1, 6))) for s, n in ((1, 150), (2, 7), (3, 1)) for p in range(n)]
    cuts = [(1, 0), (1, 1), (1, 63), (1, 64), (1, 150), (2, 3), (2, 7), (3, 1), (4, 5)]
    tokens = spark.createDataFrame(rows, "stay_id long, pos long, token_id int")
    ex = spark.createDataFrame(cuts, "stay_id long, cut long")
    got = memory.decayed_bag(ex, tokens, KEY, half_life, 149, chunk=chunk).collect()
    want = naive_bag(rows, cuts, half_life)
    assert {(r.stay_id, r.cut, r.token_id): pytest.approx(r.weight) for r in got} == want


def test_score_equals_the_normalised_product_over_the_vocabulary(spark, ws):
    m, V = ws.model, ws.model.vocab_size
    ids = sorted(r.token_id for r in ws.vocab.collect() if r.token_id > 0)
    rng = np.random.default_rng(3)
    reqs = [(i, int(rng.choice([*ids, -1, 99])), int(rng.choice([*ids, -1, 99])), int(rng.choice([*ids, -1]))) for i in range(60)]
    bags = {i: {int(t): float(rng.random() * 3) for t in rng.choice(ids, rng.integers(0, 6), replace=False)} for i in range(60)}
    requests = spark.createDataFrame(reqs, "k int, c2 int, c1 int, target_id int")
    bag = spark.createDataFrame([(i, t, w) for i, b in bags.items() for t, w in b.items()] + [(0, 0, 5.0)], "k int, token_id int, weight double")
    got = {r.k: r for r in memory.with_memory(requests, bag, m, ["k"], 0.3, alpha=0.5).collect()}
    grid = spark.createDataFrame([(i, c2, c1, t) for i, c2, c1, _ in reqs for t in ids], "k int, c2 int, c1 int, target_id int")
    p = {(r.k, r.target_id): r.p for r in scoring.score(grid, m).collect()}
    own = {r.k: r.p for r in scoring.score(requests, m).collect()}
    for i, _, _, t in reqs:
        power = {x: p[i, x] ** 0.7 * (bags[i].get(x, 0.0) + 0.5) ** 0.3 for x in ids}
        assert got[i].p_plain == pytest.approx(own[i])
        mine = own[i] ** 0.7 * (bags[i].get(t, 0.0) + 0.5) ** 0.3
        assert got[i].p_memory == pytest.approx(mine / sum(power.values()))
    assert V == len(ids)


def test_probabilities_over_the_vocabulary_sum_to_one(spark, ws):
    ids = [r.token_id for r in ws.vocab.collect() if r.token_id > 0]
    reqs = spark.createDataFrame([(t, 3, 5, t) for t in ids], "k int, c2 int, c1 int, target_id int")
    bag = spark.createDataFrame([(t, x, float(x)) for t in ids for x in ids[:4]], "k int, token_id int, weight double")
    total = memory.with_memory(reqs, bag, ws.model, ["k"], 0.2).agg(F.sum("p_memory")).first()[0]
    assert total == pytest.approx(1.0)
