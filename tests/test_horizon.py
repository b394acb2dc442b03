"""The hour-bounded horizon against a dense linear solve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import horizon, scoring


def dense(m, vocab, target, hours, s=scoring.DEFAULT):
    """Expected targets, first passage and length from every start, by solving
    (I - Q) x = r over (token, hours left); row 0 is the unknown start."""
    tokens = {r.token_id: r.token for r in vocab.collect() if r.token_id > 0}
    ids = sorted(tokens)
    at = {t: i for i, t in enumerate(ids)}
    n0 = {r.token_id: r.n0 for r in m.m0.collect()}
    n1 = {(r.c1, r.token_id): r.n1 for r in m.m1.collect()}
    n1c = {r.c1: r.n1c for r in m.t1.collect()}
    p0 = np.array([(n0.get(t, 0) + s.alpha) / (m.total + s.alpha * m.vocab_size) for t in ids])
    P = np.zeros((len(ids) + 1, len(ids)))
    P[0] = p0
    for c in ids:
        row = np.array([n1.get((c, t), 0) / n1c[c] for t in ids]) if n1c.get(c) else p0
        P[at[c] + 1] = (s.l1 + s.l2) * row + s.l0 * p0
    hour = np.array([tokens[t].startswith("hour.") for t in ids])
    hit = np.array([t == target for t in ids], float)
    V = len(ids)
    out, below = {}, np.zeros((3, V))
    for h in range(1, hours + 1):
        stay = P[1:] * ~hour  # the hours left stay as they are
        keep = (stay, stay * (1 - hit), stay)
        gain = (P @ hit, P @ hit, P @ np.ones(V))
        x = np.zeros((3, V + 1))
        for k in range(3):
            down = P * hour * (1 - hit if k == 1 else 1)
            r = gain[k] + down @ below[k]
            inner = np.linalg.solve(np.eye(V) - keep[k], r[1:])
            x[k, 1:] = inner
            x[k, 0] = r[0] + (P[0] * ~hour * (1 - hit if k == 1 else 1)) @ inner
        below = x[:, 1:]
        out = {-1: x[:, 0], **{t: x[:, at[t] + 1] for t in ids}}
    return out


@pytest.mark.parametrize("hours", [1, 3, 12])
def test_equals_a_dense_solution(ws, hours):
    target = ws.vocab.where(F.col("token") == "med.purchase").first().token_id
    got = horizon.hour_horizon(ws.model, ws.vocab, target, hours).collect()
    want = dense(ws.model, ws.vocab, target, hours)
    assert {r.c1 for r in got} == set(want)
    for r in got:
        assert [r.expected, r.first_passage, r.n_tokens] == pytest.approx(want[r.c1].tolist(), abs=1e-7)
        assert r.alive <= horizon.TOLERANCE
        assert 0 <= r.first_passage <= min(1.0, r.expected) + 1e-9 and r.n_tokens >= hours


def test_stops_and_says_so_when_no_hour_can_come(ws):
    got = horizon.hour_horizon(ws.model, ws.vocab, 1, 2, hour_prefix="never.").collect()
    assert all(r.alive == pytest.approx(1.0) for r in got)
