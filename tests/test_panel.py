"""Panel recursion by enumeration, rule table, dose table, interpolation weights."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import augment, scoring
from eventide.plans import overdose, registry

SF = "/root/testdata/sf0.001"


def test_forward_equals_enumeration(spark, ws):
    panel = ["lab.view", "lab.click", "lab.view"]
    got = overdose.panel_forward(ws, panel).collect()
    ids = {r.token: r.token_id for r in ws.vocab.collect()}
    starts = {r.stay_id: r.start for r in overdose._after_injection(ws, overdose.cuts(ws)).collect()}
    mags = [ids.get(f"magnitude.{k}", 0) for k in range(10)]
    lasts = {*mags, *(ids[x] for x in panel), *starts.values()}
    grid = spark.createDataFrame([(a, ids[x], t) for a in lasts for x in set(panel) for t in mags], "c2 int, c1 int, target_id int")
    p = {(r.c2, r.c1, r.target_id): r.p for r in scoring.score(grid, ws.model).collect()}
    want = {}
    for stay, start in starts.items():
        # every path of outcomes: a magnitude 0..9 or none (10)
        for step in range(len(panel)):
            mass, mean = 0.0, 0.0
            for path in itertools.product(range(11), repeat=step):
                prob, last = 1.0, start
                for i, k in enumerate(path):
                    lab = ids[panel[i]]
                    each = [p[last, lab, t] for t in mags]
                    prob *= each[k] if k < 10 else 1 - sum(each)
                    last = mags[k] if k < 10 else lab
                each = [p[last, ids[panel[step]], t] for t in mags]
                mass += prob * sum(each)
                mean += prob * sum(k * x for k, x in enumerate(each))
            want[stay, step] = (mass, mean / mass)
    assert {(r.stay_id, r.step): (pytest.approx(r.mag_mass), pytest.approx(r.exp_mag)) for r in got} == want
    assert all(r.mag_mass + r.none_mass == pytest.approx(1) for r in got)


def test_a_longer_panel_adds_the_same_number_of_joins_each_step(ws):
    def joins(n):
        plan = overdose.panel_forward(ws, ["lab.view", "lab.click"] * n)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join")

    assert joins(1) == joins(2) == joins(3)  # a step's plan starts from a written table


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "stay_id long, pos long, token string, next1 string")


def test_rules_against_a_loop(spark):
    rng = np.random.default_rng(6)
    labs, drugs = ["lab.a", "lab.b", "lab.c"], ["med.x", "med.y"]
    rows = []
    for s in range(4):
        toks = []
        for _ in range(150):
            k = rng.random()
            toks += [rng.choice(labs), f"magnitude.{rng.integers(10)}"] if k < 0.5 else [rng.choice(drugs), f"unit.{rng.integers(3)}", "magnitude.1"] if k < 0.8 else ["lab.a", "odd"]
        rows += [(s, i, str(t), str(toks[i + 1]) if i + 1 < len(toks) else None) for i, t in enumerate(toks)]
    rules = [("med.x", None, "lab.a", 7, None), ("med.x", "unit.1", "lab.b", None, 2), ("med.y", None, "lab.a", 3, 4),
             ("med.y", "unit.0", "lab.c", None, None), ("med.x", "unit.2", "lab.c", 9, 9), ("med.z", None, "lab.a", None, None)]
    got = augment.forbidden(rows_of(spark, rows), augment.rule_table(spark, rules)).collect()
    want, state = [], {}
    for s, pos, tok, nxt in rows:
        for i, (drug, unit, lab, low, high) in enumerate(rules):
            v = state.get((s, lab))
            if tok == drug and (unit is None or unit == nxt) and v is not None and (low is None or v >= low) and (high is None or v <= high):
                want.append((s, pos, i, drug, lab, v))
        if tok in labs and nxt and nxt.startswith("magnitude."):
            state[s, tok] = int(nxt.split(".")[1])
    assert sorted((r.stay_id, r.pos, r.rule, r.drug, r.lab, r.state) for r in got) == sorted(want) and len(want) > 50


def test_one_rule_of_the_table_is_the_old_rule(ws, spark):
    old = augment.contraindicated(ws.tokens).collect()
    new = augment.forbidden(ws.tokens, augment.rule_table(spark, [("med.purchase", None, "lab.view", 8, None)])).collect()
    assert sorted((r.stay_id, r.pos, r.state) for r in old) == sorted((r.stay_id, r.pos, r.state) for r in new) and old


def test_dose_table_keeps_zeros_and_stays_without_a_dose(spark, ws):
    got = registry.dose_table(spark, SF).collect()
    stays = {r.stay_id for r in overdose.cuts(ws).collect()}
    units = {r.token for r in ws.tokens.where(F.col("token").startswith("unit.")).select("token").distinct().collect()}
    assert {(r.stay_id, r.unit) for r in got} == set(itertools.product(stays, units)) and len(got) == len(stays) * len(units)
    sparse = {(r.stay_id, r.unit, r.decile): r.n for r in overdose.dose_histogram(ws).collect()}
    assert all(r[f"d{k}"] == sparse.get((r.stay_id, r.unit, k), 0) for r in got for k in range(10))


def test_weights_against_numpy_and_the_loss_never_rises(spark, ws):
    m, val = registry._held_out(ws)
    got = scoring.fit_weights(val, m)
    losses = [r[4] for r in got]
    assert len(got) > 3 and all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))
    p0, p1, p2 = scoring.components(m, 1.0)
    p = np.array([tuple(r) for r in scoring.with_counts(val.select("c2", "c1", "target_id"), m).select(p0, p1, p2).collect()])
    w = np.full(3, 1 / 3)
    for k, l0, l1, l2, loss in got:
        assert [l0, l1, l2] == pytest.approx(w.tolist()) and sum((l0, l1, l2)) == pytest.approx(1)
        mix = p @ w
        assert loss == pytest.approx(-np.log(mix).mean())
        w = (p * w / mix[:, None]).mean(axis=0)
