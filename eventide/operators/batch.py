"""Pluggable batch scorer over fixed-size blocks (Arrow batches).

The reference pushes blocks of 64 through a loaded network.  On Spark the
hook is ``mapInPandas``: every task receives Arrow batches of
``(keys, block)`` rows and calls a vectorised scorer on a 2-d array, so an
external model (for example an ONNX session created once per task) can be
plugged in without row-at-a-time Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.scoring import NgramModel, Smoothing


def batch_score(blocks: DataFrame, key_cols: Sequence[str], block_col: str,
                make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """``(*keys, score)``; ``make_scorer`` runs once per task (load a model
    there), the returned function maps an ``(n, T)`` int array to ``n``
    scores (NaN for undefined)."""
    keys = list(key_cols)
    fields = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", score double"

    def run(batches):
        scorer = make_scorer()
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack([np.asarray(a, dtype=np.int64) for a in pdf[block_col]])
            s = np.asarray(scorer(x), dtype=float)
            out = pdf[keys].copy()
            out["score"] = np.where(np.isnan(s), None, s)
            yield out

    return blocks.select(*keys, block_col).mapInPandas(run, schema)


MAX_VOCAB = 2048  # a dense matrix of more tokens is too large to send to every task


def chain_scorer(m: NgramModel, s: Smoothing):
    """Mean negative log-likelihood of a block's tokens given the one before, under
    the order-1 mixture ``(l1 + l2) * P1 + l0 * P0``; padding is skipped.

    The model goes to the tasks as one matrix of ``V + 1`` squared numbers."""
    if m.vocab_size > MAX_VOCAB:
        raise ValueError(f"{m.vocab_size} tokens: score with scoring.score, which joins the model")
    top = m.vocab_size + 1
    mass = m.total + s.alpha * m.vocab_size or 1.0  # an empty vocabulary scores nothing
    p0 = np.full(top, s.alpha / mass)
    for r in m.m0.where(F.col("token_id") > 0).collect():  # at most V rows
        p0[r.token_id] = (r.n0 + s.alpha) / mass
    p = np.tile(p0, (top, 1))
    seen = np.zeros((top, top))
    for r in m.m1.where((F.col("c1") > 0) & (F.col("token_id") > 0)).collect():  # at most V squared rows
        seen[r.c1, r.token_id] = r.n1
    total = np.zeros(top)
    for r in m.t1.where(F.col("c1") > 0).collect():
        total[r.c1] = r.n1c
    has = total > 0
    p[has] = seen[has] / total[has, None]
    logs = np.log((s.l1 + s.l2) * p + s.l0 * p0)

    def make():
        def score(x: np.ndarray) -> np.ndarray:
            a, b = x[:, :-1], x[:, 1:]
            real = (a > 0) & (b > 0)
            n = real.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(n > 0, -(logs[a, b] * real).sum(axis=1) / n, np.nan)
        return score
    return make


def share_scorer(token_ids: Sequence[int], pad: int = 0):
    """Share of non-padding positions holding one of ``token_ids``."""
    ids = np.asarray(list(token_ids), dtype=np.int64)

    def make():
        def score(x: np.ndarray) -> np.ndarray:
            hit = np.isin(x, ids).sum(axis=1).astype(float)
            real = (x != pad).sum(axis=1).astype(float)
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(real > 0, hit / real, np.nan)
        return score
    return make
