"""Skew-safe scans against brute force, with a tiny fanout so that the
chunked levels are really used, and one group holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest

from eventide.operators.scan import last_before, neighbors, prefix_sum, rank_in_group


def _frame(spark, seed=0, n=600):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 6, n))  # group 0 is hot
    pdf = pd.DataFrame({"g": g.astype("int64")})
    pdf["pos"] = pdf.groupby("g").cumcount().astype("int64")        # gapless per group
    pdf["v"] = rng.integers(0, 5, n).astype("int64")
    pdf["x"] = np.where(rng.random(n) < 0.3, rng.integers(0, 9, n), np.nan)
    from pyspark.sql import functions as F
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))  # NaN -> NULL


@pytest.mark.parametrize("fanout,levels", [(4, 2), (3, 3), (1000, 1)])
def test_prefix_sum(spark, fanout, levels):
    pdf, df = _frame(spark)
    got = prefix_sum(df, "g", "pos", ["v"], fanout=fanout, levels=levels).toPandas()
    exp = pdf.sort_values(["g", "pos"]).copy()
    exp["v_before"] = exp.groupby("g")["v"].cumsum() - exp["v"]
    m = exp.merge(got, on=["g", "pos"], suffixes=("", "_got"))
    assert len(m) == len(pdf)
    assert (m["v_before"] == m["v_before_got"]).all()


def test_rank_in_group_sparse_order(spark):
    pdf, df = _frame(spark, 1)
    df = df.withColumn("pos", df.pos * 7 + 3)  # not dense, still unique
    got = rank_in_group(df, "g", "pos", "r", fanout=5).toPandas()
    got = got.sort_values(["g", "pos"])
    assert (got.groupby("g").cumcount().values == got["r"].values).all()


@pytest.mark.parametrize("inclusive", [False, True])
def test_last_before(spark, inclusive):
    pdf, df = _frame(spark, 2)
    got = last_before(df, "g", "pos", "x", "lx", inclusive=inclusive, fanout=4).toPandas()
    exp = pdf.sort_values(["g", "pos"]).copy()
    carried = exp.groupby("g")["x"].ffill()
    exp["lx"] = carried if inclusive else exp.assign(c=carried).groupby("g")["c"].shift(1)
    m = exp.merge(got, on=["g", "pos"], suffixes=("", "_got"))
    a, b = m["lx"].to_numpy(), m["lx_got"].to_numpy(dtype=float)
    assert np.array_equal(np.isnan(a), np.isnan(b))
    assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)])


def test_neighbors(spark):
    pdf, df = _frame(spark, 3)
    got = neighbors(df, "g", "pos", "v", [-2, -1, 1, 2], ["m2", "m1", "p1", "p2"], fanout=4).toPandas()
    exp = pdf.sort_values(["g", "pos"]).copy()
    for o, n in [(-2, "m2"), (-1, "m1"), (1, "p1"), (2, "p2")]:
        exp[n] = exp.groupby("g")["v"].shift(-o)
    m = exp.merge(got, on=["g", "pos"], suffixes=("", "_got"))
    assert len(m) == len(pdf)
    for n in ["m2", "m1", "p1", "p2"]:
        a, b = m[n].to_numpy(dtype=float), m[n + "_got"].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), n
        assert (a[~np.isnan(a)] == b[~np.isnan(b)]).all(), n


def test_levels_for_grows_with_the_longest_group():
    from eventide.operators.scan import levels_for
    assert levels_for(10) == 2
    assert levels_for(4096 ** 2) == 2
    assert levels_for(4096 ** 2 + 1) == 3
    assert levels_for(10 ** 11) == 4


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_rank_depth_does_not_change_result(spark, levels):
    pdf, df = _frame(spark, 4)
    got = rank_in_group(df, "g", "pos", "r", fanout=3, levels=levels).toPandas().sort_values(["g", "pos"])
    assert (got.groupby("g").cumcount().values == got["r"].values).all()
