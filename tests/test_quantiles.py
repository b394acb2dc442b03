import numpy as np
import pandas as pd
import pytest

from eventide.operators.quantiles import exact_quantiles

PROBS = [0.1, 0.25, 0.5, 0.9]


@pytest.mark.parametrize("accuracy", [10_000, 500, 20])
def test_exact_quantiles_match_linear_interpolation(spark, accuracy):
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(rng.random(n) < 1 / 3, "hot", rng.choice(["a", "b", "c"], n))
    v = np.round(rng.gamma(2.0, 3.0, n), 1)  # many ties
    pdf = pd.DataFrame({"g": g, "v": v})
    pdf.loc[pdf.g == "c", "v"] = 5.0  # a constant group
    got = exact_quantiles(spark.createDataFrame(pdf), "g", "v", PROBS, accuracy=accuracy).toPandas()
    for (grp, qi), row in got.set_index(["g", "qi"]).iterrows():
        exp = np.percentile(pdf.loc[pdf.g == grp, "v"].to_numpy(), PROBS[qi] * 100, method="linear")
        assert row["edge"] == pytest.approx(exp, abs=1e-9), (grp, qi)
    assert len(got) == 4 * len(PROBS)


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_ties_on_both_sides_of_a_boundary(spark, accuracy):
    """Equal parts of 50 values: each decile falls between two tied values."""
    df = spark.range(50_000).selectExpr("'x' AS g", "cast(id % 50 + 1 AS double) AS v")
    got = {r.qi: r.edge for r in exact_quantiles(df, "g", "v", PROBS, accuracy=accuracy).collect()}
    v = np.repeat(np.arange(1.0, 51.0), 1000)
    assert got == {i: pytest.approx(np.percentile(v, p * 100)) for i, p in enumerate(PROBS)}


def test_one_hot_group_of_distinct_values(spark, monkeypatch):
    """No window spans a band: the rows read by the last one are a small part of
    the group's band."""
    from eventide.operators import quantiles
    n = 200_000
    df = spark.range(n).selectExpr("'hot' AS g", "cast((id * 7919) % 200003 AS double) AS v")
    monkeypatch.setattr(quantiles, "settled", kept := Kept(quantiles.settled))
    got = {r.qi: r.edge for r in exact_quantiles(df, "g", "v", PROBS, accuracy=1000).collect()}
    v = (np.arange(n) * 7919 % 200_003).astype(float)
    assert got == {i: pytest.approx(np.percentile(v, p * 100)) for i, p in enumerate(PROBS)}
    bands = {r.qi: r["count"] for r in kept.by["quantile-band-values"].groupBy("qi").count().collect()}
    bins = {(r.qi, r.bin): 0 for r in kept.by["quantile-wanted"].collect()}
    assert all(sum(q == qi for q, _ in bins) <= 2 for qi in bands)
    cuts = {r.qi: r.cuts for r in kept.by["quantile-bins"].collect()}
    for qi, held in bands.items():
        assert held > 800 and len(cuts[qi]) > 200  # a bin holds some 256th part of the band


class Kept:
    def __init__(self, settled):
        self.settled, self.by = settled, {}

    def __call__(self, df, name):
        self.by[name] = self.settled(df, name)
        return self.by[name]


def test_sketches_merge_for_any_days(spark):
    from eventide.operators import quantiles
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"item": rng.choice(["a", "b"], 20_000), "day": rng.integers(0, 10, 20_000), "value": rng.gamma(2, 3, 20_000)})
    daily = quantiles.daily_sketches(spark.createDataFrame(pdf), "item", "day", "value")
    for days in ([3], [0, 1, 2], list(range(10))):
        got = quantiles.merged_quantiles(daily.where(daily["day"].isin(days)), "item", PROBS).collect()
        for r in got:
            v = np.sort(pdf[(pdf.item == r["item"]) & pdf.day.isin(days)].value.to_numpy())
            assert r.n == len(v)
            assert abs(np.searchsorted(v, r.edge) / len(v) - PROBS[r.qi]) <= quantiles.SKETCH_ERROR
