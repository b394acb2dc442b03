"""Row numbers, running totals and the append-only vocabulary."""

import numpy as np
from pyspark.sql import functions as F

from eventide.operators.ranking import numbered, running_totals
from eventide.operators.tokens import extend_vocabulary, vocabulary


def test_numbers_and_totals_in_order(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 3000), rng.permutation(3000))]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = numbered(df, [F.col("a").desc(), "b"]).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(3000))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1]))
    got = running_totals(df, ["b"], F.col("a").cast("long"), "before").orderBy("b").collect()
    want = np.cumsum([0] + [a for a, _ in sorted(rows, key=lambda r: r[1])])[:-1]
    assert [r.before for r in got] == want.tolist()
    assert numbered(df.limit(0), ["b"]).count() == 0


def test_old_ids_stay_when_tokens_are_added(spark):
    def tokens(*names):
        return spark.createDataFrame([(t,) for t in names] * 3 + [(None,)], "token string")

    def ids(v):
        return {r.token: r.token_id for r in v.collect()}

    first = vocabulary(tokens("m", "c", "x"))
    assert ids(first) == {"Null event": 0, "c": 1, "m": 2, "x": 3}
    more = extend_vocabulary(first, tokens("a", "m", "z", "b"))
    assert ids(more) == ids(first) | {"a": 4, "b": 5, "z": 6}
    assert ids(extend_vocabulary(more, tokens("x", "a"))) == ids(more)
    assert ids(extend_vocabulary(more, tokens("aa"))) == ids(more) | {"aa": 7}
