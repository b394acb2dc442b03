"""One stay holding a third of all events (derived from the events table):
positions, occurrence ranks and carried values still equal the naive
stay-wide windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.operators import cohorts
from eventide.plans import params as P
from eventide.plans.workspace import Workspace
from eventide.sources.tables import events_raw


def test_hot_stay(spark):
    raw = events_raw(spark, "/root/testdata/sf0.01")
    hot = raw.withColumn("stay_id", F.when(F.pmod("row_id", F.lit(3)) == 0, F.lit(1000)).otherwise(F.col("stay_id")))
    ws = Workspace(spark, "/root/testdata/sf0.01", raw=hot)
    t = ws.tokens
    ev = t.where("kind = 1")
    share = ev.where("stay_id = 1000").count() / ev.count()
    assert share > 0.3
    # positions equal a naive row_number over the whole stay
    w = Window.partitionBy("stay_id").orderBy("charttime", "kind", "row_id", "sub")
    naive = t.select("stay_id", "charttime", "kind", "row_id", "sub", "pos",
                     (F.row_number().over(w) - 1).alias("naive"))
    assert naive.where(F.col("pos") != F.col("naive")).count() == 0
    # occurrence ranks equal the naive ones
    ex = cohorts.nth_occurrences(t, P.LAB_TARGETS, test_only=False, drop_first=False)
    wn = Window.partitionBy("stay_id", "target").orderBy("pos")
    chk = ex.withColumn("naive", F.row_number().over(wn) - 1)
    assert chk.where(F.col("occ") != F.col("naive")).count() == 0


def test_hot_stay_in_the_cohorts(spark):
    """Last lab, dose histogram, hour horizon, splice and loss on the same data."""
    from eventide.operators import augment
    from eventide.plans import handoff, overdose, registry
    raw = events_raw(spark, "/root/testdata/sf0.01")
    hot = raw.withColumn("stay_id", F.when(F.pmod("row_id", F.lit(3)) == 0, F.lit(1000)).otherwise(F.col("stay_id")))
    ws = Workspace(spark, "/root/testdata/sf0.01", raw=hot)
    t = ws.test_tokens.select("stay_id", "pos", "token", "hour_no", "next1", "next2").toPandas().sort_values(["stay_id", "pos"])
    cut = ws.test_tokens.groupBy("stay_id").agg((F.max("pos") - 7).alias("cut_pos"))
    cuts = {r.stay_id: r.cut_pos for r in cut.collect()}
    labs = t[(t.token == P.TRACKED_LAB) & (t.pos < t.stay_id.map(cuts))].groupby("stay_id").next1.last()
    got = {r.stay_id: r.last_mag for r in overdose.last_lab(ws, cut).collect() if r.last_mag is not None}
    assert got == {k: int(v.split(".")[1]) for k, v in labs.items()}
    n = overdose.dose_histogram(ws, cut).agg(F.sum("n")).first()[0]
    assert n == ((t.token == P.DRUG) & (t.pos < t.stay_id.map(cuts))).sum()
    shifts = handoff.shift_cuts(ws).where("stay_id = 1000")
    hour = t[t.stay_id == 1000].set_index("pos").hour_no
    for r in handoff.hour_horizon(ws, shifts).join(shifts, ["stay_id", "shift_start"]).collect():
        h0 = hour.get(r.cut - 1, 0)
        assert r.n_tokens == ((hour.index >= r.cut) & (hour <= h0 + P.HORIZON_HOURS)).sum()
    assert registry._stay_offsets(ws, ws.test_tokens.select("stay_id", "pos")).select("rn").distinct().count() == len(t)
    s = augment.splice_response(ws.test_tokens, ws.splits.where("testset").select("stay_id"))
    assert s.where("stay_id = 1000").count() == (t.stay_id == 1000).sum() + len(augment.RESPONSE)
    ws.close()


def test_hot_day_of_the_second_adapter(spark):
    """All lines of a third of the orders on one customer and day: the order key
    splits the day, and positions equal the naive ones."""
    from eventide.sources.tables import LINEITEM_ORDER, lineitem_raw
    raw = lineitem_raw(spark, "/root/testdata/sf0.001")
    third = F.pmod(F.xxhash64("l_orderkey"), F.lit(3)) == 0
    day = raw.agg(F.min("charttime")).first()[0]
    raw = raw.withColumn("stay_id", F.when(third, F.lit(7)).otherwise(F.col("stay_id"))) \
        .withColumn("charttime", F.when(third, F.lit(day)).otherwise(F.col("charttime")).cast(raw.schema["charttime"].dataType))
    ws = Workspace(spark, "/root/testdata/sf0.001", "lineitem", raw=raw)
    ws.tie = ("l_orderkey", 64)
    hot = ws.seconds.where("stay_id = 7").agg(F.countDistinct("tb"), F.max("c"), F.sum("c")).first()
    assert hot[0] > 20 and hot[1] < hot[2] / 10
    order = ["charttime", *LINEITEM_ORDER]
    w = Window.partitionBy("stay_id").orderBy(*order)
    naive = ws.raw_only.withColumn("k", F.row_number().over(w)).where("stay_id = 7").select("k", "row_id")
    got = ws.tokens.where("stay_id = 7 and kind = 1 and sub = 0")
    got = got.withColumn("k", F.row_number().over(Window.partitionBy("stay_id").orderBy("pos"))).select("k", "row_id")
    assert naive.exceptAll(got).count() == 0 and got.count() == naive.count()
    ws.close()


def test_no_key_of_the_hot_stay_holds_many_rows(spark):
    """Sizes, not values: the rows that meet in one window or under one join key of the
    stream build, the cuts and the horizon, where one stay has a third of all events."""
    from eventide.operators.scan import DEFAULT_FANOUT, SALTS
    from eventide.operators.stream import SUB_US, epoch_us
    raw = events_raw(spark, "/root/testdata/sf0.01")
    hot = raw.withColumn("stay_id", F.when(F.pmod("row_id", F.lit(3)) == 0, F.lit(1000)).otherwise(F.col("stay_id")))
    ws = Workspace(spark, "/root/testdata/sf0.01", raw=hot)

    def largest(df, *keys):
        return df.groupBy(*keys).count().agg(F.max("count")).first()[0]

    mine = ws.raw_only.where("stay_id = 1000").count()
    events = ws.raw_only.withColumn("second", F.floor(epoch_us("charttime") / F.lit(SUB_US)))
    assert largest(events, "stay_id", "second") < 0.01 * mine
    salt = F.pmod(F.xxhash64("charttime", "row_id", "value"), F.lit(SALTS))
    assert largest(ws.raw_only.withColumn("salt", salt).where("stay_id = 1000"), "stay_id", "salt") < 3 * mine / SALTS
    assert largest(ws.seconds, "stay_id", "ah") <= 3600
    chunk = F.floor(F.col("pos") / DEFAULT_FANOUT)
    assert largest(ws.tokens.withColumn("chunk", chunk), "stay_id", "chunk") <= DEFAULT_FANOUT
    ws.close()
