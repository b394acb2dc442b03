"""Hand fixtures for the quirks kept from the reference."""

from pyspark.sql import functions as F

from eventide.operators import cohorts
from eventide.operators.scan import at_offset
from eventide.plans import params as P


def test_q1_first_occurrence_dropped(ws):
    ex = cohorts.nth_occurrences(ws.tokens, P.LAB_TARGETS)
    assert ex.where("occ = 0").count() == 0
    allx = cohorts.nth_occurrences(ws.tokens, P.LAB_TARGETS, drop_first=False)
    n_stays = allx.select("target", "stay_id").distinct().count()
    assert allx.count() - ex.count() == n_stays


def test_q2_read_past_the_end_is_null(spark, ws):
    last = ws.tokens.groupBy("stay_id").agg(F.max("pos").alias("pos"))
    r = at_offset(last, ws.tokens, "pos", 1, ["token"], prefix="n_")
    assert r.where(F.col("n_token").isNotNull()).count() == 0


def test_q5_short_stays_dropped(ws):
    stays = ws.splits.select("stay_id")
    c = cohorts.first_n_hours(ws.tokens, stays, 10_000)
    assert c.count() == 0
    c2 = cohorts.first_n_hours(ws.tokens, stays, 24)
    assert c2.where(~F.col("cut_token").startswith("hour.")).count() == 0


def test_q6_equal_requests_are_all_answered(spark, ws):
    t = ws.tokens.where("kind = 1").select("stay_id", F.col("charttime").alias("t")).limit(3)
    twice = t.unionByName(t)
    got = cohorts.asof_cut(twice, ws.tokens, ws.grid, ws.seconds, "t")
    assert got.count() == 6 and got.distinct().count() <= 3


def test_units_above_three_are_counted(spark):
    """A dose with k of 100 or more has its own unit in the histogram."""
    from eventide.plans import overdose
    from eventide.plans.workspace import Workspace
    from eventide.sources.tables import events_raw
    raw = events_raw(spark, "/root/testdata/sf0.001")
    ws = Workspace(spark, "/root/testdata/sf0.001", raw=raw.withColumn("k", F.col("k") + 100))
    cut = ws.test_tokens.groupBy("stay_id").agg((F.max("pos") + 1).alias("cut_pos"))
    h = overdose.dose_histogram(ws, cut)
    assert h.agg(F.sum("n")).first()[0] == ws.test_tokens.where(F.col("token") == P.DRUG).count()
    assert {r.unit for r in h.select("unit").distinct().collect()} <= {f"unit.{u}" for u in range(4, 8)}
    ws.close()


def test_a_cluster_must_name_its_checkpoint_folder():
    import pytest

    from eventide import session

    class Conf:
        def get(self, *_):
            return None

    class Sc:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Spark:
        sparkContext, conf = Sc(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Spark())


def test_q6_duplicate_times_share_last_position(ws):
    from eventide.plans import dose_eval
    ex = dose_eval.dose_examples(ws).toPandas()
    grp = ex.groupby(["stay_id", "charttime"])["last_pos"].nunique()
    assert (grp == 1).all()
