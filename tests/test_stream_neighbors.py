"""Neighbours, spine rows and lookups of the stream that are derived, not shuffled,
against the naive windows; and insertions against a brute force."""

import pathlib
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.operators import augment, scoring
from eventide.operators.stream import at_unit, stay_lengths
from eventide.plans import handoff, registry
from eventide.plans.workspace import Workspace

SF = "/root/testdata/sf0.001"
EVENTS = "stay_id long, charttime timestamp_ntz, row_id long, item string, value double, k int"


def rows(spark):
    """Stays 10 and 20 (test), 1, 2, 3: gaps of none, one and many hours, equal times, an event
    without a token at the start and at the end, a lone event, a null stay and time."""
    r = [(10, "2024-01-01 00:10:00", "view"), (10, "2024-01-01 00:10:00", "view"), (10, "2024-01-01 01:00:00", "signup"),
         (10, "2024-01-01 03:30:00", "purchase"), (10, "2024-01-02 19:00:00", "click"), (20, "2024-01-01 05:00:00", None),
         (20, "2024-01-01 06:00:00", "error"), (20, "2024-01-01 08:59:59", "view"), (20, "2024-01-01 12:00:00", None),
         (1, "2024-01-01 00:00:00", "view"), (1, "2024-01-01 01:30:00", "signup"), (1, "2024-01-01 02:30:00", "signup"),
         (1, "2024-01-01 04:30:00", "error"), (2, "2024-01-01 00:00:00", "purchase"), (3, "2024-01-01 00:00:00", None),
         (3, "2024-01-01 02:00:00", None), (None, "2024-01-01 00:00:00", "view"), (1, None, "view")]
    return spark.createDataFrame([(s, t, i, item, float(i), 10 * i) for i, (s, t, item) in enumerate(r)], "stay_id long, t string, row_id long, item string, value double, k int") \
        .selectExpr("stay_id", "CAST(t AS timestamp_ntz) AS charttime", "row_id", "item", "value", "k")


@pytest.fixture(scope="module")
def odd_ws(spark):
    ws = Workspace(spark, SF, raw=rows(spark))
    yield ws
    ws.close()


def naive(t):
    w = Window.partitionBy("stay_id").orderBy("charttime", "kind", "row_id", "sub")
    return t.select("*", (F.row_number().over(w) - 1).alias("rn"), *[F.lead("token", k).over(w).alias(f"n{k}") for k in (1, 2)],
                    *[F.lag("token", k).over(w).alias(f"p{k}") for k in (1, 2)])


def wrong(t):
    d = naive(t)
    bad = F.col("rn") != F.col("pos")
    for a, b in (("n1", "next1"), ("n2", "next2"), ("p1", "prev1"), ("p2", "prev2")):
        bad = bad | ~F.col(a).eqNullSafe(F.col(b))
    return d.where(bad).count()


def test_neighbours_of_odd_stays(odd_ws):
    t = odd_ws.tokens
    assert wrong(t) == 0
    n = {r.stay_id: r.n for r in t.groupBy("stay_id").agg(F.count("*").alias("n")).collect()}
    assert n[3] == 2 and n[2] == 3 and None not in n  # a stay without a token has its spine
    assert {r.stay_id: r.len for r in stay_lengths(odd_ws.grid).collect()} == n


def test_neighbours_of_the_tables(ws, spark):
    assert wrong(ws.tokens) == 0
    li = Workspace.get(spark, SF, "lineitem").tokens
    w = Window.partitionBy("stay_id").orderBy("pos")
    d = li.select("next2", "prev2", F.lead("token", 2).over(w).alias("n2"), F.lag("token", 2).over(w).alias("p2"))
    assert d.where(~F.col("next2").eqNullSafe(F.col("n2")) | ~F.col("prev2").eqNullSafe(F.col("p2"))).count() == 0


def test_spine_tokens_are_not_written(ws, odd_ws):
    """The saved tables grow with the events, whatever the time between them."""
    for w in (ws, odd_ws):
        hours = w.tokens.where("kind = 0").count()
        assert w.grid.count() <= w.raw_only.count() < hours and w._spine.count() == w.grid.count()


def test_cuts_and_ends_at_every_hour(odd_ws):
    """The grid's covering rows give what a count of the stream gives."""
    from eventide.operators import cohorts
    t = odd_ws.tokens
    hours = t.sparkSession.range(-3, 60).select(F.col("id").alias("__h"))
    asked = odd_ws.grid.select("stay_id").distinct().crossJoin(hours.select(F.expr("timestampadd(MINUTE, 30 * __h, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("t")))
    got = cohorts.asof_cut(asked, t, odd_ws.grid, odd_ws.seconds, "t")
    want = asked.join(t.select(F.col("stay_id").alias("s"), "charttime"), (F.col("s") == F.col("stay_id")) & (F.col("charttime") <= F.col("t")), "left") \
        .groupBy("stay_id", "t").agg(F.count("s").alias("cut"))
    assert got.count() == asked.count() and got.exceptAll(want).count() == 0
    rel = at_unit(odd_ws.grid.select("stay_id").distinct().crossJoin(hours), odd_ws.grid, "__h", relative=True)
    end = {(r[0], r[1]): r[2] for r in rel.select("stay_id", "__h", F.col("__h") + F.col("__gc_before") + F.col("__gc")).collect()}
    last = {(r.stay_id, r.hour_no): r.n for r in t.groupBy("stay_id", "hour_no").agg((F.max("pos") + 1).alias("n")).collect()}
    assert all(end[k] == v for k, v in last.items())


def test_contexts_are_read_from_the_stream(ws):
    """The carried neighbours give the rows that the shuffle gives, without a window."""
    fast, slow = scoring.with_context(ws.tokens, ws.vocab), scoring.with_context(ws.tokens)
    cols = slow.columns
    assert fast.select(cols).exceptAll(slow).count() == 0 and slow.exceptAll(fast.select(cols)).count() == 0
    assert "Window" not in fast._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_stays_is_joined_to_the_events(spark):
    """The driver holds no copy of the stays for the test flag."""
    ws = Workspace.get(spark, SF, "lineitem")
    assert "Join" not in ws.raw._jdf.queryExecution().executedPlan().toString()
    assert ws.raw.select("stay_id", "testset").distinct().exceptAll(ws.splits).count() == 0


def test_plans_of_the_contexts_hold_the_cuts_once(spark):
    for name, joins in (("shift_context", 6), ("first_time_shifts", 8)):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "shift_start" in plan and "__inside" not in plan and plan.count("Join") <= joins, name
    ws = Workspace.get(spark, SF)
    assert handoff.shift_context(ws).count() == handoff.shift_cuts(ws).count()


@pytest.mark.parametrize("chunk", [2, 7, 512])
def test_insertions_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(augment, "ANCHOR_CHUNK", chunk)
    stays = {1: 23, 2: 5, 3: 1, 4: 40}
    at = {1: [0, 1, 2, 9, 22], 2: [], 3: [0], 4: [3, 39, 41, 90]}  # some lie behind the end
    tokens = spark.createDataFrame([(s, p, f"t{p}") for s, n in stays.items() for p in range(n)], "stay_id long, pos long, token string")
    anchors = spark.createDataFrame([(s, p) for s, ps in at.items() for p in ps] + [(1, 9), (7, 0)], "stay_id long, pos long")
    got = {(r.stay_id, r.pos): (r.token, r.loss_weight) for r in augment.insert_after(tokens, anchors, "new").collect()}
    want = {}
    for s, n in stays.items():
        out = [x for p in range(n) for x in [(f"t{p}", 0)] + [("new", 1)] * (p in at[s])]
        want |= {(s, i): x for i, x in enumerate(out)}
    assert got == want
    plan = augment.insert_after(tokens, anchors)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 2 * 3


def test_events_meet_their_neighbours_across_chunks_and_partitions(spark, odd_ws):
    """Chunks of a few events, on ranges of a few events: the same tokens as in one chunk,
    with copies of a row and keys equal but for the last order column."""
    from eventide.operators.stream import event_tokens, ordered_events
    cols = ["a", "b"]
    ev = odd_ws.emitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n")).selectExpr("* EXCEPT (n)", "1 AS a", "5 - n DIV 2 AS b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = odd_ws._save(ordered_events(ev, cols), "ordered-test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "a" not in ordered.columns and ordered.select(F.shiftright("at", 33)).distinct().count() > 3
    w = Window.partitionBy("stay_id").orderBy("charttime", *cols)
    want = ev.where("charttime IS NOT NULL AND size(toks) > 0").select("stay_id", F.row_number().over(w).alias("n"), "charttime", "toks")
    got = ordered.select("stay_id", F.row_number().over(Window.partitionBy("stay_id").orderBy("at")).alias("n"), "charttime", "toks")
    assert got.where("stay_id != 10").exceptAll(want).count() == 0 and got.count() == want.count()
    grid = odd_ws.grid
    one = event_tokens(ordered, grid)
    assert one.count() == 4 * odd_ws._event_tokens.count()
    for fanout in (4, 7):
        few = event_tokens(ordered, grid, fanout=fanout)
        assert few.exceptAll(one).count() == 0 and one.exceptAll(few).count() == 0
    x = one.withColumn("lead", F.lead("token").over(Window.partitionBy("stay_id", "hour_no").orderBy("pos"))) \
        .withColumn("lag", F.lag("token").over(Window.partitionBy("stay_id", "hour_no").orderBy("pos")))
    assert x.where("lead IS NOT NULL AND lead != next1 OR lag IS NOT NULL AND lag != prev1").count() == 0


def test_no_shuffle_of_a_saved_table_stays_on_disk(spark):
    """What a table's writing shuffled goes with its writing, and the ordered events with the stream."""
    def shuffled():
        it = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while it.hasNext():
            names.add(it.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    ws = Workspace(spark, SF, "lineitem")
    conf = {k: spark.conf.get(k, None) for k in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.maxConcurrentOutputFileWriters")}
    ws.raw_only
    df = ws.raw_only.repartition(3, "stay_id").groupBy("item").agg(F.count("*").alias("n"))
    before = shuffled()
    saved = ws._save(df, "counts")
    for _ in range(100):  # files go soon after
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert conf == {k: spark.conf.get(k, None) for k in conf}
    assert saved.exceptAll(df).count() == 0 and saved.count() == df.count()
    assert wrong_of_lineitem(ws.tokens) == 0
    tables = {p.name for p in pathlib.Path(ws.folder.removeprefix("file:")).iterdir()}
    assert "stream" in tables and "ordered" not in tables
    ws.close()


def wrong_of_lineitem(t):
    w = Window.partitionBy("stay_id").orderBy("pos")
    d = t.select("pos", (F.row_number().over(w) - 1).alias("rn"), *[c for k in (1, 2) for c in (
        f"next{k}", f"prev{k}", F.lead("token", k).over(w).alias(f"n{k}"), F.lag("token", k).over(w).alias(f"p{k}"))])
    bad = F.col("pos") != F.col("rn")
    for k in (1, 2):
        bad = bad | ~F.col(f"next{k}").eqNullSafe(F.col(f"n{k}")) | ~F.col(f"prev{k}").eqNullSafe(F.col(f"p{k}"))
    return d.where(bad).count()
