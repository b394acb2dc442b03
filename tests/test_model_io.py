"""Model versions survive a save / load round trip, only better ones are kept,
and the driver's flagship entry point runs."""

import uuid

import pytest

from eventide.session import ensure_checkpoint_dir
from eventide.sources.model_io import ModelStore


@pytest.fixture
def store(spark):
    return ModelStore(spark, f"{ensure_checkpoint_dir(spark)}/eventide-test-model-{uuid.uuid4().hex}")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_model_roundtrip(ws, store):
    m = ws.model
    store.publish(store.write({"ngram": m.long()}), ("ngram",), 1.5, {"order": 2, "alpha": 1.0}, {"step": 0})
    tables, v = store.load()
    assert (v.number, v.loss, v.config, v.meta) == (1, 1.5, {"order": 2, "alpha": 1.0}, {"step": 0})
    assert same(m.long(), tables["ngram"])


def test_only_a_better_version_is_kept_and_each_can_be_loaded(spark, store):
    saved = [store.save_if_better({"t": spark.range(k)}, loss, {}, {"k": k}) for k, loss in ((1, 3.0), (2, 3.0), (3, 2.0), (4, 2.5), (5, 1.0))]
    assert [v and v.number for v in saved] == [1, None, 2, None, 3]
    assert [v.loss for v in store.versions()] == [3.0, 2.0, 1.0]
    assert [store.load(n)[0]["t"].count() for n in (1, 2, 3)] == [1, 3, 5] and store.load()[1].number == 3
    store.keep_last(1)
    assert [v.number for v in store.versions()] == [3] and store.load()[0]["t"].count() == 5
    with pytest.raises(LookupError):
        store.load(1)


def test_a_write_that_stops_half_way_leaves_the_old_version(spark, store):
    store.save_if_better({"t": spark.range(7)}, 1.0, {}, {})
    store.write({"t": spark.range(3)})  # written, never published
    broken = spark.range(3).selectExpr("CASE WHEN id = 2 THEN raise_error('stopped') ELSE id END AS id")
    with pytest.raises(Exception):
        store.save_if_better({"t": broken}, 0.5, {}, {})
    assert [v.number for v in store.versions()] == [1] and store.load()[0]["t"].count() == 7
    assert store.save_if_better({"t": spark.range(2)}, 0.5, {}, {}).number == 2


def test_an_empty_store_has_nothing_to_load(store):
    assert store.versions() == []
    with pytest.raises(LookupError):
        store.load()


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["target", "metric", "value"]
    assert len(rows) > 0


def test_report_sink(spark, ws):
    from eventide.plans.lab_eval import lab_panel
    from eventide.sources.report import report, write_report
    path = f"{ensure_checkpoint_dir(spark)}/eventide-test-report-{uuid.uuid4().hex}"
    r = report(lab_panel(ws))
    write_report(r, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, r.collect()))


def test_batch_hook(spark, ws):
    """The hook for a model from outside gives what the built-in score gives."""
    from pyspark.sql import functions as F

    from eventide.operators import batch, blocks
    from eventide.plans import params as P
    top = ws.vocab.where(F.col("token") == P.HIGH).first().token_id
    tb = blocks.training_blocks(ws.test_tokens, P.BLOCK)
    got = batch.batch_score(tb, ["stay_id", "b"], "x", batch.share_scorer([top])).collect()
    want = {(r.stay_id, r.b): sum(t == top for t in r.x) / sum(t != 0 for t in r.x) for r in tb.collect()}
    assert {(r.stay_id, r.b): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
