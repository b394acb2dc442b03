import importlib
import sys

import corpus_pipeline
from eventide.llm import decontaminate, line_dedup, quality, simhash

from test_decontaminate import brute as brute_hits
from test_line_dedup import LOWER, SPACE
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    owner, out = {}, []
    for i, t in sorted(rows):
        for x in t.split("\n"):
            owner.setdefault(x.strip(SPACE).translate(LOWER), i)
    for i, t in rows:
        out.append((i, "\n".join(x for x in t.split("\n") if len(k := x.strip(SPACE).translate(LOWER)) < 10 or owner[k] == i)))
    return out


def test_against_brute_force(spark, real, labels):
    """Stages 2 to 4 by brute force over what the classifier keeps; the last
    stage only drops rows of no copy."""
    docs = real[0]
    kept = {r.doc_id for r in quality.classify(docs).where("kept").collect()}
    rows = brute_lines([(i, t) for i, t, _ in real[1] if i in kept])
    root = brute_components([brute_fp(t) for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, root):
        least[c] = min(least.get(c, i), i)
    rows = [(i, t) for i, t in rows if i in set(least.values())]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {int(r[0]) for r in brute_hits(rows, items) if r[5]}
    want = {i: t for i, t in rows if i not in hit}
    out = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.saved(stage(spark, df, SF), name)
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    assert {r.doc_id: r.text for r in df.collect()} == want
    final = corpus_pipeline.run(spark, SF)
    assert final.columns == [*docs.columns, "rate", "copies", "residual"]
    out = {r.doc_id: r for r in final.collect()}
    assert all(want[i] == r.text and r.copies >= 1 and r.n_chars == len(r.text) for i, r in out.items())
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()} & set(want)
    assert len(good & set(out)) > 0.95 * len(good)


def test_stages_on_odd_rows(spark, make_docs, odd, stored):
    """Each stage alone, written as Parquet: clashing columns, string ids, an empty table."""
    df = make_docs(odd, clash=True)
    strings = df.withColumn("doc_id", df["doc_id"].cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (df, strings):
            out = stored(stage(spark, docs, SF))
            assert out.columns[:len(df.columns)] == df.columns, name
            assert [t for _, t in out.dtypes[:len(df.columns)]] == [t for _, t in docs.dtypes]
        assert stage(spark, make_docs([]), SF).count() == 0


def test_all_stages_in_a_row_with_clashing_columns(spark, make_docs, odd, stored, text_maker):
    df = make_docs(odd + [(400 + i, ". ".join(text_maker(50 + 10 * i + k, 9) for k in range(12)) + ".") for i in range(30)], clash=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stored(stage(spark, df, SF))
    out = stored(corpus_pipeline.STAGES[-1][1](spark, df, SF))
    assert out.columns == [*df.columns, "rate_", "copies_", "residual_"] and out.count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry
    assert {"pipeline", "op1_chat_format", "op10_license_scan"} <= set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("eventide.llm")] + ["corpus_pipeline", "eventide.llm"]:
        monkeypatch.setitem(sys.modules, name, None)
    sys.modules.pop("__spark_entry__")
    bare = importlib.import_module("__spark_entry__")
    try:
        assert bare.queries() and not any(k.startswith("op") and "_" in k and k[2].isdigit() for k in bare.queries())
        assert "pipeline" not in bare.queries() and bare.oracle_sql()
    finally:
        sys.modules["__spark_entry__"] = entry


def test_no_silent_helpers():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_dedup", "benchmark_decontamination", "mixing"]
    assert (line_dedup.MIN_CHARS, simhash.SHINGLE, simhash.RADIUS, decontaminate.WINDOW) == (10, 3, 2, 10)
