import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import normalize
from eventide.llm import chat, oracle, registry

SF = "/root/testdata/sf0.001"
COLS = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = {}
    for cid in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == cid))
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[cid] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.report(df).collect()}


def test_round_trip_of_control_strings(spark):
    rng = random.Random(5)
    bits = [*chat.TEMPLATE.controls, "<", ">", "[", "]", "\\", "|", "s>", "/s>", "INST]", "\n", "$1", "😀", " a "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|end|>", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))))
            for c in range(60) for t in range(rng.randint(1, 8))]
    got = chat.format_conversations(spark.createDataFrame(rows, COLS))
    assert digests(got) == brute(rows)
    for r in got.collect():  # no control string but the template's own at its own places
        rest = r.formatted
        for c in (chat.TEMPLATE.start, chat.TEMPLATE.message, chat.TEMPLATE.part, chat.TEMPLATE.end):
            rest = rest.replace(c, "\0")
        assert not any(c in rest for c in chat.TEMPLATE.reserved)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, "first"), (1, 1, "assistant", "tie"),
            (None, 0, "assistant", ""), (None, None, None, None), (2, 0, "assistant", "y" * 60_000)]
    df = spark.createDataFrame(rows, COLS).withColumn("turns", F.lit("x")).withColumn("loss", F.lit(1))
    got = chat.format_conversations(df)
    assert digests(got) == brute(rows)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_same_role_is_one_run(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    r = chat.format_conversations(spark.createDataFrame(rows, COLS)).first()
    assert r.formatted == "<|start|>user<|message|>a<|part|>b<|end|><|start|>assistant<|message|>c<|end|>"
    assert [r.formatted[s.start:s.end] for s in r.loss] == ["c"]


@pytest.mark.parametrize("sf", [SF])
def test_query_against_sql(spark, sf):
    got = registry.op1_chat_format(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    assert normalize(got) == normalize(con.execute(oracle.ORACLE["op1_chat_format"]).df())


def test_native_plan(spark):
    plan = registry.op1_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
