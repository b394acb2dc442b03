"""Plan-shape checks over every registered query (planning only)."""

import pytest

from eventide.plans.registry import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans a {op}"


def test_token_scans_prune_and_push(spark):
    df = QUERIES["lab_examples"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans
    for line in scans:
        if "pos#" not in line.split("]")[0]:
            continue
        assert "In(token, [lab.click,lab.view])" in line
        read = line[line.index("FileScan parquet [") + 18:].split("]")[0]
        assert sorted(c.split("#")[0] for c in read.split(",")) == ["pos", "stay_id", "testset", "token"]


TEST_ONLY = ["lab_examples", "value_at_next", "one_hot_labels", "culture_examples", "tail_block", "padded_block", "history_bag",
             "dose_examples", "dose_prompt", "dose_histogram", "last_lab_before_cut", "counterfactual_prompt", "head_nonpad",
             "hour_horizon", "shift_context", "decoded_heads", "batch_scorer", "response_splice"]


@pytest.mark.parametrize("name", TEST_ONLY)
def test_test_cohorts_read_the_test_partition(spark, name):
    """Every scan of the stream is pruned to the folder of the test stays."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "token#" in x.split("]")[0] and "pos#" in x.split("]")[0]]
    assert scans
    for x in scans:
        assert "PartitionFilters: [" in x and "testset#" in x.split("PartitionFilters: [")[1].split("]")[0], x


@pytest.mark.parametrize("name, most", [("inject_error", 4), ("pre_post_delta", 4), ("dose_prompt", 4), ("dose_histogram", 4),
                                        ("magnitude_model", 4), ("last_lab_before_cut", 4)])
def test_few_scans_of_the_stream(spark, name, most):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.write.format("noop").mode("overwrite").save()
    q = df.collect() is not None and df._jdf.queryExecution().executedPlan().toString()
    final = q.split("== Initial Plan ==")[0]
    scans = [x for x in final.splitlines() if "FileScan parquet" in x and "token#" in x.split("]")[0] and "pos#" in x.split("]")[0]]
    assert 0 < len(scans) <= most


def test_without_automatic_broadcast_the_same_rows_come_by_shuffle(spark):
    """No hint forces a data-sized table into every task."""
    def rows():
        df = QUERIES["next_token_probs"](spark, "/root/testdata/sf0.001")
        return df, sorted(map(tuple, df.collect()), key=str)

    _, want = rows()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df, got = rows()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert got == want and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        if adaptive is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", adaptive)
