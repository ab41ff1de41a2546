"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
TRAINED_OR_STREAMED = {n for n in QUERIES if n[:3] in ("m01", "m02", "m03", "r01", "r02")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED_OR_STREAMED))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert word not in plan


@pytest.mark.parametrize("name", ["a05_mean_frequency_per_id", "a14_byte_patterns", "w02_delta_id", "w04_rolling_id_frequency",
                                  "w08_first_attack_windows", "w12_attack_segments", "d03_stratified_frame_split", "a22_roc_auc"])
def test_windows_run_over_blocks_not_sessions_or_classes(spark, sf_dir, name):
    """Frame-level windows are keyed by a block or a partition; count tables may be keyed by group alone."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for line in plan.splitlines():
        if not re.search(r"\bWindow \[", line):
            continue
        keys = re.findall(r"\[([^\[\]]*)\]", line)[-2]
        if re.search(r"session_id|Class", keys) and not re.search(r"block|part|Arbitration_ID", keys):
            raise AssertionError(f"window over {keys}")


@pytest.mark.parametrize("name,columns", [
    ("a06_frames_per_id", {"props"}), ("p12_binary_labels", {"ts", "user_id"}), ("a01_class_distribution", {"ts"}), ("t05_arg_max", {"vec_id", "embedding"}),
])
def test_scans_read_only_what_they_need(spark, sf_dir, name, columns):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert {field.split(":")[0] for field in re.split(r",(?![^<]*>)", schema)} == columns


@pytest.mark.parametrize("name", ["w01_deltatime", "w04_rolling_id_frequency", "f05_flattened_windows", "f11_masked_sequences", "w09_last_frame_windows"])
def test_one_exchange_of_frames(spark, sf_dir, name):
    assert plan_of(QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_label_windows_aggregate_by_hash(spark, sf_dir):
    assert "SortAggregate" not in plan_of(QUERIES["w08_first_attack_windows"](spark, sf_dir))


@pytest.mark.parametrize("name", ["f15_five_features_fixed", "f15_five_features_session_max", "w06_bus_load_session_max",
                                  "d11_heterogeneous_windows", "d14_frames_shared_by_splits", "j02_materialised_windows"])
def test_frames_move_once_by_block(spark, sf_dir, name):
    """One exchange by (session, block); no frame is copied to the windows that hold it before it."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert len(re.findall(r"Exchange hashpartitioning\(session_id#\d+, block#\d+L?, ", plan)) == 1
    assert not re.search(r"Exchange hashpartitioning\(session_id#\d+, (pos|row_id)#", plan)


def test_exchanged_rows_stay_below_frames_and_windows(spark, sf_dir):
    """Rows written to shuffles by the audits of overlapping windows, counted by Spark."""
    frames = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    windows = QUERIES["w08_first_attack_windows"](spark, sf_dir).count()
    for name in ("j02_materialised_windows", "d11_heterogeneous_windows", "d14_frames_shared_by_splits"):
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        written = exchanged(df._jdf.queryExecution().executedPlan())
        assert written and max(written) <= frames + windows, (name, written)


def exchanged(plan):
    """Rows written by each exchange of an executed plan."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found
