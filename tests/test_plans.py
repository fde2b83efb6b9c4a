"""What the physical plans must and must not contain."""

import os
import re

import pytest
from helpers import container, pod, pods, rows

from fleetfold.operators import state as ST
from fleetfold.sources.scratch import materialize

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

NATIVE = [
    "classify_state", "exit_record", "status_report", "select_labels", "select_many_apps", "latest_state",
    "latest_document", "fold_state", "unacked", "split_known", "profile_status", "missing_members", "jobs_to_delete",
    "ownership", "ids_except", "registration_ready", "lifecycle_events", "first_terminal", "merge_labels_executor",
    "resolve_conf", "check_options", "effective_settings", "size_executor", "derive_names", "parse_volumes",
    "duplicate_mounts", "group_values", "pi_estimate", "word_count", "index_within",
]
SALTED = ["fold_state", "missing_members", "ownership", "select_many_apps", "merge_labels_executor", "pack_by_budget",
          "trim_excess", "request_plan", "entity_by_job", "last_snapshot", "size_executor"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_stay_in_the_engine(spark, name):
    from fleetfold.plans.catalog import load

    plan = plan_of(load()[name].run(spark, SF))
    assert not re.search(r"Python|Pandas|Arrow", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@needs_tables
@pytest.mark.parametrize("name", SALTED)
def test_salted_joins_give_the_same_rows(spark, name):
    from fleetfold.plans.catalog import load

    run = load()[name].run
    df = run(spark, SF)
    want = rows(df, *df.columns)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows(run(spark, SF), *df.columns) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_only_the_needed_container_fields_are_read(spark):
    stored = materialize(pods(spark, pod(1, containers=[container(exit_code=0)])), "docs")
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    try:
        spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
        plan = plan_of(ST.latest_members(stored))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    read = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "containers:array<struct<name:string,terminated:struct<exit_code:int>>>" in read
    assert "labels" not in read and "message" not in read


def test_filters_on_promoted_columns_reach_the_files(spark):
    stored = materialize(pods(spark, pod(1), pod(2, app="b")), "docs")
    plan = plan_of(ST.classify_state(stored.filter("app_id = 'b'")).select("exec_id", "state"))
    assert "EqualTo(app_id,b)" in plan
