import random

import pytest
from helpers import MAIN, SIDE, container, pod, pods, rows
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.functions import pods as P
from fleetfold.operators import report as Q
from fleetfold.operators import state as ST
from fleetfold.streaming import fold as SF

CASES = [
    # document, state, state when all containers are checked
    (dict(phase="Pending"), "pending", "pending"),
    (dict(phase="Running", containers=[container(running=True)]), "running", "running"),
    (dict(phase="Running", containers=[container("x", exit_code=1), container(running=True)]), "running", "failed"),
    (dict(phase="Running", restart_policy="Always",
          containers=[container("x", exit_code=1), container(running=True)]), "running", "running"),
    (dict(phase="Succeeded"), "succeeded", "succeeded"),
    (dict(phase="Failed"), "failed", "failed"),
    (dict(phase=None, deletion_ts="now", containers=None), "deleted", "deleted"),
    (dict(phase="Failed", deletion_ts="now"), "deleted", "deleted"),
    (dict(phase="odd"), "unknown", "unknown"),
    (dict(phase="Running", containers=[container(exit_code=0), container(SIDE, running=True)]), "succeeded", "succeeded"),
    (dict(phase="Running", containers=[container(exit_code=1), container(SIDE, running=True)]), "failed", "failed"),
    (dict(phase="Running", deletion_ts="now"), "running", "running"),
    (dict(phase="Terminating", deletion_ts="now"), "terminating", "terminating"),
    (dict(phase="Running", containers=None), "running", "running"),
]


def test_classify_state(spark):
    df = pods(spark, *[pod(i, **c) for i, (c, _, _) in enumerate(CASES)])
    plain = dict(rows(ST.classify_state(df), "exec_id", "state"))
    every = dict(rows(ST.classify_state(df, check_all=True), "exec_id", "state"))
    assert [plain[i] for i in range(len(CASES))] == [c[1] for c in CASES]
    assert [every[i] for i in range(len(CASES))] == [c[2] for c in CASES]
    final = dict(rows(ST.classify_state(df), "state", "is_final"))
    assert {s for s, f in final.items() if f} == set(S.FINAL_STATES)


def test_exit_code_takes_first_terminated_of_any_name(spark):
    df = pods(
        spark,
        pod(1, containers=[container(SIDE, running=True), container("x", exit_code=7), container(exit_code=0)]),
        pod(2, containers=[container(running=True)]),
        pod(3, containers=None),
    )
    assert rows(df.select("exec_id", P.exit_code().alias("c")), "exec_id", "c") == [(1, 7), (2, -1), (3, -1)]


def test_upsert_and_replace(spark):
    changes = pods(spark, pod(0, "Pending", seq=1), pod(1, "Running", seq=2), pod(1, "Succeeded", seq=3), pod(2, "Pending", seq=4))
    none = changes.limit(0)
    assert rows(ST.fold_state(changes, none), "exec_id", "state", "full_sync_ts") == [
        (0, "pending", 0), (1, "succeeded", 0), (2, "pending", 0)]
    listing = pods(spark, pod(2, "Running", seq=5, sync_ts=100))
    assert rows(ST.fold_state(changes, listing), "exec_id", "state", "full_sync_ts") == [(2, "running", 100)]
    later = changes.unionByName(pods(spark, pod(9, "Pending", seq=6)))
    assert rows(ST.fold_state(later, listing), "exec_id", "full_sync_ts") == [(2, 100), (9, 100)]


def test_empty_listing_clears_the_app(spark):
    changes = pods(spark, pod(1, "Running", seq=1), pod(1, "Running", app="b", seq=1))
    syncs = spark.createDataFrame([("a", 50, 2)], S.SYNCS)
    assert rows(ST.fold_state(changes, changes.limit(0), syncs), "app_id", "exec_id") == [("b", 1)]


def test_fold_ignores_row_order_other_apps_and_replays(spark):
    rng = random.Random(1)
    docs = [
        pod(rng.randrange(6), rng.choice(["Pending", "Running", "Failed"]), app=rng.choice("ab"), seq=i)
        for i in range(60)
    ]
    for i in (20, 45):
        docs[i] = pod(3, "Running", app="a", seq=i, sync_ts=i * 10)
    columns = ("app_id", "exec_id", "state", "seq", "full_sync_ts")

    def fold(some):
        df = pods(spark, *some)
        return ST.fold_state(df.filter("sync_ts is null"), df.filter("sync_ts is not null"))

    want = rows(fold(docs), *columns)
    rng.shuffle(docs)
    assert rows(fold(docs), *columns) == want
    assert rows(fold(docs + docs[:10]), *columns) == want
    assert rows(fold([x for x in docs if x["app_id"] == "a"]), *columns) == [r for r in want if r[0] == "a"]
    # the streaming form decides membership the same way
    flat = SF.fold_flat(SF.flatten(pods(spark, *docs)))
    assert rows(SF.present(flat), *columns) == want


def test_latest_state_prefers_arrival_over_time(spark):
    df = pods(spark, pod(1, "Running", seq=1, ts_ms=50), pod(1, "Pending", seq=2, ts_ms=10))
    assert rows(ST.latest_state(df, ["phase"]), "phase") == [("Pending",)]
    assert rows(ST.latest_state(df, ["phase"], order_by="event_time"), "phase") == [("Running",)]


def test_narrow_latest_state_is_hash_aggregated(spark):
    plan = ST.latest_members(pods(spark, pod()))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "ObjectHashAggregate" not in plan and "Python" not in plan


def test_last_snapshot(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 2, 2), ("b", 5, 1)], "app_id string, exec_id long, snapshot_no int")
    current, seen = ST.last_snapshot(df)
    assert rows(current, "app_id", "exec_id") == [("a", 2), ("b", 5)]
    assert rows(seen, "app_id", "exec_id") == [("a", 1), ("a", 2), ("b", 5)]


def test_resolve_entity(spark):
    bad = pod(2)
    bad["labels"] = {S.ID_LABEL: "x2"}
    df = pods(spark, pod(1), bad)
    assert rows(ST.resolve_entity(df), "exec_id", "error") == [(1, None), (None, "no member id for x2")]
    with pytest.raises(Exception, match="no member id for x2"):
        ST.resolve_entity(df, strict=True).collect()
    named = pod(1)
    named["labels"] = {"job": "j-7"}
    jobs = spark.createDataFrame([("a", "j-7", 7)], "app_id string, job_name string, exec_id long")
    assert rows(ST.resolve_entity(pods(spark, named), jobs, "job"), "exec_id") == [(7,)]


def test_split_main_container(spark):
    df = pods(
        spark,
        pod(1, containers=[container("x"), container(MAIN), container("y")]),
        pod(2, containers=[container("x"), container("y")]),
        pod(3, containers=[container(MAIN), container(MAIN)]),
        pod(4, containers=[]),
    )
    out = ST.split_main_container(df, MAIN).select(
        "exec_id", F.col("main.name").alias("m"), F.col("sidecars.name").alias("s"), "fell_back")
    assert {r[0]: (r[1], r[2], r[3]) for r in out.collect()} == {
        1: (MAIN, ["x", "y"], False), 2: ("x", ["y"], True), 3: (MAIN, [MAIN], True), 4: (None, [], True)}


def test_is_ready(spark):
    df = pods(
        spark,
        pod(1, conditions=[("Other", "True"), ("Ready", "True"), ("Ready", "False")]),
        pod(2, conditions=[("Ready", "False")]), pod(3, conditions=[]), pod(4),
    )
    assert rows(ST.is_ready(df), "exec_id", "ready") == [(1, True), (2, False), (3, False), (4, False)]


def test_status_report_prints_na(spark):
    df = pods(spark, pod(1, "Running", namespace="", node_name=None, containers=[container(running=True)]))
    text = Q.status_report(df).first()["report"]
    assert "\n\t namespace: N/A" in text and "\n\t node name: N/A" in text
    assert "\n\t phase: Running" in text and "\n\t\t container state: running" in text


def test_select_apps(spark):
    def driver(name, ns="default", role=S.DRIVER_ROLE):
        return pod(1, name=name, namespace=ns, labels={S.ROLE_LABEL: role}, uid=name + ns)

    df = pods(spark, driver("etl-1-driver"), driver("etl-2-driver", "prod"), driver("web-driver"),
              driver("etl-exec", role=S.EXECUTOR_ROLE))
    ids = ["etl-*", "prod:etl-*", "web-driver", "prod:web-driver", "etl-exec", "*", "nope", "nope*", "a:b:c"]
    want = {
        "etl-*": ["etl-1-driver", "etl-2-driver"], "prod:etl-*": ["etl-2-driver"], "web-driver": ["web-driver"],
        "etl-exec": ["etl-exec"], "*": ["etl-1-driver", "etl-2-driver", "web-driver"],
    }
    for i in ids:
        assert [r[0] for r in rows(Q.select_apps(df, i), "name")] == want.get(i, [])
    many = Q.select_many_apps(df, spark.createDataFrame([(i,) for i in ids], "submission_id string"))
    assert rows(many, "submission_id", "name") == sorted((i, n) for i, ns in want.items() for n in ns)
    lines = dict(rows(Q.status_rows(spark.createDataFrame([("nope",), ("nope*",)], "submission_id string"), df), "submission_id", "line"))
    assert lines == {"nope": "Application not found.", "nope*": "No applications found."}


def test_select_labels_keeps_rows_without_the_label(spark):
    off = pod(2)
    off["labels"] = {**off["labels"], S.INACTIVE_LABEL: "true"}
    df = pods(spark, pod(1), off)
    assert rows(Q.select_labels(df, not_={S.INACTIVE_LABEL: "true"}), "exec_id") == [(1,)]
