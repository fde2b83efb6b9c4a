import random
import re

import numpy as np
import pandas as pd
from helpers import container, pod, pods, rows
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators import lifecycle as L

EVENTS = "app_id string, exec_id bigint, ts_ms bigint, seq bigint"


def brute(events, ttl, prior=None):
    kept, last = [], dict(prior or {})
    for app, ident, t, seq in sorted(events, key=lambda e: (e[2], e[3])):
        if (app, ident) not in last or t >= last[app, ident] + ttl:
            kept.append((app, ident, t, seq))
            last[app, ident] = t
    return sorted(kept)


def test_failed_member_is_removed_once_and_cleaned_up_again(spark):
    df = pods(spark, *[pod(1, "Failed", containers=[container(exit_code=1)], seq=i, ts_ms=i) for i in range(2)])
    events = L.lifecycle_events(df)
    assert rows(events, "seq", "exit_code", "by_app", "cleanup") == [(0, 1, True, "delete"), (1, 1, True, "delete")]
    assert rows(L.removal_once(events), "exec_id", "seq") == [(1, 0)]
    assert rows(L.lifecycle_events(df, keep_pods=True), "cleanup") == [("mark_inactive",)] * 2


def test_which_states_report_an_exit(spark):
    quiet = pod(6, "Failed")
    quiet["labels"] = {**quiet["labels"], S.INACTIVE_LABEL: "true"}
    df = pods(spark, pod(1, "Failed", deletion_ts="now"), pod(2, "Succeeded"), pod(3, "Terminating"),
              pod(4, "odd"), pod(5, "Running"), quiet)
    assert rows(L.lifecycle_events(df), "exec_id", "state", "by_app", "cleanup") == [
        (1, "deleted", False, None), (2, "succeeded", True, "delete")]
    text = dict(rows(L.lifecycle_events(df), "exec_id", "exit_message"))
    assert text[1] == "The executor with id 1 was deleted by a user or the framework."
    assert "exited with exit code -1" in text[2] and "brief reason: N/A" in text[2]


def test_removal_memory_counts_from_the_kept_event(spark):
    ttl = S.REMOVAL_TTL_MS
    events = [("a", 1, t, t) for t in (0, ttl // 2, ttl - 1, ttl, ttl + 5, 2 * ttl)]
    got = L.removal_once(spark.createDataFrame(events, EVENTS))
    assert rows(got, "ts_ms") == [(0,), (ttl,), (2 * ttl,)]


def test_removals_match_a_plain_loop_over_long_dense_histories(spark):
    rng = random.Random(7)
    ttl = 100
    span = 64 * ttl
    events = []
    for ident, step in ((1, 1), (2, 37), (3, 101), (4, 5000)):
        t = -3 * span
        while t < 9 * span and len(events) < 40_000:
            events.append(("a", ident, t, len(events)))
            t += rng.randint(1, 2 * step)
    # equal times, exact chunk edges, and a member with one event
    events += [("b", 1, span * i, 100_000 + i) for i in range(5)] * 1
    events += [("b", 1, span * i, 200_000 + i) for i in range(5)]
    events += [("b", 2, span * 3 - 1, 300_000), ("b", 2, span * 3 + ttl - 2, 300_001), ("b", 2, span * 3 + ttl - 1, 300_002)]
    df = spark.createDataFrame(pd.DataFrame(events, columns=["app_id", "exec_id", "ts_ms", "seq"]), EVENTS).repartition(7)
    got = rows(L.removal_once(df, ttl), "app_id", "exec_id", "ts_ms", "seq")
    assert got == sorted(brute(events, ttl), key=repr)
    # in two batches with the memory carried over
    cut = span + 17
    early = df.filter(df.ts_ms < cut)
    first = L.removal_once(early, ttl)
    second = L.removal_once(df.filter(df.ts_ms >= cut), ttl, L.last_removals(first))
    assert sorted(rows(first, *df.columns) + rows(second, *df.columns), key=repr) == got


def test_a_hot_member_spans_pieces_and_three_exchanges_do(spark):
    rng = random.Random(3)
    ttl = 50
    events, t = [], 0
    for i in range(60_000):
        t += rng.choice((0, 0, 1, 3, 40, 60)) if i % 9_000 < 8_000 else rng.choice((0, 1))
        events.append(("hot", 1, t, i))
    events += [("b", i % 40, i * 7 % 3000, 100_000 + i) for i in range(4000)]
    df = spark.createDataFrame(pd.DataFrame(events, columns=["app_id", "exec_id", "ts_ms", "seq"]), EVENTS).repartition(9)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "150")  # more pieces than one group of them
        out = L.removal_once(df, ttl)
        plan = out._jdf.queryExecution().executedPlan().toString()
        kinds = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line and "RoundRobin" not in line]
        assert len([k for k in kinds if "rangepartitioning" in k]) >= 1
        # the same exchange stands twice in the plan before it runs
        assert len({re.sub(r"#\d+L?", "", k.split("Exchange", 1)[1].split(", [plan_id")[0]) for k in kinds}) <= 3
        assert rows(out, "app_id", "exec_id", "ts_ms", "seq") == sorted(brute(events, ttl), key=repr)
        held = df.repartitionByRange(150, "app_id", "exec_id", "ts_ms", "seq").groupBy(F.spark_partition_id()).count()
        assert held.agg(F.max("count")).first()[0] < 5_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_maps_of_pieces_compose(spark):
    rng = random.Random(8)
    for _ in range(200):
        ttl = rng.choice((1, 5, 20))
        t = np.sort(np.array([rng.randrange(120) for _ in range(rng.randrange(3, 40))]))
        cuts = sorted(rng.sample(range(1, len(t)), 2))
        parts = [(*L._map_of(x, ttl), True, ("a", 1), ("a", 1)) for x in np.split(t, cuts)]
        left = L._compose(L._compose(parts[0], parts[1]), parts[2])
        right = L._compose(parts[0], L._compose(parts[1], parts[2]))
        for free in [L._FREE, *range(int(t[0]), int(t[0]) + ttl + 1)]:
            want = L._free_after(t, free, ttl)
            assert L._apply(left[0], left[1], free) == L._apply(right[0], right[1], free) == want


def test_missing_member_delta_is_strict(spark):
    df = spark.createDataFrame
    reg = df([("a", 1, 7), ("a", 2, 7), ("a", 3, 7), ("b", 1, 0)], S.REGISTRATIONS)
    state = df([("a", 2)], "app_id string, exec_id bigint")
    none = state.limit(0)
    gone = df([("a", 3)], "app_id string, exec_id bigint")

    def at(ts):
        return rows(L.missing_members(reg, state, df([("a", ts, 1)], S.SYNCS), none, gone), "app_id", "exec_id", "exit_code", "by_app")

    assert at(30_007) == []
    assert at(30_008) == [("a", 1, -1, False)]


def test_first_terminal(spark):
    df = spark.createDataFrame(
        [("a", 1, "MODIFIED", "Running"), ("a", 2, "MODIFIED", "Failed"), ("a", 3, "DELETED", "Failed"),
         ("b", 1, "ERROR", "Running"), ("c", 1, "MODIFIED", "succeeded"), ("d", 1, None, "Succeeded")],
        "app_id string, seq bigint, action string, phase string")
    assert rows(L.first_terminal(df), "app_id", "seq") == [("a", 2), ("b", 1), ("d", 1)]
    assert rows(L.first_terminal(df, "job"), "app_id", "seq") == [("a", 2), ("b", 1)]
    apps = spark.createDataFrame([("a",), ("c",), ("z",)], "app_id string")
    assert rows(L.app_status(apps, df), "app_id", "phase", "is_terminal") == [
        ("a", "Failed", True), ("c", "succeeded", False), ("z", "unknown", False)]


def test_ownership(spark):
    res = spark.createDataFrame(
        [("a", "claim", "r1", "u1", "o1"), ("a", "claim", "r2", "u2", "o2"), ("a", "claim", "r3", "u3", None)], S.OWNERS)
    owners = spark.createDataFrame([("o1", "d1"), ("o2", "d2")], "uid string, name string")
    gone = owners.filter("uid = 'o2'")
    assert rows(L.ownership(res, owners, gone), "name", "ownership") == [("r1", "owned"), ("r2", "cascade"), ("r3", "orphan")]
