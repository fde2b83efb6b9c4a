"""The allocator scenarios, cycle by cycle, with tables carried between cycles.

Every scenario is an app of its own and all apps go through each cycle together, so
the scenarios also show that one app's result does not depend on the others.
"""

from helpers import rows
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators import reconcile as R

STATE = "app_id string, exec_id bigint, profile_id int, state string, start_ms bigint"
TIMEOUT, IDLE = 600_000, 60_000


def step(targets, state=(), registered=(), now=0, **want):
    """``state``: (exec_id, state[, start_ms[, profile]]); the rest is expected output."""
    if not isinstance(targets, dict):
        targets = {0: targets}
    return dict(targets=targets, state=list(state), registered=list(registered), now=now, want=want)


def run(spark, scenarios, **options):
    """Run the n-th step of every scenario in the n-th cycle; yields app and outcome."""
    df = spark.createDataFrame
    carried = dict(ledger=[], known=[], deleted=[])
    last = {}
    for n in range(max(map(len, scenarios.values()))):
        steps = {a: s[n] for a, s in scenarios.items() if n < len(s)}
        full = [
            (a, s[0], s[3] if len(s) > 3 else 0, s[1], s[2] if len(s) > 2 else 0)
            for a, st in steps.items() for s in st["state"]
        ]
        now = F.lit(0)
        for a, st in steps.items():
            now = F.when(F.col("app_id") == a, st["now"]).otherwise(now)
        mine = {k: [r for r in v if r[0] in steps] for k, v in carried.items()}
        plan = R.reconcile(
            df(full, STATE),
            df([(a, p, t) for a, st in steps.items() for p, t in st["targets"].items()], S.TARGETS),
            df(mine["ledger"], S.LEDGER),
            df([(a, i, 0) for a, st in steps.items() for i in st["registered"]], S.REGISTRATIONS),
            now.cast("bigint"),
            known_ledger=df(mine["known"], "app_id string, exec_id bigint, profile_id int"),
            deleted=df(mine["deleted"], "app_id string, exec_id bigint"),
            last_ids=df(list(last.items()), "app_id string, last_id bigint"),
            idle_ms=IDLE, **options,
        )
        got = {a: {"request": [], "delete": [], "time_out": []} for a in steps}
        for r in plan.decisions().collect():
            got[r.app_id][r.decision].append(r.exec_id)
        for r in plan.outstanding.collect():
            got[r.app_id]["outstanding"] = r.outstanding
        carried["ledger"] = [tuple(r) for r in plan.ledger.select("app_id", "exec_id", "profile_id", "created_ms").collect()]
        carried["known"] = [tuple(r) for r in plan.known_ledger.collect()]
        carried["deleted"] = [tuple(r) for r in plan.deleted.collect()]
        for a, st in steps.items():
            out = {k: sorted(v) if isinstance(v, list) else v for k, v in got[a].items()}
            out["deleted_after"] = sorted(r[1] for r in carried["deleted"] if r[0] == a)
            last[a] = max([last.get(a, 0), *out["request"]])
            want = {"request": [], "delete": [], "time_out": [], **st["want"]}
            assert {k: out[k] for k in want} == want, (a, n)
    return carried


def running(*ids):
    return [(i, "running") for i in ids]


PROFILE_OF = {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}


def by_profile(failed=(), ids=range(1, 8)):
    return [(i, "failed" if i in failed else "running", 0, PROFILE_OF[i]) for i in ids]


SCENARIOS = {
    "first batch, then the rest": [
        step(6, request=[1, 2, 3, 4, 5], outstanding=5),
        step(6, running(1, 2, 3, 4), outstanding=1),
        step(6, running(1, 2, 3, 4, 5), request=[6], outstanding=1),
    ],
    "a failed member is replaced": [
        step(5, request=[1, 2, 3, 4, 5]),
        step(5, running(1, 2, 3, 4) + [(5, "failed")], request=[6], outstanding=1),
    ],
    "a request times out, strictly": [
        step(1, request=[1]),
        step(1, now=TIMEOUT, outstanding=1),
        step(1, now=TIMEOUT + 1, request=[2], time_out=[1], outstanding=1),
    ],
    "scale up, then down": [
        step(1, request=[1]),
        step(1, running(1), outstanding=0),
        step(4, running(1), request=[2, 3, 4], outstanding=3),
        step(1, running(1, 2) + [(3, "pending", 0)], now=2 * IDLE, delete=[3, 4], outstanding=0, deleted_after=[3, 4]),
        step(1, running(1, 2), now=2 * IDLE, outstanding=0, deleted_after=[]),
    ],
    "idle protection is strict": [
        step(1, request=[1]),
        step(1, [(1, "pending", 0)], outstanding=1),
        step(2, [(1, "pending", 0)], now=IDLE, request=[2], outstanding=2),
        step(1, [(1, "pending", 0)], now=IDLE, outstanding=2),
        step(1, [(1, "pending", 0)], now=IDLE + 1, delete=[1], outstanding=1),
    ],
    "registered requests are not trimmed": [
        step(5, request=[1, 2, 3, 4, 5]),
        step(5, [(1, "pending", 0), (2, "pending", 0)], outstanding=5),
        step(0, [(1, "pending", 0), (2, "pending", 0)], now=IDLE, outstanding=5),
        step(0, [(1, "pending", 0), (2, "pending", 0)], registered=[1, 3, 4], now=2 * IDLE + 1,
             delete=[2, 5], outstanding=0),
    ],
    "a missing start time counts as idle": [
        step(0, [(1, "pending", None)], now=5, delete=[1], outstanding=0),
    ],
    "two profiles": [
        step({0: 3, 1: 4}, request=[1, 2, 3, 4, 5, 6, 7], outstanding=7),
        step({0: 3, 1: 4}, by_profile(ids=[1, 4]), registered=[1, 4], outstanding=5),
        step({0: 3, 1: 4}, by_profile(), registered=range(1, 8), outstanding=0),
        step({0: 3, 1: 4}, by_profile(failed=[3, 7]), registered=[1, 2, 4, 5, 6], request=[8, 9], outstanding=2),
    ],
    "profiles grow and shrink": [
        step({0: 1, 1: 2}, request=[1, 2, 3], outstanding=3),
        step({0: 1, 1: 2}, [(1, "running", 0, 0), (2, "running", 0, 1), (3, "running", 0, 1)], outstanding=0),
        step({0: 4, 1: 3}, [(1, "running", 0, 0), (2, "running", 0, 1), (3, "running", 0, 1)],
             request=[4, 5, 6, 7], outstanding=4),
        step({0: 1, 1: 1}, [(1, "running", 0, 0), (2, "running", 0, 1), (3, "running", 0, 1), (4, "running", 0, 0),
                            (5, "pending", 0, 0), (6, "pending", 0, 0)], now=IDLE + 1,
             delete=[5, 6, 7], outstanding=0),
    ],
    "requests wait for an unacknowledged one": [
        step(6, [(1, "pending", 0)] + running(2, 3, 4, 5), request=[1], outstanding=2),
    ],
    "terminating and unknown are not counted": [
        step(2, [(1, "terminating"), (2, "unknown")], request=[1, 2]),
    ],
}


def test_scenarios(spark):
    run(spark, SCENARIOS)


def test_batch_mode_ignores_the_batch_size(spark):
    run(spark, {"a": [step(25_003, request=list(range(1, 25_004)), outstanding=25_003)]}, batch_mode=True)


def test_single_profile_fast_path(spark):
    state = [(1, "running", 0, 7)]
    run(spark, {"zero": [step({0: 1}, state)], "seven": [step({7: 1}, state, request=[1])]},
        single_profile_fast_path=True)


def test_deleted_ids_are_kept_without_snapshots(spark):
    carried = run(spark, {"a": [step(0, [(9, "pending", None)], now=5, delete=[9]), step(0)]}, has_snapshots=False)
    assert carried["deleted"] == [("a", 9)]


def test_one_large_profile_is_ranked_exactly(spark):
    n = 20_000
    state = spark.range(n).select(
        F.lit("a").alias("app_id"), F.col("id").alias("exec_id"), F.lit(0).alias("profile_id"),
        F.lit("pending").alias("state"), (F.col("id") * 7919 % n * 1000).alias("start_ms"))
    none = spark.createDataFrame([], S.LEDGER)
    plan = R.reconcile(
        state, spark.createDataFrame([("a", 0, 12_345)], S.TARGETS), none,
        spark.createDataFrame([], S.REGISTRATIONS), F.lit(n * 1000 + IDLE + 1).cast("bigint"), idle_ms=IDLE)
    want = sorted(range(n), key=lambda i: (i * 7919 % n, i))[: n - 12_345]
    assert sorted(r.exec_id for r in plan.trimmed.collect()) == sorted(want)


def test_jobs_and_forced_kills(spark):
    df = spark.createDataFrame
    ids = "app_id string, exec_id bigint"
    jobs = df([("a", 1, "j1"), ("a", 2, "j2"), ("a", 3, "j3")], ids + ", job_name string")
    got = R.jobs_to_delete(df([("a", 1), ("a", 2)], ids), df([("a", 2), ("a", 3)], ids), jobs)
    assert rows(got, "job_name") == [("j2",)]
    asked = df([("a", 1, 0), ("a", 2, 0), ("a", 3, 9_000)], ids + ", requested_ms bigint")
    state = df([("a", 1, 0, "running", 0), ("a", 2, 0, "succeeded", 0), ("a", 3, 0, "running", 0)], STATE)
    assert rows(R.force_kill_set(asked, state, F.lit(10_000)), "exec_id") == [(1,)]


def test_registration_ready(spark):
    df = spark.createDataFrame
    reg = df([("a", i, 0) for i in range(4)] + [("b", i, 0) for i in range(3)], S.REGISTRATIONS)
    initial = df([("a", 5), ("b", 5), ("c", 0)], "app_id string, initial bigint")
    assert rows(R.registration_ready(reg, initial), "app_id", "ready") == [("a", True), ("b", False), ("c", True)]
