"""State of streams: logs of changes, listings in parts, timers, late events."""

import os
import time

import pytest
from helpers import container, pod, pods, rows
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators import lifecycle as L
from fleetfold.operators import state as ST
from fleetfold.sources.log import TableLog, folders
from fleetfold.sources.scratch import scratch_dir
from fleetfold.streaming import fold as SF
from fleetfold.streaming import rounds as SR
from fleetfold.streaming import timers as TM


@pytest.fixture
def one_partition(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def put(spark, inbox, *docs):
    pods(spark, *docs).coalesce(1).write.mode("append").parquet(inbox)


def stream(spark, inbox, files=1):
    return spark.readStream.schema(S.POD).option("maxFilesPerTrigger", files).parquet(inbox)


DDL = "k string, n bigint"


def frame(spark, *values):
    return spark.createDataFrame(list(values), DDL)


def test_a_log_gives_the_table_before_and_after_each_batch(spark, one_partition):
    path = scratch_dir(spark, "log")
    log, table, before = TableLog(spark, path, DDL, ["k"], every=3), {}, {}
    for b in range(14):
        before[b] = dict(table)
        new = {f"k{b % 5}": b, "all": b}
        gone = [f"k{(b + 2) % 5}"] if b % 4 == 3 else []
        table.update(new)
        for k in gone:
            table.pop(k, None)
        log.append(frame(spark, *new.items()), b, spark.createDataFrame([(k,) for k in gone], "k string"))
        assert dict(rows(log.read(), "k", "n")) == table
        assert dict(rows(log.read(before=b), "k", "n")) == before[b]
        # two bases, and the changes behind the older one
        assert len(folders(spark, f"{path}/base", "v=")) <= 2 and len(folders(spark, f"{path}/changes", "batch=")) <= 7
    # the last batch comes again
    log.append(frame(spark, ("all", 99)), 13)
    assert dict(rows(log.read(before=13), "k", "n")) == before[13]


def test_an_interrupted_compaction_loses_nothing(spark, one_partition):
    path = scratch_dir(spark, "log")
    log = TableLog(spark, path, DDL, ["k"], every=4)
    for b in range(8):
        log.append(frame(spark, (f"k{b}", b)), b)
    want = dict(rows(log.read(), "k", "n"))
    newest = folders(spark, f"{path}/base", "v=")[-1]
    os.remove(f"{path.removeprefix('file:')}/base/v={newest}/_SUCCESS")
    assert folders(spark, f"{path}/base", "v=")[-1] < newest
    assert dict(rows(log.read(), "k", "n")) == want == {f"k{b}": b for b in range(8)}
    for b in range(8, 17):
        log.append(frame(spark, (f"k{b}", b)), b)
    assert dict(rows(log.read(), "k", "n")) == {f"k{b}": b for b in range(17)}
    assert newest not in folders(spark, f"{path}/base", "v=", complete=False)


def test_replace_writes_what_differs(spark, one_partition):
    path = scratch_dir(spark, "log")
    log = TableLog(spark, path, DDL, ["k"])
    log.replace(frame(spark, *[(f"k{i}", i) for i in range(50)], (None, 1)), 0)
    log.replace(frame(spark, *[(f"k{i}", 7 if i == 3 else i) for i in range(1, 50)], ("new", None), (None, 1)), 1)
    assert spark.read.parquet(f"{path}/changes/batch=1").count() == 3
    assert dict(rows(log.read(), "k", "n")) == {f"k{i}": 7 if i == 3 else i for i in range(1, 50)} | {"new": None, None: 1}


def test_bytes_of_a_round_stay_flat_and_folders_bounded(spark, one_partition):
    out = scratch_dir(spark, "flat")
    rounds = 50
    for r in range(rounds):
        put(spark, f"{out}/in", *[pod(r * 5 + i, "Running", seq=r * 5 + i) for i in range(5)])
    query = SF.start_fold(stream(spark, f"{out}/in"), f"{out}/state", f"{out}/progress", every=10)
    sizes = []
    query.awaitTermination()
    local = out.removeprefix("file:")
    for b in folders(spark, f"{out}/state/changes", "batch="):
        folder = f"{local}/state/changes/batch={b}"
        sizes.append(sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".parquet")))
    assert len(query.recentProgress) >= rounds and len(sizes) <= 20 and max(sizes) < 1.2 * min(sizes)
    assert SF.read_fold(spark, f"{out}/state").count() == 5 * rounds


def listing(spark, seq, ts, members, expected, app="a"):
    marker = pod(None, seq=seq, sync_ts=ts, app=app, listing_rows=expected)
    return marker, [pod(m, seq=seq, sync_ts=ts, app=app) for m in members]


def test_a_listing_over_four_files_reports_no_listed_member(spark, one_partition):
    out = scratch_dir(spark, "parts")
    reg = spark.createDataFrame([("a", i, 0) for i in range(1, 7)], S.REGISTRATIONS)
    none = reg.select("app_id", "exec_id").limit(0)
    marker, members = listing(spark, 5, 90_000, [1, 2, 3, 4], 4)

    def go(*docs):
        put(spark, f"{out}/in", *docs)
        SR.start_missing(stream(spark, f"{out}/in"), lambda: reg, lambda: none, out, f"{out}/progress", every=2).awaitTermination()
        return rows(spark.read.parquet(f"{out}/missing"), "exec_id", "sync_ts")

    assert go(members[0], members[1]) == []
    assert go(marker) == []
    assert go(members[0], members[2]) == []      # one member came before
    assert go(members[3]) == [(5, 90_000), (6, 90_000)]
    assert go(members[3], marker) == [(5, 90_000), (6, 90_000)]  # a repeated part is not tested again
    # an incomplete listing is passed over when a newer one is whole; an empty one misses all
    old, late = listing(spark, 6, 91_000, [1, 2], 2)
    assert go(old, late[0]) == [(5, 90_000), (6, 90_000)]
    empty, _ = listing(spark, 8, 92_000, [], 0)
    got = go(empty)
    assert [g for g in got if g[1] == 92_000] == [(i, 92_000) for i in range(1, 7)]
    assert [g for g in go(late[1]) if g[1] == 91_000] == []
    # a marker without a number ends its listing
    end, two = listing(spark, 9, 93_000, [1, 2, 3], None)
    assert [g[0] for g in go(end, *two) if g[1] == 93_000] == [4, 5, 6]
    assert spark.read.parquet(f"{out}/missing").filter("sync_ts = 93000").first()["exit_message"].endswith(
        "missed the deletion event. Marking this executor as failed.")


def test_late_removals_go_to_a_table_of_their_own(spark, one_partition):
    out = scratch_dir(spark, "late")
    ttl = 100

    def go(*times):
        docs = [pod(m, "Failed", containers=[container(exit_code=1)], seq=t, ts_ms=t) for m, t in times]
        put(spark, f"{out}/in", *docs)
        exits = L.lifecycle_events(stream(spark, f"{out}/in")).select("app_id", "exec_id", "ts_ms", "seq")
        SR.start_removals(exits, out, f"{out}/progress", ttl, lateness_ms=500, every=2).awaitTermination()

    go((1, 0), (2, 10))
    go((3, 2000))
    go((1, 50), (2, 1600), (2, 1650))     # member 1's is older than 1,500
    go((4, 5000))
    go((2, 4600), (3, 4700), (1, 2050))
    kept = rows(spark.read.parquet(f"{out}/kept"), "exec_id", "ts_ms")
    assert kept == [(1, 0), (2, 10), (2, 1600), (2, 4600), (3, 2000), (3, 4700), (4, 5000)]
    assert rows(spark.read.parquet(f"{out}/late"), "exec_id", "ts_ms") == [(1, 2050), (1, 50)]
    held = TableLog(spark, f"{out}/memory", "app_id string, exec_id bigint, kept_ms bigint", S.MEMBER, 2)
    assert (1, 0) not in rows(held.read(), "exec_id", "kept_ms")


def test_a_timeout_fires_while_only_the_clock_moves(spark, one_partition):
    out = scratch_dir(spark, "timer")
    now = int(time.time() * 1000)

    def put_rows(*events):
        spark.createDataFrame(list(events), TM.LEDGER_EVENT).coalesce(1).write.mode("append").parquet(f"{out}/in")

    put_rows(("a", 1, 0, now, TM.REQUESTED), ("a", 2, 0, now, TM.REQUESTED), ("a", 3, 7, now - 3_600_000, TM.REQUESTED))
    put_rows(("a", 2, None, None, TM.SEEN), ("a", 4, 0, now + 3_600_000, TM.REQUESTED))
    rows_in = spark.readStream.schema(TM.LEDGER_EVENT).parquet(f"{out}/in")
    query = TM.start_creation_timeouts(rows_in, f"{out}/late", f"{out}/progress", limit_ms=15_000, processingTime="1 second")
    try:
        found, end = [], time.time() + 90
        while time.time() < end and len(found) < 2:
            time.sleep(1)
            if os.path.isdir(f"{out.removeprefix('file:')}/late"):
                found = rows(spark.read.schema("app_id string, exec_id bigint, profile_id int, created_ms bigint, timed_out_ms bigint")
                             .parquet(f"{out}/late"), "exec_id", "profile_id", "created_ms", "timed_out_ms")
    finally:
        query.stop()
    assert [(f[0], f[1]) for f in found] == [(1, 0), (3, 7)]
    assert found[0][3] > now + 15_000 and found[0][2] == now


def test_fold_over_batches_and_compactions_equals_batch(spark, one_partition):
    out = scratch_dir(spark, "folds")
    docs = []
    for b in range(7):
        new = [pod(i, "Running" if (b + i) % 3 else "Failed", seq=b * 10 + i) for i in range(b, b + 3)]
        if b == 3:
            new = [pod(i, "Running", seq=39, sync_ts=1000) for i in (1, 3, 9)]
        docs += new
        put(spark, f"{out}/in", *new)
    SF.start_fold(stream(spark, f"{out}/in"), f"{out}/state", f"{out}/progress", every=2).awaitTermination()
    df = pods(spark, *docs)
    want = ST.fold_state(df.filter("sync_ts is null"), df.filter("sync_ts is not null"))
    columns = ("app_id", "exec_id", "state", "seq", "full_sync_ts")
    assert rows(SF.read_fold(spark, f"{out}/state"), *columns) == rows(want, *columns)


def test_members_of_hot_keys_are_spread(spark):
    """The buffer of a listing is keyed by member, so no task holds an app."""
    log = TableLog(spark, scratch_dir(spark, "hot"), "app_id string, seq bigint, exec_id bigint", ["app_id", "seq", "exec_id"])
    log.append(spark.range(4000).select(F.lit("a").alias("app_id"), F.lit(1).cast("bigint").alias("seq"), F.col("id").alias("exec_id")), 0)
    log.append(spark.range(10).select(F.lit("a").alias("app_id"), F.lit(2).cast("bigint").alias("seq"), F.col("id").alias("exec_id")), 1)
    assert log.read().groupBy("seq").count().filter("seq = 1").first()["count"] == 4000
