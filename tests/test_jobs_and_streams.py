import os

import pytest

from helpers import container, pod, pods, rows
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators import delivery as DL
from fleetfold.operators import jobs as J
from fleetfold.operators import keyed
from fleetfold.operators import lifecycle as L
from fleetfold.operators import state as ST
from fleetfold.sources.scratch import scratch_dir
from fleetfold.streaming import fold as SF
from fleetfold.streaming import rounds as SR


def put(spark, inbox, *docs):
    pods(spark, *docs).coalesce(1).write.mode("append").parquet(inbox)


def stream(spark, inbox):
    return spark.readStream.schema(S.POD).option("maxFilesPerTrigger", 1).parquet(inbox)


def test_pi_and_words(spark):
    pi = J.pi_estimate(spark.range(200_000), F.col("id")).first()
    assert pi["n"] == 200_000 and abs(pi["pi"] - 3.14) < 0.05
    source, target = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    spark.createDataFrame([("test PVs",), (" test  x",)], "value string").write.text(source)
    out = J.text_roundtrip_wordcount(spark, source, target)
    assert rows(out, "word", "n_before", "same") == [("PVs", 1, True), ("test", 2, True), ("x", 1, True)]


def test_rows_seen_stays_exact(spark):
    df = spark.range(0, 100, 1, 5)
    for _ in range(2):
        assert J.rows_seen(df, lambda d: d.groupBy("id").count().collect()) == 100


def test_group_values_keeps_every_value(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 5000).alias("v"))
    got = J.group_values(df, "k", "v", width=1000)
    seen = got.select("k", F.explode("vals").alias("x")).select("k", "x.value", "x.n")
    assert seen.agg(F.sum("n")).first()[0] == 10_000
    assert rows(seen, "k", "value") == sorted({(i % 3, i % 5000) for i in range(10_000)}, key=repr)


def test_a_million_fractions_of_one_unit_give_bounded_arrays(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") / F.lit(1_000_000)).alias("v"))
    got = J.group_values(df.unionByName(df.limit(10)), "k", "v", width=500)
    sizes = got.agg(F.max(F.size("vals")), F.sum(F.size("vals")), F.count("*")).first()
    assert sizes[0] <= 500 and sizes[1] == 1_000_000 and sizes[2] < 2_200
    # parts are ordered like the values they hold
    ends = got.select("part", F.get("vals", F.lit(0))["value"].alias("a")).orderBy("part").collect()
    assert [r.a for r in ends] == sorted(r.a for r in ends)
    words = spark.createDataFrame([("x", w) for w in ("b", "a", None, "b", "c")], "k string, v string")
    found = J.group_values(words, "k", "v", width=2).select(F.explode("vals").alias("x")).select("x.value", "x.n")
    assert rows(found, "value", "n") == sorted([("a", 1), ("b", 2), ("c", 1), (None, 1)], key=repr)


def test_python_function_and_range_filter(spark):
    df = spark.createDataFrame([(0,), (19,), (12345,)], "n long")
    assert rows(J.py_udf(df, "n"), "n", "digits") == [(0, 0), (12345, 15), (19, 10)]
    people = spark.createDataFrame([("Michael", None), ("Andy", 30), ("Justin", 19)], "name string, age long")
    assert rows(J.range_filter_demo(people, 13, 19), "name") == [("Justin",)]


def test_prefix_totals_with_one_hot_key(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.col("id") * 7919 % 30_000).alias("o"))
    got = keyed.prefix_totals(df, ["k"], [F.floor(F.col("o") / 5000), F.floor(F.col("o") / 100)], ["o"], F.col("o"), "before")
    want, totals = [], {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        want.append((r.k, r.o, totals.get(r.k, 0)))
        totals[r.k] = totals.get(r.k, 0) + r.o
    assert rows(got, "k", "o", "before") == sorted(want, key=repr)


def test_salted_lookup_is_a_left_join(spark):
    left = spark.range(1000).select((F.col("id") % 4).alias("k"), "id")
    right = spark.range(2).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    want = rows(left.join(right, "k", "left"), "id", "k", "v")
    assert keyed.fits_broadcast(right)
    assert rows(keyed.salted_lookup(left, right, ["k"]), "id", "k", "v") == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = keyed.salted_lookup(left, right, ["k"], salt_by=["id"])
        assert "_slot" in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got, "id", "k", "v") == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_stream_fold_equals_batch_over_many_batches(spark):
    out = scratch_dir(spark, "fold")
    inbox = f"{out}/in"
    docs = [
        [pod(1, "Pending", seq=1), pod(2, "Running", seq=2)],
        [pod(1, "Running", seq=3), pod(3, "Pending", app="b", seq=4)],
        [pod(2, "Running", seq=5, sync_ts=50), pod(4, "Running", seq=5, sync_ts=50)],
        [pod(1, "Failed", seq=6), pod(2, "Succeeded", seq=7)],
    ]
    columns = ("app_id", "exec_id", "state", "seq", "full_sync_ts")
    seen = []
    for batch in docs:
        put(spark, inbox, *batch)
        SF.start_fold(stream(spark, inbox), f"{out}/state", f"{out}/progress").awaitTermination()
        seen += batch
        df = pods(spark, *seen)
        want = ST.fold_state(df.filter("sync_ts is null"), df.filter("sync_ts is not null"))
        assert rows(SF.read_fold(spark, f"{out}/state"), *columns) == rows(want, *columns)


def test_relist_after_a_gap_also_clears_empty_apps(spark):
    out = scratch_dir(spark, "gap")
    inbox = f"{out}/in"
    put(spark, inbox, pod(1, seq=1), pod(1, app="b", seq=2), pod(1, app="c", seq=3))
    SF.start_fold(stream(spark, inbox), f"{out}/state", f"{out}/progress").awaitTermination()
    apps = spark.createDataFrame([("a",), ("b",)], "app_id string")
    SF.relist(pods(spark, pod(5)), 10, 99, apps).write.mode("append").parquet(inbox)
    SF.start_fold(stream(spark, inbox), f"{out}/state", f"{out}/progress").awaitTermination()
    assert rows(SF.read_fold(spark, f"{out}/state"), "app_id", "exec_id", "full_sync_ts") == [("a", 5, 99), ("c", 1, 0)]


def test_removal_stream_equals_batch(spark):
    out = scratch_dir(spark, "rem")
    inbox = f"{out}/in"
    ttl = 1000
    times = [[0, 400, 900], [999, 1000, 1500], [1999, 2000, 7000]]
    docs = [[pod(1, "Failed", containers=[container(exit_code=1)], seq=t, ts_ms=t) for t in b] for b in times]
    for batch in docs:
        put(spark, inbox, *batch)
        exits = L.lifecycle_events(stream(spark, inbox)).select("app_id", "exec_id", "ts_ms", "seq")
        SR.start_removals(exits, out, f"{out}/progress", ttl).awaitTermination()
    want = L.removal_once(L.lifecycle_events(pods(spark, *sum(docs, []))), ttl)
    assert rows(spark.read.parquet(f"{out}/kept"), "ts_ms") == rows(want, "ts_ms") == [(0,), (1000,), (2000,), (7000,)]


def test_missing_stream_tests_each_listing_once(spark):
    out = scratch_dir(spark, "miss")
    inbox = f"{out}/in"
    reg = spark.createDataFrame([("a", 1, 7), ("a", 2, 7)], S.REGISTRATIONS)
    none = reg.select("app_id", "exec_id").limit(0)
    apps = spark.createDataFrame([("a",)], "app_id string")
    for seq, ts in ((1, 30_007), (2, 30_008), (2, 30_008)):
        SF.relist(pods(spark, pod(2)), seq, ts, apps).coalesce(1).write.mode("append").parquet(inbox)
        SR.start_missing(stream(spark, inbox), lambda: reg, lambda: none, out, f"{out}/progress").awaitTermination()
    assert rows(spark.read.parquet(f"{out}/missing"), "exec_id", "sync_ts") == [(1, 30_008)]


def test_reconcile_stream_carries_its_tables(spark):
    out = scratch_dir(spark, "rec")
    inbox = f"{out}/in"
    targets = spark.createDataFrame([("a", 0, 3)], S.TARGETS)
    reg = spark.createDataFrame([], S.REGISTRATIONS)

    def go(*docs):
        put(spark, inbox, *docs)
        SR.start_reconcile(stream(spark, inbox), lambda: targets, lambda: reg, out, f"{out}/progress").awaitTermination()

    go(pod(1, "Running", seq=1, ts_ms=10))
    go(pod(2, "Pending", seq=2, ts_ms=20), pod(1, "Failed", seq=3, ts_ms=30))
    got = spark.read.parquet(f"{out}/decisions")
    # the request for member 3 is still unacknowledged, so the second round waits
    assert rows(got, "round", "decision", "exec_id") == [(0, "request", 2), (0, "request", 3)]
    go(pod(3, "Pending", seq=4, ts_ms=40, start_time="1970-01-01T00:00:00Z"))
    assert rows(spark.read.parquet(f"{out}/decisions").filter("round = 2"), "decision", "exec_id") == [("request", 4)]


def test_first_terminal_stream(spark):
    out = scratch_dir(spark, "term")
    inbox = f"{out}/in"
    for i, phase in enumerate(("Running", "Failed", "Succeeded")):
        put(spark, inbox, pod(1, phase, seq=i))
        SF.start_first_terminal(stream(spark, inbox), f"{out}/ends", f"{out}/progress").awaitTermination()
    assert rows(SF.read_first_terminal(spark, f"{out}/ends"), "app_id", "seq", "phase") == [("a", 1, "Failed")]


def test_due_rounds_bring_failed_ones_again(spark):
    events = spark.createDataFrame([("a", i, i * 10) for i in range(40)] + [("b", 100, 5)], "app_id string, seq bigint, ts_ms bigint")
    consumers = spark.createDataFrame([("x", "a", 4, 100), ("y", "a", -1, 1000), ("z", "c", 0, 10)],
                                      "consumer string, app_id string, delivered_seq bigint, interval_ms bigint")
    plain = DL.due_rounds(events, consumers)
    columns = ("consumer", "round", "n", "first_seq", "last_seq")
    assert rows(plain, *columns) == [("x", 0, 5, 5, 9), ("x", 1, 10, 10, 19), ("x", 2, 10, 20, 29), ("x", 3, 10, 30, 39), ("y", 0, 40, 0, 39)]
    failed = spark.createDataFrame([("x", 1), ("x", 2), ("y", 0), ("y", 0)], "consumer string, round bigint")
    assert rows(DL.due_rounds(events, consumers, failed), *columns) == [("x", 0, 5, 5, 9), ("x", 3, 30, 10, 39), ("y", 1, 40, 0, 39)]


def test_an_empty_round_decides_nothing(spark):
    out = scratch_dir(spark, "rec-empty")
    inbox = f"{out}/in"
    put(spark, inbox, pod(1, "Pending", seq=1))
    none = spark.createDataFrame([], S.REGISTRATIONS) if hasattr(S, "REGISTRATIONS") else spark.createDataFrame([], "app_id string, exec_id bigint, registered_ms bigint")
    targets = spark.createDataFrame([("a", 0, 0)], "app_id string, profile_id int, target int")
    rows_ = stream(spark, inbox).filter("seq < 0")
    SR.start_reconcile(rows_, lambda: targets, lambda: none, out, f"{out}/progress").awaitTermination()
    decided = spark.read.parquet(f"{out}/decisions/round=0") if os.path.isdir(f"{out}/decisions/round=0") else None
    assert decided is None or decided.filter("decision <> 'request'").count() == 0


def test_entry_and_catalog(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry(spark).count() == 35
