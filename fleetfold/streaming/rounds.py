"""Rounds: each micro-batch runs a batch operator against tables that are kept as logs.

A round reads its tables as they were before its batch and writes only what it
changed under its batch number, so a retried batch gives the same result and the
bytes of a round follow from its changes, not from the size of the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetfold import schema as S
from fleetfold.operators.lifecycle import last_removals, missing_members, removal_once
from fleetfold.operators.reconcile import reconcile
from fleetfold.sources.log import COMPACT_EVERY, TableLog
from fleetfold.sources.scratch import materialize
from fleetfold.streaming.fold import FOLDED, flatten, fold_flat, present


def put(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write a round's results and return them as written."""
    target = f"{path}/round={batch_id}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


class Clock:
    """The newest event time of all rounds."""

    def __init__(self, spark: SparkSession, path: str, every: int = COMPACT_EVERY) -> None:
        self.log = TableLog(spark, path, "id int, ts_ms bigint", ["id"], every)

    def before(self, batch_id: int) -> int | None:
        row = self.log.read(before=batch_id).first()
        return None if row is None else row["ts_ms"]

    def advance(self, batch: DataFrame, batch_id: int) -> int | None:
        """The newest time with this batch; a late batch does not set the clock back."""
        times = [batch.agg(F.max(F.col("ts_ms").cast("bigint"))).first()[0], self.before(batch_id)]
        newest = max((t for t in times if t is not None), default=None)
        self.log.append(batch.sparkSession.createDataFrame([(0, newest)], "id int, ts_ms bigint"), batch_id)
        return newest


def start_rounds(
    stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], **trigger
) -> StreamingQuery:
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(step)
        .start()
    )


def start_removals(
    exits: DataFrame, path: str, checkpoint: str, ttl_ms: int = S.REMOVAL_TTL_MS,
    lateness_ms: int | None = None, every: int = COMPACT_EVERY, **trigger
) -> StreamingQuery:
    """Removals that count, each once per memory span, as ``path/kept``.

    Without ``lateness_ms`` the memory is exact for events of any age and holds one row
    per removed member. With it, an event more than that much older than the newest event
    of earlier rounds is not judged but written to ``path/late``; then members whose span
    ended before that time are forgotten at the next compaction, which changes no
    decision about the events that are judged.
    """
    types = {f.name: f.dataType.simpleString() for f in exits.schema}
    ddl = f"app_id {types['app_id']}, exec_id {types['exec_id']}, kept_ms bigint"
    spark = exits.sparkSession
    clock = Clock(spark, f"{path}/clock", every)

    def oldest(batch_id: int) -> int | None:
        newest = clock.before(batch_id) if lateness_ms is not None else None
        return None if newest is None else newest - lateness_ms

    def remembered(memory: DataFrame, batch_id: int) -> DataFrame:
        limit = oldest(batch_id)
        return memory if limit is None else memory.filter(F.col("kept_ms") + ttl_ms >= limit)

    log = TableLog(spark, f"{path}/memory", ddl, S.MEMBER, every, remembered)

    def step(batch: DataFrame, batch_id: int) -> None:
        limit = oldest(batch_id)
        judged = batch
        if limit is not None:
            put(batch.filter(F.col("ts_ms") < limit), f"{path}/late", batch_id)
            judged = batch.filter(F.col("ts_ms") >= limit)
        kept = put(removal_once(judged, ttl_ms, log.read(before=batch_id)), f"{path}/kept", batch_id)
        log.append(last_removals(kept), batch_id)
        if lateness_ms is not None:
            clock.advance(batch, batch_id)

    return start_rounds(exits, checkpoint, step, **trigger)


_LISTING = ["app_id", "seq"]


def start_missing(
    listings: DataFrame,
    registrations: Callable[[], DataFrame],
    removed_recent: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    delta_ms: int = S.MISSING_DELTA_MS,
    every: int = COMPACT_EVERY,
    **trigger,
) -> StreamingQuery:
    """Missing members, tested once per full listing of an app, when all of it has arrived.

    ``listings`` carries listing rows and marker rows (null ``exec_id``). A listing may
    come in any number of parts and micro-batches: its members are put into a buffer, and it
    is released when the buffer holds as many different members as its marker's
    ``listing_rows`` says. A marker without a number is the listing's end: everything
    has come with or before it. A part that comes twice counts once. When an app has a
    newer complete listing, older ones, complete or not, are passed over. The
    live registrations and recent removals are read anew each round.
    """
    spark = listings.sparkSession
    released = TableLog(spark, f"{path}/released", "app_id string, seq bigint, sync_ts bigint", ["app_id"], every)

    def waiting(df: DataFrame, batch_id: int) -> DataFrame:
        """Rows of listings newer than the last one released; nobody needs the others again."""
        last = released.read(before=batch_id + 1).select("app_id", F.col("seq").alias("_last"))
        return df.join(last, "app_id", "left").filter("_last is null or seq > _last").drop("_last")

    opened = TableLog(
        spark, f"{path}/opened", "app_id string, seq bigint, sync_ts bigint, expected bigint, ended boolean", _LISTING, every, waiting
    )
    buffer = TableLog(spark, f"{path}/buffer", "app_id string, seq bigint, exec_id bigint", [*_LISTING, "exec_id"], every, waiting)

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter(F.col("sync_ts").isNotNull())
        is_marker = F.col("exec_id").isNull()
        buffer.append(rows.filter(~is_marker).select(*_LISTING, "exec_id").distinct(), batch_id)
        seen = rows.groupBy(*_LISTING).agg(
            F.max("sync_ts").alias("sync_ts"), F.max(F.when(is_marker, F.col("listing_rows"))).alias("expected"),
            F.max(is_marker).alias("ended"),
        )
        before = opened.read(before=batch_id)
        touched = before.unionByName(seen).groupBy(*_LISTING).agg(
            F.max("sync_ts").alias("sync_ts"), F.max("expected").alias("expected"), F.max("ended").alias("ended")
        ).join(seen.select(*_LISTING), _LISTING, "left_semi")
        opened.append(touched, batch_id)
        # a repeated batch tests against what was released before it
        last = released.read(before=batch_id).select("app_id", F.col("seq").alias("_last"))
        open_now = opened.read(before=batch_id + 1).filter("ended").join(last, "app_id", "left").filter("_last is null or seq > _last")
        held = buffer.read(before=batch_id + 1)
        counted = held.groupBy(*_LISTING).agg(F.count("*").alias("n"))
        complete = open_now.join(counted, _LISTING, "left").filter(
            F.coalesce("n", F.lit(0)) >= F.coalesce("expected", F.lit(0))
        )
        newest = complete.groupBy("app_id").agg(F.max_by("sync_ts", "seq").alias("sync_ts"), F.max("seq").alias("seq"))
        released.append(newest.select("app_id", "seq", "sync_ts"), batch_id)
        new = released.read(before=batch_id + 1).join(last, "app_id", "left").filter("_last is null or seq > _last").drop("_last")
        listed = held.join(new.select(*_LISTING), _LISTING, "left_semi")
        # this stream removes nobody itself, so recent removals are the only exclusion
        removed = removed_recent()
        found = missing_members(registrations(), listed, new.select("app_id", "sync_ts", "seq"), removed, removed, delta_ms)
        put(found, f"{path}/missing", batch_id)

    return start_rounds(listings, checkpoint, step, **trigger)


def start_reconcile(
    documents: DataFrame,
    targets: Callable[[], DataFrame],
    registrations: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    trigger: Mapping | None = None,
    every: int = COMPACT_EVERY,
    ledger: DataFrame | None = None,
    **options,
) -> StreamingQuery:
    """Reconcile every app once per micro-batch; ``path/decisions`` holds the results.

    The clock of a round is the newest event time so far, so a late batch does not set
    it back; before the first event no timeout fires. Members, ledger, acknowledged
    requests, deleted ids and highest ids are logs: a round writes the rows that it
    changed. ``ledger`` holds the requests that are open before the first round.
    """
    spark = documents.sparkSession
    ids = "app_id string, exec_id bigint"

    def log(name: str, ddl: str, keys: list[str] = S.MEMBER) -> TableLog:
        return TableLog(spark, f"{path}/{name}", ddl, keys, every)

    clock = Clock(spark, f"{path}/clock", every)
    members = log("members", FOLDED)
    requested, known = log("ledger", S.LEDGER), log("known", f"{ids}, profile_id int")
    deleted = log("deleted", ids)
    tops = log("last_ids", "app_id string, last_id bigint", ["app_id"])
    waited = log("outstanding", "app_id string, outstanding bigint", ["app_id"])

    def step(batch: DataFrame, batch_id: int) -> None:
        # the batch is computed for each use of it, so it is written once
        rows = materialize(batch, "round-rows")
        now = clock.advance(rows, batch_id)
        flat = rows.drop("ts_ms")
        keys = flat.select(*S.MEMBER).distinct()
        same = F.col("l.app_id").eqNullSafe(F.col("k.app_id")) & F.col("l.exec_id").eqNullSafe(F.col("k.exec_id"))
        before = members.read(before=batch_id).alias("l").join(keys.alias("k"), same, "left_semi")
        members.append(fold_flat(before.unionByName(flat)), batch_id)
        folded = members.read(before=batch_id + 1)
        seen = flat.filter(F.col("exec_id").isNotNull()).select(*S.MEMBER).distinct()
        open_requests = requested.read(before=batch_id)
        if ledger is not None and batch_id == 0:
            open_requests = ledger.select(*open_requests.columns)
        # ids go on from the highest id ever seen or given out
        last_ids = tops.read(before=batch_id).unionByName(
            folded.groupBy("app_id").agg(F.max("exec_id").alias("last_id"))
        ).groupBy("app_id").agg(F.max("last_id").alias("last_id"))
        plan = reconcile(
            present(folded), targets(), open_requests, registrations(), F.lit(now).cast("bigint"),
            seen=seen, known_ledger=known.read(before=batch_id), deleted=deleted.read(before=batch_id), last_ids=last_ids, **options,
        )
        decisions = put(plan.decisions(), f"{path}/decisions", batch_id)
        waited.replace(plan.outstanding, batch_id)
        requested.replace(plan.ledger, batch_id)
        known.replace(plan.known_ledger, batch_id)
        deleted.replace(plan.deleted, batch_id)
        given = decisions.filter("decision = 'request'").groupBy("app_id").agg(
            F.max("exec_id").alias("last_id")
        )
        tops.replace(
            last_ids.unionByName(given).groupBy("app_id").agg(F.max("last_id").alias("last_id")), batch_id
        )

    # what a round does not need is left out before the batch, which is not pruned, is made
    return start_rounds(flatten(documents, more=("ts_ms",)), checkpoint, step, **(trigger or {}))
