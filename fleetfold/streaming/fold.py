"""Continuous fold of change events and listings into current member state.

The state is an ordinary streaming aggregation keyed by member, so it is combined
on the map side, kept in Spark's state store and never gathers one app in one task.
Membership ("is it still in the last full listing?") is a property of the app; it
is decided when the state is read, by comparing arrival numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetfold import schema as S
from fleetfold.functions import pods as P
from fleetfold.operators.keyed import salted_lookup
from fleetfold.operators.lifecycle import terminal_rows
from fleetfold.sources.log import COMPACT_EVERY, TableLog

FLAT = ["profile_id", "seq", "code", "start_ms", "sync_seq", "sync_ts"]
FOLDED = (
    "app_id string, exec_id bigint, profile_id int, seq bigint, code int, start_ms bigint, "
    "sync_seq bigint, sync_ts bigint"
)
ENDS = "app_id string, seq bigint, phase string, action string, ts_ms bigint"


def flatten(
    documents: DataFrame, check_all: bool = False, main_name: str = S.EXECUTOR_CONTAINER, more: tuple[str, ...] = ()
) -> DataFrame:
    """Fixed-width columns of each document, and ``more`` of its own; a listing row remembers its listing.

    A row with a null ``exec_id`` and a ``sync_ts`` announces a listing that may be empty.
    """
    return documents.select(
        *S.MEMBER, "profile_id", "seq",
        P.state_code(check_all, main_name).alias("code"),
        P.start_ms().alias("start_ms"),
        F.when(F.col("sync_ts").isNotNull(), F.col("seq")).alias("sync_seq"),
        "sync_ts", *more,
    )


def fold_flat(flat: DataFrame) -> DataFrame:
    """Last document per member, and the last listing it was part of."""
    return flat.groupBy(*S.MEMBER).agg(
        *[F.max_by(c, "seq").alias(c) for c in ["profile_id", "code", "start_ms"]],
        F.max_by("sync_ts", "sync_seq").alias("sync_ts"),
        F.max("sync_seq").alias("sync_seq"),
        F.max("seq").alias("seq"),
    ).select(*S.MEMBER, *FLAT)


def present(folded: DataFrame) -> DataFrame:
    """Members that survive the last listing of their app, with readable states."""
    markers = folded.filter(F.col("sync_seq").isNotNull()).groupBy("app_id").agg(
        F.max("sync_seq").alias("last_sync_seq"), F.max_by("sync_ts", "sync_seq").alias("full_sync_ts")
    )
    members = folded.filter(F.col("exec_id").isNotNull()).drop("sync_seq", "sync_ts")
    joined = salted_lookup(members, markers, ["app_id"], salt_by=["exec_id"])
    return joined.filter(
        F.col("last_sync_seq").isNull() | (F.col("seq") >= F.col("last_sync_seq"))
    ).select(
        *S.MEMBER, "profile_id", P.state_name(F.col("code")).alias("state"), "start_ms", "seq",
        F.coalesce("full_sync_ts", F.lit(0)).alias("full_sync_ts"),
    )


def fold_log(spark: SparkSession, path: str, every: int = COMPACT_EVERY) -> TableLog:
    return TableLog(spark, path, FOLDED, S.MEMBER, every)


def _start_log(updates: DataFrame, log: TableLog, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Log the rows that a streaming aggregation updates; each is the whole state of its key."""
    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(log.append)
        .start()
    )


def start_fold(
    documents: DataFrame, path: str, checkpoint: str, every: int = COMPACT_EVERY, **trigger
) -> StreamingQuery:
    """Log the members that changed in each micro-batch below ``path``.

    The state is kept in the state store, so a batch writes what it changed. A batch
    owns its folder and overwrites it when it is retried; every ``every`` batches the
    log is compacted.
    """
    return _start_log(fold_flat(flatten(documents)), fold_log(documents.sparkSession, path, every), checkpoint, trigger)


def read_fold(spark: SparkSession, path: str) -> DataFrame:
    """Current state from the log."""
    return present(fold_log(spark, path).read())


def relist(listing: DataFrame, seq: int, sync_ts: int, apps: DataFrame | None = None) -> DataFrame:
    """Give a listing taken after a gap its place in the arrival order.

    The documents and one marker row per app replace whatever was missed when they
    are folded in; the interrupted query itself resumes from its checkpoint. ``apps``
    names the apps that were listed, also those whose listing came back empty. The
    marker tells how many members were listed (``listing_rows``), so a reader of parts
    knows when it has all of them.
    """
    stamped = listing.withColumn("seq", F.lit(seq).cast("bigint")).withColumn(
        "sync_ts", F.lit(sync_ts).cast("bigint")
    )
    # the marker only needs the app, the listing time, the arrival number and the count
    empty = {f.name: F.lit(None).cast(f.dataType) for f in listing.schema.fields}
    counted = listing.groupBy("app_id").agg(F.count_distinct("exec_id").alias("listing_rows"))
    if apps is not None:
        counted = apps.select("app_id").distinct().join(counted, "app_id", "left").fillna(0, ["listing_rows"])
    markers = counted.withColumns({
        "seq": F.lit(seq).cast("bigint"), "sync_ts": F.lit(sync_ts).cast("bigint"),
    }).select(
        *[F.col(n) if n in ("app_id", "seq", "sync_ts", "listing_rows") else e.alias(n) for n, e in empty.items()]
    )
    return stamped.unionByName(markers)


def ends_log(spark: SparkSession, path: str, every: int = COMPACT_EVERY) -> TableLog:
    return TableLog(spark, path, ENDS, ["app_id"], every)


def start_first_terminal(
    watched: DataFrame, path: str, checkpoint: str, kind: str = "app", every: int = COMPACT_EVERY, **trigger
) -> StreamingQuery:
    """Keep the first event that ends each app, as a streaming aggregation."""
    ends = terminal_rows(watched, kind).groupBy("app_id").agg(
        F.min("seq").alias("seq"), F.min_by("phase", "seq").alias("phase"),
        F.min_by("action", "seq").alias("action"), F.min_by("ts_ms", "seq").alias("ts_ms"),
    )
    return _start_log(ends, ends_log(watched.sparkSession, path, every), checkpoint, trigger)


def read_first_terminal(spark: SparkSession, path: str) -> DataFrame:
    return ends_log(spark, path).read().select("app_id", "seq", "phase", "action", "ts_ms")
