"""From change events and full listings to the current state of every member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetfold import schema as S
from fleetfold.functions import pods as P
from fleetfold.operators.keyed import salted_lookup, with_settled

_FIXED_WIDTH = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _recency(order_by: str) -> Column:
    if order_by == "arrival":
        return F.col("seq")
    if order_by == "event_time":
        # one fixed-width number that sorts like (ts_ms, seq)
        return F.expr("cast(ts_ms as decimal(19,0)) * 1000000000000000000BD + seq")
    raise ValueError(f"order_by must be 'arrival' or 'event_time', not {order_by!r}")


def classify_state(
    pods: DataFrame, check_all: bool = False, main_name: str = S.EXECUTOR_CONTAINER
) -> DataFrame:
    """Add ``state`` and ``is_final`` to every document."""
    state = P.state_name(P.state_code(check_all, main_name))
    return with_settled(pods, "state", state).withColumn("is_final", P.is_final(F.col("state")))


def latest_state(
    events: DataFrame,
    columns: list[str] | None = None,
    order_by: str = "arrival",
    keys: list[str] = S.MEMBER,
) -> DataFrame:
    """Last write per key. Arrival order decides; ``event_time`` is an extension.

    Fixed-width columns keep one `max_by` buffer each so that the partial
    aggregation runs by hash; other columns travel together in one struct.
    """
    columns = columns or [c for c in events.columns if c not in keys]
    order = _recency(order_by)
    narrow = all(isinstance(events.schema[c].dataType, _FIXED_WIDTH) for c in columns)
    if narrow:
        return events.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])
    return (
        events.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), order).alias("_last"))
        .select(*keys, "_last.*")
    )


def latest_members(
    events: DataFrame,
    check_all: bool = False,
    main_name: str = S.EXECUTOR_CONTAINER,
    order_by: str = "arrival",
) -> DataFrame:
    """Current ``profile_id``, ``state``, ``start_ms`` and ``seq`` of each member.

    Documents are classified before the shuffle, so only fixed-width columns move.
    """
    flat = events.select(
        *S.MEMBER,
        "profile_id",
        "seq",
        "ts_ms",
        P.state_code(check_all, main_name).alias("code"),
        P.start_ms().alias("start_ms"),
    )
    last = latest_state(flat, ["profile_id", "seq", "code", "start_ms"], order_by)
    return last.select(
        *S.MEMBER, "profile_id", P.state_name(F.col("code")).alias("state"), "start_ms", "seq"
    )


def last_syncs(listings: DataFrame) -> DataFrame:
    """Time and arrival number of the latest full listing of each app."""
    return listings.groupBy("app_id").agg(
        F.max_by("sync_ts", "seq").alias("sync_ts"), F.max("seq").alias("sync_seq")
    )


def fold_state(
    changes: DataFrame,
    listings: DataFrame,
    syncs: DataFrame | None = None,
    check_all: bool = False,
    main_name: str = S.EXECUTOR_CONTAINER,
) -> DataFrame:
    """State after upserting every change and replacing on every full listing.

    All rows of one listing carry the arrival number of that listing. A member is
    present when its last document is not older than the last listing of its app,
    so the fold is one aggregation per member plus a lookup of one row per app.
    ``syncs`` names listings that may be empty (``app_id, sync_ts, seq``).
    """
    columns = ["app_id", "exec_id", "profile_id", "seq", "ts_ms", "phase", "deletion_ts",
               "restart_policy", "containers", "start_time"]
    seen = changes.select(*columns).unionByName(listings.select(*columns))
    members = latest_members(seen, check_all, main_name)
    markers = last_syncs((listings if syncs is None else syncs).select("app_id", "sync_ts", "seq"))
    joined = salted_lookup(members, markers, ["app_id"], salt_by=["exec_id"])
    return joined.filter(F.col("sync_seq").isNull() | (F.col("seq") >= F.col("sync_seq"))).select(
        *S.MEMBER,
        "profile_id",
        "state",
        "start_ms",
        "seq",
        F.coalesce("sync_ts", F.lit(0)).alias("full_sync_ts"),
    )


def last_snapshot(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a batch of numbered snapshots: rows of the last one, and all ids seen.

    Decisions use the last snapshot only; acknowledgement uses every snapshot.
    """
    last = snapshots.groupBy("app_id").agg(F.max("snapshot_no").alias("_last_no"))
    current = (
        salted_lookup(snapshots, last, ["app_id"], "inner", salt_by=["exec_id"])
        .filter(F.col("snapshot_no") == F.col("_last_no"))
        .drop("_last_no")
    )
    return current, snapshots.select(*S.MEMBER).distinct()


def entity_by_job(pods: DataFrame, jobs: DataFrame, job_label: str, strict: bool = False) -> DataFrame:
    """Member id by the job-name label; a miss is an error row, or an abort if strict."""
    named = pods.drop("exec_id").withColumn("job_name", F.col("labels")[job_label])
    known = jobs.select("app_id", "job_name", "exec_id")
    # a member may own most of the documents, so its job row is looked up with a salt
    found = salted_lookup(named, known, ["app_id", "job_name"], salt_by=["uid"])
    return _flag_missing(found, F.col("job_name"), strict)


def resolve_entity(
    pods: DataFrame,
    jobs: DataFrame | None = None,
    job_label: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Member id from the id label, or through the jobs table in batch mode."""
    if jobs is not None:
        return entity_by_job(pods, jobs, job_label, strict)
    label = F.col("labels")[S.ID_LABEL]
    ident = pods.drop("exec_id").withColumn("exec_id", label.try_cast("bigint"))
    return _flag_missing(ident, label, strict)


def _flag_missing(df: DataFrame, source: Column, strict: bool) -> DataFrame:
    missing = F.col("exec_id").isNull()
    text = F.concat(F.lit("no member id for "), F.coalesce(source, F.lit("null")))
    if strict:
        return df.withColumn("exec_id", F.when(missing, F.raise_error(text)).otherwise(F.col("exec_id")))
    return df.withColumn("error", F.when(missing, text))


def is_ready(pods: DataFrame) -> DataFrame:
    return pods.withColumn("ready", P.is_ready())


def split_main_container(pods: DataFrame, name: str | None) -> DataFrame:
    """``main`` container by unique name, else the first one; the rest are ``sidecars``."""
    first = F.get("containers", F.lit(0))
    rest = F.when(
        F.size("containers") > 1,
        F.slice("containers", 2, F.greatest(F.size("containers") - 1, F.lit(0))),
    ).otherwise(F.filter("containers", lambda c: F.lit(False)))
    if name is None:
        return pods.withColumns({"main": first, "sidecars": rest, "fell_back": F.lit(False)})
    named = F.filter("containers", lambda c: c["name"].eqNullSafe(name))
    others = F.filter("containers", lambda c: ~c["name"].eqNullSafe(name))
    unique = F.coalesce(F.size(named) == 1, F.lit(False))
    return pods.withColumns({
        "main": F.when(unique, F.get(named, F.lit(0))).otherwise(first),
        "sidecars": F.when(unique, others).otherwise(rest),
        "fell_back": ~unique,
    })


def last_job_phase(jobs: DataFrame) -> DataFrame:
    """Jobs with their phase made explicit and an end mark."""
    return jobs.select(
        "*", P.job_phase().alias("job_phase"), P.is_terminal_job().alias("is_terminal")
    )
