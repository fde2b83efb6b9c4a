"""Target-versus-actual reconciliation per app and resource profile."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators.keyed import first_per_key, prefix_totals, salted_lookup
from fleetfold.sources.scratch import materialize

PROFILE = ["app_id", "profile_id"]


def unacked(ledger: DataFrame, seen: DataFrame) -> DataFrame:
    """Requested members that no snapshot of the batch has shown."""
    return ledger.join(seen.select(*S.MEMBER).distinct(), S.MEMBER, "left_anti")


def split_known(members: DataFrame, registrations: DataFrame) -> DataFrame:
    """Mark which members are registered; one pass instead of a semi and an anti join."""
    marks = registrations.select(*S.MEMBER).distinct().withColumn("is_known", F.lit(True))
    return members.join(marks, S.MEMBER, "left").withColumn(
        "is_known", F.coalesce("is_known", F.lit(False))
    )


def ids_except(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Ids of ``left`` in none of the others: the others are united and reduced first, one join."""
    gone = reduce(DataFrame.unionByName, [o.select(*S.MEMBER) for o in others])
    return left.join(gone.distinct(), S.MEMBER, "left_anti")


def ids_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select(*S.MEMBER).distinct(), S.MEMBER, "left_semi")


def ids_union(*sides: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select(*S.MEMBER) for s in sides]).distinct()


def sorted_ids(ids: DataFrame, ascending: bool = True) -> DataFrame:
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in S.MEMBER]
    return ids.orderBy(*order)


def creation_limit_ms(
    delay_ms: int = S.BATCH_DELAY_MS, timeout_ms: int = S.CREATION_TIMEOUT_MS
) -> int:
    return max(5 * delay_ms, timeout_ms)


def _timed_out(created: Column, now: Column, limit_ms: int) -> Column:
    return now - created > limit_ms


def creation_timeouts(ledger: DataFrame, now: Column, limit_ms: int | None = None) -> DataFrame:
    """Ledger entries older than the creation limit (strictly)."""
    limit = creation_limit_ms() if limit_ms is None else limit_ms
    return ledger.filter(_timed_out(F.col("created_ms"), now, limit))


def _is_idle(start: Column, now: Column, idle_ms: int) -> Column:
    # without a clock nothing is decided
    return now.isNotNull() & F.coalesce(now - start > idle_ms, F.lit(True))


def idle_pending(state: DataFrame, now: Column, idle_ms: int = S.IDLE_TIMEOUT_MS) -> DataFrame:
    """Pending members idle for longer than the limit; no start time counts as idle."""
    return state.filter((F.col("state") == "pending") & _is_idle(F.col("start_ms"), now, idle_ms))


def state_counts(state: DataFrame) -> DataFrame:
    """Running, pending-known and pending-unknown members per profile.

    ``is_known`` is the registration mark of :func:`split_known`.
    """
    pending = F.col("state") == "pending"
    return state.groupBy(*PROFILE).agg(
        F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(pending & F.col("is_known")).alias("pending_known"),
        F.count_if(pending & ~F.col("is_known")).alias("pending_unknown"),
    )


def ledger_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*PROFILE).agg(
        F.count_if(F.col("is_known")).alias("ledger_known"),
        F.count_if(~F.col("is_known")).alias("ledger_unknown"),
    )


_COUNTS = ["running", "pending_known", "pending_unknown", "ledger_known", "ledger_unknown"]


def known_count() -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in _COUNTS])


def profile_status(
    targets: DataFrame, counts: DataFrame, ledger: DataFrame | None = None
) -> DataFrame:
    """Every target profile with its counts, also when it has no members.

    ``counts`` comes from :func:`state_counts`, ``ledger`` from :func:`ledger_counts`.
    All inputs have one row per profile by now, so nothing here is skewed.
    """
    joined = targets.join(counts, PROFILE, "left")
    if ledger is not None:
        joined = joined.join(ledger, PROFILE, "left")
    have = set(joined.columns)
    filled = joined.select(
        *targets.columns,
        *[(F.coalesce(c, F.lit(0)) if c in have else F.lit(0)).cast("bigint").alias(c)
          for c in [*_COUNTS, "idle_ledger", "idle_pending"]],
    )
    return filled.withColumn("known", known_count()).withColumns({
        "excess": F.greatest(F.col("known") - F.col("target"), F.lit(0)),
        "shortfall": F.greatest(F.col("target") - F.col("known"), F.lit(0)),
    })


def trim_excess(status: DataFrame, candidates: DataFrame) -> DataFrame:
    """Members to give up: the first ``excess`` idle requests of each profile.

    ``candidates`` are idle entries ``(app_id, profile_id, exec_id, source, at_ms)``
    with source 0 for unacknowledged requests and 1 for unknown pendings. Requests
    go first in creation order, pendings fill the remainder by start time and id.
    """
    over = status.filter(F.col("excess") > 0).select(*PROFILE, "excess")
    wanted = salted_lookup(candidates, over, PROFILE, "inner", salt_by=["exec_id"])
    # the cut is searched in several steps over these rows
    ordered = materialize(
        wanted.select(*PROFILE, "exec_id", "source", "excess", F.coalesce("at_ms", F.lit(-1)).alias("_at")),
        "trim-candidates",
    )
    levels = [
        F.struct("source", F.floor(F.col("_at") / F.lit(3_600_000)).alias("hour")),
        F.col("_at"),
        F.floor(F.col("exec_id") / F.lit(4096)),
    ]
    first = first_per_key(ordered, PROFILE, "excess", levels, ["_at", "exec_id"])
    return first.select(*PROFILE, "exec_id", "source")


def request_counts(status: DataFrame, batch_size: int = S.BATCH_SIZE, batch_mode: bool = False) -> DataFrame:
    """New members to ask for per profile.

    Nothing is asked while a request of the profile is unacknowledged; batch mode
    asks for the whole shortfall at once.
    """
    want = F.col("shortfall") if batch_mode else F.least(F.col("shortfall"), F.lit(batch_size))
    return status.withColumn(
        "requests", F.when(F.col("ledger_unknown") == 0, want).otherwise(0).cast("bigint")
    )


_ID_CHUNK = 10_000


def request_plan(
    status: DataFrame,
    last_ids: DataFrame | None = None,
    batch_size: int = S.BATCH_SIZE,
    batch_mode: bool = False,
) -> DataFrame:
    """One row per new member id, numbered on from the last id of the app.

    Ids go to profiles in profile order. Large requests are cut into chunks of ids
    that are shuffled before they are expanded, so no task emits one app's whole plan.
    """
    asked = request_counts(status, batch_size, batch_mode).filter("requests > 0")
    placed = prefix_totals(
        asked,
        ["app_id"],
        [F.floor(F.col("profile_id") / F.lit(4096))],
        ["profile_id"],
        F.col("requests"),
        "_before",
    ).select(*PROFILE, "requests", "_before")
    if last_ids is None:
        based = placed.withColumn("last_id", F.lit(0).cast("bigint"))
    else:
        based = salted_lookup(placed, last_ids.select("app_id", "last_id"), ["app_id"])
        based = based.withColumn("last_id", F.coalesce("last_id", F.lit(0)).cast("bigint"))
    first = F.col("last_id") + F.col("_before") + 1
    spans = based.select(*PROFILE, first.alias("_first"), F.col("requests").alias("_n"))
    if batch_mode:
        spans = spans.select(
            *PROFILE, "_first", "_n",
            F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / _ID_CHUNK))).alias("_chunk"),
        ).repartition("app_id", "profile_id", "_chunk")
        spans = spans.select(
            *PROFILE,
            (F.col("_first") + F.col("_chunk") * _ID_CHUNK).alias("_first"),
            F.least(F.lit(_ID_CHUNK), F.col("_n") - F.col("_chunk") * _ID_CHUNK).alias("_n"),
        )
    ids = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1))
    return spans.select(*PROFILE, ids.alias("exec_id"))


def outstanding(status: DataFrame, ledger_total: DataFrame | None = None) -> DataFrame:
    """Members still waited for per app, after trimming and requesting.

    Unknown pendings count for target profiles, unacknowledged requests for all
    profiles (``ledger_total``: ``app_id, ledger_unknown``); known ones do not count.
    """
    per_app = status.groupBy("app_id").agg(
        F.sum(F.col("pending_unknown") - F.col("trimmed_pending")).alias("_pending"),
        F.sum(F.col("requests") - F.col("trimmed_ledger")).alias("_delta"),
        F.sum("ledger_unknown").alias("_own"),
    )
    if ledger_total is None:
        total = F.col("_own")
    else:
        per_app = per_app.join(ledger_total, "app_id", "left")
        total = F.coalesce("ledger_unknown", F.lit(0))
    return per_app.select(
        "app_id", (F.col("_pending") + F.col("_delta") + total).cast("bigint").alias("outstanding")
    )


def with_trim_counts(status: DataFrame) -> DataFrame:
    """How many of each source will be trimmed; follows from the counts alone."""
    from_ledger = F.least(F.col("excess"), F.col("idle_ledger"))
    return status.withColumn("trimmed_ledger", from_ledger).withColumn(
        "trimmed_pending", F.least(F.col("excess") - F.col("trimmed_ledger"), F.col("idle_pending"))
    )


@dataclass(frozen=True)
class Reconciliation:
    """Tables of one cycle. They share the materialized member and profile tables."""

    status: DataFrame        # one row per target profile, with every count
    timed_out: DataFrame     # app_id, profile_id, exec_id
    trimmed: DataFrame       # app_id, profile_id, exec_id, source
    requests: DataFrame      # app_id, profile_id, exec_id
    outstanding: DataFrame   # app_id, outstanding
    ledger: DataFrame        # unacknowledged requests after the cycle
    known_ledger: DataFrame  # acknowledged by registration only
    deleted: DataFrame       # given up, still visible

    def decisions(self) -> DataFrame:
        def kind(df: DataFrame, name: str) -> DataFrame:
            return df.select(*PROFILE, F.lit(name).alias("decision"), "exec_id")

        return (
            kind(self.timed_out, "time_out")
            .unionByName(kind(self.trimmed, "delete"))
            .unionByName(kind(self.requests, "request"))
        )


def member_table(
    state: DataFrame,
    ledger: DataFrame,
    registrations: DataFrame,
    seen: DataFrame | None = None,
    known_ledger: DataFrame | None = None,
    deleted: DataFrame | None = None,
) -> DataFrame:
    """One row per member with what each input says about it.

    All inputs share the member key, so they are united and aggregated once: one
    shuffle with map-side combine instead of a chain of semi and anti joins.
    """
    fields = {
        "state_profile": "int", "state_code": "int", "start_ms": "bigint", "in_state": "boolean",
        "ledger_profile": "int", "created_ms": "bigint", "in_ledger": "boolean",
        "known_profile": "int", "in_known": "boolean",
        "is_seen": "boolean", "registered": "boolean", "was_deleted": "boolean",
    }

    def part(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(
            *S.MEMBER,
            *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()],
        )

    yes = F.lit(True)
    code = reduce(
        lambda acc, item: acc.when(F.col("state") == item[1], item[0]),
        list(enumerate(S.STATES))[1:],
        F.when(F.col("state") == S.STATES[0], 0),
    )
    parts = [
        part(state, state_profile=F.col("profile_id"), state_code=code,
             start_ms=F.col("start_ms"), in_state=yes, is_seen=yes),
        part(ledger, ledger_profile=F.col("profile_id"), created_ms=F.col("created_ms"), in_ledger=yes),
        part(registrations, registered=yes),
    ]
    if seen is not None:
        parts.append(part(seen, is_seen=yes))
    if known_ledger is not None:
        parts.append(part(known_ledger, known_profile=F.col("profile_id"), in_known=yes))
    if deleted is not None:
        parts.append(part(deleted, was_deleted=yes))
    return reduce(DataFrame.unionByName, parts).groupBy(*S.MEMBER).agg(
        *[
            (F.coalesce(F.max(n), F.lit(False)) if t == "boolean" else F.max(n)).alias(n)
            for n, t in fields.items()
        ]
    )


def reconcile(
    state: DataFrame,
    targets: DataFrame,
    ledger: DataFrame,
    registrations: DataFrame,
    now: Column,
    *,
    seen: DataFrame | None = None,
    known_ledger: DataFrame | None = None,
    deleted: DataFrame | None = None,
    last_ids: DataFrame | None = None,
    batch_size: int = S.BATCH_SIZE,
    batch_mode: bool = False,
    idle_ms: int = S.IDLE_TIMEOUT_MS,
    creation_ms: int | None = None,
    single_profile_fast_path: bool = False,
    has_snapshots: bool = True,
) -> Reconciliation:
    """One whole cycle for every app at once.

    Acknowledge, move registered requests aside, time out, forget deleted ids that
    are gone, then per profile trim the excess or request the shortfall.
    ``single_profile_fast_path`` counts all members of an app with at most one
    target as profile 0, whatever their label says.
    """
    limit = creation_limit_ms() if creation_ms is None else creation_ms
    members = member_table(state, ledger, registrations, seen, known_ledger, deleted)
    waiting = F.col("in_ledger") & ~F.col("is_seen")
    created_known = (F.col("in_known") & ~F.col("is_seen")) | (waiting & F.col("registered"))
    created_unknown = waiting & ~F.col("registered")
    late = created_unknown & _timed_out(F.col("created_ms"), now, limit)
    still_deleted = F.col("was_deleted") & (F.col("in_state") if has_snapshots else F.lit(True))
    active = F.col("in_state") & ~still_deleted
    pending = active & (F.col("state_code") == S.STATES.index("pending"))
    unknown_ledger = created_unknown & ~late
    flags = members.select(
        *S.MEMBER,
        "start_ms", "created_ms", "state_profile",
        F.coalesce("ledger_profile", "known_profile").alias("request_profile"),
        active.alias("active"),
        (active & (F.col("state_code") == S.STATES.index("running"))).alias("running"),
        (pending & F.col("registered")).alias("pending_known"),
        (pending & ~F.col("registered")).alias("pending_unknown"),
        created_known.alias("ledger_known"),
        unknown_ledger.alias("ledger_unknown"),
        late.alias("late"),
        still_deleted.alias("still_deleted"),
    )
    if single_profile_fast_path:
        per_app = targets.groupBy("app_id").agg((F.count("*") <= 1).alias("_single"))
        flags = salted_lookup(flags, per_app, ["app_id"], salt_by=["exec_id"])
        own = F.when(F.coalesce("_single", F.lit(True)), F.lit(0)).otherwise(F.col("state_profile"))
    else:
        own = F.col("state_profile")
    flags = flags.withColumn(
        "profile_id",
        F.when(F.col("active"), own).otherwise(F.col("request_profile")).cast("int"),
    ).withColumns({
        "idle_ledger": F.col("ledger_unknown") & _is_idle(F.col("created_ms"), now, idle_ms),
        "idle_pending": F.col("pending_unknown") & _is_idle(F.col("start_ms"), now, idle_ms),
    })
    # every result below starts from this table, not from the events behind it
    flags = materialize(flags, "member-flags")
    counts = flags.groupBy(*PROFILE).agg(
        *[F.count_if(F.col(c)).alias(c) for c in [*_COUNTS, "idle_ledger", "idle_pending"]]
    )
    status = materialize(
        with_trim_counts(request_counts(profile_status(targets, counts), batch_size, batch_mode)),
        "profile-status",
    )
    candidates = flags.filter("idle_ledger or idle_pending").select(
        *PROFILE,
        "exec_id",
        F.when(F.col("idle_ledger"), 0).otherwise(1).alias("source"),
        F.when(F.col("idle_ledger"), F.col("created_ms")).otherwise(F.col("start_ms")).alias("at_ms"),
    )
    trimmed = materialize(trim_excess(status, candidates), "trimmed")
    requests = materialize(request_plan(status, last_ids, batch_size, batch_mode), "requests")
    ledger_total = counts.groupBy("app_id").agg(F.sum("ledger_unknown").alias("ledger_unknown"))
    kept = flags.filter("ledger_unknown").select(
        *S.MEMBER, F.col("request_profile").alias("profile_id"), "created_ms"
    )
    return Reconciliation(
        status=status,
        timed_out=flags.filter("late").select(
            "app_id", F.col("request_profile").alias("profile_id"), "exec_id"
        ),
        trimmed=trimmed,
        requests=requests,
        outstanding=outstanding(status, ledger_total),
        ledger=kept.join(trimmed.select(*S.MEMBER), S.MEMBER, "left_anti").unionByName(
            requests.select(*S.MEMBER, "profile_id", now.cast("bigint").alias("created_ms"))
        ),
        known_ledger=flags.filter("ledger_known").select(
            *S.MEMBER, F.col("request_profile").alias("profile_id")
        ),
        deleted=ids_union(flags.filter("still_deleted"), trimmed),
    )


def jobs_to_delete(to_delete: DataFrame, pending: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs whose id was selected and whose member is still pending."""
    return ids_intersect(ids_intersect(jobs, to_delete), pending)


def force_kill_set(
    requested: DataFrame, state: DataFrame, now: Column, grace_ms: int = S.KILL_GRACE_MS
) -> DataFrame:
    """Members asked to stop that still run once the grace period is over."""
    running = state.filter(F.col("state") == "running")
    return ids_intersect(requested.filter(now - F.col("requested_ms") >= grace_ms), running)


def registration_ready(
    registrations: DataFrame, initial: DataFrame, ratio: float = S.REGISTERED_RATIO
) -> DataFrame:
    """Apps whose registered members reach ``initial`` times the ratio.

    Distinct members are counted in two steps, first per member, so one large app
    does not gather in one task.
    """
    counts = registrations.groupBy("app_id").agg(F.count_distinct("exec_id").alias("registered"))
    return initial.join(counts, "app_id", "left").select(
        "app_id",
        "initial",
        F.coalesce("registered", F.lit(0)).alias("registered"),
        (F.coalesce("registered", F.lit(0)) >= F.col("initial") * F.lit(ratio)).alias("ready"),
    )
