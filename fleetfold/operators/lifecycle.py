"""Exits, removals, missing members and the end of applications."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.functions import pods as P
from fleetfold.operators.keyed import salted_lookup, with_settled
from fleetfold.operators.state import classify_state


def exit_record(classified: DataFrame) -> DataFrame:
    """Exit code, blame and message of documents that carry a ``state``."""
    state = F.col("state")
    return with_settled(classified, "exit_code", P.exit_code()).select(
        "*",
        (state != "deleted").alias("by_app"),
        P.exit_message(state, F.col("exit_code")).alias("exit_message"),
    )


def lifecycle_events(pods: DataFrame, check_all: bool = False, keep_pods: bool = False) -> DataFrame:
    """Documents that report an exit, with the exit record and the clean-up to do.

    Inactive documents are skipped; deleted, failed and succeeded report an exit;
    terminating and unknown do not. ``cleanup`` is ``delete`` for failed and
    succeeded members, or ``mark_inactive`` when documents are kept.
    """
    exits = classify_state(pods.filter(~P.is_inactive()), check_all).filter(
        F.col("state").isin("deleted", "failed", "succeeded")
    )
    action = "mark_inactive" if keep_pods else "delete"
    return exit_record(exits).withColumn("cleanup", F.when(F.col("state") != "deleted", action))


# --- removals with a memory ---------------------------------------------------------

#: Pieces of the history that one task of the composition puts together.
_PIECES = 64


def removal_once(
    events: DataFrame,
    ttl_ms: int = S.REMOVAL_TTL_MS,
    prior: DataFrame | None = None,
) -> DataFrame:
    """First removal per member; repeats count again ``ttl_ms`` after the kept one.

    Which event is kept depends on the one kept before it, so a long history of one
    member is a chain. The events are dealt out by ranges of (member, time), so a member
    with very many of them spans several pieces and no task holds a member. A piece is a
    map: from the time at which its first member is free again to the time at which its
    last one is. Maps of neighbouring pieces compose into maps, so groups of pieces are
    composed first, then the groups, and what enters each piece comes back down the same
    tree; the pieces then replay independently. Only the events are shuffled; the maps
    are a few numbers per piece, and what is broadcast is one row per piece.
    ``prior`` holds the last kept time per member (``app_id, exec_id, kept_ms``).
    """
    rows = events.select(*S.MEMBER, F.col("ts_ms").cast("bigint").alias("t"), F.col("seq").cast("bigint").alias("seq"))
    if prior is not None:
        rows = salted_lookup(rows, prior.select(*S.MEMBER, "kept_ms"), S.MEMBER, salt_by=["seq"])
        rows = rows.filter(F.col("kept_ms").isNull() | (F.col("t") >= F.col("kept_ms") + ttl_ms)).drop("kept_ms")
    types = {c: events.schema[c].dataType.simpleString() for c in S.MEMBER}
    state = f"app_id {types['app_id']}, exec_id {types['exec_id']}, free bigint"
    pieces = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*S.MEMBER, "t", "seq"]
    # both passes read the same exchange; a given number of pieces is never merged
    dealt = rows.repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id())
    piece = f"piece int, at bigint[], free_after bigint[], single boolean, first {_struct(types)}, last {_struct(types)}"
    piece = piece.replace("bigint[]", "array<bigint>")
    maps = dealt.sortWithinPartitions(*order).mapInPandas(_pieces(ttl_ms), piece)
    # each group is put together twice, on the way up and on the way down
    groups = maps.withColumn("pack", F.floor(F.col("piece") / F.lit(_PIECES)).cast("int")).repartition(
        -(-pieces // _PIECES), "pack"
    )
    packs = groups.sortWithinPartitions("pack", "piece").mapInPandas(_packs, f"pack int, {piece}")
    entering = packs.repartition(1).sortWithinPartitions("pack").mapInPandas(_scan("pack", None), f"pack int, {state}")
    down = groups.join(F.broadcast(entering), "pack", "left").sortWithinPartitions("pack", "piece")
    entries = down.mapInPandas(_scan("piece", "pack"), f"piece int, {state}")
    named = entries.select("piece", F.struct(*S.MEMBER, "free").alias("entry"))
    return (
        dealt.join(F.broadcast(named), "piece", "left")
        .sortWithinPartitions(*order)
        .mapInPandas(_replay(ttl_ms), f"{state.replace('free', 't')}, seq bigint")
        .select(*S.MEMBER, F.col("t").alias("ts_ms"), "seq")
    )


def _struct(types: dict[str, str]) -> str:
    return f"struct<app_id: {types['app_id']}, exec_id: {types['exec_id']}>"


#: Earlier than any event.
_FREE = -(1 << 62)


def _same(a: tuple, b: tuple) -> bool:
    """Whether two members are the same; a null id is an id like any other."""
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def _members(frame: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
    """Where in a sorted frame each member begins, and who it is."""
    codes = [pd.factorize(frame[c], use_na_sentinel=False)[0] for c in S.MEMBER]
    new = np.ones(len(frame), bool)
    new[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
    starts = np.flatnonzero(new)
    names = frame[S.MEMBER].iloc[starts]
    return starts, list(names.itertuples(index=False, name=None))


def _free_after(t: np.ndarray, free: int, ttl_ms: int) -> int:
    """When a member is free again after its events at the ordered times ``t``."""
    at = int(np.searchsorted(t, free))
    while at < len(t):
        free = int(t[at]) + ttl_ms
        at = int(np.searchsorted(t, free))
    return free


def _map_of(t: np.ndarray, ttl_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and results of the map of ordered events: free at or before ``at[i]`` gives ``free_after[i]``.

    A member may enter at any event of its first ``ttl_ms`` or right behind them: an
    earlier kept one is not after the first event here.
    """
    n = len(t)
    after = np.append(np.searchsorted(t, t + ttl_ms), n)
    end = np.where(after < n, after, np.arange(n + 1))
    end[n] = n
    while True:  # chains to their ends by pointer doubling
        further = end[end]
        if np.array_equal(further, end):
            break
        end = further
    early = min(int(np.searchsorted(t, t[0] + ttl_ms)) + 1, n)
    at, free = t[:early], t[end[:early]] + ttl_ms
    keep = np.append(free[1:] != free[:-1], True)
    return at[keep], free[keep]


def _apply(at: np.ndarray, free_after: np.ndarray, free: int) -> int:
    """The map at ``free``; later than all its times nothing changes."""
    i = int(np.searchsorted(at, free))
    return int(free_after[i]) if i < len(at) else free


def _pieces(ttl_ms: int):
    """The map of the partition: of its first member if that is the only one, else of its last (a constant)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = number = None
        head: list[np.ndarray] = []
        free = _FREE
        for frame in frames:
            if frame.empty:
                continue
            number = int(frame["piece"].iloc[0])
            t = frame["t"].to_numpy()
            starts, names = _members(frame)
            ends = [*starts[1:], len(frame)]
            if first is None:
                first = last = names[0]
            if not _same(names[0], last):
                last, free = names[0], _FREE
            if _same(last, first):
                head.append(t[:ends[0]])
            else:
                free = _free_after(t[:ends[0]], free, ttl_ms)
            if len(names) > 1:
                last, free = names[-1], _free_after(t[starts[-1]:], _FREE, ttl_ms)
        if first is None:
            return
        single = _same(first, last)
        at, after = _map_of(np.concatenate(head), ttl_ms) if single else (np.zeros(0, np.int64), np.array([free]))
        yield _piece_frame([(number, at, after, single, first, last)], ["piece"])

    return run


_PIECE = ["at", "free_after", "single", "first", "last"]


def _piece_frame(rows: list[tuple], numbers: list[str]) -> pd.DataFrame:
    named = [(*r[:-2], dict(zip(S.MEMBER, r[-2])), dict(zip(S.MEMBER, r[-1]))) for r in rows]
    return pd.DataFrame(named, columns=[*numbers, *_PIECE])


def _read_pieces(frame: pd.DataFrame, number: str) -> Iterator[tuple]:
    for row in frame.itertuples(index=False):
        yield (getattr(row, number), np.asarray(row.at, np.int64), np.asarray(row.free_after, np.int64), row.single,
               tuple(row.first[c] for c in S.MEMBER), tuple(row.last[c] for c in S.MEMBER))


def _compose(a: tuple, b: tuple) -> tuple:
    """The map of two neighbouring pieces (at, free_after, single, first, last)."""
    at_a, after_a, single_a, first_a, last_a = a
    at_b, after_b, single_b, first_b, last_b = b
    if not single_b:
        return np.zeros(0, np.int64), after_b, False, first_a, last_b
    meets = _same(last_a, first_b)
    if single_a and meets:
        after = np.array([_apply(at_b, after_b, int(x)) for x in after_a], np.int64)
        behind = at_b > at_a[-1]
        return np.append(at_a, at_b[behind]), np.append(after, after_b[behind]), True, first_a, last_b
    constant = _apply(at_b, after_b, int(after_a[0]) if meets else _FREE)
    return np.zeros(0, np.int64), np.array([constant]), False, first_a, last_b


def _packs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One map for the pieces of each group."""
    held = None
    for frame in frames:
        for pack, piece in zip(frame["pack"].tolist(), _read_pieces(frame, "piece")):
            if held is not None and held[0] == pack:
                held = (pack, held[1], _compose(held[2], piece[1:]))
                continue
            if held is not None:
                yield _piece_frame([(held[0], held[1], *held[2])], ["pack", "piece"])
            held = (pack, piece[0], piece[1:])
    if held is not None:
        yield _piece_frame([(held[0], held[1], *held[2])], ["pack", "piece"])


def _scan(number: str, within: str | None):
    """What enters each piece: the member that came last before it and when it is free.

    With ``within`` the pieces of each group begin with what enters the group.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        member, free, group = (None, None), _FREE, None
        for frame in frames:
            out = []
            groups = frame[within].tolist() if within else [None] * len(frame)
            entering = (
                zip(*[frame[c].tolist() for c in [*S.MEMBER, "free"]]) if within else [(None, None, None)] * len(frame)
            )
            for own, entry, (place, at, after, single, first, last) in zip(groups, entering, _read_pieces(frame, number)):
                if own != group:
                    group, member, free = own, entry[:2], _FREE if pd.isna(entry[2]) else int(entry[2])
                out.append((place, *member, free))
                if single:
                    free = _apply(at, after, free if _same(member, first) else _FREE)
                else:
                    free = int(after[0])
                member = last
            yield pd.DataFrame(out, columns=[number, *S.MEMBER, "free"])

    return run


def _replay(ttl_ms: int):
    """The kept events of a partition, given what entered it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        member = free = None
        for frame in frames:
            if frame.empty:
                continue
            if member is None:
                entry = frame["entry"].iloc[0]
                member, free = ((None, None), _FREE) if entry is None else (tuple(entry[c] for c in S.MEMBER), int(entry["free"]))
            t = frame["t"].to_numpy()
            starts, names = _members(frame)
            n = len(frame)
            group = np.zeros(n, np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            ends = np.append(starts[1:], n)
            # the event kept after each: the first of the same member that is late enough
            offset = t - t[starts][group]
            span = int(offset.max()) + ttl_ms + 1
            place = group * span + offset
            after = np.searchsorted(place, place + ttl_ms)
            after = np.where(after < ends[group], after, n)
            at = starts.copy()
            if _same(names[0], member):
                at[0] = np.searchsorted(t[:ends[0]], free)
                at = at[(at < ends)]
            kept = np.zeros(n, bool)
            while len(at):
                kept[at] = True
                at = after[at]
                at = at[at < n]
            own = np.flatnonzero(kept[starts[-1]:])
            if len(own):
                free = int(t[starts[-1] + own[-1]]) + ttl_ms
            elif len(names) > 1 or not _same(names[0], member):
                free = _FREE
            member = names[-1]
            yield frame.loc[kept, [*S.MEMBER, "t", "seq"]]

    return run


def last_removals(kept: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Latest kept removal per member, to carry into the next batch."""
    rows = kept.select(*S.MEMBER, F.col("ts_ms").alias("kept_ms"))
    if prior is not None:
        rows = rows.unionByName(prior.select(*S.MEMBER, "kept_ms"))
    return rows.groupBy(*S.MEMBER).agg(F.max("kept_ms").alias("kept_ms"))


# --- members that vanished -------------------------------------------------------------

def missing_members(
    registrations: DataFrame,
    state: DataFrame,
    syncs: DataFrame,
    removed_now: DataFrame,
    removed_recent: DataFrame,
    delta_ms: int = S.MISSING_DELTA_MS,
) -> DataFrame:
    """Registered members that the latest full listing of their app does not show.

    ``registrations`` must be the live ones: end-date or anti-join finished members.
    The three exclusions share the member key and are united into one anti join.
    """
    excluded = (
        state.select(*S.MEMBER)
        .unionByName(removed_now.select(*S.MEMBER))
        .unionByName(removed_recent.select(*S.MEMBER))
    )
    absent = registrations.join(excluded.distinct(), S.MEMBER, "left_anti")
    latest = syncs.groupBy("app_id").agg(F.max_by("sync_ts", "seq").alias("sync_ts"))
    timed = salted_lookup(absent, latest, ["app_id"], "inner", salt_by=["exec_id"])
    message = F.format_string(S.MISSING_TEXT, "exec_id", "registered_ms", "sync_ts", F.lit(delta_ms))
    return timed.filter(F.col("sync_ts") - F.col("registered_ms") > delta_ms).select(
        *S.MEMBER,
        "registered_ms",
        "sync_ts",
        F.lit(S.UNKNOWN_EXIT_CODE).alias("exit_code"),
        F.lit(False).alias("by_app"),
        message.alias("exit_message"),
    )


# --- end of an application --------------------------------------------------------------

def terminal_rows(watched: DataFrame, kind: str = "app") -> DataFrame:
    """Events that end a watch: a deleted/error action or a terminal phase."""
    ends = P.is_terminal_app() if kind == "app" else P.is_terminal_job()
    gone = F.coalesce(F.col("action").isin("DELETED", "ERROR"), F.lit(False))
    return watched.filter(gone | ends)


def first_terminal(watched: DataFrame, kind: str = "app") -> DataFrame:
    """The event that ends each application, in arrival order."""
    columns = [c for c in watched.columns if c != "app_id"]
    return (
        terminal_rows(watched, kind)
        .groupBy("app_id")
        .agg(F.min_by(F.struct(*columns), "seq").alias("_end"))
        .select("app_id", "_end.*")
    )


def app_status(apps: DataFrame, watched: DataFrame) -> DataFrame:
    """Last phase per requested app; an app without documents is ``unknown``."""
    last = watched.groupBy("app_id").agg(F.max_by("phase", "seq").alias("phase"))
    joined = apps.join(last, "app_id", "left")
    return joined.select(
        "app_id",
        F.coalesce("phase", F.lit("unknown")).alias("phase"),
        P.is_terminal_app().alias("is_terminal"),
    )


# --- ownership ----------------------------------------------------------------------------

def ownership(resources: DataFrame, owners: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Each resource with its owner: ``owned``, ``orphan`` or ``cascade``.

    One level only. ``cascade`` marks resources whose owner is in ``gone``. An owner
    may hold any number of resources, so the owner rows are looked up with a salt.
    """
    own = owners.select(F.col("uid").alias("owner_uid"), F.col("name").alias("owner_name"))
    if gone is not None:
        dead = gone.select(F.col("uid").alias("owner_uid")).distinct().withColumn("_gone", F.lit(True))
        own = own.join(dead, "owner_uid", "left")
    else:
        own = own.withColumn("_gone", F.lit(None).cast("boolean"))
    joined = salted_lookup(resources, own, ["owner_uid"], salt_by=["uid"])
    status = (
        F.when(F.col("owner_name").isNull(), "orphan")
        .when(F.col("_gone"), "cascade")
        .otherwise("owned")
    )
    return joined.withColumn("ownership", status).drop("_gone")
