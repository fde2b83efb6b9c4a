"""Streaming queries: each runs over several micro-batches and returns what it wrote.

Their checks are the SQL of the batch operators, so they also show batch = stream;
the rounds of ``reconcile_stream`` depend on each other and have SQL of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetfold import schema as S
from fleetfold.operators import delivery as DL
from fleetfold.operators import lifecycle as L
from fleetfold.plans import adapters as A
from fleetfold.plans.adapters import STATE_SQL, with_tables
from fleetfold.plans.catalog import query
from fleetfold.plans.members import FIRST_TERMINAL_SQL, IDLE_MS, REMOVAL_SQL, REMOVAL_TTL
from fleetfold.sources.scratch import scratch_dir
from fleetfold.streaming import fold as SF
from fleetfold.streaming import rounds as SR
from fleetfold.streaming import timers as TM

_LAST_STATE = with_tables("state", body="SELECT app_id, exec_id, profile_id, state, seq FROM state")

#: Micro-batches at least, and which of them an event comes with.
PARTS = 4
_PART = f"floor((day(ts) - 1) * {PARTS} / 31)"


def in_parts(
    source: DataFrame, part: str, inbox: str, start: Callable[[DataFrame], StreamingQuery], parts: int = PARTS, restart: bool = True
) -> None:
    """Feed a table to a stream part by part, each a micro-batch of its own at least.

    With ``restart`` the stream ends after each part and is started again for the next
    one; else one run takes a file for each micro-batch.
    """
    spark = source.sparkSession
    for i in range(parts):
        rows = source.filter(F.expr(f"{part} = {i}"))
        (rows if restart else rows.coalesce(1)).write.mode("append").parquet(inbox)
        if restart:
            start(spark.readStream.schema(source.schema).parquet(inbox)).awaitTermination()
    if not restart:
        start(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(inbox)).awaitTermination()


@query("fold_state_stream", _LAST_STATE)
def fold_state_stream(spark, d):
    out = scratch_dir(spark, "fold")
    in_parts(A.table(spark, d, "events"), _PART, f"{out}/inbox", lambda rows: SF.start_fold(
        A.pod_rows(rows), f"{out}/state", f"{out}/progress", every=3), restart=False)
    return SF.read_fold(spark, f"{out}/state").select(*S.MEMBER, "profile_id", "state", "seq")


@query("resume_after_gap", with_tables("folded", body=f"""
SELECT app_id, exec_id, profile_id, {STATE_SQL} AS state FROM folded"""))
def resume_after_gap(spark, d):
    """Fold the changes before the listing, stop, fold the listing and the rest in later."""
    out = scratch_dir(spark, "gap")
    pods = A.by_time(A.pods(spark, d))
    columns = [f.name for f in S.POD.fields]
    listing = SF.relist(A.listing(pods).select(*columns), A.LISTING_MS * 1000, A.LISTING_MS)
    when = F.when(F.col("ts_ms") < A.LISTING_MS - A.LISTING_SPAN_MS, 0).when(F.col("ts_ms") < A.LISTING_MS, None).otherwise(3)
    changes = pods.select(*columns).withColumn("part", when)
    # members first, their marker later: the fold does not need a listing in one piece
    listed = listing.withColumn("part", F.when(F.col("exec_id").isNull(), 2).otherwise(1))
    in_parts(changes.unionByName(listed.select(*columns, "part")), "part", f"{out}/inbox", lambda rows: SF.start_fold(
        rows, f"{out}/state", f"{out}/progress", every=2))
    return SF.read_fold(spark, f"{out}/state").select(*S.MEMBER, "profile_id", "state")


@query("removal_once_stream", REMOVAL_SQL)
def removal_once_stream(spark, d):
    out = scratch_dir(spark, "removals")
    in_parts(A.table(spark, d, "events"), _PART, f"{out}/inbox", lambda rows: SR.start_removals(
        L.lifecycle_events(A.pod_rows(rows)).select(*S.MEMBER, "ts_ms", "seq"), out, f"{out}/progress", REMOVAL_TTL, every=3), restart=False)
    return spark.read.parquet(f"{out}/kept").select(*S.MEMBER, "ts_ms", "seq")


@query("first_terminal_stream", FIRST_TERMINAL_SQL)
def first_terminal_stream(spark, d):
    out = scratch_dir(spark, "terminal")
    in_parts(A.table(spark, d, "events"), _PART, f"{out}/inbox", lambda rows: SF.start_first_terminal(
        A.watched_rows(A.event_rows(rows)), f"{out}/ends", f"{out}/progress", every=3), restart=False)
    return SF.read_first_terminal(spark, f"{out}/ends").select("app_id", "seq", "action", "phase")


@query("missing_members_stream", with_tables("registrations", "listing", body=f"""
SELECT r.app_id, r.exec_id, CAST({A.LISTING_MS} AS BIGINT) AS sync_ts FROM registrations r
WHERE r.app_id IN (SELECT app_id FROM listing) AND {A.LISTING_MS} - r.registered_ms > 30000
 AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.app_id = r.app_id AND l.exec_id = r.exec_id)"""))
def missing_members_stream(spark, d):
    """One listing of every app in four parts; its markers come with the second."""
    out = scratch_dir(spark, "missing")
    pods = A.by_time(A.pods(spark, d))
    columns = [f.name for f in S.POD.fields]
    listing = SF.relist(A.listing(pods).select(*columns), A.LISTING_MS * 1000, A.LISTING_MS)
    parted = listing.withColumn("part", F.coalesce(F.col("exec_id") % PARTS, F.lit(1)))
    known = A.registrations(pods)
    none = known.select(*S.MEMBER).filter(F.lit(False))
    in_parts(parted, "part", f"{out}/inbox", lambda rows: SR.start_missing(
        rows, lambda: known, lambda: none, out, f"{out}/progress", every=3))
    return spark.read.parquet(f"{out}/missing").select(*S.MEMBER, "sync_ts")


@query("creation_timeouts_stream", with_tables("ledger", "e0", body="""
SELECT app_id, exec_id, profile_id, created_ms FROM ledger l
WHERE NOT EXISTS (SELECT 1 FROM e0 e WHERE e.app_id = l.app_id AND e.exec_id = l.exec_id)"""))
def creation_timeouts_stream(spark, d):
    """Requests and sightings of every member; the clock of the run is past all limits."""
    out = scratch_dir(spark, "timeouts")
    asked = A.ledger(spark, d).withColumn("kind", F.lit(TM.REQUESTED))
    none = F.lit(None)
    seen = A.pods(spark, d).select(*S.MEMBER).distinct().select(
        *S.MEMBER, none.cast("int").alias("profile_id"), none.cast("bigint").alias("created_ms"), F.lit(TM.SEEN).alias("kind")
    )
    rows = asked.unionByName(seen).withColumn("part", F.col("exec_id") % PARTS)
    in_parts(rows, "part", f"{out}/inbox", lambda new: TM.start_creation_timeouts(
        new, f"{out}/late", f"{out}/progress"))
    return spark.read.parquet(f"{out}/late").select(*S.MEMBER, "profile_id", "created_ms")


_INTERVAL = "3600000 * (1 + n_regionkey)"


@query("batched_delivery", with_tables("e0", more={
    "consumers": f"""SELECT n_name AS consumer, concat('app-', CAST(n_nationkey % 7 AS VARCHAR)) AS app_id,
      n_nationkey * 100 AS delivered_seq, {_INTERVAL} AS interval_ms FROM nation""",
    "due": """SELECT c.consumer, e.seq, CAST(e.ts_ms // c.interval_ms AS BIGINT) AS round FROM e0 e JOIN consumers c USING (app_id)
      WHERE e.seq > c.delivered_seq""",
    "failed": "SELECT DISTINCT consumer, round FROM due WHERE round % 5 < 2 AND length(consumer) > 5",
    "placed": """SELECT consumer, seq, CASE WHEN length(consumer) > 5 AND round % 5 = 0 THEN
        CASE WHEN (consumer, round + 1) IN (SELECT (consumer, round) FROM failed) THEN round + 2 ELSE round + 1 END
      WHEN length(consumer) > 5 AND round % 5 = 1 THEN round + 1 ELSE round END AS round FROM due"""}, body="""
SELECT consumer, round, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM placed GROUP BY consumer, round"""))
def batched_delivery(spark, d):
    """Rows due to consumers with their own progress and interval; failed rounds come again."""
    consumers = A.table(spark, d, "nation").select(
        F.col("n_name").alias("consumer"), F.concat(F.lit("app-"), (F.col("n_nationkey") % 7).cast("string")).alias("app_id"),
        (F.col("n_nationkey") * 100).cast("bigint").alias("delivered_seq"), F.expr(_INTERVAL).cast("bigint").alias("interval_ms"),
    )
    events = A.event_rows(A.table(spark, d, "events"))
    failed = DL.due_rounds(events, consumers).filter("round % 5 < 2 and length(consumer) > 5").select("consumer", "round")
    return DL.due_rounds(events, consumers, failed)


def _round_sql(r: int) -> dict[str, str]:
    """The tables of round ``r``, from those of the round before it (ledger, known, deleted, tops)."""
    p = r - 1
    fields = ["state", "state_profile", "start_ms", "in_state", "ledger_profile", "created_ms", "in_ledger",
              "known_profile", "in_known", "is_seen", "registered", "was_deleted"]

    def part(source: str, **given: str) -> str:
        return "SELECT app_id, exec_id, " + ", ".join(f"{given.get(f, 'NULL')} AS {f}" for f in fields) + f" FROM {source}"

    flags = {"in_state", "in_ledger", "in_known", "is_seen", "registered", "was_deleted"}
    merged = ", ".join(f"coalesce(bool_or({f}), false) AS {f}" if f in flags else f"max({f}) AS {f}" for f in fields)
    united = " UNION ALL ".join([
        part(f"state{r}", state="state", state_profile="profile_id", start_ms="start_ms", in_state="true", is_seen="true"),
        part(f"ledger{p}", ledger_profile="profile_id", created_ms="created_ms", in_ledger="true"),
        part("registrations", registered="true"), part(f"seen{r}", is_seen="true"),
        part(f"known{p}", known_profile="profile_id", in_known="true"), part(f"deleted{p}", was_deleted="true"),
    ])
    now = f"(SELECT max(ts_ms) FROM parted WHERE part < {r})"
    return {
        f"state{r}": f"""SELECT app_id, exec_id, profile_id, start_ms, {STATE_SQL} AS state FROM (SELECT *, row_number() OVER
          (PARTITION BY app_id, exec_id ORDER BY seq DESC) AS rn FROM parted WHERE part < {r}) WHERE rn = 1""",
        f"seen{r}": f"SELECT DISTINCT app_id, exec_id FROM parted WHERE part = {p}",
        f"mem{r}": f"SELECT app_id, exec_id, {merged} FROM ({united}) GROUP BY app_id, exec_id",
        f"fa{r}": f"""SELECT *, coalesce(ledger_profile, known_profile) AS request_profile, was_deleted AND in_state AS still_deleted,
          in_state AND NOT was_deleted AS active, (in_known AND NOT is_seen) OR (in_ledger AND NOT is_seen AND registered) AS ledger_known,
          in_ledger AND NOT is_seen AND NOT registered AS unknown FROM mem{r}""",
        f"fl{r}": f"""SELECT *, CASE WHEN active THEN state_profile ELSE request_profile END AS profile_id,
          unknown AND {now} - created_ms > 600000 AS late, unknown AND {now} - created_ms <= 600000 AS ledger_unknown,
          active AND state = 'running' AS running, active AND state = 'pending' AND registered AS pending_known,
          active AND state = 'pending' AND NOT registered AS pending_unknown FROM fa{r}""",
        f"idle{r}": f"""SELECT *, ledger_unknown AND {now} - created_ms > {IDLE_MS} AS idle_ledger,
          pending_unknown AND (start_ms IS NULL OR {now} - start_ms > {IDLE_MS}) AS idle_pending FROM fl{r}""",
        f"st{r}": f"""SELECT t.app_id, t.profile_id, greatest(coalesce(n, 0) - t.target, 0) AS excess,
          CASE WHEN coalesce(lu, 0) = 0 THEN least(greatest(t.target - coalesce(n, 0), 0), 5) ELSE 0 END AS requests
          FROM targets t LEFT JOIN (SELECT app_id, profile_id, count_if(running OR pending_known OR pending_unknown) + count_if(ledger_known)
            + count_if(ledger_unknown) AS n, count_if(ledger_unknown) AS lu FROM idle{r} GROUP BY app_id, profile_id) USING (app_id, profile_id)""",
        f"trim{r}": f"""SELECT app_id, profile_id, exec_id FROM (SELECT i.*, s.excess, row_number() OVER (PARTITION BY app_id, profile_id
          ORDER BY source, at_ms NULLS FIRST, exec_id) AS rn FROM (SELECT app_id, profile_id, exec_id, CASE WHEN idle_ledger THEN 0 ELSE 1 END AS source,
          CASE WHEN idle_ledger THEN created_ms ELSE start_ms END AS at_ms FROM idle{r} WHERE idle_ledger OR idle_pending) i
          JOIN st{r} s USING (app_id, profile_id)) WHERE rn <= excess""",
        f"top{r}": f"SELECT app_id, max(last_id) AS last_id FROM (SELECT app_id, exec_id AS last_id FROM state{r} UNION ALL SELECT * FROM tops{p}) GROUP BY app_id",
        f"req{r}": f"""SELECT app_id, profile_id, coalesce(last_id, 0) + CAST(coalesce(sum(requests) OVER (PARTITION BY app_id ORDER BY profile_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + unnest(range(1, CAST(requests AS BIGINT) + 1)) AS exec_id
          FROM st{r} LEFT JOIN top{r} USING (app_id)""",
        f"ledger{r}": f"""SELECT app_id, exec_id, request_profile AS profile_id, created_ms FROM idle{r} i WHERE ledger_unknown
          AND NOT EXISTS (SELECT 1 FROM trim{r} t WHERE t.app_id = i.app_id AND t.exec_id = i.exec_id)
          UNION ALL SELECT app_id, exec_id, profile_id, {now} FROM req{r}""",
        f"known{r}": f"SELECT app_id, exec_id, request_profile AS profile_id FROM idle{r} WHERE ledger_known",
        f"deleted{r}": f"SELECT app_id, exec_id FROM idle{r} WHERE still_deleted UNION SELECT app_id, exec_id FROM trim{r}",
        f"tops{r}": f"SELECT app_id, max(last_id) AS last_id FROM (SELECT * FROM top{r} UNION ALL SELECT app_id, exec_id FROM req{r}) GROUP BY app_id",
    }


def _rounds_sql(rounds: int) -> str:
    tables = {
        "parted": f"SELECT *, CAST(floor((day(make_timestamp(ts_us)) - 1) * {PARTS} / 31) AS INT) AS part FROM pods",
        "ledger0": "SELECT app_id, exec_id, profile_id, created_ms FROM ledger",
        "known0": "SELECT app_id, exec_id, profile_id FROM ledger WHERE false",
        "deleted0": "SELECT app_id, exec_id FROM ledger WHERE false",
        "tops0": "SELECT app_id, exec_id AS last_id FROM ledger WHERE false",
    }
    for r in range(1, rounds + 1):
        tables |= _round_sql(r)
    written = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in tables.items())
    decisions = " UNION ALL ".join(f"""
SELECT CAST({r - 1} AS INT) AS round, app_id, request_profile AS profile_id, 'time_out' AS decision, exec_id FROM idle{r} WHERE late
UNION ALL SELECT {r - 1}, app_id, profile_id, 'delete', exec_id FROM trim{r}
UNION ALL SELECT {r - 1}, app_id, profile_id, 'request', exec_id FROM req{r}""" for r in range(1, rounds + 1))
    return with_tables("pods", "registrations", "targets", "ledger", body=f",{written}\n{decisions}")


@query("reconcile_stream", _rounds_sql(PARTS))
def reconcile_stream(spark, d):
    """One round per micro-batch; what a round leaves open is the next one's ledger."""
    out = scratch_dir(spark, "reconcile")
    known = A.registrations(A.pods(spark, d))
    targets, ledger = A.targets(spark, d), A.ledger(spark, d)
    in_parts(A.table(spark, d, "events"), _PART, f"{out}/inbox", lambda rows: SR.start_reconcile(
        A.pod_rows(rows), lambda: targets, lambda: known, out, f"{out}/progress", idle_ms=IDLE_MS, ledger=ledger, every=3))
    return spark.read.parquet(f"{out}/decisions")
