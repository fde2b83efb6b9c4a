"""Queries over members: state, selection, joins, counts, reconciliation, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.functions import pods as P
from fleetfold.operators import lifecycle as L
from fleetfold.operators import reconcile as R
from fleetfold.operators import report as Q
from fleetfold.operators import state as ST
from fleetfold.operators import volumes as V
from fleetfold.plans import adapters as A
from fleetfold.plans.adapters import EXIT_SQL, NOW_MS, STATE_ALL_SQL, STATE_SQL, with_tables
from fleetfold.plans.catalog import query

def _now():
    return F.lit(NOW_MS).cast("bigint")


def _members(spark, d):
    return ST.latest_members(A.pods(spark, d))


# --- predicates and projections ------------------------------------------------------------

@query("classify_state", with_tables("pods", body=f"""
SELECT seq, {STATE_SQL} AS state, {STATE_SQL} IN ('succeeded','failed','deleted','terminating') AS is_final FROM pods"""))
def classify_state(spark, d):
    return ST.classify_state(A.pods(spark, d)).select("seq", "state", "is_final")


@query("classify_state_all_containers", with_tables("pods", body=f"SELECT seq, {STATE_ALL_SQL} AS state FROM pods"))
def classify_state_all(spark, d):
    return ST.classify_state(A.pods(spark, d), check_all=True).select("seq", "state")


@query("is_deleted", with_tables("pods", body="""
SELECT seq, k < 5 AND lower(phase) NOT IN ('terminating','running') AS is_deleted FROM pods"""))
def is_deleted(spark, d):
    return A.pods(spark, d).select("seq", P.is_deleted().alias("is_deleted"))


@query("is_inactive", with_tables("pods", body="SELECT seq, inactive AS is_inactive FROM pods"))
def is_inactive(spark, d):
    return A.pods(spark, d).select("seq", P.is_inactive().alias("is_inactive"))


@query("resolve_entity", with_tables("pods", body="""
SELECT seq, CASE WHEN k % 29 <> 0 THEN exec_id END AS exec_id,
  CASE WHEN k % 29 = 0 THEN concat('no member id for x', CAST(exec_id AS VARCHAR)) END AS error FROM pods"""))
def resolve_entity(spark, d):
    return ST.resolve_entity(A.pods(spark, d)).select("seq", "exec_id", "error")


@query("entity_by_job", with_tables("pods", "jobs", body="""
SELECT p.seq, j.exec_id, CASE WHEN j.exec_id IS NULL THEN concat('no member id for job-', CAST(p.exec_id AS VARCHAR)) END AS error
FROM pods p LEFT JOIN jobs j ON p.app_id = j.app_id AND j.job_name = concat('job-', CAST(p.exec_id AS VARCHAR))"""))
def entity_by_job(spark, d):
    pods = A.pods(spark, d)
    return ST.entity_by_job(pods, A.jobs(pods), "job").select("seq", "exec_id", "error")


@query("exit_code", with_tables("pods", body=f"SELECT seq, {EXIT_SQL} AS exit_code FROM pods"))
def exit_code(spark, d):
    return A.pods(spark, d).select("seq", P.exit_code().alias("exit_code"))


_EXIT_SELECT = f"""SELECT app_id, exec_id, seq, ts_ms, state, exit_code, state <> 'deleted' AS by_app,
  CASE WHEN state = 'deleted' THEN concat('The executor with id ', CAST(exec_id AS VARCHAR), ' was deleted by a user or the framework.')
  ELSE concat(chr(10), 'The executor with id ', CAST(exec_id AS VARCHAR), ' exited with exit code ', CAST(exit_code AS VARCHAR), '.', chr(10),
    'The API gave the following brief reason: ', CASE WHEN k % 8 = 0 THEN 'Evicted' ELSE 'N/A' END, chr(10),
    'The API gave the following message: ', CASE WHEN k % 9 = 0 THEN 'out of room' ELSE 'N/A' END) END AS message_head
  FROM (SELECT *, {STATE_SQL} AS state, {EXIT_SQL} AS exit_code FROM pods)"""


def _message_head():
    return F.substring_index("exit_message", "\nThe API gave the following container", 1)


@query("exit_record", with_tables("pods", more={"x": _EXIT_SELECT}, body="""
SELECT seq, state, exit_code, by_app, message_head FROM x WHERE state IN ('deleted','failed','succeeded')"""))
def exit_record(spark, d):
    ended = ST.classify_state(A.pods(spark, d)).filter(F.col("state").isin("deleted", "failed", "succeeded"))
    return L.exit_record(ended).select("seq", "state", "exit_code", "by_app", _message_head().alias("message_head"))


_MAIN = """concat(chr(10), TAB, ' container name: spark-kubernetes-executor', chr(10), TAB, ' container image: image-', CAST(k % 4 AS VARCHAR),
  CASE WHEN main_exit IS NOT NULL THEN concat(chr(10), TAB, ' container state: terminated', chr(10), TAB, ' container started at: t', CAST(k AS VARCHAR),
    chr(10), TAB, ' container finished at: N/A', chr(10), TAB, ' exit code: ', CAST(main_exit AS VARCHAR), chr(10), TAB, ' termination reason: ',
    CASE WHEN main_exit <> 0 THEN 'Error' ELSE 'N/A' END)
  WHEN phase = 'Pending' THEN concat(chr(10), TAB, ' container state: waiting', chr(10), TAB, ' pending reason: ContainerCreating')
  ELSE concat(chr(10), TAB, ' container state: running', chr(10), TAB, ' container started at: t', CAST(k AS VARCHAR)) END)"""
_SIDE = """concat(chr(10), TAB, ' container name: sidecar', chr(10), TAB, ' container image: image-', CAST(k % 4 AS VARCHAR),
  CASE WHEN side_exit IS NOT NULL THEN concat(chr(10), TAB, ' container state: terminated', chr(10), TAB, ' container started at: t', CAST(k AS VARCHAR),
    chr(10), TAB, ' container finished at: N/A', chr(10), TAB, ' exit code: ', CAST(side_exit AS VARCHAR), chr(10), TAB, ' termination reason: ',
    CASE WHEN side_exit <> 0 THEN 'Error' ELSE 'N/A' END)
  ELSE concat(chr(10), TAB, ' container state: running', chr(10), TAB, ' container started at: t', CAST(k AS VARCHAR)) END)"""


def _summary_sql(tabs: int) -> str:
    tab = " || ".join(["chr(9)"] * tabs)
    main, side = _MAIN.replace("TAB", tab), _SIDE.replace("TAB", tab)
    return f"CASE WHEN k % 2 = 1 THEN concat({side}, chr(10), chr(10), {main}) ELSE concat({main}, chr(10), chr(10), {side}) END"


@query("container_summary", with_tables("pods", body=f"SELECT seq, {_summary_sql(1)} AS summary FROM pods"))
def container_summary(spark, d):
    return Q.container_summary(A.pods(spark, d)).select("seq", "summary")


def _line(label: str, value: str) -> str:
    return f"chr(10), chr(9), ' {label}: ', {value}"


_START_TIME = ("CASE WHEN k % 13 <> 0 THEN strftime(make_timestamp((ts_ms * 1000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' "
               "ELSE 'N/A' END")
_REPORT_SQL = "concat(" + ", ".join([
    _line("pod name", "name"),
    _line("namespace", "namespace"),
    _line("labels", """concat('job -> job-', CAST(exec_id AS VARCHAR), ', spark-app-selector -> ', app_id, ', spark-exec-id -> ',
      CASE WHEN k % 29 = 0 THEN 'x' ELSE '' END, CAST(exec_id AS VARCHAR), CASE WHEN inactive THEN ', spark-exec-inactive -> true' ELSE '' END,
      ', spark-exec-resourceprofile-id -> ', CAST(profile_id AS VARCHAR), ', spark-role -> ', role)"""),
    _line("pod uid", "concat('uid-', CAST(seq AS VARCHAR))"),
    _line("creation time", "concat('c', CAST(seq AS VARCHAR))"),
    _line("service account name", "CASE WHEN k % 6 = 0 THEN 'N/A' ELSE 'runner' END"),
    _line("volumes", "'scratch, conf'"),
    _line("node name", "CASE WHEN k % 5 <> 0 THEN concat('node-', CAST(k % 9 AS VARCHAR)) ELSE 'N/A' END"),
    _line("start time", _START_TIME),
    _line("phase", "phase"),
    _line("container status", _summary_sql(2)),
]) + ")"


@query("status_report", with_tables("pods", body=f"SELECT seq, {_REPORT_SQL} AS report FROM pods"))
def status_report(spark, d):
    return Q.status_report(A.pods(spark, d)).select("seq", "report")


@query("is_terminal_app", with_tables("watched", body="""
SELECT seq, phase IN ('Succeeded','Failed') AS is_terminal FROM watched"""))
def is_terminal_app(spark, d):
    return A.watched(spark, d).select("seq", P.is_terminal_app().alias("is_terminal"))


@query("is_terminal_job", with_tables("job_rows", body="""
SELECT seq, coalesce(phase, 'Unknown') AS job_phase,
  lower(coalesce(phase, 'Unknown')) IN ('aborted','terminated','failed','completed') AS is_terminal FROM job_rows"""))
def is_terminal_job(spark, d):
    return ST.last_job_phase(A.job_rows(spark, d)).select("seq", "job_phase", "is_terminal")


@query("select_labels", with_tables("pods", body="""
SELECT seq FROM pods WHERE role = 'executor' AND NOT inactive AND profile_id IN (0, 2, 4) AND phase = 'Running' AND namespace = 'ns-1'"""))
def select_labels(spark, d):
    return Q.select_labels(
        A.pods(spark, d),
        eq={S.ROLE_LABEL: S.EXECUTOR_ROLE},
        in_={S.PROFILE_LABEL: ["0", "2", "4"]},
        not_={S.INACTIVE_LABEL: "true"},
        phase="Running",
        namespace="ns-1",
    ).select("seq")


@query("select_labels_by_table", with_tables("pods", body="""
SELECT seq FROM pods WHERE CAST(exec_id AS VARCHAR) IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 12)
  AND k % 29 <> 0"""))
def select_labels_by_table(spark, d):
    wanted = A.table(spark, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").cast("string"))
    return Q.select_labels(A.pods(spark, d), in_={S.ID_LABEL: wanted}).select("seq")


@query("select_apps", with_tables("pods", body="""
SELECT seq, name FROM pods WHERE namespace = 'ns-1' AND starts_with(name, 'app-3-exec-1') AND role = 'driver'"""))
def select_apps(spark, d):
    return Q.select_apps(A.pods(spark, d), "ns-1:app-3-exec-1*").select("seq", "name")


# one request of every customer: exact names and prefixes, with and without a namespace
_REQUEST = ("CASE c_custkey % 4 WHEN 0 THEN concat('app-', CAST(c_custkey % 7 AS STRING), '-exec-', CAST(c_custkey AS STRING)) "
            "WHEN 1 THEN concat('ns-', CAST(c_custkey % 3 AS STRING), ':app-', CAST(c_custkey % 7 AS STRING), '-exec-', CAST(c_custkey AS STRING)) "
            "WHEN 2 THEN concat('app-', CAST(c_custkey % 9 AS STRING), '-exec-', CAST(c_custkey % 10 AS STRING), '*') "
            "ELSE concat('ns-', CAST(c_custkey % 4 AS STRING), ':app-', CAST(c_custkey % 7 AS STRING), '*') END")
_REQUEST_SQL = f"SELECT DISTINCT {_REQUEST} AS submission_id FROM customer"
_MATCH_SQL = """SELECT r.submission_id, p.* FROM
  (SELECT submission_id, CASE WHEN contains(submission_id, ':') THEN split_part(submission_id, ':', 1) END AS ns,
     CASE WHEN contains(submission_id, ':') THEN split_part(submission_id, ':', 2) ELSE submission_id END AS nm FROM requests) r
  JOIN pods p ON (r.ns IS NULL OR r.ns = p.namespace) AND
   CASE WHEN suffix(r.nm, '*') THEN p.role = 'driver' AND starts_with(p.name, r.nm[:-2]) ELSE p.name = r.nm END"""


def _requests(spark, d):
    return A.table(spark, d, "customer").select(F.expr(_REQUEST).alias("submission_id")).distinct()


@query("select_many_apps", with_tables("pods", more={"requests": _REQUEST_SQL, "m": _MATCH_SQL}, body="""
SELECT submission_id, seq FROM m"""))
def select_many_apps(spark, d):
    return Q.select_many_apps(A.pods(spark, d), _requests(spark, d)).select("submission_id", "seq")


STATUS_SQL = with_tables("latest", more={"requests": _REQUEST_SQL, "m": _MATCH_SQL.replace("JOIN pods p", "JOIN latest p")}, body="""
SELECT submission_id, true AS found, count(*) AS n FROM m GROUP BY submission_id
UNION ALL SELECT submission_id, false AS found, 1 AS n FROM requests WHERE submission_id NOT IN (SELECT submission_id FROM m)""")


@query("split_main_container", with_tables("pods", body="""
SELECT seq, CASE WHEN k % 2 = 1 THEN 'sidecar' ELSE 'spark-kubernetes-executor' END AS first_name,
 'sidecar' AS main_name, 1 AS n_sidecars, false AS fell_back FROM pods"""))
def split_main_container(spark, d):
    pods = A.pods(spark, d)
    named = ST.split_main_container(pods, "sidecar")
    unnamed = F.get("containers", F.lit(0))["name"]
    return named.select("seq", unnamed.alias("first_name"), F.col("main.name").alias("main_name"),
                        F.size("sidecars").alias("n_sidecars"), "fell_back")


@query("is_ready", with_tables("pods", body="SELECT seq, (k % 3 = 0 AND k % 4 <> 0) AS ready FROM pods"))
def is_ready(spark, d):
    return ST.is_ready(A.pods(spark, d)).select("seq", "ready")


# --- state ------------------------------------------------------------------------------------

@query("latest_state", with_tables("state", body="SELECT app_id, exec_id, profile_id, state, seq FROM state"))
def latest_state(spark, d):
    return _members(spark, d).select(*S.MEMBER, "profile_id", "state", "seq")


@query("latest_document", with_tables("latest", body="SELECT app_id, exec_id, seq, name, phase FROM latest"))
def latest_document(spark, d):
    columns = ["seq", "name", "phase"]
    return ST.latest_state(A.pods(spark, d), columns, order_by="event_time")


@query("fold_state", with_tables("folded", body=f"""
SELECT app_id, exec_id, profile_id, {STATE_SQL} AS state,
  CASE WHEN app_id IN (SELECT app_id FROM listing) THEN {A.LISTING_MS} ELSE 0 END AS full_sync_ts FROM folded"""))
def fold_state(spark, d):
    changes = A.by_time(A.pods(spark, d))
    folded = ST.fold_state(changes, A.listing(changes))
    return folded.select(*S.MEMBER, "profile_id", "state", "full_sync_ts")


@query("last_snapshot", with_tables("pods", more={"snap": """
SELECT *, CAST(ts_ms // 86400000 AS BIGINT) AS snapshot_no FROM pods""", "last": """
SELECT app_id, max(snapshot_no) AS m FROM snap GROUP BY app_id"""}, body="""
SELECT s.app_id, s.exec_id, count(*) AS n, CAST(sum(CASE WHEN s.snapshot_no = l.m THEN 1 ELSE 0 END) AS BIGINT) AS n_last
FROM snap s JOIN last l USING (app_id) GROUP BY s.app_id, s.exec_id"""))
def last_snapshot(spark, d):
    snaps = A.pods(spark, d).withColumn("snapshot_no", F.floor(F.col("ts_ms") / 86_400_000))
    current, seen = ST.last_snapshot(snaps.select(*S.MEMBER, "snapshot_no"))
    per_member = snaps.groupBy(*S.MEMBER).agg(F.count("*").alias("n"))
    last = current.groupBy(*S.MEMBER).agg(F.count("*").alias("n_last"))
    return seen.join(per_member, S.MEMBER).join(last, S.MEMBER, "left").withColumn(
        "n_last", F.coalesce("n_last", F.lit(0)).cast("bigint")
    )


# --- joins and sets -------------------------------------------------------------------------------

@query("unacked", with_tables("ledger", "state", body="""
SELECT l.* FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.app_id = l.app_id AND s.exec_id = l.exec_id)"""))
def unacked(spark, d):
    seen = A.pods(spark, d).select(*S.MEMBER).distinct()
    return R.unacked(A.ledger(spark, d), seen).select(*S.MEMBER, "profile_id", "created_ms")


@query("split_known", with_tables("ledger", "registrations", body="""
SELECT l.app_id, l.exec_id, l.profile_id, r.exec_id IS NOT NULL AS is_known FROM ledger l LEFT JOIN registrations r USING (app_id, exec_id)"""))
def split_known(spark, d):
    known = A.registrations(A.pods(spark, d))
    return R.split_known(A.ledger(spark, d), known).select(*S.MEMBER, "profile_id", "is_known")


_COUNTS_SQL = """SELECT app_id, profile_id, count_if(state = 'running') AS running,
  count_if(state = 'pending' AND r.exec_id IS NOT NULL) AS pending_known,
  count_if(state = 'pending' AND r.exec_id IS NULL) AS pending_unknown
  FROM state LEFT JOIN registrations r USING (app_id, exec_id) GROUP BY app_id, profile_id"""


def _counts(spark, d):
    return R.state_counts(R.split_known(_members(spark, d), A.registrations(A.pods(spark, d))))


@query("state_counts", with_tables("state", "registrations", body=f"""
SELECT app_id, profile_id, CAST(running AS BIGINT) AS running, CAST(pending_known AS BIGINT) AS pending_known,
 CAST(pending_unknown AS BIGINT) AS pending_unknown FROM ({_COUNTS_SQL})"""))
def state_counts(spark, d):
    return _counts(spark, d)


_STATUS = """SELECT t.app_id, t.profile_id, t.target, CAST(coalesce(running, 0) AS BIGINT) AS running,
  CAST(coalesce(pending_known, 0) AS BIGINT) AS pending_known, CAST(coalesce(pending_unknown, 0) AS BIGINT) AS pending_unknown,
  CAST(coalesce(ledger_known, 0) AS BIGINT) AS ledger_known, CAST(coalesce(ledger_unknown, 0) AS BIGINT) AS ledger_unknown
  FROM targets t LEFT JOIN cnt USING (app_id, profile_id) LEFT JOIN lc USING (app_id, profile_id)"""
_LEDGER_COUNTS = """SELECT l.app_id, l.profile_id, count_if(r.exec_id IS NOT NULL) AS ledger_known,
  count_if(r.exec_id IS NULL) AS ledger_unknown FROM (SELECT * FROM ledger l WHERE NOT EXISTS
   (SELECT 1 FROM state s WHERE s.app_id = l.app_id AND s.exec_id = l.exec_id)) l
  LEFT JOIN registrations r USING (app_id, exec_id) GROUP BY l.app_id, l.profile_id"""
_STATUS_TABLES = {"cnt": _COUNTS_SQL, "lc": _LEDGER_COUNTS, "status": _STATUS}
_KNOWN = "running + pending_known + pending_unknown + ledger_known + ledger_unknown"


def _status(spark, d):
    pods = A.pods(spark, d)
    known = A.registrations(pods)
    waiting = R.unacked(A.ledger(spark, d), pods.select(*S.MEMBER).distinct())
    counts = R.state_counts(R.split_known(ST.latest_members(pods), known))
    return R.profile_status(A.targets(spark, d), counts, R.ledger_counts(R.split_known(waiting, known)))


@query("profile_status", with_tables("state", "registrations", "ledger", "targets", more=_STATUS_TABLES, body=f"""
SELECT app_id, profile_id, target, running, pending_known, pending_unknown, ledger_known, ledger_unknown, {_KNOWN} AS known,
  greatest({_KNOWN} - target, 0) AS excess, greatest(target - ({_KNOWN}), 0) AS shortfall FROM status"""))
def profile_status(spark, d):
    return _status(spark, d).drop("idle_ledger", "idle_pending")


@query("known_count", with_tables("state", "registrations", "ledger", "targets", more=_STATUS_TABLES, body=f"""
SELECT app_id, profile_id, {_KNOWN} AS known FROM status"""))
def known_count(spark, d):
    return _status(spark, d).select("app_id", "profile_id", R.known_count().alias("known"))


def missing_text_sql(delta: int = S.MISSING_DELTA_MS) -> str:
    """The message of a missing member, built from the same fixed text."""
    return "printf('" + S.MISSING_TEXT.replace("%d ms) configured", f"{delta} ms) configured") + "', r.exec_id, r.registered_ms, CAST(" + str(A.LISTING_MS) + " AS BIGINT))"


@query("missing_members", with_tables("registrations", "folded", more={"gone": """
SELECT DISTINCT app_id, exec_id FROM pods WHERE k = 3"""}, body=f"""
SELECT r.app_id, r.exec_id, -1 AS exit_code, false AS by_app, CAST({A.LISTING_MS} AS BIGINT) AS sync_ts,
 {missing_text_sql()} AS exit_message FROM registrations r
WHERE r.app_id IN (SELECT app_id FROM listing) AND {A.LISTING_MS} - r.registered_ms > 30000
 AND NOT EXISTS (SELECT 1 FROM folded f WHERE f.app_id = r.app_id AND f.exec_id = r.exec_id)
 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.app_id = r.app_id AND g.exec_id = r.exec_id)"""))
def missing_members(spark, d):
    changes = A.by_time(A.pods(spark, d))
    full = A.listing(changes)
    gone = changes.filter(F.col("deletion_ts").isNotNull() & (F.col("containers")[0]["image"] == "image-3"))
    gone = gone.select(*S.MEMBER)
    found = L.missing_members(
        A.registrations(changes), ST.fold_state(changes, full), full, gone, gone
    )
    return found.select(*S.MEMBER, "exit_code", "by_app", "sync_ts", "exit_message")


@query("jobs_to_delete", with_tables("state", "ledger", "jobs", body="""
SELECT j.app_id, j.exec_id, j.job_name FROM jobs j JOIN state s USING (app_id, exec_id) WHERE s.state = 'pending' AND j.exec_id % 2 = 0"""))
def jobs_to_delete(spark, d):
    pods = A.pods(spark, d)
    state = ST.latest_members(pods)
    chosen = pods.filter("exec_id % 2 = 0").select(*S.MEMBER)
    return R.jobs_to_delete(chosen, state.filter("state = 'pending'"), A.jobs(pods))


@query("force_kill_set", with_tables("state", "registrations", body=f"""
SELECT r.app_id, r.exec_id FROM registrations r JOIN state s USING (app_id, exec_id)
WHERE s.state = 'running' AND {NOW_MS} - r.registered_ms >= 2500000000"""))
def force_kill_set(spark, d):
    pods = A.pods(spark, d)
    asked = A.registrations(pods).withColumnRenamed("registered_ms", "requested_ms")
    return R.force_kill_set(asked, ST.latest_members(pods), _now(), grace_ms=2_500_000_000).select(*S.MEMBER)


@query("ownership", """
SELECT o.o_orderkey, c.c_name AS owner_name, CASE WHEN c.c_custkey IS NULL THEN 'orphan' WHEN c.c_acctbal < 0 THEN 'cascade' ELSE 'owned' END AS ownership
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_custkey % 10 <> 0""")
def ownership(spark, d):
    key = F.col("o_custkey").cast("string")
    resources = A.table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("uid"),
        F.when(F.col("o_custkey") % 10 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("owner_uid"),
    )
    customer = A.table(spark, d, "customer")
    owners = customer.select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_name").alias("name"))
    gone = customer.filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("uid"))
    return L.ownership(resources, owners, gone).select("o_orderkey", "owner_name", "ownership")


@query("ids_except", with_tables("registrations", "state", "ledger", body="""
SELECT app_id, exec_id FROM registrations WHERE (app_id, exec_id) NOT IN (SELECT (app_id, exec_id) FROM state WHERE state = 'failed')
 AND (app_id, exec_id) NOT IN (SELECT (app_id, exec_id) FROM ledger)"""))
def ids_except(spark, d):
    pods = A.pods(spark, d)
    failed = ST.latest_members(pods).filter("state = 'failed'")
    return R.ids_except(A.registrations(pods), failed, A.ledger(spark, d)).select(*S.MEMBER)


@query("ids_intersect", with_tables("ledger", "state", body="""
SELECT l.app_id, l.exec_id FROM ledger l JOIN state s USING (app_id, exec_id)"""))
def ids_intersect(spark, d):
    return R.ids_intersect(A.ledger(spark, d), A.pods(spark, d)).select(*S.MEMBER)


@query("ids_union", with_tables("ledger", "registrations", body="""
SELECT app_id, exec_id FROM ledger UNION SELECT app_id, exec_id FROM registrations"""))
def ids_union(spark, d):
    return R.ids_union(A.ledger(spark, d), A.registrations(A.pods(spark, d)))


@query("sorted_ids", with_tables("ledger", body="SELECT app_id, exec_id FROM ledger ORDER BY app_id, exec_id"))
def sorted_ids(spark, d):
    return R.sorted_ids(A.ledger(spark, d).select(*S.MEMBER))


@query("registration_ready", with_tables("e0", more={"init": """
SELECT app_id, count(DISTINCT exec_id) * (1 + CAST(right(app_id, 1) AS INT)) // 4 AS initial FROM e0 GROUP BY app_id""",
"reg": "SELECT app_id, count(DISTINCT exec_id) AS registered FROM e0 WHERE exec_id % 3 <> 0 GROUP BY app_id"}, body="""
SELECT app_id, CAST(initial AS BIGINT) AS initial, coalesce(registered, 0) AS registered,
 coalesce(registered, 0) >= CAST(initial AS DOUBLE) * CAST(0.8 AS DOUBLE) AS ready FROM init LEFT JOIN reg USING (app_id)"""))
def registration_ready(spark, d):
    pods = A.pods(spark, d)
    initial = pods.groupBy("app_id").agg(F.count_distinct("exec_id").alias("n")).select(
        "app_id", F.expr("n * (1 + cast(right(app_id, 1) as int)) div 4").alias("initial")
    )
    return R.registration_ready(A.registrations(pods), initial)


@query("name_prefixes", with_tables("pods", body="""
SELECT app_id, count(DISTINCT prefix) AS n_prefixes, count(DISTINCT prefix) = 1 AS ok
FROM (SELECT app_id, CASE WHEN app_id = 'app-2' AND exec_id % 2 = 0 THEN 'other' ELSE concat(app_id, '-exec') END AS prefix FROM pods)
GROUP BY app_id"""))
def name_prefixes(spark, d):
    from fleetfold.operators.names import name_prefixes as op

    odd = (F.col("app_id") == "app-2") & (F.col("exec_id") % 2 == 0)
    return op(A.pods(spark, d).withColumn("name", F.when(odd, F.concat(F.lit("other-"), "exec_id")).otherwise(F.col("name"))))


# --- time limits -------------------------------------------------------------------------------------

@query("creation_timeouts", with_tables("ledger", body=f"""
SELECT app_id, exec_id, profile_id FROM ledger WHERE {NOW_MS} - created_ms > 600000"""))
def creation_timeouts(spark, d):
    return R.creation_timeouts(A.ledger(spark, d), _now()).select(*S.MEMBER, "profile_id")


@query("idle_pending", with_tables("state", body=f"""
SELECT app_id, exec_id FROM state WHERE state = 'pending' AND (start_ms IS NULL OR {NOW_MS} - start_ms > 172800000)"""))
def idle_pending(spark, d):
    return R.idle_pending(_members(spark, d), _now(), idle_ms=172_800_000).select(*S.MEMBER)


# --- reconcile ----------------------------------------------------------------------------------------

IDLE_MS = 60_000
_CYCLE = {
    "mem": f"""SELECT coalesce(s.app_id, l.app_id) AS app_id, coalesce(s.exec_id, l.exec_id) AS exec_id,
      coalesce(s.profile_id, l.profile_id) AS profile_id, s.exec_id IS NOT NULL AS in_state, s.state, s.start_ms, l.created_ms,
      r.exec_id IS NOT NULL AS registered
      FROM state s FULL JOIN ledger l ON s.app_id = l.app_id AND s.exec_id = l.exec_id
      LEFT JOIN registrations r ON r.app_id = coalesce(s.app_id, l.app_id) AND r.exec_id = coalesce(s.exec_id, l.exec_id)""",
    "fl": f"""SELECT *, in_state AND state = 'running' AS running, in_state AND state = 'pending' AND registered AS pending_known,
      in_state AND state = 'pending' AND NOT registered AS pending_unknown, NOT in_state AND registered AS ledger_known,
      NOT in_state AND NOT registered AND {NOW_MS} - created_ms > 600000 AS late,
      NOT in_state AND NOT registered AND {NOW_MS} - created_ms <= 600000 AS ledger_unknown FROM mem""",
    "idle": f"""SELECT *, ledger_unknown AND {NOW_MS} - created_ms > {IDLE_MS} AS idle_ledger,
      pending_unknown AND (start_ms IS NULL OR {NOW_MS} - start_ms > {IDLE_MS}) AS idle_pending FROM fl""",
    "st": """SELECT t.app_id, t.profile_id, t.target, coalesce(n_known, 0) AS known, coalesce(n_lu, 0) AS ledger_unknown,
      coalesce(n_pu, 0) AS pending_unknown, coalesce(n_il, 0) AS idle_ledger, coalesce(n_ip, 0) AS idle_pending,
      greatest(coalesce(n_known, 0) - t.target, 0) AS excess,
      CASE WHEN coalesce(n_lu, 0) = 0 THEN least(greatest(t.target - coalesce(n_known, 0), 0), BATCH) ELSE 0 END AS requests
      FROM targets t LEFT JOIN (SELECT app_id, profile_id,
        count_if(running OR pending_known OR pending_unknown OR ledger_known OR ledger_unknown) AS n_known,
        count_if(ledger_unknown) AS n_lu, count_if(pending_unknown) AS n_pu, count_if(idle_ledger) AS n_il, count_if(idle_pending) AS n_ip
        FROM idle GROUP BY app_id, profile_id) USING (app_id, profile_id)""",
    "trim": """SELECT app_id, profile_id, exec_id, source FROM (SELECT i.*, s.excess,
      row_number() OVER (PARTITION BY app_id, profile_id ORDER BY source, at_ms NULLS FIRST, exec_id) AS rn
      FROM (SELECT app_id, profile_id, exec_id, CASE WHEN idle_ledger THEN 0 ELSE 1 END AS source,
        CASE WHEN idle_ledger THEN created_ms ELSE start_ms END AS at_ms FROM idle WHERE idle_ledger OR idle_pending) i
      JOIN st s USING (app_id, profile_id)) WHERE rn <= excess""",
    "top": "SELECT app_id, max(exec_id) AS last_id FROM state GROUP BY app_id",
    "req": """SELECT app_id, profile_id, coalesce(last_id, 0) + CAST(coalesce(sum(requests) OVER (PARTITION BY app_id ORDER BY profile_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + unnest(range(1, CAST(requests AS BIGINT) + 1)) AS exec_id
      FROM st LEFT JOIN top USING (app_id)""",
}


def _cycle_sql(body: str, batch: str = "5", scale: int = 1) -> str:
    more = {n: q.replace("BATCH", batch).replace("t.target", f"t.target * {scale}") for n, q in _CYCLE.items()}
    return with_tables("state", "ledger", "registrations", "targets", more=more, body=body)


def _cycle(spark, d, scale=1, **options):
    pods = A.pods(spark, d)
    state = ST.latest_members(pods)
    last_ids = state.groupBy("app_id").agg(F.max("exec_id").alias("last_id"))
    return R.reconcile(
        state, A.targets(spark, d).withColumn("target", F.col("target") * scale),
        A.ledger(spark, d), A.registrations(pods), _now(),
        last_ids=last_ids, idle_ms=IDLE_MS, **options,
    )


@query("reconcile", _cycle_sql("""
SELECT app_id, profile_id, 'time_out' AS decision, exec_id FROM idle WHERE late
UNION ALL SELECT app_id, profile_id, 'delete' AS decision, exec_id FROM trim
UNION ALL SELECT app_id, profile_id, 'request' AS decision, exec_id FROM req"""))
def reconcile(spark, d):
    return _cycle(spark, d).decisions()


@query("trim_excess", _cycle_sql("SELECT app_id, profile_id, exec_id, source FROM trim"))
def trim_excess(spark, d):
    return _cycle(spark, d).trimmed


@query("request_plan", _cycle_sql("SELECT app_id, profile_id, exec_id FROM req"))
def request_plan(spark, d):
    return _cycle(spark, d).requests


@query("request_plan_batch_mode", _cycle_sql("SELECT app_id, profile_id, exec_id FROM req", batch="1000000000", scale=20))
def request_plan_batch_mode(spark, d):
    return _cycle(spark, d, scale=20, batch_mode=True).requests


@query("outstanding", _cycle_sql("""
SELECT app_id, CAST(sum(n) AS BIGINT) AS outstanding FROM (
 SELECT app_id, pending_unknown AS n FROM st UNION ALL SELECT app_id, requests FROM st
 UNION ALL SELECT app_id, -1 FROM trim UNION ALL SELECT app_id, 1 FROM idle WHERE ledger_unknown)
WHERE app_id IN (SELECT app_id FROM targets) GROUP BY app_id"""))
def outstanding(spark, d):
    return _cycle(spark, d).outstanding


@query("ledger_after_cycle", _cycle_sql(f"""
SELECT app_id, exec_id, profile_id, created_ms FROM idle WHERE ledger_unknown
 AND NOT EXISTS (SELECT 1 FROM trim t WHERE t.app_id = idle.app_id AND t.exec_id = idle.exec_id)
UNION ALL SELECT app_id, exec_id, profile_id, {NOW_MS} FROM req"""))
def ledger_after_cycle(spark, d):
    return _cycle(spark, d).ledger


# --- lifecycle ------------------------------------------------------------------------------------------

@query("lifecycle_events", with_tables("pods", more={"x": f"SELECT *, {STATE_SQL} AS state, {EXIT_SQL} AS exit_code FROM pods"}, body="""
SELECT app_id, exec_id, seq, state, exit_code, state <> 'deleted' AS by_app, CASE WHEN state <> 'deleted' THEN 'delete' END AS cleanup
FROM x WHERE NOT inactive AND state IN ('deleted','failed','succeeded')"""))
def lifecycle_events(spark, d):
    return L.lifecycle_events(A.pods(spark, d)).select(
        *S.MEMBER, "seq", "state", "exit_code", "by_app", "cleanup"
    )


REMOVAL_TTL = 8 * 3_600_000
REMOVAL_SQL = with_tables("pods", recursive=True, more={
    "x": f"""SELECT app_id, exec_id, ts_ms, seq FROM (SELECT *, {STATE_SQL} AS state FROM pods)
      WHERE NOT inactive AND state IN ('deleted','failed','succeeded')""",
    "ev": "SELECT app_id, exec_id, ts_ms AS t, min(seq) AS seq FROM x GROUP BY app_id, exec_id, ts_ms",
    "nxt": f"""SELECT a.app_id, a.exec_id, a.t, min(b.t) AS next_t FROM ev a JOIN ev b
      ON a.app_id = b.app_id AND a.exec_id = b.exec_id AND a.t + {REMOVAL_TTL} <= b.t GROUP BY a.app_id, a.exec_id, a.t""",
    "chain": """SELECT app_id, exec_id, min(t) AS t FROM ev GROUP BY app_id, exec_id
      UNION ALL SELECT n.app_id, n.exec_id, n.next_t AS t FROM chain c JOIN nxt n ON c.app_id = n.app_id AND c.exec_id = n.exec_id AND c.t = n.t""",
}, body="SELECT c.app_id, c.exec_id, c.t AS ts_ms, e.seq FROM chain c JOIN ev e ON c.app_id = e.app_id AND c.exec_id = e.exec_id AND c.t = e.t")


@query("removal_once", REMOVAL_SQL)
def removal_once(spark, d):
    return L.removal_once(L.lifecycle_events(A.pods(spark, d)), REMOVAL_TTL)


_ENDS = """SELECT app_id, seq, action, phase FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY seq) AS rn
 FROM watched WHERE action IN ('DELETED','ERROR') OR phase IN ('Succeeded','Failed')) WHERE rn = 1"""


@query("first_terminal", with_tables("watched", body=_ENDS))
def first_terminal(spark, d):
    return L.first_terminal(A.watched(spark, d)).select("app_id", "seq", "action", "phase")


FIRST_TERMINAL_SQL = with_tables("watched", body=_ENDS)


@query("app_status", with_tables("watched", more={"apps": """
SELECT concat('u', CAST(c_custkey AS VARCHAR)) AS app_id FROM customer""", "lastp": """
SELECT app_id, arg_max(phase, seq) AS phase FROM watched GROUP BY app_id"""}, body="""
SELECT app_id, coalesce(phase, 'unknown') AS phase, coalesce(phase IN ('Succeeded','Failed'), false) AS is_terminal
FROM apps LEFT JOIN lastp USING (app_id)"""))
def app_status(spark, d):
    apps = A.table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("app_id"))
    return L.app_status(apps, A.watched(spark, d))


@query("index_within", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) - 1 AS idx FROM orders""")
def index_within(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("g"))
    placed = V.index_within(rows, ["g"], ["o_orderkey"], [F.floor(F.col("o_orderkey") / 4096)])
    return placed.select("o_orderkey", "idx")
