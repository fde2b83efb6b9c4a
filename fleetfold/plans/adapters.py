"""The driver's tables seen as the model of ``fleetfold.schema``.

Every adapter has a SQL twin in :data:`CTES` that the checking queries build on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold import schema as S

NOW_MS = 1_706_659_200_000       # 2024-01-31 00:00 UTC
LISTING_MS = 1_706_572_800_000   # 2024-01-30 00:00 UTC
LISTING_SPAN_MS = 3 * 3_600_000
PREFIX_VOLUMES = "spark.kubernetes.executor.volumes."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(raw: DataFrame) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return raw.select(
        F.concat(F.lit("app-"), (F.col("user_id") % 7).cast("string")).alias("app_id"),
        F.col("user_id").alias("exec_id"),
        (F.col("user_id") % 5).cast("int").alias("profile_id"),
        F.col("event_id").alias("seq"),
        us.alias("ts_us"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("ts_ms"),
        "event_type",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def pod_rows(raw: DataFrame) -> DataFrame:
    """Documents in the shape of ``schema.POD`` (plus ``ts_us``) from event rows."""
    k, kind = F.col("k"), F.col("event_type")
    phase = (
        F.when(kind == "signup", "Pending")
        .when(kind.isin("view", "click"), "Running")
        .when(kind == "purchase", "Succeeded")
        .otherwise("Failed")
    )
    main_exit = F.when(
        kind.isin("purchase", "error") | ((kind == "click") & (k % 10 == 0)), k % 3
    )
    side_exit = F.when(k % 11 == 0, 1).when(kind == "error", 0)
    started = F.concat(F.lit("t"), k.cast("string"))

    def container(name: str, code: Column, idle: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.concat(F.lit("image-"), (k % 4).cast("string")).alias("image"),
            F.when(code.isNull() & ~idle, F.struct(started.alias("started_at"))).alias("running"),
            F.when(code.isNotNull(), F.struct(
                started.alias("started_at"), F.lit(None).cast("string").alias("finished_at"),
                code.cast("int").alias("exit_code"),
                F.when(code != 0, "Error").alias("reason"),
            )).alias("terminated"),
            F.when(code.isNull() & idle, F.struct(F.lit("ContainerCreating").alias("reason"))).alias("waiting"),
        )

    main = container(S.EXECUTOR_CONTAINER, main_exit, phase == "Pending")
    side = container("sidecar", side_exit, F.lit(False))
    text = F.col("exec_id").cast("string")
    labels = F.map_concat(
        F.create_map(
            F.lit(S.APP_LABEL), F.col("app_id"),
            F.lit(S.ID_LABEL), F.when(k % 29 == 0, F.concat(F.lit("x"), text)).otherwise(text),
            F.lit(S.ROLE_LABEL), F.when(k % 7 == 0, S.DRIVER_ROLE).otherwise(S.EXECUTOR_ROLE),
            F.lit(S.PROFILE_LABEL), F.col("profile_id").cast("string"),
            F.lit("job"), F.concat(F.lit("job-"), text),
        ),
        F.when(k >= 95, F.create_map(F.lit(S.INACTIVE_LABEL), F.lit("true"))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    )
    none = F.lit(None)
    return event_rows(raw).select(
        "app_id", "exec_id", "profile_id", "seq", "ts_ms", "ts_us",
        none.cast("bigint").alias("sync_ts"),
        F.when(k == 1, "DELETED").otherwise("MODIFIED").alias("action"),
        F.concat("app_id", F.lit("-exec-"), text).alias("name"),
        F.concat(F.lit("ns-"), (F.col("exec_id") % 3).cast("string")).alias("namespace"),
        F.concat(F.lit("uid-"), F.col("seq").cast("string")).alias("uid"),
        labels.alias("labels"),
        F.concat(F.lit("c"), F.col("seq").cast("string")).alias("creation_ts"),
        F.when(k < 5, "2024-01-31T00:00:00Z").alias("deletion_ts"),
        F.when(k % 2 == 0, "Never").otherwise("Always").alias("restart_policy"),
        F.when(k % 6 == 0, "").otherwise("runner").alias("service_account"),
        F.array(F.lit("scratch"), F.lit("conf")).alias("volumes"),
        F.when(k % 5 != 0, F.concat(F.lit("node-"), (k % 9).cast("string"))).alias("node_name"),
        phase.alias("phase"),
        F.when(k % 8 == 0, "Evicted").alias("reason"),
        F.when(k % 9 == 0, "out of room").alias("message"),
        F.when(
            k % 13 != 0,
            F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        ).alias("start_time"),
        F.when(k % 2 == 1, F.array(side, main)).otherwise(F.array(main, side)).alias("containers"),
        F.array(F.struct(
            F.when(k % 3 == 0, "Ready").otherwise("Initialized").alias("type"),
            F.when(k % 4 == 0, "False").otherwise("True").alias("status"),
        )).alias("conditions"),
        F.when(k % 7 == 0, S.DRIVER_ROLE).otherwise(S.EXECUTOR_ROLE).alias("role"),
        (k >= 95).alias("inactive"),
        F.concat(F.lit("job-"), text).alias("job_name"),
        none.cast("bigint").alias("listing_rows"),
    )


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pod_rows(table(spark, sf_dir, "events"))


def by_time(documents: DataFrame) -> DataFrame:
    """Number arrivals by microsecond, so that listings can be placed among them."""
    return documents.withColumn("seq", F.col("ts_us"))


def listing(documents: DataFrame) -> DataFrame:
    """A full listing: active members that changed in the three hours before it."""
    recent = documents.filter(
        (F.col("ts_ms") >= LISTING_MS - LISTING_SPAN_MS) & (F.col("ts_ms") < LISTING_MS)
    )
    columns = [c for c in documents.columns if c not in S.MEMBER]
    last = recent.groupBy(*S.MEMBER).agg(F.max_by(F.struct(*columns), "seq").alias("d")).select(*S.MEMBER, "d.*")
    return last.filter(~F.col("labels")[S.INACTIVE_LABEL].eqNullSafe("true")).withColumns({
        "sync_ts": F.lit(LISTING_MS).cast("bigint"),
        "seq": F.lit(LISTING_MS * 1000).cast("bigint"),
    })


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every app of the events wants ``r_regionkey + 1`` members of each profile."""
    apps = table(spark, sf_dir, "events").select(
        F.concat(F.lit("app-"), (F.col("user_id") % 7).cast("string")).alias("app_id")
    ).distinct()
    profiles = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("profile_id")
    return apps.select("app_id", profiles).withColumn("target", F.col("profile_id") + 1)


def registrations(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("exec_id") % 3 != 0).groupBy(*S.MEMBER).agg(
        F.min("ts_ms").alias("registered_ms")
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("app-"), (key % 7).cast("string")).alias("app_id"),
        (key + 70).alias("exec_id"),
        (key % 5).cast("int").alias("profile_id"),
        (F.lit(NOW_MS) - key * 30000).cast("bigint").alias("created_ms"),
    )


def jobs(documents: DataFrame) -> DataFrame:
    """One job per member; every ninth member's job is unknown."""
    ids = documents.filter(F.col("exec_id") % 9 != 0).select(*S.MEMBER).distinct()
    return ids.select(
        "app_id", "exec_id", F.concat(F.lit("job-"), F.col("exec_id").cast("string")).alias("job_name")
    )


# --- configuration ---------------------------------------------------------------------
# key, value and condition are expressions both engines read the same way

PART_CONF = [
    ("spark.kubernetes.driver.label.team", "p_brand", "true"),
    ("spark.kubernetes.driver.label.spark-role", "'mine'", "p_partkey % 17 = 0"),
    ("spark.kubernetes.executor.label.size", "CAST(p_size AS STRING)", "true"),
    ("spark.kubernetes.executor.label.spark-exec-id", "'1'", "p_partkey % 19 = 0"),
    ("spark.executorEnv.GOOD_KEY", "p_type", "true"),
    ("spark.executorEnv.9BAD", "p_type", "p_partkey % 3 = 0"),
    ("spark.executorEnv.ba*d", "p_type", "p_partkey % 4 = 0"),
    ("spark.kubernetes.namespace", "concat('ns-', p_type)", "p_partkey % 6 <> 0"),
    ("spark.kubernetes.allocation.batch.size", "CAST(p_size - 2 AS STRING)", "p_partkey % 2 = 0"),
    ("spark.kubernetes.allocation.batch.delay",
     "CASE WHEN p_partkey % 5 = 0 THEN '2s' WHEN p_partkey % 5 = 1 THEN '500ms' "
     "WHEN p_partkey % 5 = 2 THEN '1m' WHEN p_partkey % 5 = 3 THEN 'soon' ELSE '-1s' END", "p_size > 10"),
    ("spark.kubernetes.memoryOverheadFactor",
     "CASE WHEN p_size % 10 = 0 THEN '1.5' ELSE '0.5' END", "p_size % 5 = 0"),
    ("spark.kubernetes.container.image", "concat('img-', p_brand)", "p_partkey % 4 <> 0"),
    ("spark.kubernetes.driver.container.image", "'own'", "p_partkey % 6 = 0"),
    ("spark.kubernetes.container.image.pullPolicy",
     "CASE WHEN p_size % 3 = 0 THEN 'Sometimes' ELSE 'Always' END", "p_partkey % 3 = 1"),
    ("spark.kubernetes.pyspark.pythonVersion",
     "CASE WHEN p_size % 2 = 0 THEN '3' ELSE '2' END", "p_partkey % 7 = 0"),
    ("spark.kubernetes.resource.type",
     "CASE WHEN p_partkey % 3 = 0 THEN 'java' WHEN p_partkey % 3 = 1 THEN 'python' ELSE 'r' END",
     "p_partkey % 8 <> 0"),
    ("spark.kubernetes.executor.deleteOnTermination",
     "CASE WHEN p_size % 2 = 0 THEN 'False' ELSE 'maybe' END", "p_partkey % 9 = 0"),
    ("spark.driver.port", "CASE WHEN p_size % 2 = 0 THEN '80' ELSE '7000' END", "p_partkey % 8 = 0"),
    ("spark.driver.blockManager.port", "'7100'", "p_partkey % 9 = 0"),
    ("spark.blockManager.port", "CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '0' END", "p_partkey % 4 = 1"),
    ("spark.pyspark.python", "'python3'", "p_partkey % 5 = 1"),
    ("spark.pyspark.driver.python", "'python4'", "p_partkey % 10 = 1"),
    ("spark.local.dir", "'/a,/b'", "p_partkey % 10 = 3"),
    ("spark.kubernetes.kerberos.krb5.path", "'/etc/k'", "p_partkey % 3 = 0"),
    ("spark.kubernetes.kerberos.krb5.configMapName", "'krb'", "p_partkey % 4 = 0"),
    ("spark.kubernetes.kerberos.tokenSecret.name", "'sec'", "p_partkey % 5 = 0"),
    ("spark.kubernetes.kerberos.tokenSecret.itemKey", "'item'", "p_partkey % 10 = 5"),
]
PART_ENV = [
    ("PYSPARK_PYTHON", "'/usr/bin/python3'", "p_partkey % 6 = 0"),
    ("PYSPARK_DRIVER_PYTHON", "'/usr/bin/python4'", "p_partkey % 14 = 0"),
    ("SPARK_LOCAL_DIRS", "'/e1,/e2,/e3'", "p_partkey % 12 = 0"),
]
OPTION_RULES = [
    ("not_both", "spark.kubernetes.kerberos.krb5.path", "spark.kubernetes.kerberos.krb5.configMapName"),
    ("both_or_neither", "spark.kubernetes.kerberos.tokenSecret.name",
     "spark.kubernetes.kerberos.tokenSecret.itemKey"),
    ("second_if_first", "spark.pyspark.driver.python", "spark.kubernetes.container.image"),
]
VOLUME_TYPE = (
    "CASE WHEN s_suppkey % 5 = 0 THEN 'hostPath' WHEN s_suppkey % 5 = 1 THEN 'persistentVolumeClaim' "
    "WHEN s_suppkey % 5 = 2 THEN 'emptyDir' WHEN s_suppkey % 5 = 3 THEN 'nfs' ELSE 'floppy' END"
)
SUPPLIER_VOLUMES = [
    ("mount.path", "concat('/data', CAST(s_suppkey % 3 AS STRING))", "s_suppkey % 13 <> 0"),
    ("mount.readOnly", "CASE WHEN s_suppkey % 8 = 0 THEN 'yes' ELSE 'True' END", "s_suppkey % 4 = 0"),
    ("mount.subPath", "'sub'", "s_suppkey % 6 = 0"),
    ("options.path", "'/mnt'", "s_suppkey % 7 <> 0"),
    ("options.claimName",
     "CASE WHEN s_suppkey % 2 = 0 THEN 'OnDemand' ELSE 'claim-SPARK_EXECUTOR_ID' END", "s_suppkey % 11 <> 0"),
    ("options.storageClass", "'fast'", "s_suppkey % 3 = 1"),
    ("options.sizeLimit", "'1Gi'", "s_suppkey % 2 = 1"),
    ("options.medium", "'Memory'", "s_suppkey % 10 = 2"),
    ("options.server", "'nfs.example'", "s_suppkey % 9 <> 0"),
]


def _entries(df: DataFrame, app: str, entries: list[tuple[str, str, str]], prefix: str = "''") -> DataFrame:
    pairs = [
        F.when(F.expr(cond), F.struct(F.expr(f"concat({prefix}, '{key}')").alias("key"),
                                      F.expr(value).alias("value")))
        for key, value, cond in entries
    ]
    return df.select(F.expr(app).alias("app_id"), F.explode(F.array_compact(F.array(*pairs))).alias("e")).select(
        "app_id", "e.*"
    )


def _entries_sql(source: str, app: str, entries: list[tuple[str, str, str]], prefix: str = "''") -> str:
    return " UNION ALL ".join(
        f"SELECT {app} AS app_id, concat({prefix}, '{key}') AS key, {value} AS value FROM {source} WHERE {cond}"
        for key, value, cond in entries
    )


_PART_APP = "concat('p', CAST(p_partkey AS STRING))"
_SUPP_APP = "concat('n', CAST(s_nationkey AS STRING))"
_SUPP_PREFIX = f"concat('{PREFIX_VOLUMES}', {VOLUME_TYPE}, '.v', CAST(s_suppkey AS STRING), '.')"


def part_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(table(spark, sf_dir, "part"), _PART_APP, PART_CONF)


def part_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(table(spark, sf_dir, "part"), _PART_APP, PART_ENV)


def volume_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(table(spark, sf_dir, "supplier"), _SUPP_APP, SUPPLIER_VOLUMES, _SUPP_PREFIX)


APP_SIZES = [
    ("app_id", _PART_APP),
    ("memory_mib", "CAST(256 * (1 + p_size % 16) AS BIGINT)"),
    ("factor", "CASE WHEN p_size % 5 = 0 THEN CAST(p_size % 9 AS DOUBLE) / CAST(10 AS DOUBLE) END"),
    ("kind", "CASE WHEN p_partkey % 3 = 0 THEN 'java' WHEN p_partkey % 3 = 1 THEN 'python' ELSE 'r' END"),
    ("overhead_mib", "CASE WHEN p_partkey % 7 = 0 THEN CAST(700 AS BIGINT) END"),
    ("offheap_mib", "CASE WHEN p_partkey % 5 = 0 THEN CAST(42 AS BIGINT) END"),
    ("pyspark_mib", "CASE WHEN p_partkey % 4 = 0 THEN CAST(100 AS BIGINT) END"),
    ("cores", "1 + p_size % 4"),
    ("request_cores", "CASE WHEN p_partkey % 6 = 0 THEN '0.5' END"),
    ("limit_cores", "CASE WHEN p_partkey % 4 = 0 THEN '2' END"),
]


def app_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*[F.expr(e).alias(n) for n, e in APP_SIZES])


PROFILE_SIZES = [
    ("app_id", _PART_APP),
    ("profile_id", "profile_id"),
    ("memory_mib", "CASE WHEN (p_partkey + profile_id) % 2 = 0 THEN CAST(2048 AS BIGINT) END"),
    ("overhead_mib", "CASE WHEN (p_partkey + profile_id) % 3 = 0 THEN CAST(1024 AS BIGINT) END"),
    ("offheap_mib", "CASE WHEN (p_partkey + profile_id) % 5 = 0 THEN CAST(10 AS BIGINT) END"),
    ("pyspark_mib", "CASE WHEN (p_partkey + profile_id) % 4 = 0 THEN CAST(3072 AS BIGINT) END"),
    ("cores", "CASE WHEN profile_id = 2 THEN 4 END"),
]


def profile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "part").select(
        "p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("profile_id")
    )
    return profiles.select(*[F.expr(e).alias(n) for n, e in PROFILE_SIZES])


def name_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*[F.expr(e).alias(n) for n, e in NAME_MEMBERS])


NAME_MEMBERS = [
    ("app_id", "concat('c', CAST(c_custkey AS STRING))"),
    ("app_name", "concat('  ', repeat(c_mktsegment, CAST(1 + c_custkey % 7 AS INT)), ' My.App  (', c_name, ')--x')"),
    ("run_id", "CAST(c_custkey AS STRING)"),
    ("exec_id", "c_custkey % 50"),
    ("job_prefix", "concat('job-', CAST(c_nationkey AS STRING))"),
]


def conf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("app_id"),
        F.concat(F.lit("file-"), F.col("doc_id").cast("string"), F.lit(".conf")).alias("file_name"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.col("text").alias("content"),
    )


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watched_rows(event_rows(table(spark, sf_dir, "events")))


def watched_rows(e: DataFrame) -> DataFrame:
    """Application events: one app per user, phases and actions as a watch reports them."""
    return e.select(
        F.concat(F.lit("u"), F.col("exec_id").cast("string")).alias("app_id"),
        "seq", "ts_ms",
        F.when(F.col("k") == 1, "DELETED").when(F.col("k") == 2, "ERROR").otherwise("MODIFIED").alias("action"),
        F.when(F.col("event_type") == "purchase", F.when(F.col("k") % 2 == 0, "Succeeded").otherwise("succeeded"))
        .when(F.col("event_type") == "error", "Failed").otherwise("Running").alias("phase"),
    )


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(table(spark, sf_dir, "events"))
    phase = (
        F.when(F.col("k") % 6 == 0, "Aborted").when(F.col("k") % 6 == 1, "Completed")
        .when(F.col("k") % 6 == 2, "TERMINATED").when(F.col("k") % 6 == 3, "Running")
        .when(F.col("k") % 6 == 4, "failed")
    )
    return e.select("app_id", "seq", "ts_ms", phase.alias("phase"))


# --- SQL twins --------------------------------------------------------------------------

_STATE = """CASE WHEN k < 5 AND lower(phase) NOT IN ('terminating','running') THEN 'deleted'
  {check_all}
  WHEN lower(phase)='running' AND main_exit = 0 THEN 'succeeded'
  WHEN lower(phase)='running' AND main_exit IS NOT NULL THEN 'failed' ELSE lower(phase) END"""
STATE_SQL = _STATE.format(check_all="")
STATE_ALL_SQL = _STATE.format(
    check_all="WHEN lower(phase)='running' AND k % 2 = 0 AND "
    "(coalesce(main_exit,0) <> 0 OR coalesce(side_exit,0) <> 0) THEN 'failed'"
)
EXIT_SQL = "CASE WHEN k % 2 = 1 THEN coalesce(side_exit, main_exit, -1) ELSE coalesce(main_exit, side_exit, -1) END"

CTES = {
    "e0": """SELECT concat('app-', CAST(user_id % 7 AS VARCHAR)) AS app_id, user_id AS exec_id,
  CAST(user_id % 5 AS INT) AS profile_id, event_id AS seq, epoch_us(ts) AS ts_us, epoch_us(ts) // 1000 AS ts_ms,
  event_type, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM events""",
    "pods": """SELECT *, concat(app_id, '-exec-', CAST(exec_id AS VARCHAR)) AS name,
  concat('ns-', CAST(exec_id % 3 AS VARCHAR)) AS namespace,
  CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'view' THEN 'Running' WHEN 'click' THEN 'Running'
                  WHEN 'purchase' THEN 'Succeeded' ELSE 'Failed' END AS phase,
  CASE WHEN event_type IN ('purchase','error') OR (event_type='click' AND k % 10 = 0) THEN k % 3 END AS main_exit,
  CASE WHEN k % 11 = 0 THEN 1 WHEN event_type='error' THEN 0 END AS side_exit,
  k >= 95 AS inactive, CASE WHEN k % 7 = 0 THEN 'driver' ELSE 'executor' END AS role,
  CASE WHEN k % 13 <> 0 THEN ts_ms END AS start_ms FROM e0""",
    "latest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id, exec_id ORDER BY seq DESC) AS rn
  FROM pods) WHERE rn = 1""",
    "state": f"SELECT app_id, exec_id, profile_id, seq, start_ms, {STATE_SQL} AS state FROM latest",
    "targets": """SELECT app_id, CAST(profile_id AS INT) AS profile_id, CAST(profile_id + 1 AS INT) AS target
  FROM (SELECT DISTINCT app_id FROM e0), (SELECT r_regionkey AS profile_id FROM region)""",
    "registrations": """SELECT app_id, exec_id, min(ts_ms) AS registered_ms FROM e0 WHERE exec_id % 3 <> 0
  GROUP BY app_id, exec_id""",
    "ledger": f"""SELECT concat('app-', CAST(c_custkey % 7 AS VARCHAR)) AS app_id, c_custkey + 70 AS exec_id,
  CAST(c_custkey % 5 AS INT) AS profile_id, {NOW_MS} - c_custkey*30000 AS created_ms
  FROM customer""",
    "jobs": """SELECT DISTINCT app_id, exec_id, concat('job-', CAST(exec_id AS VARCHAR)) AS job_name FROM e0
  WHERE exec_id % 9 <> 0""",
    "listing": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id, exec_id ORDER BY ts_us DESC) AS rn
  FROM pods WHERE ts_ms >= {LISTING_MS - LISTING_SPAN_MS} AND ts_ms < {LISTING_MS}) WHERE rn = 1 AND NOT inactive""",
    "folded": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id, exec_id ORDER BY arrival DESC) AS last_rn
  FROM (SELECT * EXCLUDE (rn), {LISTING_MS * 1000} AS arrival FROM listing
        UNION ALL SELECT *, ts_us AS arrival FROM pods)) WHERE last_rn = 1 AND
  (arrival >= {LISTING_MS * 1000} OR app_id NOT IN (SELECT app_id FROM listing))""",
    "part_conf": _entries_sql("part", _PART_APP, PART_CONF),
    "part_env": _entries_sql("part", _PART_APP, PART_ENV),
    "volume_conf": _entries_sql("supplier", _SUPP_APP, SUPPLIER_VOLUMES, _SUPP_PREFIX),
    "app_sizes": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in APP_SIZES) + " FROM part",
    "profile_sizes": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PROFILE_SIZES)
    + " FROM (SELECT p_partkey, unnest([0, 1, 2]) AS profile_id FROM part)",
    "name_members": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in NAME_MEMBERS) + " FROM customer",
    "watched": """SELECT concat('u', CAST(exec_id AS VARCHAR)) AS app_id, seq, ts_ms,
  CASE WHEN k = 1 THEN 'DELETED' WHEN k = 2 THEN 'ERROR' ELSE 'MODIFIED' END AS action,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'Succeeded' ELSE 'succeeded' END
       WHEN event_type = 'error' THEN 'Failed' ELSE 'Running' END AS phase FROM e0""",
    "job_rows": """SELECT app_id, seq, ts_ms, CASE k % 6 WHEN 0 THEN 'Aborted' WHEN 1 THEN 'Completed'
  WHEN 2 THEN 'TERMINATED' WHEN 3 THEN 'Running' WHEN 4 THEN 'failed' END AS phase FROM e0""",
}
_NEEDS = {
    "pods": ["e0"], "latest": ["pods"], "state": ["latest"], "targets": ["e0"], "registrations": ["e0"],
    "jobs": ["e0"], "listing": ["pods"], "folded": ["listing", "pods"], "watched": ["e0"], "job_rows": ["e0"],
}


def with_tables(*names: str, body: str, recursive: bool = False, more: dict[str, str] | None = None) -> str:
    """``WITH`` the named adapter tables (and what they need) in front of ``body``."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
