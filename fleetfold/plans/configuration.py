"""Queries over flat configuration: settings, labels, sizes, names, volumes, bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators import conf as C
from fleetfold.operators import names as N
from fleetfold.operators import packing as K
from fleetfold.operators import sizing as Z
from fleetfold.operators import volumes as V
from fleetfold.plans import adapters as A
from fleetfold.plans.adapters import with_tables
from fleetfold.plans.catalog import query


@query("conf_prefix", with_tables("part_conf", body="""
SELECT app_id, substr(key, 33) AS key, value FROM part_conf WHERE starts_with(key, 'spark.kubernetes.executor.label.')"""))
def conf_prefix(spark, d):
    return C.conf_prefix(A.part_conf(spark, d), "spark.kubernetes.executor.label.")


@query("merge_labels", with_tables("part_conf", body="""
SELECT app_id, substr(key, 31) AS key, value, 'custom' AS source, substr(key, 31) IN ('spark-app-selector', 'spark-role') AS rejected
FROM part_conf WHERE starts_with(key, 'spark.kubernetes.driver.label.')
UNION ALL SELECT concat('p', CAST(p_partkey AS VARCHAR)), 'spark-app-selector', concat('p', CAST(p_partkey AS VARCHAR)), 'preset', false FROM part
UNION ALL SELECT concat('p', CAST(p_partkey AS VARCHAR)), 'spark-role', 'driver', 'preset', false FROM part"""))
def merge_labels(spark, d):
    conf = A.part_conf(spark, d)
    return C.merge_labels(conf, conf.select("app_id").distinct(), "driver")


@query("merge_labels_executor", with_tables("part_conf", more={"m": """
SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS app_id, CAST(unnest([1, 2]) AS BIGINT) AS exec_id, p_size % 2 AS profile_id FROM part"""}, body="""
SELECT m.app_id, m.exec_id, substr(key, 33) AS key, value, 'custom' AS source,
  substr(key, 33) IN ('spark-exec-id', 'spark-app-selector', 'spark-role', 'spark-exec-resourceprofile-id') AS rejected
FROM part_conf c JOIN m USING (app_id) WHERE starts_with(key, 'spark.kubernetes.executor.label.')
UNION ALL SELECT app_id, exec_id, 'spark-exec-id', CAST(exec_id AS VARCHAR), 'preset', false FROM m
UNION ALL SELECT app_id, exec_id, 'spark-app-selector', app_id, 'preset', false FROM m
UNION ALL SELECT app_id, exec_id, 'spark-role', 'executor', 'preset', false FROM m
UNION ALL SELECT app_id, exec_id, 'spark-exec-resourceprofile-id', CAST(profile_id AS VARCHAR), 'preset', false FROM m"""))
def merge_labels_executor(spark, d):
    members = A.table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("app_id"),
        F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("exec_id"),
        (F.col("p_size") % 2).alias("profile_id"),
    )
    return C.merge_labels(A.part_conf(spark, d), members, "executor")


@query("valid_env", with_tables("part_conf", body="""
SELECT app_id, substr(key, 19) AS key, value FROM part_conf WHERE starts_with(key, 'spark.executorEnv.')
 AND regexp_full_match(substr(key, 19), '[-._a-zA-Z][-._a-zA-Z0-9]*')"""))
def valid_env(spark, d):
    return C.valid_env(A.part_conf(spark, d))


@query("invalid_env", with_tables("part_conf", body="""
SELECT app_id, substr(key, 19) AS key, value FROM part_conf WHERE starts_with(key, 'spark.executorEnv.')
 AND NOT regexp_full_match(substr(key, 19), '[-._a-zA-Z][-._a-zA-Z0-9]*')"""))
def invalid_env(spark, d):
    return C.invalid_env(A.part_conf(spark, d))


def _values(rows: list[tuple], names: list[str]) -> str:
    def lit(v):
        return "CAST(NULL AS VARCHAR)" if v is None else "'" + str(v).replace("'", "''") + "'"

    return " UNION ALL ".join("SELECT " + ", ".join(f"{lit(v)} AS {n}" for v, n in zip(r, names)) for r in rows)


# each suffix with the number of milliseconds it stands for
_UNITS = " ".join(f"WHEN '{u}' THEN CAST({ms} AS DOUBLE)" for u, ms in C.TIME_UNITS.items())
RESOLVE_SQL = with_tables("part_conf", more={
    "reg": _values(C.SETTINGS, ["key", "type", "dflt", "fb", "chk"]),
    "apps": "SELECT DISTINCT app_id FROM part_conf",
    "eff": """SELECT a.app_id, r.*, coalesce(own.value, other.value, r.dflt) AS value,
      CASE WHEN own.value IS NOT NULL THEN 'set' WHEN other.value IS NOT NULL THEN 'fallback'
           WHEN r.dflt IS NOT NULL THEN 'default' ELSE 'none' END AS source
      FROM apps a CROSS JOIN reg r LEFT JOIN part_conf own ON own.app_id = a.app_id AND own.key = r.key
      LEFT JOIN part_conf other ON other.app_id = a.app_id AND other.key = r.fb""",
    "num": f"""SELECT *, CASE WHEN type IN ('ms', 's') THEN
        floor(TRY_CAST(regexp_extract(value, '^(-?[0-9]+)([a-z]*)$', 1) AS DOUBLE) *
        CASE coalesce(nullif(regexp_extract(value, '^(-?[0-9]+)([a-z]*)$', 2), ''), type) {_UNITS} END
        / CASE WHEN type = 's' THEN 1000 ELSE 1 END)
      WHEN type IN ('int', 'long', 'double') THEN TRY_CAST(value AS DOUBLE) END AS number FROM eff""",
}, body="""
SELECT app_id, key, type, value, source, number,
 CASE WHEN value IS NULL THEN NULL
  WHEN type IN ('int','long','double','ms','s') AND number IS NULL THEN 'unreadable'
  WHEN type = 'boolean' AND lower(value) NOT IN ('true','false') THEN 'unreadable'
  WHEN chk = 'positive' AND NOT number > 0 THEN 'not positive'
  WHEN chk = 'unit_interval' AND NOT (number >= 0 AND number < 1) THEN 'not in [0, 1)'
  WHEN type = 'string' AND chk IS NOT NULL AND NOT list_contains(string_split(chk, '|'), value) THEN 'not allowed' END AS violation
FROM num""")


@query("resolve_conf", RESOLVE_SQL)
def resolve_conf(spark, d):
    return C.resolve_conf(A.part_conf(spark, d))


_BATCH = "queueing"
_BATCH_ROWS = ("SELECT CASE o_orderkey % 4 WHEN 0 THEN '{b}.queue' WHEN 1 THEN '{b}.maxRetry' WHEN 2 THEN '{b}.enabled' ELSE '{b}.other' END AS key, "
               "concat('c', CAST(o_custkey AS STRING)) AS app_id, CASE o_orderkey % 4 WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'many' ELSE "
               "CAST(o_orderkey % 11 AS STRING) END WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'yes' ELSE 'TRUE' END ELSE o_orderstatus END AS value, "
               "o_orderkey AS line FROM orders").format(b=f"spark.kubernetes.{_BATCH}")
_BATCH_DEFAULTS = ", ".join(
    f"('{k}', '{t}', '{v}')" for k, t, v, _, _ in C.batch_settings(_BATCH)
)


@query("resolve_conf_in_order", f"""
WITH o AS ({_BATCH_ROWS}), reg AS (SELECT * FROM (VALUES {_BATCH_DEFAULTS}) AS v(key, type, dflt)),
 last AS (SELECT app_id, key, arg_max(value, line) AS value FROM o GROUP BY app_id, key),
 eff AS (SELECT a.app_id, reg.key, reg.type, coalesce(l.value, reg.dflt) AS value, CASE WHEN l.value IS NULL THEN 'default' ELSE 'set' END AS source
   FROM (SELECT DISTINCT app_id FROM o) a CROSS JOIN reg LEFT JOIN last l ON l.app_id = a.app_id AND l.key = reg.key)
SELECT *, CASE WHEN type = 'int' THEN TRY_CAST(value AS DOUBLE) END AS number, CASE WHEN type = 'int' AND TRY_CAST(value AS DOUBLE) IS NULL THEN 'unreadable'
  WHEN type = 'boolean' AND lower(value) NOT IN ('true', 'false') THEN 'unreadable' END AS violation FROM eff""")
def resolve_conf_in_order(spark, d):
    """The entries of a batch scheduler; a customer's orders set a key again and again, and the last counts."""
    select, _, _ = _BATCH_ROWS.removeprefix("SELECT ").rpartition(" FROM ")
    rows = A.table(spark, d, "orders").select(F.expr(f"struct({select})").alias("r")).select("r.*")
    return C.resolve_conf(rows, C.batch_settings(_BATCH), order="line")


def _rule_sql(rule: str, first: str, second: str) -> str:
    a = f"EXISTS (SELECT 1 FROM part_conf c WHERE c.app_id = x.app_id AND c.key = '{first}')"
    b = f"EXISTS (SELECT 1 FROM part_conf c WHERE c.app_id = x.app_id AND c.key = '{second}')"
    test = {"both_or_neither": f"({a}) <> ({b})", "second_if_first": f"{a} AND NOT {b}", "not_both": f"{a} AND {b}"}[rule]
    return f"""SELECT app_id, '{rule}' AS rule, '{first}' AS first, '{second}' AS second
      FROM (SELECT DISTINCT app_id FROM part_conf) x WHERE {test}"""


@query("check_options", with_tables("part_conf", body=" UNION ALL ".join(_rule_sql(*r) for r in A.OPTION_RULES)))
def check_options(spark, d):
    return C.check_options(A.part_conf(spark, d), A.OPTION_RULES)


def _conf(key: str) -> str:
    return f"(SELECT value FROM part_conf c WHERE c.app_id = a.app_id AND c.key = '{key}')"


def _envv(key: str) -> str:
    return f"(SELECT value FROM part_env e WHERE e.app_id = a.app_id AND e.key = '{key}')"


def _setting_sql(name: str, places: list[tuple[str, str]]) -> str:
    value = "coalesce(" + ", ".join(v for _, v in places) + ", NULL)"
    source = "CASE " + " ".join(f"WHEN {v} IS NOT NULL THEN '{s}'" for s, v in places) + " END"
    return f"SELECT app_id, '{name}' AS setting, {value} AS value, {source} AS source FROM apps a"


_SETTINGS_SQL = " UNION ALL ".join([
    _setting_sql("driver_port", [("conf", _conf("spark.driver.port")), ("default", "'7078'")]),
    _setting_sql("driver_block_manager_port", [
        ("conf", _conf("spark.driver.blockManager.port")), ("shared", _conf("spark.blockManager.port")), ("default", "'7079'")]),
    _setting_sql("service_block_manager_port", [("conf", _conf("spark.driver.blockManager.port")), ("default", "'7079'")]),
    _setting_sql("executor_block_manager_port", [("conf", _conf("spark.blockManager.port")), ("default", "'7079'")]),
    _setting_sql("executor_python", [("conf", _conf("spark.pyspark.python")), ("env", _envv("PYSPARK_PYTHON"))]),
    _setting_sql("driver_python", [
        ("conf", _conf("spark.pyspark.driver.python")), ("shared", _conf("spark.pyspark.python")),
        ("env", _envv("PYSPARK_DRIVER_PYTHON")), ("shared_env", _envv("PYSPARK_PYTHON"))]),
    _setting_sql("app_type", [("conf", _conf("spark.kubernetes.resource.type")), ("default", "'java'")]),
])


@query("effective_settings", with_tables("part_conf", "part_env", more={
    "apps": "SELECT DISTINCT app_id FROM part_conf",
    "plain": _SETTINGS_SQL,
    "mounted": "SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS app_id, unnest([1, 2]) AS idx FROM part WHERE p_partkey % 15 = 0",
    "dirs": f"""SELECT app_id, unnest(string_split(paths, ',')) AS value, source, unnest(range(1, len(string_split(paths, ',')) + 1)) AS pos FROM (
      SELECT app_id, coalesce({_envv('SPARK_LOCAL_DIRS')}, {_conf('spark.local.dir')}, concat('/var/data/spark-', app_id)) AS paths,
       CASE WHEN {_envv('SPARK_LOCAL_DIRS')} IS NOT NULL THEN 'env' WHEN {_conf('spark.local.dir')} IS NOT NULL THEN 'conf' ELSE 'default' END AS source
      FROM apps a WHERE app_id NOT IN (SELECT app_id FROM mounted))""",
}, body="""
SELECT app_id, setting, value, source, CASE WHEN suffix(setting, '_port') THEN
  coalesce(TRY_CAST(value AS INT) = 0 OR TRY_CAST(value AS INT) BETWEEN 1024 AND 65535, false) END AS legal
 FROM plain WHERE value IS NOT NULL
UNION ALL SELECT app_id, concat('local_dir_', CAST(pos AS VARCHAR)), value, source, NULL FROM dirs
UNION ALL SELECT app_id, concat('local_dir_', CAST(idx AS VARCHAR)), '/m', 'mounted', NULL FROM mounted"""))
def effective_settings(spark, d):
    mounted = A.table(spark, d, "part").filter("p_partkey % 15 = 0").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("app_id"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"), F.lit("/m").alias("path"),
    )
    return C.effective_settings(A.part_conf(spark, d), A.part_env(spark, d), mounted)


# --- sizes ----------------------------------------------------------------------------------

_FACTOR = "coalesce(factor, CASE WHEN kind IN ('python', 'r') THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END)"
_OVERHEAD = f"coalesce(overhead_mib, greatest(CAST(floor({_FACTOR} * memory_mib) AS BIGINT), 384))"


@query("size_driver", with_tables("app_sizes", body=f"""
SELECT app_id, {_FACTOR} AS factor, {_OVERHEAD} AS overhead_mib, memory_mib + {_OVERHEAD} AS total_mib,
 coalesce(request_cores, CAST(cores AS VARCHAR)) AS cpu_request, limit_cores AS cpu_limit FROM app_sizes"""))
def size_driver(spark, d):
    return Z.size_driver(A.app_sizes(spark, d))


@query("size_executor", with_tables("app_sizes", "profile_sizes", more={"j": f"""
SELECT p.app_id, p.profile_id, a.kind, a.request_cores, a.limit_cores,
 CASE WHEN profile_id = 0 THEN a.memory_mib ELSE coalesce(p.memory_mib, a.memory_mib) END AS memory_mib,
 CASE WHEN profile_id = 0 THEN a.ov ELSE coalesce(p.overhead_mib, a.ov) END AS overhead_mib,
 CASE WHEN profile_id = 0 THEN coalesce(a.offheap_mib, 0) ELSE coalesce(p.offheap_mib, a.offheap_mib, 0) END AS off_mib,
 CASE WHEN a.kind <> 'python' THEN 0 WHEN profile_id = 0 THEN coalesce(a.pyspark_mib, 0) ELSE coalesce(p.pyspark_mib, a.pyspark_mib, 0) END AS py_mib,
 CASE WHEN profile_id = 0 THEN a.cores ELSE coalesce(p.cores, a.cores) END AS cores
 FROM profile_sizes p JOIN (SELECT *, {_OVERHEAD} AS ov FROM app_sizes) a USING (app_id)"""}, body="""
SELECT app_id, profile_id, memory_mib, overhead_mib, memory_mib + overhead_mib + off_mib + py_mib AS total_mib,
 concat(CAST(memory_mib + overhead_mib + off_mib + py_mib AS VARCHAR), 'Mi') AS quantity,
 CASE WHEN profile_id = 0 THEN coalesce(request_cores, CAST(cores AS VARCHAR)) ELSE CAST(cores AS VARCHAR) END AS cpu_request,
 CASE WHEN profile_id = 0 THEN limit_cores END AS cpu_limit FROM j"""))
def size_executor(spark, d):
    return Z.size_executor(A.app_sizes(spark, d), A.profile_sizes(spark, d))


@query("custom_resources", """
SELECT CAST(p_partkey AS VARCHAR) AS app_id, CASE WHEN p_partkey % 4 > 1 THEN concat('vendor', CAST(p_partkey % 4 AS VARCHAR), '.com/', lower(p_type)) END AS resource,
 p_size AS amount, CASE WHEN p_partkey % 4 <= 1 THEN concat('Resource: ', lower(p_type), ' was requested, but vendor was not specified.') END AS error FROM part""")
def custom_resources(spark, d):
    key = F.col("p_partkey")
    vendor = F.when(key % 4 > 1, F.concat(F.lit("vendor"), (key % 4).cast("string"), F.lit(".com"))).when(key % 4 == 1, "")
    return Z.custom_resources(A.table(spark, d, "part").select(
        key.cast("string").alias("app_id"), F.lower("p_type").alias("name"), vendor.alias("vendor"),
        F.col("p_size").alias("amount"),
    ))


# --- names ---------------------------------------------------------------------------------

_BASE = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(concat(app_name, '-', run_id))),
  '\\s+', '-', 'g'), '\\.', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g')"""


@query("derive_names", with_tables("name_members", more={"b": f"SELECT *, {_BASE} AS prefix FROM name_members",
       "c": "SELECT *, concat(prefix, '-exec-', CAST(exec_id AS VARCHAR)) AS pod_name FROM b"}, body="""
SELECT app_id, exec_id, prefix, pod_name, concat(prefix, '-driver') AS driver_name, concat(job_prefix, '-', CAST(exec_id AS VARCHAR)) AS job_name,
 concat(job_prefix, '-driver-0') AS job_driver_name,
 regexp_replace(regexp_replace(right(pod_name, 63), '^[^a-zA-Z0-9_]+', ''), '[^a-zA-Z0-9_-]+', '_', 'g') AS host_name,
 CASE WHEN length(prefix) + 11 <= 63 THEN concat(prefix, '-driver-svc') ELSE concat('spark-', run_id, '-driver-svc') END AS service_name,
 concat(left(prefix, 54), '-conf-map') AS bundle_name FROM c"""))
def derive_names(spark, d):
    return N.derive_names(A.name_members(spark, d))


# --- volumes --------------------------------------------------------------------------------

_V = "string_split(substr(key, 35), '.')"
_PROP_SQL = ", ".join(f"max(CASE WHEN prop = '{p}' THEN value END) AS {c}" for p, c in V._PROPS.items())


def _need(prop: str) -> str:
    return f"concat(type, '.', name, '.{prop} is required for ', type)"


VOLUMES = {
    "vs": f"SELECT app_id, {_V}[1] AS type, {_V}[2] AS name, array_to_string({_V}[3:], '.') AS prop, value FROM volume_conf",
    "vw": f"SELECT app_id, type, name, {_PROP_SQL} FROM vs GROUP BY app_id, type, name",
    "vol": f"""SELECT app_id, type, name, mount_path, coalesce(sub_path, '') AS sub_path, lower(coalesce(read_only, 'false')) = 'true' AS read_only,
      path, claim_name, storage_class, medium, size_limit, server,
      CASE WHEN mount_path IS NULL THEN {_need('mount.path')}
       WHEN lower(coalesce(read_only, 'false')) NOT IN ('true','false') THEN concat(type, '.', name, '.mount.readOnly is not a boolean')
       WHEN type = 'hostPath' AND path IS NULL THEN {_need('options.path')}
       WHEN type = 'persistentVolumeClaim' AND claim_name IS NULL THEN {_need('options.claimName')}
       WHEN type = 'nfs' AND path IS NULL THEN {_need('options.path')}
       WHEN type = 'nfs' AND server IS NULL THEN {_need('options.server')}
       WHEN type = 'floppy' THEN 'Volume type `floppy` is not supported' END AS error FROM vw""",
}


def _volumes(spark, d):
    return V.parse_volumes(A.volume_conf(spark, d), A.PREFIX_VOLUMES)


@query("parse_volumes", with_tables("volume_conf", more=VOLUMES, body="SELECT * FROM vol"))
def parse_volumes(spark, d):
    return _volumes(spark, d)


@query("volume_claims", with_tables("volume_conf", more=VOLUMES, body="""
SELECT app_id, name, claim_name, storage_class, size_limit AS size, 'ReadWriteOnce' AS access_mode FROM vol
WHERE error IS NULL AND type = 'persistentVolumeClaim' AND storage_class IS NOT NULL AND size_limit IS NOT NULL"""))
def volume_claims(spark, d):
    return V.volume_claims(_volumes(spark, d).filter("error IS NULL"))


@query("duplicate_mounts", with_tables("volume_conf", more=VOLUMES, body="""
SELECT app_id, mount_path, count(*) AS n FROM vol WHERE error IS NULL GROUP BY app_id, mount_path HAVING count(*) > 1"""))
def duplicate_mounts(spark, d):
    return V.duplicate_mounts(_volumes(spark, d).filter("error IS NULL"))


@query("substitute_placeholders", with_tables("volume_conf", more={**VOLUMES, "ix": """
SELECT app_id, name, claim_name, row_number() OVER (PARTITION BY app_id ORDER BY CAST(substr(name, 2) AS BIGINT)) - 1 AS idx
FROM vol WHERE claim_name IS NOT NULL"""}, body="""
SELECT app_id, name, replace(replace(claim_name, 'OnDemand', concat(app_id, '-exec-7-pvc-', CAST(idx AS VARCHAR))), 'SPARK_EXECUTOR_ID', '7') AS claim_name,
 concat('/scratch/', app_id, '/7') AS dirs FROM ix"""))
def substitute_placeholders(spark, d):
    claims = _volumes(spark, d).filter("claim_name IS NOT NULL").select(
        "app_id", "name", "claim_name", F.substr("name", F.lit(2)).cast("bigint").alias("n")
    )
    placed = V.index_within(claims, ["app_id"], ["n"], [F.floor(F.col("n") / 4096)])
    ready = placed.select(
        "app_id", "name", "claim_name", "idx", F.lit(7).cast("bigint").alias("exec_id"),
        F.col("app_id").alias("prefix"), F.lit("/scratch/SPARK_APPLICATION_ID/SPARK_EXECUTOR_ID").alias("dirs"),
    )
    return V.substitute_placeholders(ready, "executor").select("app_id", "name", "claim_name", "dirs")


# --- bundles ---------------------------------------------------------------------------------

BUDGET = 60_000
# Files are taken while they fit, so the check walks them in order, as a recursion
PACK = {
    "f": f"""SELECT source AS app_id, concat('file-', CAST(doc_id AS VARCHAR), '.conf') AS file_name,
      length(concat('file-', CAST(doc_id AS VARCHAR), '.conf')) + strlen(text) AS size,
      length(concat('file-', CAST(doc_id AS VARCHAR), '.conf')) + length(text) + length(regexp_replace(text, '[^\U00010000-\U0010FFFF]', '', 'g')) AS cost
      FROM documents""",
    "o": f"SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY size, file_name) AS rn FROM f WHERE size <= {BUDGET}",
    "w": f"""SELECT app_id, rn, file_name, CASE WHEN cost < {BUDGET} THEN cost ELSE 0 END AS total, cost < {BUDGET} AS taken FROM o WHERE rn = 1
      UNION ALL SELECT o.app_id, o.rn, o.file_name, w.total + CASE WHEN w.total + o.cost < {BUDGET} THEN o.cost ELSE 0 END,
       w.total + o.cost < {BUDGET} FROM w JOIN o ON o.app_id = w.app_id AND o.rn = w.rn + 1""",
}


@query("pack_by_budget", "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in PACK.items())
       + " SELECT app_id, file_name FROM w WHERE taken")
def pack_by_budget(spark, d):
    return K.pack_by_budget(A.conf_files(spark, d), BUDGET).select("app_id", "file_name")


@query("write_conf_bundle", "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in PACK.items()) + f"""
SELECT w.app_id, concat(w.app_id, '-conf-map') AS name, w.file_name, md5(d.text) AS content_md5
FROM w JOIN documents d ON w.file_name = concat('file-', CAST(d.doc_id AS VARCHAR), '.conf') WHERE w.taken
UNION ALL SELECT source, concat(source, '-conf-map'), '{S.PROPERTIES_FILE}', md5(concat('{S.PROPERTIES_HEADER}', source, '-conf-map', chr(10),
  string_agg(line, chr(10) ORDER BY line), chr(10))) FROM
  (SELECT DISTINCT source, concat('lang.', lang, '=a\\:b \\#', CAST(doc_id % 7 AS VARCHAR)) AS line, row_number() OVER
    (PARTITION BY source, lang ORDER BY doc_id % 7 DESC) AS rn FROM documents WHERE lang <> 'es') WHERE rn = 1 GROUP BY source""")
def write_conf_bundle(spark, d):
    docs = A.table(spark, d, "documents").filter("lang <> 'es'")
    properties = docs.select(
        F.col("source").alias("app_id"), F.concat(F.lit("lang."), "lang").alias("key"),
        F.concat(F.lit("a:b #"), (F.col("doc_id") % 7).cast("string")).alias("value"),
    )
    bundle = K.write_conf_bundle(A.conf_files(spark, d), budget=BUDGET, properties=properties)
    return bundle.select("app_id", "name", F.explode("data").alias("file_name", "content")).select(
        "app_id", "name", "file_name", F.md5("content").alias("content_md5")
    )


@query("file_verdicts", "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in PACK.items()) + f"""
SELECT d.source AS app_id, f.file_name, coalesce(w.taken, false) AS taken, CASE WHEN coalesce(w.taken, false) THEN NULL
  WHEN length(f.file_name) + strlen(d.text) > {BUDGET} THEN 'size' ELSE 'budget' END AS reason
FROM documents d JOIN (SELECT doc_id, concat('file-', CAST(doc_id AS VARCHAR), '.conf') AS file_name FROM documents) f USING (doc_id)
LEFT JOIN w ON w.app_id = d.source AND w.file_name = f.file_name""")
def file_verdicts(spark, d):
    """Every file with whether the bundle takes it, and why not."""
    return K.file_verdicts(A.conf_files(spark, d), BUDGET)


@query("sorted_keys", "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in PACK.items()) + """
SELECT app_id, string_agg(file_name, ',' ORDER BY file_name) AS keys FROM w WHERE taken GROUP BY app_id""")
def sorted_keys(spark, d):
    bundle = K.sorted_keys(K.write_conf_bundle(A.conf_files(spark, d), budget=BUDGET))
    return bundle.select("app_id", F.array_join("keys", ",").alias("keys"))
