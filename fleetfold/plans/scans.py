"""Queries that write a source format, read it back and compare or count."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators import jobs as J
from fleetfold.operators import report as Q
from fleetfold.plans import adapters as A
from fleetfold.plans.adapters import with_tables
from fleetfold.plans.catalog import query
from fleetfold.plans.members import STATUS_SQL, _requests
from fleetfold.sources import conf_files as CF
from fleetfold.sources import documents as D
from fleetfold.sources.scratch import scratch_dir


@query("read_listing", with_tables("listing", body="""
SELECT app_id, exec_id, phase FROM listing WHERE role = 'executor'"""))
def read_listing(spark, d):
    path = scratch_dir(spark, "listing")
    pods = A.by_time(A.pods(spark, d))
    D.write_documents(A.listing(pods).drop("ts_us").unionByName(pods.drop("ts_us")), path)
    return D.read_listing(spark, path).select(*S.MEMBER, "phase")


@query("read_changes", with_tables("pods", body="""
SELECT seq, app_id, exec_id, inactive, CASE WHEN k % 2 = 1 THEN 'sidecar' ELSE 'spark-kubernetes-executor' END AS first_container
FROM pods WHERE role = 'executor'"""))
def read_changes(spark, d):
    path = scratch_dir(spark, "changes")
    D.write_documents(A.pods(spark, d).drop("ts_us"), path)
    return D.read_changes(spark, path).select(
        "seq", *S.MEMBER,
        (F.col("labels")[S.INACTIVE_LABEL] == "true").eqNullSafe(True).alias("inactive"),
        F.col("containers")[0]["name"].alias("first_container"),
    )


@query("read_listing_of_jobs", with_tables("listing", "jobs", body="""
SELECT l.app_id, l.exec_id, l.phase, l.role FROM listing l JOIN jobs j ON j.app_id = l.app_id AND j.exec_id = l.exec_id"""))
def read_listing_of_jobs(spark, d):
    """Batch scheduler: documents of known jobs, whatever their role; a fifth of them has no role label."""
    path = scratch_dir(spark, "listing-jobs")
    pods = A.by_time(A.pods(spark, d))
    bare = F.map_filter("labels", lambda k, v: (k != S.ROLE_LABEL) | (F.col("exec_id") % 5 != 0))
    unlabelled = A.listing(pods).drop("ts_us", "role", "inactive", "job_name").withColumn("labels", bare)
    D.write_documents(unlabelled, path, job_label="job", format="parquet")
    found = D.read_listing(spark, path, jobs=A.jobs(pods), format="parquet")
    # the role as it was written, to show that documents without one are found
    kept = found.join(A.listing(pods).select(*S.MEMBER, F.col("role").alias("_role")), S.MEMBER)
    return kept.select(*S.MEMBER, "phase", F.coalesce("role", "_role").alias("role"))


@query("read_changes_of_jobs", with_tables("pods", "jobs", body="""
SELECT p.seq, p.app_id, p.exec_id, p.role, p.inactive FROM pods p JOIN jobs j ON j.app_id = p.app_id AND j.exec_id = p.exec_id"""))
def read_changes_of_jobs(spark, d):
    """The same for a stream of changes, which also holds inactive members."""
    out = scratch_dir(spark, "changes-jobs")
    pods = A.pods(spark, d)
    D.write_documents(pods.drop("ts_us", "role", "inactive", "job_name"), f"{out}/inbox", job_label="job")
    rows = D.read_changes(spark, f"{out}/inbox", streaming=True, jobs=A.jobs(pods))
    columns = ["seq", *S.MEMBER, "role", "inactive"]
    rows.select(*columns).writeStream.option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).foreachBatch(
        lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={i}")
    ).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(*columns)


# the name decides whether a file is read; every fifth is hidden from Spark's own sources
_FILE_NAMES = ("concat(CASE WHEN doc_id % 5 = 4 THEN '.' WHEN doc_id % 10 = 5 THEN '_' WHEN doc_id % 5 = 2 THEN 'spark-' ELSE '' END, lang, "
               "CAST(doc_id AS STRING), CASE WHEN doc_id % 5 = 1 THEN '.template' WHEN doc_id % 5 = 3 THEN '.tar' ELSE '.conf' END)")
_FILE_BUDGET = 20_000


@query("read_conf_files", f"""
SELECT *, CASE WHEN reason IS NULL THEN sha256(text) END AS content_sha256 FROM (SELECT source AS app_id, {_FILE_NAMES} AS file_name,
  CAST(strlen(text) AS BIGINT) AS n_bytes, text, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'name' WHEN strlen(text) + length({_FILE_NAMES}) > {_FILE_BUDGET}
  THEN 'size' END AS reason FROM documents)""".replace("SELECT *,", "SELECT app_id, file_name, n_bytes, reason,", 1))
def read_conf_files(spark, d):
    """Every document as a file of its own with its whole text; rejected ones with their reason."""
    path = scratch_dir(spark, "conf-files")
    docs = A.table(spark, d, "documents").select(
        F.col("source").alias("app_id"), F.expr(_FILE_NAMES).alias("file_name"), F.col("text").alias("content"),
    )
    CF.write_conf_files(docs, path)
    found = CF.read_conf_files(spark, path, budget=_FILE_BUDGET, rejected=True)
    return found.select("app_id", "file_name", "n_bytes", "reason", F.sha2("content", 256).alias("content_sha256"))


# a value in three lines, an escape that stands for itself, and one in seven records that cannot be read
_RECORD = ("concat('doc\\\\ key\\\\:', CAST(doc_id AS STRING), ' = ', lang, '\\\\bx, \\\\\n   \\\\u00e9', source, CASE WHEN doc_id % 7 = 0 THEN '\\\\u12' ELSE '' END, "
           "' \\\\\n\t', CAST(n_chars AS STRING))")


@query("read_properties_records", r"""
SELECT source AS app_id, CASE WHEN doc_id % 7 <> 0 THEN concat('doc key:', CAST(doc_id AS VARCHAR)) END AS key,
 CASE WHEN doc_id % 7 <> 0 THEN concat(lang, 'bx, ', chr(233), source, ' ', CAST(n_chars AS VARCHAR)) END AS value, doc_id % 7 = 0 AS failed FROM documents""")
def read_properties_records(spark, d):
    """Records over several lines, between comments that seem to go on and do not."""
    path = scratch_dir(spark, "properties-records")
    docs = A.table(spark, d, "documents")
    note = F.concat(F.lit("# note on "), F.col("doc_id").cast("string"), F.lit(" \\"))
    text = F.concat_ws("\n", note, F.expr(_RECORD), F.lit(""))
    docs.select(F.col("source").alias("app_id"), text.alias("value")).write.partitionBy("app_id").text(path)
    return CF.read_properties(spark, path).select("app_id", "key", "value", F.col("error").isNotNull().alias("failed"))


@query("read_properties", """
SELECT source AS app_id, concat('doc key:', CAST(doc_id AS VARCHAR), '=', lang) AS key, md5(text) AS value_md5 FROM documents""")
def read_properties(spark, d):
    path = scratch_dir(spark, "properties")
    conf = A.table(spark, d, "documents").select(
        F.col("source").alias("app_id"),
        F.concat(F.lit("doc key:"), F.col("doc_id").cast("string"), F.lit("="), "lang").alias("key"),
        F.col("text").alias("value"),
    )
    CF.write_properties(conf, path)
    return CF.read_properties(spark, path).select("app_id", "key", F.md5("value").alias("value_md5"))


@query("write_properties", """
SELECT concat('doc\\ key\\:', CAST(p_partkey AS VARCHAR), '=', replace(p_name, '#', '\\#')) AS line, count(*) AS n FROM part GROUP BY ALL""")
def write_properties(spark, d):
    conf = A.table(spark, d, "part").select(
        F.lit("all").alias("app_id"),
        F.concat(F.lit("doc key:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"),
    )
    path = scratch_dir(spark, "properties-text")
    CF.write_properties(conf, path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


_PAGE_URI = "CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^https?://[^/]*', '/data') WHEN page_id % 5 = 1 THEN regexp_replace(url, '^https?:', 'file:') ELSE url END"
_PAGE_KIND = "CASE WHEN page_id % 2 = 0 THEN 'archives' ELSE 'files' END"


@query("staging_plan", f"""
WITH u AS (SELECT page_id, {_PAGE_KIND} AS kind, {_PAGE_URI} AS uri FROM pages),
 p AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 'file' WHEN starts_with(uri, 'https') THEN 'https' ELSE 'http' END AS scheme,
   regexp_extract(rtrim(split_part(split_part(regexp_replace(uri, '^[a-z]+://[^/]*', ''), '#', 1), '?', 1), '/'), '[^/]*$') AS base_name FROM u)
SELECT page_id, scheme, base_name, page_id % 5 < 2 AS is_local,
 CASE WHEN page_id % 5 < 2 THEN concat('s3a://stage/spark-upload-', CAST(page_id AS VARCHAR), '/', base_name,
   CASE WHEN kind = 'archives' AND contains(uri, '#') THEN concat('#', split_part(uri, '#', 2)) ELSE '' END) ELSE uri END AS target FROM p""")
def staging_plan(spark, d):
    uris = A.table(spark, d, "pages").select(
        "page_id", F.lit("all").alias("app_id"), F.col("page_id").alias("upload_id"),
        F.expr(_PAGE_KIND).alias("kind"), F.expr(_PAGE_URI).alias("uri"),
    )
    return CF.staging_plan(uris, "s3a://stage").select("page_id", "scheme", "base_name", "is_local", "target")


@query("text_roundtrip_wordcount", """
SELECT word, count(*) AS n_before, count(*) AS n_after, true AS same FROM
 (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word""")
def text_roundtrip_wordcount(spark, d):
    source, target = scratch_dir(spark, "text"), scratch_dir(spark, "text-copy")
    A.table(spark, d, "documents").select(F.col("text").alias("value")).write.text(source)
    return J.text_roundtrip_wordcount(spark, source, target)


@query("status_report_sink", STATUS_SQL.replace("SELECT submission_id, true AS found, count(*) AS n FROM m GROUP BY submission_id",
       "SELECT 'found' AS kind, count(*) AS n FROM m").replace(
       "UNION ALL SELECT submission_id, false AS found, 1 AS n FROM requests WHERE",
       "UNION ALL SELECT CASE WHEN suffix(submission_id, '*') THEN 'no apps' ELSE 'no app' END AS kind, count(*) AS n FROM requests WHERE") + " GROUP BY ALL")
def status_report_sink(spark, d):
    path = scratch_dir(spark, "status")
    Q.status_report_sink(_requests(spark, d), A.pods(spark, d), path)
    lines = spark.read.text(path)
    kind = (
        F.when(F.col("value").startswith("Application status (driver): "), "found")
        .when(F.col("value") == "Application not found.", "no app")
        .when(F.col("value") == "No applications found.", "no apps")
    )
    return lines.select(kind.alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


@query("status_rows", STATUS_SQL)
def status_rows(spark, d):
    return Q.status_rows(_requests(spark, d), A.pods(spark, d)).groupBy("submission_id", "found").agg(
        F.count("*").alias("n")
    )
