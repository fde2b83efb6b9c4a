"""Pod documents as files: full listings and change events, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.functions.pods import is_inactive


def stamp(pods: DataFrame, job_label: str | None = None) -> DataFrame:
    """Role, inactive mark and job as columns, from the labels where they are not set yet."""
    labels = F.col("labels")
    given = {"role": labels[S.ROLE_LABEL], "inactive": is_inactive()}
    if job_label is not None:
        given["job_name"] = labels[job_label]
    return pods.withColumns({n: F.coalesce(F.col(n), c) if n in pods.columns else c for n, c in given.items()})


def write_documents(pods: DataFrame, path: str, job_label: str | None = None, format: str = "json") -> None:
    """Documents with role, inactive mark and (for a batch scheduler) job as columns of their own."""
    writer = stamp(pods, job_label).write.mode("overwrite").format(format)
    if format == "json":
        writer = writer.option("ignoreNullFields", True)
    writer.save(path)


def _read(
    spark: SparkSession, path: str, streaming: bool, files_per_trigger: int | None, format: str
) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(S.POD).format(format)
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def _members_of(rows: DataFrame, jobs: DataFrame | None) -> DataFrame:
    """Executors by role, or, under a batch scheduler, the documents of known jobs, whatever their role.

    The job table is a static side also for a stream: one semi join that keeps no
    state. A job may own most of the documents; Spark broadcasts a small table itself, and
    a semi join needs no second copy of the documents otherwise.
    """
    if jobs is None:
        return rows.filter(F.col("role") == S.EXECUTOR_ROLE)
    known = jobs.select("app_id", "job_name").distinct()
    return rows.filter(F.col("job_name").isNotNull()).join(known, ["app_id", "job_name"], "left_semi").select(*rows.columns)


def read_listing(
    spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None,
    jobs: DataFrame | None = None, format: str = "json",
) -> DataFrame:
    """Rows of full listings: executors that are not marked inactive.

    With ``jobs`` (app_id, job_name) the documents of a batch scheduler: those of known
    jobs, also without a role. All tests are on plain columns and reach the scan.
    """
    rows = _read(spark, path, streaming, files_per_trigger, format)
    active = F.col("inactive").isNull() | (F.col("inactive") == F.lit(False))
    return _members_of(rows.filter(F.col("sync_ts").isNotNull() & active), jobs)


def read_changes(
    spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None,
    jobs: DataFrame | None = None, format: str = "json",
) -> DataFrame:
    """Change events of executors, also inactive ones; the action is not looked at.

    ``jobs`` selects as in :func:`read_listing`.
    """
    rows = _read(spark, path, streaming, files_per_trigger, format)
    return _members_of(rows.filter(F.col("sync_ts").isNull()), jobs)
