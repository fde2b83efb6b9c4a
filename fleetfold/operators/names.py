"""Names derived from app names, ids and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: length limits --------------------------------------------------------
HOST_CHARS = 63
SERVICE_CHARS = 63
BUNDLE_CHARS = 54


def base_name(app_name: Column, ident: Column) -> Column:
    """Lower-case name of letters, digits and single dashes."""
    raw = F.concat(app_name, F.lit("-"), ident)
    name = F.lower(F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    name = F.regexp_replace(name, r"[\s.]+", "-")
    return F.regexp_replace(F.regexp_replace(name, "[^a-z0-9-]", ""), "-+", "-")


def host_name(name: Column) -> Column:
    tail = F.right(name, F.lit(HOST_CHARS))
    return F.regexp_replace(F.regexp_replace(tail, r"^[^\w]+", ""), r"[^\w-]+", "_")


def service_name(prefix: Column, short_id: Column) -> Column:
    full = F.concat(prefix, F.lit("-driver-svc"))
    short = F.concat(F.lit("spark-"), short_id, F.lit("-driver-svc"))
    return F.when(F.length(full) <= SERVICE_CHARS, full).otherwise(short)


def bundle_name(prefix: Column) -> Column:
    return F.concat(F.left(prefix, F.lit(BUNDLE_CHARS)), F.lit("-conf-map"))


def derive_names(members: DataFrame) -> DataFrame:
    """Every name a member goes by, to join logs and listings that carry only names.

    Needs ``app_id, app_name, run_id, exec_id, job_prefix``.
    """
    prefix = base_name(F.col("app_name"), F.col("run_id").cast("string"))
    ident = F.col("exec_id").cast("string")
    named = members.withColumn("prefix", prefix)
    pod = F.concat("prefix", F.lit("-exec-"), ident)
    return named.select(
        "app_id",
        "exec_id",
        "prefix",
        pod.alias("pod_name"),
        F.concat("prefix", F.lit("-driver")).alias("driver_name"),
        F.concat("job_prefix", F.lit("-"), ident).alias("job_name"),
        F.concat("job_prefix", F.lit("-driver-0")).alias("job_driver_name"),
        host_name(pod).alias("host_name"),
        service_name(F.col("prefix"), F.col("run_id").cast("string")).alias("service_name"),
        bundle_name(F.col("prefix")).alias("bundle_name"),
    )


def name_prefixes(members: DataFrame) -> DataFrame:
    """Distinct name prefixes per app; more than one is a fault."""
    prefix = F.regexp_extract("name", r"(?s)^(.*)-[^-]*$", 1)
    return (
        members.select("app_id", prefix.alias("prefix"))
        .groupBy("app_id")
        .agg(F.count_distinct("prefix").alias("n_prefixes"))
        .withColumn("ok", F.col("n_prefixes") == 1)
    )
