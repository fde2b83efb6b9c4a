"""Volumes, claims and mounts from flat configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.operators.conf import conf_prefix
from fleetfold.operators.keyed import prefix_totals

# --- fixed values: volume types with the options each requires -----------------------
VOLUME_TYPES = {
    "hostPath": ["options.path"],
    "persistentVolumeClaim": ["options.claimName"],
    "emptyDir": [],
    "nfs": ["options.path", "options.server"],
}
_PROPS = {
    "mount.path": "mount_path",
    "mount.subPath": "sub_path",
    "mount.readOnly": "read_only",
    "options.path": "path",
    "options.claimName": "claim_name",
    "options.storageClass": "storage_class",
    "options.medium": "medium",
    "options.sizeLimit": "size_limit",
    "options.server": "server",
}
ACCESS_MODE = "ReadWriteOnce"
ON_DEMAND = "OnDemand"
ID_PLACEHOLDER = "SPARK_EXECUTOR_ID"
APP_PLACEHOLDER = "SPARK_APPLICATION_ID"


def parse_volumes(conf: DataFrame, prefix: str) -> DataFrame:
    """One row per (type, name) of ``<prefix><type>.<name>.<property>`` settings.

    Rows that break a rule keep their values and say why in ``error``.
    """
    parts = F.split("key", r"\.")
    settings = conf_prefix(conf, prefix).select(
        "app_id",
        F.get(parts, F.lit(0)).alias("type"),
        F.get(parts, F.lit(1)).alias("name"),
        F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), ".").alias("prop"),
        "value",
    ).filter(F.col("name").isNotNull() & ~((F.col("name") == "") & (F.col("prop") == "")))
    wide = settings.groupBy("app_id", "type", "name").agg(
        *[F.max(F.when(F.col("prop") == p, F.col("value"))).alias(c) for p, c in _PROPS.items()]
    )
    read_only = F.lower(F.coalesce("read_only", F.lit("false")))
    return wide.withColumn("error", _volume_error(read_only)).withColumns({
        "read_only": read_only == "true",
        "sub_path": F.coalesce("sub_path", F.lit("")),
    })


def _volume_error(read_only: Column) -> Column:
    def needs(prop: str) -> Column:
        return F.concat(F.concat_ws(".", "type", "name", F.lit(prop)), F.lit(" is required for "), F.col("type"))

    error = F.when(F.col("mount_path").isNull(), needs("mount.path")).when(
        ~read_only.isin("true", "false"),
        F.concat(F.concat_ws(".", "type", "name", F.lit("mount.readOnly")), F.lit(" is not a boolean")),
    )
    for kind, required in VOLUME_TYPES.items():
        for prop in required:
            error = error.when((F.col("type") == kind) & F.col(_PROPS[prop]).isNull(), needs(prop))
    return error.when(
        ~F.col("type").isin(list(VOLUME_TYPES)),
        F.concat(F.lit("Volume type `"), F.col("type"), F.lit("` is not supported")),
    )


def volume_claims(volumes: DataFrame) -> DataFrame:
    """Claims to create: only when both storage class and size are given."""
    return volumes.filter(
        (F.col("type") == "persistentVolumeClaim")
        & F.col("storage_class").isNotNull()
        & F.col("size_limit").isNotNull()
    ).select(
        "app_id", "name", "claim_name", "storage_class",
        F.col("size_limit").alias("size"), F.lit(ACCESS_MODE).alias("access_mode"),
    )


def duplicate_mounts(volumes: DataFrame) -> DataFrame:
    """Mount paths an app uses more than once."""
    return volumes.groupBy("app_id", "mount_path").agg(F.count("*").alias("n")).filter("n > 1")


def index_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    levels: list[Column],
    name: str = "idx",
    first: int = 0,
) -> DataFrame:
    """Position of each row inside its group, counted without sorting whole groups.

    ``levels`` are bucket expressions that grow with ``order``.
    """
    placed = prefix_totals(df, keys, levels, order, F.lit(1), name)
    return placed.withColumn(name, F.col(name) + first) if first else placed


def substitute_placeholders(df: DataFrame, role: str) -> DataFrame:
    """Fill ids into claim names and scratch dirs.

    Needs ``app_id, prefix, claim_name, idx`` and, for executors, ``exec_id``; a
    ``dirs`` column is filled too when present.
    """
    index = F.col("idx").cast("string")
    if role == "driver":
        claim = F.replace("claim_name", F.lit(ON_DEMAND), F.concat("prefix", F.lit("-driver-pvc-"), index))
        return df.withColumn("claim_name", claim)
    ident = F.col("exec_id").cast("string")
    on_demand = F.concat("prefix", F.lit("-exec-"), ident, F.lit("-pvc-"), index)
    claim = F.replace(
        F.replace("claim_name", F.lit(ON_DEMAND), on_demand), F.lit(ID_PLACEHOLDER), ident
    )
    out = df.withColumn("claim_name", claim)
    if "dirs" in df.columns:
        dirs = F.replace("dirs", F.lit(APP_PLACEHOLDER), F.col("app_id").cast("string"))
        out = out.withColumn("dirs", F.replace(dirs, F.lit(ID_PLACEHOLDER), ident))
    return out
