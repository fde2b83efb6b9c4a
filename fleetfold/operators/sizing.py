"""Memory and core requests of drivers and executors, in MiB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.operators.keyed import salted_lookup

# --- fixed values ---------------------------------------------------------------------
JVM_FACTOR = 0.1
NON_JVM_FACTOR = 0.4
MIN_OVERHEAD_MIB = 384


def effective_factor() -> Column:
    """Explicit overhead factor, else a default that depends on the app type."""
    return F.coalesce(
        "factor", F.when(F.col("kind").isin("python", "r"), NON_JVM_FACTOR).otherwise(JVM_FACTOR)
    )


def _overhead() -> Column:
    # the product is cut to a whole number before it meets the minimum
    share = F.floor(effective_factor() * F.col("memory_mib")).cast("bigint")
    return F.coalesce("overhead_mib", F.greatest(share, F.lit(MIN_OVERHEAD_MIB)))


def size_driver(apps: DataFrame) -> DataFrame:
    """``memory_mib, overhead_mib, factor, kind, cores, request_cores, limit_cores`` in."""
    return apps.select(
        "app_id",
        effective_factor().alias("factor"),
        _overhead().cast("bigint").alias("overhead_mib"),
        (F.col("memory_mib") + _overhead()).cast("bigint").alias("total_mib"),
        F.coalesce("request_cores", F.col("cores").cast("string")).alias("cpu_request"),
        F.col("limit_cores").alias("cpu_limit"),
    )


def size_executor(apps: DataFrame, profiles: DataFrame) -> DataFrame:
    """Total memory and cores per profile; profile 0 follows the app's settings.

    ``profiles`` overrides are null where a profile leaves the app's value alone.
    The overhead share is taken from the app's memory, also for other profiles.
    """
    base = apps.select(
        "app_id", "kind",
        F.col("memory_mib").alias("a_memory"),
        _overhead().alias("a_overhead"),
        F.coalesce("offheap_mib", F.lit(0)).alias("a_offheap"),
        F.coalesce("pyspark_mib", F.lit(0)).alias("a_pyspark"),
        F.col("cores").alias("a_cores"),
        F.col("request_cores").alias("a_request"),
        F.col("limit_cores").alias("a_limit"),
    )
    joined = salted_lookup(profiles, base, ["app_id"], "inner", salt_by=["profile_id"])
    default = F.col("profile_id") == 0

    def pick(name: str) -> Column:
        return F.when(default, F.col(f"a_{name}")).otherwise(
            F.coalesce(f"{name}_mib", f"a_{name}")
        )

    pyspark = F.when(F.col("kind") == "python", pick("pyspark")).otherwise(0)
    cores = F.when(default, F.col("a_cores")).otherwise(F.coalesce("cores", "a_cores"))
    total = pick("memory") + pick("overhead") + pick("offheap") + pyspark
    return joined.select(
        "app_id",
        "profile_id",
        pick("memory").cast("bigint").alias("memory_mib"),
        pick("overhead").cast("bigint").alias("overhead_mib"),
        total.cast("bigint").alias("total_mib"),
        F.concat(total.cast("bigint").cast("string"), F.lit("Mi")).alias("quantity"),
        F.when(default, F.coalesce("a_request", cores.cast("string")))
        .otherwise(cores.cast("string")).alias("cpu_request"),
        F.when(default, F.col("a_limit")).alias("cpu_limit"),
    )


def custom_resources(requests: DataFrame, strict: bool = False) -> DataFrame:
    """``vendor/name`` with its amount; a request without vendor is an error."""
    missing = F.coalesce(F.col("vendor") == "", F.lit(True))
    text = F.concat(F.lit("Resource: "), "name", F.lit(" was requested, but vendor was not specified."))
    name = F.concat_ws("/", "vendor", "name")
    if strict:
        return requests.select(
            "app_id", F.when(missing, F.raise_error(text)).otherwise(name).alias("resource"), "amount"
        )
    return requests.select(
        "app_id",
        F.when(~missing, name).alias("resource"),
        "amount",
        F.when(missing, text).alias("error"),
    )
