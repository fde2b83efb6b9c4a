"""Derivations from flat application configuration, ``(app_id, key, value)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators.keyed import salted_lookup

# --- fixed values: registry of settings -------------------------------------------
# key, type, default, fallback key, check. ``check`` is positive, unit_interval, or
# the allowed values split by "|".
SETTINGS = [
    ("spark.kubernetes.context", "string", None, None, None),
    ("spark.kubernetes.driver.master", "string", "https://kubernetes.default.svc", None, None),
    ("spark.kubernetes.namespace", "string", "default", None, None),
    ("spark.kubernetes.container.image", "string", None, None, None),
    ("spark.kubernetes.driver.container.image", "string", None, "spark.kubernetes.container.image", None),
    ("spark.kubernetes.executor.container.image", "string", None, "spark.kubernetes.container.image", None),
    ("spark.kubernetes.container.image.pullPolicy", "string", "IfNotPresent", None, "Always|Never|IfNotPresent"),
    ("spark.kubernetes.container.image.pullSecrets", "string", "", None, None),
    ("spark.kubernetes.configMap.maxSize", "long", "1572864", None, None),
    ("spark.kubernetes.submission.requestTimeout", "int", "10000", None, None),
    ("spark.kubernetes.submission.connectionTimeout", "int", "10000", None, None),
    ("spark.kubernetes.driver.requestTimeout", "int", "10000", None, None),
    ("spark.kubernetes.driver.connectionTimeout", "int", "10000", None, None),
    ("spark.kubernetes.authenticate.driver.serviceAccountName", "string", None, None, None),
    ("spark.kubernetes.authenticate.executor.serviceAccountName", "string", None, None, None),
    ("spark.kubernetes.driver.limit.cores", "string", None, None, None),
    ("spark.kubernetes.driver.request.cores", "string", None, None, None),
    ("spark.kubernetes.submitInDriver", "boolean", "false", None, None),
    ("spark.kubernetes.executor.limit.cores", "string", None, None, None),
    ("spark.kubernetes.executor.scheduler.name", "string", None, None, None),
    ("spark.kubernetes.executor.request.cores", "string", None, None, None),
    ("spark.kubernetes.driver.pod.name", "string", None, None, None),
    ("spark.kubernetes.driver.resourceNamePrefix", "string", None, None, None),
    ("spark.kubernetes.executor.podNamePrefix", "string", None, None, None),
    ("spark.kubernetes.allocation.batch.size", "int", "5", None, "positive"),
    ("spark.kubernetes.allocation.batch.delay", "ms", "1s", None, "positive"),
    ("spark.kubernetes.allocation.executor.timeout", "ms", "600s", None, "positive"),
    ("spark.kubernetes.executor.lostCheck.maxAttempts", "int", "10", None, "positive"),
    ("spark.kubernetes.submission.waitAppCompletion", "boolean", "true", None, None),
    ("spark.kubernetes.report.interval", "ms", "1s", None, "positive"),
    ("spark.kubernetes.executor.apiPollingInterval", "ms", "30s", None, "positive"),
    ("spark.kubernetes.executor.eventProcessingInterval", "ms", "1s", None, "positive"),
    ("spark.kubernetes.memoryOverheadFactor", "double", "0.1", None, "unit_interval"),
    ("spark.kubernetes.pyspark.pythonVersion", "string", None, None, "3"),
    ("spark.kubernetes.kerberos.krb5.path", "string", None, None, None),
    ("spark.kubernetes.kerberos.krb5.configMapName", "string", None, None, None),
    ("spark.kubernetes.hadoop.configMapName", "string", None, None, None),
    ("spark.kubernetes.kerberos.tokenSecret.name", "string", None, None, None),
    ("spark.kubernetes.kerberos.tokenSecret.itemKey", "string", None, None, None),
    ("spark.kubernetes.resource.type", "string", None, None, "java|python|r"),
    ("spark.kubernetes.local.dirs.tmpfs", "boolean", "false", None, None),
    ("spark.kubernetes.driver.podTemplateFile", "string", None, None, None),
    ("spark.kubernetes.executor.podTemplateFile", "string", None, None, None),
    ("spark.kubernetes.driver.podTemplateContainerName", "string", None, None, None),
    ("spark.kubernetes.executor.podTemplateContainerName", "string", None, None, None),
    ("spark.kubernetes.executor.deleteOnTermination", "boolean", "true", None, None),
    ("spark.kubernetes.dynamicAllocation.deleteGracePeriod", "ms", "5s", None, None),
    ("spark.kubernetes.appKillPodDeletionGracePeriod", "s", None, None, None),
    ("spark.kubernetes.file.upload.path", "string", None, None, None),
    ("spark.kubernetes.executor.checkAllContainers", "boolean", "false", None, None),
    ("spark.kubernetes.executor.missingPodDetectDelta", "ms", "30s", None, "positive"),
]


def batch_settings(scheduler: str) -> list[tuple]:
    """Registry entries of a batch scheduler that goes by the given name."""
    base = f"spark.kubernetes.{scheduler}"
    return [
        (f"{base}.enabled", "boolean", "false", None, None),
        (f"{base}.queue", "string", "default", None, None),
        (f"{base}.scheduler", "string", scheduler, None, None),
        (f"{base}.maxRetry", "int", "3", None, None),
        (f"{base}.deleteDriverJob", "boolean", "false", None, None),
        (f"{base}.addExecutorOwnerReference", "boolean", "true", None, None),
    ]


# --- fixed values: milliseconds per time suffix ------------------------------------
TIME_UNITS = {"us": 0.001, "ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}

ENV_KEY = "[-._a-zA-Z][-._a-zA-Z0-9]*"

#: Tasks that share the rows of one app and key.
SLOTS = 8


def conf_prefix(conf: DataFrame, prefix: str) -> DataFrame:
    """Entries below a prefix, with the prefix cut off."""
    return conf.filter(F.col("key").startswith(prefix)).select(
        "app_id", F.substring("key", len(prefix) + 1, 2_147_483_647).alias("key"), "value"
    )


RESERVED_LABELS = {
    "driver": [S.APP_LABEL, S.ROLE_LABEL],
    "executor": [S.ID_LABEL, S.APP_LABEL, S.ROLE_LABEL, S.PROFILE_LABEL],
}


def merge_labels(conf: DataFrame, entities: DataFrame, role: str) -> DataFrame:
    """Custom labels and preset labels of every entity, one row per label.

    ``entities`` has ``app_id`` for drivers, plus ``exec_id, profile_id`` for
    executors. A custom label with a preset key comes back with ``rejected`` set.
    """
    ident = ["app_id"] if role == S.DRIVER_ROLE else S.MEMBER
    custom = conf_prefix(conf, f"spark.kubernetes.{role}.label.")
    mine = salted_lookup(entities, custom, ["app_id"], "inner", salt_by=ident).select(
        *ident, "key", "value",
        F.lit("custom").alias("source"),
        F.col("key").isin(RESERVED_LABELS[role]).alias("rejected"),
    )
    value = {
        S.APP_LABEL: F.col("app_id").cast("string"),
        S.ROLE_LABEL: F.lit(role),
    }
    if role != S.DRIVER_ROLE:
        value[S.ID_LABEL] = F.col("exec_id").cast("string")
        value[S.PROFILE_LABEL] = F.col("profile_id").cast("string")
    preset = F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), value[k].alias("value")) for k in RESERVED_LABELS[role]
    ])).alias("label")
    presets = entities.select(*ident, preset).select(
        *ident, "label.key", "label.value",
        F.lit("preset").alias("source"), F.lit(False).alias("rejected"),
    )
    return mine.unionByName(presets)


def _env(conf: DataFrame) -> DataFrame:
    return conf_prefix(conf, "spark.executorEnv.")


def _is_env_key() -> Column:
    return F.col("key").rlike(rf"\A{ENV_KEY}\z")


def valid_env(conf: DataFrame) -> DataFrame:
    """Executor environment entries whose key is a legal variable name."""
    return _env(conf).filter(_is_env_key())


def invalid_env(conf: DataFrame) -> DataFrame:
    return _env(conf).filter(~_is_env_key())


def settings_by_app(conf: DataFrame, keys: list[str], order: str | None = None, every_app: bool = True) -> DataFrame:
    """One row per app with a map of the named settings only.

    Values are reduced to one per (app, key) first, so the map never has more
    entries than ``keys``, however many rows an app has. With ``order`` the last of several
    values of a key counts, as a later assignment does; without an order the largest does,
    so that the result does not depend on chance. An app with none of the keys has an
    empty map, or no row if ``every_app`` is not set.

    Only rows with one of the keys are shuffled, with a number for the key; the apps
    themselves are combined before they are sent. A value is a string, which Spark
    aggregates by sorting. Rows are therefore dealt out before any of them is sorted:
    first by app, key and a slot, so that an app with very many rows is shared by several
    tasks, then the few rows left by app. A task that reads much sorts nothing, and
    sorting tasks get even shares.
    """
    names = F.array(*[F.lit(k) for k in sorted(set(keys))]).cast("array<string>")
    rows = conf.filter(F.col("key").isin(keys)).select(
        "app_id", F.array_position(names, F.col("key")).cast("int").alias("place"), "value",
        *([] if order is None else [F.col(order).alias("at")]),
        F.pmod(F.spark_partition_id(), F.lit(SLOTS)).alias("slot"),
    )
    value = F.max("value") if order is None else F.max_by("value", "at")
    last = [value.alias("value")] + ([] if order is None else [F.max("at").alias("at")])
    dealt = rows.repartition("app_id", "place", "slot").groupBy("app_id", "place", "slot").agg(*last).drop("slot")
    if every_app:
        dealt = conf.select("app_id").distinct().unionByName(dealt, allowMissingColumns=True)
    single = dealt.repartition("app_id").groupBy("app_id", "place").agg(value.alias("value"))
    found = F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "value")))
    entries = F.transform(found, lambda e: F.struct(F.element_at(names, e["place"]).alias("key"), e["value"].alias("value")))
    return single.groupBy("app_id").agg(F.map_from_entries(entries).alias("conf"))


def resolve_conf(conf: DataFrame, settings: list[tuple] | None = None, order: str | None = None) -> DataFrame:
    """Effective value, origin and violation of every registry entry for every app.

    ``order`` names the column by which the last of several values of a key is told.
    """
    settings = settings or SETTINGS
    apps = settings_by_app(conf, [s[0] for s in settings], order)
    entry = F.explode(F.array(*[
        F.struct(*[F.lit(v).cast("string").alias(n) for n, v in
                   zip(["key", "type", "default", "fallback", "check"], s)])
        for s in settings
    ])).alias("e")
    rows = apps.select("app_id", "conf", entry).select(
        "app_id", "e.*",
        F.col("conf")[F.col("e.key")].alias("own"),
        F.col("conf")[F.col("e.fallback")].alias("other"),
    )
    source = (
        F.when(F.col("own").isNotNull(), "set")
        .when(F.col("other").isNotNull(), "fallback")
        .when(F.col("default").isNotNull(), "default")
        .otherwise("none")
    )
    typed = rows.withColumns({
        "value": F.coalesce("own", "other", "default"), "source": source,
    }).withColumn("number", _number())
    return typed.select("app_id", "key", "type", "value", "source", "number", _violation().alias("violation"))


def _number() -> Column:
    value = F.trim("value")
    timed = F.lower(value)  # units count in either case
    amount = F.regexp_extract(timed, r"^(-?[0-9]+)([a-z]*)$", 1).try_cast("double")
    unit = F.nullif(F.regexp_extract(timed, r"^(-?[0-9]+)([a-z]*)$", 2), F.lit(""))
    scale = F.create_map(*[F.lit(x) for kv in TIME_UNITS.items() for x in (kv[0], float(kv[1]))])
    millis = amount * scale[F.coalesce(unit, F.col("type"))]
    # durations are whole units of the setting
    return (
        F.when(F.col("type") == "ms", F.floor(millis).cast("double"))
        .when(F.col("type") == "s", F.floor(millis / 1000).cast("double"))
        .when(F.col("type") == "int", value.try_cast("int").cast("double"))
        .when(F.col("type") == "long", value.try_cast("bigint").cast("double"))
        .when(F.col("type") == "double", value.try_cast("double"))
    )


def _violation() -> Column:
    numeric = F.col("type").isin("int", "long", "double", "ms", "s")
    known = F.col("value").isNotNull()
    is_bool = F.lower(F.trim("value")).isin("true", "false")
    allowed = F.split("check", r"\|")
    return (
        F.when(~known, F.lit(None).cast("string"))
        .when(numeric & F.col("number").isNull(), "unreadable")
        .when((F.col("type") == "boolean") & ~is_bool, "unreadable")
        .when((F.col("check") == "positive") & ~(F.col("number") > 0), "not positive")
        .when(
            (F.col("check") == "unit_interval") & ~((F.col("number") >= 0) & (F.col("number") < 1)),
            "not in [0, 1)",
        )
        .when(
            (F.col("type") == "string") & F.col("check").isNotNull()
            & ~F.array_contains(allowed, F.col("value")),
            "not allowed",
        )
    )


def check_options(conf: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Violations of pairwise rules ``(rule, first, second)``.

    Rules: ``both_or_neither``, ``second_if_first``, ``not_both``.
    """
    keys = sorted({k for _, a, b in rules for k in (a, b)})
    # an app with none of the keys breaks no rule
    apps = settings_by_app(conf, keys, every_app=False)

    def broken(rule: str, first: str, second: str) -> Column:
        a, b = F.col("conf")[first].isNotNull(), F.col("conf")[second].isNotNull()
        test = {"both_or_neither": a != b, "second_if_first": a & ~b, "not_both": a & b}[rule]
        return F.when(
            test,
            F.struct(F.lit(rule).alias("rule"), F.lit(first).alias("first"), F.lit(second).alias("second")),
        )

    found = F.explode(F.array_compact(F.array(*[broken(*r) for r in rules]))).alias("v")
    return apps.select("app_id", found).select("app_id", "v.*")


# --- fixed values: ports ------------------------------------------------------------
DRIVER_PORT = "7078"
BLOCK_MANAGER_PORT = "7079"

# setting, then the places to look in order: (source, key or literal)
_CHAINS = [
    ("driver_port", [("conf", "spark.driver.port"), ("default", DRIVER_PORT)]),
    ("driver_block_manager_port", [
        ("conf", "spark.driver.blockManager.port"), ("shared", "spark.blockManager.port"),
        ("default", BLOCK_MANAGER_PORT)]),
    ("service_block_manager_port", [
        ("conf", "spark.driver.blockManager.port"), ("default", BLOCK_MANAGER_PORT)]),
    ("executor_block_manager_port", [
        ("conf", "spark.blockManager.port"), ("default", BLOCK_MANAGER_PORT)]),
    ("executor_python", [("conf", "spark.pyspark.python"), ("env", "PYSPARK_PYTHON")]),
    ("driver_python", [
        ("conf", "spark.pyspark.driver.python"), ("shared", "spark.pyspark.python"),
        ("env", "PYSPARK_DRIVER_PYTHON"), ("shared_env", "PYSPARK_PYTHON")]),
    ("app_type", [("conf", "spark.kubernetes.resource.type"), ("default", "java")]),
]
_ENV = "env:"


def effective_settings(
    conf: DataFrame, env: DataFrame | None = None, mounted_dirs: DataFrame | None = None
) -> DataFrame:
    """Winning value and source of derived settings, one row per app and setting.

    ``env`` is ``(app_id, key, value)``; ``mounted_dirs`` ``(app_id, idx, path)`` are
    scratch dirs an app already mounts, which win over every other source. Local
    dirs come back as ``local_dir_1``, ``local_dir_2``, ...
    """
    keys = ["spark.local.dir", _ENV + "SPARK_LOCAL_DIRS"]
    for _, places in _CHAINS:
        keys += [(_ENV + k if "env" in s else k) for s, k in places if s != "default"]
    everything = conf.select("app_id", "key", "value")
    if env is not None:
        everything = everything.unionByName(
            env.select("app_id", F.concat(F.lit(_ENV), "key").alias("key"), "value")
        )
    apps = settings_by_app(everything, sorted(set(keys)))

    def pick(source: str, place: str) -> Column:
        if source == "default":
            return F.lit(place)
        return F.col("conf")[_ENV + place if "env" in source else place]

    def chain(name: str, places: list[tuple[str, str]]) -> Column:
        found = reduce(
            lambda acc, p: acc.when(pick(*p).isNotNull(), F.struct(pick(*p).alias("value"), F.lit(p[0]).alias("source"))),
            places[1:],
            F.when(pick(*places[0]).isNotNull(),
                   F.struct(pick(*places[0]).alias("value"), F.lit(places[0][0]).alias("source"))),
        )
        return F.struct(F.lit(name).alias("setting"), found["value"].alias("value"), found["source"].alias("source"))

    # one pass for all settings: apps with mounted dirs are marked rather than taken out in a second one
    if mounted_dirs is not None:
        marks = mounted_dirs.select("app_id", F.lit(True).alias("mounted")).distinct()
        apps = apps.join(marks, "app_id", "left")
    else:
        apps = apps.withColumn("mounted", F.lit(None).cast("boolean"))
    dirs = chain("local_dir", [
        ("env", "SPARK_LOCAL_DIRS"), ("conf", "spark.local.dir"), ("default", "")])
    paths = F.when(
        dirs["source"] == "default", F.concat(F.lit("/var/data/spark-"), F.col("app_id").cast("string"))
    ).otherwise(dirs["value"])
    local = F.transform(
        F.split(F.regexp_replace(paths, ",+$", ""), ","),
        lambda path, pos: F.struct(
            F.concat(F.lit("local_dir_"), pos + 1).alias("setting"), path.alias("value"), dirs["source"].alias("source")),
    )
    plain = F.array(*[chain(*c) for c in _CHAINS])
    settings = F.when(F.col("mounted") | local.isNull(), plain).otherwise(F.concat(plain, local))
    port = F.col("value").try_cast("int")
    legal = F.when(
        F.col("setting").endswith("_port"),
        F.coalesce((port == 0) | port.between(1024, 65535), F.lit(False)),
    )
    found = apps.select("app_id", F.explode(settings).alias("s")).select("app_id", "s.*").filter(
        F.col("value").isNotNull()).withColumn("legal", legal)
    if mounted_dirs is not None:
        found = found.unionByName(mounted_dirs.select(
            "app_id", F.concat(F.lit("local_dir_"), "idx").alias("setting"),
            F.col("path").alias("value"), F.lit("mounted").alias("source"),
            F.lit(None).cast("boolean").alias("legal"),
        ))
    return found
