"""Column expressions over one observed document (see ``schema.POD``).

All of them are built-in expressions. Containers and conditions are addressed as
arrays of one field (``containers.name``) where possible: that stays inside code
generation, and a file scan then reads only the named nested fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetfold import schema as S


def _or_na(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("N/A"))


def is_deleted() -> Column:
    """A deletion time is set and the phase is not one that is still winding down."""
    winding_down = F.coalesce(F.lower("phase").isin("terminating", "running"), F.lit(False))
    return F.col("deletion_ts").isNotNull() & ~winding_down


def is_inactive(labels: str = "labels") -> Column:
    return F.col(labels)[S.INACTIVE_LABEL].eqNullSafe("true")


def exit_code() -> Column:
    """Exit code of the first terminated container, whatever its name; -1 if none."""
    codes = F.array_compact(F.col("containers.terminated.exit_code"))
    return F.coalesce(F.get(codes, F.lit(0)), F.lit(S.UNKNOWN_EXIT_CODE))


def _field_of(array: str, key: str, value: str, field: str) -> Column:
    """``field`` of the first element whose ``key`` is ``value``; null if there is none."""
    at = F.array_position(F.col(f"{array}.{key}"), F.lit(value)).cast("int") - 1
    return F.get(F.col(f"{array}.{field}"), at)


def main_exit_code(main_name: str = S.EXECUTOR_CONTAINER) -> Column:
    """Exit code of the container called ``main_name``; null while it has none."""
    return _field_of("containers", "name", main_name, "terminated.exit_code")


def state_code(check_all: bool = False, main_name: str = S.EXECUTOR_CONTAINER) -> Column:
    """Integer state (position in ``schema.STATES``).

    The integer form lets `max_by` keep a fixed-width buffer, which Spark
    aggregates by hash; a string value would force a sort.
    """
    code = {name: F.lit(i) for i, name in enumerate(S.STATES)}
    phase = F.lower("phase")
    main = main_exit_code(main_name)
    running = (
        F.when(main == 0, code["succeeded"])
        .when(main.isNotNull(), code["failed"])
        .otherwise(code["running"])
    )
    if check_all:
        broken = F.exists(
            F.col("containers.terminated.exit_code"), lambda c: F.coalesce(c != 0, F.lit(False))
        )
        running = F.when(
            F.col("restart_policy").eqNullSafe("Never") & F.coalesce(broken, F.lit(False)),
            code["failed"],
        ).otherwise(running)
    return (
        F.when(is_deleted(), code["deleted"])
        .when(phase == "pending", code["pending"])
        .when(phase == "running", running)
        .when(phase == "failed", code["failed"])
        .when(phase == "succeeded", code["succeeded"])
        .when(phase == "terminating", code["terminating"])
        .otherwise(code["unknown"])
    )


def state_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in S.STATES]), code + 1)


def is_final(state: Column) -> Column:
    return state.isin(S.FINAL_STATES)


def _pair(label: str, value: Column, indent: int) -> Column:
    return F.concat(F.lit("\n" + "\t" * indent + f" {label}: "), _or_na(value))


def container_summary(indent: int = 1) -> Column:
    """Text block per container: name, image, then the fields of its state.

    A container that reports several states shows the first of running,
    terminated, waiting.
    """

    def one(c: Column) -> Column:
        running = F.concat(
            _pair("container state", F.lit("running"), indent),
            _pair("container started at", c["running"]["started_at"], indent),
        )
        terminated = F.concat(
            _pair("container state", F.lit("terminated"), indent),
            _pair("container started at", c["terminated"]["started_at"], indent),
            _pair("container finished at", c["terminated"]["finished_at"], indent),
            _pair("exit code", c["terminated"]["exit_code"].cast("string"), indent),
            _pair("termination reason", c["terminated"]["reason"], indent),
        )
        waiting = F.concat(
            _pair("container state", F.lit("waiting"), indent),
            _pair("pending reason", c["waiting"]["reason"], indent),
        )
        state = (
            F.when(c["running"].isNotNull(), running)
            .when(c["terminated"].isNotNull(), terminated)
            .when(c["waiting"].isNotNull(), waiting)
            .otherwise(_pair("container state", F.lit(None).cast("string"), indent))
        )
        return F.concat(
            _pair("container name", c["name"], indent),
            _pair("container image", c["image"], indent),
            state,
        )

    return F.coalesce(F.array_join(F.transform("containers", one), "\n\n"), F.lit(""))


def status_report() -> Column:
    """Label/value lines of one document; null or empty values print ``N/A``."""
    labels = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("labels")),
            lambda e: F.concat_ws(" -> ", e["key"], e["value"]),
        ),
        ", ",
    )
    return F.concat(
        _pair("pod name", F.col("name"), 1),
        _pair("namespace", F.col("namespace"), 1),
        _pair("labels", labels, 1),
        _pair("pod uid", F.col("uid"), 1),
        _pair("creation time", F.col("creation_ts"), 1),
        _pair("service account name", F.col("service_account"), 1),
        _pair("volumes", F.array_join("volumes", ", "), 1),
        _pair("node name", F.col("node_name"), 1),
        _pair("start time", F.col("start_time"), 1),
        _pair("phase", F.col("phase"), 1),
        _pair("container status", container_summary(2), 1),
    )


def exit_message(state: Column, code: Column) -> Column:
    """Why a member left, as one text."""
    deleted = F.concat(
        F.lit("The executor with id "), F.col("exec_id").cast("string"),
        F.lit(" was deleted by a user or the framework."),
    )
    exited = F.concat(
        F.lit("\nThe executor with id "), F.col("exec_id").cast("string"),
        F.lit(" exited with exit code "), code.cast("string"),
        F.lit(".\nThe API gave the following brief reason: "),
        F.coalesce("reason", F.lit("N/A")),
        F.lit("\nThe API gave the following message: "),
        F.coalesce("message", F.lit("N/A")),
        F.lit("\nThe API gave the following container statuses:\n\n"),
        container_summary(), F.lit("\n"),
    )
    return F.when(state == "deleted", deleted).otherwise(exited)


def is_ready() -> Column:
    return F.coalesce(_field_of("conditions", "type", "Ready", "status") == "True", F.lit(False))


def start_ms() -> Column:
    """Start time as epoch milliseconds; null when missing or unreadable."""
    return F.unix_millis(F.try_to_timestamp(F.col("start_time")))


def is_terminal_app() -> Column:
    """Case-sensitive on purpose: only these two spellings end an application."""
    return F.coalesce(F.col("phase").isin("Succeeded", "Failed"), F.lit(False))


def job_phase(phase: str = "phase") -> Column:
    return F.coalesce(F.col(phase), F.lit("Unknown"))


def is_terminal_job(phase: str = "phase") -> Column:
    return F.lower(job_phase(phase)).isin("aborted", "terminated", "failed", "completed")
