"""Selection of documents and readable status reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.functions import pods as P
from fleetfold.operators.keyed import salted_lookup
from fleetfold.operators.state import latest_state
from fleetfold.sources.scratch import materialize


def select_labels(
    df: DataFrame,
    eq: Mapping[str, str] | None = None,
    in_: Mapping[str, Sequence[str] | DataFrame] | None = None,
    not_: Mapping[str, str] | None = None,
    phase: str | None = None,
    namespace: str | None = None,
) -> DataFrame:
    """Label selector: equality, IN, absent-or-different; field and namespace filters.

    An IN list may be a one-column DataFrame, which becomes a semi join.
    """
    labels = F.col("labels")
    test = F.lit(True)
    for name, value in (eq or {}).items():
        test = test & (labels[name] == value)
    for name, value in (not_ or {}).items():
        test = test & ~labels[name].eqNullSafe(value)
    if phase is not None:
        test = test & (F.col("phase") == phase)
    if namespace is not None:
        test = test & (F.col("namespace") == namespace)
    out = df.filter(test)
    for name, values in (in_ or {}).items():
        if isinstance(values, DataFrame):
            wanted = values.select(F.col(values.columns[0]).alias("_wanted"))
            out = out.join(wanted, labels[name] == F.col("_wanted"), "left_semi")
        else:
            out = out.filter(labels[name].isin(list(values)))
    return out


def _id_parts(ident: Column) -> tuple[Column, Column]:
    parts = F.split(ident, ":", 2)
    has_ns = F.size(parts) == 2
    return (
        F.when(has_ns, F.get(parts, F.lit(0))),
        F.when(has_ns, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))),
    )


def select_apps(pods: DataFrame, submission_id: str) -> DataFrame:
    """Documents for ``[namespace:]name``; a trailing ``*`` matches driver prefixes."""
    namespace, _, name = submission_id.rpartition(":") if submission_id.count(":") < 2 else (
        *submission_id.partition(":")[:2], submission_id.partition(":")[2])
    scope = F.col("namespace") == namespace if ":" in submission_id else F.lit(True)
    if name.endswith("*"):
        hit = F.col("name").startswith(name[:-1]) & (F.col("labels")[S.ROLE_LABEL] == S.DRIVER_ROLE)
    else:
        hit = F.col("name") == name
    return pods.filter(scope & hit)


def matched_names(names: DataFrame, requests: DataFrame) -> DataFrame:
    """submission_id, namespace and name of every match, from a dictionary of names.

    ``names`` (namespace, name, is_driver) has one row per name. A name is looked up as
    it is for the requests without an asterisk, and, for a driver, by its own prefixes
    of the lengths that were asked for: prefixes become equality, the join stays
    hash-based, and only names are multiplied, never documents. Both kinds share
    one lookup, which is salted because a short prefix may match every driver.
    """
    namespace, name = _id_parts(F.col("submission_id"))
    asked = requests.select("submission_id", namespace.alias("_ns"), name.alias("_name")).distinct()
    is_glob = F.col("_name").endswith("*")
    wanted = asked.select(
        "submission_id", "_ns", is_glob.alias("_glob"),
        F.when(is_glob, F.expr("left(_name, length(_name) - 1)")).otherwise(F.col("_name")).alias("_text"),
    )
    # a set of lengths of names, so at most a few hundred numbers
    lengths = wanted.agg(F.coalesce(F.collect_set(F.when(F.col("_glob"), F.length("_text"))), F.array().cast("array<int>"))).scalar()
    keys = F.when(F.col("is_driver"), F.filter("_lengths", lambda n: n <= F.length("name"))).otherwise(F.array().cast("array<int>"))
    looked = names.withColumn("_lengths", lengths).withColumn("_len", F.explode(F.concat(F.array(F.lit(-1)), keys))).select(
        "namespace", "name", (F.col("_len") >= 0).alias("_glob"),
        F.when(F.col("_len") < 0, F.col("name")).otherwise(F.expr("left(name, _len)")).alias("_text"),
    )
    found = salted_lookup(looked, wanted, ["_glob", "_text"], "inner", salt_by=["namespace", "name"])
    return found.filter(F.col("_ns").isNull() | (F.col("_ns") == F.col("namespace"))).select("submission_id", "namespace", "name")


def _names(pods: DataFrame) -> DataFrame:
    is_driver = F.coalesce(F.col("labels")[S.ROLE_LABEL] == S.DRIVER_ROLE, F.lit(False))
    return pods.select("namespace", "name", is_driver.alias("is_driver")).distinct()


def select_many_apps(pods: DataFrame, requests: DataFrame) -> DataFrame:
    """:func:`select_apps` for a table of ids: each match with its ``submission_id``.

    Requests are matched with the dictionary of the documents' names; documents are
    joined once at the end, by name. A name may have most documents, and a request
    matches a driver's prefix only by documents in the driver's role.
    """
    is_driver = F.coalesce(F.col("labels")[S.ROLE_LABEL] == S.DRIVER_ROLE, F.lit(False))
    matches = matched_names(_names(pods), requests).withColumn("_glob", F.col("submission_id").endswith("*")).distinct()
    found = salted_lookup(pods, matches, ["namespace", "name"], "inner", salt_by=["uid"])
    return found.filter(~F.col("_glob") | is_driver).drop("_glob")


def container_summary(pods: DataFrame) -> DataFrame:
    return pods.withColumn("summary", P.container_summary())


def status_report(pods: DataFrame) -> DataFrame:
    return pods.withColumn("report", P.status_report())


#: What a report reads of a document.
_REPORTED = ["labels", "uid", "creation_ts", "service_account", "volumes", "node_name", "start_time", "phase", "containers"]


def status_rows(requests: DataFrame, pods: DataFrame) -> DataFrame:
    """Report lines for every requested id, or one line that says nothing was found.

    A report is of a document as it is now: the last one per name. The requests are matched
    once; the ids without a match are found in the written matches.
    """
    current = latest_state(pods, ["seq", *_REPORTED], keys=["namespace", "name"])
    found = materialize(status_report(select_many_apps(current, requests)).select(
        "submission_id", F.lit(True).alias("found"), F.concat(F.lit("Application status (driver): "), "report").alias("line"),
    ), "status-found")
    none = F.when(F.col("submission_id").endswith("*"), "No applications found.").otherwise("Application not found.")
    missing = requests.select("submission_id").distinct().join(
        found.select("submission_id").distinct(), "submission_id", "left_anti"
    )
    return found.unionByName(missing.select("submission_id", F.lit(False).alias("found"), none.alias("line")))


def status_report_sink(requests: DataFrame, pods: DataFrame, path: str) -> None:
    """Write the status lines as text."""
    status_rows(requests, pods).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
