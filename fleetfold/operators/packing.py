"""Bundles of small text files under a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators.conf import settings_by_app
from fleetfold.operators.keyed import prefix_totals, salted_lookup
from fleetfold.operators.names import bundle_name
from fleetfold.sources.conf_files import to_properties
from fleetfold.sources.scratch import materialize

#: Files of one size that one task sorts.
_SORTED = 4096


def utf16_units(text: Column) -> Column:
    """String length in UTF-16 units, the unit the budget is counted in."""
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(text) + astral


def measure_files(files: DataFrame, budget: int = S.BUNDLE_BUDGET) -> DataFrame:
    """``size`` orders files (name length + bytes), ``cost`` fills the budget (chars).

    Files over the budget and undecodable ones (null content) take no part.
    """
    name_len = utf16_units(F.col("file_name"))
    return (
        files.filter(F.col("content").isNotNull())
        .select(
            "app_id", "file_name",
            (name_len + F.col("n_bytes")).cast("bigint").alias("size"),
            (name_len + utf16_units(F.col("content"))).cast("bigint").alias("cost"),
        )
        .filter(F.col("size") <= budget)
    )


def pack_by_budget(files: DataFrame, budget: int = S.BUNDLE_BUDGET) -> DataFrame:
    """Files taken in (size, name) order while they fit; misfits are passed over.

    Taking is a running decision, but it has a closed form. Files are taken up to
    the first misfit, which a prefix sum finds. A later file has at least a third of
    the first misfit's size in characters, because UTF-8 spends at most three bytes
    per UTF-16 unit, and that is at least a third of the room left; so at most two
    more files can be taken, and two minimum searches find them.
    """
    # contents are read once; every later step uses the narrow copy
    sized = materialize(measure_files(files, budget), "file-sizes")
    return _pack(sized, budget)


def _pack(sized: DataFrame, budget: int) -> DataFrame:
    # 1. prefix sums over sizes decide all but one size per app
    by_size = sized.groupBy("app_id", "size").agg(F.sum("cost").alias("cost"), F.count("*").alias("_rows"))
    sums = prefix_totals(
        by_size, ["app_id"], [F.floor(F.col("size") / F.lit(4096))], ["size"], F.col("cost"), "_before"
    )
    open_sizes = sums.filter(F.col("_before") < budget).select(
        "app_id", "size", "_before", (F.col("_before") + F.col("cost") < budget).alias("_whole"),
        F.ceil(F.col("_rows") / F.lit(_SORTED)).alias("_slots"),
    )
    placed = materialize(
        salted_lookup(sized, open_sizes, ["app_id", "size"], "inner", salt_by=["file_name"]),
        "open-sizes",
    )
    whole = placed.filter("_whole").select("app_id", "file_name", "size", "cost")
    # 2. the size where the budget ends: only its first names can matter. A file of
    # this size costs at least a third of it, which bounds how many; the bound is
    # applied per salt first, and a size has salts by its number of files, so no task
    # sorts all files of one size.
    edge = placed.filter(~F.col("_whole")).withColumn("_slot", F.pmod(F.xxhash64("file_name"), F.col("_slots")))
    most = F.floor((budget - F.col("_before")) * 3 / F.greatest("size", F.lit(1))) + 2
    near = Window.partitionBy("app_id", "size", "_slot").orderBy("file_name")
    first = edge.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= most)
    running = Window.partitionBy("app_id", "size").orderBy("file_name").rowsBetween(
        Window.unboundedPreceding, 0
    )
    edged = first.withColumn("_sum", F.col("_before") + F.sum("cost").over(running))
    prefix = whole.unionByName(
        edged.filter(F.col("_sum") < budget).select("app_id", "file_name", "size", "cost")
    )
    # 3. at most two files behind the first misfit
    misfit = edged.filter(F.col("_sum") >= budget).groupBy("app_id").agg(
        F.min(F.struct("size", "file_name")).alias("at")
    )
    used = prefix.groupBy("app_id").agg(F.sum("cost").alias("used"))
    room = misfit.join(used, "app_id", "left").select(
        "app_id", "at", (budget - F.coalesce("used", F.lit(0))).alias("room")
    )
    second = materialize(_next_fit(sized, materialize(room, "room")), "second-fit")
    third = _next_fit(
        sized,
        second.select(
            "app_id", F.struct("size", "file_name").alias("at"), (F.col("room") - F.col("cost")).alias("room")
        ),
    )
    late = second.unionByName(third).select("app_id", "file_name", "size", "cost")
    return prefix.unionByName(late)


def _next_fit(sized: DataFrame, room: DataFrame) -> DataFrame:
    """First file behind ``at`` that costs less than ``room``, per app."""
    open_to = salted_lookup(sized, room, ["app_id"], "inner", salt_by=["file_name"])
    fits = (F.struct("size", "file_name") > F.col("at")) & (F.col("cost") < F.col("room"))
    best = open_to.filter(fits).groupBy("app_id").agg(
        F.min(F.struct("size", "file_name", "cost", "room")).alias("b")
    )
    return best.select("app_id", "b.*")


def file_verdicts(files: DataFrame, budget: int = S.BUNDLE_BUDGET) -> DataFrame:
    """app_id, file_name, taken and, for a file that is left out, its ``reason``.

    Reasons: ``encoding`` (no content), ``size`` (over the budget by itself), ``budget`` (the
    bundle had no room for it).
    """
    sized = materialize(measure_files(files, budget), "file-sizes")
    taken = _pack(sized, budget).select("app_id", "file_name", F.lit(True).alias("_taken"))
    name_len = utf16_units(F.col("file_name"))
    judged = files.select(
        "app_id", "file_name",
        F.when(F.col("content").isNull(), "encoding").when(name_len + F.col("n_bytes") > budget, "size").alias("_why"),
    ).join(taken, ["app_id", "file_name"], "left")
    return judged.select(
        "app_id", "file_name", F.coalesce("_taken", F.lit(False)).alias("taken"),
        F.when(F.col("_taken").isNull(), F.coalesce("_why", F.lit("budget"))).alias("reason"),
    )


def properties_file(properties: DataFrame, prefix: Column | None = None) -> DataFrame:
    """app_id and content: the resolved properties of an app as one text, sorted by key, below a header.

    Properties of one app are a file of their own, so its size is that of the entries;
    of several values of a key the largest is taken.
    """
    single = properties.groupBy("app_id", "key").agg(F.max("value").alias("value"))
    base = F.col("app_id").cast("string") if prefix is None else prefix
    lines = F.array_join(F.sort_array(F.collect_list("value")), "\n")
    text = to_properties(single).groupBy("app_id").agg(lines.alias("_lines"))
    header = F.concat(F.lit(S.PROPERTIES_HEADER), bundle_name(base), F.lit("\n"))
    return text.select("app_id", F.concat(header, "_lines", F.lit("\n")).alias("content"))


def write_conf_bundle(
    files: DataFrame,
    labels: DataFrame | None = None,
    label_keys: list[str] | None = None,
    prefix: Column | None = None,
    budget: int = S.BUNDLE_BUDGET,
    properties: DataFrame | None = None,
) -> DataFrame:
    """One row per app of ``files``: bundle name, labels and a map from file name to content.

    An app none of whose files fits or can be decoded has an empty map. Apps with
    resolved ``properties`` (app_id, key, value) have them as one more file, named
    ``S.PROPERTIES_FILE``, in place of a file of that name and outside the budget.

    The data map holds the packed files only, so its size is bounded by ``budget``;
    the labels map holds the labels of ``(app_id, key, value)`` named in
    ``label_keys``, so it is bounded by that list.
    """
    taken = pack_by_budget(files, budget).select("app_id", "file_name")
    packed = files.join(taken, ["app_id", "file_name"], "left_semi").select("app_id", "file_name", "content")
    apps = files.select("app_id")
    if properties is not None:
        own = properties_file(properties, prefix).select("app_id", F.lit(S.PROPERTIES_FILE).alias("file_name"), "content")
        replaced = packed.filter(F.col("file_name") == S.PROPERTIES_FILE).join(own, ["app_id", "file_name"], "left_anti")
        packed = packed.filter(F.col("file_name") != S.PROPERTIES_FILE).unionByName(replaced).unionByName(own)
        apps = apps.unionByName(properties.select("app_id"))
    filled = packed.groupBy("app_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("file_name", "content")))).alias("data")
    )
    empty = F.create_map().cast("map<string,string>")
    data = apps.distinct().join(filled, "app_id", "left").withColumn("data", F.coalesce("data", empty))
    base = F.col("app_id").cast("string") if prefix is None else prefix
    out = data.select("app_id", bundle_name(base).alias("name"), "data")
    if labels is not None:
        tags = settings_by_app(labels, label_keys).withColumnRenamed("conf", "labels")
        out = out.join(tags, "app_id", "left")
    return out


def sorted_keys(bundle: DataFrame) -> DataFrame:
    """File names of a bundle in name order."""
    return bundle.withColumn("keys", F.sort_array(F.map_keys("data")))
