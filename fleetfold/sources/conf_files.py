"""Configuration directories and properties text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetfold import schema as S
from fleetfold.operators.keyed import carry_last
from fleetfold.sources import files
from fleetfold.sources.scratch import materialize

# --- fixed values: files that never enter a bundle -------------------------------------
SKIPPED_NAMES = [r".*\.template", r"spark.*(conf|properties)", r".*\.(gz|zip|jar|tar)"]


def is_bundle_name(name: Column) -> Column:
    return ~name.rlike(r"\A(?:" + "|".join(SKIPPED_NAMES) + r")\z")


def read_conf_files(
    spark: SparkSession, path: str, budget: int = S.BUNDLE_BUDGET, rejected: bool = False
) -> DataFrame:
    """Small text files below ``path/<app>/``: app_id, file_name, n_bytes and content.

    Skipped names, files that cannot fit the budget with their name, and files that are not
    UTF-8 are left out; with ``rejected`` they are rows too, without content and with their
    ``reason`` (name, size or encoding). Names that begin with ``_`` or ``.`` are files
    like any other. Oversize and skipped files are not opened.
    """
    files.register(spark)
    rows = spark.read.format("conf_files").option("budget", budget).option("skipped", "|".join(SKIPPED_NAMES)).load(path)
    return rows if rejected else rows.filter("reason is null").drop("reason")


def write_conf_files(rows: DataFrame, path: str) -> None:
    """Each row (app_id, file_name, content) as a file ``path/<app>/<file>``."""
    files.register(rows.sparkSession)
    rows.select("app_id", "file_name", "content").write.format("conf_files").mode("append").option("path", path).save()


def _escape(text: Column, spaces: bool) -> Column:
    out = F.regexp_replace(text, r"([\\:=#!])", r"\\$1")
    for char, name in (("\t", "t"), ("\n", "n"), ("\r", "r"), ("\f", "f")):
        out = F.replace(out, F.lit(char), F.lit("\\" + name))
    out = F.regexp_replace(out, " " if spaces else r"\A ", r"\\ ")
    units = F.transform(
        F.split(out, ""),
        lambda c: F.when(
            c.rlike(r"[^\x20-\x7e]"),
            F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "([0-9A-F]{4})", r"\\u$1"),
        ).otherwise(c),
    )
    return F.when(out.rlike(r"[^\x20-\x7e]"), F.array_join(units, "")).otherwise(out)


_UNIT = re.compile(r"\\(u[0-9a-fA-F]{4}|u|.|\Z)", re.S)
_KEY = re.compile(r"(?:[^\\:= \t\f]|\\.)*", re.S)
_NAMED = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def decode(text: str) -> str:
    """Text of an escaped part: named characters, UTF-16 units, and any other character for itself."""
    if "\\" not in text:
        return text

    def one(found: re.Match) -> str:
        unit = found.group(1)
        if unit == "u":
            raise ValueError("malformed \\u escape")
        return chr(int(unit[1:], 16)) if len(unit) == 5 else _NAMED.get(unit, unit)

    # two units may make one character; half of one cannot be written in UTF-8
    return _UNIT.sub(one, text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def entry(record: str) -> tuple[str | None, str | None, str | None]:
    """Key, value and error of a logical record without leading white space."""
    end = _KEY.match(record).end()
    rest = record[end:].lstrip(" \t\f")
    if rest[:1] in ("=", ":"):
        rest = rest[1:].lstrip(" \t\f")
    try:
        return decode(record[:end]), decode(rest), None
    except ValueError as wrong:
        return None, None, f"{wrong}: {record}"


_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "value", "error")])


def _entries(records: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([entry(r) for r in records], columns=_ENTRY.names, dtype=object)


def to_properties(conf: DataFrame) -> DataFrame:
    """One properties line per entry, ``(app_id, value)``."""
    line = F.concat(_escape(F.col("key"), True), F.lit("="), _escape(F.col("value"), False))
    return conf.select("app_id", line.alias("value"))


_BLANK_OR_NOTE = r"\A[ \t\f]*([#!].*)?\z"


def from_properties(records: DataFrame) -> DataFrame:
    """Entries of ``(app_id, value)`` logical records; comments and blank lines are skipped.

    A record with a malformed escape has an ``error`` and neither key nor value.
    """
    text = F.regexp_replace("value", r"\A[ \t\f]+", "")
    kept = records.filter(~F.col("value").rlike(_BLANK_OR_NOTE)).withColumn("e", F.pandas_udf(_entries, _ENTRY)(text))
    return kept.select(*[c for c in records.columns if c != "value"], "e.*")


#: Lines that one step of the search for the record before them looks at.
LINES = 4096


def logical_records(lines: DataFrame, keys: list[str], block: str, at: str, chunk: int = LINES) -> DataFrame:
    """Physical lines joined to logical records: the key columns, the place of the first line, and value.

    ``lines`` (keys, block, at, value) are placed by (block, at) within their keys. A
    line whose last backslash is not escaped goes on in the next one, whose leading
    white space falls away; comments do not go on, and a blank line ends a record.
    Whether a line is a continuation is told by the nearest line before it that decides
    it: all lines do, but comments that end in a backslash. The last deciding line and the
    last first line are carried over chunks of lines, not walked, so a file of any length
    is worked on in parallel.
    """
    text = F.col("value")
    slashes = F.length(F.regexp_extract(text, r"(\\*)\z", 1))
    odd = slashes % 2 == 1
    note = text.rlike(r"\A[ \t\f]*[#!]")
    blank = text.rlike(r"\A[ \t\f]*\z")
    # true or false: so the next line is, whatever this one is; null: as this one is
    decides = F.when(blank, False).when(note & odd, None).otherwise(odd)
    rows = lines.withColumns({"_decides": decides, "_blank": blank, "_note": note, "_odd": odd})
    place = [block, at]
    rows = carry_last(rows, keys, place, chunk, F.col("_decides"), "_goes_on")
    inside = F.coalesce("_goes_on", F.lit(False))
    starts = ~inside & ~F.col("_blank") & ~F.col("_note")
    rows = rows.withColumns({"_inside": inside, "_starts": starts, "_place": F.struct(*place)})
    rows = carry_last(rows, keys, place, chunk, F.when(F.col("_starts"), F.col("_place")), "_before")
    first = F.when(F.col("_starts"), F.col("_place")).when(F.col("_inside"), F.col("_before"))
    part = F.when(F.col("_inside"), F.regexp_replace("value", r"\A[ \t\f]+", "")).otherwise(text)
    parts = rows.withColumn("_first", first).filter("_first is not null").withColumn("_part", _without_last(part, F.col("_odd")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_part"))), lambda p: p["_part"]), "")
    return parts.groupBy(*keys, "_first").agg(joined.alias("value")).withColumnRenamed("_first", "place")


def _without_last(text: Column, when: Column) -> Column:
    return F.when(when, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def write_properties(conf: DataFrame, path: str) -> None:
    """Properties text, one folder per app.

    Rows are rebalanced by app before they are written: small apps get one file, and a
    very large app is split over several tasks and files.
    """
    to_properties(conf).hint("rebalance", "app_id").write.mode("overwrite").partitionBy("app_id").text(path)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the properties files of every app: app_id, file, place, key, value and error.

    ``place`` orders the entries of a file; of several entries with one key the last
    counts for most readers.
    """
    lines = spark.read.schema("value string, app_id string").text(path).select(
        "app_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        # rows of a block in the order of the file
        (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at"), "value",
    )
    stored = materialize(lines, "properties-lines")
    return from_properties(logical_records(stored, ["app_id", "file"], "block", "at"))


def staging_plan(uris: DataFrame, upload_path: str) -> DataFrame:
    """Which dependencies are local, and where each would be copied.

    ``uris`` is ``(app_id, kind, upload_id, uri)``. Local means no scheme or ``file``;
    others pass through. Archives keep their fragment.
    """
    uri = F.col("uri")
    scheme = F.nullif(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit(""))
    is_local = scheme.isNull() | (scheme == "file")
    path = F.regexp_extract(uri, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    fragment = F.regexp_extract(uri, r"(#.*)$", 1)
    target = F.concat(
        F.lit(f"{upload_path}/spark-upload-"), F.col("upload_id").cast("string"), F.lit("/"), base,
        F.when(F.col("kind") == "archives", fragment).otherwise(""),
    )
    return uris.select(
        "*",
        scheme.alias("scheme"),
        base.alias("base_name"),
        is_local.alias("is_local"),
        F.when(is_local, target).otherwise(uri).alias("target"),
    )
