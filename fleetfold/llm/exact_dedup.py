"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so, so equal texts have equal
cuts. Each distinct chunk gets an identifier, and the identifiers are verified: all
distinct chunks are brought together once and no two of them may share one. From
then on only the recipe, the ordered identifiers of a document, is grouped and
joined; the long texts are not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.llm.common import SPACE, whole_text
from fleetfold.sources.scratch import materialize

#: A chunk ends behind a lower-case letter, a stop or comma and a space, once it has
#: ``LEAST`` characters; text without such a place is cut at ``MOST``.
LEAST, MOST = 512, 4096

IDENTIFIERS = [
    lambda chunk: F.xxhash64(chunk),
    lambda chunk: F.sha2(chunk, 256),
    lambda chunk: chunk,
]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The consecutive chunks of a text; empty for the empty text."""
    pattern = rf"(?s).{{{least},{most - 1}}}?(?:\p{{Ll}}[.,] |\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def verified_identifier(docs: DataFrame, identifiers: list = IDENTIFIERS):
    """The first identifier under which no two different chunks of ``docs`` meet.

    The distinct chunks are the only long strings that are shuffled. The last
    identifier is the chunk itself, which needs no proof.
    """
    text = normalised(whole_text())
    distinct = docs.select(F.explode(chunks(text)).alias("chunk")).distinct()
    for identifier in identifiers[:-1]:
        shared = distinct.groupBy(identifier(F.col("chunk")).alias("id")).count().filter("count > 1")
        if shared.isEmpty():
            return identifier
    return identifiers[-1]


def exact_groups(docs: DataFrame, identifiers: list = IDENTIFIERS) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after each run of white space became one
    space; null counts as empty, and the empty texts are one group. The smallest
    doc_id of a group stays, null being the largest. Rows that repeat both doc_id and
    text are one document: one row comes back and ``group_size`` counts each of them.
    An empty table gives an empty result; other columns are not looked at.
    """
    identifier = verified_identifier(docs.select("text"), identifiers)
    text = normalised(whole_text())
    recipes = materialize(
        docs.select(
            "doc_id",
            F.transform(chunks(text), identifier).alias("recipe"),
            F.sha2(text, 256).alias("text_sha256"),
        ),
        "recipes",
    )
    # a group may hold a third of all rows: it is combined before the shuffle, and the
    # join back reads both sides from storage, so Spark can split its rows
    groups = materialize(
        recipes.groupBy("recipe")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1"),
        "groups",
    )
    one = recipes.groupBy("doc_id", "recipe", "text_sha256").agg(F.count("*").alias("_rows"))
    return (
        materialize(one, "documents")
        .join(groups, "recipe", "left")
        .select(
            "doc_id",
            F.coalesce("keep_id", "doc_id").alias("keep_id"),
            F.coalesce("group_size", "_rows").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
            "text_sha256",
        )
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row per document.

    ``docs`` may have columns of any name. Whole texts move once, for the last join.
    """
    key = ["none", "id", "sha"]

    def keys(sha: Column) -> list[Column]:
        return [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), sha.alias("sha")]

    stay = exact_groups(docs).filter("kept").select(*keys(F.col("text_sha256")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, *keys(F.sha2(normalised(whole_text()), 256))).join(stay, key, "left_semi")
    # the join has dealt out and sorted the rows by their key already
    first = F.row_number().over(Window.partitionBy(*key).orderBy("sha"))
    return rows.withColumn("at", first).filter("at = 1").select("row.*")


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT DISTINCT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
