"""Quality rules: text statistics and cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import SPACE, WORD, let, whole_text
from fleetfold.sources.scratch import materialize

SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A line is boilerplate where it stands in more than this many different documents of its host.
LINE_DOCS = 20
#: A document is depleted when fewer than this share (in percent) of its words is left.
LEFT_PERCENT = 25


def _repeated_positions(windows: Column) -> Column:
    """Positions, in order, of the windows that occur twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(placed, lambda s: F.array_sort(F.transform(
        F.filter(
            F.transform(s, lambda x, i: F.struct(
                x["i"].alias("i"),
                ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])
                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"),
            )),
            lambda x: x["twice"],
        ),
        lambda x: x["i"],
    )))


def _covered(positions: Column, width: int) -> Column:
    """Words that windows of ``width`` words at these ordered positions cover."""
    return let(positions, lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    ))


def repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text has twice or more, each once.

    Windows are compared by 64-bit hash. Most texts repeat none, which a hash set
    tells in one pass; only the others sort their windows. No step is quadratic.
    """
    windows = F.when(F.size(words) > 2, F.zip_with(
        F.zip_with(F.slice(words, F.lit(1), F.size(words) - 2), F.slice(words, F.lit(2), F.size(words) - 2),
                   lambda a, b: F.struct(a, b)),
        F.slice(words, F.lit(3), F.size(words) - 2), lambda ab, c: F.xxhash64(ab, c),
    )).otherwise(F.array().cast("array<bigint>"))
    return let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")
    ).otherwise(_covered(_repeated_positions(h), 3)))


def lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0)


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACE, " "))


def word_count(text: Column) -> Column:
    """Words of a text: one more than the gaps of its trimmed form."""
    flat = F.trim(F.regexp_replace(text, SPACE, " "))
    return let(flat, lambda t: F.when(t == "", 0).otherwise(
        F.length(t) - F.length(F.translate(t, " ", "")) + 1)).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns n_words ... base_failed."""
    text = whole_text()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counted = docs.select(
        *docs.columns,
        let(words, lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
        )).alias("_w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines(text), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint")).alias("n_dup_lines"),
    )
    return counted.select(
        *docs.columns, "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words",
    ).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def _text_key() -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(whole_text()).alias("a"), F.xxhash64(F.lit(1), whole_text()).alias("b"))


def removed_words(docs: DataFrame, line_docs: int) -> DataFrame:
    """Boilerplate lines per host and different text: _host, _text, removed (words) and common (line hashes).

    Copies of a text count once for its host, so a text does not become boilerplate
    by being copied. Texts without such a line have no row.
    """
    texts = docs.select("_host", whole_text().alias("text"))
    per_line = texts.select(
        "_host", _text_key().alias("_text"), F.explode(lines(F.col("text"))).alias("line")
    ).select("_host", "_text", F.xxhash64(normal_line(F.col("line"))).alias("line"), word_count(F.col("line")).alias("words"))
    # one row per text and different line: words of all its occurrences in one copy
    stood = materialize(
        per_line.groupBy("_host", "_text", "line").agg(
            F.sum("words").alias("words"), F.count("*").alias("times")
        ), "lines",
    )
    copies = texts.groupBy("_host", _text_key().alias("_text")).agg(F.count("*").alias("copies"))
    common = materialize(
        stood.groupBy("_host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > line_docs).select("_host", "line"),
        "common-lines",
    )
    # collected per text, so never more than its own lines
    hit = stood.join(common, ["_host", "line"]).groupBy("_host", "_text").agg(
        F.sum("words").alias("words"), F.collect_list("line").alias("common")
    )
    return materialize(
        hit.join(copies, ["_host", "_text"])
        .select("_host", "_text", (F.col("words") / F.col("copies")).cast("bigint").alias("removed"), "common"),
        "removed",
    )


#: Columns that the rules add.
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_words", "kept", "common"]


def _named(docs: DataFrame) -> dict[str, str]:
    """The name under which each column of ``docs`` travels, so that none can clash with ours.

    They travel side by side and not in a struct: what the caller drops, the text above
    all, is then dropped before the shuffle of the join.
    """
    return {c: "text" if c == "text" else f"_in{i}" for i, c in enumerate(docs.columns)}


def _judged(docs: DataFrame, host: str, line_docs: int, left_percent: int, passed: bool = False) -> DataFrame:
    """The columns of ``docs`` by their names of ``_named`` and the columns of ``MADE``.

    With ``passed`` only the rows that pass the base rules; the others do not take part in the join.
    """
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in _named(docs).items()],
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("_host"),
    )
    removed = removed_words(rows, line_docs)
    counted = statistics(rows)
    if passed:
        # a filter on the verdict must not travel below the statistics, which would be computed again for it
        counted = counted.select(F.inline_outer(F.array(F.struct("*")))).filter("not base_failed")
    return (
        counted.withColumn("_text", _text_key())
        .join(removed, ["_host", "_text"], "left")
        .withColumn("left_words", F.col("n_words") - F.coalesce("removed", F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("left_words") * 100 >= F.col("n_words") * left_percent))
        .drop("_host", "_text", "removed")
    )


def quality_rules(
    docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_percent: int = LEFT_PERCENT
) -> DataFrame:
    """``docs`` (all columns) with the statistics, ``left_words`` and ``kept``.

    ``left_words`` are the words outside boilerplate lines: those that stand in more than
    ``line_docs`` different documents of the host, whatever its size. A document with
    fewer than ``left_percent`` of its words left is depleted and not kept, as is one that
    fails the base rules. Null text counts as empty and fails the base rules; a null host is
    one host. Every row gives one row, repeated ones too; copies of a text count once
    in the line counts. The columns n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, left_words, kept and common replace any of that name; the last
    is not returned. Columns of ``docs`` may have any other name.
    """
    judged = _judged(docs, host, line_docs, left_percent)
    own = [F.col(n).alias(c) for c, n in _named(docs).items() if c not in MADE]
    return judged.select(*own, *[c for c in MADE if c != "common"])


def clean_documents(
    docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_percent: int = LEFT_PERCENT
) -> DataFrame:
    """The kept documents with the columns of ``docs``, their text without boilerplate lines."""
    kept = _judged(docs, host, line_docs, left_percent, passed=True).filter("kept")
    left = let(F.col("common"), lambda common: F.array_join(F.filter(
        F.split(whole_text(), "\n"), lambda line: ~F.array_contains(common, F.xxhash64(normal_line(line)))), "\n"))
    text = F.when(F.col("common").isNull(), F.col("text")).otherwise(left)
    return kept.select(*[(text if c == "text" else F.col(n)).alias(c) for c, n in _named(docs).items()])


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1
), line AS (
  SELECT host, text, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
    len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT host, text, unnest(ls) AS l FROM (SELECT DISTINCT host, text, ls FROM w))
), common AS (
  SELECT host, line FROM line GROUP BY host, line HAVING count(DISTINCT text) > 20
), removed AS (
  SELECT l.host, l.text, sum(l.words) AS n FROM line l JOIN common c ON l.host = c.host AND l.line = c.line GROUP BY 1, 2
), s AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    (len(w) - coalesce(removed.n, 0))::BIGINT AS left_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN removed ON w.host = removed.host AND w.text = removed.text
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, left_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_words * 100 >= n_words * 25 AS kept
FROM s
"""
