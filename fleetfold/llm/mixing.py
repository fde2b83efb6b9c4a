"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.llm.common import whole_text
from fleetfold.llm.quality_rules import word_count
from fleetfold.sources.scratch import materialize

LEVELS = ["domain", "language", "source"]


@dataclass(frozen=True)
class Mix:
    """Target weights per level (whole numbers, 1 where a name is not listed) and limits.

    ``budget_percent`` of all tokens is the budget; a leaf is read at most
    ``max_epochs`` times.
    """

    domains: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    budget_percent: int = 75
    max_epochs: int = 2
    seed: int = 7


PRODUCTION = Mix(domains={"crawl": 2, "forum": 3, "books": 5}, languages={"en": 6, "de": 2, "fr": 2})


def domain_of(source: Column) -> Column:
    """Domain of a source of the documents: one crawl, forums by one digit, books by two."""
    return (
        F.when(source == "src0", "crawl")
        .when(F.length(source) == 4, "forum")
        .otherwise("books")
    )


def _weight(level: str, weights: dict[str, int]) -> Column:
    found = F.lit(1)
    for name, weight in weights.items():
        found = F.when(F.col(level) == name, weight).otherwise(found)
    return found.cast("bigint")


def water_fill(children: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """``children`` (capacity, weight) with ``share``: the parent's budget by weight, none above its capacity.

    With children ordered by capacity per weight, the level that fits is the largest
    of (budget - capacities before) / (weights from here on). What a small child
    cannot take goes to its siblings in proportion to their weights. What rounding
    down leaves is given out one by one, the largest weight first, so the whole
    budget is spent while there is room. A child with the weight 0 takes nothing.
    """
    names = [F.col(c) for c in LEVELS if c in children.columns]
    weight = F.nullif("weight", F.lit(0))
    order = [(F.col("weight") == 0).asc(), F.col("capacity") / weight, *names]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    family = Window.partitionBy(*parent)
    level = (budget - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.nullif(F.sum("weight").over(onward), F.lit(0))
    fair = F.least(F.col("capacity"), F.greatest(F.floor(F.col("weight") * F.coalesce("_level", F.lit(0.0))), F.lit(0)))
    has_room = F.col("_floor") < F.col("capacity")
    turn = Window.partitionBy(*parent).orderBy(has_room.desc(), F.desc("weight"), *names)
    return (
        children.withColumn("capacity", F.when(F.col("weight") == 0, 0).otherwise(F.col("capacity")).cast("bigint"))
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(family))
        .withColumn("_all", F.sum("capacity").over(family))
        .withColumn("_floor", F.when(budget >= F.col("_all"), F.col("capacity")).otherwise(fair).cast("bigint"))
        .withColumn("_spare", F.least(budget, F.col("_all")) - F.sum("_floor").over(family))
        .withColumn("share", F.col("_floor") + F.when(has_room & (F.row_number().over(turn) <= F.col("_spare")), 1).otherwise(0))
        .withColumn("share", F.col("share").cast("bigint"))
        .drop("_level", "_all", "_floor", "_spare")
    )


def leaf_budgets(supply: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf: tokens (its supply) and quota, the tokens to take.

    Budgets go down the tree. A child's capacity is all its leaves can give, so a
    shortage is met by siblings first and reaches an ancestor only when they are
    exhausted.
    """
    # a name with the weight 0 is left out, so what lies below it is no capacity of its ancestors
    left_out = _weight("language", mix.languages) * _weight("source", mix.sources) == 0
    leaves = supply.withColumn("capacity", F.when(left_out, 0).otherwise(F.col("tokens") * mix.max_epochs).cast("bigint"))
    total = supply.agg((F.sum("tokens") * mix.budget_percent).alias("_all"))
    budgets = None
    for depth, weights in enumerate([mix.domains, mix.languages, mix.sources], start=1):
        keys, parent = LEVELS[:depth], LEVELS[:depth - 1]
        children = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn(
            "weight", _weight(keys[-1], weights)
        )
        if budgets is None:
            # one row per domain
            children = children.join(F.broadcast(total)).withColumn("budget", F.floor(F.col("_all") / 100).cast("bigint")).drop("_all")
        else:
            children = children.join(budgets, parent)
        shared = water_fill(children, parent, F.col("budget"))
        budgets = shared.select(*keys, F.col("share").alias("budget"))
    return supply.join(budgets.withColumnRenamed("budget", "quota"), LEVELS)


def mix_sources(docs: DataFrame, mix: Mix = PRODUCTION, domain: Column | None = None) -> DataFrame:
    """doc_id, epoch, domain, language, source, n_tokens, taken_tokens: what each epoch of each leaf takes.

    A leaf's stream is its documents in the seeded order of epoch 0, then of epoch 1,
    and so on; its quota is a prefix of that stream, so the last document may be taken
    in part (``taken_tokens``). Tokens are words. Null language or source count as
    empty, null text has no tokens and is taken with each whole epoch and where the prefix
    passes it. Repeated
    rows are taken as often as they stand; an empty table or budget gives no rows.
    Positions inside a leaf come from totals of order buckets: only the bucket with
    the cut is ranked row by row.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (domain_of(source) if domain is None else domain).alias("domain"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"),
            source.alias("source"),
            word_count(whole_text()).alias("n_tokens"),
        ),
        "mix-rows",
    )
    supply = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    quotas = materialize(
        leaf_budgets(supply, mix).withColumns({
            "_full": F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("int"),
        }).withColumn("_rest", F.col("quota") - F.col("_full") * F.col("tokens")),
        "mix-quotas",
    )
    # few leaves: the stored table is below Spark's own broadcast limit; if not, a hot leaf is split
    placed = rows.join(quotas, LEVELS)
    whole = placed.filter("_full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    cut = (
        placed.filter("_rest > 0").withColumn("epoch", F.col("_full")).withColumn("_order", order)
        .withColumn("_bucket", F.substring("_order", 1, 4))
    )
    totals = cut.groupBy(*LEVELS, "_bucket").agg(F.sum("n_tokens").alias("_in"), F.max("_rest").alias("_rest"))
    earlier = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialize(
        totals.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0))).filter("_before < _rest")
        .select(*LEVELS, "_bucket", "_before", (F.col("_before") + F.col("_in") < F.col("_rest")).alias("_whole")),
        "mix-buckets",
    )
    chosen = cut.join(buckets, [*LEVELS, "_bucket"])
    inside = Window.partitionBy(*LEVELS, "_bucket").orderBy("_order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        chosen.filter("not _whole")
        .withColumn("_at", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .filter("_at < _rest")
        .withColumn("taken_tokens", F.least("n_tokens", F.col("_rest") - F.col("_at")))
    )
    columns = ["doc_id", "epoch", *LEVELS, "n_tokens", "taken_tokens"]
    return (
        whole.withColumn("taken_tokens", F.col("n_tokens")).select(*columns)
        .unionByName(chosen.filter("_whole").withColumn("taken_tokens", F.col("n_tokens")).select(*columns))
        .unionByName(ranked.select(*columns))
    )


def mixed_documents(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The documents that the mix takes, all columns as they are, one row per epoch; the last of a leaf whole.

    Rows are judged by doc_id alone, null being an id like any other: rows that
    repeat an id come with it. ``docs`` may have columns of any name.
    """
    taken = mix_sources(docs, mix).select(F.col("doc_id").alias("taken_id"), "epoch").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id")
    return rows.join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id"))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source,
    CASE WHEN coalesce(source, '') = 'src0' THEN 'crawl' WHEN length(coalesce(source, '')) = 4 THEN 'forum' ELSE 'books' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), supply AS (
  SELECT domain, language, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), c1 AS (
  SELECT domain, sum(tokens * 2)::BIGINT AS capacity,
    CASE domain WHEN 'crawl' THEN 2 WHEN 'forum' THEN 3 WHEN 'books' THEN 5 ELSE 1 END AS weight,
    floor((SELECT sum(tokens) * 75 FROM supply) / 100)::BIGINT AS budget
  FROM supply GROUP BY 1
), l1 AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c1
), f1 AS (
  SELECT *, sum(capacity) OVER () AS every, CASE WHEN budget >= sum(capacity) OVER () THEN capacity
    ELSE least(capacity, greatest(floor(weight * max(lv) OVER ()), 0)) END::BIGINT AS part FROM l1
), s1 AS (
  SELECT domain, part + CASE WHEN part < capacity AND row_number() OVER (ORDER BY part < capacity DESC, weight DESC, domain)
    <= least(budget, every) - sum(part) OVER () THEN 1 ELSE 0 END AS budget FROM f1
), c2 AS (
  SELECT s.domain, s.language, sum(tokens * 2)::BIGINT AS capacity,
    CASE s.language WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, any_value(s1.budget) AS budget
  FROM supply s JOIN s1 ON s.domain = s1.domain GROUP BY 1, 2
), l2 AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, domain, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, domain, language ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c2
), f2 AS (
  SELECT *, sum(capacity) OVER (PARTITION BY domain) AS every, CASE WHEN budget >= sum(capacity) OVER (PARTITION BY domain) THEN capacity
    ELSE least(capacity, greatest(floor(weight * max(lv) OVER (PARTITION BY domain)), 0)) END::BIGINT AS part FROM l2
), s2 AS (
  SELECT domain, language, part + CASE WHEN part < capacity AND row_number() OVER (PARTITION BY domain ORDER BY part < capacity DESC,
    weight DESC, domain, language) <= least(budget, every) - sum(part) OVER (PARTITION BY domain) THEN 1 ELSE 0 END AS budget FROM f2
), c3 AS (
  SELECT s.domain, s.language, s.source, tokens, tokens * 2 AS capacity, 1 AS weight, s2.budget
  FROM supply s JOIN s2 ON s.domain = s2.domain AND s.language = s2.language
), l3 AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER (PARTITION BY domain, language ORDER BY capacity / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (PARTITION BY domain, language ORDER BY capacity / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c3
), f3 AS (
  SELECT *, sum(capacity) OVER (PARTITION BY domain, language) AS every,
    CASE WHEN budget >= sum(capacity) OVER (PARTITION BY domain, language) THEN capacity
    ELSE least(capacity, greatest(floor(weight * max(lv) OVER (PARTITION BY domain, language)), 0)) END::BIGINT AS part FROM l3
), q AS (
  SELECT domain, language, source, tokens, (part + CASE WHEN part < capacity AND row_number() OVER (PARTITION BY domain, language
    ORDER BY part < capacity DESC, weight DESC, source) <= least(budget, every) - sum(part) OVER (PARTITION BY domain, language)
    THEN 1 ELSE 0 END)::BIGINT AS quota FROM f3
), e AS (
  SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS nfull FROM q
), stream AS (
  SELECT d.doc_id, ep.epoch, d.domain, d.language, d.source, d.n_tokens, e.quota, e.tokens,
    ep.epoch * e.tokens + coalesce(sum(d.n_tokens) OVER (PARTITION BY d.domain, d.language, d.source, ep.epoch
      ORDER BY md5('7:' || ep.epoch || ':' || d.doc_id), d.doc_id, d.n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.domain = e.domain AND d.language = e.language AND d.source = e.source
  CROSS JOIN (SELECT unnest(range(0, 3)) AS epoch) ep
)
SELECT doc_id, epoch::INTEGER AS epoch, domain, language, source, n_tokens, least(n_tokens, quota - before)::BIGINT AS taken_tokens
FROM stream WHERE before < quota OR epoch * tokens + tokens <= quota AND tokens > 0
"""
