"""The small example jobs, on tables of any size."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fleetfold.operators.keyed import fits_broadcast
from fleetfold.sources.scratch import materialize, scratch_dir


def group_values(df: DataFrame, key: str, value: str, width: int = 4096) -> DataFrame:
    """All values per key across a shuffle: key, part and vals, at most ``width`` different values in order.

    A key may own any number of rows, and its values may be of any type that has an
    order and lie however they like. Equal values are counted before the shuffle. The
    ranges of the shuffle come from Spark's sample of the counted pairs, so they hold
    about the same number of pairs each; inside a range the sorted pairs are cut into
    arrays. A key's parts are ordered like its values, its rows together hold every
    value, and no array and no task grows with a key.
    """
    counted = materialize(df.groupBy(key, value).agg(F.count("*").alias("n")), "group-values")
    ranged = counted.repartitionByRange(key, value).sortWithinPartitions(key, value)
    # the number of a row in its range is the low part of its id
    numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
    low = F.col("_id") % F.lit(1 << 33)
    part = (F.col("_id") - low + F.floor(low / F.lit(width))).alias("part")
    return numbered.groupBy(key, part).agg(
        F.sort_array(F.collect_list(F.struct(F.col(value).alias("value"), "n"))).alias("vals")
    )


def rows_seen(df: DataFrame, action) -> int:
    """Run ``action`` over ``df`` and return how many rows went through.

    The count is an observed metric of the finished query, so retried or
    speculative tasks do not add to it the way an accumulator would.
    """
    seen = Observation()
    action(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


_MULTIPLIER, _INCREMENT, _MODULUS = 1103515245, 12345, 1 << 31


def pi_estimate(draws: DataFrame, ident: Column) -> DataFrame:
    """Monte-Carlo estimate of pi with one pseudo-random point per row."""

    def step(x: Column) -> Column:
        return F.pmod(x * _MULTIPLIER + _INCREMENT, F.lit(_MODULUS))

    x = step(F.pmod(ident.cast("bigint"), F.lit(_MODULUS)))
    points = draws.select(x.alias("x")).withColumn("y", step(F.col("x")))
    hit = F.col("x") * F.col("x") + F.col("y") * F.col("y") < F.lit(_MODULUS * _MODULUS)
    return points.agg(
        F.count("*").alias("n"), F.count_if(hit).alias("inside")
    ).withColumn("pi", F.col("inside") * 4.0 / F.col("n"))


def word_count(texts: DataFrame, text: str = "value") -> DataFrame:
    """Number of occurrences of each whitespace-separated word."""
    words = texts.select(F.explode(F.split(text, r"\s+")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def text_roundtrip_wordcount(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Count words of a text source, write the text, read it back and compare."""
    first = spark.read.text(source)
    first.write.mode("overwrite").text(target)
    before = word_count(first).withColumnRenamed("n", "n_before")
    after = word_count(spark.read.text(target)).withColumnRenamed("n", "n_after")
    return before.join(after, "word", "full").withColumn(
        "same", F.col("n_before").eqNullSafe(F.col("n_after"))
    )


def register_py_udf(spark: SparkSession, name: str = "digit_sum") -> None:
    """Register a vectorised Python function for use from SQL."""

    @F.pandas_udf("long")
    def digit_sum(values: pd.Series) -> pd.Series:
        rest = values.abs()
        total = rest * 0
        while (rest > 0).any():
            total = total + rest % 10
            rest = rest // 10
        return total

    spark.udf.register(name, digit_sum)


def py_udf(df: DataFrame, column: str, name: str = "digit_sum") -> DataFrame:
    """Apply the registered Python function to a column through SQL."""
    register_py_udf(df.sparkSession, name)
    return df.selectExpr("*", f"{name}(cast({column} as bigint)) AS digits")


def range_filter_demo(people: DataFrame, low: int, high: int) -> DataFrame:
    """The classic ``WHERE age BETWEEN`` query over a JSON-backed table."""
    return people.sparkSession.sql(
        "SELECT name, age FROM {people} WHERE age >= {low} AND age <= {high}",
        people=people, low=low, high=high,
    )


RANK_UNIT = 1_000_000_000


#: Rows and columns of the grid that the links are dealt to, by their source and their target.
GRID = 16


def _place(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(GRID)).cast("int")


def _cell(row: Column, column: Column) -> Column:
    return (row * GRID + column).alias("cell")


def page_rank(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """Rank of every linked node, in billionths, from distinct ``(src, dst)`` edges.

    Ranks are whole numbers, so sums do not depend on the order of tasks and a
    repeated task gives the same result. The links are dealt once to a grid of cells
    and stay there, as a bucketed table: a round sends a node's share to the cells of its
    row and gets back one sum per cell of a column, so it moves nodes and not links. A
    node may own a third of the edges: they lie in as many cells as the grid is wide.
    Each round's ranks are written out, which keeps the plan of the next one small.
    """
    spark = edges.sparkSession
    name, all_keys = f"links_{uuid.uuid4().hex}", "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(all_keys)
    dealt = edges.select(_cell(_place("src"), _place("dst")), "src", "dst")
    dealt.repartition(GRID * GRID, "cell").distinct().write.bucketBy(GRID * GRID, "cell").saveAsTable(
        name, format="parquet", path=scratch_dir(spark, "links")
    )
    try:
        # the join is by cell and node, the buckets are by cell
        spark.conf.set(all_keys, "false")
        links = spark.table(name)
        degree = materialize(links.groupBy("src").agg(F.count("*").alias("n")), "degree")
        ranks = degree.select("src", "n", F.lit(RANK_UNIT).cast("bigint").alias("rank"))
        for _ in range(iterations):
            share = ranks.select("src", F.expr("rank div n").alias("share"))
            if fits_broadcast(share):
                given = links.join(share, "src")
            else:
                columns = F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("column")
                sent = share.select("*", columns).select(_cell(_place("src"), F.col("column")), "src", "share")
                given = links.join(sent, ["cell", "src"])
            summed = given.groupBy("dst").agg(F.sum("share").alias("total"))
            fresh = summed.select(
                F.col("dst").alias("src"),
                F.expr(f"{RANK_UNIT * 15 // 100} + total * 85 div 100").alias("rank"),
            )
            ranks = materialize(fresh.join(degree, "src", "left"), "ranks")
    finally:
        spark.conf.set(all_keys, before)
        spark.sql(f"DROP TABLE {name}")
    return ranks.select(F.col("src").alias("node"), "rank")
