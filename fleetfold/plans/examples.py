"""The example jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.operators import jobs as J
from fleetfold.plans import adapters as A
from fleetfold.plans.catalog import query
from fleetfold.sources.scratch import scratch_dir


_WIDTH = 50


@query("group_values", """
SELECT l_suppkey, l_extendedprice, count(*) AS n, true AS bounded, true AS in_order FROM lineitem GROUP BY ALL""")
def group_values(spark, d):
    """Prices of each supplier: fractions, most of them different; each array short and in order."""
    grouped = J.group_values(A.table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", _WIDTH)
    values = F.col("vals.value")
    ordered = F.array_sort(values) == values
    return grouped.select(
        "l_suppkey", (F.size("vals") <= _WIDTH).alias("bounded"), ordered.alias("in_order"), F.explode("vals").alias("v")
    ).select("l_suppkey", F.col("v.value").alias("l_extendedprice"), F.col("v.n").alias("n"), "bounded", "in_order")


@query("rows_seen", "SELECT count(*) AS first_pass, count(*) AS second_pass FROM lineitem")
def rows_seen(spark, d):
    def run(df):
        df.groupBy("l_suppkey").agg(F.count("*").alias("n")).write.format("noop").mode("overwrite").save()

    rows = A.table(spark, d, "lineitem")
    first, second = J.rows_seen(rows, run), J.rows_seen(rows, run)
    return spark.range(1).select(F.lit(first).cast("bigint").alias("first_pass"), F.lit(second).cast("bigint").alias("second_pass"))


@query("pi_estimate", """
WITH a AS (SELECT ((l_orderkey * 64 + l_linenumber * 8 + l_partkey % 8) % 2147483648 * 1103515245 + 12345) % 2147483648 AS x FROM lineitem),
 b AS (SELECT x, (x * 1103515245 + 12345) % 2147483648 AS y FROM a)
SELECT count(*) AS n, count_if(x * x + y * y < 4611686018427387904)::BIGINT AS inside,
 CAST(count_if(x * x + y * y < 4611686018427387904) AS DOUBLE) * CAST(4 AS DOUBLE) / count(*) AS pi FROM b""")
def pi_estimate(spark, d):
    ident = F.col("l_orderkey") * 64 + F.col("l_linenumber") * 8 + F.col("l_partkey") % 8
    return J.pi_estimate(A.table(spark, d, "lineitem"), ident)


@query("word_count", """
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word""")
def word_count(spark, d):
    return J.word_count(A.table(spark, d, "documents"), "text")


@query("py_udf", """
SELECT o_orderkey, CAST(sum(CAST(digit AS INT)) AS BIGINT) AS digits FROM
 (SELECT o_orderkey, unnest(string_split(CAST(o_orderkey AS VARCHAR), '')) AS digit FROM orders) GROUP BY o_orderkey""")
def py_udf(spark, d):
    return J.py_udf(A.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("filter_people_demo", "SELECT c_name AS name, c_custkey % 90 AS age FROM customer WHERE c_custkey % 90 BETWEEN 13 AND 19")
def filter_people_demo(spark, d):
    path = scratch_dir(spark, "people")
    A.table(spark, d, "customer").select(
        F.col("c_name").alias("name"), (F.col("c_custkey") % 90).alias("age")
    ).write.json(path)
    people = spark.read.schema("name string, age bigint").json(path)
    return J.range_filter_demo(people, 13, 19)


_EDGES = """SELECT DISTINCT concat('s', CAST(l_suppkey AS VARCHAR)) AS src, concat('p', CAST(l_partkey AS VARCHAR)) AS dst FROM lineitem
  UNION ALL SELECT DISTINCT concat('p', CAST(l_partkey AS VARCHAR)), concat('s', CAST(l_suppkey AS VARCHAR)) FROM lineitem"""
_ROUNDS = 3
_RANK_CTES = {"e": _EDGES, "d": "SELECT src, count(*) AS n FROM e GROUP BY src", "r0": f"SELECT src, {J.RANK_UNIT} AS rank FROM d"}
for _i in range(_ROUNDS):
    _RANK_CTES[f"r{_i + 1}"] = f"""SELECT dst AS src, {J.RANK_UNIT * 15 // 100} + CAST(sum(rank // n) AS BIGINT) * 85 // 100 AS rank
      FROM e JOIN d USING (src) JOIN r{_i} USING (src) GROUP BY dst"""


@query("page_rank", "WITH " + ", ".join(f"{n} AS ({q})" for n, q in _RANK_CTES.items())
       + f" SELECT src AS node, CAST(rank AS BIGINT) AS rank FROM r{_ROUNDS}")
def page_rank(spark, d):
    supp = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    pairs = A.table(spark, d, "lineitem").select(supp.alias("src"), part.alias("dst"))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return J.page_rank(both, _ROUNDS)
