"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.sources.scratch import materialize


def _mark(edges: DataFrame) -> tuple:
    """What tells one state of the links from another."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", "a"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node it is linked to, for each node of ``links`` (a, b) that is no root.

    Each round hangs the larger neighbours of every node below its smallest one
    (large star), then the smaller ones (small star), until nothing changes; the
    number of rounds is logarithmic. Both sides of each join are read from storage,
    so Spark can split the rows of a node with very many links. Links of a node to
    itself and repeated links are ignored; no links give no rows.
    """
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("b", "a"))
        smallest = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "smallest")
        large = materialize(
            both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large-star",
        )
        smallest = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        edges = materialize(
            large.join(smallest, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct(),
            "small-star",
        )
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
