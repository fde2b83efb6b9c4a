"""What is due to consumers that read a log of events at their own pace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.operators.keyed import salted_lookup


def due_rounds(events: DataFrame, consumers: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rows due to each consumer, per delivery round: consumer, round, n, first_seq, last_seq.

    ``consumers`` (consumer, app_id, delivered_seq, interval_ms) follow one app each, from
    the row behind ``delivered_seq`` on; a round holds the rows of one interval of event
    time. The rows of a ``failed`` round (consumer, round) come again with the next
    round that did not fail, beside its own. Every consumer gets every row once. An app
    may own most events, so its consumers are looked up with a salt and rows are counted
    before they are shuffled by round.
    """
    rows = salted_lookup(events.select("app_id", "seq", "ts_ms"), consumers, ["app_id"], "inner", salt_by=["seq"])
    due = rows.filter(F.col("seq") > F.col("delivered_seq")).withColumn("round", F.floor(F.col("ts_ms") / F.col("interval_ms")))
    counts = due.groupBy("consumer", "round").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    if failed is not None:
        # failures in a row have the same difference to their number
        order = Window.partitionBy("consumer").orderBy("round")
        runs = failed.select("consumer", "round").distinct().withColumn("_run", F.col("round") - F.row_number().over(order))
        last = Window.partitionBy("consumer", "_run")
        again = runs.select("consumer", "round", (F.max("round").over(last) + 1).alias("_again"))
        counts = counts.join(again, ["consumer", "round"], "left").withColumn("round", F.coalesce("_again", "round"))
        counts = counts.groupBy("consumer", "round").agg(
            F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq")
        )
    return counts
