"""A round computes the documents of its batch once, and only what it needs of them."""

from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.sources.scratch import scratch_dir
from fleetfold.streaming import rounds as SR

from helpers import pod, pods


def test_a_round_reads_its_batch_once(spark):
    out = scratch_dir(spark, "once")
    pods(spark, *[pod(i, "Running", seq=i, ts_ms=10 * i) for i in range(1, 6)]).write.parquet(f"{out}/in")
    calls, unused = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def phase(p):
        calls.add(1)
        return p

    @F.udf("string")
    def message(p):
        unused.add(1)
        return p

    docs = spark.readStream.schema(S.POD).parquet(f"{out}/in").withColumn("phase", phase("phase")).withColumn("message", message("message"))
    targets = spark.createDataFrame([("a", 0, 7)], S.TARGETS)
    reg = spark.createDataFrame([], S.REGISTRATIONS)
    SR.start_reconcile(docs, lambda: targets, lambda: reg, f"{out}/o", f"{out}/progress").awaitTermination()
    got = spark.read.parquet(f"{out}/o/decisions")
    assert sorted((r.decision, r.exec_id) for r in got.collect()) == [("request", 6), ("request", 7)]
    assert (calls.value, unused.value) == (5, 0)
