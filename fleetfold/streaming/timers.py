"""Limits that pass while nothing arrives: requests in the state store with processing-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetfold import schema as S
from fleetfold.operators.reconcile import creation_limit_ms

#: What the stream of a ledger says about a member.
REQUESTED, SEEN = "requested", "seen"
LEDGER_EVENT = "app_id string, exec_id bigint, profile_id int, created_ms bigint, kind string"
_TIMED_OUT = "app_id string, exec_id bigint, profile_id int, created_ms bigint, timed_out_ms bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Queries started in here keep their state in the store that knows timers."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class CreationTimeouts(StatefulProcessor):
    """One open request per member; it ends when the member is seen or its timer expires."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", "profile_id int, created_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # within a batch a sighting counts for the requests beside it, whatever the order of the rows
        asked, seen = None, False
        for row in rows:
            if row.kind == SEEN:
                seen = True
            elif asked is None or row.created_ms >= asked.created_ms:
                asked = row
        if seen:
            self._forget()
        elif asked is not None:
            self._forget()
            self.request.update((asked.profile_id, asked.created_ms))
            # the limit itself is still in time
            self.handle.registerTimer(max(asked.created_ms + self.limit_ms + 1, 0))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.request.exists():
            profile_id, created_ms = self.request.get()
            self.request.clear()
            yield Row(app_id=key[0], exec_id=key[1], profile_id=profile_id, created_ms=created_ms,
                      timed_out_ms=timerValues.getCurrentProcessingTimeInMs())

    def _forget(self) -> None:
        if self.request.exists():
            self.request.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def start_creation_timeouts(
    ledger_events: DataFrame, path: str, checkpoint: str, limit_ms: int | None = None, **trigger
) -> StreamingQuery:
    """Requests whose member was not seen within the creation limit, as ``path/batch=<n>``.

    ``ledger_events`` (``LEDGER_EVENT``) carries a row for each request and each sighting of
    a member, in any number of parts. A request is a value in the state store with a
    timer on the wall clock, so it times out (strictly after the limit) when the clock
    passes it, also when no row ever arrives again. Without a trigger one micro-batch runs
    over all that is there, and the clock is that of the run; give ``processingTime`` for a
    query that goes on (a query with timers always has another batch, so
    ``availableNow`` would not end). A newer request of a member replaces the one before it.
    Members are keys of their own, so a large app is spread over all tasks.
    """
    limit = creation_limit_ms() if limit_ms is None else limit_ms
    keyed = ledger_events.filter(F.col("exec_id").isNotNull()).groupBy(*S.MEMBER)
    late = keyed.transformWithState(
        statefulProcessor=CreationTimeouts(limit), outputStructType=_TIMED_OUT, outputMode="append", timeMode="processingTime"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with timer_state(ledger_events.sparkSession):
        return (
            late.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"once": True}))
            .foreachBatch(write)
            .start()
        )
