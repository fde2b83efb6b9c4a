"""Tables that grow by changes: a base, a log of changes behind it, and compaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batches between two compactions.
COMPACT_EVERY = 8


def folders(spark: SparkSession, path: str, prefix: str, complete: bool = True) -> list[int]:
    """Numbers of the folders ``prefix<number>`` below a path, in order; only those wholly written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    numbers = [int(n[len(prefix):]) for n in names if n.startswith(prefix)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n in numbers if not complete or fs.exists(done(f"{path}/{prefix}{n}/_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class TableLog:
    """A table with a key, as its last base and the changes of the batches after it.

    ``append`` writes the rows of one batch; the row of the newest batch stands for its
    key, and a row marked as gone removes the key. A batch owns its folder, so writing it
    again replaces it. Every few batches a new base is written from the old one and
    the changes since. A base counts once it is wholly written, so readers switch from one to
    the next in a single step and an interrupted compaction leaves the old one
    in use. Folders are removed one compaction later, when no reader of the table as it
    was before uses them: their number is bounded, whatever the number of batches.
    Bases are dealt out and sorted by key, so that a filter on the first key column
    skips most row groups.
    """

    def __init__(
        self, spark: SparkSession, path: str, ddl: str, keys: list[str], every: int = COMPACT_EVERY,
        keep: Callable[[DataFrame, int], DataFrame] | None = None,
    ) -> None:
        """``keep`` may drop rows of the table at a compaction (given the batch)."""
        self.spark, self.path, self.keys, self.every, self.keep = spark, path, keys, every, keep
        self.schema = T._parse_datatype_string(ddl)
        self.columns = [f.name for f in self.schema]
        self.stored = T.StructType([*self.schema, T.StructField("gone", T.BooleanType())])

    def _bases(self) -> list[int]:
        return folders(self.spark, f"{self.path}/base", "v=")

    def _changes(self) -> list[int]:
        return folders(self.spark, f"{self.path}/changes", "batch=")

    def _read(self, path: str, batch: int) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(path).withColumn("batch", F.lit(batch))

    def read(self, before: int | None = None) -> DataFrame:
        """The table as it is, or as it was before a batch."""
        bases = [v for v in self._bases() if before is None or v < before]
        base = bases[-1] if bases else None
        later = [b for b in self._changes() if (base is None or b > base) and (before is None or b < before)]
        parts = [self._read(f"{self.path}/changes/batch={b}", b) for b in later]
        if base is not None:
            parts.append(self._read(f"{self.path}/base/v={base}", base))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        if len(parts) == 1:
            rows = parts[0]
        else:
            union = parts[0]
            for part in parts[1:]:
                union = union.unionByName(part)
            values = [c for c in [*self.columns, "gone"] if c not in self.keys]
            rows = union.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*self.keys, "last.*")
        return rows.filter("not gone").select(*self.columns)

    def append(self, rows: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """Write one batch: rows with new values, and keys to remove. At most one row for a key."""
        changes = rows.select(*self.columns, F.lit(False).alias("gone"))
        if gone is not None:
            empty = [
                F.col(c) if c in self.keys else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns
            ]
            changes = changes.unionByName(gone.select(*empty, F.lit(True).alias("gone")))
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        bases = self._bases()
        first = bases[-1] if bases else min(self._changes(), default=batch) - 1
        if batch - first >= self.every:
            self.compact(batch)

    def replace(self, rows: DataFrame, batch: int) -> None:
        """Make the table equal to ``rows``; only what differs from before the batch is written."""
        values = [c for c in self.columns if c not in self.keys]

        def side(df: DataFrame, name: str) -> DataFrame:
            # a struct without fields is not null either
            return df.select(*self.keys, F.struct(F.lit(1).alias("one"), *values).alias(name))

        both = side(rows, "new").unionByName(side(self.read(before=batch), "old"), allowMissingColumns=True)
        seen = both.groupBy(*self.keys).agg(F.first("new", ignorenulls=True).alias("new"), F.first("old", ignorenulls=True).alias("old"))
        changed = seen.filter(~F.col("new").eqNullSafe(F.col("old")))
        new = changed.filter("new is not null").select(*self.keys, *[F.col(f"new.{c}").alias(c) for c in values])
        self.append(new, batch, changed.filter("new is null").select(*self.keys))

    def compact(self, batch: int) -> None:
        """Write a base of everything up to a batch, then remove what no reader needs any more."""
        bases = [v for v in self._bases() if v < batch]
        rows = self.read(before=batch + 1)
        if self.keep is not None:
            rows = self.keep(rows, batch)
        rows = rows.withColumn("gone", F.lit(False)).repartitionByRange(*self.keys).sortWithinPartitions(*self.keys)
        rows.write.mode("overwrite").parquet(f"{self.path}/base/v={batch}")
        if bases:
            # the base before this one stays for a repeated batch and for readers that began with it
            for old in folders(self.spark, f"{self.path}/base", "v=", complete=False):
                if old < bases[-1]:
                    remove(self.spark, f"{self.path}/base/v={old}")
            for old in folders(self.spark, f"{self.path}/changes", "batch=", complete=False):
                if old <= bases[-1]:
                    remove(self.spark, f"{self.path}/changes/batch={old}")
