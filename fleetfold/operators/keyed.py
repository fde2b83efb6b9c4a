"""Keyed building blocks that stay even when one key owns much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.sources.scratch import materialize

SALTS = 16


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of ``df`` is below its broadcast limit."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def with_settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column that is computed once for a row, however often it is used.

    Expressions and filters above are not merged with it, so the code generated for
    them stays small; columns that nobody uses are still not read.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    salts: int = SALTS,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """Join many rows per key to few ``right`` rows per key.

    A right side that Spark itself would broadcast is joined as it is; skew does not
    matter then. Otherwise the left rows of one key are spread over ``salts`` shuffle
    keys and the right rows are repeated once per salt, so a key with a third of the
    rows is shared by many tasks.
    """
    if fits_broadcast(right):
        return left.join(right, on, how)
    spread = salt_by or [c for c in left.columns if c not in on] or on
    slot = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    slots = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        left.withColumn("_slot", slot)
        .join(right.withColumn("_slot", slots), [*on, "_slot"], how)
        .drop("_slot")
    )


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which null keys meet null keys."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(named, same).drop(*[f"_r_{c}" for c in on])


def prefix_totals(
    df: DataFrame,
    keys: list[str],
    levels: list[Column],
    order: list[str],
    measure: Column,
    before: str,
) -> DataFrame:
    """Running total of ``measure`` over earlier rows of the key, in ``order``.

    ``levels`` are coarse-to-fine bucket expressions that grow with ``order``. Each
    level is totalled first, so a window only ever sees the buckets inside one
    coarser bucket, and the last window only the rows of one finest bucket: the
    rows of a large key are never sorted together. With ``measure`` 1 this is the
    zero-based position. Rows with a null key are a key of their own, and rows with a
    null order value come first.
    """
    names = [f"_b{i}" for i in range(len(levels))]
    rows = df.withColumn("_m", measure.cast("bigint"))
    for name, level in zip(names, levels):
        rows = rows.withColumn(name, level)
    # totals per bucket, finest first
    totals = [rows.groupBy(*keys, *names).agg(F.sum("_m").alias("_t"))]
    for depth in range(len(levels) - 1, 0, -1):
        totals.insert(0, totals[0].groupBy(*keys, *names[:depth]).agg(F.sum("_t").alias("_t")))
    offsets = None
    for depth, total in enumerate(totals, start=1):
        inner = Window.partitionBy(*keys, *names[: depth - 1]).orderBy(names[depth - 1])
        earlier = F.coalesce(
            F.sum("_t").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        level_offset = total.select(*keys, *names[:depth], earlier.alias(f"_o{depth}"))
        offsets = (
            level_offset
            if offsets is None
            else join_null_safe(level_offset, offsets, [*keys, *names[: depth - 1]])
        )
    base = reduce(lambda a, b: a + b, [F.col(f"_o{d}") for d in range(1, len(levels) + 1)])
    offsets = offsets.select(*keys, *names, base.alias("_base"))
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    running = F.coalesce(
        F.sum("_m").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        join_null_safe(rows, offsets, [*keys, *names])
        .withColumn(before, F.col("_base") + running)
        .drop("_m", "_base", *names)
    )


def carry_last(df: DataFrame, keys: list[str], place: list[str], chunk: int, value: Column, name: str) -> DataFrame:
    """The last ``value`` that is not null on an earlier row of the key, in the order of ``place``.

    ``place`` is (block, number): the rows of a block are cut into chunks of ``chunk``
    numbers. The last value of each chunk is found first; a window over chunks carries
    it on, and a window over the rows of one chunk does the rest, so no window holds
    all rows of a key.
    """
    block, number = place
    rows = df.withColumns({"_v": value, "_chunk": F.floor(F.col(number) / F.lit(chunk))})
    of_chunk = [*keys, block, "_chunk"]
    held = rows.groupBy(*of_chunk).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(number))).alias("_own"))
    earlier = Window.partitionBy(*keys).orderBy(block, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_carried", F.last("_own", ignorenulls=True).over(earlier)).drop("_own")
    inside = Window.partitionBy(*of_chunk).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    found = join_null_safe(rows, held, of_chunk).withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    return found.withColumn(name, F.coalesce("_in", "_carried")).drop("_v", "_chunk", "_in", "_carried")


def first_per_key(
    df: DataFrame, keys: list[str], n: str, levels: list[Column], order: list[str]
) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, where column ``n`` is constant per key.

    Each level counts the rows per bucket and tells the buckets that are wholly in
    from the one where the cut falls; only the rows of that bucket go on to the next,
    finer level. The last bucket is ranked row by row.
    """
    rest, parts = df.withColumn("_n", F.col(n).cast("bigint")), []
    for level in levels:
        rest = rest.withColumn("_b", level)
        earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counted = rest.groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
        placed_buckets = (
            counted.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
            .filter("_before < _n")
            .select(*keys, "_b", (F.col("_n") - F.col("_before")).alias("_left"),
                    (F.col("_before") + F.col("_c") <= F.col("_n")).alias("_whole"))
        )
        # There may be nearly as many buckets as rows, so they are not repeated per salt;
        # nothing follows the join but a write, so Spark can split a hot bucket itself.
        # Written once: the rows that are in, and those of the buckets still to be cut.
        placed = materialize(
            rest.join(placed_buckets, [*keys, "_b"]).select(*df.columns, "_left", "_whole"), "cut"
        )
        parts.append(placed.filter("_whole").select(*df.columns))
        rest = placed.filter("not _whole").select(*df.columns, F.col("_left").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    last = rest.withColumn("_rank", rank).filter("_rank <= _n").select(*df.columns)
    return reduce(DataFrame.unionByName, parts, last)
