"""A place for intermediate files that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder; on
    a cluster a machine-local folder would not be shared, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="fleetfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write an intermediate table once and go on from the written copy.

    Cuts the lineage of a table that several results share. The copy lies on shared
    storage, so it survives lost executors, and it is columnar, so each result reads
    only its columns and Spark knows its size when it plans the next join. ``options`` go to
    the writer.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
