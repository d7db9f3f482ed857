"""Materialised tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local master, where driver and executors are one
    process, gets a folder of its own if none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="regista-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Makes Spark delete an execution's shuffle files when it ends, rather than when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Writes in this context give the disk of their shuffles back when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and survives lost executors, and
    the shuffles that led to it give their disk back. ``options`` are those of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
