"""Dense numbers of rows in a global order, at any size: sorted by ranges, numbered by part, moved by what lies before."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: monotonically_increasing_id has the partition above this bit.
PART_BIT = 33


def checkpoint_folder(spark: SparkSession) -> None:
    """A folder for checkpoints: that of the session; a temporary one only on a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(folder)


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows, written to the folder for checkpoints and read from there."""
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint()


#: Spark's setting by which a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(rows: DataFrame) -> DataFrame:
    """rows, written as a table to the folder for checkpoints and read from there; the shuffle files of the write go."""
    spark = rows.sparkSession
    checkpoint_folder(spark)
    path, before = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str | Column], name: str, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """rows with their place from 0 in the order as column name; rows that the order leaves equal come in any order.

    keep writes the sorted rows once, as a place must not change when a lost task runs again.  What is broadcast is one
    row a partition of the sort, so its number is that of spark.sql.shuffle.partitions at most.
    """
    own, part, before = "_own", "_part", "_before"
    placed = keep(rows.orderBy(*order).withColumn(own, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(own, PART_BIT))
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    sums = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy(part)) - F.col("_n")  # over partitions, not rows
    offsets = F.broadcast(sizes.select(part, sums.alias(before)))
    place = F.col(before) + F.col(own).bitwiseAND((1 << PART_BIT) - 1)
    return placed.join(offsets, part).withColumn(name, place).drop(own, part, before)
