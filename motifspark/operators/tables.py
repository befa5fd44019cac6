"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one, whose executor is the driver, gets a
    temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/motifspark-tables"


def written(df: DataFrame) -> DataFrame:
    """df, written and read again: its rows and their numbers are the same for all that reads them, and the
    lineage ends there. The table goes when the driver ends."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/search/{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that a join may broadcast.
BROADCAST_ROWS = 100_000


def shuffled(df: DataFrame) -> DataFrame:
    """df as one side of a join that is never broadcast: Spark goes by the size of compressed files, and rows
    of numbers that ascend or repeat take a hundred times that in the driver's memory."""
    return df.hint("merge")


def joinable(table: DataFrame) -> DataFrame:
    """A written table as one side of a join: its rows, not its files' size, tell whether it is broadcast."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else shuffled(table)
