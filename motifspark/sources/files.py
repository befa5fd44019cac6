"""Text and pattern files: each file is one value, without the line feed at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text_id, text) of files in UTF-8, text_id being the file's path. One line feed at the end is no
    data; others are. An empty file has no text and gives no row."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("text_id"), F.regexp_replace("value", r"\n\z", "").alias("text"))


def read_patterns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(pattern_id, pattern) of files, as read_texts."""
    return read_texts(spark, path).toDF("pattern_id", "pattern")


def from_strings(spark: SparkSession, values: list[str | None], kind: str = "text") -> DataFrame:
    """(text_id, text), or of another kind, of strings in memory; ids count from 0."""
    return spark.createDataFrame(list(enumerate(values)), f"{kind}_id long, {kind} string")
