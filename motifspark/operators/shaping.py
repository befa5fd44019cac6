"""Shaping of match rows: events, early stop, position lists, order, ranks, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_events(found: DataFrame) -> DataFrame:
    """(text_id, end_pos, patterns, match_num) of multi_pattern_scan's rows: all patterns that end at a
    place, ascending; they are suffixes of one another, so no more than the longest pattern has characters
    if no pattern repeats."""
    patterns = F.sort_array(F.collect_set("pattern_id")).alias("patterns")
    return found.groupBy("text_id", "end_pos").agg(patterns, F.count("*").alias("match_num"))


def first_event(found: DataFrame) -> DataFrame:
    """(text_id, end_pos, pattern_id): where a scan that stops at its first match stops; of several
    patterns that end there, the smallest id."""
    return found.groupBy("text_id").agg(F.min(F.struct("end_pos", "pattern_id")).alias("f")).select("text_id", "f.end_pos", "f.pattern_id")


def ordered(matches: DataFrame) -> DataFrame:
    """The rows by text, pattern and position."""
    return matches.orderBy("text_id", "pattern_id", "pos")


def position_lists(matches: DataFrame) -> DataFrame:
    """(text_id, pattern_id, positions, occurrences): ascending positions of a pattern in a text."""
    return matches.groupBy("text_id", "pattern_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.count("*").alias("occurrences"))


def appended(*tagged: tuple[str, DataFrame]) -> DataFrame:
    """The rows of several queries one after the other, each with its tag in `query`."""
    if not tagged:
        raise ValueError("nothing to append")
    first, *rest = (rows.withColumn("query", F.lit(tag)) for tag, rows in tagged)
    for rows in rest:
        first = first.unionByName(rows)
    return first


def best_matches(matches: DataFrame, n: int = 1) -> DataFrame:
    """The n best rows of each pattern: least distance, then smallest text and position. Each partition
    keeps its own n first, so a pattern of many matches meets pre-selected."""
    if n < 1:
        raise ValueError("n must be positive")
    key = F.struct("distance", "text_id", "pos")
    part = matches.withColumn("_part", F.spark_partition_id())
    near = part.withColumn("_turn", F.row_number().over(Window.partitionBy("pattern_id", "_part").orderBy(key))).where(F.col("_turn") <= n)
    rank = F.row_number().over(Window.partitionBy("pattern_id").orderBy(key))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).drop("_part", "_turn")


def texts_with_match(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """The rows of texts that hold a match."""
    return texts.join(matches.select("text_id").distinct(), "text_id", "left_semi")


def texts_without_match(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """The rows of texts that hold none, those of null ids included."""
    return texts.join(matches.select("text_id").distinct(), "text_id", "left_anti")
