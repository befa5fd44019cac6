"""Preparation of patterns and texts: fragments, equal fragments, rotations, blocks, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of fragments that a task groups; small files hold very many, so tasks go by rows and not by bytes.
TASK_ROWS = 500_000


def fragments(patterns: DataFrame, count: int) -> DataFrame:
    """(pattern_id, frag_id, off, fragment): each pattern cut into `count` contiguous, nearly equal
    pieces, longer ones first; pieces of patterns shorter than count may be empty. Null or empty
    patterns give no rows."""
    if count < 1:
        raise ValueError("count must be positive")
    rows = patterns.where("length(pattern) > 0").select("pattern_id", "pattern", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("frag_id"))
    off = F.expr(f"frag_id * (length(pattern) div {count}) + least(frag_id, length(pattern) % {count})")
    size = F.expr(f"length(pattern) div {count} + if(frag_id < length(pattern) % {count}, 1, 0)")
    return rows.select("pattern_id", "frag_id", off.cast("int").alias("off"), F.substring("pattern", off + 1, size).alias("fragment"))


def equal_fragments(pieces: DataFrame) -> DataFrame:
    """(pattern_id, frag_id, first_equal): the first fragment of the pattern that is equal, itself if none is before it."""
    own = Window.partitionBy("pattern_id", "fragment")
    return dealt(pieces, "pattern_id", "fragment").select("pattern_id", "frag_id", F.min("frag_id").over(own).alias("first_equal"))


def fragment_counts(pieces: DataFrame) -> DataFrame:
    """(pattern_id, fragments, distinct_fragments) of fragments' rows."""
    return dealt(pieces, "pattern_id").groupBy("pattern_id").agg(F.count("*").alias("fragments"), F.countDistinct("fragment").alias("distinct_fragments"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by keys to as many tasks as TASK_ROWS asks for, or as there are cores."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(parts, *keys)


def fragment_groups(pieces: DataFrame) -> DataFrame:
    """(fragment, members, places) of the equal, non-empty fragments of all patterns: places holds each
    fragment's (pattern_id, frag_id, off), ascending, so a scan has to look for each fragment once."""
    rows = pieces.where("length(fragment) > 0").groupBy("fragment")
    return rows.agg(F.count("*").alias("members"), F.sort_array(F.collect_list(F.struct("pattern_id", "frag_id", "off"))).alias("places"))


def doubled(pattern: str) -> str:
    """SQL of a pattern followed by all of itself but its last character: it holds each rotation once."""
    return f"concat({pattern}, substring({pattern}, 1, length({pattern}) - 1))"


def doubled_patterns(patterns: DataFrame) -> DataFrame:
    """(pattern_id, doubled); null or empty patterns give no rows."""
    return patterns.where("length(pattern) > 0").select("pattern_id", F.expr(doubled("pattern")).alias("doubled"))


def reversed_texts(texts: DataFrame) -> DataFrame:
    """(text_id, reversed) by code points; null stays null."""
    return texts.select("text_id", F.reverse("text").alias("reversed"))


def rotations(patterns: DataFrame) -> DataFrame:
    """(pattern_id, rotation, rotated) of every rotation."""
    rows = patterns.where("length(pattern) > 0").select("pattern_id", "pattern", F.expr("explode(sequence(0, length(pattern) - 1))").alias("rotation"))
    return rows.select("pattern_id", "rotation", F.expr(f"substring({doubled('pattern')}, rotation + 1, length(pattern))").alias("rotated"))


def blocks(texts: DataFrame, size: int, context: int = 0) -> DataFrame:
    """(text_id, start, low, block, text_length): block owns the characters from start on, `size` of
    them, and holds `context` more on either side; low is the place of its first character."""
    if size < 1 or context < 0:
        raise ValueError("size must be positive and context not negative")
    rows = texts.where("length(text) > 0").select("text_id", "text", F.expr(f"explode(sequence(0, length(text) - 1, {size}))").alias("start"))
    rows = rows.withColumn("low", F.expr(f"greatest(0, start - {context})"))
    return rows.select("text_id", "start", "low", F.expr(f"substring(text, low + 1, start - low + {size + context})").alias("block"), F.expr("length(text)").alias("text_length"))


def pattern_status(patterns: DataFrame, longest: int | None = None) -> DataFrame:
    """(pattern_id, status): empty, long, duplicate (of a pattern with a smaller id) or ok."""
    first = patterns.groupBy("pattern").agg(F.min("pattern_id").alias("first"))
    rows = patterns.join(first, "pattern", "left")
    status = F.when(F.coalesce(F.length("pattern"), F.lit(0)) == 0, "empty")
    if longest is not None:
        status = status.when(F.length("pattern") > longest, "long")
    return rows.select("pattern_id", status.when(F.col("pattern_id") > F.col("first"), "duplicate").otherwise("ok").alias("status"))


def accepted_patterns(patterns: DataFrame, longest: int | None = None) -> DataFrame:
    """The patterns (pattern_id, pattern) whose status is ok: each text once, under its smallest id."""
    rows = patterns.where("length(pattern) > 0" + ("" if longest is None else f" AND length(pattern) <= {longest}"))
    return rows.groupBy("pattern").agg(F.min("pattern_id").alias("pattern_id")).select("pattern_id", "pattern")


def trie_edges(patterns: DataFrame) -> DataFrame:
    """(parent, symbol, child, patterns, ends) of the trie of all patterns: nodes are named by their
    prefix, patterns counts those that pass the edge and ends those that end at the child."""
    rows = patterns.where("length(pattern) > 0").select("pattern", F.expr("explode(sequence(1, length(pattern)))").alias("depth"))
    edge = rows.select(F.expr("substring(pattern, 1, depth - 1)").alias("parent"), F.expr("substring(pattern, depth, 1)").alias("symbol"), F.expr("substring(pattern, 1, depth)").alias("child"), (F.col("depth") == F.length("pattern")).alias("last"))
    return edge.groupBy("parent", "symbol", "child").agg(F.count("*").alias("patterns"), F.count_if("last").alias("ends"))
