"""Index structures of texts: prefix array, suffix array with ranks, longest common prefixes, range minima.

A text is one row, so its arrays are made where it stands: no shuffle, and memory in proportion to the
longest text. Suffixes are ordered by code points, by prefix doubling.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifspark.operators.search import codes, spread
from motifspark.operators.tables import shuffled

#: Rows of a batch that leaves a task.
ROWS = 1 << 18


def z_array(points: list[int]) -> list[int]:
    """How far each suffix agrees with the whole; 0 for the whole itself."""
    n = len(points)
    out, left, right = [0] * n, 0, 0
    for i in range(1, n):
        size = min(right - i, out[i - left]) if i < right else 0
        while i + size < n and points[size] == points[i + size]:
            size += 1
        out[i] = size
        if i + size > right:
            left, right = i, i + size
    return out


def suffix_ranks(points):
    """Rank of each suffix."""
    import numpy as np

    n, size = len(points), 1
    rank = np.unique(points, return_inverse=True)[1].astype(np.int64)
    while size < n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-size] = rank[size:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        size *= 2
    return rank


def common_prefixes(points: list[int], rank: list[int]) -> list[int]:
    """For each suffix, how far it agrees with the one ranked before it; 0 for the first."""
    n = len(points)
    order, out, size = [0] * n, [0] * n, 0
    for i, r in enumerate(rank):
        order[r] = i
    for i, r in enumerate(rank):
        if r == 0:
            size = 0
            continue
        j = order[r - 1]
        while i + size < n and j + size < n and points[i + size] == points[j + size]:
            size += 1
        out[i] = size
        size = max(0, size - 1)
    return out


def _per_text(texts: DataFrame, arrays, names: list[str]) -> DataFrame:
    """(text_id, pos, names...) with a row for each character of each text; arrays(text) gives the columns."""
    import numpy as np

    rows = spread(texts.select("text_id", "text").where("length(text) > 0"))
    kind = rows.schema["text_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                columns = arrays(batch.column(1)[i].as_py())
                for low in range(0, len(columns[0]), ROWS):
                    parts = [pa.array(np.asarray(c[low : low + ROWS], np.int32)) for c in columns]
                    n = len(parts[0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n)), pa.array(np.arange(low, low + n, dtype=np.int32)), *parts], ["text_id", "pos", *names])

    return rows.mapInArrow(run, f"text_id {kind}, pos int, " + ", ".join(f"{n} int" for n in names))


def prefix_array(texts: DataFrame) -> DataFrame:
    """(text_id, pos, z): how far the suffix at pos agrees with the text; 0 at pos 0. Null and empty texts
    give no rows; rows of repeated ids have arrays of their own."""
    return _per_text(texts, lambda t: [z_array(codes(t).tolist())], ["z"])


def _ranked(text: str):
    points = codes(text)
    rank = suffix_ranks(points)
    return [rank, common_prefixes(points.tolist(), rank.tolist())]


def suffix_array(texts: DataFrame) -> DataFrame:
    """(text_id, pos, rank, lcp): rank of the suffix at pos in code point order, and how far it agrees
    with the one before it. Read by rank it is the suffix array, by pos its inverse. Nulls as prefix_array."""
    return _per_text(texts, _ranked, ["rank", "lcp"])


def lcp_array(suffixes: DataFrame) -> DataFrame:
    """(text_id, rank, lcp) of suffix_array's rows."""
    return suffixes.select("text_id", "rank", "lcp")


def range_minimum(values: DataFrame, ranges: DataFrame, longest: int | None = None) -> DataFrame:
    """ranges (text_id, low, high) with `least`, the least lcp of the ranks from low to high, both counted
    in; null for an empty range. values are (text_id, rank, lcp) with one row a rank. A sparse table of
    minima over 2^l ranks answers every range by two equi-joins; each of its levels is the least of two
    rows of the level below, so a level costs the same for each rank. `longest`, a bound of the ranges'
    lengths, saves a look for it; a longer range raises."""
    if longest is None:
        longest = ranges.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 1
    levels = max(1, int(longest).bit_length())
    order = Window.partitionBy("text_id").orderBy("rank")
    table = values.select(F.col("text_id"), F.col("rank"), F.col("lcp").alias("_0"))
    for level in range(1, levels):
        table = table.withColumn(f"_{level}", F.least(f"_{level - 1}", F.lead(f"_{level - 1}", 1 << (level - 1)).over(order)))
    table = table.select(F.col("text_id").alias("_t"), F.col("rank").alias("_r"), F.posexplode(F.array(*(f"_{level}" for level in range(levels)))).alias("_level", "_least"))
    size = F.col("high") - F.col("low") + 1
    exponent = F.floor(F.log2(size.cast("double")) + 1e-9).cast("int")
    asked = ranges.withColumn("_l", F.when(size > longest, F.raise_error(F.lit("a range is longer than `longest`")).cast("int")).when(size > 0, exponent))
    first = shuffled(table.withColumnRenamed("_least", "_a"))
    second = shuffled(table.withColumnRenamed("_least", "_b"))
    own = lambda at: F.expr(f"text_id <=> _t AND _l = _level AND _r = {at}")
    asked = asked.join(first, own("low"), "left").drop("_t", "_r", "_level")
    asked = asked.join(second, own("high - CAST(shiftleft(1, _l) AS INT) + 1"), "left").drop("_t", "_r", "_level", "_l")
    return asked.withColumn("least", F.least("_a", "_b")).drop("_a", "_b")


def common_extension(suffixes: DataFrame, pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """pairs (text_id, i, j) with `lce`, how far the suffixes at i and j agree: the least lcp between their
    ranks, or the rest of the text for i = j. Places outside of the text give 0; null places null.
    suffixes are suffix_array's rows, of ids that do not repeat; `longest` as range_minimum."""
    at = lambda name: shuffled(suffixes.select(F.col("text_id").alias(f"_{name}t"), F.col("pos").alias(f"_{name}p"), F.col("rank").alias(f"_{name}r")))
    sizes = suffixes.groupBy(F.col("text_id").alias("_n")).agg(F.count("*").cast("int").alias("_size"))
    rows = pairs.join(at("a"), F.expr("text_id <=> _at AND i = _ap"), "left").join(at("b"), F.expr("text_id <=> _bt AND j = _bp"), "left").join(shuffled(sizes), F.expr("text_id <=> _n"), "left")
    rows = rows.withColumns({"low": F.least("_ar", "_br") + 1, "high": F.greatest("_ar", "_br")})
    found = range_minimum(lcp_array(suffixes), rows, longest)
    lce = F.expr("CASE WHEN i IS NULL OR j IS NULL THEN NULL WHEN _ar IS NULL OR _br IS NULL THEN 0 WHEN i = j THEN _size - i ELSE least END")
    return found.select(*pairs.columns, lce.cast("int").alias("lce"))

