"""SQL table functions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, StructType


@lru_cache(maxsize=64)
def _prepared(patterns: tuple[str, ...], k: int, circular: bool):
    """The patterns' seeds, made once in a worker for the calls that follow."""
    from motifspark.operators.search import Patterns

    return Patterns(list(patterns), k, circular)


def _search(text, pattern, k, circular):
    import numpy as np

    from motifspark.operators.search import BLOCK, codes

    if not text or not pattern or k is None or len(pattern) > len(text):
        return
    if k < 0:
        raise ValueError("k must not be negative")
    wanted = _prepared((pattern,), k, circular)
    for _, start, distance, rotation in wanted.search(codes(text), np.array([len(text)]), max(BLOCK, len(pattern))):
        yield from zip(start.tolist(), distance.tolist(), rotation.tolist())


class KMismatch:
    """kmismatch(text, pattern, k) gives (pos, distance) of each start within k mismatches."""

    def eval(self, text: str, pattern: str, k: int):
        for pos, distance, _ in _search(text, pattern, k, False):
            yield pos, distance


class CircularKMismatch:
    """kmismatch_circular(text, pattern, k) gives (pos, distance, rotation), the best rotation of each start."""

    def eval(self, text: str, pattern: str, k: int):
        yield from _search(text, pattern, k, True)


class KMismatchTable:
    """kmismatch_table(TABLE(texts), patterns, k) gives the rows of a table, which has a string column `text`,
    once for each match of one of an array of patterns, with pattern (its place in the array), pos and
    distance. The patterns are prepared once a worker, whatever the table's rows. Null and empty ones match nothing."""

    @staticmethod
    def analyze(table: AnalyzeArgument, patterns: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "text" not in table.dataType.names:
            raise ValueError("the first argument must be a table with a column text")
        taken = {n.lower() for n in table.dataType.names} & {"pattern", "pos", "distance"}
        if taken:
            raise ValueError(f"the table has columns {', '.join(sorted(taken))}")
        if k.value is not None and k.value < 0:
            raise ValueError("k must not be negative")
        schema = StructType(list(table.dataType.fields))
        return AnalyzeResult(schema.add("pattern", IntegerType()).add("pos", LongType()).add("distance", IntegerType()))

    def eval(self, row, patterns, k):
        import numpy as np

        from motifspark.operators.search import BLOCK, codes

        known = [(i, p) for i, p in enumerate(patterns or ()) if p]
        if not row["text"] or not known or k is None:
            return
        wanted = _prepared(tuple(p for _, p in known), k, False)
        for number, start, distance, _ in wanted.search(codes(row["text"]), np.array([len(row["text"])]), max(BLOCK, wanted.longest)):
            for n, pos, d in zip(number.tolist(), start.tolist(), distance.tolist()):
                yield (*row, known[n][0], pos, d)


def register(spark: SparkSession) -> None:
    """Register the functions for SQL: SELECT ... FROM t, LATERAL kmismatch(t.text, 'pattern', 2), or
    SELECT * FROM kmismatch_table(TABLE(t), array('pattern', 'other'), 2)."""
    spark.udtf.register("kmismatch_table", udtf(KMismatchTable))
    spark.udtf.register("kmismatch", udtf(KMismatch, returnType="pos bigint, distance int"))
    spark.udtf.register("kmismatch_circular", udtf(CircularKMismatch, returnType="pos bigint, distance int, rotation int"))
