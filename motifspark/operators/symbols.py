"""Bytes and arrays as strings, so that searches by code points serve them too.

A byte is the code point of its value, so positions are offsets in bytes. Elements of arrays are numbered
by one dictionary of the patterns' symbols; what no pattern holds needs no number of its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Code points of symbols begin here, and pass over those of surrogates; as many symbols as are left.
FIRST, SURROGATES, COUNT = 0x100, (0xD800, 0x800), 0x110000 - 0x100 - 0x800
#: Code points of symbols that no pattern holds, and of null ones of texts and patterns, which equal nothing.
OTHER, NULL_TEXT, NULL_PATTERN = 0, 1, 2


def bytes_as_text(rows: DataFrame, column: str) -> DataFrame:
    """rows whose binary column is a string with one code point a byte."""
    return rows.withColumn(column, F.decode(column, "ISO-8859-1"))


def _arrays_as_text(rows: DataFrame, column: str, symbols, null: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(symbols)
    schema = ", ".join(f"`{f.name}` {'string' if f.name == column else f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch[column]
            flat = pc.list_flatten(lists)
            number = pc.index_in(flat, value_set=shared.value)
            point = pc.fill_null(pc.add(number, FIRST), OTHER).to_numpy(zero_copy_only=False).astype(np.uint32)
            point[point >= SURROGATES[0]] += SURROGATES[1]
            point[pc.is_null(flat).to_numpy(zero_copy_only=False)] = null
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            texts = [point[e - n : e].tobytes().decode("utf-32-le") for n, e in zip(sizes, ends)]
            text = pa.array(texts, pa.string(), mask=pc.is_null(lists).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([text if name == column else batch[name] for name in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(run, schema)


def encoded(texts: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (text) and patterns (pattern) as strings in which equal symbols, and no others, have equal code
    points. Both are strings, binary, or arrays of one element type with at most COUNT different symbols
    in patterns; null elements match nothing. Other types, or two different ones, raise ValueError."""
    kinds = texts.schema["text"].dataType, patterns.schema["pattern"].dataType
    if kinds == (StringType(), StringType()):
        return texts, patterns
    if kinds == (BinaryType(), BinaryType()):
        return bytes_as_text(texts, "text"), bytes_as_text(patterns, "pattern")
    if not all(isinstance(kind, ArrayType) for kind in kinds) or kinds[0].elementType != kinds[1].elementType:
        raise ValueError("texts and patterns must both be strings, binary or arrays of one type")
    symbols = patterns.select(F.explode("pattern").alias("symbol")).where("symbol IS NOT NULL").distinct().limit(COUNT + 1).toArrow()["symbol"].combine_chunks()
    if len(symbols) > COUNT:
        raise ValueError(f"the patterns have more than {COUNT} different symbols")
    return _arrays_as_text(texts, "text", symbols, NULL_TEXT), _arrays_as_text(patterns, "pattern", symbols, NULL_PATTERN)
