"""Mismatch expressions of two equally long strings, and arrays of mismatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _symbols(x: str) -> str:
    """The characters of a string, in one pass over it."""
    return f"regexp_extract_all({x}, '(?s).', 0)"


def _differ(x: str, w: str) -> str:
    """array<boolean>: whether w differs from x at each place of x, as it does where it has ended."""
    return f"zip_with({_symbols(x)}, {_symbols(f'left({w}, length({x}))')}, (a, b) -> NOT a <=> b)"


def mismatch_positions(x: str, w: str) -> Column:
    """array<int> of the places, from 0, at which w differs from x; null if either is null."""
    return F.expr(f"CASE WHEN {x} IS NOT NULL AND {w} IS NOT NULL THEN filter(transform({_differ(x, w)}, (d, i) -> CASE WHEN d THEN i END), i -> i IS NOT NULL) END")


def hamming(x: str, w: str) -> Column:
    """Number of places at which the strings differ."""
    return F.size(mismatch_positions(x, w))


def k_extension(windows: DataFrame, k: int, x: str = "x", w: str = "w") -> DataFrame:
    """windows with `extension`: element q is the length of the longest prefix of w that agrees with x in
    all but q places, for q from 0 to k. Windows are as long as x; null strings give null."""
    if k < 0:
        raise ValueError("k must not be negative")
    places = windows.withColumn("_places", mismatch_positions(x, w))
    return places.withColumn("extension", F.expr(f"CASE WHEN _places IS NOT NULL THEN transform(sequence(0, {k}), q -> coalesce(get(_places, q), length({x}))) END")).drop("_places")


def sliding_mismatches(windows: DataFrame, x: str = "x", w: str = "w") -> DataFrame:
    """windows with `distances`: element r is the distance of rotation r of x to the stretch of w that
    starts at r, where w is as long as x doubled without its last character. A running sum over the
    places of the doubled pattern gives all: each next window adds a place and drops one. Null strings give null."""
    doubled = f"concat({x}, substring({x}, 1, length({x}) - 1))"
    rows = windows.withColumn("_x", F.expr(doubled)).withColumn("_differ", F.expr(_differ("_x", w)))
    first = f"size(filter(slice(_differ, 1, length({x})), d -> d))"
    step = f"a.now + CAST(_differ[r + length({x}) - 1] AS INT) - CAST(_differ[r - 1] AS INT)"
    sums = f"aggregate(slice(sequence(0, length({x})), 2, length({x}) - 1), named_struct('now', {first}, 'all', array({first})), (a, r) -> named_struct('now', {step}, 'all', array_append(a.all, {step})), a -> a.all)"
    return rows.withColumn("distances", F.expr(f"CASE WHEN length({x}) > 0 AND {w} IS NOT NULL THEN {sums} END")).drop("_x", "_differ")
