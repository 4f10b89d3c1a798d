"""Turning computed arrays and structs into rows without computing them twice.

The optimizer gives an inner explode a test for non-empty input, and moves any filter below
the projections it refers to; either way a computed column is then computed once for the
test and once for its value. A test on the output of an outer explode cannot move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def each(table: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """``keep`` columns and a row per element; elements must not be NULL."""
    return table.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def each_placed(table: DataFrame, keep: list, array: Column, position: str, name: str) -> DataFrame:
    """As ``each``, with the zero-based position."""
    return table.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(position).isNotNull())


def settled(table: DataFrame, keep: list, value: Column) -> DataFrame:
    """``keep`` columns and the fields of a computed struct, on which filters may follow freely."""
    return table.select(*keep, F.inline_outer(F.array(value)))
