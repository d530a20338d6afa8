"""Scalar operators as column builders, with the rules that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def wide(c: Column) -> Column:
    """Whole numbers are computed as 64-bit numbers."""
    return c.cast("bigint")


def add(a: Column, b: Column) -> Column:
    return wide(a) + wide(b)


def sub(a: Column, b: Column) -> Column:
    return wide(a) - wide(b)


def mul(a: Column, b: Column) -> Column:
    return wide(a) * wide(b)


def int_div(a: Column, b: Column) -> Column:
    """Truncates towards zero; an error for 0."""
    return F.call_function("div", wide(a), wide(b))


def rem(a: Column, b: Column) -> Column:
    """The sign is the dividend's."""
    return wide(a) % wide(b)


def select(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond, a).otherwise(b)


def get_or(array: Column, index: Column | int, default: Column) -> Column:
    """Element from 0, or the default out of bounds."""
    return F.coalesce(F.get(array, index), default)


def set_at(array: Column, index: int, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == index, value).otherwise(x))


def swap(array: Column, i: int, j: int) -> Column:
    return F.transform(array, lambda x, k: F.when(k == i, F.get(array, j)).when(k == j, F.get(array, i)).otherwise(x))


def sub_slice(array: Column, start: int, end: int) -> Column:
    """Elements [start, end) from 0."""
    return F.slice(array, start + 1, max(0, end - start))


def zip_shortest(a: Column, b: Column, f) -> Column:
    """Element-wise f; ends with the shorter array (Spark's own pads with nulls)."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def then_some(cond: Column, value: Column) -> Column:
    """The value, or null."""
    return F.when(cond, value)


@F.pandas_udf(LongType())
def float_bits(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The 64 bits of a double as a whole number; Spark has no such function."""
    for s in frames:
        yield pd.Series(s.to_numpy(np.float64).view(np.int64), index=s.index).where(s.notna())


@F.pandas_udf(DoubleType())
def bits_float(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in frames:
        yield pd.Series(s.fillna(0).to_numpy(np.int64).view(np.float64), index=s.index).where(s.notna())
