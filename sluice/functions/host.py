"""Host functions: Python code under a name, as scalar, array, table and iterator functions."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def vectorised(returns: str) -> Callable:
    """A function of pandas Series, called per Arrow batch."""
    return F.pandas_udf(returns)


def register(spark: SparkSession, name: str, function: Callable, returns: str):
    """A function of whole Series under a SQL name; 0 to 4 arguments or more."""
    return spark.udf.register(name, F.pandas_udf(function, returns))


def register_rows(spark: SparkSession, name: str, function: Callable, returns: str):
    """A function of single values under a SQL name, called for each row of an Arrow batch; it
    may call itself. Null where an argument is null."""

    arity = len(inspect.signature(function).parameters)

    def rows(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in columns:
            batch = batch if isinstance(batch, tuple) else (batch,)
            yield pd.Series([None if any(pd.isna(v) for v in values) else function(*values) for values in zip(*batch)], dtype=object)

    def one(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from rows(columns)

    one.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rows.__annotations__ = {"columns": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return spark.udf.register(name, F.pandas_udf(one if arity == 1 else rows, returns))


def define(name: str, arguments: str, returns: str, body: str) -> str:
    """The statement of a function that stays inside the JVM."""
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}"


def compose(*functions: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Column functions one after another; they fuse into one expression."""

    def run(c: Column) -> Column:
        for f in functions:
            c = f(c)
        return c

    return run


def table_function(spark: SparkSession, name: str, returns: str, generate: Callable[..., Iterable[tuple]]):
    """A host iterator as a SQL table function; with LATERAL it is called per row."""

    class Generated:
        def eval(self, *args):
            yield from generate(*args)

    made = F.udtf(Generated, returnType=returns)
    spark.udtf.register(name, made)
    return made


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """A single-pass host iterator over a partition's Arrow batches."""
    return df.mapInArrow(function, schema)


def sum_slice(array: Column) -> Column:
    """The sum of an array; 0 if it is empty."""
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + x)


@F.pandas_udf(LongType())
def length_of(arrays: pd.Series) -> pd.Series:
    """A host function over slices."""
    return arrays.map(len, na_action="ignore").astype("Int64")
