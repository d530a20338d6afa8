"""Sources, strict schemas and sinks."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType


class SchemaMismatch(ValueError):
    """A table does not have the schema that was declared for it."""


def _plain(kind: DataType) -> str:
    return kind.simpleString()


def assert_schema(df: DataFrame, expected: StructType, name: str = "table", nullability: bool = False) -> DataFrame:
    """`df` if its columns have exactly the expected names, order and types.

    Files never say that a column has no nulls, so nullability is compared on
    request only (tables made in memory).
    """
    row = lambda f: (f.name, _plain(f.dataType), f.nullable) if nullability else (f.name, _plain(f.dataType))
    have, want = [row(f) for f in df.schema], [row(f) for f in expected]
    if have != want:
        raise SchemaMismatch(f"{name}: expected {expected.simpleString()}, got {df.schema.simpleString()}")
    return df


def read(spark: SparkSession, path: str | list[str], format: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """Files of any of Spark's formats; text formats should be given a schema."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read(spark, f"{folder}/{name}.parquet")


def from_batches(spark: SparkSession, batches: Iterable[pa.RecordBatch], schema: pa.Schema, name: str = "table") -> DataFrame:
    """Arrow batches of one declared schema as a table; a batch that differs in
    names, types or nullability is refused."""
    kept = []
    for k, batch in enumerate(batches):
        if not batch.schema.equals(schema):
            raise SchemaMismatch(f"{name}, batch {k}: expected\n{schema}\ngot\n{batch.schema}")
        kept.append(batch)
    return spark.createDataFrame(pa.Table.from_batches(kept, schema))


def to_batches(df: DataFrame) -> list[pa.RecordBatch]:
    """The result as Arrow batches on the driver, for results that fit there."""
    return df.toArrow().to_batches()


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def count_from_footers(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """count(*) and count(column) from Parquet footers, without reading a page.

    Needs the second reader generation and its aggregate push-down; set on a session
    of its own so that other queries keep theirs.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    wanted = ["count(*) AS n", *(f"count(`{c}`) AS n_{c}" for c in columns)]
    return own.read.parquet(path).selectExpr("*").createOrReplaceTempView("footers") or own.sql(f"SELECT {', '.join(wanted)} FROM footers")
