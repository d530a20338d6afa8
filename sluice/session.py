"""The SQL surface: named tables with declared schemas, one query at a time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .sources.tables import assert_schema


class EngineError(ValueError):
    """A query or table that the engine does not take."""


class Engine:
    """Tables by name, and SQL over them.

    Names are taken once, schemas are checked when a table is registered, and a
    query is one SELECT. Planning and execution are Spark's.
    """

    def __init__(self, spark: SparkSession, overflow: str = "error"):
        """`overflow`: "error" keeps the session's arithmetic; "wrap" runs this engine's
        queries in a session of its own where whole numbers wrap around."""
        if overflow not in ("error", "wrap"):
            raise EngineError(f"overflow is error or wrap, not {overflow!r}")
        if overflow == "wrap":
            spark = spark.newSession()
            spark.conf.set("spark.sql.ansi.enabled", "false")
        self.spark = spark
        self.tables: dict[str, StructType] = {}

    def register(self, name: str, df: DataFrame, schema: StructType | None = None, nullability: bool = False) -> Engine:
        """Give `df` a name; with `schema`, its columns must be exactly that."""
        key = name.lower()
        if key in self.tables:
            raise EngineError(f"table already registered: {name}")
        if schema is not None:
            assert_schema(df, schema, name, nullability)
        if df.sparkSession is not self.spark:
            # the same plan in this engine's session
            df = DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().logical()), self.spark)
        df.createOrReplaceTempView(name)
        self.tables[key] = df.schema
        return self

    def register_parquet(self, name: str, path: str, schema: StructType | None = None) -> Engine:
        return self.register(name, self.spark.read.parquet(path), schema)

    def sql(self, query: str) -> DataFrame:
        """The result of one SELECT; several statements, DDL and DML are refused."""
        text = query.strip().rstrip(";")
        parser = self.spark._jsparkSession.sessionState().sqlParser()
        try:
            parser.parseQuery(text)
        except ParseException as e:
            raise EngineError(f"not a single query: {e}") from e
        try:
            return self.spark.sql(text)
        except AnalysisException as e:
            raise EngineError(str(e)) from e


def run_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame], schemas: Mapping[str, StructType] | None = None) -> DataFrame:
    """One query over the given tables."""
    engine = Engine(spark)
    for name, df in tables.items():
        engine.register(name, df, (schemas or {}).get(name))
    return engine.sql(query)
