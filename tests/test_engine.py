"""The SQL surface on small tables made in memory, with literal results."""

import math

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sluice.session import Engine, EngineError, run_sql
from sluice.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(spark, query, **data):
    return rows(run_sql(spark, query, {n: spark.createDataFrame(d, s) for n, (d, s) in data.items()}))


KV = "key bigint, value bigint"


def test_join_duplicates(spark):
    a = ([(1, 10), (2, 20), (1, 30), (3, 40)], "ak bigint, av bigint")
    b = ([(1, 100), (2, 200), (5, 500)], "bk bigint, bv bigint")
    got = run(spark, "SELECT ak, av, bk, bv FROM ta JOIN tb ON ak = bk", ta=a, tb=b)
    assert got == [(1, 10, 1, 100), (1, 30, 1, 100), (2, 20, 2, 200)]


def test_join_null_and_negative_keys(spark):
    a = ([(1, 10), (None, 20), (2, 30), (-5, 40)], "ak bigint, av bigint")
    b = ([(1, 100), (None, 200), (-5, 300)], "bk bigint, bv bigint")
    got = run(spark, "SELECT ak, av, bv FROM ta JOIN tb ON ak = bk", ta=a, tb=b)
    assert got == [(-5, 40, 300), (1, 10, 100)]


def test_nan_and_zero_keys(spark):
    data = [(0.0, 1), (-0.0, 2), (math.nan, 3), (0.0, 4), (math.nan, 5)]
    got = run(spark, "SELECT sum(value) AS s FROM t GROUP BY key", t=(data, "key double, value bigint"))
    assert got == [(7,), (8,)]


def test_empty_aggregate(spark):
    got = run(spark, "SELECT count(*) AS n, min(value) AS lo, sum(value) AS s FROM t", t=([], KV))
    assert got == [(0, None, None)]


def test_octet_length(spark):
    data = [("ok",), ("hello",), ("a-longer-string-here",), ("café",), (None,)]
    got = run(spark, "SELECT name, octet_length(name) AS n FROM t", t=(data, "name string"))
    assert sorted((n for _, n in got if n is not None)) == [2, 5, 5, 20]


def test_group_where(spark):
    data = [(1, 10), (1, 20), (2, 30), (1, 40), (2, 50)]
    got = run(spark, "SELECT sum(value) AS s, min(value) AS lo FROM t WHERE key = 1 AND value > 10 GROUP BY key", t=(data, KV))
    assert got == [(60, 20)]


def test_three_valued_or(spark):
    got = run(spark, "SELECT value FROM t WHERE key = 1 OR value > 5", t=([(None, 9), (None, 1), (1, 2)], KV))
    assert got == [(2,), (9,)]


def test_infinite_minimum(spark):
    got = run(spark, "SELECT min(v) AS lo, max(v) AS hi FROM t", t=([(math.inf,)], "v double"))
    assert got == [(math.inf, math.inf)]


def test_refusals(spark):
    df = spark.range(3)
    e = Engine(spark).register("t", df)
    with pytest.raises(EngineError):
        e.register("T", df)
    for query in ("SELECT 1; SELECT 2", "DROP VIEW t", "CREATE TABLE x (a INT)", "SELECT nope FROM t", "SELECT * FROM no_such_table"):
        with pytest.raises(EngineError):
            e.sql(query)
    with pytest.raises(tables.SchemaMismatch):
        e.register("u", df, T.StructType([T.StructField("id", T.IntegerType())]))
    with pytest.raises(EngineError):
        Engine(spark, overflow="ignore")


def test_overflow(spark):
    top = 2**63 - 1
    with pytest.raises(Exception, match="(?i)overflow"):
        Engine(spark).register("big_t", spark.createDataFrame([(top,)], "v bigint")).sql("SELECT v + 1 AS w FROM big_t").collect()
    wrap = Engine(spark, overflow="wrap")
    wrap.register("big_t", wrap.spark.createDataFrame([(top,)], "v bigint"))
    assert wrap.sql("SELECT v + 1 AS w FROM big_t").first()[0] == -(2**63)
    other = Engine(spark, overflow="wrap").register("big_u", spark.createDataFrame([(top,)], "v bigint"))
    assert other.sql("SELECT v + 1 AS w FROM big_u").first()[0] == -(2**63)


def test_batches(spark):
    schema = pa.schema([pa.field("key", pa.int64(), False), pa.field("value", pa.int64())])
    batch = lambda k, v: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v, pa.int64())], schema=schema)
    df = tables.from_batches(spark, [batch([1, 2], [5, None]), batch([1], [7])], schema)
    assert rows(run_sql(spark, "SELECT key, sum(value) AS s, count(value) AS n FROM bt GROUP BY key", {"bt": df})) == [(1, 12, 2), (2, None, 0)]
    odd = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([1], pa.int64())], names=["key", "value"])
    with pytest.raises(tables.SchemaMismatch):
        tables.from_batches(spark, [batch([1], [1]), odd], schema)
    assert sum(b.num_rows for b in tables.to_batches(df)) == 3


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.none() | st.integers(-1000, 1000)), min_size=1, max_size=39))
def test_group_by_property(spark, data):
    got = {r[0]: tuple(r)[1:] for r in run_sql(spark, "SELECT key, count(*) n, count(value) c, sum(value) s, min(value) lo, max(value) hi, avg(value) a FROM gp GROUP BY key", {"gp": spark.createDataFrame(data, KV)}).collect()}
    want = {}
    for k in {k for k, _ in data}:
        v = [x for q, x in data if q == k and x is not None]
        n = sum(q == k for q, _ in data)
        want[k] = (n, len(v), sum(v) if v else None, min(v, default=None), max(v, default=None), sum(v) / len(v) if v else None)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:5] == want[k][:5]
        assert got[k][5] == pytest.approx(want[k][5])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.none() | st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=40), min_size=1, max_size=15))
def test_strings_property(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = run_sql(spark, "SELECT name, octet_length(name) AS n FROM sp", {"sp": df}).collect()
    assert [(r[0], r[1]) for r in got] == [(n, None if n is None else len(n.encode())) for n in names]


def test_plans_push_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id AS k", "id * 2 AS v", "id AS unused").write.parquet(path)
    df = run_sql(spark, "SELECT a.v FROM pa_t a JOIN pb_t b ON a.k = b.k WHERE a.v > 100", {"pa_t": spark.read.parquet(path), "pb_t": spark.read.parquet(path)})
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(v,100)" in plan
    assert "unused" not in plan.split("== Physical Plan ==")[1]


def test_count_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "nullif(id, 3) AS v").write.parquet(path)
    df = tables.count_from_footers(spark, path, "v")
    assert tuple(df.first()) == (10, 9)
    assert "COUNT(*)" in df._jdf.queryExecution().toString().upper()
