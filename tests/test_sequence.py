"""Ordered sequences, scalar operators, host functions and streams against literal results."""

import math
import os

import pytest
from pyspark.sql import functions as F

from sluice.functions import host, scalar
from sluice.operators import sequence
from sluice.operators.asof import asof_join
from sluice.operators.sequence import Seq
from sluice.streaming import run as streaming


def seq(spark, values, kind="bigint"):
    return Seq(spark.createDataFrame(list(enumerate(values)), f"ord bigint, item {kind}"))


def items(s):
    return [r[0] for r in s.df.orderBy(s.ord).select(s.item).collect()]


def one(df):
    return tuple(df.first())


def test_while(spark):
    assert one(seq(spark, [1, 2, 3, 5, 4]).take_while(lambda x: x < 5).sum()) == (6,)
    assert one(seq(spark, [1, 2, 3, 5, 4, 6]).skip_while(lambda x: x < 5).sum()) == (15,)
    assert items(seq(spark, [1, None, 2]).take_while(lambda x: x < 5)) == [1]
    assert items(seq(spark, [1, 2]).skip_while(lambda x: x < 5)) == []


@pytest.fixture(params=[1 << 20, 300, 10])
def bucket(request, monkeypatch):
    """Sequences of one bucket, of a few and of many."""
    monkeypatch.setattr(sequence, "PER_BUCKET", request.param)


def test_scan(spark, bucket):
    assert one(seq(spark, [1, 2, 3, 4]).scan("sum").sum()) == (20,)
    values = [(k * 37) % 101 - 50 for k in range(1000)]
    total, sums, lows = 0, [], []
    for v in values:
        total += v
        sums.append(total)
        lows.append(min(lows[-1:] + [v]))
    s = seq(spark, values)
    assert items(s.scan("sum")) == sums
    assert items(s.scan("min")) == lows
    assert items(seq(spark, []).scan("sum")) == []
    step = s.scan_fold(F.lit(0).cast("bigint"), lambda a, x: (a * 3 + x) % 1009)
    a, want = 0, []
    for v in values:
        a = int(math.fmod(a * 3 + v, 1009))
        want.append(a)
    assert items(step) == want


def test_positions(spark):
    assert one(seq(spark, [10, 20, 3, 40]).position(lambda x: x == 3)) == (2,)
    assert one(seq(spark, [10, 20]).position(lambda x: x == 3)) == (2,)
    assert one(seq(spark, [5, 6, 7]).find_map(lambda x: F.when(x > 5, x * 2))) == (12, True)
    assert one(seq(spark, [5]).find_map(lambda x: F.when(x > 5, x * 2))) == (None, False)


def test_empty_terminals(spark):
    s = seq(spark, [])
    assert one(s.sum()) == (0,) and one(s.count()) == (0,)
    assert one(s.any(lambda x: x > 0)) == (False,) and one(s.all(lambda x: x > 0)) == (True,)
    assert one(s.min()) == (None,) and one(s.max(if_empty=-1)) == (-1,)
    assert one(s.last()) == (0,)


def test_long_zip_and_enumerate(spark, bucket):
    values = [(k * 37) % 101 for k in range(700)]
    s = Seq(spark.createDataFrame([(k * k, v) for k, v in enumerate(values)], "ord bigint, item bigint").repartition(3))
    assert sorted(tuple(r) for r in s.enumerate().collect()) == [(k * k, v, k) for k, v in enumerate(values)]
    assert items(s.zip(seq(spark, values[::-1][:500]), lambda a, b: a * b)) == [a * b for a, b in zip(values, values[::-1][:500])]
    nested = s.zip(seq(spark, values)).zip(seq(spark, [1, 2, 3]), lambda p, x: p["left"] * p["right"] + x)
    assert items(nested) == [v * v + k + 1 for k, v in enumerate(values[:3])]


def test_for_each(spark, tmp_path):
    """Side effects on the executors, of single items and of pairs."""
    folder = str(tmp_path)
    note = lambda v: open(f"{folder}/{v}", "w").close()
    seq(spark, [3, 1, 2]).for_each(note)
    seq(spark, [10, 20]).zip(seq(spark, [7, 8, 9])).for_each(lambda p: open(f"{folder}/{p[0]}-{p[1]}", "w").close())
    assert sorted(os.listdir(folder)) == ["1", "10-7", "2", "20-8", "3"]


def test_late_rows_and_windows(spark):
    day = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"
    rows = lambda *times: spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    batches = [rows(day(1, 1), day(1, 20)), rows(day(2, 3), day(4, 0)), rows(day(4, 1)), rows(day(1, 5), day(4, 2))]  # the last begins with a late row
    found = streaming.windowed(streaming.arrivals(spark, batches), "t", [], "1 day", late="1 hour", n=F.count(F.lit(1)))
    got = sorted((str(r.window.start), r.n) for r in streaming.drain(found).collect())
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-02 00:00:00", 1)]


def test_streams_on_both_sides(spark):
    rows = lambda name, pairs: spark.createDataFrame(pairs, f"k int, {name} string").select("k", F.col(name).cast("timestamp").alias(name))
    left = [rows("at", [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00")]), rows("at", [(1, "2024-01-01 05:00:00")])]
    right = [rows("later", [(1, "2024-01-01 00:30:00"), (1, "2024-01-01 03:00:00")]), rows("later", [(2, "2024-01-01 04:00:00"), (1, "2024-01-01 05:59:00")])]
    joined = streaming.join_streams(streaming.arrivals(spark, left), streaming.arrivals(spark, right), ["k"], "at", "later", "1 hour")
    got = sorted((str(r["at"]), str(r["later"])) for r in streaming.drain(joined.select("at", "later")).collect())
    assert got == [("2024-01-01 00:00:00", "2024-01-01 00:30:00"), ("2024-01-01 05:00:00", "2024-01-01 05:59:00")]


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 5), (5, "a", None), (6, "a", 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("a", 5, 30), (None, 1, 40), ("a", 8, 50), ("b", None, 60)], "k string, t int, v int")
    got = sorted((r.id, r.v) for r in asof_join(left, right, ["k"], "t", ["v"], "v").collect())
    assert got == [(1, 30), (2, None), (3, None), (4, None), (5, None), (6, 30)]
    assert asof_join(left.limit(0), right, ["k"], "t", ["v"], "v").count() == 0
    assert asof_join(left, right.limit(0), ["k"], "t", ["v"], "v").count() == 6


def test_zip_and_range(spark):
    left, right = seq(spark, [1, 2, 3]), seq(spark, [10, 20])
    assert items(left.zip(right, lambda a, b: a * b)) == [10, 40]
    assert items(Seq.range(spark, 1, 10, 3)) == [1, 4, 7]
    assert items(Seq.range(spark, 5, 1)) == []
    with pytest.raises(ValueError):
        Seq.range(spark, 0, 5, 0)


def test_window_fold(spark):
    got = seq(spark, [3, 6, 7, 5, 3, 5]).window_fold(4, F.lit(1).cast("bigint"), lambda a, x: a * x)
    assert items(got) == [630, 630, 525]


def test_scalars(spark):
    df = spark.createDataFrame([(-7, 3), (7, -3), (-7, -3)], "a bigint, b bigint")
    got = df.select(scalar.int_div(F.col("a"), F.col("b")), scalar.rem(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(-2, -1), (-2, 1), (2, -1)]
    arrays = spark.createDataFrame([([1, 2, 3], [10, 20])], "a array<bigint>, b array<bigint>")
    got = arrays.select(
        scalar.zip_shortest(F.col("a"), F.col("b"), lambda x, y: x * y), scalar.get_or(F.col("a"), 9, F.lit(-1)),
        scalar.set_at(F.col("a"), 1, F.lit(0)), scalar.swap(F.col("a"), 0, 2), scalar.sub_slice(F.col("a"), 1, 3),
    ).first()
    assert tuple(got) == ([10, 40], -1, [1, 0, 3], [3, 2, 1], [2, 3])
    bits = spark.createDataFrame([(1.5,), (None,)], "x double").select(scalar.bits_float(scalar.float_bits("x"))).collect()
    assert [r[0] for r in bits] == [1.5, None]


def test_host_functions(spark):
    host.register(spark, "host_double", lambda s: s * 2, "bigint")
    assert spark.sql("SELECT host_double(id) FROM range(3)").collect() == [(0,), (2,), (4,)]
    host.table_function(spark, "host_pairs", "a bigint, b bigint", lambda n: ((i, i * i) for i in range(n)))
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM host_pairs(3)").collect()) == [(0, 0), (1, 1), (2, 4)]
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "a array<bigint>")
    assert [tuple(r) for r in df.select(host.sum_slice(F.col("a")), host.length_of("a")).collect()] == [(6, 3), (0, 0), (None, None)]


def test_stream_equals_batch(spark, tmp_path):
    table = spark.range(200).selectExpr("id % 7 AS key", "nullif(id, 5) AS value")
    shape = lambda t: t.groupBy("key").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    got = streaming.over_stream(spark, table, shape, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, shape(table).collect()))
    kept = streaming.over_stream(spark, table, lambda t: t.where("value > 100"))
    assert kept.count() == table.where("value > 100").count()


def test_empty_stream(spark, tmp_path):
    empty = spark.range(0).selectExpr("id AS v")
    shape = lambda t: t.agg(F.count(F.lit(1)).alias("n"))
    some = spark.createDataFrame([], "n bigint")
    assert streaming.scalar_or_empty(some, shape(empty)).collect() == [(0,)]
    assert streaming.scalar_or_empty(shape(spark.range(3)), shape(empty)).collect() == [(3,)]
