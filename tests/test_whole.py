"""Queries that once ran over a part of their tables or of a sequence."""

import math
import os

import pytest
from pyspark.sql import functions as F

from sluice.operators import sequence
from sluice.operators.sequence import Seq
from sluice.plans import catalog

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 1000])
def test_scan_fold_carries_its_state_over_runs(spark, monkeypatch, n):
    monkeypatch.setattr(sequence, "RUN", 100, raising=False)
    monkeypatch.setattr(sequence, "SPAN", 7, raising=False)
    values = [(k * 37) % 101 - 50 for k in range(n)]
    a, want = 0, []
    for k, v in enumerate(values):
        a = int(math.fmod(a * 3 + v, 1009))
        want.append((k * 5, a))
    df = spark.createDataFrame([(k * 5, v) for k, v in enumerate(values)], "ord bigint, item bigint").repartition(3)
    got = Seq(df).scan_fold(F.lit(0).cast("bigint"), lambda s, x: (s * 3 + x) % 1009).df
    assert sorted(map(tuple, got.collect())) == want


@tables
def test_scan_fold_query_is_whole(spark):
    assert catalog.QUERIES["iter_scan_fold"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()


@tables
def test_join_dups_has_every_key(spark):
    keys = spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_orderkey").count()
    want = keys.agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert catalog.QUERIES["join_dups"](spark, FOLDER).count() == want


@pytest.mark.parametrize("k", [1, 4, 23])
def test_windows_cross_runs(spark, monkeypatch, k):
    monkeypatch.setattr(sequence, "RUN", 10, raising=False)
    values = [(i * 7) % 13 for i in range(95)]
    df = spark.createDataFrame(list(enumerate(values)), "ord bigint, item bigint").repartition(3)
    got = Seq(df).window_fold(k, F.lit(0).cast("bigint"), lambda a, x: a * 3 % 1009 + x).df
    want = []
    for i in range(95 - k + 1):
        a = 0
        for x in values[i : i + k]:
            a = a * 3 % 1009 + x
        want.append((i, a))
    assert sorted(map(tuple, got.collect())) == want


@tables
def test_window_product_is_of_neighbours(spark):
    items = [r[0] % 9 + 1 for r in spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("event_id").select("user_id").collect()]
    assert catalog.QUERIES["iter_window_product"](spark, FOLDER).first()[0] == max(math.prod(items[k : k + 4]) for k in range(len(items) - 3))


#: The answers at the published arguments of these puzzles.
ANSWERS = {
    "prime_factor": 6857, "smallest_multiple": 232792560, "nth_prime": 104743, "primes": 142913828922, "divisible_triangle": 76576500,
    "lattice": 137846528820, "amicable": 31626, "digit_powers": 443839, "digit_factorials": 40730, "triangle": 1074,
}


@pytest.mark.parametrize("name", ANSWERS)
def test_programs_at_the_arguments_of_the_reference(spark, name):
    assert catalog.QUERIES[f"program_{name}"](spark, FOLDER).first()[0] == ANSWERS[name]
