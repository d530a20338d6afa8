"""Ordered sequences: adapters and terminals over a frame with an explicit order.

A Spark frame has no order, so a sequence names its order column, whose values are
distinct. Nothing here sorts into one partition: terminals and the while-adapters
are aggregates, and what needs positions or running values is done in
buckets of the order, whose totals are carried over as a small table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

from ..streaming.run import shared_folder

Fold = Callable[[Column, Column], Column]
#: Items of a bucket of the order for running values, and buckets, at most.
PER_BUCKET, MOST_BUCKETS = 1 << 20, 1 << 14
#: Neighbours that a task of a sequential fold holds, and the states appended to one array.
RUN, SPAN = 1 << 16, 256


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Seq:
    """The items of column `item`, in the order of column `ord`."""

    df: DataFrame
    ord: str = "ord"
    item: str = "item"

    @staticmethod
    def of(df: DataFrame, ord: Column | str, item: Column | str) -> Seq:
        return Seq(df.select(_col(ord).alias("ord"), _col(item).alias("item")))

    @staticmethod
    def range(spark: SparkSession, start: int, end: int, step: int = 1) -> Seq:
        """[start, end); the step is 1 or more."""
        if step < 1:
            raise ValueError(f"the step of a range is 1 or more, not {step}")
        numbers = spark.range(start, max(start, end), step)
        return Seq(numbers.select(F.col("id").alias("ord"), F.col("id").alias("item")))

    @staticmethod
    def of_array(df: DataFrame, array: Column | str) -> Seq:
        """The elements of an array column of a one-row frame."""
        return Seq(df.select(F.posexplode(_col(array)).alias("ord", "item")))

    @property
    def _x(self) -> Column:
        return F.col(self.item)

    @property
    def _o(self) -> Column:
        return F.col(self.ord)

    # adapters

    def map(self, f: Callable[[Column], Column]) -> Seq:
        return replace(self, df=self.df.select(self.ord, f(self._x).alias(self.item)))

    def filter(self, p: Callable[[Column], Column]) -> Seq:
        return replace(self, df=self.df.where(p(self._x)))

    def filter_map(self, f: Callable[[Column], Column]) -> Seq:
        """f gives a value or null; nulls are left out."""
        return replace(self, df=self.map(f).df.where(self._x.isNotNull()))

    def take_while(self, p: Callable[[Column], Column]) -> Seq:
        """Items before the first that fails: its place first, then a filter, no sort."""
        return self._split(p, lambda o, at: at.isNull() | (o < at))

    def skip_while(self, p: Callable[[Column], Column]) -> Seq:
        """The first item that fails and all after it."""
        return self._split(p, lambda o, at: o >= at)

    def _split(self, p, side) -> Seq:
        fails = ~F.coalesce(p(self._x), F.lit(False))
        at = self.df.agg(F.min(F.when(fails, self._o)).alias("_at"))  # one row
        out = self.df.join(F.broadcast(at), on=F.lit(True)).where(side(self._o, F.col("_at")))
        return replace(self, df=out.select(self.ord, self.item))

    def scan(self, kind: str) -> Seq:
        """Running "sum", "min", "max" or "count" up to and with each item."""
        return replace(self, df=self._running(self._x, kind).select(self.ord, F.col("_value").alias(self.item)))

    def _bucketed(self) -> DataFrame:
        """The rows with `_b`, the bucket of their place in the order.

        The order is cut at its approximate quantiles, as many as its length asks for, which
        come as one broadcast row. A row looks among every `step`-th cut first and
        then among the `step` cuts behind that. A short sequence is one bucket.
        """
        n = min(MOST_BUCKETS, -(-self.df.count() // PER_BUCKET))
        if n < 2:
            return self.df.withColumn("_b", F.lit(0))
        step = math.isqrt(n - 1) + 1
        cuts = F.percentile_approx(self._o, [k / n for k in range(1, n)], max(10_000, 10 * n))
        cuts = self.df.agg(F.array_sort(F.array_distinct(cuts)).alias("_cuts"))  # one row
        cuts = cuts.select("_cuts", F.filter("_cuts", lambda c, i: i % step == 0).alias("_tops"))
        tops = F.size(F.filter("_tops", lambda c: c < self._o))
        rows = self.df.join(F.broadcast(cuts), on=F.lit(True)).withColumn("_top", tops)
        first = (F.col("_top") - 1) * step + 1
        inside = F.size(F.filter(F.slice("_cuts", first, F.lit(step)), lambda c: c < self._o))
        return rows.withColumn("_b", F.when(F.col("_top") > 0, first - 1 + inside).otherwise(0)).drop("_cuts", "_tops", "_top")

    def _running(self, x: Column, kind: str) -> DataFrame:
        """The rows with `_value`, the running aggregate of x.

        Running values inside a bucket come from a window per bucket; what all earlier
        buckets give is a window over the buckets' totals, at most MOST_BUCKETS rows, joined by broadcast.
        """
        inside = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[kind]
        over = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}[kind]
        both = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest}[kind]
        rows = self._bucketed()
        local = rows.withColumn("_r", inside(x).over(W.partitionBy("_b").orderBy(self._o).rowsBetween(W.unboundedPreceding, 0)))
        totals = rows.groupBy("_b").agg(inside(x).alias("_t"))
        before = totals.select(F.col("_b").alias("_of"), over("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
        out = local.join(F.broadcast(before), F.col("_b") == F.col("_of"))
        value = F.when(F.col("_before").isNull(), F.col("_r")).when(F.col("_r").isNull(), F.col("_before")).otherwise(both(F.col("_before"), F.col("_r")))
        return out.withColumn("_value", value)

    def scan_fold(self, init: Column, f: Fold) -> Seq:
        """A running fold of any step function, emitting the state after each item.

        A step that does not compose cannot be split, so runs of RUN items, written as
        arrays into the shared folder, are folded one after the other, a job each, and the
        state after a run goes to the next. With each run's first state known, the states
        inside the runs are found in parallel. Every run is read twice and a task holds one.
        """
        spark = self.df.sparkSession
        pair = F.struct(self._o.alias("o"), self._x.alias("x"))
        runs = self.enumerate().groupBy(F.expr(f"index div {RUN}").alias("run")).agg(F.sort_array(F.collect_list(pair)).alias("a"))
        folder = f"{shared_folder(spark)}/runs"
        runs.repartition("run").write.partitionBy("run").parquet(folder)
        table = spark.read.schema(runs.schema).parquet(folder)
        last = table.agg(F.max("run")).first()[0]
        first = spark.range(1).select(init.alias("s"))
        schema = StructType([StructField("of", LongType()), StructField("s", first.schema["s"].dataType)])
        state, starts = first.first()["s"], []
        for k in range(0 if last is None else last + 1):
            starts.append((k, state))
            if k < last:
                run = spark.read.schema(runs.select("a").schema).parquet(f"{folder}/run={k}")
                at = spark.createDataFrame(starts[-1:], schema)  # one row
                state = run.join(F.broadcast(at), on=F.lit(True)).select(F.aggregate("a", F.col("s"), lambda s, e: f(s, e["x"]))).first()[0]
        # states are appended to spans of SPAN items, as an append copies its array; each span begins with the state before it
        begin = F.array(F.struct(F.get("a", 0)["o"].alias("o"), F.col("s").alias("x")))
        append = lambda out, e: F.concat(out, F.array(F.struct(e["o"].alias("o"), f(F.element_at(out, -1)["x"], e["x"]).alias("x"))))
        spans = F.transform(F.sequence(F.lit(1), F.size("a"), F.lit(SPAN)), lambda i: F.slice("a", i, SPAN))
        found = F.aggregate(spans, F.array(begin), lambda out, span: F.concat(out, F.array(F.aggregate(span, F.slice(F.element_at(out, -1), -1, 1), append))))
        states = F.flatten(F.transform(found, lambda span: F.slice(span, 2, SPAN)))
        out = table.join(F.broadcast(spark.createDataFrame(starts, schema)), F.col("run") == F.col("of")).select(F.explode(states).alias("e"))
        return replace(self, df=out.select(F.col("e.o").alias(self.ord), F.col("e.x").alias(self.item)))

    def enumerate(self) -> DataFrame:
        """(ord, item, index): places from 0, without a global sort."""
        return self._running(F.lit(1), "count").select(self.ord, self.item, (F.col("_value") - 1).alias("index"))

    def zip(self, other: Seq, f: Fold | None = None) -> Seq:
        """Pairs of items at the same place; ends with the shorter sequence."""
        left = self.enumerate().select(F.col("index"), F.col(self.item).alias("_l"))
        right = other.enumerate().select(F.col("index").alias("_i"), F.col(other.item).alias("_r"))
        pair = f(F.col("_l"), F.col("_r")) if f else F.struct(F.col("_l").alias("left"), F.col("_r").alias("right"))
        out = left.join(right, F.col("index") == F.col("_i"))
        return Seq(out.select(F.col("index").alias("ord"), pair.alias("item")))

    # terminals: frames of one row

    def fold_stats(self, **aggs: Column) -> DataFrame:
        """Several accumulators in one pass."""
        return self.df.agg(*[c.alias(n) for n, c in aggs.items()])

    def _one(self, c: Column, name: str) -> DataFrame:
        return self.df.agg(c.alias(name))

    def sum(self, name: str = "sum") -> DataFrame:
        """0 for no items."""
        return self._one(F.coalesce(F.sum(self._x), F.lit(0)), name)

    def count(self, name: str = "n") -> DataFrame:
        return self._one(F.count(F.lit(1)), name)

    def min(self, name: str = "min", if_empty=None) -> DataFrame:
        return self._one(F.coalesce(F.min(self._x), F.lit(if_empty)), name)

    def max(self, name: str = "max", if_empty=None) -> DataFrame:
        return self._one(F.coalesce(F.max(self._x), F.lit(if_empty)), name)

    def count_if(self, p: Callable[[Column], Column], name: str = "n") -> DataFrame:
        return self._one(F.count_if(p(self._x)), name)

    def sum_if(self, p: Callable[[Column], Column], name: str = "sum") -> DataFrame:
        return self._one(F.coalesce(F.sum(F.when(p(self._x), self._x)), F.lit(0)), name)

    def any(self, p: Callable[[Column], Column], name: str = "any") -> DataFrame:
        """False for no items."""
        return self._one(F.coalesce(F.bool_or(p(self._x)), F.lit(False)), name)

    def all(self, p: Callable[[Column], Column], name: str = "all") -> DataFrame:
        """True for no items."""
        return self._one(F.coalesce(F.bool_and(p(self._x)), F.lit(True)), name)

    def position(self, p: Callable[[Column], Column], name: str = "position") -> DataFrame:
        """Place of the first match, or the number of items: how many come before it."""
        at = self.df.agg(F.min(F.when(p(self._x), self._o)).alias("_at"))
        out = self.df.join(F.broadcast(at), on=F.lit(True))
        return out.agg(F.count_if(F.col("_at").isNull() | (self._o < F.col("_at"))).alias(name))

    def find_map(self, f: Callable[[Column], Column]) -> DataFrame:
        """(value, found): f of the first item for which it is not null."""
        value = f(self._x)
        return self.df.agg(F.min_by(value, F.when(value.isNotNull(), self._o)).alias("value"), (F.count(value) > 0).alias("found"))

    def last(self, if_empty=0, name: str = "last") -> DataFrame:
        return self._one(F.coalesce(F.max_by(self._x, self._o), F.lit(if_empty)), name)

    def reverse(self) -> Seq:
        return replace(self, df=self.df.select((-self._o).alias(self.ord), self.item))

    def window_fold(self, k: int, init: Column, f: Fold, key: Column | None = None) -> Seq:
        """A fold over each run of k neighbours. `key` splits the sequence into pieces
        that windows do not cross; without one the order is cut into runs of RUN items,
        each with the k - 1 items after it."""
        if key is not None:
            rows, own, part = self.df, F.lit(True), key
        else:
            placed = self.enumerate()
            into = F.sequence(F.greatest(F.expr(f"(index - {k - 1}) div {RUN}"), F.lit(0).cast("bigint")), F.expr(f"index div {RUN}"))
            rows, own, part = placed.withColumn("_into", F.explode(into)), F.expr(f"index div {RUN} = _into"), F.col("_into")
        w = W.partitionBy(part).orderBy(self._o).rowsBetween(0, k - 1)
        runs = rows.select(self.ord, own.alias("_own"), F.collect_list(self._x).over(w).alias("_run")).where(F.col("_own") & (F.size("_run") == k))
        return replace(self, df=runs.select(self.ord, F.aggregate("_run", init, f).alias(self.item)))

    def for_each(self, consume: Callable) -> None:
        """Side effects per partition, on the executors."""
        self.df.select(self.item).foreachPartition(lambda rows: [consume(r[0]) for r in rows] and None)


def member_count(items: DataFrame, item: str, among: DataFrame, key: str, name: str = "n") -> DataFrame:
    """How many items are in the other table: a semi join and a count."""
    return items.join(among, items[item] == among[key], "left_semi").agg(F.count(F.lit(1)).alias(name))


def nested(nodes: DataFrame, node: str, edges: DataFrame, source: str) -> DataFrame:
    """Rows of an inner sequence per item of an outer one."""
    return nodes.join(edges, nodes[node] == edges[source])
