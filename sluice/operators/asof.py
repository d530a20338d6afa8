"""As-of joins: each left row with the last right row of its key at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], tie: str) -> DataFrame:
    """The columns of `left` and, of the latest row of `right` with equal keys and `time` not
    later, `values` (null if there is none). Of right rows at one time that of the largest `tie` counts.

    Both sides are stacked and sorted once by key and time, and the last right row is carried forward by a
    window; no row meets more than its neighbours, so the work is that of one sort whatever the
    number of rows per key. Null keys and times match nothing.
    """
    held = F.struct(*[F.col(v) for v in values])
    a = left.select(F.struct(*left.columns).alias("_left"), *keys, F.col(time).alias("_t"), F.lit(1).alias("_side"))
    b = right.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), held.alias("_right"))
    both = a.withColumn("_tie", F.lit(None).cast(b.schema["_tie"].dataType)).unionByName(b, allowMissingColumns=True)
    last = F.last("_right", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0))
    known = F.col("_t").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    found = both.withColumn("_found", F.when(known, last)).where("_side = 1")
    return found.select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])
