"""Operator 4: mixing sources to target weights.

Tokens are summed per source, targets are dealt out by weight with a ceiling per
source, and each document is taken floor(rate) times plus one copy more with
the fraction of the rate as probability, drawn from a seeded hash.

Defined cases: a null text has size 0 and is taken for nothing; a null source is a
source of its own and the last in order; a null doc_id draws like the text "null";
repeated rows draw alike; a draw equal to the fraction takes no copy, and of equally near
trials the first is taken; texts of any length are counted whole, as one row; an empty table gives an
empty result; other columns of the input are neither read nor can they clash. All arithmetic before the shares is in
whole numbers, so reruns and other partitionings agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut, free_name

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Draws per source, of which the one nearest to its target is taken.
TRIALS = 16


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) per document -> (source, source_size, target) per source.

    The ceiling of a source is `most` times its size. Sources are ordered by the
    level at which a common factor on the weights would fill them; a source is
    full if all ceilings up to it plus its level on all other weights stay within
    the whole. What is left goes to the others by weight. That is the fixed point
    of resharing excess, without a loop. The windows run over one pre-aggregated
    row per source, in one task: sources are meant to be collections, up to some millions,
    and not single pages.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * most)
    per = per.withColumn("level", F.col("ceiling") / F.col("weight"))
    every = W.partitionBy()
    so_far = W.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    per = per.select(
        "source", "source_size", "weight", "ceiling", "level",
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("whole"),
        F.sum("ceiling").over(so_far).alias("filled"),
        (F.sum("weight").over(every) - F.sum("weight").over(so_far)).alias("open_weight"),
    )
    full = F.col("filled") + F.col("level") * F.col("open_weight") <= F.col("whole")
    per = per.withColumn("full", full)
    left = F.col("whole") - F.sum(F.when(F.col("full"), F.col("ceiling")).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise(left * F.col("weight") / open_w)
    return per.select("source", "source_size", target.alias("target"))


def draw(key: Column, trial: Column | int, seed: str = SEED) -> Column:
    """A number in [0, 1) from a document's id; trials 0 to TRIALS - 1 are independent.
    One digest gives four of them."""
    trial = F.lit(trial) if isinstance(trial, int) else trial
    name = F.concat(F.lit(f"{seed}-"), F.floor(trial / 4).cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null")))
    digits = F.substring(F.md5(name), trial % 4 * 8 + 1, F.lit(8))
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(4294967296.0)


def copies_of(key: Column, rate: Column, trial: Column | int, seed: str = SEED) -> Column:
    """floor(rate), and one more where the document's draw is below the rest."""
    return F.floor(rate) + F.when(draw(key, trial, seed) < rate - F.floor(rate), 1).otherwise(0)


def source_key(source: Column) -> Column:
    """Sources as keys that nulls have too."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_rates(rows: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """(key, source_size, target, rate, trial) per source of `rows` (doc_id, source, size).

    Of TRIALS draws the source takes the one whose words come nearest to its target:
    every document still has its Bernoulli copy of a hash-seeded draw, and the total of a
    source with few or very unequal documents strays less. One pass of sums.
    """
    per = source_targets(rows.select("source", "size"), **targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = cut(per.select(source_key(F.col("source")).alias("key"), "source_size", "target", rate.alias("rate")), "targets")
    rated = rows.select("doc_id", "size", source_key(F.col("source")).alias("of")).join(per, F.col("of") == F.col("key"))
    sums = [F.sum(F.col("size") * copies_of(F.col("doc_id"), F.col("rate"), k, seed)).alias(f"t{k}") for k in range(TRIALS)]
    tried = rated.groupBy("of").agg(F.first("target").alias("goal"), *sums)
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("goal")).alias("off"), F.lit(k).alias("k")) for k in range(TRIALS)]))["k"]
    return cut(per.join(tried.select("of", nearest.alias("trial")), F.col("of") == F.col("key")).drop("of"), "rates")


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size), written once: the sums and the decisions read this and not the texts."""
    return cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **targets) -> DataFrame:
    """One row per document: its id, size, source's size and target, copies and words
    taken. A source with half of all rows is split by the engine's skew join, as its
    other side has one row per source."""
    rows = sizes_of(docs, id_col, text_col, source_col)
    rates = source_rates(rows, seed, **targets)
    out = rows.withColumn("of", source_key(F.col("source"))).join(rates, F.col("of") == F.col("key"))
    out = out.withColumn("copies", copies_of(F.col("doc_id"), F.col("rate"), F.col("trial"), seed).cast("bigint"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **targets) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, all columns kept."""
    rates = source_rates(sizes_of(docs, id_col, text_col, source_col), seed, **targets)
    of, rate, trial, count, again = (free_name(docs, f"mix_{n}") for n in ("of", "rate", "trial", "count", "again"))
    rates = rates.select(F.col("key").alias(of), F.col("rate").alias(rate), F.col("trial").alias(trial))
    taken = docs.join(rates, source_key(docs[source_col]) == rates[of])
    taken = taken.withColumn(count, copies_of(docs[id_col], F.col(rate), F.col(trial), seed).cast("int"))
    out = taken.where(F.col(count) > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(count))))
    return out.select(*[docs[c] for c in docs.columns])
