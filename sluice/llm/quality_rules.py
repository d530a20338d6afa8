"""Operator 6: quality rules with cross-document line frequency, DataFrame functions only.

Base rules look at one text. Then each line is normalised (words lower-cased, joined by one
space) and hashed, the documents holding it are counted per host, lines in more
documents of a host than the limit are taken out, and a document that loses more than
`depleted` of its words that way is rejected.

The texts are read once: the first pass writes the figures of each row and its lines'
hashes and word counts, and all else reads that table. A line counts once per row, so its
documents are counted by a plain sum that combines before the shuffle; a line or host with a
third of all rows is split by the engine's skew join, as the other side has one row.

Defined cases: null and blank texts have no words and fail the base; a null host is a host
of its own; a null doc_id stays null; repeated rows count and are answered each; a line in just
`limit_docs` documents stays, as does a text that loses just the share `depleted`; texts of any length are
read whole, as one row; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, free_name

#: A line is common in more documents of a host than this, however large the host is.
LIMIT_DOCS = 10
#: Share of a document's words in common lines above which it is rejected.
DEPLETED = 0.7


def covered(positions: Column, width: int) -> Column:
    """How many places windows of `width` at these sorted positions cover."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"))
    return F.aggregate(positions, start, step, lambda a: a["n"])


def line_hash(words: Column) -> Column:
    """Hash of a line's words, lower-cased and joined by one space."""
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def row_key(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> Column:
    """Equal rows, which share a verdict, have equal keys."""
    return F.xxhash64(docs[id_col], docs[text_col], docs[host_col], docs[id_col].isNull(), docs[text_col].isNull(), docs[host_col].isNull())


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per document: the base figures, and `lines` as (hash, words).

    Each step is a projection of its own, so that what several expressions or a lambda
    use is computed once per row.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), row_key(docs, id_col, text_col, host_col).alias("key"), F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    raw = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.withColumn("raw", raw).withColumn("split", F.transform("raw", lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))
    rows = rows.select(
        "row", "key", "doc_id", "host", F.flatten("split").alias("words"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("bigint").alias("n_dup_lines"),
        F.transform("split", lambda w: F.struct(line_hash(w).alias("h"), F.size(w).alias("n"))).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    rows = rows.select(
        "row", "key", "doc_id", "host", "n_symbols", "n_dup_lines", "lines", n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), windows.alias("windows"),
    )
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    same = lambda e, i: (F.get("sorted", i - 1)["h"] == e["h"]) | (F.get("sorted", i + 1)["h"] == e["h"])
    places = F.transform(F.filter("sorted", lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["p"])
    rows = rows.withColumn("places", F.sort_array(places))
    return rows.select(
        "row", "key", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("places").isNotNull(), covered(F.col("places"), 3)).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"), "lines",
    )


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, limit_docs: int, depleted: float) -> tuple[DataFrame, DataFrame]:
    """(figures and verdict of every row, the common lines of each row as (row, key, h, n))."""
    rows = cut(measured(docs, id_col, text_col, host_col), "measured")
    host = F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("n"))
    lines = rows.select("row", "key", host.alias("k"), F.explode("lines").alias("l")).select("row", "key", "k", "l.h", "l.n")
    once = rows.select(host.alias("k"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    common = once.groupBy("k", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > limit_docs).select("k", "h")
    common = cut(common, "common")  # read anew, so that a hot line's join can be split
    removed = lines.join(common, ["k", "h"])
    lost = removed.groupBy("row").agg(F.sum("n").cast("bigint").alias("common_words"))
    out = rows.drop("lines").join(lost, "row", "left").withColumn("common_words", F.coalesce("common_words", F.lit(0).cast("bigint")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~base & (F.col("common_words") <= F.col("n_words") * depleted)
    return out.withColumn("base_failed", base).withColumn("kept", kept), removed


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit_docs: int = LIMIT_DOCS, depleted: float = DEPLETED) -> DataFrame:
    """The base figures, `base_failed`, `common_words` (in lines above the limit) and `kept` of every row."""
    found, _ = judged(docs, id_col, text_col, host_col, limit_docs, depleted)
    return found.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "common_words", "base_failed", "kept")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit_docs: int = LIMIT_DOCS, depleted: float = DEPLETED) -> DataFrame:
    """The rows of `docs` that are kept, their texts without the common lines; all columns stay."""
    found, removed = judged(docs, id_col, text_col, host_col, limit_docs, depleted)
    of, gone = free_name(docs, "rule_key"), free_name(docs, "rule_lines")
    lines = removed.groupBy("key").agg(F.collect_set("h").alias("gone"))  # at most a row's own lines
    keys = found.where("kept").select("key").distinct().join(lines, "key", "left")
    keys = cut(keys.select(F.col("key").alias(of), F.coalesce("gone", F.array().cast("array<bigint>")).alias(gone)), "kept")
    out = docs.withColumn(f"{of}_", row_key(docs, id_col, text_col, host_col)).join(keys, F.col(f"{of}_") == F.col(of))
    stays = lambda x: ~F.array_contains(F.col(gone), line_hash(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))
    text = F.array_join(F.filter(F.split(text_col, "\n", -1), stays), "\n")
    return out.select(*[text.alias(c) if c == text_col else out[c] for c in docs.columns])
