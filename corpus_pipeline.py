"""The corpus pipeline: quality, toxicity, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
`documents`. A stage's result is written as Parquet and read again as the next one's
input, so every stage starts without lineage and survives lost executors. Once it is written,
the stage's input and the operators' intermediate tables are deleted, so the shared folder holds
two stages at most, and the last one when `run` has ended.

Each stage sets the session to hold few rows of Parquet at a time (`common.FEW_ROWS`), as a batch of 4,096 long texts
does not fit an executor. `run` puts back what was set; a stage called by itself leaves it, as its caller writes the result.

Defined cases: a null or empty text is scored as one empty passage, is a copy of every other text without words, is taken
as often as its source's rate says, and packs into the closing id alone. A null doc_id
is scored and packed, is no one's copy, and draws like the text "null". A null source is a source of its own.
Rows that share a doc_id count as one document: one of them stays after the near duplicates. Very long texts are read whole by
every stage. Of equal scores both stay or go; of copies the smallest doc_id stays. Columns beyond those of
`documents`, whatever their names, are kept up to the last stage. An empty table gives no rows; without labels of
both classes a classifier rejects nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import common, mixing, packing, quality_mil, simhash, toxicity
from sluice.llm.common import shared_dir, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents scoring below 0.3 go."""
    common.few_rows(spark)
    return quality_mil.keep_good(docs, quality_mil.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scoring 0.5 or more go."""
    common.few_rows(spark)
    return toxicity.keep_clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of documents whose 5-word shingles are similar by 0.8 or more the one of the smallest id stays."""
    common.few_rows(spark)
    return simhash.keep_one(docs, width=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it."""
    common.few_rows(spark)
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of token sequences."""
    common.few_rows(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packed)]

#: The classifiers, components and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/sluice-pipeline-{uuid.uuid4().hex}"
    last = None
    found = common.few_rows(spark)
    try:
        for name, stage in STAGES:
            before = common.cuts()
            path = f"{base}/{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            common.release(spark, before)
            if last:
                common.delete_folder(spark, last)
            docs, last = spark.read.parquet(path), path
    finally:
        common.settings(spark, found)
    return docs
