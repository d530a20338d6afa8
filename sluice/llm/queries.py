"""The queries over the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html, mixing, packing, quality_mil, quality_rules, simhash, token_counts, topk, toxicity
from .common import table, tokenizer_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", "fingerprint", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that holds the template's own strings."""
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_chat(rows.unionAll(more)))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    found = quality_rules.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_mil.classify(docs, quality_mil.fit(docs, labels))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.classify(docs, toxicity.fit(docs, labels))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, packed into sequences."""
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM e q JOIN e x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, doc_id, source,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln
  FROM d),
x AS (
  SELECT r, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c, unnest(range(len(w))) AS i FROM m),
y AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM x WHERE c IS NOT NULL),
z AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM y WHERE n > 1) GROUP BY r),
l AS (
  SELECT r, source, lower(array_to_string(w, ' ')) AS line, len(w) AS n
  FROM (SELECT r, source, regexp_extract_all(unnest(ln), '[^\\x20\\x09-\\x0D]+') AS w FROM m)),
f AS (
  SELECT source, line, count(DISTINCT r) AS docs FROM l GROUP BY source, line),
g AS (SELECT source, line FROM f WHERE docs > 10),
k AS (
  SELECT r, sum(n) AS lost FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source AND l.line = g.line GROUP BY r),
o AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(z.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost, 0) AS lost
  FROM m LEFT JOIN z ON m.r = z.r LEFT JOIN k ON m.r = k.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= n_words * 0.7::DOUBLE AS kept
FROM o
"""

OP4_SQL = """
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
             WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight
  FROM s),
l AS (SELECT *, source_size * 2 AS ceiling, (source_size * 2)::DOUBLE / weight AS level FROM w),
f AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS whole,
         (sum(ceiling) OVER p)::DOUBLE + level * (sum(weight) OVER () - sum(weight) OVER p) <= sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS filled
  FROM l WINDOW p AS (ORDER BY level, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN filled THEN ceiling::DOUBLE
              ELSE (whole - sum(CASE WHEN filled THEN ceiling ELSE 0 END) OVER ()::DOUBLE) * weight
                   / sum(CASE WHEN filled THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target
  FROM f),
r AS (
  SELECT doc_id, d.source, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-' || k // 4 || ':' || coalesce(doc_id::VARCHAR, 'null')), k % 4 * 8 + 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM r, range(16) x(k)),
o AS (SELECT source, k, abs(sum(size * copies)::DOUBLE - any_value(target)) AS off FROM c GROUP BY source, k),
b AS (SELECT source, k FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.k = b.k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_chat": op2_chat,
        "op3_html": op3_html,
        "op4_mixing": op4_mixing,
        "op5_topk": op5_topk,
        "op6_quality_rules": op6_quality_rules,
        "op7_token_counts": op7_token_counts,
        "op8_quality_mil": op8_quality_mil,
        "op9_packing": op9_packing,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op5_topk": OP5_SQL, "op6_quality_rules": OP6_SQL}
