"""The query catalogue: each entry runs on Spark and has the same query as DuckDB SQL."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import host, scalar
from ..operators.asof import asof_join
from ..operators.sequence import Seq, member_count, nested
from ..session import Engine
from ..sources.tables import count_from_footers, read, read_table, write
from ..streaming.run import arrivals, drain, in_order, join_streams, over_stream, shared_folder, windowed

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query of the SQL surface; the oracle is the same text unless types or names differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for table in TABLES:
            if re.search(rf"\b{table}\b", text):
                engine.register(table, read_table(spark, sf_dir, table))
        return engine.sql(text)

    QUERIES[name] = run
    ORACLE[name] = oracle or text


def frame(name: str, oracle: str | None, *tables: str) -> Callable:
    """A query of the DataFrame surface: called with (spark, its tables)."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(spark, *[read_table(spark, sf_dir, t) for t in tables])
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def big(text: str) -> str:
    """Sums of whole numbers are 128-bit in DuckDB and 64-bit here."""
    return re.sub(r"\bsum\(([^()]*(?:\([^()]*\)[^()]*)*)\)(?! OVER| FILTER)", r"CAST(sum(\1) AS BIGINT)", text)


# --- scans, projection, filters -------------------------------------------------------

sql("flagship", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS q, round(avg(l_extendedprice), 4) AS p FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus")
sql("scan_all", "SELECT * FROM nation")
sql("scan_events", "SELECT event_id, user_id, event_type, value FROM events")
sql("project_cols", "SELECT l_orderkey, l_quantity FROM lineitem")
sql("project_expr", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) + 1 AS a, CAST(2 AS BIGINT) * o_custkey - o_orderkey AS b FROM orders")
sql("project_literal", "SELECT n_nationkey, 7 AS seven, CAST(0.5 AS DOUBLE) AS half, 'tag' AS tag, CAST(NULL AS BIGINT) AS nothing FROM nation")
sql("project_string", "SELECT event_id, nullif(event_type, 'error') AS kind FROM events")
sql("project_bool", "SELECT l_orderkey, l_linenumber, l_quantity > 25 AS large FROM lineitem")
sql("derived_table", "SELECT x.k, x.v FROM (SELECT l_orderkey AS k, l_partkey AS v FROM lineitem WHERE l_quantity > 45) x WHERE x.v > 100")
sql("cte_source", "WITH x AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) SELECT c_custkey, c_acctbal FROM x WHERE c_acctbal < 500")
sql("filter_basic", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30")
sql("filter_null_drop", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_linenumber, 3) > 2")
sql("filter_ne", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
sql("filter_le_ge", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10 AND l_linenumber >= 3")
sql("filter_and", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_linenumber = 2 AND l_returnflag = 'R'")
sql("filter_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_linenumber, 3) = 1 OR l_quantity > 40")
sql("filter_not_null", "SELECT l_orderkey, nullif(l_linenumber, 3) AS k FROM lineitem WHERE nullif(l_linenumber, 3) IS NULL OR NOT (l_linenumber IN (1, 2) OR l_quantity BETWEEN 5 AND 20)")
sql("filter_like_case", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part WHERE p_name LIKE '%1%'")
sql("arith_int", "SELECT l_orderkey + l_partkey AS a, l_orderkey - l_suppkey AS b, l_partkey * CAST(l_linenumber AS BIGINT) AS c FROM lineitem")
sql("arith_float", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 6) AS v FROM lineitem")
sql("arith_mixed", "SELECT l_orderkey, l_linenumber, l_linenumber * l_quantity AS v FROM lineitem")
sql("octet_length", "SELECT doc_id, octet_length(text) AS b FROM documents", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS b FROM documents")
sql("str_eq_literal", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' OR o_orderstatus = 'O'")
sql("str_eq_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END = l_linestatus")
sql("str_compare", "SELECT c_custkey FROM customer WHERE c_mktsegment < 'C' AND c_name > 'Customer#000000100'")

# --- aggregation ----------------------------------------------------------------------

sql("agg_scalar", t := "SELECT count(*) AS n, sum(l_orderkey) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_linenumber) AS mean FROM lineitem", big(t))
sql("agg_empty", t := "SELECT count(*) AS n, count(l_linenumber) AS c, min(l_linenumber) AS m, sum(l_orderkey) AS s, avg(l_quantity) AS a FROM lineitem WHERE l_quantity < 0", big(t))
sql("count_star", "SELECT count(*) AS n FROM lineitem")
sql("count_col", "SELECT count(nullif(l_linenumber, 3)) AS n FROM lineitem")
sql("sum_int", t := "SELECT sum(nullif(l_linenumber, 3)) AS s FROM lineitem", big(t))
sql("sum_float", "SELECT round(sum(l_discount), 4) AS s FROM lineitem")
sql("min_max", "SELECT min(nullif(l_linenumber, 1)) AS lo, max(l_partkey) AS hi, min(l_extendedprice) AS flo, max(l_extendedprice) AS fhi, min(l_returnflag) AS slo, max(l_linestatus) AS shi FROM lineitem")
sql("avg_int", "SELECT avg(nullif(l_linenumber, 3)) AS a FROM lineitem")
sql("avg_float", "SELECT round(avg(l_extendedprice), 4) AS a FROM lineitem")
sql("sum_expr", t := "SELECT sum(l_partkey + 1) AS s, sum(l_orderkey * l_linenumber) AS p FROM lineitem", big(t))
sql("group_int", t := "SELECT l_linenumber AS k, count(*) AS n, sum(l_orderkey) AS s, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY l_linenumber", big(t))
sql("group_float", "SELECT l_discount + 0.0 AS k, count(*) AS n FROM lineitem GROUP BY l_discount + 0.0")
sql("group_string", t := "SELECT c_mktsegment AS k, count(*) AS n, sum(c_custkey) AS s FROM customer GROUP BY c_mktsegment", big(t))
sql("group_null_key", t := "SELECT nullif(l_linenumber, 3) AS k, sum(l_orderkey) AS s, count(nullif(l_linenumber, 3)) AS n FROM lineitem GROUP BY nullif(l_linenumber, 3)", big(t))
sql("group_multi", t := "SELECT l_linenumber AS a, l_suppkey AS b, count(*) AS n, sum(l_orderkey) AS s FROM lineitem GROUP BY l_linenumber, l_suppkey", big(t))
sql("group_multi_string", t := "SELECT o_orderstatus AS a, o_orderpriority AS b, sum(o_custkey) AS s, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", big(t))
sql("group_multi_null", t := "SELECT nullif(event_type, 'error') AS a, nullif(user_id % 5, 2) AS b, sum(event_id) AS s FROM events GROUP BY nullif(event_type, 'error'), nullif(user_id % 5, 2)", big(t))
sql("group_expr", "SELECT octet_length(c_mktsegment) AS k, count(*) AS n FROM customer GROUP BY octet_length(c_mktsegment)", "SELECT CAST(strlen(c_mktsegment) AS INTEGER) AS k, count(*) AS n FROM customer GROUP BY 1")
sql("having", t := "SELECT l_suppkey AS k, sum(l_linenumber) AS s FROM lineitem GROUP BY l_suppkey HAVING count(*) > 30", big(t))
sql("having_alias", t := "SELECT l_partkey AS k, sum(l_linenumber) AS s FROM lineitem GROUP BY l_partkey HAVING s > 100", big(t))
sql("agg_post_expr", "SELECT l_linenumber AS k, sum(l_partkey) + 2 AS s, max(l_partkey) - min(l_partkey) AS spread FROM lineitem GROUP BY l_linenumber", "SELECT l_linenumber AS k, CAST(sum(l_partkey) + 2 AS BIGINT) AS s, max(l_partkey) - min(l_partkey) AS spread FROM lineitem GROUP BY l_linenumber")
sql("agg_of_group", t := "SELECT count(*) AS n, sum(s) AS total, max(s) AS top FROM (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey) x", t.replace("sum(s)", "CAST(sum(s) AS BIGINT)"))
sql("count_distinct", "SELECT l_returnflag AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_filter", "SELECT count(*) FILTER (WHERE l_quantity > 25) AS n, CAST(sum(l_orderkey) FILTER (WHERE l_linenumber = 1) AS BIGINT) AS s FROM lineitem")
sql("null_skip_sum", t := "SELECT sum(CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END) AS s, count(*) - count(CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END) AS nulls FROM events", t.replace("sum(CASE", "CAST(sum(CASE").replace("END) AS s", "END) AS BIGINT) AS s"))
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("cube_rollup", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")

# --- joins ----------------------------------------------------------------------------

sql("join_inner", "SELECT o_orderkey, o_custkey, l_orderkey, l_partkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
sql("join_build_filter", "SELECT o_orderkey, l_partkey FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) o JOIN lineitem ON o_orderkey = l_orderkey")
sql("join_dups", "SELECT l.l_orderkey, l.l_linenumber, m.l_linenumber AS other FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey")
sql("join_null_keys", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON nullif(c_custkey, 7) = nullif(o_custkey, 7)")
sql("join_negative_keys", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON 50 - c_custkey = 50 - o_custkey")
sql("join_empty", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = -o_custkey - 1")
sql("join_where", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000 AND o_orderstatus = 'F'")
sql("join_group", t := "SELECT c_mktsegment AS k, count(*) AS n, sum(o_orderkey) AS s FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", big(t))
sql("join_of_group", "SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
sql("self_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
sql("join_chain", "SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name, c_mktsegment")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
sql("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey FROM supplier) s FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey > 50) c ON s_suppkey = c_custkey")
sql("join_semi_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS pending FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("join_composite", "SELECT l.l_orderkey, l.l_partkey, l.l_suppkey FROM lineitem l JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity > 49) x ON l.l_partkey = x.p AND l.l_suppkey = x.s")
sql("join_string_key", "SELECT e.event_id, k.n FROM events e JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) k ON e.event_type = k.event_type")

# --- what the SQL surface has beyond that -----------------------------------------------

sql("window_rank", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders", "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders")
sql("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("set_ops", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey AS k FROM region")

sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_range", t := "SELECT b.band, count(*) AS n, sum(o_orderkey) AS s FROM orders JOIN (SELECT * FROM (VALUES (0, 0, 50000), (1, 50000, 150000), (2, 100000, 250000), (3, 250000, 1000000)) v(band, lo, hi)) b ON o_totalprice >= b.lo AND o_totalprice < b.hi GROUP BY b.band", big(t))
frame("join_asof", "SELECT e.event_id, e.user_id, p.event_id AS bought, p.value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts", "events")(
    lambda spark, e: asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select(F.col("event_id").alias("bought"), "user_id", "ts", "value"), ["user_id"], "ts", ["bought", "value"], "bought").drop("ts")
)
sql("agg_stats", "SELECT l_returnflag AS k, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 9) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, median(l_quantity) AS mid FROM lineitem GROUP BY l_returnflag")
sql("grouping_sets", "SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
sql("rollup", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("scalar_subquery", "SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS dear, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")
sql("values_rows", "SELECT v.k, v.name, count(c_custkey) AS n FROM (VALUES (0, 'none'), (1, 'one'), (NULL, 'null')) AS v(k, name) LEFT JOIN customer ON c_nationkey = v.k GROUP BY v.k, v.name")
sql("sql_bits", "SELECT o_orderkey, o_custkey % 7 AS rem, o_orderkey / 4 AS quot, o_orderkey & 12 AS both, o_orderkey | 5 AS either, o_orderkey << 2 AS up, o_orderkey >> 1 AS down FROM orders")
sql("fn_string", "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, substr(c_name, 10, 4) AS part, replace(c_name, '#', '-') AS swapped, concat(c_mktsegment, ':', c_name) AS both, trim(concat(' ', c_mktsegment, ' ')) AS bare, length(c_name) AS n, left(c_name, 3) AS head, reverse(c_mktsegment) AS back, lpad(c_mktsegment, 12, '.') AS padded FROM customer", "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, substr(c_name, 10, 4) AS part, replace(c_name, '#', '-') AS swapped, concat(c_mktsegment, ':', c_name) AS both, trim(concat(' ', c_mktsegment, ' ')) AS bare, CAST(length(c_name) AS INTEGER) AS n, left(c_name, 3) AS head, reverse(c_mktsegment) AS back, lpad(c_mktsegment, 12, '.') AS padded FROM customer")
sql("fn_math", "SELECT c_custkey, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 6) AS r, CAST(floor(c_acctbal) AS BIGINT) AS lo, CAST(ceil(c_acctbal) AS BIGINT) AS hi, round(ln(abs(c_acctbal) + 1), 6) AS l, round(pow(c_nationkey, 2), 3) AS p, CAST(sign(c_acctbal) AS INTEGER) AS s, round(exp(c_nationkey / 10.0), 6) AS e FROM customer")
sql("fn_date", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS at, CAST(ts AS DATE) AS date, ts + INTERVAL 1 DAY AS next FROM events".replace("CAST(date_trunc('hour', ts) AS TIMESTAMP)", "CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)"), "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, date_trunc('hour', ts) AS at, CAST(ts AS DATE) AS date, ts + INTERVAL 1 DAY AS next FROM events")
frame("fn_array", "SELECT vec_id, list_max(embedding) AS top, list_min(embedding) AS least, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS up, list_contains(embedding, embedding[3]) AS has, list_sort(embedding)[1] AS first FROM embeddings", "embeddings")(
    lambda spark, e: e.select("vec_id", F.array_max("embedding").alias("top"), F.array_min("embedding").alias("least"), F.size(F.filter("embedding", lambda x: x > 0)).alias("up"), F.array_contains("embedding", F.get("embedding", F.lit(2))).alias("has"), F.get(F.array_sort("embedding"), F.lit(0)).alias("first"))
)


@frame("source_formats", "SELECT n_nationkey, n_name, n_regionkey, k AS format FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(k)", "nation")
def _(spark, nation):
    """A table written and read again in several formats."""
    folder, found = shared_folder(spark), None
    for kind in ("csv", "json", "orc", "parquet"):
        write(nation, f"{folder}/{kind}", kind)
        back = read(spark, f"{folder}/{kind}", kind, nation.schema).withColumn("format", F.lit(kind))
        found = back if found is None else found.unionByName(back)
    return found.select("n_nationkey", "n_name", "n_regionkey", "format")


# --- streams ----------------------------------------------------------------------------


@frame("stream_project", "SELECT event_id, user_id + 1 AS u FROM events", "events")
def _(spark, events):
    return over_stream(spark, events, lambda s: s.select("event_id", (F.col("user_id") + 1).alias("u")))


@frame("stream_filter", "SELECT event_id, event_type FROM events WHERE value > 50 AND event_type <> 'error'", "events")
def _(spark, events):
    return over_stream(spark, events, lambda s: s.where("value > 50 AND event_type <> 'error'").select("event_id", "event_type"))


@frame("stream_agg", "SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS s, min(event_id) AS lo, max(event_id) AS hi FROM events", "events")
def _(spark, events):
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("s"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")]
    return over_stream(spark, events, lambda s: s.agg(*aggs), "complete")


@frame("stream_group", "SELECT event_type AS k, count(*) AS n, count(nullif(user_id % 4, 1)) AS c FROM events GROUP BY event_type", "events")
def _(spark, events):
    return over_stream(spark, events, lambda s: s.groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count(F.expr("nullif(user_id % 4, 1)")).alias("c")), "complete")


@frame("stream_multi", "SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey", "events", "customer")
def _(spark, events, customer):
    return over_stream(spark, events, lambda s: s.join(customer, s.user_id == customer.c_custkey).select("event_id", "c_mktsegment"))


@frame("stream_windowed", "SELECT event_type AS k, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2", "events")
def _(spark, events):
    w = F.window("t", "1 day")
    shape = lambda s: s.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 hour").groupBy(F.col("event_type").alias("k"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return over_stream(spark, events, shape, "complete").select("k", F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("t", F.col("ts").cast("timestamp"))


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@frame("stream_late", f"SELECT event_type AS k, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING day + INTERVAL 1 DAY <= {_CLOSED}", "events")
def _(spark, events):
    """Tumbling windows, appended once the watermark has passed them; the first day comes a second time at the end and is dropped as late."""
    rows = _timed(events)
    first = rows.agg(F.min("t")).first()[0]
    again = rows.where(F.col("t") < F.lit(first) + F.expr("INTERVAL 1 HOUR"))
    stream = arrivals(spark, [*in_order(rows, "t"), again])
    found = windowed(stream.withColumnRenamed("event_type", "k"), "t", ["k"], "1 day", late="1 hour", n=F.count(F.lit(1)))
    return drain(found).select("k", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@frame("stream_sliding", f"SELECT start, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS s FROM (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) - k * INTERVAL 1 DAY AS start FROM events, range(2) r(k)) GROUP BY start HAVING start + INTERVAL 2 DAY <= {_CLOSED}", "events")
def _(spark, events):
    found = windowed(arrivals(spark, in_order(_timed(events), "t")), "t", [], "2 days", "1 day", late="1 hour", n=F.count(F.lit(1)), s=F.sum("user_id"))
    return drain(found).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "s")


@frame("stream_join", "SELECT a.event_id AS clicked, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'", "events")
def _(spark, events):
    """Both sides arrive in batches."""
    rows = _timed(events)
    side = lambda kind, id, t: arrivals(spark, [b.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(id), F.col("t").alias(t)) for b in in_order(rows, "t")])
    return drain(join_streams(side("click", "clicked", "at"), side("purchase", "bought", "later"), ["user_id"], "at", "later", "6 hours").select("clicked", "bought"))


# --- host functions -----------------------------------------------------------------------


@frame("udf_square_quad", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) * l_linenumber AS square, CAST(l_linenumber AS BIGINT) * l_linenumber * l_linenumber * l_linenumber AS quad FROM lineitem", "lineitem")
def _(spark, lineitem):
    square = lambda c: scalar.mul(c, c)  # noqa: E731  a staged function: one fused expression
    quad = host.compose(square, square)
    n = F.col("l_linenumber")
    return lineitem.select("l_orderkey", "l_linenumber", square(n).alias("square"), quad(n).alias("quad"))


@frame("udf_host", "SELECT event_id, CAST(floor(value) AS BIGINT) * 3 + user_id AS v FROM events", "events")
def _(spark, events):
    host.register(spark, "host_mix", lambda a, b: a // 1 * 3 + b, "bigint")
    return events.select("event_id", F.call_udf("host_mix", F.floor("value").cast("bigint"), F.col("user_id")).alias("v"))


@frame("udf_sql", "SELECT event_id, user_id * user_id + 1 AS v FROM events", "events")
def _(spark, events):
    spark.sql(host.define("square_plus_one", "x BIGINT", "BIGINT", "x * x + 1"))
    return events.select("event_id", F.expr("square_plus_one(user_id)").alias("v"))


@frame("udtf_host", "SELECT n_nationkey, i FROM (SELECT n_nationkey, unnest(range(0, n_regionkey + 1)) AS i FROM nation)", "nation")
def _(spark, nation):
    host.table_function(spark, "host_count_up", "i bigint", lambda n: ((i,) for i in range(n + 1)))
    nation.createOrReplaceTempView("host_nation")
    return spark.sql("SELECT n_nationkey, i FROM host_nation, LATERAL host_count_up(n_regionkey)")


@frame("udf_slice", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor(x * 1024) AS BIGINT))) AS BIGINT) AS s FROM embeddings", "embeddings")
def _(spark, embeddings):
    whole = F.transform("embedding", lambda x: F.floor(x * F.lit(1024).cast("float")))
    return embeddings.select("vec_id", host.length_of("embedding").alias("n"), host.sum_slice(whole).alias("s"))


@frame("opaque_iterator", "SELECT event_id, user_id * 2 AS v FROM events WHERE user_id % 2 = 0", "events")
def _(spark, events):
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b in batches:
            kept = b.filter(pc.equal(pc.bit_wise_and(b["user_id"], 1), 0))
            yield pa.RecordBatch.from_arrays([kept["event_id"], pc.multiply(kept["user_id"], 2)], ["event_id", "v"])

    return host.map_batches(events.select("event_id", "user_id"), run, "event_id long, v long")


# --- scalar operators ---------------------------------------------------------------------

_M = "(l_orderkey % 19 - 9)"
QUERIES["scalar_int"] = lambda spark, d: read_table(spark, d, "lineitem").withColumn("a", F.col("l_orderkey") % 19 - 9).select(
    "l_orderkey", "l_linenumber",
    scalar.int_div(F.col("a"), F.col("l_linenumber")).alias("q"), scalar.rem(F.col("a"), F.col("l_linenumber")).alias("r"),
    F.col("a").bitwiseAND(6).alias("both"), F.col("a").bitwiseOR(5).alias("either"), F.col("a").bitwiseXOR(3).alias("odd"),
    F.shiftleft("l_orderkey", 3).alias("up"), F.shiftright("a", 1).alias("down"),
)
ORACLE["scalar_int"] = f"SELECT l_orderkey, l_linenumber, {_M} // l_linenumber AS q, {_M} % l_linenumber AS r, {_M} & 6 AS both, {_M} | 5 AS either, xor({_M}, 3) AS odd, l_orderkey * 8 AS up, CAST(floor({_M} / 2.0) AS BIGINT) AS down FROM lineitem"

sql("scalar_select", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_partkey ELSE l_suppkey END AS chosen, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, coalesce(nullif(l_linenumber, 2), -1) AS got, nullif(l_linenumber, 2) IS NOT NULL AS some, CASE WHEN l_linenumber > 3 THEN l_partkey END AS then_some, NOT (l_quantity > 25) AS inverse FROM lineitem")
sql("scalar_casts", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS f, CAST(l_quantity AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS w FROM lineitem")


@frame("scalar_struct", "SELECT n_nationkey, n_regionkey + 10 AS a, n_name AS b FROM nation", "nation")
def _(spark, nation):
    s = nation.select("n_nationkey", F.struct(F.col("n_regionkey").alias("a"), F.struct(F.col("n_name").alias("b")).alias("inner")).alias("s"))
    s = s.withColumn("s", F.col("s").withField("a", F.col("s.a") + 10))
    return s.select("n_nationkey", "s.a", "s.inner.b")


@frame("scalar_slice", "SELECT vec_id, len(embedding) AS n, embedding[3] AS third, coalesce(embedding[999], CAST(-1 AS FLOAT)) AS beyond, embedding[2] AS swapped, (embedding[5:7])[3] AS part FROM embeddings", "embeddings")
def _(spark, embeddings):
    e = F.col("embedding")
    return embeddings.select("vec_id", F.size(e).cast("bigint").alias("n"), F.get(e, 2).alias("third"), scalar.get_or(e, 998, F.lit(-1).cast("float")).alias("beyond"), F.get(scalar.swap(e, 0, 1), 0).alias("swapped"), F.get(scalar.sub_slice(e, 4, 7), 2).alias("part"))


#: The discounts of the tables and the whole numbers of the same 64 bits.
_BITS = ", ".join(f"({k} / 100.0::DOUBLE, {struct.unpack('<q', struct.pack('<d', k / 100))[0]})" for k in range(101))


@frame("scalar_bits", f"SELECT l_orderkey, l_linenumber, l_discount AS same, bits FROM lineitem LEFT JOIN (VALUES {_BITS}) t(d, bits) ON l_discount = d", "lineitem")
def _(spark, lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", scalar.bits_float(scalar.float_bits("l_discount")).alias("same"), scalar.float_bits("l_discount").alias("bits"))


# --- ordered sequences: events by event_id ------------------------------------------------

_SEQ = ("events",)


def _seq(events: DataFrame, item: str = "user_id") -> Seq:
    return Seq.of(events, "event_id", item)


@frame("iter_range", "SELECT CAST(i AS BIGINT) AS item FROM range(1, 1000, 3) t(i)")
def _(spark):
    return Seq.range(spark, 1, 1000, 3).df.select("item")


frame("iter_map_filter_sum", "SELECT CAST(coalesce(sum(user_id * 2), 0) AS BIGINT) AS sum FROM events WHERE user_id % 3 = 0", *_SEQ)(
    lambda spark, e: _seq(e).filter(lambda x: x % 3 == 0).map(lambda x: x * 2).sum()
)
frame("iter_filter_map", "SELECT event_id AS ord, user_id + 1 AS item FROM events WHERE user_id > 20", *_SEQ)(
    lambda spark, e: _seq(e).filter_map(lambda x: scalar.then_some(x > 20, x + 1)).df
)
frame("iter_scan", "SELECT event_id AS ord, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS item FROM events", *_SEQ)(
    lambda spark, e: _seq(e).scan("sum").df
)
frame("iter_scan_max", "SELECT event_id AS ord, max(user_id) OVER (ORDER BY event_id) AS item FROM events", *_SEQ)(lambda spark, e: _seq(e).scan("max").df)
_FIRST = "(SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE NOT user_id <> 7)"
frame("iter_take_while", f"SELECT event_id AS ord, user_id AS item FROM events WHERE event_id < {_FIRST}", *_SEQ)(
    lambda spark, e: _seq(e).take_while(lambda x: x != 7).df
)
frame("iter_skip_while", f"SELECT event_id AS ord, user_id AS item FROM events WHERE event_id >= {_FIRST}", *_SEQ)(
    lambda spark, e: _seq(e).skip_while(lambda x: x != 7).df
)
frame("iter_zip_dot", "SELECT CAST(sum(a.user_id * o.o_custkey) AS BIGINT) AS sum FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) AS i FROM events) a JOIN (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) o ON a.i = o.i", "events", "orders")(
    lambda spark, e, o: _seq(e).zip(Seq.of(o, "o_orderkey", "o_custkey"), lambda a, b: a * b).sum()
)
frame("iter_enumerate", "SELECT o_orderkey AS ord, o_custkey AS item, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders", "orders")(
    lambda spark, o: Seq.of(o, "o_orderkey", "o_custkey").enumerate()
)
frame("iter_zip_nested", "SELECT a.i - 1 AS ord, CAST(a.user_id * o.o_custkey + c.c_nationkey AS BIGINT) AS item FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) AS i FROM events) a JOIN (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) o ON a.i = o.i JOIN (SELECT c_nationkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) c ON a.i = c.i", "events", "orders", "customer")(
    lambda spark, e, o, c: _seq(e).zip(Seq.of(o, "o_orderkey", "o_custkey"), lambda a, b: a * b).zip(Seq.of(c, "c_custkey", "c_nationkey"), lambda a, b: a + b).df
)
frame("iter_sum_empty", "SELECT CAST(0 AS BIGINT) AS sum", *_SEQ)(lambda spark, e: _seq(e).filter(lambda x: x < 0).sum())
frame("iter_count", "SELECT count(*) AS n FROM events WHERE user_id > 10", *_SEQ)(lambda spark, e: _seq(e).filter(lambda x: x > 10).count())
frame("iter_count_if", "SELECT count(*) FILTER (WHERE user_id % 2 = 0) AS n FROM events", *_SEQ)(lambda spark, e: _seq(e).count_if(lambda x: x % 2 == 0))
frame("iter_sum_if", "SELECT CAST(coalesce(sum(user_id) FILTER (WHERE user_id > 30), 0) AS BIGINT) AS sum FROM events", *_SEQ)(lambda spark, e: _seq(e).sum_if(lambda x: x > 30))
frame("iter_min", "SELECT min(user_id) AS min FROM events", *_SEQ)(lambda spark, e: _seq(e).min())
frame("iter_max", "SELECT max(user_id) AS max FROM events", *_SEQ)(lambda spark, e: _seq(e).max())
frame("iter_any", "SELECT coalesce(bool_or(user_id = 7), false) AS any FROM events", *_SEQ)(lambda spark, e: _seq(e).any(lambda x: x == 7))
frame("iter_all", "SELECT coalesce(bool_and(user_id >= 0), true) AS all FROM events".replace("AS all", 'AS "all"'), *_SEQ)(lambda spark, e: _seq(e).all(lambda x: x >= 0))
_POS = "SELECT coalesce(min(CASE WHEN user_id = {k} THEN rn END), count(*)) AS position FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events WHERE user_id > 3)"
frame("iter_position", _POS.format(k=7), *_SEQ)(lambda spark, e: _seq(e).filter(lambda x: x > 3).position(lambda x: x == 7))
frame("iter_position_absent", _POS.format(k=-1), *_SEQ)(lambda spark, e: _seq(e).filter(lambda x: x > 3).position(lambda x: x == -1))
frame("iter_find_map", "SELECT arg_min(user_id * 10, event_id) FILTER (WHERE user_id > 40) AS value, count(*) FILTER (WHERE user_id > 40) > 0 AS found FROM events", *_SEQ)(
    lambda spark, e: _seq(e).find_map(lambda x: scalar.then_some(x > 40, x * 10))
)
frame("iter_fold_stats", "SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS s, min(user_id) AS lo, max(user_id) AS hi, avg(user_id) AS mean FROM events WHERE user_id > 10", *_SEQ)(
    lambda spark, e: _seq(e).filter(lambda x: x > 10).fold_stats(n=F.count(F.lit(1)), s=F.sum("item"), lo=F.min("item"), hi=F.max("item"), mean=F.avg("item"))
)
frame("iter_last", "SELECT arg_max(user_id, event_id) AS last FROM events", *_SEQ)(lambda spark, e: _seq(e).last())
frame("iter_semi_count", "SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)", "orders", "events")(
    lambda spark, o, e: member_count(o, "o_custkey", e, "user_id")
)
frame("iter_nested_sum", "SELECT CAST(sum(l_partkey) AS BIGINT) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'", "orders", "lineitem")(
    lambda spark, o, l: nested(o.where("o_orderstatus = 'F'"), "o_orderkey", l, "l_orderkey").agg(F.sum("l_partkey").alias("s"))
)
frame("iter_scan_fold", "SELECT event_id AS ord, CAST(event_id * 0 + v AS BIGINT) AS item FROM (SELECT event_id, sum(user_id % 7) OVER (ORDER BY event_id) % 1000003 AS v FROM events)", *_SEQ)(
    lambda spark, e: _seq(e).scan_fold(F.lit(0).cast("bigint"), lambda s, x: (s + x % 7) % 1000003).df
)
frame("iter_window_product", "SELECT max(p) AS max FROM (SELECT CAST(product(user_id % 9 + 1) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS BIGINT) AS p, count(*) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM events) WHERE n = 4", *_SEQ)(
    lambda spark, e: _seq(e).window_fold(4, F.lit(1).cast("bigint"), lambda a, x: a * (x % 9 + 1)).max()
)

# --- programs over ranges ---------------------------------------------------------------

frame("program_multiples", "SELECT CAST(sum(i) AS BIGINT) AS sum FROM range(1, 1000) t(i) WHERE i % 3 = 0 OR i % 5 = 0")(
    lambda spark: Seq.range(spark, 1, 1000).sum_if(lambda x: (x % 3 == 0) | (x % 5 == 0))
)
sql("program_fibonacci", t := "WITH RECURSIVE f(a, b) AS (SELECT CAST(1 AS BIGINT), CAST(2 AS BIGINT) UNION ALL SELECT b, a + b FROM f WHERE b < 4000000) SELECT sum(a) AS s FROM f WHERE a % 2 = 0", big(t))
sql("program_square_difference", "SELECT CAST(sum(id) * sum(id) - sum(id * id) AS BIGINT) AS d FROM range(1, 101)", "SELECT CAST(sum(i) * sum(i) - sum(i * i) AS BIGINT) AS d FROM range(1, 101) t(i)")
frame("program_palindrome", "SELECT max(a * b) AS p FROM range(100, 1000) x(a), range(100, 1000) y(b) WHERE CAST(a * b AS VARCHAR) = reverse(CAST(a * b AS VARCHAR))")(
    lambda spark: spark.range(100, 1000).toDF("a").withColumn("b", F.explode(F.sequence(F.lit(100), F.lit(999)))).select((F.col("a") * F.col("b")).alias("p")).where(F.col("p").cast("string") == F.reverse(F.col("p").cast("string"))).agg(F.max("p").alias("p"))
)
frame("program_triplet", "SELECT a * b * (1000 - a - b) AS p FROM range(1, 500) x(a), range(1, 500) y(b) WHERE a < b AND a * a + b * b = (1000 - a - b) * (1000 - a - b)")(
    lambda spark: spark.range(1, 500).toDF("a").withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.lit(500)))).withColumn("c", 1000 - F.col("a") - F.col("b")).where("a * a + b * b = c * c").selectExpr("a * b * c AS p")
)
frame("program_primes", "SELECT CAST(sum(n) AS BIGINT) AS s, count(*) AS c, max(n) AS top FROM range(2, 2000000) t(n) WHERE NOT EXISTS (SELECT 1 FROM (SELECT d FROM range(2, 1415) v(d) WHERE NOT EXISTS (SELECT 1 FROM range(2, 38) w(e) WHERE e * e <= d AND d % e = 0)) u WHERE d * d <= n AND n % d = 0)")(
    lambda spark: spark.range(2, 2000000).where(~F.exists(F.sequence(F.lit(2), F.lit(1414)), lambda d: (d * d <= F.col("id")) & (F.col("id") % d == 0))).agg(F.sum("id").alias("s"), F.count("*").alias("c"), F.max("id").alias("top"))
)
sql("program_gcd", "WITH RECURSIVE g(a, b) AS (SELECT CAST(1071 AS BIGINT), CAST(462 AS BIGINT) UNION ALL SELECT b, a % b FROM g WHERE b > 0) SELECT max(CASE WHEN b = 0 THEN a END) AS gcd FROM g")
sql("program_collatz", "WITH RECURSIVE c(s, n, k) MAX RECURSION LEVEL 400 AS (SELECT id, id, 1 FROM range(1, 100) UNION ALL SELECT s, CASE WHEN n % 2 = 0 THEN n DIV 2 ELSE 3 * n + 1 END, k + 1 FROM c WHERE n > 1) SELECT s, max(k) AS k FROM c GROUP BY s", "WITH RECURSIVE c(s, n, k) AS (SELECT i, i, 1 FROM range(1, 100) t(i) UNION ALL SELECT s, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, k + 1 FROM c WHERE n > 1) SELECT s, max(k) AS k FROM c GROUP BY s")
frame("program_digit_factorials", "SELECT CAST(sum(i) AS BIGINT) AS s FROM range(10, 2540160) t(i) WHERE i = list_sum(list_transform(string_split(CAST(i AS VARCHAR), ''), lambda d: factorial(CAST(d AS INTEGER))))")(
    lambda spark: spark.range(10, 2540160).where(F.col("id") == F.aggregate(F.split(F.col("id").cast("string"), ""), F.lit(0).cast("bigint"), lambda a, d: a + F.factorial(d.cast("int")))).agg(F.sum("id").alias("s"))
)
frame("program_amicable", "WITH d AS (SELECT n, coalesce(CAST(sum(k) AS BIGINT), 0) AS s FROM range(2, 10000) t(n), range(1, 5000) u(k) WHERE k < n AND n % k = 0 GROUP BY n) SELECT CAST(sum(a.n) AS BIGINT) AS total FROM d a JOIN d b ON a.s = b.n AND b.s = a.n WHERE a.n <> b.n")(
    lambda spark: _amicable(spark)
)
frame("program_reverse", "SELECT -event_id AS ord, user_id AS item FROM events", *_SEQ)(lambda spark, e: _seq(e).reverse().df)
_TRIANGLE = "75|95 64|17 47 82|18 35 87 10|20 4 82 47 65|19 1 23 75 3 34|88 2 77 73 7 63 67|99 65 4 28 6 16 70 92|41 41 26 56 83 40 80 70 33|41 48 72 33 47 32 37 16 94 29|53 71 44 65 25 43 91 52 97 51 14|70 11 33 28 77 73 17 78 39 68 17 57|91 71 52 38 17 14 91 43 58 50 27 29 48|63 66 4 68 89 53 67 30 73 16 69 87 40 31|4 62 98 27 23 9 70 98 73 93 38 53 60 4 23"
_ROWS = ", ".join(f"({k}, [{row.replace(' ', ', ')}])" for k, row in enumerate(_TRIANGLE.split("|"), 1))
frame("program_triangle", f"WITH RECURSIVE t(r, v) AS (VALUES {_ROWS}), f(r, best) AS (SELECT r, v FROM t WHERE r = 15 UNION ALL SELECT t.r, list_transform(range(1, len(t.v) + 1), lambda i: t.v[i] + greatest(f.best[i], f.best[i + 1])) FROM f JOIN t ON t.r = f.r - 1) SELECT CAST(best[1] AS BIGINT) AS best FROM f WHERE r = 1")(
    lambda spark: spark.createDataFrame([([[int(x) for x in row.split()] for row in _TRIANGLE.split("|")],)], "rows array<array<bigint>>").select(
        F.get(F.aggregate(F.reverse("rows"), F.array_repeat(F.lit(0).cast("bigint"), 16), lambda below, row: F.transform(row, lambda x, i: x + F.greatest(F.get(below, i), F.get(below, i + 1)))), 0).alias("best")
    )
)


frame("program_prime_factor", "WITH RECURSIVE f(n, d) AS (SELECT CAST(600851475143 AS BIGINT), CAST(2 AS BIGINT) UNION ALL SELECT CASE WHEN n % d = 0 THEN n // d ELSE n END, CASE WHEN n % d = 0 THEN d ELSE d + 1 END FROM f WHERE n > 1) SELECT max(d) AS factor FROM f")(
    lambda spark: spark.range(1, 775147).where("600851475143 % id = 0").selectExpr("explode(array(id, 600851475143 div id)) AS f").where("f > 1 AND NOT exists(sequence(2L, greatest(2L, cast(sqrt(f) AS bigint))), d -> d < f AND f % d = 0)").agg(F.max("f").alias("factor"))
)
frame("program_smallest_multiple", "SELECT CAST(list_reduce(range(1, 21), lambda a, k: lcm(a, k)) AS BIGINT) AS n")(
    lambda spark: spark.range(1).select(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint")), F.lit(1).cast("bigint"), lambda a, k: scalar.int_div(a, _gcd(a, k)) * k).alias("n"))
)
frame("program_divisible_triangle", "SELECT min(t) AS t FROM (SELECT t FROM (SELECT i * (i + 1) // 2 AS t FROM range(1, 12500) r(i)) JOIN range(1, 8840) u(d) ON d * d <= t AND t % d = 0 GROUP BY t HAVING sum(CASE WHEN d * d = t THEN 1 ELSE 2 END) > 500)")(
    lambda spark: spark.range(1, 12500).selectExpr("id * (id + 1) div 2 AS t").where("aggregate(filter(sequence(1, cast(floor(sqrt(t)) as int)), d -> t % d = 0), 0, (a, d) -> a + CASE WHEN d * d = t THEN 1 ELSE 2 END) > 500").agg(F.min("t").alias("t"))
)
frame("program_lattice", "WITH RECURSIVE c(k, b) AS (SELECT 0, CAST(1 AS HUGEINT) UNION ALL SELECT k + 1, b * (20 - k) // (k + 1) FROM c WHERE k < 20) SELECT CAST(sum(b * b) AS BIGINT) AS paths FROM c")(
    lambda spark: spark.range(1).select(F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(1).cast("bigint"), lambda a, k: F.floor(a * (k + 20) / k)).alias("paths"))
)
sql("program_spiral", "SELECT 1 + CAST(sum(4 * (2 * id + 1) * (2 * id + 1) - 12 * id) AS BIGINT) AS s FROM range(1, 501)", "SELECT 1 + CAST(sum(4 * (2 * i + 1) * (2 * i + 1) - 12 * i) AS BIGINT) AS s FROM range(1, 501) t(i)")
frame("program_digit_powers", "SELECT CAST(sum(i) AS BIGINT) AS s FROM range(10, 354295) t(i) WHERE i = list_sum(list_transform(string_split(CAST(i AS VARCHAR), ''), lambda d: CAST(d AS INTEGER) ** 5))")(
    lambda spark: spark.range(10, 354295).where(F.col("id") == F.aggregate(F.split(F.col("id").cast("string"), ""), F.lit(0).cast("bigint"), lambda a, d: a + F.pow(d.cast("bigint"), F.lit(5)).cast("bigint"))).agg(F.sum("id").alias("s"))
)
frame("program_nth_prime", "SELECT n AS prime FROM (SELECT n, row_number() OVER (ORDER BY n) AS k FROM range(2, 105000) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 325) u(d) WHERE d * d <= n AND n % d = 0)) WHERE k = 10001")(
    lambda spark: Seq.range(spark, 2, 105000).filter(lambda n: ~F.exists(F.sequence(F.lit(2), F.lit(324)), lambda d: (d * d <= n) & (n % d == 0))).enumerate().where("index = 10000").select(F.col("item").alias("prime"))
)
frame("program_totient", "WITH RECURSIVE g(n, a, b) AS (SELECT n, n, k FROM range(1, 60) t(n), range(1, 60) u(k) WHERE k <= n UNION ALL SELECT n, b, a % b FROM g WHERE b > 0) SELECT n, count(*) AS phi FROM g WHERE b = 0 AND a = 1 GROUP BY n")(
    lambda spark: spark.range(1, 60).select(F.col("id").alias("n"), F.size(F.filter(F.sequence(F.lit(1).cast("bigint"), F.col("id")), lambda k: _gcd(F.col("id"), k) == 1)).cast("bigint").alias("phi"))
)


def _gcd(a, b):
    """Twelve steps of Euclid's algorithm, enough for numbers below 200, as one expression."""
    pair = F.struct(a.alias("a"), b.alias("b"))
    step = lambda p, _: F.struct(F.when(p["b"] == 0, p["a"]).otherwise(p["b"]).alias("a"), F.when(p["b"] == 0, 0).otherwise(F.pmod(p["a"], F.when(p["b"] != 0, p["b"]))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), pair, step, lambda p: p["a"])


@frame("program_recursive", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 20) SELECT CAST(n AS BIGINT) AS n, CAST(factorial(n) AS BIGINT) AS factorial, a AS fibonacci, CAST(gcd(n * 12, 90) AS BIGINT) AS gcd FROM f")
def _(spark):
    factorial = lambda n: 1 if n < 2 else n * factorial(n - 1)
    fibonacci = lambda n: 1 if n < 3 else fibonacci(n - 1) + fibonacci(n - 2)
    gcd = lambda a, b: a if b == 0 else gcd(b, a % b)
    for name, function in (("host_factorial", factorial), ("host_fibonacci", fibonacci), ("host_gcd", gcd)):
        host.register_rows(spark, name, function, "bigint")
    return spark.sql("SELECT id AS n, host_factorial(id) AS factorial, host_fibonacci(id) AS fibonacci, host_gcd(id * 12, 90L) AS gcd FROM range(1, 21)")


# --- containers -----------------------------------------------------------------------------


@frame("vector_ops", "SELECT o_custkey AS k, count(*) AS n, arg_min(o_orderkey, o_orderkey) AS head, max(o_orderkey) AS tail, CAST(count(*) + 1 AS BIGINT) AS pushed FROM orders GROUP BY o_custkey", "orders")
def _(spark, orders):
    v = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("v"))
    return v.select("k", F.size("v").cast("bigint").alias("n"), F.get("v", 0).alias("head"), F.element_at("v", -1).alias("tail"), F.size(F.array_append("v", F.lit(-1).cast("bigint"))).cast("bigint").alias("pushed"))


@frame("record_ops", "SELECT c_custkey, c_custkey * 2 AS twice, c_mktsegment AS segment FROM customer", "customer")
def _(spark, customer):
    r = customer.select("c_custkey", F.struct("c_custkey", F.col("c_mktsegment").alias("segment")).alias("r"))
    r = r.withColumn("r", F.col("r").withField("twice", F.col("r.c_custkey") * 2).dropFields("c_custkey"))
    return r.select("c_custkey", "r.twice", "r.segment")


@frame("null_bits", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN NULL ELSE user_id END AS unset, coalesce(nullif(user_id, 5), 0) AS reset FROM events", "events")
def _(spark, events):
    return events.select("event_id", F.when(F.col("user_id") % 2 == 0, None).otherwise(F.col("user_id")).alias("unset"), F.coalesce(F.nullif("user_id", F.lit(5).cast("bigint")), F.lit(0).cast("bigint")).alias("reset"))


@frame("option_ops", "SELECT event_id, user_id > 10 AS some, CASE WHEN user_id > 10 THEN user_id ELSE -1 END AS unwrapped, CASE WHEN user_id > 10 THEN user_id + 1 ELSE 0 END AS matched FROM events", "events")
def _(spark, events):
    o = events.withColumn("o", scalar.then_some(F.col("user_id") > 10, F.col("user_id")))
    return o.select("event_id", F.col("o").isNotNull().alias("some"), F.coalesce("o", F.lit(-1).cast("bigint")).alias("unwrapped"), scalar.select(F.col("o").isNotNull(), F.col("o") + 1, F.lit(0).cast("bigint")).alias("matched"))


@frame("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k", "events")
def _(spark, events):
    w = F.session_window("t", "6 hours")
    return over_stream(spark, events, lambda s: s.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "4000 days").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")), "complete").select("user_id", "n")


def _amicable(spark: SparkSession) -> DataFrame:
    divisors = F.filter(F.sequence(F.lit(1), F.lit(5000)), lambda k: (k < F.col("n")) & (F.col("n") % k == 0))
    d = spark.range(2, 10000).toDF("n").withColumn("s", F.aggregate(divisors, F.lit(0).cast("bigint"), lambda a, x: a + x))
    a, b = d.alias("a"), d.alias("b")
    pairs = a.join(b, (F.col("a.s") == F.col("b.n")) & (F.col("b.s") == F.col("a.n"))).where("a.n <> b.n")
    return pairs.agg(F.sum("a.n").alias("total"))


# --- physical shortcuts -------------------------------------------------------------------

QUERIES["count_from_footers"] = lambda spark, d: count_from_footers(spark, f"{d}/lineitem.parquet", "l_partkey")
ORACLE["count_from_footers"] = "SELECT count(*) AS n, count(l_partkey) AS n_l_partkey FROM lineitem"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
